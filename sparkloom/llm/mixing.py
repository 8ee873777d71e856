"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed into cells of source, language and topic. The cells' token weights are
raked: scaled to the target share of each source, then of each language, then of each topic,
round after round until all three marginals hold. From the fitted weights every cell gets a
sampling probability; where a cell has too few tokens for its share its probability is 1 and
the others are calibrated so that the expected tokens still meet the budget. A document is
sampled if a hash of its id and text, uniform in [0, 1), is below its cell's probability.

Only the cells are iterated over. Few cells (``SMALL_CELLS``) are held by one task, so that
no round shuffles; more are dealt out by hash and raked by the same windows.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

DIMENSIONS = ("source", "lang", "topic")
KEEP_SHARE = 0.5
TEMPER = 0.7
ROUNDS, MOST_ROUNDS, TOLERANCE = 6, 48, 1e-6
SMALL_CELLS = 50_000
MISSING = "(none)"


def topic_of(text: Column) -> Column:
    """The form of a text: table, capitals, symbols, note (short) or prose; a stand-in where documents carry no topic."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!! "), "capitals")
        .when(text.contains("***") | text.contains("%%%"), "symbols")
        .when(F.char_length(text) < 400, "note")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Tokens as a quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4)


def _prepared(docs: DataFrame) -> DataFrame:
    """The columns used, under names of their own (d_source, d_lang, d_topic, d_tokens, d_draw), and the whole row as ``row``, so that no name clashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(text)
    draw = F.pmod(F.xxhash64("doc_id", text, F.lit(17)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    named = {d: F.coalesce(c.cast("string"), F.lit(MISSING)) for d, c in (("source", F.col("source")), ("lang", F.col("lang")), ("topic", topic))}
    return docs.select(F.struct("*").alias("row"), *(c.alias(f"d_{d}") for d, c in named.items()), tokens_of(text).cast("long").alias("d_tokens"), draw.alias("d_draw"))


def fit_cells(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep_share: float = KEEP_SHARE, temper: float = TEMPER) -> DataFrame:
    """(d_source, d_lang, d_topic, tokens, weight, probability), a row for each cell with tokens.

    ``targets``: wanted shares by dimension and value; values that are not named share what is left
    in proportion to their tokens. A dimension without targets gets its tokens to the power ``temper``.
    """
    names = [f"d_{d}" for d in DIMENSIONS]
    cells = cut(_prepared(docs).groupBy(*names).agg(F.sum("d_tokens").alias("tokens")).where("tokens > 0"))
    small = cells.count() <= SMALL_CELLS
    if small:
        cells = cells.coalesce(1)
    everything = Window.partitionBy(F.lit(0))
    for d in DIMENSIONS:
        own = F.sum("tokens").over(Window.partitionBy(f"d_{d}"))
        cells = cells.withColumn(f"own_{d}", own.cast("double")).withColumn("rows", F.count("*").over(Window.partitionBy(f"d_{d}")))
        if targets and d in targets:
            pairs = [x for v, share in targets[d].items() for x in (F.lit(v), F.lit(float(share)))]
            named = F.try_element_at(F.create_map(*pairs), F.col(f"d_{d}"))
            rest = max(0.0, 1.0 - sum(targets[d].values()))
            others = F.sum(F.when(named.isNull(), F.col("tokens"))).over(everything)
            raw = F.coalesce(named, F.col(f"own_{d}") * rest / others)
        else:
            raw = F.pow(F.col(f"own_{d}"), F.lit(temper))
        cells = cells.withColumn("raw", raw).withColumn(f"goal_{d}", F.col("raw") / F.sum(F.col("raw") / F.col("rows")).over(everything))
    cells = cut(cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(everything)).select(*names, "tokens", "weight", *(f"goal_{d}" for d in DIMENSIONS)))
    for _ in range(0, MOST_ROUNDS, ROUNDS):
        cells = cells.coalesce(1) if small else cells
        for _ in range(ROUNDS):
            for d in DIMENSIONS:
                held = F.sum("weight").over(Window.partitionBy(f"d_{d}"))
                cells = cells.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"goal_{d}") / held).otherwise(F.lit(0.0)))
        cells = cut(cells)
        off = reduce(F.greatest, (F.abs(F.sum("weight").over(Window.partitionBy(f"d_{d}")) - F.col(f"goal_{d}")) for d in DIMENSIONS))
        worst = (cells.coalesce(1) if small else cells).select(off.alias("off")).agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        warnings.warn(f"the marginals are still off by {worst:.2g} after {MOST_ROUNDS} rounds: no weights of these cells may meet all targets", stacklevel=2)
    cells = cells.coalesce(1) if small else cells
    ordered = Window.partitionBy(F.lit(0)).orderBy("ratio", *names)
    upward = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.lit(keep_share) * F.sum("tokens").over(everything)
    scale = (F.col("budget") - F.coalesce(F.sum("tokens").over(upward), F.lit(0))) / F.sum("weight").over(onward)
    sized = cells.where("weight > 0").withColumn("ratio", F.col("tokens") / F.col("weight")).withColumn("budget", budget).withColumn("scale", scale)
    fits = F.min(F.when(F.col("scale") <= F.col("ratio"), F.struct("ratio", "scale"))).over(everything)
    sized = sized.withColumn("fit", fits["scale"])
    probability = F.when(F.col("fit").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("fit") * F.col("weight") / F.col("tokens")))
    return cut(sized.select(*names, "tokens", "weight", probability.alias("probability")))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep_share: float = KEEP_SHARE, temper: float = TEMPER) -> DataFrame:
    """All columns of ``docs``, and mix_topic, mix_tokens, mix_weight, mix_probability, mix_sampled.

    Null sources, languages and topics form cells of their own; documents without text hold no
    tokens, have weight 0 and probability 1 (they cost nothing, and are kept); repeated rows draw alike;
    an empty table gives an empty result; columns of other names stay, whatever they are called, and
    mix_ columns of an earlier mixing are replaced. The draw is a hash, so a rerun samples the same rows.
    """
    docs = docs.drop(*(f"mix_{c}" for c in ("topic", "tokens", "weight", "probability", "sampled")))
    names = [f"d_{d}" for d in DIMENSIONS]
    cells = fit_cells(docs, targets, keep_share, temper).select(*(F.col(n).alias(f"c{n}") for n in names), F.col("weight").alias("c_weight"), F.col("tokens").alias("c_tokens"), F.col("probability").alias("c_probability"))
    small = cells.count() <= SMALL_CELLS
    rows = _prepared(docs)
    on = [F.col(n) == F.col(f"c{n}") for n in names]
    joined = rows.join(F.broadcast(cells) if small else cells, on, "left")
    probability = F.when(F.col("d_tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("c_probability", F.lit(0.0)))
    return joined.select(
        "row.*",
        F.col("d_topic").alias("mix_topic"),
        F.col("d_tokens").alias("mix_tokens"),
        F.coalesce(F.col("c_weight") * F.col("d_tokens") / F.col("c_tokens"), F.lit(0.0)).alias("mix_weight"),
        probability.alias("mix_probability"),
        (F.col("d_draw") < probability).alias("mix_sampled"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", *(c for c in mixed.columns if c.startswith("mix_")))


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLE_SQL: dict[str, str] = {}
