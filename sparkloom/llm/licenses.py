"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined with the positions of the same
k-grams in the license templates. A hit votes for the diagonal ``text position - template
position`` of its template; votes are aggregated as bit masks of template positions before
the shuffle. Neighbouring diagonals (a word more or less inside the notice) are merged, and
a span is verified when enough of its template has voted: all of it, on one diagonal, for
the short phrases, ``MIN_COVERAGE`` of its k-grams for the longer notices, and of those all that
tell a notice from its near-identical neighbours (see ``needed``): a gram that has voted says that
two words of the template stand side by side in the text, so a version, a clause or a word
between them that makes it another license is seen where its gram is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

K = 2
NEIGHBOUR = 2
MIN_COVERAGE = 0.75
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases of the base scan and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Opening words of well-known notices (at most 62 words each).
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)

#: Words that make a notice another one, beside numbers, and the word that such words follow.
CLAUSES = frozenset(("sa", "nc"))
FOLLOWED = frozenset(("gnu",))

#: The template that every document hits once, so that documents without hits keep their row.
PRESENT = "\x01"


def _gram(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def needed(words: str) -> int:
    """Bit mask of the places of a notice whose grams have to vote: those with a number or a clause, and those after which another license is named."""
    given = words.split()
    return sum(1 << i for i, (a, b) in enumerate(zip(given, given[1:])) if a in FOLLOWED or any(w.isdigit() or w in CLAUSES for w in (a, b)))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(gram, template, place, label, base, full, need): one row for each k-gram position; as large as its parameters."""
    rows = [(t, label, base) for given, base in ((phrases, True), (notices, False)) for t, label in given]
    short = [t for t, _, _ in rows if not 1 < len(t.split()) <= 62]
    if short:
        raise ValueError(f"templates need 2 to 62 words: {short}")
    listed = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(t).alias("words"), F.lit(label).alias("label"), F.lit(b).alias("base"), F.lit(0 if b else needed(t)).cast("long").alias("need")) for i, (t, label, b) in enumerate(rows)))
    words = spark.range(1).select(F.inline(listed)).withColumn("words", F.split("words", " "))
    grams = F.transform(F.expr(f"slice(words, 1, size(words) - {K - 1})"), lambda w, i: _gram(w, F.get("words", i + 1)))
    hits = words.select("template", "label", "base", (F.size("words") - (K - 1)).alias("full"), "need", F.posexplode(grams).alias("place", "gram"))
    present = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("full"), F.lit(0).cast("long").alias("need"), F.lit(0).alias("place"), _gram(F.lit(PRESENT), F.lit(PRESENT)).alias("gram"))
    return hits.unionByName(present)


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, spans array<struct<first, words, label, base, coverage>>.

    Null text is empty: no words, no spans. Null ids stay null; repeated rows each get their row;
    an empty table gives an empty result; other columns are ignored. Texts are scanned whole.
    """
    cut = F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), cut.alias("parts"))
    lead = (F.get("parts", F.lit(0)) == "").cast("int")
    trail = (F.element_at("parts", -1) == "").cast("int")
    grams = F.transform("parts", lambda w, i: _gram(w, F.get("parts", i + 1)))
    grams = F.concat(F.array(_gram(F.lit(PRESENT), F.lit(PRESENT))), grams)
    rolled = texts.select("id", "text_key", F.greatest(F.size("parts") - lead - trail, F.lit(0)).cast("long").alias("n_words"), lead.alias("lead"), F.posexplode(grams).alias("at", "gram"))
    found = rolled.join(F.broadcast(templates(docs.sparkSession, phrases, notices)), "gram")
    key = ["id", "text_key", "n_words"]
    diagonal = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("at") - 1 - F.col("lead") - F.col("place"))
    votes = (
        found.withColumn("diagonal", diagonal)
        .groupBy(*key, "template", "diagonal")
        .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("full").alias("full"), F.first("need").alias("need"), F.count("*").alias("hits"))
    )
    by_template = Window.partitionBy(*key, "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(by_template) <= F.lit(NEIGHBOUR)
    grouped = votes.withColumn("opens", (F.col("base") | ~F.coalesce(near, F.lit(False))).cast("int")).withColumn("band", F.sum("opens").over(by_template))
    coverage = F.bit_count("mask") / F.col("full")
    spans = (
        grouped.groupBy(*key, "template", "band")
        .agg(F.bit_or("mask").alias("mask"), F.min("diagonal").alias("first"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("full").alias("full"), F.first("need").alias("need"), F.sum("hits").alias("hits"))
        .withColumn("coverage", F.when(F.col("full") > 0, coverage).otherwise(F.lit(0.0)))
        .where((F.col("template") < 0) | F.when(F.col("base"), F.col("coverage") == 1.0).otherwise((F.col("coverage") >= MIN_COVERAGE) & (F.col("mask").bitwiseAND(F.col("need")) == F.col("need"))))
    )
    span = F.struct(F.greatest(F.col("first"), F.lit(0)).cast("long").alias("first"), (F.col("full") + K - 1).cast("long").alias("words"), "label", "base", "coverage")
    per_doc = spans.groupBy(*key).agg(
        F.max(F.when(F.col("template") < 0, F.col("hits"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(F.col("template") >= 0, span))).alias("spans"),
    )
    return per_doc.select(F.col("id").alias(id_col), "n_words", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL: dict[str, str] = {}
