"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Benchmark items become windows of ``n`` words (an item of fewer words is one window). The
windows are broadcast as numbered word tuples behind a hash set. Training texts are scanned
word window by word window; a window whose hash is in the set is verified word by word.

The set's size is measured before it is broadcast. Beyond ``max_windows`` the windows are
dealt by hash into as many parts as needed and each part is broadcast in a pass of its own,
so that what one task holds is bounded however many benchmark items there are. Cuts are repeated
until no window is left, in either case.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _WORD_TABLE, Spool, keyed_text, map_slices, table, words_of

WINDOW = 10
MAX_WINDOWS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, spans array<struct<first:long,end:long>>, items array<string>"
ITEM_SCHEMA = "item string, words array<string>"


class Vocabulary(dict):
    """Numbers of benchmark words; any other word is 0 and can be part of no window."""

    def __missing__(self, word: bytes) -> int:
        return 0


class WindowSet:
    """Windows as tuples of word numbers, with sorted hashes by window length for a vectorised scan."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]) -> None:
        self.vocabulary = Vocabulary()
        self.items: dict[tuple[int, ...], list[str]] = {}
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for words, items in windows.items():
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            self.items[ids] = sorted(items)
            by_length.setdefault(len(ids), []).append(ids)
        self.hashes = {n: np.unique(window_hashes(np.array(rows, np.uint64).ravel(), n)[::n]) for n, rows in by_length.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans hit by verified windows, and the items they belong to."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.uint64, len(words))
        if not ids.any():
            return [], set()
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        hit, items = np.zeros(len(ids) + 1, np.int64), set()
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            h = window_hashes(ids, n)[starts]
            at = np.searchsorted(hashes, h)
            for s in starts[hashes[np.minimum(at, len(hashes) - 1)] == h].tolist():
                found = self.items.get(tuple(ids[s : s + n].tolist()))
                if found is not None:
                    items.update(found)
                    hit[s] += 1
                    hit[s + n] -= 1
        covered = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), items


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each ``n`` consecutive numbers."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + ids[k : k + len(h)]
    return h


def item_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, words) windows, made by the executors; texts without words have none."""

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = dict.fromkeys(
                (i, tuple(w[s : s + n]))
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if (w := [x.decode("utf-8", "surrogatepass") for x in words_of(t)])
                for s in range(max(1, len(w) - n + 1))
            )
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([list(k[1]) for k in seen], pa.list_(pa.string()))], names=["item", "words"])

        return step

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    return map_slices(items, kernel, ITEM_SCHEMA).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word positions, end exclusive), items.

    Null or wordless texts have no words and no hits; null doc_ids stay null; a benchmark
    item without an id marks spans but is not named; repeated documents each get their row;
    an empty benchmark hits nothing; other columns of either table are ignored.
    """
    windows, parts = _parts(benchmark, n, max_windows)
    if parts == 1:
        return _pass(docs, _shared(windows))
    return _passes(docs, _shares(windows, parts)).select("doc_id", "n_words", "spans", "items", F.explode(F.expr("array_repeat(0, int(copies))")).alias("copy")).drop("copy")


def _parts(benchmark: DataFrame, n: int, max_windows: int) -> tuple[DataFrame, int]:
    windows = item_windows(benchmark, n)
    return windows, max(1, math.ceil(windows.count() / max_windows))


def _row_key() -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)


def _shares(windows: DataFrame, parts: int) -> list[Broadcast]:
    part_of = F.pmod(F.xxhash64(F.col("words")), F.lit(parts))
    return [_shared(windows.where(part_of == part)) for part in range(parts)]


def _passes(docs: DataFrame, shares: list[Broadcast]) -> DataFrame:
    """One pass for each part of the windows; a row for each distinct (doc_id, text), by its key."""
    return (
        reduce(DataFrame.unionByName, [_pass(docs, shared, "row_key") for shared in shares])
        .groupBy("row_key")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            _merge_spans("flatten(collect_list(spans))").alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            (F.count("*") / len(shares)).cast("long").alias("copies"),
        )
    )


def _merge_spans(name: str) -> Column:
    """Union of word spans, in order."""
    return F.expr(
        f"""aggregate(array_sort({name}), cast(array() as array<struct<first:bigint,end:bigint>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).end >= s.first,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, s.end)))),
           concat(acc, array(s))))"""
    )


def _shared(windows: DataFrame) -> Broadcast:
    found: dict[tuple[bytes, ...], set[str]] = {}
    for row in windows.toLocalIterator():
        named = found.setdefault(tuple(w.encode("utf-8", "surrogatepass") for w in row["words"]), set())
        if row["item"] is not None:
            named.add(row["item"])
    return windows.sparkSession.sparkContext.broadcast(WindowSet(found))


def _pass(docs: DataFrame, shared: Broadcast, key: str | None = None) -> DataFrame:
    def kernel():
        windows_here = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, spans, items = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split()
                s, i = windows_here.scan(words)
                counts.append(len(words))
                spans.append([{"first": a, "end": b} for a, b in s])
                items.append(sorted(i))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(arrays + ([batch.column(2)] if key else []), names=["doc_id", "n_words", "spans", "items", *([key] if key else [])])

        return step

    texts = keyed_text(docs)
    return map_slices(texts.withColumn(key, _row_key()) if key else texts, kernel, SCHEMA + (f", {key} string" if key else ""))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what separates them; the rest stays as it is."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(_WORD_TABLE)
    bounds, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def _cut_in_passes(docs: DataFrame, shares: list[Broadcast], drop_share: float | None) -> DataFrame:
    """(sparkloom_key, sparkloom_text, sparkloom_drop) for each distinct (doc_id, text) with hits, cut until none is left.

    Every round goes over the documents that the round before has cut, so the rounds end: each takes words away.
    """

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, drop = [], []
            for text, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                hits = [(s["first"], s["end"]) for s in given]
                drop.append(drop_share is not None and sum(b - a for a, b in hits) >= drop_share * len(words_of(text)))
                texts.append(remove_spans(text, hits))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(drop, pa.bool_())], names=["sparkloom_key", "doc_id", "text", "sparkloom_drop"])

        return step

    spool, done, at = Spool(docs.sparkSession), None, 0
    pending = docs.select(_row_key().alias("sparkloom_key"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("sparkloom_drop"))
    while True:
        found = spool.save(_passes(pending, shares).where(F.size("spans") > 0).select("row_key", "spans"), f"hits-{at}")
        known = pending.withColumn("row_key", _row_key())
        if at:
            clean = known.join(found, "row_key", "left_anti").select(*pending.columns)
            done = clean if done is None else done.unionByName(clean)
        if found.isEmpty():
            break
        hit = known.dropDuplicates(["sparkloom_key"]).join(found, "row_key").select("sparkloom_key", "doc_id", "text", "spans")
        pending = spool.save(map_slices(hit, kernel, "sparkloom_key string, doc_id long, text string, sparkloom_drop boolean"), f"cut-{at}")
        if at == 0 and drop_share is not None:
            done, pending = pending.where("sparkloom_drop"), pending.where("not sparkloom_drop")
        drop_share, at = None, at + 1
    if done is None:
        done = pending.limit(0)
    return done.select("sparkloom_key", F.col("text").alias("sparkloom_text"), "sparkloom_drop")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, drop_share: float | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with the hit spans cut from their texts; documents hit nowhere stay as they are.

    Only documents with hits change. With ``drop_share``, documents of which at least that share
    of words is hit are dropped instead. All columns, their order and repeated rows stay; if the
    table has n_chars, it is counted again where text was cut. Null texts stay null.
    """
    windows, parts = _parts(benchmark, n, max_windows)
    source, shared = docs, None
    if parts == 1:
        shared = _shared(windows)
    else:
        cuts = _cut_in_passes(docs, _shares(windows, parts), drop_share)
        source = docs.withColumn("sparkloom_key", _row_key()).join(cuts, "sparkloom_key", "left").select(*docs.columns, "sparkloom_text", "sparkloom_drop")
    schema = docs.schema

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.names.index("text")
            texts, keep = batch.column(at).to_pylist(), []
            given = None
            if shared is None:
                given = list(zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("sparkloom_text", "sparkloom_drop")), strict=True))
            changed = []
            for i, text in enumerate(texts):
                if given is not None:
                    cut, drop = given[i]
                    if drop:
                        continue
                    keep.append(i)
                    if cut is not None:
                        changed.append(i)
                        texts[i] = cut
                    continue
                hits = shared.value.scan(words_of(text))[0] if text else []
                if hits and drop_share is not None and sum(b - a for a, b in hits) >= drop_share * len(words_of(text)):
                    continue
                keep.append(i)
                if hits:
                    changed.append(i)
                while hits:
                    texts[i] = remove_spans(texts[i], hits)
                    hits = shared.value.scan(words_of(texts[i]))[0]  # what the cut has brought together
            columns = [batch.column(k) for k in range(len(schema.names))]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in schema.names and changed:
                k = schema.names.index("n_chars")
                counts = columns[k].to_pylist()
                for i in changed:
                    counts[i] = len(texts[i])
                columns[k] = pa.array(counts, columns[k].type)
            return pa.RecordBatch.from_arrays(columns, names=schema.names).take(pa.array(keep, pa.int64()))

        return step

    return map_slices(source, kernel, schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL = {
    "op4_decontaminate": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS k FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT p.r, p.s, p.n, x.item_id FROM (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM places) p JOIN windows x ON p.k = x.k AND p.n = x.n),
covered AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.r = d.r LEFT JOIN named i ON i.r = d.r
"""
}
