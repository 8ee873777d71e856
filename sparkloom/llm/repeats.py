"""Removal of every byte under a ``LENGTH``-byte string that starts anywhere else, too.

The strings that repeat are found by column-wise construction over aligned segments:

* Every ``LENGTH`` bytes of a text hold an anchor, the smallest hash of its ``GRAM``-byte strings
  (a minimizer), and two equal strings hold it in the same place. So all equal strings are among
  the segments about equal anchors, and stand in them at the same offset.
* Anchors whose hash is unique are dropped. Where all segments of an anchor are equal, all
  their strings repeat.
* The distinct segments of every other anchor are one collection. It is built column by column
  from the right: each round inserts one symbol per segment in front of the suffixes sorted so
  far, which yields the next column of the collection's positional Burrows-Wheeler transform and,
  from it and the last round alone, the next common prefixes of neighbours. A string repeats
  where a common prefix with a neighbour is at least ``LENGTH``. A round needs the order and the
  prefixes of the last one and one column, read in sequence; many collections share a round.
* A collection of more than ``MAX_COLLECTION`` segments is not built in one task: its strings are
  dealt out by offset and hash and counted, exactly alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spool, keyed_text, map_slices, mix64, table

LENGTH = 400
GRAM = 100
SPAN = 2 * LENGTH - GRAM
MAX_COLLECTION = 20_000
ROUND_SEGMENTS = 8192
BROADCAST_ROWS = 300_000
BROADCAST_RUNS = 2_000_000  # 24 bytes each
END = 256
SPANS = "array<struct<first:long,end:long>>"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hasher:
    """Polynomial hashes of all substrings of one length, by prefix sums; power tables grow as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, raw: np.ndarray, size: int) -> np.ndarray:
        n = len(raw)
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, max(n, 1 << 16)), _powers(_INVERSE, max(n, 1 << 16))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[:n])])
        return mix64((total[size:] - total[:-size]) * self.up[: n - size + 1])


def anchors(raw: np.ndarray, hasher: Hasher, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the leftmost smallest gram in each ``length`` bytes, each once."""
    if len(raw) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = hasher(raw, gram)
    width = length - gram + 1
    pad = -len(h) % width
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(behind[: len(h) - width + 1], ahead[width - 1 : len(h)])
    # The leftmost equal position at or after each window's start: the next occurrence of its minimum.
    order = np.argsort(h, kind="stable")
    first = np.searchsorted(h[order], lowest, side="left")
    changes = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
    ends = np.concatenate([changes[1:], [len(lowest)]])
    found = []
    for start, end, at in zip(changes.tolist(), ends.tolist(), first[changes].tolist(), strict=True):
        value, s = lowest[start], start
        if at + 1 >= len(order) or h[order[at + 1]] != value:
            found.append(int(order[at]))
            continue
        while s < end:  # windows with one minimum that occurs more than once
            p = s + int(np.argmax(h[s : s + width] == value))
            found.append(p)
            s = p + 1
    positions = np.unique(np.array(found, np.int64))
    return positions, h[positions]


def segment(raw: bytes, at: int) -> tuple[int, bytes]:
    """What stands about an anchor, and how many columns of it are before the text's start."""
    start = at + GRAM - LENGTH
    return max(0, -start), raw[max(0, start) : at + LENGTH]


def _ranges(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def repeated_starts(groups: np.ndarray, columns: np.ndarray, several: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each segment (rows) and column, whether the ``length`` symbols from there repeat in its group.

    ``groups`` is sorted; ``columns`` (column x segment) holds symbols, END outside of texts;
    ``several`` marks segments that themselves stand in several places.
    """
    width, m = columns.shape
    starts = width - length + 1
    flags = np.zeros((m, max(0, starts)), bool)
    order, prefix = np.arange(m), np.zeros(m, np.int32)
    inside = np.zeros(m, np.int32)
    scaled = groups.astype(np.int64) * 512
    for c in range(width - 1, -1, -1):
        column = columns[c]
        inside = np.where(column == END, 0, inside + 1)
        symbols = column[order]
        key = scaled + symbols
        fresh = np.zeros(m, np.int32)
        if (key[1:] >= key[:-1]).all():
            same = key[1:] == key[:-1]
            fresh[1:] = np.where(same & (symbols[1:] != END), prefix[1:] + 1, 0)
        else:
            move = np.argsort(key, kind="stable")
            key, order, symbols = key[move], order[move], symbols[move]
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbols[1:] != END))
            before, here = move[same], move[same + 1]
            least = prefix[here]
            far = np.flatnonzero(here - before > 1)
            if len(far):
                bounds = np.column_stack([before[far] + 1, here[far] + 1]).ravel()
                least[far] = np.minimum.reduceat(np.append(prefix, 0), bounds)[::2]
            fresh[same + 1] = least + 1
        prefix = fresh
        if c < starts:
            long = prefix >= length
            long[:-1] |= long[1:]
            flags[order[long], c] = True
            flags[:, c] |= several & (inside >= length)
    return flags


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, segment, several, lead, content) sorted by anchor; whole collections, many at a time."""
    held: list[tuple] = []

    def build(rows: list[tuple]) -> pa.RecordBatch:
        groups = np.cumsum([0] + [int(a[0] != b[0]) for a, b in zip(rows, rows[1:], strict=False)])
        columns = np.full((len(rows), SPAN), END, np.uint16)
        for i, (_, _, _, lead, content) in enumerate(rows):
            columns[i, lead : lead + len(content)] = np.frombuffer(content, np.uint8)
        flags = repeated_starts(groups, np.ascontiguousarray(columns.T), np.array([r[2] for r in rows]))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        kept = [(r[0], r[1], _ranges(f)) for r, f in zip(rows, flags, strict=True) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], kind)], names=["anchor", "segment", "starts"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and row[:2] == held[-1][:2]:
                continue  # from a repeated row
            if len(held) >= ROUND_SEGMENTS and row[0] != held[-1][0]:
                yield build(held)
                held = []
            held.append(row)
    if held:
        yield build(held)


def _anchor_rows(texts: DataFrame) -> DataFrame:
    def kernel():
        hasher = Hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[], [], [], [], []]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                at, h = anchors(np.frombuffer(raw, np.uint8), hasher)
                rows[0] += [row] * len(at)
                rows[1].append(h.view(np.int64))
                rows[2] += [xxhash.xxh3_64_intdigest(content, lead) - (1 << 63) for lead, content in (segment(raw, p) for p in at.tolist())]
                rows[3] += at.tolist()
                rows[4] += [len(raw)] * len(at)
            flat = np.concatenate(rows[1]) if rows[1] else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(flat, pa.int64()), *(pa.array(rows[i], pa.int64()) for i in (2, 3, 4))], names=["row", "anchor", "segment", "at", "n"])

        return step

    return map_slices(texts.select("row", "text"), kernel, "row long, anchor long, segment long, at long, n long", 64)


def _segment_rows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, segment, several, lead, content) of wanted (anchor, segment, several, row, at), cut from their texts; twice where a row stands twice."""
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "segment", "several", "at")).alias("wanted"))
    few = by_row.count() <= BROADCAST_ROWS and wanted.count() <= 4 * BROADCAST_ROWS
    found = texts.join(F.broadcast(by_row) if few else by_row, "row").select("text", "wanted")

    def kernel():
        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                cut = [segment(raw, w["at"]) for w in wanted]
                out.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([w["segment"] for w in wanted], pa.int64()), pa.array([w["several"] for w in wanted], pa.bool_()), pa.array([c[0] for c in cut], pa.int32()), pa.array([c[1] for c in cut], pa.binary())],
                        names=["anchor", "segment", "several", "lead", "content"],
                    )
                )
            return out

        return step

    return map_slices(found, kernel, "anchor long, segment long, several boolean, lead int, content binary")


def _counted(segments: DataFrame) -> DataFrame:
    """``starts`` of the segments of large collections: every string dealt out by offset and hash, and counted."""

    def kernel():
        hasher = Hasher()

        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for anchor, seg, several, lead, content in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if len(content) >= LENGTH:
                    h = hasher(np.frombuffer(content, np.uint8), LENGTH).view(np.int64)
                    n = len(h)
                    out.append(pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array([several] * n, pa.bool_()), pa.array(np.arange(lead, lead + n), pa.int64()), pa.array(h)], names=["anchor", "segment", "several", "place", "string"]))
            return out

        return step

    strings = map_slices(segments, kernel, "anchor long, segment long, several boolean, place long, string long")
    seen = strings.groupBy("anchor", "place", "string").agg(F.count("*").alias("held"), F.max("several").alias("any")).where("held > 1 or any").select("anchor", "place", "string")
    hits = strings.join(seen, ["anchor", "place", "string"], "left_semi").groupBy("anchor", "segment").agg(F.collect_list("place").alias("places"))

    def ranges():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            starts = []
            for places in batch.column(2).to_pylist():
                flags = np.zeros(SPAN, bool)
                flags[places] = True
                starts.append(_ranges(flags))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, kind)], names=["anchor", "segment", "starts"])

        return step

    return map_slices(hits, ranges, "anchor long, segment long, starts array<struct<first:long,last:long>>")


def find_repeats(docs: DataFrame, spool: Spool, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (row, id, text) and, for each row with repeats, the maximal runs of their bytes (row, spans<first, end>)."""
    texts = keyed_text(docs, id_col, text_col).select(F.xxhash64(F.col(id_col), "text").alias("row"), F.col(id_col).alias("id"), "text")
    marked = spool.save(_anchor_rows(texts), "anchors")
    kept = marked.groupBy("anchor").agg(F.count("*").alias("rows"), F.min("segment").alias("least"), F.max("segment").alias("most")).where("rows > 1").select("anchor", (F.col("least") == F.col("most")).alias("alike"))
    kept = spool.save(kept, "kept")  # a plain join of two tables, so that a hot anchor's partition can be split
    shared = spool.save(marked.join(kept, "anchor"), "shared")
    distinct = shared.where("not alike").groupBy("anchor", "segment").agg(F.count("*").alias("rows"), F.min(F.struct("row", "at")).alias("of"))
    wanted = spool.save(distinct.select("anchor", "segment", (F.col("rows") > 1).alias("several"), "of.row", "of.at"), "wanted")
    segments = spool.save(_segment_rows(texts, wanted), "segments")
    sizes = wanted.groupBy("anchor").agg(F.count("*").alias("size")).where(F.col("size") > MAX_COLLECTION).select("anchor")
    large = spool.save(sizes, "large")
    small = segments.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "segment")
    starts = small.select("anchor", "segment", "several", "lead", "content").mapInArrow(_collections, "anchor long, segment long, starts array<struct<first:long,last:long>>")
    if not large.isEmpty():
        starts = starts.unionByName(_counted(segments.join(large, "anchor", "left_semi").dropDuplicates(["anchor", "segment"]).select("anchor", "segment", "several", "lead", "content")))
    starts = spool.save(starts, "starts")
    origin = F.col("at") + (GRAM - LENGTH)
    alike = shared.where("alike").select("row", F.greatest(origin, F.lit(0)).alias("first"), F.least(F.col("at") + LENGTH, F.col("n")).alias("end"))
    built = shared.where("not alike").join(starts, ["anchor", "segment"]).select("row", origin.alias("origin"), F.explode("starts").alias("s"))
    built = built.select("row", (F.col("origin") + F.col("s.first")).alias("first"), (F.col("origin") + F.col("s.last") + LENGTH).alias("end"))
    spans = alike.unionByName(built).groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("spans"))

    def runs():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(1)
            flat, edges = column.flatten(), np.concatenate([[0], np.cumsum([len(x) for x in column])]).tolist()
            first, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            found = [[{"first": x, "end": y} for x, y in merged(first[a:b], end[a:b])] for a, b in zip(edges, edges[1:], strict=False)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], names=["row", "spans"])

        return step

    return texts, spool.save(map_slices(spans, runs, f"row long, spans {SPANS}"), "spans")


def merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    opens = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return list(zip(first[opens].tolist(), reach[np.append(opens[1:], len(first)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, spans (maximal removed runs of bytes, end exclusive), kept (bytes).

    Null text is empty. Texts under ``LENGTH`` bytes keep everything; a text that stands in
    two rows is removed from both, repeated rows included; null ids stay null; an empty table
    gives an empty result; other columns are ignored. What is kept may not be whole UTF-8.
    """
    spool = Spool(docs.sparkSession)
    texts, spans = find_repeats(docs, spool, id_col, text_col)
    runs = spans.agg(F.sum(F.size("spans") + 2)).first()[0] or 0
    joined = texts.join(F.broadcast(spans) if runs <= BROADCAST_RUNS else spans, "row", "left").select("id", "text", "spans")

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            runs = [[(x["first"], x["end"]) for x in s or []] for s in batch.column(2).to_pylist()]
            kept = []
            for r, gone in zip(raw, runs, strict=True):
                ends = [0, *(b for _, b in gone)]
                kept.append(b"".join(r[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(r)], strict=True)))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([[{"first": a, "end": b} for a, b in g] for g in runs], kind), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

        return step

    for name in ("anchors", "kept", "shared", "wanted", "segments", "large", "starts"):
        spool.drop(name)
    return map_slices(joined, kernel, f"{id_col} long, n_bytes long, spans {SPANS}, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE_SQL = {
    "op5_suffix_dedup": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS s FROM docs WHERE octet_length(b) >= 400),
strings AS (SELECT r, s, md5(array_slice(b, s, s + 399)) AS k FROM starts),
repeated AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM strings) WHERE n > 1),
marked AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS opens FROM repeated),
numbered AS (SELECT r, s, sum(opens) OVER (PARTITION BY r ORDER BY s) AS span FROM marked),
spans AS (SELECT r, span, min(s) AS begun, max(s) + 400 AS stop FROM numbered GROUP BY r, span),
edges AS (
  SELECT r, stop AS lo, lead(begun) OVER (PARTITION BY r ORDER BY begun) AS hi FROM spans
  UNION ALL SELECT r, 1, min(begun) FROM spans GROUP BY r),
pieces AS (
  SELECT e.r, string_agg(hex(array_slice(d.b, e.lo, coalesce(e.hi - 1, octet_length(d.b)))), '' ORDER BY e.lo) AS kept
  FROM edges e JOIN docs d ON d.r = e.r WHERE e.lo < coalesce(e.hi, octet_length(d.b) + 1) GROUP BY e.r),
sizes AS (SELECT r, sum(stop - begun) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(z.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(z.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN z.r IS NULL THEN d.b ELSE unhex(coalesce(p.kept, '')) END) AS kept_sha256
FROM docs d LEFT JOIN sizes z ON z.r = d.r LEFT JOIN pieces p ON p.r = d.r
"""
}
