"""Exact n-gram Jaccard self-join with set-relation skipping.

Every text becomes the set of its distinct word shingles; equal sets are one set from then
on. All sets put their shingles into one order, rare ones first (by a count sketch of all
shingles, then by hash), and are indexed under the first ``n - ceil(0.75 n) + 1`` of them:
two sets that link share one of those. An index list holds each set's size and the position of
the shingle in it. Lists of one set say nothing and are dropped; no other list is cut short.

Pairs of a list are not emitted. The relations between sets decide most of them:

1. each set is compared with the leaders of its lists, and what links is one component;
2. lists within one component are skipped. Of the others only the distinct (component, size,
   position) are kept, in order, and read in blocks: a block pair is skipped where even the
   largest rest after a position, or the sizes, rule a link out. What is left names pairs of
   components that may link, not pairs of sets;
3. of two such components all sets of the smaller are compared with all of the larger, whose
   sets are an index in memory (in blocks of bounded size). The overlaps of one set with the
   whole block are its answers, and are derived from those of the set before by the shingles in
   which the two differ.

Before sets are compared, their parities by bucket are: the bits in which two differ are
shingles that only one has, and too many rule a link out. A comparison itself is exact, so the
result rests on nothing but 64-bit hashes standing for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Spool, keyed_text, mix64, table
from .components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
#: The count sketch: buckets of all shingles, in chunks that are summed apart. Its size does not depend on the data.
SKETCH_BITS, CHUNK_BITS = 20, 14
#: Buckets of a set's parities, at least and at most.
PARITY = 512, 1 << 16
LIST_BLOCK, LIST_ROWS = 64, 4096
BLOCK_SHINGLES, BLOCK_PROBES = 500_000, 500
SEEN_SETS = 200_000
BROADCAST_ROWS = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words; a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle, one without words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix64(h * _ODD + w[i : i + len(h)])
    return np.unique(h)


def set_id(s: np.ndarray) -> int:
    return int(mix64(mix64(s ^ _SECOND).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def parity(s: np.ndarray) -> bytes:
    """How many shingles are in each bucket, modulo 2; two buckets and more for a shingle, a power of two."""
    width = min(PARITY[1], max(PARITY[0], 1 << (2 * len(s) - 1).bit_length()))
    counts = np.bincount(((s >> np.uint64(7)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (rows of words) of fewer buckets."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def prefix_size(n):
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def rare_first(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of a set under which it is indexed, in the order of all sets: by level of the sketch, then by hash."""
    order = np.argsort(levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return s[order[: prefix_size(len(s))]]


def may_link(na, ra, nb, rb):
    """Whether sets of these sizes, with these many shingles from their first common one on, can link."""
    rest = np.minimum(ra, rb) * (NUMERATOR + DENOMINATOR) >= (na + nb) * NUMERATOR
    return rest & (np.minimum(na, nb) * DENOMINATOR >= np.maximum(na, nb) * NUMERATOR)


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_shingles, set_id, bits) for each document, set_id null if its set is empty, and the sketch of each task (chunk, counts)."""
    chunks, width = 1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS
    schema = "id long, text_key long, n_shingles long, set_id long, bits binary, chunk int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    none = lambda n, kind: pa.nulls(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(chunks * width, np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                sets = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
                if any(map(len, sets)):
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([parity(s) if len(s) else None for s in sets], pa.binary()), none(n, pa.int32()), none(n, pa.binary())],
                    names=names,
                )
        few = np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(chunks, width)
        for i in np.flatnonzero(few.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([*(none(1, pa.int64()) for _ in range(4)), none(1, pa.binary()), pa.array([i], pa.int32()), pa.array([few[i].tobytes()], pa.binary())], names=names)

    return _with_key(docs, id_col, text_col).mapInArrow(run, schema)


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def sketch_levels(profiles: DataFrame) -> np.ndarray:
    """How common the shingles of each bucket are: 0 where not more than chance explains, then by powers of two."""
    width = 1 << CHUNK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, np.zeros(width, np.uint64)) + np.frombuffer(counts, np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    parts = profiles.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect()
    total = np.zeros(1 << SKETCH_BITS)
    for r in parts:
        total[r["chunk"] * width : (r["chunk"] + 1) * width] += np.frombuffer(r["counts"], np.uint64)
    mean = total.mean()
    return np.log2(np.maximum(total - mean - 5 * np.sqrt(mean), 0) / 8 + 1).astype(np.uint8)


def index_lists(docs: DataFrame, levels: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, set_id, n, place, leader): the index lists of two sets and more; a leader is a list's smallest set_id."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["token", "set_id", "n", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                out: list[list[np.ndarray]] = [[], [], [], []]
                for text in whole.column(1).slice(at, SLICE_ROWS).to_pylist():
                    s = shingles(text, hashes)
                    if not len(s) or (own := set_id(s)) in seen:
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(own)
                    first = rare_first(s, shared.value)
                    k = len(first)
                    for column, values in zip(out, (first.view(np.int64), np.full(k, own, np.int64), np.full(k, len(s), np.int32), np.arange(k, dtype=np.int32)), strict=True):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    entries = keyed_text(docs, id_col, text_col).mapInArrow(run, "token long, set_id long, n int, place int").repartition("token")
    # One exchange serves the sums and the entries; what is joined to them is the few tokens that several sets have.
    # (The sums name all columns: an exchange of fewer would be another one.)
    sums = entries.groupBy("token").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("last"), F.max("n").alias("most"), F.max("place").alias("deepest"))
    several = sums.where("leader != last and most > 0 and deepest >= 0").select("token", "leader")
    return entries.join(several.hint("shuffle_hash"), "token").select(*names, "leader").distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, list]]:
    """Whole groups of sorted rows, as many as a batch ends: (key columns, starts with the end, other columns as chunked arrays)."""
    held: pa.Table | None = None

    def bounds(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        at = [rows.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(rows.num_rows, bool)
        change[:1] = True
        for a in at:
            change[1:] |= a[1:] != a[:-1]
        return at, np.append(np.flatnonzero(change), rows.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        at, edges = bounds(rows)
        held = rows.slice(edges[-2])
        if len(edges) > 2:
            yield [a[: edges[-2]] for a in at], edges[:-1], [rows.column(i).slice(0, edges[-2]) for i in range(keys, rows.num_columns)]
    if held is not None:
        at, edges = bounds(held)
        yield at, edges, [held.column(i) for i in range(keys, held.num_columns)]


def list_pairs(edges: np.ndarray, c: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Pairs (2 x k, distinct) of components that may link by one of the lists between ``edges``, each sorted by n and place."""
    rest, out = n - place, [np.empty((2, 0), np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        ok = (c[i] != c[j]) & may_link(n[i], rest[i], n[j], rest[j])
        if ok.any():
            a, b = c[i[ok]], c[j[ok]]
            out.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))

    sizes = np.diff(edges)
    last = np.repeat(edges[1:], sizes)
    i = np.flatnonzero(np.repeat(sizes <= LIST_BLOCK, sizes))
    for d in range(1, LIST_BLOCK):
        i = i[i + d < last[i]]
        if not len(i):
            break
        add(i, i + d)
    for start, end in zip(edges[:-1][sizes > LIST_BLOCK].tolist(), edges[1:][sizes > LIST_BLOCK].tolist(), strict=True):
        at = np.arange(start, end, LIST_BLOCK)
        low, high, most = np.minimum.reduceat(n[:end], at), np.maximum.reduceat(n[:end], at), np.maximum.reduceat(rest[:end], at)
        one = np.minimum.reduceat(c[:end], at), np.maximum.reduceat(c[:end], at)
        alone = one[0] == one[1]
        for x in range(len(at)):
            y = np.arange(x, len(at))
            # The later block has the larger sets: its smallest against the largest of this one, and the best rests of both.
            open_ = (np.minimum(high[x], low[y]) * DENOMINATOR >= low[y] * NUMERATOR) & (np.minimum(most[x], most[y]) * (NUMERATOR + DENOMINATOR) >= (low[x] + low[y]) * NUMERATOR)
            open_ &= ~(alone[x] & alone[y] & (one[0][x] == one[0][y]))
            for b in y[open_].tolist():
                left, right = np.arange(at[x], min(at[x] + LIST_BLOCK, end)), np.arange(at[b], min(at[b] + LIST_BLOCK, end))
                i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                add(i[i < j], j[i < j])
    return np.unique(np.concatenate(out, axis=1), axis=1)


def component_pairs(named: DataFrame) -> DataFrame:
    """Pairs (a, b), distinct, of components that may link, of lists (token, c, n, place) that hold several components."""
    entries = named.select("token", "c", "n", "place").distinct()
    # A list of many entries is dealt out in pairs of its parts.
    parts = entries.groupBy("token").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    dealt = entries.join(parts, "token").withColumn("own", F.pmod(F.xxhash64("c", "n", "place"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "n", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for _, edges, columns in _groups(batches, 3):
            c, n, place = (x.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for x in columns)
            found.append(list_pairs(edges, c, n, place))
            if sum(x.shape[1] for x in found) > 1_000_000:
                yield flush()
                found.clear()
        if found:
            yield flush()

    ordered = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "place")
    return ordered.mapInArrow(run, "a long, b long").distinct()


class Answers:
    """The overlaps of one set after another with all sets of a block."""

    def __init__(self, members: list[np.ndarray]) -> None:
        self.sizes = np.array([len(m) for m in members])
        flat = np.concatenate(members)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.tokens, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))
        self.before: tuple[np.ndarray, np.ndarray] | None = None

    def _lists(self, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each member has, by the lists of the block's index."""
        at = np.searchsorted(self.tokens, tokens)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == tokens)]
        if not len(at):
            return np.zeros(len(self.sizes), np.int64)
        lengths = self.ends[at] - self.starts[at]
        shift = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        return np.bincount(self.owners[np.arange(lengths.sum()) + shift], minlength=len(self.sizes))

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        if self.before is not None:
            other, known = self.before
            fresh = np.setdiff1d(s, other, assume_unique=True)
            if 2 * len(fresh) + len(other) - len(s) < len(s) // 2:
                known = known + self._lists(fresh) - self._lists(np.setdiff1d(other, s, assume_unique=True))
                self.before = s, known
                return known
        self.before = s, self._lists(s)
        return self.before[1]

    def link(self, s: np.ndarray) -> int | None:
        """The member that has most of what it needs to link with ``s``, if any links."""
        overlap = self.overlaps(s)
        spare = overlap * (NUMERATOR + DENOMINATOR) - (self.sizes + len(s)) * NUMERATOR
        best = int(spare.argmax())
        return best if spare[best] >= 0 else None


class Block:
    """Sizes and parities of a block's members."""

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray]) -> None:
        self.sizes, self.bits = sizes, bits
        self.words = np.array([len(b) for b in bits])
        self.known: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def _rows(self, words: int, only: bool) -> tuple[np.ndarray, np.ndarray]:
        if (words, only) not in self.known:
            at = np.flatnonzero(self.words == words if only else self.words >= words)
            rows = np.stack([folded(self.bits[i], words) for i in at.tolist()]) if len(at) else np.empty((0, words), np.uint64)
            self.known[words, only] = at, rows
        return self.known[words, only]

    def may_link(self, n: int, bits: np.ndarray) -> bool:
        """Whether sizes and parities let a set link with a member; sets that can have parities of sizes next to each other."""
        for words, only in ((len(bits), False), (len(bits) // 2, True)):
            at, rows = self._rows(words, only)
            sizes = self.sizes[at]
            near = np.minimum(sizes, n) * DENOMINATOR >= np.maximum(sizes, n) * NUMERATOR
            if near.any():
                apart = np.bitwise_count(rows[near] ^ folded(bits, words)).sum(axis=1, dtype=np.int64)
                if (apart * (NUMERATOR + DENOMINATOR) <= (sizes[near] + n) * (DENOMINATOR - NUMERATOR)).any():
                    return True
        return False


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (target, block, shard, probe, set_id, n, bits), a group's members first: the probes that sizes and parities let link with a member."""
    for keys, edges, (probe, ids, n, bits) in _groups(batches, 3):
        probe, ids, n = (x.combine_chunks().to_numpy(zero_copy_only=False) for x in (probe, ids, n))
        bits = [np.frombuffer(b, np.uint64) for b in bits.to_pylist()]
        keep = np.zeros(len(ids), bool)
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            first = start + int((~probe[start:end]).sum())
            block = Block(n[start:first], bits[start:first])
            for x in range(first, end):
                keep[x] = block.may_link(int(n[x]), bits[x])
        yield pa.RecordBatch.from_arrays([*(pa.array(k[keep]) for k in keys), pa.array(ids[keep])], names=["target", "block", "shard", "set_id"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (target, block, shard, probe, set_id, text), a group's members first: a link (a, b) for each probe that has one."""
    hashes, at, members, ids, answers = WordHashes(), None, [], [], None
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(start, SLICE_ROWS)
            links: list[tuple[int, int]] = []
            for target, block, shard, probe, own, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if at != (target, block, shard):
                    at, members, ids, answers = (target, block, shard), [], [], None
                s = shingles(text, hashes)
                if not probe:
                    members.append(s)
                    ids.append(own)
                    continue
                answers = answers or Answers(members)
                best = answers.link(s)
                if best is not None:
                    links.append((own, ids[best]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


class Matcher:
    """Compares sets of ``docs``; ``sets`` (set_id, n, bits, key, at) says which document has each."""

    def __init__(self, docs: DataFrame, sets: DataFrame, spool: Spool, id_col: str, text_col: str) -> None:
        self.docs, self.sets, self.spool, self.columns = docs, sets, spool, (id_col, text_col)

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(set_id, text): one text for each wanted set, read again from the documents that have it."""
        chosen = self.sets.join(wanted, "set_id", "left_semi").select("set_id", "key", "at")
        found = _with_key(self.docs, *self.columns).withColumnRenamed(self.columns[0], "id")
        few = chosen.count() <= BROADCAST_ROWS  # 24 bytes each
        found = found.join(F.broadcast(chosen) if few else chosen, (F.col("text_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("at")))
        return found.groupBy("set_id").agg(F.any_value("text").alias("text"))

    def links(self, probes: DataFrame, members: DataFrame, name: str) -> DataFrame:
        """Links (a, b): one for each probe (target, set_id) and block of its target's members (target, set_id) in which it has any."""
        sized = members.join(self.sets.select("set_id", "n"), "set_id").groupBy("target").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
        dealt = sized.join(probes.groupBy("target").agg(F.ceil(F.count("*") / BLOCK_PROBES).cast("int").alias("shards")), "target")
        dealt = self.spool.save(dealt, f"{name}_dealt")
        part = lambda c: F.pmod(F.xxhash64("set_id"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        held = members.join(dealt, "target").withColumn("block", part("blocks")).withColumn("shard", every("shards")).select("target", "block", "shard", F.lit(False).alias("probe"), "set_id")
        asked = probes.join(dealt, "target").withColumn("shard", part("shards")).withColumn("block", every("blocks")).select("target", "block", "shard", F.lit(True).alias("probe"), "set_id")
        key = ["target", "block", "shard"]
        rows = held.unionByName(asked).join(self.sets.select("set_id", "n", "bits"), "set_id").select(*key, "probe", "set_id", "n", "bits")
        left = rows.repartition(*key).sortWithinPartitions(*key, "probe", "n", "set_id").mapInArrow(_alike, "target long, block int, shard int, set_id long")
        left = self.spool.save(left, f"{name}_left")
        rows = held.join(left.select(*key).distinct(), key, "left_semi").unionByName(left.withColumn("probe", F.lit(True)))
        rows = self.spool.save(rows.join(self.sets.select("set_id", "n"), "set_id"), f"{name}_rows")
        rows = rows.join(self.texts(rows.select("set_id").distinct()), "set_id").select(*key, "probe", "set_id", "text", "n")
        ordered = rows.repartition(*key).sortWithinPartitions(*key, "probe", "n", "set_id").drop("n")
        links = self.spool.save(ordered.mapInArrow(_linked, "a long, b long"), name)
        for x in ("dealt", "left", "rows"):
            self.spool.drop(f"{name}_{x}")
        return links


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links).

    Null and wordless texts have no shingles, link with nothing and keep their own id. Rows with
    equal sets are linked whether their texts are equal or not; rows that share an id are the
    same document only through their sets. Null ids take part in links, but cannot name a component:
    one of null ids only has a null component_id. An empty table gives an empty result; other columns are ignored.
    """
    spool = Spool(docs.sparkSession)
    made = spool.save(profile(docs, id_col, text_col), "profiles")
    profiles = made.where("chunk is null").select("id", "text_key", "n_shingles", "set_id", "bits")
    of = F.min(F.struct("text_key", "id", "n_shingles", "bits"))
    sets = profiles.where("set_id is not null").groupBy("set_id").agg(of.alias("of"), F.min("id").alias("own"))
    sets = spool.save(sets.select("set_id", "own", F.col("of.n_shingles").alias("n"), F.col("of.bits").alias("bits"), F.col("of.text_key").alias("key"), F.col("of.id").alias("at")), "sets")
    lists = spool.save(index_lists(docs, sketch_levels(made), id_col, text_col), "lists")
    matcher = Matcher(docs, sets, spool, id_col, text_col)

    followers = spool.save(lists.where("set_id != leader").select(F.col("leader").alias("target"), "set_id").distinct(), "followers")
    links = matcher.links(followers, followers.select("target", F.col("target").alias("set_id")).distinct(), "links")
    found = components(links)

    named = lists.join(found.withColumnRenamed("v", "set_id"), "set_id", "left").select("token", "set_id", "n", "place", F.coalesce("c", "set_id").alias("c"))
    several = named.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least != most").select("token")
    named = spool.save(named.join(several, "token", "left_semi"), "mixed")
    vertices = spool.save(named.select("set_id", "c").distinct(), "vertices")
    sizes = vertices.groupBy("c").agg(F.count("*").alias("size"))
    pairs = component_pairs(named)
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("c").alias(end), F.struct("size", "c").alias(f"s{end}")), end)
    pairs = spool.save(pairs.select(F.least("sa", "sb")["c"].alias("c"), F.greatest("sa", "sb")["c"].alias("target")), "pairs")
    probes = pairs.join(vertices, "c").select("target", "set_id")
    members = pairs.select("target").distinct().join(vertices, F.col("target") == F.col("c")).select("target", "set_id")
    more = matcher.links(spool.save(probes, "probes"), spool.save(members, "members"), "more")
    found = components(links.unionByName(more))

    smallest = sets.select("set_id", "own")
    named = smallest.join(found.withColumnRenamed("v", "set_id"), "set_id", "left").select("set_id", "own", F.coalesce("c", "set_id").alias("c"))
    by_component = named.groupBy("c").agg(F.min("own").alias("component_id"))
    by_set = named.join(by_component, "c").select("set_id", "component_id")
    own = F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = profiles.select("id", "n_shingles", "set_id").join(by_set, "set_id", "left").select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))
    out = spool.save(out, "result")
    for name in ("profiles", "sets", "lists", "followers", "links", "mixed", "vertices", "pairs", "probes", "members", "more"):
        spool.drop(name)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one whose doc_id names it. All columns stay, whatever their names.

    Rows without shingles or without a doc_id stay as they are; of rows that share the naming doc_id one stays.
    """
    spool = Spool(docs.sparkSession)
    found = join_components(docs)
    gone = spool.save(found.where("n_shingles > 0 and doc_id != component_id").select("doc_id").distinct(), "gone")
    twice = spool.save(found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "twice")
    few = gone.count() <= BROADCAST_ROWS  # 8 bytes each
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLE_SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[s : s + 4], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM docs WHERE len(w) > 0)),
sets AS (SELECT r, count(*) AS n, md5(string_agg(md5(k), '' ORDER BY md5(k))) AS id FROM shingles GROUP BY r),
kinds AS (SELECT id, min(n) AS n, min(r) AS r FROM sets GROUP BY id),
members AS (SELECT x.id, x.n, g.k FROM kinds x JOIN shingles g ON g.r = x.r),
shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS in_both FROM members a JOIN members b ON a.k = b.k AND a.id < b.id GROUP BY a.id, b.id),
links AS (
  SELECT a, b FROM shared WHERE 100 * in_both >= 75 * (na + nb - in_both)
  UNION ALL SELECT b, a FROM shared WHERE 100 * in_both >= 75 * (na + nb - in_both)),
reach(a, b) AS (SELECT id, id FROM kinds UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
lowest AS (SELECT s.id, min(d.doc_id) AS doc_id FROM sets s JOIN docs d ON d.r = s.r GROUP BY s.id),
components AS (SELECT reach.a AS id, min(lowest.doc_id) AS component_id FROM reach JOIN lowest ON lowest.id = reach.b GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.component_id, d.doc_id) AS BIGINT) AS component_id
FROM docs d LEFT JOIN sets s ON s.r = d.r LEFT JOIN components c ON c.id = s.id
"""
}
