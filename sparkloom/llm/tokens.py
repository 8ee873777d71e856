"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols form a doubly linked list and every adjacent pair whose concatenation is
a vocabulary piece waits in a heap, ordered by rank and then by position. The lowest pair
is popped and merged until none is left; the count is the initial symbols minus the merges.
No identifiers are made. A character outside the vocabulary is as many symbols as it has
UTF-8 bytes (byte fallback) and never merges.

No piece holds the space mark after another character, so merges never reach across the
start of a space run: texts are counted run by run, and equal runs are counted once per
task (a dictionary of bounded size).
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keyed_text, map_slices, table

SPACE = "▁"
CACHE_ENTRIES = 400_000
OVER_LIMIT = 4096
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def load_pieces(path: str) -> dict[str, float]:
    """Mergeable pieces and their costs (lower merges first) from a sentencepiece BPE model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, trainer = model.normalizer_spec, model.trainer_spec
    if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not trainer.byte_fallback:
        raise ValueError("expected a BPE model with byte fallback, a dummy prefix and no normalisation")
    pieces = {p.piece: -p.score for p in model.pieces if p.type == 1}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece reaches across a space")
    return pieces


def count_run(run: str, pieces: dict[str, float]) -> int:
    """Symbols left after merging ``run`` by heap and linked list."""
    symbols = list(run)
    n = len(symbols)
    after = list(range(1, n)) + [-1]
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        cost = pieces.get(symbols[i] + symbols[i + 1])
        if cost is not None:
            heap.append((cost, i, symbols[i] + symbols[i + 1]))
    heapq.heapify(heap)
    count = n
    for ch in symbols:
        if ch not in pieces:
            count += len(ch.encode("utf-8", "surrogatepass")) - 1
    while heap:
        _, i, merged = heapq.heappop(heap)
        j = after[i] if symbols[i] else -1
        if j < 0 or len(symbols[i]) + len(symbols[j]) != len(merged) or symbols[i] + symbols[j] != merged:
            continue
        symbols[i], symbols[j] = merged, ""
        k = after[i] = after[j]
        count -= 1
        if k >= 0:
            before[k] = i
            cost = pieces.get(merged + symbols[k])
            if cost is not None:
                heapq.heappush(heap, (cost, i, merged + symbols[k]))
        h = before[i]
        if h >= 0:
            cost = pieces.get(symbols[h] + merged)
            if cost is not None:
                heapq.heappush(heap, (cost, h, symbols[h] + merged))
    return count


class RunCounts(dict):
    """Counts by run; a key that starts with a line feed has no space mark before its rest."""

    def __init__(self, pieces: dict[str, float], most: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.pieces, self.most = pieces, most
        self.line_feed_alone = "\n" not in pieces and not any("\n" in p for p in pieces)

    def __missing__(self, key: str) -> int:
        if key[:1] == "\n":
            count = 1 + (count_run(key[1:], self.pieces) if len(key) > 1 else 0)
        else:
            count = count_run(SPACE + key, self.pieces)
        if len(self) >= self.most:
            self.clear()
        self[key] = count
        return count


_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def count_text(text: str, counts: RunCounts) -> int:
    if not text:
        return 0
    if counts.line_feed_alone and text[0] not in " \n" and text[-1] != " " and SPACE not in text and "  " not in text and " \n" not in text:
        return sum(map(counts.__getitem__, text.replace("\n", " \n").split(" ")))
    return sum(count_run(r, counts.pieces) for r in _RUNS.findall(SPACE + text.replace(" ", SPACE)))


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER_LIMIT) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit.

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each
    get their row; an empty table gives an empty result; other columns are ignored, so
    clashing names do no harm. Very long texts only cost memory in proportion to their own
    length. The vocabulary (tens of thousands of pieces, the model file's size) is broadcast.
    """
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def kernel():
        counts = RunCounts(pieces.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            n = [count_text(t, counts) for t in texts]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > over for x in n], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    return map_slices(keyed_text(df, id_col, text_col), kernel, SCHEMA.replace("doc_id", id_col, 1))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
