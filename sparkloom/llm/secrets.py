"""Secret scans: rules, and a character convolutional network over every candidate and its context.

Base findings come from three rules. Candidates are all long tokens, also those that a base
finding covers in part (what lies wholly inside one is found already); a network in numpy
(character embedding, one convolution, max and mean pooling, a linear output) scores every
candidate with what stands before and after it, tile by tile if it is long. It is trained on
labelled findings: the candidates of all documents, labelled by the rules, and generated ones
of known kind. Findings of equal characters and context count once. They are dealt to shards;
in each epoch every shard takes the network through its tiles, and the mean of the shards'
networks begins the next (a table of one shard is trained as in one process). Scores are
calibrated on findings held out from training, and the threshold is the highest that still
recalls ``MIN_RECALL`` of all of these; a finding scores what its best tile does, in training as
in scans, and scans use that threshold as it is.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spool, keyed_text, map_slices, table

KINDS = ("assign", "access", "hex")
ADDED = "network"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

SAMPLE_DOCS, SAMPLE_CANDIDATES, GENERATED = 4000, 6000, 5000
BEFORE, TILE, AFTER = 16, 48, 16
WIDTH = BEFORE + TILE + AFTER
EMBED, FILTERS, REACH = 8, 24, 5
MIN_RECALL = 0.98
#: Passes over the tiles, tiles of a shard on average, distinct findings a task holds, and steps of a logit in which held-out findings are counted.
EPOCHS, SHARD, TASK_FINDINGS, STEPS = 14, 8000, 100_000, 256
RATE = 0.01
MASK = "[secret]"
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' findings, leftmost and non-overlapping for each kind, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _LONG_HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


#: Runs of HEX are maximal, so dropping those under 24 characters is the same as asking for 24.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def _codes(text: str, shift: int) -> list[int]:
    return [(c - 31 if 32 <= c < 127 else 96) + shift for c in map(ord, text)]


def windows(text: str, start: int, end: int) -> list[list[int]]:
    """Character codes of each tile of a candidate between its contexts; context characters have codes of their own."""
    left, right = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    out = []
    for at in range(start, end, TILE):
        inside = text[at : min(end, at + TILE)]
        out.append([0] * (BEFORE - len(left)) + _codes(left, 96) + _codes(inside, 0) + [0] * (TILE - len(inside)) + _codes(right, 96) + [0] * (AFTER - len(right)))
    return out


class Network:
    """Embedding, convolution, rectifier, max and mean pooling, linear output; Adam on the log loss."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w = weights or {
            "embed": rng.normal(0, 0.5, (193, EMBED)),
            "conv": rng.normal(0, (2 / (REACH * EMBED)) ** 0.5, (REACH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, 2 * FILTERS),
            "offset": np.zeros(1),
        }
        self.w = {k: np.asarray(v, np.float32) for k, v in self.w.items()}
        self.w["embed"][0] = 0

    def forward(self, codes: np.ndarray) -> tuple:
        e = self.w["embed"][codes]
        n = codes.shape[1] - REACH + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(REACH)], axis=2)
        act = np.maximum(cols @ self.w["conv"] + self.w["bias"], 0)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1)], axis=1)
        return pooled @ self.w["out"] + self.w["offset"], pooled, act, top, cols

    def logits(self, codes: np.ndarray, rows: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + rows])[0] for i in range(0, len(codes), rows)]) if len(codes) else np.empty(0, np.float32)

    def gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        logit, pooled, act, top, cols = self.forward(codes)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * (1 if weight is None else weight) / len(y)).astype(np.float32)
        back = d[:, None] * self.w["out"]
        d_act = np.repeat(back[:, None, FILTERS:] / act.shape[1], act.shape[1], axis=1)
        rows, filters = np.ogrid[: len(y), :FILTERS]
        d_act[rows, top, filters] += back[:, :FILTERS]
        d_act *= act > 0
        flat = d_act.reshape(-1, FILTERS)
        d_cols = d_act @ self.w["conv"].T
        d_embed = np.zeros_like(self.w["embed"])
        n = act.shape[1]
        for k in range(REACH):
            np.add.at(d_embed, codes[:, k : k + n], d_cols[:, :, k * EMBED : (k + 1) * EMBED])
        d_embed[0] = 0
        return {"embed": d_embed, "conv": cols.reshape(len(flat), -1).T @ flat, "bias": flat.sum(axis=0), "out": pooled.T @ d, "offset": d.sum(keepdims=True)}

    def start(self) -> tuple[dict, dict, int]:
        """The optimiser's means, mean squares and steps before the first epoch."""
        return {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0

    def epoch(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, state: tuple[dict, dict, int], rate: float, rng: np.random.Generator, batch: int = 256) -> tuple[dict, dict, int]:
        """One pass over the rows; the state after it."""
        m, v, t = dict(state[0]), dict(state[1]), state[2]
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick, t = order[at : at + batch], t + 1
            for k, g in self.gradients(codes[pick], y[pick], weight[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return m, v, t

    def fit(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 256, seed: int = 7) -> None:
        rng, state = np.random.default_rng(seed), self.start()
        for epoch in range(epochs):
            state = self.epoch(codes, y, weight, state, rate * (1 - epoch / epochs), rng, batch)


def generated(n: int = GENERATED, seed: int = 11) -> list[tuple[list[int], int]]:
    """Labelled windows of the generated findings."""
    return [(w, secret) for tiles, secret in generated_findings(n, seed) for w in taught(tiles, secret)]


def taught(tiles: list[list[int]], secret: int) -> list[list[int]]:
    """The tiles of a finding that carry its label: of a secret, those that are no shorter than a candidate."""
    return [w for w in tiles if sum(map(bool, w[BEFORE : BEFORE + TILE])) >= 16] if secret else tiles


def generated_findings(n: int = GENERATED, seed: int = 11) -> list[tuple[list[list[int]], int]]:
    """Labelled findings of known kind, as tiles: random keys of many alphabets, and words, names, numbers and paths."""
    rng = random.Random(seed)
    syllables = "the and ing tion er re on an en st de la que men to con pro per tra ver ge sch ung lich ado cion eau ment".split()
    alphabets = ["0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits]
    syllables += [a + b + c for a in "bcdfghjklmnprstvwz" for b in "aeiou" for c in ("", rng.choice("lmnrstp"), rng.choice(("pf", "ch", "st", "ll")))]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        secret = i % 2
        if secret:
            body = rng.choice(["", "", "ghp_", "sk-", "AKIA", "xoxb-", "eyJ"]) + "".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64)))
        else:
            kind = rng.randrange(7)
            if kind == 0:
                body = "".join(word() for _ in range(8))[: rng.randint(16, 60)]
                body = rng.choice([body, body.capitalize()])
            elif kind == 1:
                body = rng.choice("-_/").join(word() for _ in range(rng.randint(4, 8)))
            elif kind == 2:
                body = "".join(rng.choices(string.digits, k=rng.randint(16, 30)))
            elif kind == 3:
                body = rng.choice("=-_+abcxyz01") * rng.randint(16, 60)
            elif kind == 4:
                body = f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{word()}-{word()}{rng.randint(1, 99)}"
            elif kind == 5:
                body = (word() * 12)[: rng.randint(16, 48)].upper()
            else:
                body = "/".join(word() for _ in range(rng.randint(3, 7))) + f"/{rng.randint(1, 9999)}"
            body = body if len(body) >= 16 else body + word() + "andtheversion"
        left = " ".join(word() for _ in range(3)) + rng.choice([" ", "\n", ": ", ' = "', " | "])
        text = left + body + rng.choice([" ", '" ', "\n", ", ", "."]) + word() + " " + word()
        rows.append((windows(text, len(left), len(left) + len(body)), secret))
    return rows


def train(found: list[tuple[list[int], int]], share: tuple[float, float] = (1.0, 1.0)) -> dict:
    """A model from labelled windows, one for each finding: weights, calibration (slope, offset) and threshold.

    ``share``: how many clean and secret findings each given one stands for; generated ones weigh as
    much as the average given one. Recall and precision are those of whole findings held out, at the
    threshold that scans use.
    """
    mean = sum(share[y] for _, y in found) / max(len(found), 1)
    findings = [([w], y, share[y] / mean) for w, y in sorted(found)] + [(tiles, y, 1.0) for tiles, y in generated_findings()]
    held = [x for i, x in enumerate(findings) if i % 8 < 2]
    rows = [(w, y, weight) for i, (tiles, y, weight) in enumerate(findings) if i % 8 >= 2 for w in taught(tiles, y)]
    net = Network()
    net.fit(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32), np.array([r[2] for r in rows], np.float32))
    first = np.cumsum([0] + [len(tiles) for tiles, _, _ in held[:-1]])
    logit = np.maximum.reduceat(net.logits(np.array([w for tiles, _, _ in held for w in tiles], np.int64)), first)
    return calibrated(net, logit, np.array([x[1] for x in held], float), np.array([x[2] for x in held]))


def calibrated(net: Network, logit: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> dict:
    """The model of a network and of what findings held out score: calibration, and the highest threshold that recalls enough of them."""
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        off = (p - truth) * weight / weight.sum()
        a, b = a - 0.05 * float((off * logit).sum()), b - 0.05 * float(off.sum())
    p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
    order = np.argsort(-p[truth == 1], kind="stable")
    recall = np.cumsum(weight[truth == 1][order]) / weight[truth == 1].sum()
    recalled = float(p[truth == 1][order][min(np.searchsorted(recall, MIN_RECALL), len(recall) - 1)])
    hit = p >= recalled
    return {"weights": net.w, "slope": a, "offset": b, "threshold": max(recalled, 1e-6), "recall": float((weight * truth)[hit].sum() / (weight * truth).sum()), "precision": float((weight * truth)[hit].sum() / weight[hit].sum())}


def labelled(df: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> tuple[list[tuple[list[int], int]], tuple[float, float]]:
    """Windows of the candidates in a bounded sample of documents, labelled by the rules, and the share that ``train`` takes; for trials, ``fit`` reads all.

    The documents with the smallest id hashes are taken, and of their clean and of their secret
    candidates as many each as the parameter says, by a hash: what reaches the driver is bounded
    by these two parameters.
    """
    chosen = df.select(F.col("doc_id").alias("chosen")).where("chosen is not null").distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(sample_docs)

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                for m in CANDIDATE.finditer(text):
                    known = any(a < m.end() and m.start() < b for a, b, _ in spans)
                    rows += [(w, int(known)) for w in windows(text, m.start(), m.end())[:1]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int16())), pa.array([r[1] for r in rows], pa.int32())], names=["codes", "secret"])

        return step

    texts = df.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi")
    spool = Spool(df.sparkSession)
    found = spool.save(map_slices(texts, kernel, "codes array<short>, secret int"), "candidates")
    counts = {r["secret"]: r["n"] for r in found.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    rows = []
    for secret in (0, 1):
        part = found.where(F.col("secret") == secret).orderBy(F.xxhash64("codes"), "codes").limit(sample_candidates)
        rows += [(list(r["codes"]), secret) for r in part.collect()]
    spool.drop()
    return rows, tuple(max(1.0, counts.get(secret, 0) / sample_candidates) for secret in (0, 1))


def findings(texts: DataFrame) -> DataFrame:
    """(codes, secret) of every candidate, labelled by the rules: the codes of all its tiles, one after the other, as 16-bit numbers."""

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, secret = [], []
            for text in batch.column(0).to_pylist():
                if not (found := list(CANDIDATE.finditer(text))):
                    continue
                spans = base_spans(text)
                for m in found:
                    codes.append(np.array(windows(text, m.start(), m.end()), np.int16).tobytes())
                    secret.append(int(any(a < m.end() and m.start() < b for a, b, _ in spans)))
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(secret, pa.int32())], names=["codes", "secret"])

        return step

    return map_slices(texts, kernel, "codes binary, secret int")


def _tiles(codes: bytes) -> np.ndarray:
    return np.frombuffer(codes, np.int16).reshape(-1, WIDTH)


def tiles_taught(found: DataFrame) -> DataFrame:
    """(codes, secret) of the tiles that carry their finding's label, equal ones of a finding once."""

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, secret = [], []
            for raw, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tiles = _tiles(raw)
                tiles = tiles[(tiles[:, BEFORE : BEFORE + TILE] > 0).sum(axis=1) >= 16] if y else tiles
                own = dict.fromkeys(w.tobytes() for w in tiles)
                codes += own
                secret += [y] * len(own)
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(secret, pa.int32())], names=["codes", "secret"])

        return step

    return map_slices(found, kernel, "codes binary, secret int")


def shards(tiles: DataFrame, parts: int) -> DataFrame:
    """(shard, codes, secret): all distinct tiles, each shard's in one row, in the order of their codes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def packed() -> pa.RecordBatch:
            rows = sorted(set(held))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([b"".join(w for w, _ in rows)], pa.binary()), pa.array([bytes(y for _, y in rows)], pa.binary())], names=["shard", "codes", "secret"])

        for batch in batches:
            for shard, codes, secret in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at and held:
                    yield packed()
                    held = []
                at = shard
                held.append((codes, secret))
        if held:
            yield packed()

    dealt = tiles.select(F.pmod(F.xxhash64("codes", "secret"), F.lit(parts)).cast("int").alias("shard"), "codes", "secret")
    return dealt.repartitionByRange(parts, "shard").sortWithinPartitions("shard").mapInArrow(pack, "shard int, codes binary, secret binary")


def _flat(parts: tuple[dict, ...]) -> np.ndarray:
    return np.concatenate([d[k].ravel() for d in parts for k in sorted(d)]).astype(np.float32)


def _unflat(flat: np.ndarray, like: dict) -> tuple[dict, ...]:
    """The three dictionaries of ``_flat``."""
    out, at = [], 0
    for _ in range(3):
        d = {}
        for k in sorted(like):
            d[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
            at += like[k].size
        out.append(d)
    return tuple(out)


def taught_by_shards(held: DataFrame, made: tuple[np.ndarray, np.ndarray], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Network:
    """A network that every shard taught in each epoch, with the generated tiles ``made`` beside its own; shards count by their rows."""
    net = Network()
    state, context = net.start(), held.sparkSession.sparkContext
    extra = context.broadcast(made)
    for epoch in range(epochs):
        now = context.broadcast((_flat((net.w, *state[:2])), state[2], epoch, rate * (1 - epoch / epochs)))

        def teach(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            flat, t, epoch, rate = now.value
            for batch in batches:
                for shard, raw, secret in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = Network()
                    own.w, *state = _unflat(flat, own.w)
                    codes = np.concatenate([_tiles(raw), extra.value[0]]).astype(np.int64)
                    y = np.concatenate([np.frombuffer(secret, np.uint8), extra.value[1]]).astype(np.float32)
                    m, v, steps = own.epoch(codes, y, np.ones(len(y), np.float32), (*state, t), rate, np.random.default_rng((seed, epoch, shard)))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([steps], pa.int64()), pa.array([_flat((own.w, m, v)).tobytes()], pa.binary())], names=["shard", "n", "t", "state"])

        got = sorted(held.mapInArrow(teach, "shard int, n long, t long, state binary").collect(), key=lambda r: r["shard"])
        total = sum(r["n"] for r in got)
        mean = sum(np.frombuffer(r["state"], np.float32).astype(np.float64) * (r["n"] / total) for r in got)
        net.w, m, v = _unflat(mean, net.w)
        state = (m, v, max(r["t"] for r in got))
        now.unpersist()
    extra.unpersist()
    return net


def best_logits(held: DataFrame, net: Network) -> dict[tuple[int, int], int]:
    """How many findings of (secret, step of the logit of their best tile) there are."""
    shared = held.sparkSession.sparkContext.broadcast(net.w)

    def kernel():
        own = Network(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            best = [float(own.logits(_tiles(raw).astype(np.int64)).max()) for raw in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.floor(np.clip(best, -40, 40) * STEPS).astype(np.int32), pa.int32())], names=["secret", "step"])

        return step

    counted = map_slices(held, kernel, "secret int, step int").groupBy("secret", "step").agg(F.count("*").alias("n"))
    return {(r["secret"], r["step"]): r["n"] for r in counted.collect()}


class Scanner:
    def __init__(self, model: dict) -> None:
        self.net = Network(model["weights"])
        self.model = model
        self.threshold = model["threshold"]

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        out: list[list[tuple[int, int, str, float]]] = []
        owners: list[tuple[int, int, int]] = []
        codes: list[list[int]] = []
        for i, text in enumerate(texts):
            spans = base_spans(text)
            out.append([(a, b, k, 1.0) for a, b, k in spans])
            for m in CANDIDATE.finditer(text):
                if not any(a <= m.start() and m.end() <= b for a, b, _ in spans):
                    tiles = windows(text, m.start(), m.end())
                    owners += [(i, m.start(), m.end())] * len(tiles)
                    codes += tiles
        if codes:
            logit = self.net.logits(np.array(codes, np.int64))
            best: dict[tuple[int, int, int], float] = {}
            for owner, p in zip(owners, (1 / (1 + np.exp(-np.clip(self.model["slope"] * logit + self.model["offset"], -30, 30)))).tolist(), strict=True):
                best[owner] = max(p, best.get(owner, 0.0))
            for (i, a, b), p in best.items():
                if p >= self.threshold:
                    out[i].append((a, b, ADDED, round(p, 4)))
            order = {k: n for n, k in enumerate((*KINDS, ADDED))}
            out = [sorted(s, key=lambda x: (x[0], order[x[2]])) for s in out]
        return out


def scan(df: DataFrame, model: dict) -> DataFrame:
    """One row per row: doc_id, spans (kind, start, end in code points, score; by start, then kind).

    Null text has no spans; null ids stay null; repeated rows each get their row; an empty table
    gives an empty result; other columns are ignored. The model is of fixed size and broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        scanner = Scanner(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scanner(batch.column(1).to_pylist())
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": k, "start": a, "end": b, "score": s} for a, b, k, s in f] for f in found], kind)], names=["doc_id", "spans"])

        return step

    return map_slices(keyed_text(df), kernel, SCHEMA)


def fit(df: DataFrame, shard: int = SHARD) -> dict:
    """A model from every candidate of ``df``, each distinct finding once, and the generated findings.

    A quarter of the findings, by a hash, is held out. Generated ones stand beside each shard's own in
    training and count as often as there are shards in calibration. What reaches the driver is one
    network for each shard and counts of held-out findings by the step of their score.
    """
    spool = Spool(df.sparkSession)
    raw = spool.save(findings(keyed_text(df).select("text")), "candidates")
    n = raw.count()
    found = spool.save(raw.repartition(-(-n // TASK_FINDINGS) or 1, "codes", "secret").distinct().withColumn("held", F.pmod(F.xxhash64("codes"), F.lit(8)) < 2), "findings")
    tiles = spool.save(tiles_taught(found.where("not held").select("codes", "secret")), "tiles")
    parts = -(-tiles.count() // shard)
    ours = [x for x in enumerate(generated_findings())]
    made = [(w, y) for i, (tiles_of, y) in ours if i % 8 >= 2 for w in taught(tiles_of, y)]
    codes, y = np.array([w for w, _ in made], np.int16), np.array([y for _, y in made], np.uint8)
    if parts:
        net = taught_by_shards(spool.save(shards(tiles, parts), "shards"), (codes, y))
    else:
        net = Network()
        net.fit(codes.astype(np.int64), y.astype(np.float32), np.ones(len(y), np.float32))
    counts = best_logits(found.where("held").select("codes", "secret"), net)
    spool.drop()
    logit, truth, weight = [k[1] / STEPS for k in sorted(counts)], [k[0] for k in sorted(counts)], [counts[k] for k in sorted(counts)]
    for i, (tiles_of, label) in ours:
        if i % 8 < 2:
            logit.append(float(net.logits(np.array(tiles_of, np.int64)).max()))
            truth.append(label)
            weight.append(max(1, parts))
    return calibrated(net, np.array(logit), np.array(truth, float), np.array(weight, float))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    kept, last = [], 0
    for a, b in sorted(spans):
        if a >= last:
            kept += [text[last:a], MASK]
        last = max(last, b)
    return "".join([*kept, text[last:]])


def redact(df: DataFrame, model: dict) -> DataFrame:
    """``df`` with every found span replaced by ``MASK``; other rows, columns and null texts stay as they are.

    If the table has n_chars, it is counted again where text was masked.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.schema

    def kernel():
        scanner = Scanner(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, columns = schema.names.index("text"), list(batch.columns)
            texts = columns[at].to_pylist()
            found = scanner([t or "" for t in texts])
            changed = [i for i, s in enumerate(found) if s]
            if changed:
                for i in changed:
                    texts[i] = mask(texts[i], [(a, b) for a, b, _, _ in found[i]])
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in schema.names:
                    n = schema.names.index("n_chars")
                    counts = columns[n].to_pylist()
                    for i in changed:
                        counts[i] = len(texts[i])
                    columns[n] = pa.array(counts, columns[n].type)
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        return step

    return map_slices(df, kernel, schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != ADDED)), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE_SQL: dict[str, str] = {}
