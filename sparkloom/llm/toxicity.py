"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (a word, or the words that begin with a stem)
and pattern voters (shouting, exclamation, symbols, numbers, address). A generative label
model estimates by expectation maximisation how often each voter fires on toxic and on
clean texts, counts the given labels as one more, imperfect voter, and discounts voters
that fire together given the class, so that a stem and the words under it count about
once. A logistic classifier over the votes is then trained on the model's posterior labels,
and on one more row for each lexicon voter that fires alone, with the posterior of the rows
it fires on.

The lexicon, the label model and the classifier are fitted on a bounded sample of labelled
rows (at most ``MAX_POSITIVE`` and ``MAX_NEGATIVE``, chosen by a hash of the id); every
document is scored whole.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, map_slices, table

MAX_POSITIVE, MAX_NEGATIVE = 4000, 8000
MAX_LEXICON = 400
STEMS = range(3, 8)
MIN_PRECISION = 0.85
PRIOR_ROWS = 1.0
CHANCE = 0.05
ALONE_ROWS = 20.0
LABEL_NOISE = 0.05
THRESHOLD = 0.7
HELD_OUT = (3, 1)

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"*#$%&@"
PATTERNS = ("shouting", "exclaiming", "symbols", "numbers", "addressing")


def words(text: str) -> set[bytes]:
    """Distinct lower-cased words (runs of letters or of anything beyond ASCII), as UTF-8."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def pattern_votes(text: str) -> list[int]:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    share = lambda kinds: (len(raw) - len(raw.translate(None, kinds))) / n
    return [int(n > 20 and share(_UPPER) > 0.4), int(share(b"!") > 0.01), int(share(_SYMBOLS) > 0.03), int(share(b"0123456789") > 0.1), int("you are" in text or "you're" in text)]


def grams(word: bytes) -> list[str]:
    """What a lexicon voter can look for in a word: the word itself (closed by ``$``) and its stems."""
    w = word.decode("utf-8", "replace")
    return [w + "$", *(w[:n] for n in STEMS if n < len(w))]


def copy_groups(docs: list[Collection[bytes]], size: int = 16, same: int = 8) -> list[int]:
    """A group number for each row; rows that share half of their ``size`` longest words are copies of each other."""
    first: dict[bytes, int] = {}
    groups = []
    for i, found in enumerate(docs):
        sketch = heapq.nlargest(size, found, key=lambda w: (len(w), w))
        shared = Counter(first[h] for h in sketch if h in first)
        best, n = max(shared.items(), key=lambda x: (x[1], -x[0]), default=(i, 0))
        group = best if n >= min(same, max(1, len(sketch) - 1)) else i
        groups.append(group)
        for h in sketch:
            first[h] = group
    return groups


def choose_lexicon(docs: list[Collection[bytes]], toxic: np.ndarray, most: int = MAX_LEXICON) -> list[str]:
    """Voters by coverage of toxic rows: precise ones, and so often with toxic rows that chance explains none of them.

    Of voters with equal rows the most specific is taken, and none under a chosen stem unless it is more precise. Copies of a text count once.
    """
    groups = copy_groups(docs)
    rows_of: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})  # clean and toxic rows of each group
    for i, g in enumerate(groups):
        rows_of[int(toxic[i])].setdefault(g, []).append(i)
    # Only numbers are held for each gram and word: a group counts once, whatever its rows.
    number: dict[str, int] = {}
    of_word: dict[bytes, tuple[int, ...]] = {}
    for rows in rows_of[1].values():
        for w in {w for i in rows for w in docs[i]}:
            if w not in of_word:
                of_word[w] = tuple(number.setdefault(g, len(number)) for g in grams(w))
    hits = np.zeros(len(number), np.int64)
    for rows in rows_of[1].values():
        hits[list({n for i in rows for w in docs[i] for n in of_word[w]})] += 1
    several = hits > 1
    number = {g: n for g, n in number.items() if several[n]}
    of_word = {}
    clean = np.zeros(len(hits), np.int64)
    for rows in rows_of[0].values():
        found: set[int] = set()
        for w in {w for i in rows for w in docs[i]}:
            v = of_word.get(w)
            if v is None:
                v = of_word[w] = tuple(n for g in grams(w) if (n := number.get(g)) is not None)
            found.update(v)
        clean[list(found)] += 1
    sampled = float(np.mean(toxic))
    needed = np.log(max(len(number), 1) / CHANCE)
    precise = []
    for g, n in number.items():
        hit, missed = int(hits[n]), int(clean[n])
        share = hit / (hit + missed)
        surprise = hit * np.log(share / sampled) + (missed and missed * np.log((1 - share) / (1 - sampled)))
        if share >= MIN_PRECISION and surprise >= needed:
            precise.append((-hit, -len(g), g))
    wanted, where = {g for _, _, g in precise}, {g: [] for _, _, g in precise}
    for group, rows in sorted(rows_of[1].items()):
        for g in {g for i in rows for w in docs[i] for g in grams(w) if g in wanted}:
            where[g].append(group)
    chosen: dict[str, None] = {}
    taken: set[tuple[int, ...]] = set()
    for _, _, g in sorted(precise):
        wider = [g[:n] for n in STEMS if n < len(g) and g[:n] in chosen]
        if tuple(where[g]) not in taken and not any(clean[number[w]] <= clean[number[g]] for w in wider):
            chosen[g] = None
            taken.add(tuple(where[g]))
            if len(chosen) == most:
                break
    return list(chosen)


class Voters:
    """Votes of a lexicon; what a word sets off is looked up once per task, in a table of bounded size."""

    def __init__(self, lexicon: list[str]) -> None:
        self.index = {g: i for i, g in enumerate(lexicon)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, found: Collection[bytes]) -> set[int]:
        hits: set[int] = set()
        for w in found:
            v = self.known.get(w)
            if v is None:
                v = tuple(i for g in grams(w) if (i := self.index.get(g)) is not None)
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[w] = v
            if v:
                hits.update(v)
        return hits


def vote_matrix(texts: list[str], found: list[Collection[bytes]], voters: Voters) -> np.ndarray:
    votes = np.zeros((len(texts), len(voters.index) + len(PATTERNS)))
    for i, (text, has) in enumerate(zip(texts, found, strict=True)):
        votes[i, sorted(voters.of(has))] = 1
        votes[i, len(voters.index) :] = pattern_votes(text)
    return votes


def label_model(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior of each row, and the voters' firing rates by class and correlation discounts."""
    q = np.where(toxic == 1, 1 - LABEL_NOISE, LABEL_NOISE)
    noise = LABEL_NOISE
    for _ in range(rounds):
        w1, w0 = weight * q, weight * (1 - q)
        rate1 = (w1 @ votes + 0.5) / (w1.sum() + 1)
        rate0 = (w0 @ votes + 0.5) / (w0.sum() + 1)
        together = 0.0
        for w, rate in ((w1, rate1), (w0, rate0)):
            centred = (votes - rate) * np.sqrt(w)[:, None]
            cov = centred.T @ centred / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            together = np.maximum(together, np.clip(cov / np.outer(sd, sd), 0, 1))
        np.fill_diagonal(together, 0)
        discount = 1 / (1 + (together * (together > 0.1)).sum(axis=1))
        prior = np.clip(w1.sum() / weight.sum(), 1e-3, 1 - 1e-3)
        silent = np.log((1 - rate1) / (1 - rate0)) * discount
        fires = np.log(rate1 / rate0) * discount
        given = np.where(toxic == 1, 1, -1) * np.log((1 - noise) / noise)
        logit = np.log(prior / (1 - prior)) + votes @ (fires - silent) + np.maximum(silent.sum(), -3) + given
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        noise = float(np.clip((weight * np.abs(q - toxic)).sum() / weight.sum(), 0.005, 0.2))
    return q, {"toxic_rate": rate1.round(5).tolist(), "clean_rate": rate0.round(5).tolist(), "discount": discount.round(4).tolist(), "label_noise": round(noise, 5)}


def fit_linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - q)) + penalty * beta
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1, 4 / max(np.abs(step).max(), 1e-9))
        beta -= step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def train(texts: list[str], toxic: list[int], share: tuple[float, float] = (1.0, 1.0)) -> dict:
    """A model from labelled texts; ``share``: how many clean and toxic rows each sampled one stands for.

    Without rows of both classes there is nothing to learn: the model scores every text 0.
    """
    order = sorted(range(len(texts)), key=lambda i: (texts[i], toxic[i]))
    texts, y = [texts[i] for i in order], np.array([toxic[i] for i in order], float)
    if not 0 < y.sum() < len(y):
        return {"lexicon": [], "weights": [], "patterns": [0.0] * len(PATTERNS), "intercept": -30.0}
    scale = np.where(y == 1, share[1], share[0])
    known: dict[bytes, bytes] = {}
    found = [tuple(known.setdefault(w, w) for w in words(t)) for t in texts]
    lexicon = choose_lexicon(found, y)
    votes = vote_matrix(texts, found, Voters(lexicon))
    q, stats = label_model(votes, y, scale)
    n = len(lexicon)
    fired1, fired0 = (scale * q) @ votes[:, :n], (scale * (1 - q)) @ votes[:, :n]
    alone = np.eye(n, votes.shape[1])
    q_alone = (fired1 + PRIOR_ROWS * 0.5) / (fired1 + fired0 + PRIOR_ROWS)
    w = scale / scale.mean()
    beta = fit_linear(np.vstack([votes, alone]), np.concatenate([q, q_alone]), np.concatenate([w, np.minimum(fired1, ALONE_ROWS)]))
    return {"lexicon": lexicon, "weights": beta[:n].tolist(), "patterns": beta[n:-1].tolist(), "intercept": float(beta[-1]), "label_model": stats}


class Scorer:
    def __init__(self, model: dict) -> None:
        self.voters = Voters(model["lexicon"])
        self.weights = np.array(model["weights"] + [0.0])
        self.patterns = np.array(model["patterns"])
        self.intercept = model["intercept"]

    def __call__(self, text: str) -> float:
        logit = self.intercept + float(self.patterns @ pattern_votes(text))
        hits = self.voters.of(words(text))
        if hits:
            logit += float(self.weights[sorted(hits)].sum())
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, logit)))))


def held_out(id_col: str = "doc_id"):
    modulus, rest = HELD_OUT
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> dict:
    """Train on a bounded sample of the labelled rows that are not held out.

    Rows without a label or an id are left out; a document with several labels is toxic if
    any says so; null texts are empty.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label, most in ((1, max_positive), (0, max_negative)):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    share = tuple(max(1.0, counts.get(label, 0) / most) for label, most in ((0, max_negative), (1, max_positive)))
    # At most max_positive + max_negative rows: one task and one broadcast hold them.
    rows = keyed_text(docs).join(F.broadcast(sample), "doc_id").select("toxic", "text").repartition(1)

    def run(batches):
        texts, toxic = [], []
        for b in batches:
            toxic += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(train(texts, toxic, share))], pa.string())], names=["model"])

    found = rows.mapInArrow(run, "model string").collect()
    return json.loads(found[0]["model"]) if found else train([], [])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1). The model, bounded by ``MAX_LEXICON``, is broadcast.

    Null text is empty and gets the score of an empty text; null ids stay null; repeated rows
    each get their row; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        scorer = Scorer(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [scorer(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

        return step

    return map_slices(keyed_text(docs, id_col, text_col), kernel, f"{id_col} long, score double")


def reject_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``; all columns and repeated rows of the rest stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def kernel():
        scorer = Scorer(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([scorer(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

        return step

    return map_slices(docs, kernel, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
