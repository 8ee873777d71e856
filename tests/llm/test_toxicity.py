import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import toxicity as t


def corpus(n, seed, words=("grumblewort", "snarkle")):
    rng = random.Random(seed)
    syllables = ["an", "re", "to", "li", "sha", "mo", "ve", "ku", "é", "dor"]
    rows = []
    for i in range(n):
        body = ["".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(rng.randint(20, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                body.insert(rng.randrange(len(body)), rng.choice([words[0], words[1] + rng.choice(syllables)]))
        rows.append((i, " ".join(body), toxic))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus(900, 1)
    spark.createDataFrame(rows, "doc_id long, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1 if held(i) else y) for i, _, y in rows]  # held-out labels are wrong on purpose: they must not be read
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in t.op9_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    right = [got[i]["predicted"] == y for i, _, y in rows if held(i)]
    assert np.mean(right) > 0.98


def test_label_model_prefers_votes_to_a_wrong_label():
    rng = np.random.default_rng(2)
    truth = rng.random(400) < 0.3
    votes = np.column_stack([np.where(truth, rng.random(400) < 0.9, rng.random(400) < 0.02) for _ in range(5)]).astype(float)
    given = truth.copy()
    given[:8] = ~given[:8]
    q, stats = t.label_model(votes, given.astype(float), np.ones(400))
    assert np.mean((q > 0.5) == truth) > 0.985
    assert all(a > 0.8 and b < 0.1 for a, b in zip(stats["toxic_rate"], stats["clean_rate"], strict=True))


def test_correlated_voters_are_discounted():
    rng = np.random.default_rng(3)
    truth = rng.random(500) < 0.4
    one = np.where(truth, rng.random(500) < 0.8, rng.random(500) < 0.1)
    other = np.where(truth, rng.random(500) < 0.8, rng.random(500) < 0.1)
    _, stats = t.label_model(np.column_stack([one, one, other]).astype(float), truth.astype(float), np.ones(500))
    assert stats["discount"][0] < 0.6 < stats["discount"][2]


def test_copies_count_once_in_the_lexicon():
    copy = {f"word{i}number".encode() for i in range(30)}
    docs = [copy] * 40 + [{f"clean{i}{j}".encode() for j in range(30)} for i in range(100)]
    assert t.choose_lexicon(docs, np.array([1.0] * 40 + [0.0] * 100)) == []


def test_degenerate_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you are", "x"), (4, "a " * 60_000, "x"), (4, "a", "x")], "doc_id long, text string, toxic string")
    for labels in ([], [(1, None), (None, 1)], [(1, 0), (2, 0)], [(1, 1), (1, 0), (2, 0), (4, 1)]):
        model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = t.score(docs, model).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        assert t.reject_toxic(docs, model).columns == docs.columns
    assert t.score(docs.limit(0), t.train([], [])).count() == 0
    assert t.held_out is not None and docs.select(t.held_out().alias("h")).where(F.col("h").isNull()).count() == 0
