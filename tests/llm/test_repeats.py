import hashlib
import random

import duckdb
import numpy as np
import pytest

from sparkloom.llm import repeats as r


def brute(docs, length=r.LENGTH):
    raw = [(t or "").encode() for _, t in docs]
    seen = {}
    for x in raw:
        for s in range(len(x) - length + 1):
            k = hashlib.blake2b(x[s : s + length], digest_size=12).digest()
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (i, _), x in zip(docs, raw, strict=True):
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - length + 1):
            if seen[hashlib.blake2b(x[s : s + length], digest_size=12).digest()] > 1:
                gone[s : s + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(x), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_query_matches_brute_force_on_the_tables(spark):
    at = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{at}/documents.parquet'").fetchall()
    want = brute(docs)
    assert rows(r.op5_suffix_dedup(spark, at)) == want and any(x[2] for x in want)


def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(400), text(90)
    texts = [None, "", "x" * 399, "y" * 401, "ab" * 1500, "z" * 5000, base, base]
    for _ in range(25):
        w = base.split(" ")
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [text(rng.randint(0, 60)) + passage + text(rng.randint(0, 60)) for _ in range(20)]
    texts += [passage[:k] for k in (399, 400, 401)] + [t + t for t in (text(100), text(60))]
    rng.shuffle(texts)
    return [(i if i != 5 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most", [r.MAX_COLLECTION, 3])
def test_planted_repeats(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(r, "MAX_COLLECTION", most)
    docs = planted()
    spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, anchor int, row int").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(r.op5_suffix_dedup(spark, str(tmp_path))) == brute(docs)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "q" * 100 + "abc" * 150), (1, "q" * 100 + "abc" * 150)], "doc_id long, text string")
    assert [tuple(x["spans"][0]) for x in r.remove_repeats(df).collect()] == [(0, 550)] * 2
    assert r.remove_repeats(df.limit(0)).count() == 0


def test_columns_find_common_strings():
    rng = np.random.default_rng(1)
    for _ in range(40):
        m, width, length = int(rng.integers(1, 30)), 14, int(rng.integers(2, 8))
        groups = np.sort(rng.integers(0, 3, m))
        rows_ = rng.integers(0, 2, (m, width)).astype(np.uint16)
        rows_[rng.random(m) < 0.2, :3] = r.END
        rows_[rng.random(m) < 0.2, 11:] = r.END
        several = rng.random(m) < 0.1
        got = r.repeated_starts(groups, rows_.T.copy(), several, length)
        for i in range(m):
            for s in range(width - length + 1):
                x = rows_[i, s : s + length]
                same = any(j != i and groups[j] == groups[i] and (rows_[j, s : s + length] == x).all() for j in range(m))
                assert got[i, s] == ((same or several[i]) and not (x == r.END).any())


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(2)
    hasher = r.Hasher()
    for _ in range(30):
        raw = rng.integers(97, 99, 1500).astype(np.uint8) if rng.random() < 0.5 else np.tile(rng.integers(97, 122, rng.integers(1, 90)).astype(np.uint8), 200)[:1500]
        at, _ = r.anchors(raw, hasher)
        for s in range(0, len(raw) - r.LENGTH + 1, 97):
            own, _ = r.anchors(raw[s : s + r.LENGTH].copy(), hasher)
            assert len(own) == 1 and s + own[0] in at
