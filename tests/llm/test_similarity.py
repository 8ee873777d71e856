import random

import duckdb
import numpy as np

from sparkloom.llm import similarity as s
from sparkloom.llm.components import components


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    w = [x for x in words.split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting = {}
    for at, (_, x) in enumerate(sets):
        near = {other for g in x for other in posting.get(g, ())}
        for other in near:
            if 100 * len(x & sets[other][1]) >= 75 * len(x | sets[other][1]):
                parent[root(at)] = root(other)
        for g in x:
            posting.setdefault(g, []).append(at)
    smallest = {}
    for at, (i, _) in enumerate(sets):
        smallest[root(at)] = min(smallest.get(root(at), i), i)
    return sorted((i, len(x), smallest[root(at)]) for at, (i, x) in enumerate(sets))


def test_query_matches_brute_force_on_the_tables(spark):
    at = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{at}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in s.op10_jaccard_join(spark, at).collect())
    assert got == brute(docs) and any(i != c for i, _, c in got)


def near(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def test_groups_about_the_threshold(spark):
    rng = random.Random(5)
    docs, texts = [], []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 4, 5, 6, 9, 60, 200]))]
        for _ in range(15):
            texts.append(" ".join(near(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08]))))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(40)]
    rng.shuffle(texts)
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, set_id string")
    assert sorted(tuple(r) for r in s.join_components(df).collect()) == brute(docs)


def test_small_cases_and_one_document_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, long), (8, long + " end"), (7, long), (None, "one two"), (9, "one\x0btwo")]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, component_id int, key int")
    got = sorted(map(str, (tuple(r) for r in s.join_components(df).collect())))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29996, 7), (8, 29997, 7), (7, 29996, 7), (None, 1, 4), (9, 1, 4)]
    assert got == sorted(map(str, want))
    kept = s.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 6, 7, None]))
    assert s.join_components(df.limit(0)).count() == 0


def test_derived_answers_are_the_direct_ones():
    rng = np.random.default_rng(4)
    some = lambda k: np.unique(rng.integers(0, 60, k)).astype(np.uint64)
    for _ in range(200):
        members = [some(rng.integers(1, 40)) for _ in range(rng.integers(1, 6))]
        answers, probe = s.Answers(members), some(40)
        for _ in range(6):
            overlap = [len(np.intersect1d(m, probe)) for m in members]
            assert answers.overlaps(probe).tolist() == overlap
            linked = [100 * o >= 75 * (len(m) + len(probe) - o) for m, o in zip(members, overlap, strict=True)]
            best = answers.link(probe)
            assert linked[best] if best is not None else not any(linked)
            probe = np.unique(np.concatenate([rng.permutation(probe)[: max(1, len(probe) - rng.integers(0, 6))], some(rng.integers(1, 6))]))


def test_lists_name_the_pairs_that_may_link():
    rng = np.random.default_rng(5)
    for many in (3, 40, 300):
        lists = [sorted(zip(rng.integers(20, 60, k).tolist(), rng.integers(0, 12, k).tolist(), rng.integers(0, 9, k).tolist(), strict=True)) for k in rng.integers(1, many, 4).tolist()]
        want = set()
        for rows in lists:
            for i, (na, pa, ca) in enumerate(rows):
                for nb, pb, cb in rows[i + 1 :]:
                    if ca != cb and 100 * min(na, nb) >= 75 * max(na, nb) and 175 * min(na - pa, nb - pb) >= 75 * (na + nb):
                        want.add((min(ca, cb), max(ca, cb)))
        n, place, c = (np.array([r[k] for rows in lists for r in rows], np.int64) for k in range(3))
        edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        assert set(map(tuple, s.list_pairs(edges, c, n, place).T.tolist())) == want


def test_parities_keep_every_link():
    rng = np.random.default_rng(7)
    for _ in range(200):
        k = int(rng.integers(1, 900))
        sets = [np.unique(rng.integers(0, 2**63, k).astype(np.uint64))]
        for _ in range(4):
            sets.append(np.unique(np.concatenate([rng.permutation(sets[0])[: max(1, int(k * rng.uniform(0.6, 1)))], rng.integers(0, 2**63, rng.integers(0, k // 8 + 1)).astype(np.uint64)])))
        bits = [np.frombuffer(s.parity(x), np.uint64) for x in sets]
        block = s.Block(np.array([len(x) for x in sets[1:]]), bits[1:])
        overlaps = [len(np.intersect1d(sets[0], x)) for x in sets[1:]]
        linked = any(100 * o >= 75 * (len(sets[0]) + len(x) - o) for x, o in zip(sets[1:], overlaps, strict=True))
        assert block.may_link(len(sets[0]), bits[0]) or not linked
    far = np.unique(rng.integers(0, 2**63, k).astype(np.uint64))
    assert not s.Block(np.array([len(far)]), [np.frombuffer(s.parity(far), np.uint64)]).may_link(len(sets[0]), bits[0])


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(6)
    levels = rng.integers(0, 3, 1 << s.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.7, 1)))], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]))
        overlap = len(np.intersect1d(a, b))
        if 100 * overlap >= 75 * (len(a) + len(b) - overlap):
            x, y = s.rare_first(a, levels).tolist(), s.rare_first(b, levels).tolist()
            first = next(t for t in x if t in y)
            assert s.may_link(len(a), len(a) - x.index(first), len(b), len(b) - y.index(first))


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7)] + [(500, i) for i in range(501, 540)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    parent = {v: v for x in links for v in x}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    alone = {a for a, b in links if a == b} - {v for a, b in links if a != b for v in (a, b)}
    assert got == {v: root(v) for v in parent if v not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
