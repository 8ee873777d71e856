import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for s in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = set()
    for i, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if (k := windows.get(tuple(w[s : s + size]))) is not None:
                    hit.update(range(s, s + size))
                    found |= k
        out.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_query_matches_brute_force_on_the_tables(spark):
    at = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{at}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{at}/benchmark.parquet'").fetchall()
    got = {tuple(r) for r in d.op4_decontaminate(spark, at).collect()}
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


DOCS = [(1, "One two-three FOUR é five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (None, "alpha beta"), (5, "x " * 30_000 + "alpha BETA"), (5, "alpha; beta alpha beta"), (6, "two three four")]
ITEMS = [(10, "two three four É five six seven eight nine ten"), (11, "alpha beta"), (12, None), (13, "..."), (11, "alpha beta"), (14, "two three four é five six seven eight nine ten eleven")]


def frames(spark):
    docs = spark.createDataFrame([(*r, 7) for r in DOCS], "doc_id long, text string, items int")
    return docs, spark.createDataFrame([(*r, 7) for r in ITEMS], "item_id int, text string, spans int")


def digest(df):
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return {(r[0], r[1], r[2], tuple(r[3])) for r in df.select("doc_id", "n_words", n_hit, "items").collect()}


def test_small_cases(spark):
    docs, items = frames(spark)
    got = digest(d.scan(docs, items))
    want = {(r[0], r[1], r[2], r[3]) for r in brute(DOCS, ITEMS)}
    assert {(a, b, c, len(x)) for a, b, c, x in got} == want
    assert digest(d.scan(docs, items, max_windows=1)) == got
    assert d.scan(docs, items, max_windows=1).count() == len(DOCS)
    assert digest(d.scan(docs, items.limit(0))) == {(r[0], r[1], 0, ()) for r in want}
    assert d.scan(docs.limit(0), items).count() == 0


def test_spans_are_cut_from_texts_and_clean_rows_stay(spark):
    docs, items = frames(spark)
    got = [tuple(r) for r in d.decontaminate(docs, items).collect()]
    assert len(got) == len(DOCS) and (6, "two three four", 7) in got
    assert ("One  twelve" in [g[1] for g in got])
    assert [g[1] for g in got if g[0] is None] == [""]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in d.decontaminate(docs, items, max_windows=1).collect())
    assert len(d.decontaminate(docs, items, drop_share=1.0).collect()) == len(DOCS) - 2


def test_what_a_cut_brings_together_is_cut_however_large_the_benchmark(spark):
    one, two, three = ("".join(f"{w}{k} " for k in range(10)) for w in "abc")
    nested = f"start {one[:15]}{two[:15]}{three}{two[15:]}{one[15:]}end"
    rows = [(1, nested, 9), (1, nested, 9), (2, "clean", 5), (None, nested, 9), (3, None, 0), (4, three + "rest", 9), (5, f"{three[:15]}{one}{three[15:]}", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    items = spark.createDataFrame([(10, one), (11, two), (12, three)], "item_id int, text string")
    for share in (None, 0.4):
        want = sorted(map(str, d.decontaminate(docs, items, drop_share=share).collect()))
        assert sorted(map(str, d.decontaminate(docs, items, drop_share=share, max_windows=1).collect())) == want
        assert len(want) == (len(rows) if share is None else len(rows) - 2)
    got = d.decontaminate(docs, items, max_windows=1)
    assert not any(r[2] for r in digest(d.scan(got, items)))
    assert {r["text"] for r in got.collect() if r["doc_id"] in (1, None)} == {"start  end"}
