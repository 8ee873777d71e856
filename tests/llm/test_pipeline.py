import duckdb
import pytest

import corpus_pipeline as p
from sparkloom.llm import decontaminate, mixing, secrets, toxicity

from .test_decontaminate import brute as brute_hits
from .test_similarity import brute as brute_groups

AT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{AT}/documents.parquet"), []
    for _, stage in p.STAGES:
        made = stage(spark, docs, AT)
        docs = spark.createDataFrame(made.collect(), made.schema)
        out.append({r["doc_id"]: r for r in docs.collect()})
    return out


def test_stages_against_brute_force(spark, staged):
    docs = {i: t for i, t in duckdb.sql(f"select doc_id, text from '{AT}/documents.parquet'").fetchall()}
    clean, single, cut, masked, mixed = staged
    model = toxicity.fit(spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    assert set(clean) == {i for i, t in docs.items() if scorer(t) < toxicity.THRESHOLD} and len(clean) < len(docs)
    groups = brute_groups([(i, r["text"]) for i, r in clean.items()])
    assert set(single) == {i for i, n, c in groups if i == c}
    items = duckdb.sql(f"select item_id, text from '{AT}/benchmark.parquet'").fetchall()
    hit = {r[0] for r in brute_hits([(i, r["text"]) for i, r in single.items()], items) if r[5]}
    assert hit and {i for i in cut if cut[i]["text"] != single[i]["text"]} == hit and set(cut) == set(single)
    assert not any(r[5] for r in brute_hits([(i, r["text"]) for i, r in cut.items()], items))
    found = {i for i, r in cut.items() if secrets.base_spans(r["text"])}
    assert found and found <= {i for i in masked if masked[i]["text"] != cut[i]["text"]} and set(masked) == set(cut)
    assert not any(secrets.base_spans(r["text"]) for r in masked.values())
    assert set(mixed) <= set(masked) and 0 < len(mixed) < len(masked)


def test_run_is_the_stages_in_a_row(spark, staged):
    got = p.run(spark, AT)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: r["text"] for i, r in staged[-1].items()}
    assert got.columns[:5] == spark.read.parquet(f"{AT}/documents.parquet").columns


def test_columns_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    assert decontaminate and mixing
