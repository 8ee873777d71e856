import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing as m


def brute(cells: pd.DataFrame, keep, temper, targets=None):
    """Raking and calibration over a data frame of cells, by plain loops."""
    goal = {}
    for d in m.DIMENSIONS:
        own = cells.groupby(d)["tokens"].sum()
        if targets and d in targets:
            raw = own.astype(float) * max(0, 1 - sum(targets[d].values())) / own[~own.index.isin(targets[d])].sum()
            for v, x in targets[d].items():
                if v in raw:
                    raw[v] = x
        else:
            raw = own.astype(float) ** temper
        goal[d] = raw / raw.sum()
    w = cells["tokens"] / cells["tokens"].sum()
    for _ in range(400):
        for d in m.DIMENSIONS:
            w = w * cells[d].map(goal[d]) / w.groupby(cells[d]).transform("sum")
    low, high = 0.0, 1e15
    budget = keep * cells["tokens"].sum()
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(cells["tokens"], mid * w).sum() < budget else (low, mid)
    return w, np.minimum(1, high * w / cells["tokens"]), goal


def test_marginals_and_budget_hold_on_the_tables(spark):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    cells = m.fit_cells(docs).toPandas().rename(columns={f"d_{d}": d for d in m.DIMENSIONS}).sort_values(list(m.DIMENSIONS)).reset_index(drop=True)
    w, p, goal = brute(cells, m.KEEP_SHARE, m.TEMPER)
    np.testing.assert_allclose(cells["weight"], w, atol=1e-5)
    np.testing.assert_allclose(cells["probability"], p, atol=1e-3)
    for d in m.DIMENSIONS:
        np.testing.assert_allclose(cells.groupby(d)["weight"].sum(), goal[d], atol=1e-5)
    rows = m.op2_mix_sources(spark, at).toPandas()
    assert len(rows) == duckdb.sql(f"select count(*) from '{at}/documents.parquet'").fetchall()[0][0]
    kept = rows.loc[rows["mix_sampled"], "mix_tokens"].sum() / rows["mix_tokens"].sum()
    assert abs(kept - m.KEEP_SHARE) < 0.06
    assert abs(rows["mix_weight"].sum() - 1) < 1e-6


def test_given_targets_and_dealt_cells(spark, monkeypatch):
    rows = [(i, "x" * (i % 37 + 1), f"s{i % 3}", "en" if i % 5 else None, "t" if i % 2 else "u") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"s0": 0.6, "s1": 0.2}}
    cells = m.fit_cells(df, targets, 0.3).toPandas()
    shares = cells.groupby("d_source")["weight"].sum()
    assert abs(shares["s0"] - 0.6) < 1e-4 and abs(shares["s2"] - 0.2) < 1e-4
    assert abs((cells["tokens"] * cells["probability"]).sum() / cells["tokens"].sum() - 0.3) < 1e-6
    assert (m.fit_cells(df, targets, 1.0).toPandas()["probability"] == 1).all()
    monkeypatch.setattr(m, "SMALL_CELLS", 0)
    dealt = m.fit_cells(df, targets, 0.3).toPandas()
    order = ["d_source", "d_lang", "d_topic"]
    np.testing.assert_allclose(dealt.sort_values(order)["weight"], cells.sort_values(order)["weight"], atol=1e-9)


def test_names_that_clash(spark):
    names = ["d_source", "d_draw", "d_tokens", "c_weight", "c_probability", "cd_source", "row", "rows", "tokens", "mix_sampled"]
    df = spark.createDataFrame([(i, "x" * 40 * i, f"s{i % 2}", "en", *(n + str(i) for n in names)) for i in range(1, 9)], ["doc_id", "text", "source", "lang", *names])
    plain = {r["doc_id"]: r for r in m.mix(df.select("doc_id", "text", "source", "lang")).collect()}
    got = m.mix(df)
    assert got.columns == ["doc_id", "text", "source", "lang", *names[:-1], "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_sampled"]
    for r in got.collect():
        assert all(r[n] == n + str(r["doc_id"]) for n in names[:-1]) and r["mix_sampled"] == plain[r["doc_id"]]["mix_sampled"]
    assert m.mix(got.where("mix_sampled")).count() == sum(r["mix_sampled"] for r in plain.values())


def test_marginals_that_cannot_hold_are_told(spark):
    df = spark.createDataFrame([(1, "x" * 40, "a", "en", "t"), (2, "x" * 40, "b", "de", "t")], "doc_id long, text string, source string, lang string, topic string")
    with pytest.warns(UserWarning, match="still off"):
        m.fit_cells(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}})


def test_small_cases(spark):
    rows = [(1, None, None, None, 1), (2, "", "a", "en", 1), (None, "abc", "a", "en", 1), (4, "x" * 50_000, "b", "de", 1), (4, "x" * 50_000, "b", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    got = m.mix(df).collect()
    assert len(got) == 5 and all(0 <= r["mix_probability"] <= 1 for r in got)
    assert all(r["mix_sampled"] and r["mix_weight"] == 0 for r in got if not r["text"])
    assert len({r["mix_sampled"] for r in got if r["doc_id"] == 4}) == 1
    assert m.mix(df.limit(0)).count() == 0
    assert m.mix(df.where("text is null")).where(F.col("mix_sampled")).count() == 1
