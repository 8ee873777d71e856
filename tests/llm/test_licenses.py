import re

import duckdb

from sparkloom.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc_id, text):
    w = words(text)
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return (doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_base_matches_brute_force_on_the_tables(spark):
    at = "/root/testdata/sf0.001"
    got = licenses.op6_license_scan(spark, at).collect()
    docs = duckdb.sql(f"select doc_id, text from '{at}/documents.parquet'").fetchall()
    assert {tuple(r)[:6] for r in got} == {brute(*r) for r in docs} and len(got) == len(docs)
    assert any(r["n_base"] for r in got)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


CASES = [
    (1, None), (2, ""), (3, "..."), (4, "Mit License"), (None, "cc by cc BY cc-by"), (5, "(MIT license) mit license."), (5, "(MIT license) mit license."),
    (6, "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation"),
    (7, "x " * 40_000 + "GNU General Public\nLicense"), (8, "GNU General Public Public License"), (9, "é cc\x00by éapache license"),
]


def test_small_cases(spark, tmp_path):
    spark.createDataFrame([(*r, 3) for r in CASES], "doc_id long, text string, label int").write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op6_license_scan(spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(str(brute(*r)) for r in CASES)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["labels"] == "mit-text" and by[6]["n_base"] == 0 and by[6]["first_word"] is None
    assert by[3]["labels"] == "" and by[3]["score"] == 0 and by[7]["score"] == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty).count() == 0


def test_near_identical_notices_are_told_apart(spark):
    cases = {
        "licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
        "licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "GNU General Public License Version 3": "gpl,gpl-3.0",
        "GNU General Public License Version 2, June 1991": "gpl,gpl-2.0",
        "licensed under the GNU General Public License": "gpl",
        "licensed under the GNU Lesser General Public License version 3": "lgpl",
        "licensed under the GNU Affero General Public License version 3": "agpl",
        "licensed under CC BY 4.0": "cc-by,cc-by-4.0",
        "licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "licensed under CC BY 3.0": "cc-by",
        "licensed under CC BY-SA 3.0": "cc-by",
        "Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "Creative Commons Attribution ShareAlike 4.0 International License": "",
        "licensed under the Apache License, version 2.0": "apache,apache-2.0",
        "licensed under the Apache License, version 2.1": "apache",
        "subject to the terms of the Mozilla Public License, v. 2.0. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1": "",
        "licensed under GNU General Public License version 3": "gpl,gpl-3.0",
    }
    texts = list(cases)
    df = spark.createDataFrame([(i, f"x y {t} z") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: ",".join(sorted({s["label"] for s in r["spans"]})) for r in licenses.scan(df).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == cases
