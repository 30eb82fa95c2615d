"""Inferred contracts, lenient parsing, folder scan and order rules on hand-made rows."""

import os

from pyspark.sql import functions as F

from lintlake.operators import mining as M
from lintlake.sources import corpus, quarantine


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_value_rules(spark):
    t = spark.createDataFrame([(float(i), -1.0 if i == 0 else 0.5, None) for i in range(40)], "a double, b double, c double")
    got = by(M.value_rules(t, ["a", "b", "c"], 0.97), "subject", "kind")
    assert got[("a", "not_negative")]["confidence"] == 1.0 and got[("a", "positive")]["confidence"] == 0.975 and ("a", "unit_interval") not in got and got[("a", "whole")]["lo"] == 0.0
    assert got[("b", "unit_interval")]["holds"] == 39 and ("b", "whole") not in got
    assert not [k for k in got if k[0] == "c"]  # no value, no rule; not_null does not hold
    assert M.value_rules(t.limit(0), ["a"]).count() == 0


def test_a_planted_dependency_is_found_and_a_violation_lowers_its_confidence(spark):
    rows = [(i, i % 10, (i % 10) * 7 % 13, None) for i in range(200)]
    clean = spark.createDataFrame(rows, "id int, a int, b int, n int")
    got = by(M.dependencies(clean, [("a", "b"), ("b", "a"), ("a", "id"), ("id", "a"), ("n", "a"), ("a", "n")], 0.9), "subject")
    assert got[("a -> b",)]["confidence"] == 1.0 and got[("a -> b",)]["groups"] == 10 and got[("a -> b",)]["broken_groups"] == 0
    assert ("a -> id",) not in got and ("id -> a",) not in got  # a key says nothing
    assert ("n -> a",) not in got and got[("a -> n",)]["confidence"] == 1.0  # nulls are one value
    rows[17] = (17, 7, 99, None)
    broken = by(M.dependencies(spark.createDataFrame(rows, "id int, a int, b int, n int"), [("a", "b")], 0.9), "subject")[("a -> b",)]
    assert broken["confidence"] == 0.995 and broken["broken_groups"] == 1 and broken["holds"] == 199


def test_inclusions_and_merge(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "y long")
    got = by(M.inclusions([("x", F.col("x"), child, "y", F.col("y"), parent), ("y", F.col("y"), parent, "x", F.col("x"), child.filter("x < 9")), ("y", F.col("y"), parent, "y2", F.col("y"), parent)], 0.6), "subject")
    assert got[("x in y",)]["holds"] == 2 and got[("x in y",)]["support"] == 3 and got[("y in x",)]["confidence"] == 0.666667 and got[("y in y2",)]["confidence"] == 1.0
    inferred = spark.createDataFrame([("a", "k", 10, 10, 1.0), ("b", "k", 10, 9, 0.9), ("c", "k", 5, 5, 1.0)], M.INFERRED)
    declared = spark.createDataFrame([("a", "k"), ("b", "k"), ("d", "k"), ("a", "k")], "subject string, kind string")
    merged = M.merged(declared, inferred)
    assert {r["subject"]: r["state"] for r in merged.collect()} == {"a": "confirmed", "b": "violated", "c": "new", "d": "unsupported"}
    assert {r["state"]: r["n"] for r in M.contract_report(merged.filter("state <> 'new'")).collect()} == {"confirmed": 1, "violated": 1, "unsupported": 1, "new": 0}


def test_used_before(spark):
    rows = [("early", 1, "buy"), ("early", 2, "see"), ("early", 3, "buy"), ("fine", 1, "see"), ("fine", 2, "buy"), ("never", 5, "buy"), ("never", 6, "buy"), ("same", 4, "buy"), ("same", 4, "see"), ("none", 1, "see"), ("twice", 1, "buy"), ("twice", 2, "buy"), ("twice", 3, "see")]
    df = spark.createDataFrame(rows, "who string, at int, what string")
    got = {r["who"]: (r["first_use"], r["first_check"], r["uses_before"]) for r in M.used_before(df, "who", F.col("at"), F.col("what") == "buy", F.col("what") == "see").collect()}
    assert got == {"early": (1, 2, 1), "never": (5, None, 2), "twice": (1, 3, 2)}


def test_malformed_rows_end_in_quarantine_and_the_rest_go_on(spark):
    rows = [(1, '{"k": 5}'), (2, "{broken"), (3, None), (4, '{"j": 1}'), (5, '{"k": "x"}'), (6, '{"k": 700}'), (7, '{"k": 7, "more": [1]}'), (8, ""), (9, "[1, 2]"), (10, '{"k": null}')]
    p = quarantine.parsed(spark.createDataFrame(rows, "id long, props string"), "props", {"k": (0, 99)})
    good, bad = quarantine.split(p)
    assert {r["id"]: r["k"] for r in good.collect()} == {1: 5, 7: 7} and "reason" not in good.columns
    assert {r["id"]: (r["reason"], r["confidence"]) for r in bad.collect()} == {
        2: ("not_json", "low"), 3: ("no_text", "low"), 4: ("missing:k", "medium"), 5: ("not_a_number:k", "medium"), 6: ("out_of_range:k", "medium"), 8: ("not_json", "low"), 9: ("missing:k", "medium"), 10: ("missing:k", "medium")}
    assert {r["props"] for r in bad.filter("id = 2").collect()} == {"{broken"}  # the row itself is kept


def test_folder_scan(spark, tmp_path):
    root = tmp_path / "data"
    for path, text in (("a.parquet", "x"), ("deep/er/b.CSV", "four"), ("deep/noext", "abc"), ("empty", ""), ("t.parquet/part-0.parquet", "12"), ("_SUCCESS", "")):
        os.makedirs((root / path).parent, exist_ok=True)
        (root / path).write_text(text)
    got = {r["path"]: (r["name"], r["suffix"], r["top"], r["bytes"]) for r in corpus.scan_files(spark, str(root)).collect()}
    assert got == {"a.parquet": ("a.parquet", "parquet", "a.parquet", 1), "deep/er/b.CSV": ("b.CSV", "csv", "deep", 4), "deep/noext": ("noext", "", "deep", 3), "t.parquet/part-0.parquet": ("part-0.parquet", "parquet", "t.parquet", 2)}
    assert corpus.scan_files(spark, str(root), "*.parquet").count() == 2
