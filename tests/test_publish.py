import pytest
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.operators import publish as P


def test_labels(spark):
    df = spark.createDataFrame([("a", None), ("b", 0), ("c", 1), ("d", 2), ("e", -1)], "link string, classification int")
    assert {r["link"] for r in P.labelled(df).collect()} == {"b", "c", "d"}
    assert {r["link"] for r in P.unlabelled(df).collect()} == {"a"}
    got = {r["link"]: r["n"] for r in df.select("link", P.narrow_label(F.col("classification")).alias("n")).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 0, "e": 0}


def test_corrections(spark):
    link = next(iter(V.CORRECTIONS))
    df = spark.createDataFrame([(link, 0), ("x", 0), ("y", None)], "link string, label int")
    got = {r["link"]: r["label"] for r in P.apply_corrections(df, P.corrections_table(spark)).collect()}
    assert got == {link: 1, "x": 0, "y": None}


def test_class_match(spark):
    rows = [(0, 0, 1), (1, 1, 1), (0, 1, 0), (1, 0, 0), (None, 1, None)]
    df = spark.createDataFrame(rows, "p int, y int, want int")
    assert all(r["m"] == r["want"] for r in df.withColumn("m", P.class_match(F.col("p"), F.col("y"))).collect())


def test_agreement_is_a_left_join(spark):
    expert = spark.createDataFrame([("a", 1), ("b", 0)], "link string, label int")
    pred = spark.createDataFrame([("a", 0)], "link string, prediction int")
    got = {r["link"]: (r["prediction"], r["class_match"]) for r in P.with_agreement(expert, pred).collect()}
    assert got == {"a": (0, 0), "b": (None, None)}


def test_publish(spark):
    expert = spark.createDataFrame([("A", 2005, "l1", 0), ("B", 2001, "l2", 1)], "case_name string, year int, link string, label int")
    pred = spark.createDataFrame([("C", 2003, "l3", 0), ("D", 2003, "l0", 1)], "case_name string, year int, link string, prediction int")
    fixes = P.corrections_table(spark, {"l1": 1})
    got = [tuple(r) for r in P.publish(expert, pred, fixes).select(
        "link", "classification", "expert_or_ml_classified", "year").collect()]
    assert got == [("l2", 1, "expert", 2001), ("l0", 1, "ml", 2003), ("l3", 0, "ml", 2003), ("l1", 1, "expert", 2005)]


def test_mention_summary(spark):
    df = spark.range(55202)
    r = P.mention_summary(df, F.col("id") < 1637).first()
    assert (r["checked"], r["mentions"], r["percent"]) == (55202, 1637, pytest.approx(2.97))


def test_sheet_and_second_round(spark):
    found = spark.createDataFrame([(f"c{i}", 2000, f"l{i:04d}") for i in range(1637)], "case_name string, year int, link string")
    sheet = P.labelling_sheet(found, ["link"])
    rows = sheet.collect()
    assert sorted(r["idx"] for r in rows) == list(range(1, 1638))
    assert all(r["link"] == f"l{r['idx'] - 1:04d}" for r in rows)
    assert sum(r["sample"] for r in rows) == 200 and {r["classification"] for r in rows} == {None}
    done = sheet.withColumn("classification", F.when(F.col("sample") == 1, F.col("idx") % 3).cast("int"))
    second = P.extend_sample(done)
    counts = {(r["og_sample"], r["sample"]): r["count"] for r in second.groupBy("og_sample", "sample").count().collect()}
    assert counts == {(1, 1): 200, (0, 1): 300, (0, 0): 1137}
