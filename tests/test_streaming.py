import datetime

from pyspark.sql import functions as F

from docketflow.session import scratch_path
from docketflow.streaming import flow


def test_new_pages_are_flagged_once_across_restarts(spark):
    source, out, progress = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-progress"))
    schema = "link string, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        pages = flow.read_arriving(spark, source, spark.createDataFrame([], schema).schema, 1)
        flow.run_to_end(flow.flag_new_pages(pages, "link", F.col("text")), out, progress, 120)
        return {r["link"]: r["mention"] for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    # one link makes up most of the rows, with different texts
    first, n = arrive([("a", f"an animal {i}") for i in range(300)] + [("b", "none")])
    assert first == {"a": "animal_mention", "b": "no_mention"} and n == 2
    second, n = arrive([("a", "an animal again"), ("c", "Animal"), ("bad�", "animal")])
    assert second == {**first, "c": "animal_mention", "bad�": "no_judgment_on_bailii"} and n == 4


def test_first_text_is_defined_and_links_are_forgotten(spark):
    """The earliest text counts in whatever order files come; a link that stays away is forgotten, and late rows change nothing."""
    source, out, progress = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-progress"))
    schema = "link string, text string, at timestamp"
    day = datetime.datetime(2024, 1, 1)

    def arrive(rows):
        spark.createDataFrame([(k, t, day + datetime.timedelta(days=d)) for k, t, d in rows], schema).repartition(4).write.mode("append").parquet(source)
        pages = flow.read_arriving(spark, source, spark.createDataFrame([], schema).schema)
        flow.run_to_end(flow.flag_new_pages(pages, "link", F.col("text"), "at", "2 days", datetime.timedelta(days=10)), out, progress, 120)
        return sorted((r["link"], r["mention"]) for r in spark.read.parquet(out).collect())

    rows = [("a", "none", d / 100) for d in range(1, 200)] + [("a", "an animal", 0), ("b", "none", 1), ("b", "animals", 1.5)]
    first = arrive(rows)
    assert first == [("a", "animal_mention"), ("b", "no_mention")]
    # b comes again and is known; c moves the time on; d is too late
    second = arrive([("b", "animal", 9), ("c", "none", 9)])
    assert second == sorted([*first, ("c", "no_mention")])
    third = arrive([("e", "none", 17), ("b", "animal", 17)])
    assert third == sorted([*second, ("e", "no_mention")])
    fourth = arrive([("d", "animal", 3), ("b", "animal", 17)])
    assert ("d", "animal_mention") not in fourth
    # a was last seen on day 2 and is new again; b never stayed away so long
    fifth = arrive([("a", "none", 18), ("b", "none", 18)])
    assert fifth == sorted([*third, ("a", "no_mention")])


def test_scoring_runs_the_batch_steps(spark):
    source, out, progress = (scratch_path(spark, n) for n in ("t-docs", "t-scores", "t-scored"))
    spark.range(50).write.parquet(source)
    docs = flow.read_arriving(spark, source, spark.range(1).schema)
    scored = flow.score_arriving(docs, lambda d: d.withColumn("x", F.col("id") * 2),
                                 lambda d: d.withColumn("prediction", (F.col("x") > 40).cast("int")))
    flow.run_to_end(scored, out, progress, 120)
    got = spark.read.parquet(out)
    assert got.count() == 50 and got.agg(F.sum("prediction")).first()[0] == 29
