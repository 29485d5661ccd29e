import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docketflow.operators import sampling as S
from docketflow.operators.ranking import exact_rank, local_if_small


def _expected(rows, by, order):
    groups, out = {}, {}
    for r in sorted(rows, key=lambda r: tuple(r[o] for o in order)):
        k = tuple(r[b] for b in by)
        groups[k] = groups.get(k, 0) + 1
        out[tuple(r[o] for o in order) + k] = groups[k]
    return out


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    """Range partitions as they were cut, and put together when they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_exact_rank(spark, by, coalesced):
    rng = random.Random(3)
    # one group holds most rows
    rows = [{"g": "hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", "h": rng.randrange(2), "a": i // 7, "b": f"x{i % 7}"}
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, a int, b string")
    got = exact_rank(df, by, ["a", "b"], "n", total="all")
    assert got.columns == df.columns + ["n", "all"]
    got = got.collect()
    assert {(r["a"], r["b"], *[r[c] for c in by]): r["n"] for r in got} == _expected(rows, by, ["a", "b"])
    sizes = {}
    for r in rows:
        k = tuple(r[c] for c in by)
        sizes[k] = sizes.get(k, 0) + 1
    assert all(r["all"] == sizes[tuple(r[c] for c in by)] for r in got)


def test_exact_rank_with_null_groups_ties_and_taken_names(spark, coalesced):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 > 0, "x")).withColumn("_at", F.lit(1)).withColumn("_n", F.lit("y"))
    got = exact_rank(df, ["g"], ["id"], "n").collect()
    assert {tuple(r[c] for c in ("_at", "_n")) for r in got} == {(1, "y")}
    for g, rows in (("x", [i for i in range(500) if i % 3]), (None, [i for i in range(500) if i % 3 == 0])):
        assert {r["id"]: r["n"] for r in got if r["g"] == g} == {i: n + 1 for n, i in enumerate(rows)}
    alike = exact_rank(spark.range(300).select(F.lit(None).cast("string").alias("g"), F.lit(1).alias("o")), ["g"], ["o"], "n").collect()
    assert sorted(r["n"] for r in alike) == list(range(1, 301))
    assert exact_rank(df.limit(0), ["g"], ["id"]).collect() == []


def test_hot_group_is_cut_into_ranges(spark):
    """No window has the rows in it: only one count per group and partition is added up."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(80_000).withColumn("g", F.lit("hot"))
        ranked = exact_rank(df, ["g"], ["id"], "n")
        assert max(r["count"] for r in ranked.groupBy(F.floor(F.col("n") / 1)).count().collect()) == 1
        parts = [r["count"] for r in df.repartitionByRange("g", "id").groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) == 8 and max(parts) < 80_000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_local_if_small(spark):
    df = spark.range(10)
    assert local_if_small(df, 10) is not df and local_if_small(df, 9) is df


def test_draw_and_flag(spark):
    df = spark.range(1000).withColumnRenamed("id", "idx")
    flagged = S.flag_sample(df, "idx", 200)
    assert flagged.count() == 1000 and flagged.filter("sample = 1").count() == 200
    again = {r["idx"] for r in S.flag_sample(df, "idx", 200).filter("sample = 1").collect()}
    assert again == {r["idx"] for r in flagged.filter("sample = 1").collect()}
    assert S.flag_sample(df, "idx", 200, seed=2).filter("sample = 1").join(flagged.filter("sample = 1"), "idx").count() < 200
    assert S.draw(df, "idx", 5000).count() == 1000


@pytest.mark.parametrize("sizes", [(1, 5, 83, 417), (3, 2500), (2, 2)])
def test_split_counts_are_exact(spark, sizes):
    rows = [(f"k{c}-{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "link string, label int")
    split = S.stratified_split(df).collect()
    assert sorted((r["link"], r["label"]) for r in split) == sorted(rows)
    test = {}
    for r in split:
        test[r["label"]] = test.get(r["label"], 0) + (r["split"] == "test")
    assert test == {c: int(0.2 * n + 0.5) for c, n in enumerate(sizes)}


def test_split_follows_the_hash(spark):
    import hashlib
    df = spark.createDataFrame([(i, i % 2) for i in range(300)], "link bigint, label int")
    got = {r["link"] for r in S.stratified_split(df).filter("split = 'test'").collect()}
    want = set()
    for c in (0, 1):
        keys = sorted((i for i in range(300) if i % 2 == c), key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())
        want |= set(keys[:30])
    assert got == want


def _folds(labels, k=5):
    """The usual unshuffled stratified folds, by hand."""
    seen = list(dict.fromkeys(labels))
    code = sorted(seen.index(y) for y in labels)
    give = [[code[i::k].count(c) for c in range(len(seen))] for i in range(k)]
    out, at = [], {c: [f for f in range(k) for _ in range(give[f][c])] for c in range(len(seen))}
    for y in labels:
        out.append(at[seen.index(y)].pop(0))
    return out


def test_folds_of_400(spark, coalesced):
    rng = random.Random(1)
    labels = [1] * 66 + [0] * 334
    rng.shuffle(labels)
    df = spark.createDataFrame(list(enumerate(labels)), "link int, label int")
    got = S.stratified_folds(df).orderBy("link").collect()
    assert [r["fold"] for r in got] == _folds(labels)
    per_fold = sorted(sum(r["label"] for r in got if r["fold"] == f) for f in range(5))
    assert per_fold == [13, 13, 13, 13, 14] and all(sum(r["fold"] == f for r in got) == 80 for f in range(5))


@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_folds_property(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "link int, label int")
    assert [r["fold"] for r in S.stratified_folds(df).orderBy("link").collect()] == _folds(labels)
