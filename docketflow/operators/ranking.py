"""Exact row numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from docketflow.session import materialise

# A table of at most this many rows may be held by the driver and broadcast.
SMALL_ROWS = 50_000


def small_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """Driver rows as a table for a broadcast join; their number is checked.

    Without the hint a table made from rows has no known size, and joining it on a class or a court
    would shuffle everything by that hot key.
    """
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"{len(rows)} rows are too many to broadcast")
    return F.broadcast(spark.createDataFrame(rows, schema))


def local_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """The same rows held by the driver and broadcast when they are few; otherwise ``df`` itself,
    joined the ordinary way."""
    rows = df.limit(max_rows + 1).collect()
    return small_table(df.sparkSession, rows, df.schema) if len(rows) <= max_rows else df


def exact_rank(df: DataFrame, by: list[str], order: list[str], out: str = "rank", total: str | None = None) -> DataFrame:
    """``row_number`` over (``by`` ordered by ``order``), spread over many tasks however large one group is.

    Rows are sorted by group and order in range partitions, which hold about the same number of rows whatever the groups' sizes, and stored
    with their running number. A row's rank is its distance from the first row of its group in its partition, plus the group's
    rows in earlier partitions: a running sum over one row per (group, partition). ``order`` has to be unique inside a group;
    rows alike in all of it are numbered in any order. ``total`` names a column for the group's number of rows.
    """
    at, part, first, n, before = _free_names([*df.columns, out, *[total] * bool(total)], "_at", "_part", "_first", "_n", "_before")
    keys = [F.col(c) for c in [*by, *order]]
    ordered = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ranked") \
        .withColumn(part, F.shiftright(at, 33))
    counts = ordered.groupBy(*by, part).agg(F.min(at).alias(first), F.count("*").alias(n))
    earlier = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    whole = [F.sum(F.col(n)).over(W.partitionBy(*by)).alias(total)] if total else []
    left, right = ordered.alias("l"), counts.select("*", *whole).alias("r")
    same = F.col(f"l.{part}") == F.col(f"r.{part}")
    for c in by:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return left.join(right, same).select(
        *[F.col(f"l.`{c}`") for c in df.columns], (F.col(f"l.{at}") - F.col(f"r.{first}") + F.col(f"r.{before}") + 1).alias(out),
        *[F.col(f"r.`{total}`")] * bool(total))


def _free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until none of ``columns`` has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def seeded_hash(key: Column, seed: int) -> Column:
    """The seeded order key, the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
