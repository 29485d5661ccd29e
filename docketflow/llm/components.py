"""Connected components of a link table by alternating star steps; every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketflow.session import materialise


#: Shares in which a node's edges are joined, so that no task has all edges of a hub.
SHARES = 32


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with ``m``, the smallest ``v`` of their ``u``, and ``u, m`` of every ``u``.

    Minima are found per share of a node's edges and joined with it by share: a hub's edges are met by as many small rows as it has shares.
    """
    dealt = edges.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(SHARES)).cast("int"))
    shares = dealt.groupBy("u", "share").agg(F.min("v").alias("m"))
    least = shares.groupBy("u").agg(F.min("m").alias("m"))
    return dealt.join(shares.select("u", "share").join(least, "u"), ["u", "share"]).drop("share"), least


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or its smaller) neighbours on the smallest node of its neighbourhood."""
    if large:
        both, _ = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        return both.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    hung, least = _with_least(edges)
    return hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node of ``links`` but those that are their component's smallest node.

    ``left`` and ``right`` are long and not null; order, repeats and self-links don't matter. Each round is stored in the
    shared folder. The number of rounds grows with the logarithm of the longest chain. An empty table gives an empty one.
    """
    edges = links.filter(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        edges = materialise(_step(_step(edges, True), False).distinct(), "stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
