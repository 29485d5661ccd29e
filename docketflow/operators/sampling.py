"""Seeded exact samples, stratified split and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docketflow import fixed_values as V
from docketflow.operators.ranking import exact_rank, local_if_small, seeded_hash
from docketflow.session import materialise


def draw(df: DataFrame, key: str, n: int, seed: int = V.SEED) -> DataFrame:
    """Keys of exactly ``n`` rows (all rows when there are fewer). Each task keeps ``n`` at most."""
    return df.select(key, seeded_hash(F.col(key), seed).alias("_h")).orderBy("_h", key).limit(n).select(key)


def flag_sample(df: DataFrame, key: str, n: int, seed: int = V.SEED, out: str = "sample") -> DataFrame:
    """1 for the drawn rows, 0 for the others. The drawn keys are ``n`` rows, so they may be broadcast."""
    drawn = draw(df, key, n, seed).distinct().withColumn("_drawn", F.lit(1))
    side = F.broadcast(drawn) if n <= 100_000 else drawn
    return df.join(side, key, "left").withColumn(out, F.coalesce("_drawn", F.lit(0))).drop("_drawn")


def stratified_split(df: DataFrame, key: str = "link", label: str = "label", test_share: float = V.TEST_SHARE,
                     seed: int = V.SEED, out: str = "split") -> DataFrame:
    """``train``/``test`` with exactly ``round(test_share * n)`` test rows in every class.

    The order is a hash of the key. Keys and hashes are ranked per class to find the hash at which its test set ends;
    ``df`` itself is passed once, unshuffled. ``key`` has to be unique.
    """
    slim = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), seeded_hash(F.col(key), seed).alias("_h"))
    ranked = exact_rank(slim, ["_label"], ["_h", "_key"], "_rank", total="_rows")
    last = ranked.filter(F.col("_rank") == F.floor(F.lit(test_share) * F.col("_rows") + 0.5))
    cuts = local_if_small(last.select("_label", F.col("_h").alias("_cut_h"), F.col("_key").alias("_cut_key")))
    marked = df.withColumn("_h", seeded_hash(F.col(key), seed))
    before = (F.col("_h") < F.col("_cut_h")) | ((F.col("_h") == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_key")))
    return marked.join(cuts, marked[label].eqNullSafe(cuts["_label"]), "left") \
        .withColumn(out, F.when(before, "test").otherwise("train")).drop("_h", "_label", "_cut_h", "_cut_key")


def stratified_folds(df: DataFrame, key: str = "link", label: str = "label", folds: int = V.FOLDS, out: str = "fold") -> DataFrame:
    """Unshuffled stratified folds: contiguous blocks of each class in key order.

    Classes are laid end to end in order of first appearance and dealt to the folds in turn, which
    gives each (class, fold) its size; a class's rows then fill the folds in order. Only keys are
    ranked, to find where each fold ends; ``df`` itself is passed once, unshuffled.
    """
    slim = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"))
    ranked = materialise(exact_rank(slim, ["_label"], ["_key"], "_rank", total="_rows"), "folds")
    # one row per class from here on
    classes = ranked.filter("_rank = 1").withColumn("_start", F.sum("_rows").over(W.orderBy("_key")) - F.col("_rows"))
    dealt = classes.select("_label", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(folds - 1)), lambda j: _dealt(F.col("_start"), F.col("_rows"), j, folds))).alias("_fold", "_size"))
    ends = dealt.select("_label", "_fold", F.sum("_size").over(W.partitionBy("_label").orderBy("_fold")).alias("_upto")).filter(F.col("_fold") < folds - 1).alias("e")
    last = ends.join(ranked.alias("r"), F.col("e._label").eqNullSafe(F.col("r._label")) & (F.col("_upto") == F.col("_rank")), "left")
    fold_ends = F.transform(F.array_sort(F.collect_list(F.struct("_fold", "_key"))), lambda e: e["_key"])
    table = local_if_small(last.select("e._label", "_fold", "_key").groupBy("_label").agg(fold_ends.alias("_ends")))
    # a fold without an end has no row before it
    passed = F.aggregate("_ends", F.lit(0), lambda n, e: n + F.when(e.isNull() | (F.col(key) > e), 1).otherwise(0))
    return df.join(table, df[label].eqNullSafe(table["_label"])).withColumn(out, passed).drop("_label", "_ends")


def _dealt(start, size, fold, folds: int):
    """How many of ``size`` places from ``start`` on fall to ``fold`` when places are dealt in turn."""
    return F.floor((start + size - 1 - fold) / folds) - F.floor((start - 1 - fold) / folds)
