"""Paired permutation test on macro-F1, all model pairs in one job."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docketflow import fixed_values as V
from docketflow.operators.evaluation import macro_f1_columns

# One md5 gives this many coins: 15 hex digits fit a positive bigint.
COINS = 60


def coins(seed: int, pair: Column, block: Column, row: Column) -> Column:
    """Sixty coins of one row for one block of permutations, as the bits of a bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), pair, block.cast("string"), row.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def permutation_test(wide: DataFrame, pairs: list[tuple[str, str]], row: str = "row_id", label: str = "label",
                     permutations: int = V.PERMUTATIONS, seed: int = V.SEED, ties: str = "count",
                     zero_tp: float = 0.0, level: float = V.SIGNIFICANCE) -> DataFrame:
    """One-sided test that ``better`` beats ``worse`` for each ``(worse, better)`` pair.

    ``wide`` has a 0/1 correctness column per model. A permutation swaps the two answers of a row by
    a coin. Rows answered alike do not change under a swap, so they are only counted; each other row
    gives 60 permutations per hash, and the coins are summed before the shuffle, so what moves is a
    few numbers per task. ``ties='strict'`` counts only statistics above the observed one.
    """
    cells = F.array(*[
        F.struct(F.lit(f"{w}|{b}").alias("pair"), F.col(w).alias("w"), F.col(b).alias("b")) for w, b in pairs])
    rows = wide.select(F.col(row).alias("row"), F.col(label).alias("label"), F.explode(cells).alias("x")) \
        .select("row", "label", "x.*")
    base = rows.groupBy("pair").agg(*_base_counts())
    blocks = -(-permutations // COINS)
    tossed = rows.filter("w <> b").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .withColumn("h", coins(seed, F.col("pair"), F.col("block"), F.col("row")))
    # swapping a row moves one right answer from the better model to the worse, or back
    heads = tossed.withColumn("move", F.col("b") - F.col("w")).groupBy("pair", "block", "label", "move").agg(
        *[F.expr(f"sum(shiftright(h, {j}) & 1) AS c{j}") for j in range(COINS)])
    moved = heads.select("pair", "block", "label", "move", F.posexplode(F.array(*[f"c{j}" for j in range(COINS)]))
                         .alias("j", "heads")) \
        .groupBy("pair", (F.col("block") * COINS + F.col("j")).alias("perm")).agg(
            F.sum(F.col("label") * F.col("move") * F.col("heads")).alias("m1"),
            F.sum((1 - F.col("label")) * F.col("move") * F.col("heads")).alias("m0")) \
        .filter(F.col("perm") < permutations)
    stat = _difference(F.col("m1"), F.col("m0"), zero_tp)
    above = (F.col("stat") > F.col("observed")) if ties == "strict" else (F.col("stat") >= F.col("observed"))
    hits = moved.join(base, "pair").withColumn("stat", stat).withColumn("observed", _difference(F.lit(0), F.lit(0), zero_tp)) \
        .groupBy("pair").agg(F.sum(above.cast("bigint")).alias("hits"))
    # a pair whose models agree on every row has no coins: every statistic equals the observed one
    all_tied = 0 if ties == "strict" else permutations
    counted = F.coalesce("hits", F.lit(all_tied))
    p = counted / permutations if ties == "strict" else (1 + counted) / (permutations + 1)
    return base.withColumn("observed", _difference(F.lit(0), F.lit(0), zero_tp)).join(hits, "pair", "left") \
        .withColumn("p_value", p).withColumn("significant", F.col("p_value") < level) \
        .select(F.split("pair", r"\|")[0].alias("worse"), F.split("pair", r"\|")[1].alias("better"),
                "observed", "p_value", "significant")


def exact_test(wide: DataFrame, pairs: list[tuple[str, str]], label: str = "label", ties: str = "count", level: float = V.SIGNIFICANCE) -> DataFrame:
    """The p-value that infinitely many permutations would give, for each ``(worse, better)`` pair; same columns as the test.

    Rows with the same label and the same move are alike under the coins, so all that counts is how many of them swap: the statistic
    depends on two binomial numbers, one per label. One row of counts per pair comes to the driver, however many rows there are.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(w).alias("w"), F.col(b).alias("b")) for i, (w, b) in enumerate(pairs)])
    rows = wide.select(F.col(label).alias("label"), F.explode(cells).alias("x")).select("label", "x.*")
    swings = [F.sum(F.when((F.col("label") == side) & (F.col("b") - F.col("w") == move), 1).otherwise(0)).alias(f"{name}{side}")
              for name, move in (("gains", 1), ("losses", -1)) for side in (1, 0)]
    counted = {r["pair"]: r.asDict() for r in rows.groupBy("pair").agg(*_base_counts(), *swings).collect()}
    found = [(*pairs[i], *_exact(c, ties)) for i, c in sorted(counted.items())]
    return wide.sparkSession.createDataFrame(found, "worse string, better string, observed double, p_value double") \
        .withColumn("significant", F.col("p_value") < level)


# Statistics closer than this are one value: they differ by rounding only.
SAME = 1e-12
# Coins further from half than this many standard deviations have a chance below 1e-80.
DEVIATIONS = 20


def _swaps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of heads among ``n`` coins, and their chances."""
    reach = DEVIATIONS * math.sqrt(n) / 2 + 1
    heads = np.arange(max(0, math.floor(n / 2 - reach)), min(n, math.ceil(n / 2 + reach)) + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in heads.tolist()]) - n * math.log(2)
    return heads, np.exp(log)


def _exact(c: dict, ties: str) -> tuple[float, float]:
    """Observed difference and its exact p-value from a pair's counts."""
    def f1(right1, right0):
        one, zero = right1 + c["n1"] + c["n0"] - right0, right0 + c["n0"] + c["n1"] - right1
        return right1 / np.where(one > 0, one, 1) + right0 / np.where(zero > 0, zero, 1)

    def difference(m1, m0):
        return f1(c["b1"] - m1, c["b0"] - m0) - f1(c["w1"] + m1, c["w0"] + m0)

    observed = float(difference(np.zeros(1), np.zeros(1))[0])
    least = observed + SAME if ties == "strict" else observed - SAME
    (heads1, chance1), (heads0, chance0) = _swaps(c["gains1"] + c["losses1"]), _swaps(c["gains0"] + c["losses0"])
    # the difference falls as either number rises: for each first number, how many second ones keep it high enough
    low, high = np.zeros(len(heads1), int), np.full(len(heads1), len(heads0))
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(heads0) - 1)
        enough = difference(heads1 - c["losses1"], heads0[middle] - c["losses0"]) >= least
        low, high = np.where(enough & (low < high), middle + 1, low), np.where(enough, high, middle)
    return observed, float(chance1 @ np.concatenate([[0], np.cumsum(chance0)])[low])


def _base_counts() -> list[Column]:
    def n(name, cond):
        return F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    one, zero = F.col("label") == 1, F.col("label") == 0
    return [n("n1", one), n("n0", zero), n("b1", one & (F.col("b") == 1)), n("b0", zero & (F.col("b") == 1)),
            n("w1", one & (F.col("w") == 1)), n("w0", zero & (F.col("w") == 1))]


def _difference(m1: Column, m0: Column, zero_tp: float) -> Column:
    n1, n0 = F.col("n1"), F.col("n0")
    better = macro_f1_columns(F.col("b1") - m1, n1, F.col("b0") - m0, n0, zero_tp)
    worse = macro_f1_columns(F.col("w1") + m1, n1, F.col("w0") + m0, n0, zero_tp)
    return better - worse
