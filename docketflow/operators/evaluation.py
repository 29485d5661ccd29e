"""Confusion counts and everything derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketflow import fixed_values as V


def _ratio(num: Column, den: Column) -> Column:
    """Zero where nothing was there to divide by."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def confusion_counts(df: DataFrame, by: list[str] | None = None, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """``tp, fp, fn, tn`` per group in one pass."""
    def n(p, y):
        return F.coalesce(F.sum(((F.col(prediction) == p) & (F.col(label) == y)).cast("bigint")), F.lit(0))
    return df.groupBy(*(by or [])).agg(
        n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows are predictions, columns are true classes, class 1 first."""
    return df.groupBy(F.col(prediction).alias("prediction")).pivot(label, [1, 0]).agg(F.count(F.lit(1))) \
        .na.fill(0).withColumnsRenamed({"1": "label_1", "0": "label_0"}).orderBy(F.desc("prediction"))


def scores(counts: DataFrame) -> DataFrame:
    """Per-class F1, macro-F1 and accuracy from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumn("f1_1", _f1(tp, fp, fn)).withColumn("f1_0", _f1(tn, fn, fp)) \
        .withColumn("macro_f1", (F.col("f1_1") + F.col("f1_0")) / 2) \
        .withColumn("accuracy", _ratio(tp + tn, tp + fp + fn + tn))


def classification_report(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support, one row per class."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def row(cls, hit, false_hit, miss):
        return F.struct(F.lit(cls).alias("class"), _ratio(hit, hit + false_hit).alias("precision"),
                        _ratio(hit, hit + miss).alias("recall"), _f1(hit, false_hit, miss).alias("f1"),
                        (hit + miss).alias("support"))

    rows = F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))
    return counts.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.*")


def macro_f1_of_correct(counts: DataFrame, zero_tp: float = 0.0, out: str = "macro_f1") -> DataFrame:
    """Macro-F1 from per-class correct counts ``c1`` of ``n1`` and ``c0`` of ``n0``.

    ``zero_tp`` is the class-1 score when no class-1 row is right; 1 is the other convention in use.
    """
    return counts.withColumn(out, macro_f1_columns(F.col("c1"), F.col("n1"), F.col("c0"), F.col("n0"), zero_tp))


def macro_f1_columns(c1: Column, n1: Column, c0: Column, n0: Column, zero_tp: float = 0.0) -> Column:
    one = F.when(c1 == 0, F.lit(float(zero_tp))).otherwise(2 * c1 / (2 * c1 + (n0 - c0) + (n1 - c1)))
    zero = F.when(c0 == 0, F.lit(0.0)).otherwise(2 * c0 / (2 * c0 + (n1 - c1) + (n0 - c0)))
    return (one + zero) / 2


def correct_counts(df: DataFrame, by: list[str], label: str = "label", correct: str = "correct") -> DataFrame:
    """Rows and right answers per class from 0/1 correctness."""
    def n(y, what):
        return F.coalesce(F.sum(F.when(F.col(label) == y, what)), F.lit(0)).cast("bigint")
    return df.groupBy(*by).agg(
        n(1, F.col(correct)).alias("c1"), n(1, F.lit(1)).alias("n1"),
        n(0, F.col(correct)).alias("c0"), n(0, F.lit(1)).alias("n0"))


def scoreboard(wide: DataFrame, models: list[str], label: str = "label") -> DataFrame:
    """Right answers and macro-F1 of every model held as a 0/1 correctness column."""
    long = wide.unpivot([label], models, "model", "correct")
    counted = macro_f1_of_correct(correct_counts(long, ["model"], label))
    return counted.select("model", (F.col("c1") + F.col("c0")).alias("correct"), "macro_f1")


def expand_counts(counts: DataFrame, by: list[str], chunk: int = 100_000) -> DataFrame:
    """Confusion counts back to rows ``(*by, label, correct, n)``, a large count in many pieces."""
    cells = F.array(*[
        F.struct(F.lit(y).alias("label"), F.lit(ok).alias("correct"), F.col(c).alias("size"))
        for c, y, ok in (("tp", 1, 1), ("fn", 1, 0), ("tn", 0, 1), ("fp", 0, 0))])
    cell = counts.select(*by, F.explode(cells).alias("x")).select(*by, "x.*").filter("size > 0")
    piece = cell.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / chunk))))
    spread = piece.repartition(*by, "label", "correct", "piece")
    inside = F.sequence(F.lit(1), F.least(F.lit(chunk), F.col("size") - F.col("piece") * chunk))
    return spread.select(*by, "label", "correct", "piece", F.explode(inside).alias("i")) \
        .select(*by, "label", "correct", (F.col("piece") * chunk + F.col("i")).alias("n"))


def published_counts(spark) -> DataFrame:
    return spark.createDataFrame([(m, *c) for m, c in V.PUBLISHED_COUNTS.items()],
                                 "model string, tp bigint, fp bigint, fn bigint, tn bigint")


def mean_of_folds(fold_scores: DataFrame, by: list[str], score: str = "macro_f1") -> DataFrame:
    return fold_scores.groupBy(*by).agg(F.avg(score).alias("mean_score"))


def best_setting(settings: DataFrame, score: str = "mean_score", order: str = "setting") -> DataFrame:
    """The highest score; the earliest setting wins a tie."""
    return settings.orderBy(F.desc(score), order).limit(1)


def threshold(score: Column, at: float = 0.5) -> Column:
    return (score > at).cast("int")
