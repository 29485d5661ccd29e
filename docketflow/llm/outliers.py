"""Quality rules: statistics of whole texts, base limits, and robust outliers by minimum covariance determinant.

Per language and source the mean and covariance of the most concentrated three quarters of the rows are estimated by
concentration steps; rows far from it in Mahalanobis distance are rejected. A step is one aggregation: rows are counted and
their moments summed by group and distance bin, combined before the shuffle, so a group of any size is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docketflow.llm import batches
from docketflow.llm.names import refuse
from docketflow.session import materialise

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Transformed statistics and the spread that is taken for natural in each: the least standard deviation of an estimate.
FEATURES = {"_length": 0.08, "_symbols": 0.02, "_lines": 0.3, "_repeats": 0.06}
#: Words of a typical text that are added to each before ratios are taken, so that short texts don't stand out by chance.
PRIOR_WORDS = 300
TYPICAL_WORD = 5.0
#: Share of rows in the concentrated subset, rows that a group's own estimate needs, and the chance at which rows go.
SUBSET = 0.75
MIN_GROUP = 200
ALPHA = 1e-7
STEPS = 12


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five statistics of each text; see ``measure``."""
    n = len(texts)
    codes, starts, distinct = batches.words(texts)
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(n), sizes)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[starts[1:]] - sums[starts[:-1]]

    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    covered = np.zeros(len(codes) + 2, dtype=bool)
    if len(codes) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        a, b, c, d = codes[at], codes[at + 1], codes[at + 2], doc[at]
        odd = np.uint64(0x9E3779B97F4A7C15)
        key = (((d.astype(np.uint64) * odd + a.astype(np.uint64)) * odd + b.astype(np.uint64)) * odd + c.astype(np.uint64)) * odd
        key ^= key >> np.uint64(29)
        order = np.argsort(key)

        def same(order: np.ndarray) -> np.ndarray:
            x, y = order[1:], order[:-1]
            return (d[x] == d[y]) & (a[x] == a[y]) & (b[x] == b[y]) & (c[x] == c[y])

        equal = same(order)
        if (equal != (key[order[1:]] == key[order[:-1]])).any():  # two windows share a hash: sort by the windows themselves
            order = np.lexsort((c, b, a, d))
            equal = same(order)
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for k in range(3):
            covered[at[twice] + k] = True

    lines, begins = batches.flat_list(pc.split_pattern(texts, "\n"))
    coded = lines.dictionary_encode()
    filled = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0d]").to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_doc = np.repeat(np.arange(n), np.diff(begins))
    counts = filled[code] if len(code) else np.zeros(0, bool)
    first = np.unique(line_doc[counts] * max(1, len(filled)) + code[counts])
    doubles = np.bincount(line_doc[counts], minlength=n) - np.bincount(first // max(1, len(filled)), minlength=n)
    return {"n_words": sizes, "word_chars": per_text(chars[codes]) if len(codes) else sizes, "n_dup_lines": doubles,
            "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
            "n_repeat_words": per_text(covered[: len(codes)])}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``base_failed``.

    Words are runs of other than ASCII white space; ``n_repeat_words`` are words inside three-word windows that occur twice
    or more in the text. A null text counts as empty: zeros, and ``base_failed``. The new names must be free.
    """
    taken = set(STATISTICS + ["base_failed"]) & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"the input already has {sorted(taken)}")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.bounded(rows, text):
            found = statistics_of(pc.fill_null(batch.column(text), ""))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[s], pa.int64()) for s in STATISTICS]], [*batch.schema.names, *STATISTICS])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(s, T.LongType()) for s in STATISTICS]])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return docs.mapInArrow(run, schema).withColumn("base_failed", failed)


def transformed() -> dict[str, Column]:
    """The statistic vector: shrunken mean word length, symbols per word, repeated lines and repeated words."""
    words = F.col("n_words") + F.lit(float(PRIOR_WORDS))
    return {"_length": (F.col("word_chars") + PRIOR_WORDS * TYPICAL_WORD) / words, "_symbols": F.log1p(F.col("n_symbols") / words),
            "_lines": F.log1p(F.col("n_dup_lines").cast("double") / F.sqrt(1 + F.col("n_words") / F.lit(float(PRIOR_WORDS)))),
            "_repeats": F.col("n_repeat_words") / words}


def chi_square_cdf(x: float, freedom: int) -> float:
    """By the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = freedom / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < p else (low, middle)
    return (low + high) / 2


def consistency(share: float, freedom: int) -> float:
    """By which the covariance of the nearest ``share`` of normal rows is too small."""
    return share / chi_square_cdf(chi_square_quantile(share, freedom), freedom + 2)


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from ``mean`` and ``inverse`` (row by row) columns."""
    p = len(names)
    dev = [F.col(f) - F.col("mean")[i] for i, f in enumerate(names)]
    terms = [(1.0 if i == j else 2.0) * F.col("inverse")[i * p + j] * dev[i] * dev[j] for i in range(p) for j in range(i, p)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


ESTIMATE = "_group string, start int, n bigint, mean array<double>, inverse array<double>, log_det double"


def _solved(sums: DataFrame, names: list[str], floors: list[float], factor: float) -> DataFrame:
    """New estimates from each row's ``n``, ``mean`` so far and moments of deviations from it."""
    p = len(names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            n = column("n")
            first = np.stack([column(f"s{i}") for i in range(p)], axis=1) / n[:, None]
            cov = np.empty((len(n), p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[:, i, j] = cov[:, j, i] = column(f"s{i}_{j}") / n - first[:, i] * first[:, j]
            cov = cov * factor + np.diag(np.square(floors))
            mean = np.stack(batch.column("mean").to_pylist()) + first
            yield pa.RecordBatch.from_arrays([
                batch.column("_group"), batch.column("start"), batch.column("n"), pa.array(list(mean), pa.list_(pa.float64())),
                pa.array(list(np.linalg.inv(cov).reshape(len(n), -1)), pa.list_(pa.float64())), pa.array(np.linalg.slogdet(cov)[1])],
                ["_group", "start", "n", "mean", "inverse", "log_det"])

    return sums.mapInArrow(run, ESTIMATE)


def _moments(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    dev = [F.col(f) - F.col("mean")[i] for i, f in enumerate(names)]
    p = len(names)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("mean").alias("mean"), *[F.sum(dev[i]).alias(f"s{i}") for i in range(p)],
        *[F.sum(dev[i] * dev[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)])


def fit(rows: DataFrame, groups: list[str], features: dict[str, float], subset: float = SUBSET, min_group: int = MIN_GROUP,
        steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Estimates per group, and which estimate each group's rows use.

    ``rows`` has the group columns (null is a group of its own) and the feature columns, without nulls; it is read several
    times, so it should be a stored table. Groups of fewer than ``min_group`` rows share one estimate per first group column,
    and what is still smaller shares one for all; below that nothing is estimated. ``features`` gives each feature's
    least standard deviation. Two starts, by the spread of each feature and by spatial signs, take concentration steps
    until no determinant changes; the smaller determinant wins and is reweighted once.
    """
    names, floors = list(features), list(features.values())
    p = len(names)
    fine, coarse = F.to_json(F.struct(*groups)), F.to_json(F.struct(F.lit("*").alias("_"), groups[0]))
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n")).withColumn("_fine", fine).withColumn("_coarse", coarse)
    small = F.when(F.col("n") < min_group, F.col("n")).otherwise(0)
    pooled = F.sum(small).over(Window.partitionBy("_coarse"))
    group = F.when(F.col("n") >= min_group, F.col("_fine")).when(pooled >= min_group, F.col("_coarse")).otherwise(F.lit("*"))
    used = materialise(sizes.select(F.col("_fine").alias("_own"), group.alias("_group")), "mcd-groups")
    named = rows.withColumn("_own", fine).join(used, "_own").select("_group", *names)

    centre = named.groupBy("_group").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 2000).alias(f"m{i}") for i, f in enumerate(names)])
    centre = materialise(centre.filter(F.col("n") >= min_group), "mcd-centre")
    off = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(names)]
    spread = named.join(centre, "_group").groupBy("_group").agg(*[F.percentile_approx(F.abs(off[i]), 0.5, 2000).alias(f"d{i}") for i in range(p)])
    scale = [F.greatest(1.4826 * F.col(f"d{i}"), F.lit(floors[i])) for i in range(p)]
    scaled = centre.join(spread, "_group").select("_group", F.array(*[F.col(f"m{i}").cast("double") for i in range(p)]).alias("mean"),
                                                  F.array(*[s.cast("double") for s in scale]).alias("scale"))
    scaled = materialise(scaled, "mcd-scales")

    # start 0: each feature by its own spread; start 1: covariance of the directions from the centre
    diagonal = [(1 / F.col("scale")[i] ** 2 if i == j else F.lit(0.0)) for i in range(p) for j in range(p)]
    start0 = scaled.select("_group", F.lit(0).alias("start"), F.lit(0).cast("bigint").alias("n"), "mean", F.array(*diagonal).alias("inverse"),
                           F.lit(0.0).alias("log_det"))
    unit = [(F.col(f) - F.col("mean")[i]) / F.col("scale")[i] for i, f in enumerate(names)]
    length = F.sqrt(sum((u * u for u in unit[1:]), unit[0] * unit[0]) + 1e-12)
    signs = named.join(scaled, "_group").select("_group", "mean", "scale", *[(u / length * math.sqrt(p)).alias(f"u{i}") for i, u in enumerate(unit)])
    sums = signs.groupBy("_group").agg(
        F.lit(1).alias("start"), F.count("*").alias("n"), F.first("mean").alias("mean"), *[F.lit(0.0).alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col(f"u{i}") * F.col(f"u{j}") * F.col("scale")[i] * F.col("scale")[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)])
    estimates = materialise(start0.unionByName(_solved(sums, names, floors, 1.0)), "mcd-start")

    factor, before = consistency(subset, p), None
    for _ in range(steps):
        near = named.join(estimates.drop("n"), "_group").withColumn("_bin", F.floor(F.log(_distance(names) + 1e-6) * 16).cast("int"))
        bins = _moments(near, names, ["_group", "start", "_bin"])
        whole = Window.partitionBy("_group", "start")
        reached = F.sum("n").over(whole.orderBy("_bin")) - F.col("n")
        inside = bins.withColumn("_before", reached).withColumn("_all", F.sum("n").over(whole)).filter(F.col("_before") < subset * F.col("_all"))
        sums = inside.groupBy("_group", "start").agg(
            F.sum("n").alias("n"), F.first("mean").alias("mean"), *[F.sum(c).alias(c) for c in bins.columns if c.startswith("s") and c != "start"])
        estimates = materialise(_solved(sums, names, floors, factor), "mcd-step")
        now = estimates.agg(F.sum("log_det").alias("d"), F.count("*").alias("k")).first()
        if before is not None and abs((now.d or 0.0) - before) <= 1e-9 * max(1, now.k):
            break
        before = now.d or 0.0

    best = estimates.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy("log_det", "start"))).filter("_rank = 1").drop("_rank", "n")
    weighted = named.join(best, "_group").filter(_distance(names) <= chi_square_quantile(0.975, p))
    return materialise(_solved(_moments(weighted, names, ["_group", "start"]), names, floors, consistency(0.975, p)), "mcd-final"), used


def judge(rows: DataFrame, estimates: DataFrame, used: DataFrame, groups: list[str], features: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """``rows`` with ``distance`` (squared Mahalanobis; null without an estimate) and ``outlier``; an error if ``rows`` has these or ``mean, inverse, _own``."""
    refuse(rows.columns, "distance", "outlier", "mean", "inverse", "_own", "kept")
    names = list(features)
    own = used.join(estimates.select("_group", "mean", "inverse"), "_group").drop("_group")
    found = rows.withColumn("_own", F.to_json(F.struct(*groups))).join(own, "_own", "left").withColumn("distance", _distance(names))
    found = found.withColumn("distance", F.when(F.col("mean").isNotNull(), F.col("distance")))
    far = F.coalesce(F.col("distance") > chi_square_quantile(1 - alpha, len(names)), F.lit(False))
    return found.withColumn("outlier", far).drop("_own", "mean", "inverse")


def _features_of(rows: DataFrame) -> DataFrame:
    refuse(rows.columns, *transformed())
    return rows.withColumns({k: c.cast("double") for k, c in transformed().items()})


def estimates_from(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> tuple[DataFrame, DataFrame]:
    """Fit on the rows of ``measured``, which has the columns of ``measure``, that pass the base limits."""
    statistics = _features_of(measured.filter(~F.col("base_failed")))
    return fit(materialise(statistics.select(*groups, *FEATURES), "quality"), list(groups), FEATURES)


def estimates_of(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> tuple[DataFrame, DataFrame]:
    """Fit on the statistics of all rows of ``docs`` that pass the base limits."""
    return estimates_from(measure(docs.select(*groups, text), text), groups)


def verdicts(measured: DataFrame, estimates: DataFrame, used: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``measured``, which has the columns of ``measure``, with ``distance`` and ``kept``; every row stays, repeated ones too."""
    found = judge(_features_of(measured), estimates, used, list(groups), FEATURES)
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier")).drop("outlier", *FEATURES)


def quality(docs: DataFrame, estimates: DataFrame, used: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``distance`` and ``kept``; every row stays, repeated ones too."""
    return verdicts(measure(docs, text), estimates, used, groups)
