"""Mixing sources to target weights: token weights raked to marginals, then documents sampled by calibrated probabilities.

Documents are first added up to one row per cell (source, language, topic). Iterative proportional fitting works on the cells:
each step scales them so that one marginal meets its target. A cell's calibrated share over its own share is the factor
by which its documents are to be weighted; scaled and cut off at 1 it is their sampling probability. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketflow.llm.names import refuse
from docketflow.session import materialise

#: Rounds over all marginals, and how many of them one stored table covers.
ROUNDS = 12
ROUNDS_STORED = 4
SEED = 9


def tempered(cells: DataFrame, by: str, power: float, weight: str = "weight") -> DataFrame:
    """``by, target``: each value's share of ``weight`` to a power below 1, which evens the values out."""
    sums = cells.groupBy(by).agg(F.sum(weight).alias("_w"))
    raised = F.when(F.col("_w") > 0, F.pow(F.col("_w").cast("double"), F.lit(power))).otherwise(0.0)
    return sums.select(by, raised.alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], weight: str = "weight", rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``factor``: calibrated share over own share, after ``rounds`` rounds over the marginals.

    ``cells`` has one row per combination of the marginals' columns, null being a value. A target table has a column of the
    same name and ``target``, any non-negative numbers; they are normalised over the values that have weight. A value
    without a target keeps nothing. Cells without weight get factor 1, and an empty table stays empty.
    """
    names = list(targets)
    total = Window.partitionBy(F.lit(0))
    fitted = cells
    for i, (name, target) in enumerate(targets.items()):
        having = cells.groupBy(name).agg(F.sum(weight).alias("_w")).filter("_w > 0").select(F.col(name).alias("_v"))
        wanted = target.select(F.col(name).alias("_t"), "target").join(having, F.col("_t").eqNullSafe(F.col("_v"))).select(
            "_v", F.try_divide("target", F.sum("target").over(total)).alias(f"_target{i}"))
        fitted = fitted.join(wanted, F.col(name).eqNullSafe(F.col("_v")), "left").drop("_v")
    fitted = fitted.withColumn("_own", F.coalesce(F.try_divide(F.col(weight).cast("double"), F.sum(weight).over(total)), F.lit(0.0))).withColumn("_share", F.col("_own"))
    for step in range(rounds):
        if step % ROUNDS_STORED == 0:
            fitted = materialise(fitted, "cells")
        for i, name in enumerate(names):
            have = F.sum("_share").over(Window.partitionBy(name))
            fitted = fitted.withColumn("_share", F.when(have > 0, F.col("_share") * F.coalesce(F.col(f"_target{i}"), F.lit(0.0)) / have).otherwise(0.0))
    fitted = materialise(fitted, "cells")
    return fitted.withColumn("factor", F.when(F.col("_own") > 0, F.col("_share") / F.col("_own")).otherwise(1.0)).select(*cells.columns, "factor")


def draw(key: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that the key and the seed decide."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / float(1 << 32)


def budgeted(cells: DataFrame, budget: float, weight: str = "weight") -> DataFrame:
    """``cells`` with ``probability``: ``min(1, c * factor)``, ``c`` such that ``budget`` of all weight is expected to be drawn.

    ``weight`` is an integer. A budget that the cells with a factor above 0 can't fill draws these cells whole.
    """
    total, upward = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("factor")
    # with all larger factors cut off, the others share what is left of the budget; the largest such scale is the one that fits
    left = F.lit(budget) * F.sum(weight).over(total) - (F.sum(weight).over(total) - F.sum(weight).over(upward))
    scaled = cells.withColumn("_scale", F.try_divide(left, F.sum(F.col(weight) * F.col("factor")).over(upward)))
    scale = F.coalesce(F.max("_scale").over(total), F.lit(1.0))
    return scaled.withColumn("probability", F.least(F.lit(1.0), scale * F.col("factor"))).drop("_scale")


def sample(docs: DataFrame, targets: dict[str, float], tokens: Column, key: str = "doc_id", seed: int = SEED, budget: float | None = None) -> DataFrame:
    """``docs`` with ``_tokens, _factor, _probability, _weight, _sampled``.

    ``targets`` maps marginal columns of ``docs`` to the power of ``tempered``. With ``budget``, a share of all tokens, the
    probabilities are those of ``budgeted``, however rare a value is. Without, the largest factor gets probability 1 and one
    rare value can leave little of the rest. ``_weight`` is factor over probability: weighted with it, the drawn documents
    meet the targets also where a probability is cut off. Rows with the same key share one draw; rows stay. Null is a value of
    its own in a marginal; a null or empty text has no tokens. ``docs`` may not have the new columns, nor ``_c0`` and so on.
    """
    refuse(docs.columns, "_tokens", "_factor", "_probability", "_weight", "_sampled", *[f"_c{i}" for i in range(len(targets))])
    counted = docs.withColumn("_tokens", tokens)
    cells = counted.groupBy(*targets).agg(F.sum("_tokens").alias("weight"))
    cells = materialise(cells, "cells")
    raked = rake(cells, {name: tempered(cells, name, power) for name, power in targets.items()})
    if budget is None:
        raked = raked.withColumn("probability", F.col("factor") / F.max("factor").over(Window.partitionBy(F.lit(0))))
    else:
        raked = budgeted(raked, budget)
    scaled = raked.select(*[F.col(n).alias(f"_c{i}") for i, n in enumerate(targets)], F.col("factor").alias("_factor"), F.col("probability").alias("_probability"),
                          F.try_divide("factor", "probability").alias("_weight"))
    scaled = materialise(scaled, "probabilities")
    same = [F.col(n).eqNullSafe(F.col(f"_c{i}")) for i, n in enumerate(targets)]
    joined = counted.join(scaled, on=same, how="inner").drop(*[f"_c{i}" for i in range(len(targets))])
    return joined.withColumn("_sampled", draw(key, seed) < F.col("_probability"))


def word_count(text: str = "text") -> Column:
    """Space-separated tokens of a text; a null or empty text has none."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.length(filled) == 0, 0).otherwise(F.length(filled) - F.length(F.replace(filled, F.lit(" "), F.lit(""))) + 1).cast("bigint")


#: Topic by the first mark that a text contains; texts without one are prose.
TOPICS = [("licence", "icense"), ("table", " | "), ("contact", "@"), ("list", "\n- "), ("numbers", "0")]


def topic(text: str = "text") -> Column:
    out = F.lit("prose")
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(mark)), F.lit(name)).otherwise(out)
    return out
