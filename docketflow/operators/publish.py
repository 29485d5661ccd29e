"""Labels, corrections, labelling sheets and the published table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketflow import fixed_values as V
from docketflow.operators.ranking import exact_rank, local_if_small
from docketflow.operators.sampling import flag_sample


def labelled(df: DataFrame, classification: str = "classification") -> DataFrame:
    return df.filter(F.col(classification) >= 0)


def unlabelled(df: DataFrame, classification: str = "classification") -> DataFrame:
    return df.filter(F.col(classification).isNull())


def narrow_label(classification: Column) -> Column:
    """The broad classes folded to 1 and not 1."""
    return F.when(classification == 1, 1).otherwise(0)


def corrections_table(spark, corrections: dict | None = None) -> DataFrame:
    return spark.createDataFrame(list((corrections or V.CORRECTIONS).items()), "link string, fixed int")


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str = "link", label: str = "label") -> DataFrame:
    """Replace the label of the listed keys. A short list is broadcast, so the rows stay where they are."""
    fixes = local_if_small(corrections.groupBy(key).agg(F.max("fixed").alias("_fixed")))
    return df.join(fixes, key, "left").withColumn(label, F.coalesce("_fixed", label)).drop("_fixed")


def mention_summary(df: DataFrame, found: Column) -> DataFrame:
    """Pages checked, pages that mention the keyword, and their share in percent."""
    counted = df.agg(F.count("*").alias("checked"), F.count_if(found).alias("mentions"))
    return counted.withColumn("percent", F.round(100 * F.col("mentions") / F.col("checked"), 2))


def labelling_sheet(mentions: DataFrame, order: list[str], n: int = V.FIRST_SAMPLE, seed: int = V.SEED) -> DataFrame:
    """Index, blank label columns, and a flag on the rows drawn for labelling."""
    numbered = exact_rank(mentions, [], order, "idx") \
        .withColumn("classification", F.lit(None).cast("int")).withColumn("explanation", F.lit(" "))
    return flag_sample(numbered, "idx", n, seed)


def extend_sample(sheet: DataFrame, n: int = V.SECOND_SAMPLE, seed: int = V.SEED) -> DataFrame:
    """The second round: labelled rows first sampled before, plus ``n`` newly drawn from the rest."""
    done = labelled(sheet).withColumn("og_sample", F.lit(1))
    rest = flag_sample(unlabelled(sheet).drop("sample"), "idx", n, seed).withColumn("og_sample", F.lit(0))
    return done.unionByName(rest, allowMissingColumns=True)


def class_match(prediction: Column, label: Column) -> Column:
    """1 where model and expert agree, 0 where they differ, null without a prediction."""
    return F.when(prediction.isNull(), F.lit(None)).when(prediction == label, 1).otherwise(0)


def publish(expert: DataFrame, predicted: DataFrame, corrections: DataFrame) -> DataFrame:
    """One table of all judgments: the expert's label where there is one, else the model's.

    ``expert(case_name, year, link, label)`` and ``predicted(case_name, year, link, prediction)``.
    """
    both = expert.select("case_name", "year", "link", F.col("label").alias("expert"), F.lit(None).cast("int").alias("ml")) \
        .unionByName(predicted.select("case_name", "year", "link", F.lit(None).cast("int").alias("expert"),
                                      F.col("prediction").alias("ml")))
    chosen = both.select("case_name", "year", "link", F.coalesce("expert", "ml").alias("classification"),
                         F.when(F.col("expert") >= 0, "expert").otherwise("ml").alias("expert_or_ml_classified"))
    return apply_corrections(chosen, corrections, "link", "classification").orderBy("year", "link")


def with_agreement(expert: DataFrame, predictions: DataFrame) -> DataFrame:
    """Expert rows with the test-set prediction, where there is one, and whether the two agree."""
    return expert.join(predictions.select("link", "prediction"), "link", "left") \
        .withColumn("class_match", class_match(F.col("prediction"), F.col("label")))
