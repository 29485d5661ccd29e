"""Index-page URLs for court x year, and the fixed court list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketflow import schemas
from docketflow import fixed_values as V
from docketflow.functions.html import index_url


def court_seeds(spark: SparkSession) -> DataFrame:
    rows = [(c, *V.COURT_YEARS.get(c, V.DEFAULT_YEARS)) for c in V.COURTS]
    return spark.createDataFrame(rows, schemas.COURT_SEED)


def seed_urls(courts: DataFrame, host: str = V.HOST) -> DataFrame:
    """One row per court and year in its range; every index page is listed once."""
    return courts.select("court", F.explode(F.sequence("year_min", "year_max")).alias("year")) \
        .withColumn("url", index_url(F.col("court"), F.col("year"), host))
