"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, token ids; each stage works on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketflow.llm import byte_bpe, odd_sketch, outliers, queries, raking, secret_scan
from docketflow.session import scratch_path

#: Five-word shingles shared by at least this percentage make two documents one; op7's own contract is 85.
SIMILARITY_PERCENT = 80
#: Share of the tokens that reach the mixing stage which it is expected to draw.
TOKEN_BUDGET = 0.5


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with all further columns under names that no operator uses, and under their own names again in its result."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"further_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        out = stage(spark, docs.toDF(*[names.get(c, c) for c in docs.columns]), sf_dir)
        own = {v: c for c, v in names.items()}
        return out.toDF(*[own.get(c, c) for c in out.columns])
    return run_stage


@apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and are no outliers of their language and source; a null text has no words and goes."""
    estimates, used = outliers.estimates_of(docs)
    return outliers.quality(docs, estimates, used).filter("kept").select(docs.columns)


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; without an id each stays.

    Rows with the same id are one document; of several different ones the row with the smallest hash of all its columns stays.
    """
    kept = odd_sketch.near_duplicates(docs.select("doc_id", "text"), percent=SIMILARITY_PERCENT).filter("kept").select("doc_id").distinct()
    marked = docs.filter(F.col("doc_id").isNotNull()).withColumn("_hash", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns]))
    # all by doc_id, so texts are shuffled once
    first = marked.groupBy("doc_id").agg(F.min("_hash").alias("_least")).join(kept, "doc_id", "left_semi")
    once = marked.join(first, "doc_id").filter("_hash = _least").drop("_hash", "_least").dropDuplicates(["doc_id"])
    return once.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


@apart
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the spans of secrets in their texts replaced by a mark; ``n_chars`` follows the text. Null and empty texts stay."""
    clean = secret_scan.scan(docs, redact=True, secrets="_secrets").withColumn(
        "n_chars", F.when(F.size("_secrets") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


@apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their raked factors, about ``TOKEN_BUDGET`` of the tokens; those of rare values are all kept, none twice."""
    drawn = raking.sample(docs.withColumn("topic", raking.topic()), queries.POWERS, raking.word_count(), budget=TOKEN_BUDGET)
    return drawn.filter("_sampled").select(docs.columns)


@apart
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' ids, checked by decoding: ``doc_id, lang, source, n_tokens, ids, round_trip``; null and empty texts have none."""
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.ranks_file(), queries.pattern(), same="round_trip")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secret_scans", secrets), ("mixing", mixing), ("byte_bpe", token_ids)]

#: No SQL: estimates by concentration steps, MinHash and token ids can't be expressed in it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
