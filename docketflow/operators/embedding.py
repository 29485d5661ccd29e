"""Chunking, padding, encoding and mean pooling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docketflow import fixed_values as V
from docketflow.functions.text import blank_separated, let, sentences_to_encode
from docketflow.operators.ranking import exact_rank

Encoder = Callable[[DataFrame], DataFrame]


def mean_pool(df: DataFrame, key: str, vector: str = "vector", out: str = "embedding") -> DataFrame:
    """Mean vector per key; sums are combined before the shuffle, so a key may hold any number of rows."""
    return df.groupBy(key).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias(out))


def hashing_encoder(hex_digits: int = 2) -> Encoder:
    """The built-in sentence encoder: word counts in ``16 ** hex_digits`` hash buckets, of unit length.

    Adds ``vector`` from ``sentence``, all inside the JVM.
    """
    buckets = [f"{i:0{hex_digits}x}" for i in range(16 ** hex_digits)]

    def encode(df: DataFrame) -> DataFrame:
        words = blank_separated(F.lower("sentence"))
        hashed = df.withColumn("_buckets", F.transform(words, lambda w: F.substring(F.md5(w), 1, hex_digits)))
        counted = CountVectorizerModel.from_vocabulary(buckets, inputCol="_buckets", outputCol="_tf").transform(hashed)
        scaled = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
        return scaled.withColumn("vector", vector_to_array("_unit")).drop("_buckets", "_tf", "_unit")
    return encode


def batch_encoder(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 64) -> Encoder:
    """A sentence encoder from a model that lives on the workers.

    ``load`` is called once per worker task and returns a function from an array of sentences to an array of as many vectors. Sentences are
    sorted by length within their partition first, so those of one batch need little padding.
    """
    encoded = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch_size)

    def encode(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(F.length("sentence")).withColumn("vector", encoded("sentence"))
    return encode


def embed_documents(df: DataFrame, key: str, text: str, encode: Encoder, min_words: int = V.SKIP_WORDS,
                    max_chars: int | None = None, cap: int | None = None,
                    seed: int = V.SEED) -> DataFrame:
    """Sentence vectors averaged per document; a document with no sentence left gets a null embedding.

    ``encode`` takes rows with ``sentence`` and adds ``vector``; a pretrained encoder comes in as
    ``lambda d: d.withColumn("vector", some_pandas_udf("sentence"))``.
    """
    kept = sentences_to_encode(F.col(text), F.col(key), min_words, max_chars, cap, seed)
    pooled = mean_pool(encode(df.select(key, F.explode(kept).alias("sentence"))), key)
    return df.select(key).join(pooled, key, "left")


def chunk_tokens(ids: Column, max_len: int = V.MAX_CHUNK_TOKENS, first_only: bool = False) -> Column:
    """Token ids cut into chunks, each with the start and end markers put back and an attention mask.

    ``first_only`` keeps the first chunk alone, as the published long-document encoder does.
    """
    def cut(t):
        length = F.size(t) - 2
        starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(max_len))) \
            .otherwise(F.array().cast("array<int>"))
        if first_only:
            starts = F.slice(starts, 1, 1)
        return F.transform(starts, lambda s, k: let(
            F.concat(F.array(t[0]), F.slice(t, s + 2, F.least(F.lit(max_len), length - s)),
                     F.array(F.element_at(t, -1))),
            lambda c: F.struct(k.alias("chunk"), c.alias("input_ids"),
                               F.transform(c, lambda _: F.lit(1)).alias("attention_mask"))))

    return let(ids, cut)


def pad_batches(df: DataFrame, order: list[str], batch: int = V.ENCODER_BATCH, pad_id: int = V.PAD_TOKEN,
                pad_mask: int = V.PAD_ATTENTION) -> DataFrame:
    """Batches of ``batch`` rows in the given order, padded to the longest row of each batch."""
    numbered = exact_rank(df, [], order, "_n").withColumn(
        "batch", F.floor((F.col("_n") - 1) / batch)).drop("_n")
    longest = numbered.withColumn("_max", F.max(F.size("input_ids")).over(W.partitionBy("batch")))
    gap = F.col("_max") - F.size("input_ids")
    return longest.withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(pad_mask), gap))) \
        .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), gap))).drop("_max")


def embed_chunks(df: DataFrame, key: str, ids: str, encode: Encoder, max_len: int = V.MAX_CHUNK_TOKENS,
                 first_only: bool = False) -> DataFrame:
    """Chunk vectors averaged per document; one without chunks has a null embedding.

    ``encode`` adds ``vector`` to ``input_ids, attention_mask``.
    """
    chunks = df.select(key, F.explode(chunk_tokens(F.col(ids), max_len, first_only)).alias("c")).select(key, "c.*")
    return df.select(key).join(mean_pool(encode(chunks), key), key, "left")
