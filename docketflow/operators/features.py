"""Term statistics, vocabularies and TF-IDF."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from docketflow.functions.text import feature_words, let, ngrams, term_runs
from docketflow.operators.vocabulary import known
from docketflow.session import materialise

# A vocabulary lives on the driver and in every task, so its size is a checked parameter.
MAX_VOCABULARY = 1_000_000
# Terms that a task counts at once, unless a single document has more.
COUNTED_TERMS = 1 << 18


def analyse(text: Column, ngram: int = 1, words: Column | None = None) -> Column:
    """The terms of a document: default words, or the caller's token list, as n-grams up to ``ngram``."""
    return ngrams(feature_words(text) if words is None else words, ngram)


def term_frequencies(df: DataFrame, key: str, terms: str) -> DataFrame:
    """``(key, term, tf)``; counted inside each row, so nothing is shuffled."""
    return df.select(key, F.explode(term_runs(F.col(terms))).alias("r")).select(key, "r.term", "r.tf")


def counted_terms(df: DataFrame, terms: str, group: str | None = None) -> DataFrame:
    """``term, group, cf, df`` over some documents each, so that sums by term give the statistics; ``group`` is an integer column.

    A task counts the terms of many documents together: what is shuffled then has each of them once, not once per document.
    """
    def run(batches):
        for batch in batches:
            lists, groups = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.concatenate([[0], np.cumsum(sizes)]), 0
            while start < len(lists):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + COUNTED_TERMS, side="right")) - 1)
                coded = lists.slice(start, stop - start).flatten().dictionary_encode(null_encoding="encode")
                member = groups.slice(start, stop - start).dictionary_encode(null_encoding="encode")
                n = len(coded.dictionary)
                if n:
                    # sorted by document and term, so every run is a term of a document
                    keys = np.repeat(np.arange(stop - start), sizes[start:stop]) * n + coded.indices.to_numpy()
                    keys.sort()
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    tf, (row, term) = np.diff(np.append(first, len(keys))), np.divmod(keys[first], n)
                    cell = member.indices.to_numpy()[row] * np.int64(n) + term
                    df_, cf = np.bincount(cell), np.bincount(cell, tf)
                    at = np.flatnonzero(df_)
                    yield pa.RecordBatch.from_arrays(
                        [coded.dictionary.take(pa.array(at % n)), member.dictionary.take(pa.array(at // n)),
                         pa.array(cf[at].astype(np.int64)), pa.array(df_[at])], names=["term", "group", "cf", "df"])
                start = stop
        # workers live on and serve other stages
        pa.default_memory_pool().release_unused()

    groups = F.lit(0) if group is None else F.col(group).cast("int")
    return df.select(F.col(terms).alias("terms"), groups.alias("group")).mapInArrow(run, "term string, group int, cf bigint, df bigint")


def term_stats(df: DataFrame, terms: str) -> DataFrame:
    """Corpus and document frequency per term with one pre-aggregated shuffle."""
    return counted_terms(df, terms).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def vocabulary(stats: DataFrame, n_docs: int, max_features: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """The ``max_features`` most frequent terms within the document-frequency limits; ties by term."""
    return stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n_docs)) \
        .orderBy(F.desc("cf"), "term").limit(max_features)


def leading_stats(df: DataFrame, words: str, ngram: int, n_docs: int, max_features: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """What ``term_stats`` gives of the n-grams up to ``ngram`` for all terms that ``vocabulary`` may choose, and all single words.

    An n-gram is at most as frequent as each of its words. So once single words fill the vocabulary, no n-gram with a word less frequent
    than the last of them belongs to it, and only n-grams of the others are counted. ``words`` have no blanks.
    """
    single = materialise(term_stats(df, words), "word-stats")
    filled = vocabulary(single, n_docs, max_features, min_df, max_df).agg(F.count("*").alias("n"), F.min("cf").alias("floor")).first()
    floor = filled["floor"] if filled["n"] >= max_features else 0
    common = single.filter(F.col("cf") >= floor).select(F.col("term").alias("word"))
    looked_up = known(df.select(words), F.col(words), materialise(common, "common-words"), "_common")
    left_in = F.zip_with(words, "_common", lambda w, c: F.when(c, w))

    def build(w: Column) -> Column:
        longest, found = w, []
        for size in range(2, ngram + 1):
            left = F.greatest(F.size(w) - (size - 1), F.lit(0))
            # null where any word is
            longest = F.zip_with(F.slice(longest, F.lit(1), left), F.slice(w, F.lit(size), left), lambda a, b: F.concat(a, F.lit(" "), b))
            found.append(longest)
        return F.filter(F.concat(*found), lambda g: g.isNotNull())

    return single if ngram < 2 else single.unionByName(term_stats(looked_up.select(let(left_in, build).alias("_grams")), "_grams"))


def smooth_idf(df: float, n_docs: int) -> float:
    return math.log((1 + n_docs) / (1 + df)) + 1


@dataclass
class Tfidf:
    """A fitted vectoriser: terms in alphabetical order with their idf."""

    terms: list[str]
    idf: list[float]

    def pipeline(self, terms_col: str = "terms", out: str = "features") -> PipelineModel:
        """Count, weight and scale to unit length; each document is one row throughout, no shuffle."""
        # a vocabulary may not be empty, so one that is gets a term no analyser produces
        names, weights = (self.terms, self.idf) if self.terms else ([""], [0.0])
        return PipelineModel([
            CountVectorizerModel.from_vocabulary(names, inputCol=terms_col, outputCol="_counts"),
            ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_counts", outputCol="_weighted"),
            Normalizer(p=2.0, inputCol="_weighted", outputCol=out),
        ])

    def transform(self, df: DataFrame, terms_col: str = "terms", out: str = "features") -> DataFrame:
        return self.pipeline(terms_col, out).transform(df).drop("_counts", "_weighted")


def fit_tfidf(df: DataFrame, terms: str, max_features: int, min_df: int = 1, max_df: float = 1.0,
              n_docs: int | None = None) -> Tfidf:
    if not 0 < max_features <= MAX_VOCABULARY:
        raise ValueError(f"max_features has to lie in 1..{MAX_VOCABULARY}")
    n = df.count() if n_docs is None else n_docs
    rows = sorted(vocabulary(term_stats(df, terms), n, max_features, min_df, max_df).collect(),
                  key=lambda r: r["term"])
    return Tfidf([r["term"] for r in rows], [smooth_idf(r["df"], n) for r in rows])


def constant_array(values: list, kind: str) -> Column:
    """A list as one literal of the plan, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def cells(features: Column) -> Column:
    """``array<struct<at, value>>``: a vector's stored values and their places; a sparse one's zeros don't appear."""
    vector = F.unwrap_udt(features)

    def places(v):
        dense = F.when(v["size"].isNull() & (F.size(v["values"]) > 0), F.sequence(F.lit(0), F.size(v["values"]) - 1))
        return F.coalesce(v["indices"], dense, F.array().cast("array<int>"))

    return let(vector, lambda v: F.zip_with(places(v), v["values"], lambda i, x: F.struct(i.alias("at"), x.alias("value"))))


def weights_long(df: DataFrame, key: str, model: Tfidf, features: str = "features") -> DataFrame:
    """``(key, term, weight)`` for the non-zero weights; a row's work is its own terms, not the vocabulary's."""
    return df.select(key, F.explode(cells(F.col(features))).alias("c")).filter("c.value <> 0").select(
        key, F.get(constant_array(model.terms, "string"), F.col("c.at")).alias("term"), F.col("c.value").alias("weight"))
