"""Sentences split with abbreviations that are learned from the corpus.

A word is an abbreviation if it keeps company with a full stop far more often than chance has it. Each word's counts with and without a
full stop give a log-likelihood ratio between "always with one" and "with one as often as any word"; it is weighed down
for long words and for every time that the word stands without, and up for full stops inside (Kiss and Strunk, 2006).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from docketflow.functions import text as X
from docketflow.operators.features import counted_terms
from docketflow.operators.vocabulary import known
from docketflow.session import materialise

#: An abbreviation's least score, and the share of its occurrences that have a full stop if it is one.
LEAST_SCORE, WITH_STOP = 0.3, 0.99
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"


def bare(token: Column) -> Column:
    """A token in lower case without the punctuation around it; full stops behind it stay."""
    return F.lower(F.regexp_replace(token, F.lit(_EDGES), F.lit("")))


def abbreviations(df: DataFrame, text: str, least: float = LEAST_SCORE) -> DataFrame:
    """``word, n, with_stop, score`` of the words, without their full stop, that score ``least`` or more.

    Tokens are counted as they stand before they are shuffled, so a distinct one is looked at once; what is scored is one row per
    word, stored since its totals are needed first. Null texts count nothing.
    """
    standing = counted_terms(df.select(X.blank_separated(F.col(text)).alias("_tokens")), "_tokens").groupBy("term").agg(F.sum("cf").alias("cf"))
    tokens = standing.select(bare(F.col("term")).alias("t"), "cf").filter(F.col("t").rlike(r"\p{L}"))
    stopped = F.endswith("t", F.lit("."))
    counted = materialise(tokens.groupBy(F.when(stopped, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")).alias("word")).agg(
        F.sum("cf").alias("n"), F.sum(F.when(stopped, F.col("cf")).otherwise(0)).alias("with_stop")), "counted-words")
    totals = counted.agg(F.sum("n").alias("all_n"), F.sum("with_stop").alias("all_stops"))
    both = counted.filter("with_stop > 0").join(F.broadcast(totals))
    chance = F.least(F.greatest(F.col("all_stops") / F.col("all_n"), F.lit(1e-9)), F.lit(1 - 1e-9))
    without = F.col("n") - F.col("with_stop")

    def likelihood(p: Column) -> Column:
        return F.col("with_stop") * F.log(p) + without * F.log(1 - p)

    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = 2 * (likelihood(F.lit(WITH_STOP)) - likelihood(chance)) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -without)
    return both.withColumn("score", score).filter(F.col("score") >= least).select("word", "n", "with_stop", "score")


def split_sentences(df: DataFrame, text: str, model: DataFrame, out: str = "sentences") -> DataFrame:
    """``df`` with the array ``out`` of sentences: no sentence ends behind a word of ``model(word)`` or behind a single letter.

    Texts are cut where they might end first; parts that don't end there are put together again with a blank.
    """
    def word(part: Column) -> Column:
        # a part ends without white space, so its last token is behind its last blank at the earliest
        last = bare(F.element_at(X.blank_separated(F.substring_index(part, " ", -1)), -1))
        return X.let(last, lambda t: F.when(F.endswith(t, F.lit(".")), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(""))

    cut = X.let(X.sentences(F.col(text)), lambda p: F.struct(p.alias("parts"), F.transform(p, word).alias("words")))
    ready = df.withColumn("_cut", cut)
    looked_up = known(ready, F.col("_cut.words"), model, "_open")
    alone = F.transform("_cut.words", lambda w: w.rlike(r"^\p{L}$"))
    joined = F.arrow_udf(_joined, "array<string>")
    return looked_up.withColumn(out, joined(F.col("_cut.parts"), F.col("_open"), alone)).drop("_cut", "_open")


def _joined(parts: pa.Array, opened: pa.Array, alone: pa.Array) -> pa.Array:
    """Each row's parts, those that go on put together with the next one; a null row stays null."""
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row_ends = np.cumsum(sizes)
    rows = row_ends[sizes > 0]
    # rows without parts have no flags either, so the three flat lists run side by side
    ends = ~pc.or_(opened.flatten(), alone.flatten()).to_numpy(zero_copy_only=False).astype(bool)
    ends[rows - 1] = True
    at = np.concatenate([[0], np.flatnonzero(ends) + 1])
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts.flatten().cast(pa.string())), " ")
    per_row = np.concatenate([[0], np.cumsum(ends)])[np.concatenate([[0], row_ends])]
    return pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), whole, mask=pc.is_null(parts))
