"""Token look-ups against a word table: dictionary filter and lemmas; lemmas by rules.

A table whose size has been checked goes to the workers whole, sorted into nothing but arrays: each row's tokens are looked up where they
are, so no row is moved or stored. A larger table is joined: tokens go out with a number of their row, and what is found is
gathered by it. Both give the same answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from docketflow import fixed_values as V
from docketflow.functions.text import let, tokens
from docketflow.session import materialise

#: Bytes of words that a table may have to be sent to every worker.
HELD_BYTES = 64 << 20


def _held(table: DataFrame) -> pa.Table | None:
    """The table's rows, if its texts are small enough; they are counted first."""
    size = table.agg(F.sum(sum(F.octet_length(c) + 8 for c in table.columns))).first()[0] or 0
    return table.toArrow() if size <= HELD_BYTES else None


def _relisted(lists: pa.Array, values: pa.Array, kept: np.ndarray | None = None) -> pa.Array:
    """``values`` of all lists as lists again; ``kept`` says which of the old values they are."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if kept is not None:
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _numbered(df: DataFrame) -> DataFrame:
    """The rows, stored, with a number each; a number made anew in every read could change when a task runs again."""
    return materialise(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _gathered(rows: DataFrame, words: Column, table: DataFrame, how: str, value: Column, out: str, kind: str = "string") -> DataFrame:
    """``rows`` with the array ``out`` of ``value`` for every token that ``table(_word, ...)`` joins, in token order."""
    exploded = rows.select("_row", F.posexplode(words).alias("_pos", "_word"))
    joined = exploded.join(table, "_word", how).select("_row", "_pos", value.alias("_value"))
    lists = joined.groupBy("_row").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_pos", "_value"))), lambda r: r["_value"]).alias("_found"))
    return rows.join(lists, "_row", "left").withColumn(out, F.coalesce("_found", F.array().cast(f"array<{kind}>"))).drop("_row", "_found")


def dictionary_filter(df: DataFrame, key: str, text: str, words: DataFrame, exclude: DataFrame | None = None,
                      out: str = "kept") -> DataFrame:
    """Keep the tokens found in ``words(word)`` and not in ``exclude(word)``, each followed by a blank.

    Case-sensitive; null words match nothing. Rows stay as they are, also where ``key`` repeats. A null text keeps nothing.
    """
    table = words.select(F.col("word").alias("_word")).filter("_word IS NOT NULL").distinct()
    if exclude is not None:
        table = table.join(exclude.select(F.col("word").alias("_word")).distinct(), "_word", "left_anti")
    held = _held(table)
    if held is None:
        found = _gathered(_numbered(df), tokens(F.col(text)), table, "left_semi", F.col("_word"), "_kept")
        return found.withColumn(out, _spaced(F.col("_kept"))).drop("_kept")
    known = held.column("_word").combine_chunks().cast(pa.string())

    @F.arrow_udf("array<string>")
    def kept(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().cast(pa.string())
        mask = pc.is_in(flat, value_set=known)
        return _relisted(lists, flat.filter(mask), mask.to_numpy(zero_copy_only=False))

    return df.withColumn(out, _spaced(kept(tokens(F.col(text)))))


def _spaced(words: Column) -> Column:
    return let(words, lambda w: F.when(F.size(w) > 0, F.concat(F.array_join(w, " "), F.lit(" "))).otherwise(""))


def lemmatize(df: DataFrame, key: str, text: str, lemmas: DataFrame, out: str = "lemmas") -> DataFrame:
    """Tokens of two or more characters, each replaced by its lemma where ``lemmas(form, lemma)`` has one.

    Where a form repeats its smallest lemma counts. Rows stay as they are, also where ``key`` repeats. A null text has none.
    """
    words = F.filter(tokens(F.col(text)), lambda w: F.length(w) > 1)
    table = lemmas.filter("form IS NOT NULL AND lemma IS NOT NULL").groupBy(F.col("form").alias("_word")).agg(F.min("lemma").alias("_lemma"))
    held = _held(table)
    if held is None:
        return _gathered(_numbered(df), words, table, "left", F.coalesce("_lemma", "_word"), out)
    forms, lemma = (held.column(c).combine_chunks().cast(pa.string()) for c in ("_word", "_lemma"))

    @F.arrow_udf("array<string>")
    def replaced(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().cast(pa.string())
        return _relisted(lists, pc.coalesce(lemma.take(pc.index_in(flat, value_set=forms)), flat))

    return df.withColumn(out, replaced(words))


def known(df: DataFrame, words: Column, table: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: for each of the strings in ``words``, whether ``table(word)`` has it. A null list gives an empty one."""
    listed = table.select(F.col("word").alias("_word")).filter("_word IS NOT NULL").distinct()
    held = _held(listed)
    if held is None:
        marked = listed.withColumn("_known", F.lit(True))
        return _gathered(_numbered(df), words, marked, "left", F.coalesce("_known", F.lit(False)), out, "boolean")
    found = held.column("_word").combine_chunks().cast(pa.string())

    @F.arrow_udf("array<boolean>")
    def looked_up(lists: pa.Array) -> pa.Array:
        return _relisted(lists, pc.is_in(lists.flatten().cast(pa.string()), value_set=found))

    return df.withColumn(out, looked_up(words))


def rule_lemmas(forms: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None, rules=V.VERB_ENDINGS) -> DataFrame:
    """``form, lemma`` for each distinct ``form`` of ``forms`` that has a lemma of its own: a table for ``lemmatize``.

    A form's candidates are itself and what the rules make of it by replacing an ending. Those in ``lexicon(word)`` count, the
    shortest is the lemma, the first in code-point order of several. Without one the rules are applied to the candidates again, until one
    is found or no ending fits. A form in ``exceptions(form, lemma)`` has those lemmas as candidates, and no rule applies. A form
    without any candidate in the lexicon stays as it is. Each distinct form is looked at once, however often it occurs.
    """
    known = materialise(lexicon.select("word").filter("word IS NOT NULL").distinct(), "lexicon")
    distinct = forms.select("form").filter("form IS NOT NULL").distinct()
    found = []
    if exceptions is not None:
        listed = exceptions.select("form", F.col("lemma").alias("word")).filter("form IS NOT NULL AND word IS NOT NULL")
        special = distinct.join(listed.select("form").distinct(), "form", "left_semi")
        found.append(_shortest(special.join(listed, "form").unionByName(special.withColumn("word", F.col("form"))), known))
        distinct = distinct.join(listed.select("form").distinct(), "form", "left_anti")
    endings = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in rules])

    def detached(word: Column) -> Column:
        fits = F.filter(endings, lambda e: F.endswith(word, e["old"]) & (F.length(word) > F.length(e["old"])))
        return F.transform(fits, lambda e: F.concat(F.substr(word, F.lit(1), F.length(word) - F.length(e["old"])), e["new"]))

    left = materialise(distinct.select("form", F.explode(F.array_append(detached(F.col("form")), F.col("form"))).alias("word")).distinct(), "candidates")
    while left.limit(1).count():
        best = materialise(_shortest(left, known), "lemmas")
        found.append(best)
        # every rule makes a word shorter, so this ends
        rest = left.join(best.select("form"), "form", "left_anti").filter("word <> form")
        left = materialise(rest.select("form", F.explode(detached(F.col("word"))).alias("word")).distinct(), "candidates")
    if not found:
        return left.select("form", F.col("word").alias("lemma"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.filter("lemma <> form")


def _shortest(candidates: DataFrame, known: DataFrame) -> DataFrame:
    hits = candidates.join(known, "word", "left_semi")
    return hits.groupBy("form").agg(F.min(F.struct(F.length("word").alias("size"), "word")).alias("best")).select("form", F.col("best.word").alias("lemma"))
