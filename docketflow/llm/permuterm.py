"""Spelling variants: words one inserted, deleted or replaced character apart, found among their sorted rotations.

A word is marked with a terminator and turned through all its rotations. A rotation that ends just behind a word's character x reads
``b$ax`` for the word ``axb``. Words that differ from it in x alone share the rotation's prefix ``b$a``; and the word without
x, ``ab``, has that prefix itself among its rotations. So every edit of one character is a prefix range that skips the edited character:
a word stands under each rotation without its last character (``skip``) and under each whole rotation (``whole``), 2n + 1 entries of n
characters. Sorted by prefix, entries of one prefix stand together. A prefix and the character it skips spell one word, so such a
group has no more words than the alphabet has letters, one more for the word without any; no group grows with the corpus.

Within a group entries are sorted by falling count and rising word. A scan over the sorted entries finds each entry's first neighbour and
how many it has without holding the group's pairs; ``neighbours`` spells the pairs out for those who want them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from docketflow.llm import batches
from docketflow.session import materialise

#: Ends a word; no word has it.
TERMINATOR = "$"
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least this many times as frequent as its variant.
RATIO = 2
#: What an entry says: the word is the prefix's own rotation; its skipped character repeats the one before it; or neither.
#: Skipping any one of a run of equal characters gives the same shorter word: only the first of the run counts for that.
WHOLE, REPEATED, SKIP = 0, 1, 2
OUT_ROWS = 50_000


def runs(docs: DataFrame, text: str = "text", pattern: str = LETTERS) -> DataFrame:
    """``docs`` with a row per run of letters: ``word``, A to Z lower-cased, in place of ``text``. Null and empty texts have none."""
    rest = [c for c in docs.columns if c != text]
    if "word" in [c.lower() for c in rest]:
        raise ValueError("a column is already called word")
    return docs.select(*rest, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("word")).withColumn(
        "word", F.translate("word", UPPER, LOWER))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words of at least so many code points that occur at least so often."""
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def entries(words: DataFrame) -> DataFrame:
    """``prefix, kind, word, n``: every word of ``word, n`` under its rotations, whole and without their last character."""
    size = F.char_length("word")

    def turned(at: Column, upto: Column) -> Column:
        # the marked word from place `at` (from 0) to its end, then its first `upto` characters
        return F.concat(F.substring("word", at + 1, size - at), F.lit(TERMINATOR), F.substring("word", F.lit(1), upto))

    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(i, i).alias("prefix"), F.lit(WHOLE).alias("kind")))
    same = lambda i: (i > 1) & (F.substring("word", i, F.lit(1)) == F.substring("word", i - 1, F.lit(1)))
    skip = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        turned(i, i - 1).alias("prefix"), F.when(same(i), REPEATED).otherwise(SKIP).alias("kind")))
    return words.filter(size > 0).select("word", "n", F.explode(F.concat(whole, skip)).alias("e")).select("e.prefix", "e.kind", "word", "n")


def _groups(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Entries of prefixes that several words share, and where each prefix's entries start; rows come sorted by prefix."""
    held = None
    for batch in rows:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not table.num_rows:
            continue
        prefix = table.column("prefix")
        new = np.concatenate([[True], pc.not_equal(prefix.slice(1), prefix.slice(0, table.num_rows - 1)).to_numpy()])
        starts = np.flatnonzero(new)
        # the last prefix may go on in the next batch
        held = table.slice(int(starts[-1]))
        yield from _shared(table.slice(0, int(starts[-1])), starts[:-1])
    if held is not None:
        yield from _shared(held, np.zeros(1, np.int64))


def _shared(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    sizes = np.diff(starts, append=table.num_rows)
    shared = sizes > 1
    if shared.any():
        yield table.filter(pa.array(np.repeat(shared, sizes))), np.cumsum(sizes[shared]) - sizes[shared]


def _sorted(words: DataFrame) -> DataFrame:
    return entries(words).repartition("prefix").sortWithinPartitions("prefix", F.desc("n"), "word")


def nearest(words: DataFrame) -> DataFrame:
    """``word, n, n_near, near, near_n`` for each row of ``word, n`` (distinct words, none null).

    ``n_near``: how many words are one inserted, deleted or replaced character away; ``near``: the most frequent of them, the first in
    code-point order of several, with its count. A word without such a neighbour has 0 and nulls.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(rows):
            kind = table.column("kind").to_numpy()
            at, none = np.arange(len(kind)), len(kind)
            group = np.repeat(np.arange(len(starts)), np.diff(starts, append=none))

            def first(wanted: np.ndarray) -> np.ndarray:
                """Each row's group's first entry that is wanted, or none."""
                return np.minimum.reduceat(np.where(wanted, at, none), starts)[group]

            def number(wanted: np.ndarray) -> np.ndarray:
                return np.add.reduceat(wanted.astype(np.int64), starts)[group]

            whole, skips, single = kind == WHOLE, kind != WHOLE, kind == SKIP
            best = first(skips)
            other = np.where(best == at, first(skips & (best != at)), best)
            # the word without the character is near those that skip it first of its run; entries are sorted, so the smaller place is the better word
            near = np.where(whole, first(single), np.where(single, np.minimum(other, first(whole)), other))
            count = np.where(whole, number(single), number(skips) - 1 + np.where(single, number(whole), 0))
            found = pa.array(np.flatnonzero(near < none))
            chosen = table.take(pa.array(near[near < none]))
            yield from pa.table([table.column("word").take(found), pa.array(count).take(found), chosen.column("word"), chosen.column("n")],
                                ["word", "n_near", "near", "near_n"]).combine_chunks().to_batches(OUT_ROWS)

    each = _sorted(words).mapInArrow(run, "word string, n_near bigint, near string, near_n bigint")
    summed = each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best"))
    return words.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_best.near").alias("near"), (-F.col("_best.m")).alias("near_n"))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near``: every ordered pair of words that are one inserted, deleted or replaced character apart, once."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(rows):
            kind, sizes = table.column("kind").to_numpy(), np.diff(starts, append=table.num_rows)
            each = np.repeat(sizes, sizes)
            left = np.repeat(np.arange(len(kind)), each)
            right = batches.gather(np.repeat(starts, sizes), each)
            a, b = kind[left], kind[right]
            keep = (left != right) & np.where((a == WHOLE) | (b == WHOLE), (a == SKIP) | (b == SKIP), True)
            word = table.column("word")
            yield from pa.table([word.take(pa.array(left[keep])), word.take(pa.array(right[keep]))], ["word", "near"]).combine_chunks().to_batches(OUT_ROWS)

    return _sorted(words).mapInArrow(run, "word string, near string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``word, form`` lead from each word; ``form`` is not null and no word leads to itself.

    Paths double in length every round. A row whose root is found takes part no longer, so no join gathers a root's whole tree.
    """
    paths = materialise(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "forms")
    while paths.filter("NOT done").limit(1).count():
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"), F.col("done").alias("_ended"))
        moved = paths.filter("NOT done").join(onward, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.coalesce("_ended", F.lit(True)).alias("done"))
        paths = materialise(paths.filter("done").unionByName(moved), "forms")
    return paths.select("word", "root")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``word, n``.

    ``form``: the word's most frequent neighbour, if it is at least ``ratio`` (2 or more) times as frequent, else null; ``root``: where
    forms lead in the end, the word itself without one. Counts rise along forms, so a path has at most as many steps as counts
    can double. Words are distinct and not null; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms have to be more frequent than their variants")
    stored = materialise(words.select("word", "n"), "words")
    held = F.col("near_n") >= ratio * F.col("n")
    found = materialise(nearest(stored).select("word", F.when(held, F.col("near")).alias("form"), "n", "n_near", F.when(held, F.col("near_n")).alias("form_n")), "nearest")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
