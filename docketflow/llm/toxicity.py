"""Toxicity by class-conditional Kneser-Ney models.

Labelled training texts give bigram and word counts per class. Each class has an interpolated Kneser-Ney model: bigrams back
off to the class's words, and those to one distribution that both classes share, the words' continuation counts (in
how many contexts a word occurs). A word that is rare in both classes therefore weighs the same in both. A text's toxic
log-likelihood is compared with the ordinary one per word: over all words, and over those whose ratio exceeds 1 to 4 nats
above that of a word neither class knows, since a few expressions in a long text drown in the noise of all others. A
logistic curve, fitted on training texts that gave no counts, turns these features into a score.

Counts are made by Spark over all training texts. The model that goes to the workers has every counted word and every bigram
seen twice or more, each with its log-likelihood ratio alone, so it grows with the counted texts. A bigram seen once takes its
word's ratio: such bigrams count for discounts and backoff weights, but say more of chance than of the class they were seen in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from docketflow.llm import batches
from docketflow.session import materialise

#: Labelled rows that are learned from at most (by hash when there are more).
MAX_LABELLED = 1_000_000
#: One training row in so many fits the curve instead of giving counts.
CURVE_PART = 5
#: Rows on which the curve is fitted at most.
CURVE_ROWS = 40_000
#: Log-likelihood ratios above which a word's excess is averaged; the sum is taken above ``SUM_ABOVE``.
ABOVE = (1.0, 2.0, 3.0, 4.0)
SUM_ABOVE = 3.0
LEAST = 0.003
FEATURES = ["mean", *[f"above{t:g}" for t in ABOVE], "sum"]
START = np.uint64(0x5851F42D4C957F2D)
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words without marks around them, and where each text's words start.

    Words that are marks only keep them, so every run of other than white space is one token.
    """
    import xxhash

    codes, starts, distinct = batches.words(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(distinct), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    plain = pc.if_else(pc.equal(plain, ""), distinct, plain)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in plain.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    return (hashes[codes] if len(codes) else np.zeros(0, np.uint64)), starts


def contexts_of(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each; a text's first has the start mark."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    first = starts[:-1][np.diff(starts) > 0]
    before[first] = START
    return before


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = (before * ODD) ^ (words + (before >> np.uint64(31)))
    return (x ^ (x >> np.uint64(32))) * ODD


@dataclass
class Model:
    """Log-likelihood ratios, toxic to ordinary, by hash.

    ``word_keys``: sorted hashes, ``word_ratios`` those of the word level; ``pair_keys``: sorted keys of bigrams, ``pair_ratios``
    those of the bigram level with what it backs off to. ``unseen``: backoff weights of the word level, ordinary and toxic,
    whose ratio all other words get. ``curve``: slopes and offset of the score over the features. ``base``: score of a
    text without words.
    """

    word_keys: np.ndarray
    word_ratios: np.ndarray
    pair_keys: np.ndarray
    pair_ratios: np.ndarray
    unseen: np.ndarray
    curve: tuple[np.ndarray, float] = (np.zeros(len(FEATURES)), 0.0)
    base: float = 0.0

    def features(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of ``FEATURES`` per text."""
        ratios = np.full(len(words), np.log(self.unseen[1] / self.unseen[0]))
        # a context's weight counts where a bigram with it was seen, else the word level stands alone
        for known, values, keys in ((self.word_keys, self.word_ratios, words), (self.pair_keys, self.pair_ratios, pair_keys(contexts_of(words, starts), words))):
            if len(words) and len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                found = known[at] == keys
                ratios[found] = values[at[found]]
        ratios -= np.log(self.unseen[1] / self.unseen[0])
        sizes = np.maximum(np.diff(starts), 1)

        def total(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values)])
            return sums[starts[1:]] - sums[starts[:-1]]

        above = [np.log(LEAST + total(np.where(ratios > t, ratios, 0)) / sizes) for t in ABOVE]
        return np.stack([total(ratios) / sizes, *above, np.log1p(total(np.where(ratios > SUM_ABOVE, ratios, 0)))], axis=1)

    def scores(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        slopes, offset = self.curve
        x = np.clip(self.features(words, starts) @ slopes + offset, -40, 40)
        return np.where(np.diff(starts) > 0, 1 / (1 + np.exp(-x)), self.base)


def labelled_sample(labels: DataFrame, key: str, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """``key, label`` of the rows to learn from: at most ``limit``, so small enough to be broadcast. Null labels are out."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("_toxic")).groupBy(key).agg(F.max("_toxic").alias("_toxic"))
    rows = materialise(rows, "labels")
    n = rows.count()
    if n <= limit:
        return rows
    cut = int((1 << 30) * 0.98 * limit / n)
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 30)) < cut)


def pair_counts(docs: DataFrame, text: str) -> DataFrame:
    """``before, word, ordinary, toxic``: bigram counts of ``docs``, which has ``_toxic``; added up per batch already."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.bounded(rows, text):
            words, starts = tokens_of(pc.fill_null(batch.column(text), ""))
            if not len(words):
                continue
            toxic = np.repeat(batch.column("_toxic").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts))
            before = contexts_of(words, starts)
            keys = pair_keys(before, words)
            _, first, each = np.unique(keys, return_index=True, return_inverse=True)
            poisoned = np.bincount(each, weights=toxic, minlength=len(first)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(before[first].view(np.int64)), pa.array(words[first].view(np.int64)),
                pa.array(np.bincount(each, minlength=len(first)) - poisoned), pa.array(poisoned)], ["before", "word", "ordinary", "toxic"])

    counted = docs.select(text, "_toxic").mapInArrow(run, "before bigint, word bigint, ordinary bigint, toxic bigint")
    return counted.groupBy("before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _discounts(ones: float, twos: float) -> float:
    """Kneser and Ney's absolute discount; half when there are too few counts to tell."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _sorted(keys: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], ratios[order]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Both classes' models from the rows of ``docs`` that ``labels`` marks 0 or 1; both tables hold training rows only.

    A key with several labels counts as toxic if one says so. Without rows of both classes every score is 0.5.
    """
    marked = labelled_sample(labels, key, label)
    rows = docs.select(key, text).join(F.broadcast(marked), key)
    part = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(CURVE_PART)) == 0
    pairs = materialise(pair_counts(rows.filter(~part), text), "bigrams")
    words = materialise(pairs.groupBy("word").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count("*").alias("contexts")), "words")
    one = lambda c, n: F.count(F.when(F.col(c) == n, 1))
    w = words.agg(F.sum("ordinary").alias("n0"), F.sum("toxic").alias("n1"), F.sum("contexts").alias("contexts"),
                  one("ordinary", 1).alias("a0"), one("ordinary", 2).alias("b0"), one("toxic", 1).alias("a1"), one("toxic", 2).alias("b1"),
                  F.count(F.when(F.col("ordinary") > 0, 1)).alias("t0"), F.count(F.when(F.col("toxic") > 0, 1)).alias("t1")).first()
    if not w.n0 or not w.n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0), np.ones(2), base=0.5)
    b = pairs.agg(one("ordinary", 1).alias("a0"), one("ordinary", 2).alias("b0"), one("toxic", 1).alias("a1"), one("toxic", 2).alias("b1")).first()
    word_d = [_discounts(w.a0, w.b0), _discounts(w.a1, w.b1)]
    pair_d = [_discounts(b.a0, b.b0), _discounts(b.a1, b.b1)]
    unseen = np.array([word_d[0] * w.t0 / w.n0, word_d[1] * w.t1 / w.n1])

    classes = ["ordinary", "toxic"]
    totals = [w.n0, w.n1]
    shared = F.col("contexts") / F.lit(float(w.contexts))
    probs = [F.greatest(F.col(c) - word_d[i], F.lit(0.0)) / float(totals[i]) + float(unseen[i]) * shared for i, c in enumerate(classes)]
    follow = pairs.groupBy("before").agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(f"f{i}") for i, c in enumerate(classes)],
                                         *[F.sum(c).alias(f"n{i}") for i, c in enumerate(classes)])
    weights = [F.when(F.col(f"n{i}") > 0, pair_d[i] * F.col(f"f{i}") / F.col(f"n{i}")).otherwise(1.0) for i in range(2)]
    level = words.select("word", *[p.alias(f"p{i}") for i, p in enumerate(probs)])
    context = follow.select("before", "n0", "n1", *[x.alias(f"w{i}") for i, x in enumerate(weights)])
    share = [F.when(F.col(f"n{i}") > 0, F.greatest(F.col(c) - pair_d[i], F.lit(0.0)) / F.col(f"n{i}")).otherwise(0.0) for i, c in enumerate(classes)]
    mixed = [share[i] + F.col(f"w{i}") * F.col(f"p{i}") for i in range(2)]
    ratio = lambda a, b: F.log(b / a).cast("float").alias("ratio")
    ones = level.select("word", ratio(F.col("p0"), F.col("p1"))).toArrow()
    twos = pairs.filter("ordinary + toxic > 1").join(level, "word").join(context, "before").select("before", "word", ratio(*mixed)).toArrow()
    hashes = lambda table, column: table[column].to_numpy().view(np.uint64)
    model = Model(*_sorted(hashes(ones, "word"), ones["ratio"].to_numpy()),
                  *_sorted(pair_keys(hashes(twos, "before"), hashes(twos, "word")), twos["ratio"].to_numpy()), unseen)

    held = _applied(rows.filter(part), model, text, ["_toxic"], "_toxic int, words bigint, " + ", ".join(f"{f} double" for f in FEATURES), lambda own, words, starts: list(own.features(words, starts).T))
    share = min(1.0, CURVE_ROWS / max(1, marked.count() / CURVE_PART))
    chosen = held.filter("words > 0").filter(F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 20)) < int(share * (1 << 20))).toArrow()
    model.curve, model.base = _curve(np.stack([chosen[f].to_numpy() for f in FEATURES], axis=1), chosen["_toxic"].to_numpy())
    return model


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[tuple[np.ndarray, float], float]:
    """Slopes and offset of a logistic curve by Newton steps with a prior of one unit, and the share of toxic rows."""
    if not len(x) or y.min() == y.max():
        return (np.zeros(len(FEATURES)), 0.0), 0.5
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1)
    prior = np.diag([1.0] * len(FEATURES) + [1e-6])
    beta = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + prior, a.T @ (p - y) + prior @ beta)
        beta -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[:-1] / scale
    return (slopes, float(beta[-1] - slopes @ centre)), float(y.mean())


def _applied(docs: DataFrame, model: Model, text: str, keep: list[str], schema, values) -> DataFrame:
    """Columns ``keep``, the number of words, and what ``values`` makes of the model and a batch's words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.bounded(rows, text):
            words, starts = tokens_of(pc.fill_null(batch.column(text), ""))
            found = values(shared.value, words, starts)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(np.diff(starts)), *map(pa.array, found)], names)

    names = schema.fieldNames() if isinstance(schema, T.StructType) else [c.split()[0] for c in schema.split(", ")]
    return docs.select(*keep, text).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` (0 to 1, higher: toxic likelier) of every row from its whole text; without words the training rows' share."""
    kind = T.StructType([docs.schema[key], T.StructField("words", T.LongType()), T.StructField("score", T.DoubleType())])
    return _applied(docs, model, text, [key], kind, lambda own, words, starts: [own.scores(words, starts)]).drop("words")
