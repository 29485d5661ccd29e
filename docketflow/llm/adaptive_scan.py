"""Nearest neighbours by largest inner product: inverted lists scanned with early abandonment.

Vectors are scaled by the largest norm and given one more component that makes all norms 1; the largest inner product is then
the smallest distance. After a random rotation the distance over the first components estimates the whole distance.
Each probed list is scanned in column blocks: after each block candidates whose partial distance is, by a hypothesis test, too
large for the best ones go. What is left is scored exactly on the original vectors.

Equal vectors are one entry, so a vector that a third of all rows share costs one. Lists are dealt in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docketflow.session import materialise

#: Rows on which lists are fitted, and rows that give each query a first bound; both are bounded samples by hash.
FIT_ROWS = 20_000
BOUND_ROWS = 4_000
MAX_LISTS = 4_096
#: Share of lists that a query scans; vectors without clusters need many lists for a recall of 0.9.
PROBES = 0.7
LEAST_PROBES = 16
COLUMNS = 16
#: Significance of the test: a partial distance must exceed the bound by this many standard deviations.
EPSILON = 2.1
BLOCK_VECTORS, BLOCK_QUERIES = 4_096, 512
SEED = 5


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, vector`` (doubles) of the rows that take part.

    Out are null keys, null and zero vectors, those with null or non-finite components, and of the others those of another length
    than most have (the longer one of two lengths that are as frequent).
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter("vec_id is not null")
    # a sum over the components is null, not finite or zero exactly where a vector is out
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x))
    valid = rows.filter((total > 0) & (total < float("inf")))
    size = valid.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("d")).first().d
    return valid.filter(F.size("vector") == size) if size else rows.limit(0)


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from rows spread over the sample; an empty list keeps its place."""
    rng = np.random.default_rng(SEED)
    means = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        near = np.concatenate([_distances(part, means).argmin(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(means)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(means))
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Scaled by the largest norm, with the component that makes the norm 1."""
    x = vectors / largest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)


def asked(queries: np.ndarray) -> np.ndarray:
    """Queries of norm 1, with 0 for the added component."""
    return np.concatenate([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((len(queries), 1))], axis=1)


def scan_block(x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
    """For each rotated query the rows that may be among its ``k`` nearest, and how many components were read.

    ``bound``: a squared distance for each query within which ``k`` rows are known to lie.
    """
    found, read, size = [], 0, x.shape[1]
    for i in range(len(q)):
        limit, alive, partial = bound[i], np.arange(len(x)), np.zeros(len(x))
        for start in range(0, size, COLUMNS):
            stop = min(size, start + COLUMNS)
            step = x[alive, start:stop] - q[i, start:stop]
            partial = partial[alive] if len(partial) != len(alive) else partial
            partial = partial + np.einsum("ij,ij->i", step, step)
            read += step.size
            factor = 1.0 if stop == size else stop / size * (1 + EPSILON / stop**0.5) ** 2
            keep = partial <= limit * factor * (1 + 1e-9) + 1e-12
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        if len(alive) > k:
            # ties with the last one stay
            alive = alive[partial <= np.partition(partial, k - 1)[k - 1] * (1 + 1e-9) + 1e-12]
        found.append(alive)
    return found, read


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, probes: float = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose key is divisible by ``every``, the ``k`` rows of largest inner product.

    Nearest first, ties to the smaller key, the query's own key left out; fewer rows if there are fewer candidates. Rows that
    share a key count once per distinct vector. ``probes``: share of lists that are scanned per query. No query, no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, key, vector).distinct(), "vectors")
    top = Window.partitionBy("vector").orderBy("vec_id")
    # one entry per distinct vector; its k + 1 smallest keys are all that any result can need
    entries = rows.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k + 1).groupBy("vector").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id())
    entries = materialise(entries, "entries")
    facts = entries.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("largest")).first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not facts.n:
        return spark.createDataFrame([], out)
    share = min(1.0, 1.1 * FIT_ROWS / facts.n)
    hashed = F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) / float(1 << 30)
    sample = np.array([r.vector for r in entries.filter(hashed < share).select("vector").limit(2 * FIT_ROWS).collect()] or [entries.first().vector], dtype=float)
    largest = float(facts.largest)
    turn = rotation(sample.shape[1] + 1)
    lists = max(1, min(MAX_LISTS, int(facts.n**0.5), len(sample)))
    turned = lifted(sample, largest) @ turn
    means = centroids(turned, lists)
    bounding = turned[:BOUND_ROWS]
    bounding_list = _distances(bounding, means).argmin(axis=1)
    probed = min(lists, max(LEAST_PROBES, int(np.ceil(probes * lists))))

    def listed(batches):
        for batch in batches:
            x = lifted(np.array(batch.column("vector").to_pylist(), dtype=float).reshape(batch.num_rows, -1), largest) @ turn if batch.num_rows else np.zeros((0, turn.shape[0]))
            near = _distances(x, means).argmin(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("vector"), pa.array(near, pa.int32())], ["entry", "vector", "list"])

    def probing(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = asked(np.array(batch.column("vector").to_pylist(), dtype=float)) @ turn
            near = np.argpartition(_distances(q, means), probed - 1, axis=1)[:, :probed]
            scanned = np.zeros((len(q), lists), bool)
            scanned[np.arange(len(q))[:, None], near] = True
            # only rows of lists that the query scans may bound it
            known = np.where(scanned[:, bounding_list], _distances(q, bounding), 8.0)
            # the query's own entry may be among them, so one more than k
            bound = np.partition(known, k, axis=1)[:, k] if known.shape[1] > k else np.full(len(q), 8.0)
            yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("vector"), pa.array(np.maximum(bound, 0)), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))],
                                             ["entry", "vector", "bound", "lists"])

    index = materialise(entries.select("entry", "vector").mapInArrow(listed, "entry bigint, vector array<double>, list int"), "index")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).join(entries.select("vector", "entry"), "vector").select(F.col("vec_id").alias("query_id"), "entry")
    queries = materialise(queries, "queries")
    distinct = entries.join(queries.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")
    probes_of = materialise(distinct.mapInArrow(probing, "entry bigint, vector array<double>, bound double, lists array<int>").select(
        "entry", "vector", "bound", F.explode("lists").alias("list")), "probes")

    # a list of any length is dealt in blocks, and so are its queries
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("xs"))
    asks = probes_of.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qs"))
    dealt = sizes.join(asks, "list")
    left = index.join(dealt, "list").select("list", F.pmod(F.xxhash64("entry"), F.col("xs")).cast("int").alias("x"),
                                            F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "entry", "vector")
    right = probes_of.join(dealt, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"),
                                                 F.pmod(F.xxhash64("entry"), F.col("qs")).cast("int").alias("q"), "entry", "vector", "bound")

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "entry": [], "score": []}).astype({"query": "int64", "entry": "int64", "score": "float64"})
        own, ask = np.stack(a["vector"].to_numpy()), np.stack(b["vector"].to_numpy())
        found, _ = scan_block(lifted(own, largest) @ turn, asked(ask) @ turn, b["bound"].to_numpy(), k + 1)
        ids, who = a["entry"].to_numpy(), b["entry"].to_numpy()
        at = np.concatenate(found) if found else np.zeros(0, int)
        by = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return pd.DataFrame({"query": who[by], "entry": ids[at], "score": np.einsum("ij,ij->i", own[at], ask[by])})

    hits = left.groupBy("list", "x", "q").cogroup(right.groupBy("list", "x", "q")).applyInPandas(scan, "query bigint, entry bigint, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "first")
    # ties between entries go by key, so each entry stands for its smallest
    firsts = entries.select("entry", "ids", F.col("ids")[0].alias("first"))
    short = hits.join(firsts.select("entry", "first"), "entry").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    each = short.join(firsts.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    each = materialise(each.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k + 1).drop("_r"), "nearest")
    ranked = queries.join(each.withColumnRenamed("query", "entry"), "entry").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
