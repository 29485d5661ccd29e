"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full shingle sets decide.

A text's words (lower-cased A-Z) give its set of five-word shingles. 192 MinHash samples of the set are cut into 32 bands of
6; texts that agree in a band are candidates. The same samples are folded into a 1,024-bit odd sketch: each sample flips one
bit, so equal samples cancel in the XOR of two sketches and its population count tells how many samples differ. Candidates
whose count is out of reach for the asked similarity go; the others are confirmed on the full sets.

No bucket is turned into all its pairs. First each text is held against its buckets' smallest text only, and components are
formed. Then, per smallest text, only texts outside the group's main component are held against the group, in blocks.
At a similarity of 0.85 two texts share no band with a chance of 3e-7, at 0.8 of 6e-5; a shared band's link is always found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from docketflow.llm import batches
from docketflow.llm.components import components
from docketflow.session import materialise

SHINGLE = 5
BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
SIMILARITY_PERCENT = 85
#: Bytes of text that a block of one comparison task holds.
BLOCK_BYTES = 4 << 20

_SEEDS = np.random.default_rng(7)
FACTORS = _SEEDS.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _SEEDS.integers(1, 2**63, SAMPLES, dtype=np.uint64)
PLACES = _SEEDS.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0xFF51AFD7ED558CCD)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * ODD
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes and its length."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all five-word windows, where each text's windows start, and a hash of each text's word sequence.

    A text of fewer than five words has its whole sequence as one window; one without words has none.
    """
    codes, starts, distinct = batches.words(pc.ascii_lower(texts))
    hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    sizes = np.diff(starts)
    windows = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    at = batches.gather(starts[:-1], windows)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    short = np.repeat(np.where(sizes < SHINGLE, sizes, SHINGLE), windows)
    for k in range(SHINGLE):
        out += np.where(k < short, mixed(padded[at + k] + np.uint64(k)) * PLACES[k], np.uint64(0))
    out = mixed(out + short.astype(np.uint64))
    # the sequence: a sum of words mixed with their places
    place = np.arange(len(hashes), dtype=np.int64) - np.repeat(starts[:-1], sizes)
    each = mixed(hashes ^ mixed(place.astype(np.uint64) + np.uint64(1)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    whole = mixed(sums[starts[1:]] - sums[starts[:-1]] + sizes.astype(np.uint64))
    return out, np.concatenate([[0], np.cumsum(windows)]), whole


def sets_of(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where they start."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(starts) - 1))])


def samples_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash samples, one row per set; sets must not be empty."""
    out = np.empty((len(starts) - 1, SAMPLES), np.uint64)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat((hashes ^ SHIFTS[j]) * FACTORS[j], starts[:-1])
    return out


def sketches_of(samples: np.ndarray) -> np.ndarray:
    """Odd sketches as 64-bit words: sample ``j`` with value ``x`` flips the bit that ``(j, x)`` hashes to."""
    n = len(samples)
    bits = (mixed(samples + SHIFTS[None, :]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.zeros((n, SKETCH_BITS), np.uint8)
    rows = np.arange(n)
    for j in range(samples.shape[1]):
        flips[rows, bits[:, j]] ^= 1
    return np.packbits(flips, axis=1, bitorder="little").view("<u8")


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One hash per band, the band's number mixed in."""
    parts = samples.reshape(len(samples), BANDS, ROWS)
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(samples), axis=0)
    for k in range(ROWS):
        out = mixed(out * BASE + parts[:, :, k])
    return out


def most_flips(percent: int) -> int:
    """The XOR count that pairs of at least this similarity exceed with a chance below one in a million.

    The number of differing samples is binomial; each adds up to two flips to distinct or colliding bits.
    """
    p = 1 - percent / 100
    differing = SAMPLES * p + 5 * (SAMPLES * p * (1 - p)) ** 0.5 + 1
    mean = SKETCH_BITS / 2 * (1 - np.exp(-4 * differing / SKETCH_BITS))
    return int(mean + 3 * (SKETCH_BITS / 4 * (1 - np.exp(-8 * differing / SKETCH_BITS))) ** 0.5) + 1


def estimated_similarity(flips: int) -> float:
    """Similarity from the population count of two sketches' XOR."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * flips / SKETCH_BITS)))


SIGNATURE = "{key} bigint, n_shingles bigint, sequence bigint, sequence2 bigint, bands array<bigint>, sketch array<bigint>"


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, set size, hashes of the word sequence, bands and odd sketch of every row (both null for an empty set)."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.bounded(rows, text, 4 << 20):
            hashes, starts, whole = shingles_of(pc.fill_null(batch.column(text), ""))
            # a second, independent hash of the sequence makes it 128 bits
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes * ODD + np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts[:-1], np.diff(starts)).astype(np.uint64)))])
            second = sums[starts[1:]] - sums[starts[:-1]]
            values, at = sets_of(hashes, starts)
            sizes = np.diff(at)
            filled = sizes > 0
            samples = samples_of(values, np.concatenate([at[:-1][filled], at[-1:]])) if filled.any() else np.zeros((0, SAMPLES), np.uint64)
            empty = pa.array(~filled)

            def listed(rows: np.ndarray, width: int) -> pa.Array:
                offsets = np.concatenate([[0], np.cumsum(np.where(filled, width, 0))])
                return pc.if_else(empty, None, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.astype(np.uint64).reshape(-1).view(np.int64))))

            yield pa.RecordBatch.from_arrays([
                batch.column(key).cast(pa.int64()), pa.array(sizes), pa.array(whole.view(np.int64)), pa.array(second.view(np.int64)),
                listed(bands_of(samples), BANDS), listed(sketches_of(samples), SKETCH_BITS // 64)],
                [key, "n_shingles", "sequence", "sequence2", "bands", "sketch"])

    return docs.select(key, text).mapInArrow(run, SIGNATURE.format(key=key))


def flips_between(a: str, b: str):
    """Population count of the XOR of two sketch columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows of ``u, v, left, right`` (texts) whose shingle sets are similar enough: ``u, v``."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.bounded(rows, "left", 4 << 20):
            (a, i), (b, j) = (sets_of(*shingles_of(batch.column(c))[:2]) for c in ("left", "right"))
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return pairs.select("u", "v", "left", "right").mapInArrow(run, "u bigint, v bigint")


def _links_in_block(group: pd.DataFrame, percent: int, limit: int) -> pd.DataFrame:
    """Links that join different components of one block: its strays against all its members.

    Pairs that this block has already joined are not held against each other again.
    """
    node, comp, stray = group["node"].to_numpy(), group["comp"].to_numpy(), group["stray"].to_numpy(bool)
    sketch = np.stack(group["sketch"].to_numpy()).view(np.uint64)
    hashes, starts = sets_of(*shingles_of(pa.array(group["text"], pa.string()))[:2])
    sizes, starts = np.diff(starts), starts[:-1]
    _, codes = np.unique(hashes, return_inverse=True)
    present = np.zeros(int(codes.max()) + 1, np.int64)
    comp = np.unique(comp, return_inverse=True)[1]
    out = []
    for i in np.flatnonzero(stray):
        small, big = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        others = np.flatnonzero((comp != comp[i]) & (100 * small >= percent * big))
        others = others[np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1) <= limit]
        if not len(others):
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        present[mine] = 1
        both = np.add.reduceat(present[codes[batches.gather(starts[others], sizes[others])]], np.cumsum(sizes[others]) - sizes[others])
        present[mine] = 0
        for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)]:
            if comp[j] != comp[i]:
                out.append((node[i], node[j]))
                comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """``key, n_shingles, component_id, kept``: one row per row of ``docs``.

    Texts are linked when 100 times the shared shingles are at least ``percent`` times all their shingles. ``component_id``
    is the smallest key that can be reached over links, ``kept`` says that it is the row's own. Null and empty texts have no
    shingles and no links. Rows that share a key are one document: what one is linked with, all are. A null key stands
    alone: its component is null and it is kept. ``key`` is an integer; other columns are not read.
    """
    source = docs.select(F.col(key).cast("bigint").alias(key), text)
    signed = materialise(signatures(source, key, text), "signatures")
    # one node per word sequence: the smallest key with it
    sequence = ["sequence", "sequence2", "n_shingles"]
    linked = signed.filter(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    first = materialise(linked.groupBy(*sequence).agg(F.min(key).alias("node")), "nodes")
    copies = linked.select(key, *sequence).join(first, sequence).select(F.col(key).alias("u"), F.col("node").alias("v")).filter("u <> v").distinct()
    nodes = linked.join(first.withColumnRenamed("node", key), [key, *sequence], "left_semi").select(F.col(key).alias("node"), "n_shingles", "bands", "sketch")
    nodes = nodes.dropDuplicates(["node", "n_shingles", "bands"])

    # each text and the smallest text of every bucket it is in
    banded = materialise(nodes.select("node", F.explode("bands").alias("band")), "bands")
    shared = banded.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("band", "pivot")
    pairs = materialise(banded.join(shared, "band").select("node", "pivot").filter("node <> pivot").distinct(), "pairs")
    named = pairs.select("node").union(pairs.select("pivot")).distinct()
    # joins that carry texts are sort-merge joins at every size: the text side is never small
    texts = source.filter(F.col(key).isNotNull()).join(named.withColumnRenamed("node", key).hint("merge"), key, "left_semi").dropDuplicates([key, text])
    limit = most_flips(percent)
    sketches = nodes.select("node", "sketch")
    near = pairs.join(sketches.withColumnRenamed("sketch", "a"), "node").join(sketches.withColumnsRenamed({"node": "pivot", "sketch": "b"}), "pivot")
    near = near.filter(flips_between("a", "b") <= limit).select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    wanted = materialise(texts.select(F.col(key).alias("node"), F.col(text).alias("text")).join(sketches, "node"), "texts")
    own = wanted.select("node", "text")
    with_left = near.hint("merge").join(own.withColumnsRenamed({"node": "u", "text": "left"}), "u")
    links = materialise(confirmed(with_left.hint("merge").join(own.withColumnsRenamed({"node": "v", "text": "right"}), "v"), percent), "confirmed")
    formed = materialise(components(links, "u", "v"), "formed")

    # per smallest text: what is outside its component is held against the whole group
    members = pairs.unionByName(pairs.select(F.col("pivot").alias("node"), "pivot").distinct())
    in_part = members.join(formed, "node", "left").select("node", "pivot", F.coalesce("component", "node").alias("comp"))
    in_part = materialise(in_part, "members")
    largest = in_part.groupBy("pivot", "comp").agg(F.count("*").alias("m")).groupBy("pivot").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("parts"))
    mixed_groups = in_part.join(largest.filter("parts > 1"), "pivot").select("pivot", "node", "comp", (F.col("comp") != F.col("main")).alias("stray"))
    strays = links_across(mixed_groups, wanted, percent, limit)
    everything = copies.unionByName(links).unionByName(strays)
    parts = components(everything, "u", "v")
    return signed.select(key, "n_shingles").join(parts.withColumnRenamed("node", key), key, "left").select(
        key, "n_shingles", F.coalesce("component", key).alias("component_id"), F.coalesce(F.coalesce("component", key) == F.col(key), F.lit(True)).alias("kept"))


def links_across(groups: DataFrame, wanted: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links between components inside each pivot's group; blocks of strays meet blocks of members.

    ``groups``: ``pivot, node, comp, stray``. A block holds about ``BLOCK_BYTES`` of text, however large the group is.
    """
    rows = materialise(groups.hint("merge").join(wanted, "node").withColumn("_size", F.octet_length("text")), "groups")
    weight = rows.groupBy("pivot").agg(
        F.ceil(F.sum("_size") / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(F.col("stray"), F.col("_size"))) / F.lit(BLOCK_BYTES)).cast("int").alias("stray_blocks"))
    dealt = rows.join(weight, "pivot").withColumns({
        "x": F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"), "y": F.pmod(F.xxhash64("node", F.lit(2)), F.col("stray_blocks")).cast("int")})
    # as a member it meets every block of strays; as a stray it also meets every block of members
    meeting = F.transform(F.sequence(F.lit(0), F.col("stray_blocks") - 1), lambda y: F.struct(F.col("x").alias("x"), y.alias("y")))
    going = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("x"), F.col("y").alias("y")))
    places = F.when(F.col("stray"), F.array_union(meeting, going)).otherwise(meeting)
    spread = dealt.withColumn("_at", F.explode(places)).select(
        "pivot", "_at.x", "_at.y", "node", "comp", (F.col("stray") & (F.col("y") == F.col("_at.y"))).alias("stray"), "sketch", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return _links_in_block(group, percent, limit)
        finally:
            batches.trim()

    return spread.groupBy("pivot", "x", "y").applyInPandas(run, "u bigint, v bigint")
