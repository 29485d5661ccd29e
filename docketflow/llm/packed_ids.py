"""Token ids in 64-bit words: Simple-8b coding, and token files whose documents stand in ascending key order.

A word's top four bits select how many values it holds and how wide they are. Ids are coded in blocks of 512 that start at
a word of their own; the words at which blocks start are stored, so all blocks of a page are decoded side by side. A value
that needs more than 60 bits is an escape: a word with selector 15 that says so, then the value itself as a whole word.

A token file is a Parquet file of pages. A page holds whole documents, about a million ids, and has ``keys, sizes`` (ids per
document), ``words`` and ``starts`` (first word of each block), both as little-endian binary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from docketflow.llm import batches, library_ids, pieces
from docketflow.session import scratch_path

#: (values, bits) by selector 0 to 14; 15 is the escape. Fixed values of the format.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
#: One value of up to 60 bits shares the escape's selector; its lowest bits tell which it is: see ``pack``.
ESCAPE = 15
BLOCK = 512
PAGE_IDS = 1 << 20


def _runs(fits: np.ndarray, count: int) -> np.ndarray:
    """Whether the ``count`` values from each place on all fit, along the last axis; places past the end fit."""
    have, out = 1, fits
    while have < count and out.any():
        step = min(have, count - have)
        shifted = np.ones_like(out)
        shifted[:, :-step] = out[:, step:]
        out = out & shifted
        have += step
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code unsigned 64-bit values: the words, and the word at which each block of 512 values starts.

    Selector 15 with payload 0 announces that the next word is one raw value of any size. Values wider than 30 bits
    take this way; token ids never do.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + 240), np.uint64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    # the most values that one word can take from each place on; what lies past a block's end counts as zero
    best = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    own = grid[:, :BLOCK]
    widths = np.frexp(own.astype(np.float64))[1].astype(np.uint8)
    least, most = int(widths.min()), int(widths.max())
    for selector in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[selector]
        if most <= bits:
            best[:] = selector
        elif least <= bits:
            best[_runs(widths <= bits, count)] = selector
    steps = np.array([c for c, _ in SELECTORS] + [1])
    line, place = np.arange(blocks), np.zeros(blocks, np.int64)
    taken = np.zeros((blocks, BLOCK), bool)
    while len(line):
        taken[line, place] = True
        place = place + steps[best[line, place]]
        going = place < np.minimum(BLOCK, n - line * BLOCK)
        line, place = line[going], place[going]
    line, place = np.nonzero(taken)
    s = best[line, place]
    width = np.where(s == ESCAPE, 2, 1)
    at = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    flat, first = grid.ravel(), line * grid.shape[1] + place
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(s == selector)
        word, start = np.full(len(mine), selector << 60, np.uint64), first[mine]
        for k in range(count if bits else 0):
            word |= flat[start + k] << np.uint64(k * bits)
        words[at[mine]] = word
    raw = np.flatnonzero(s == ESCAPE)
    words[at[raw]] = ESCAPE << 60
    words[at[raw] + 1] = flat[first[raw]]
    return words, at[np.concatenate([[True], line[1:] != line[:-1]])]


def unpack(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that ``pack`` coded; all blocks side by side."""
    if not n:
        return np.zeros(0, np.uint64)
    counts = np.array([c for c, _ in SELECTORS] + [1])
    # an escape's second word is data: found block by block in step with the escapes before it
    head = np.ones(len(words), bool)
    s = (words >> np.uint64(60)).astype(np.int64)
    for i in np.flatnonzero(s == ESCAPE):
        if head[i]:
            head[i + 1] = False
    block = np.searchsorted(starts, np.arange(len(words)), side="right") - 1
    s, block, at = s[head], block[head], np.flatnonzero(head)
    each = counts[s]
    before = np.cumsum(each) - each
    first = np.concatenate([[True], block[1:] != block[:-1]])
    place = before - before[first][block] + block * BLOCK
    out = np.zeros(len(starts) * BLOCK + 240, np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(s == selector)
        mask = np.uint64((1 << bits) - 1)
        last = block[mine] * BLOCK + BLOCK
        for k in range(count if bits else 0):
            to = place[mine] + k
            inside = to < last
            out[to[inside]] = (words[at[mine[inside]]] >> np.uint64(k * bits)) & mask
    raw = np.flatnonzero(s == ESCAPE)
    out[place[raw]] = words[at[raw] + 1]
    return out[:n]


PAGE = "file int, page int, keys array<bigint>, sizes array<bigint>, words binary, starts binary"
LISTING = "file int, page int, place int, {key} bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, end_id: int, key: str = "doc_id", text: str = "text",
                      files: int | None = None) -> None:
    """Encode ``text`` (null: empty), append ``end_id`` to each document and write token files in ascending ``key`` order.

    Null keys come first. Rows of one key stand next to each other, ordered by text size; equal keys may go on in the next
    file. ``key`` is an integer; other columns are not read. ``files`` defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["_key", "_size", "_row"]
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).select(
        "_key", "_text", F.coalesce(F.octet_length("_text"), F.lit(0)).alias("_size"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("_key", "_text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        own = library_ids.encoder(tokenizer_file)
        page, keys, sizes, ids, held = 0, [], [], [], 0

        def full() -> pa.RecordBatch:
            words, starts = pack(np.concatenate(ids).astype(np.uint64))
            return pa.RecordBatch.from_arrays([
                pa.array([file], pa.int32()), pa.array([page], pa.int32()), pa.array([[k for part in keys for k in part]], pa.list_(pa.int64())),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()]), pa.array([starts.astype("<i8").tobytes()])],
                ["file", "page", "keys", "sizes", "words", "starts"])

        for batch in batches.bounded(parts, "_text", pieces.TEXT_BYTES):
            found, lengths = pieces.with_end(*own.encode(batch.column("_text")), end_id)
            keys.append(batch.column("_key").to_pylist())
            sizes.append(lengths)
            ids.append(found)
            held += len(ids[-1])
            if held >= PAGE_IDS:
                yield full()
                page, keys, sizes, ids, held = page + 1, [], [], [], 0
        if held:
            yield full()
        own.pool.release()

    ordered.mapInArrow(run, PAGE).write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document of the files: ``key, start`` (ids of all documents before it), ``n_tokens, ids_crc32, ids``."""
    return _located(spark, path, key, with_ids=True)


def list_token_files(spark, path: str, key: str = "doc_id") -> DataFrame:
    """As ``read_token_files``, without the ids themselves."""
    return _located(spark, path, key, with_ids=False)


def _located(spark, path: str, key: str, with_ids: bool) -> DataFrame:
    schema = LISTING.format(key=key) + (", ids array<bigint>" if with_ids else "")
    pages = spark.read.schema(PAGE).parquet(path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, sizes = row.column("keys").flatten(), row.column("sizes").flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                words = np.frombuffer(row.column("words")[0].as_buffer(), "<u8")
                starts = np.frombuffer(row.column("starts")[0].as_buffer(), "<i8")
                ids = unpack(words, starts, int(ends[-1]) if len(ends) else 0)
                raw = memoryview(ids.astype("<u4")).cast("B")
                spans = zip((ends - sizes).tolist(), ends.tolist())
                columns = [pa.array(np.full(len(sizes), row.column("file")[0].as_py(), np.int32)), pa.array(np.full(len(sizes), row.column("page")[0].as_py(), np.int32)),
                           pa.array(np.arange(len(sizes), dtype=np.int32)), keys, pa.array(ends - sizes), pa.array(sizes),
                           pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["file", "page", "place", key, "local_start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    # ids before each page: a running sum over one small row per page, file by file, and one row per file
    per_page = pages.select("file", "page", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    per_file = per_page.groupBy("file").agg(F.sum("n").alias("n"))
    offsets = per_file.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    within = per_page.select("file", "page", (F.sum("n").over(Window.partitionBy("file").orderBy("page")) - F.col("n")).alias("inside"))
    found = pages.mapInArrow(run, schema).join(within, ["file", "page"]).join(offsets, "file")
    return found.select(key, (F.col("before") + F.col("inside") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file_path(spark) -> str:
    """A fresh place in the shared folder."""
    return scratch_path(spark, "tokens")
