"""Best-fit packing: documents' token ids into as few sequences of a fixed size as best-fit decreasing finds.

Best-fit decreasing takes pieces from the longest to the shortest and puts each into the open sequence with the least room
that still holds it. Where a piece goes depends only on its length, and lengths are bounded by the sequence size, so the
whole plan follows from how many pieces there are of each length: the driver gets that table, at most one row per length,
however large the corpus. Sequences with the same room are interchangeable and move in runs of consecutive numbers. A segment
tree over the rooms 0 to size finds the tightest one; equal lengths are placed run by run, with the result that
placing them one by one has. The plan then is a table of steps, each a range of ranks among the pieces of one length.

Ranks come from counts by file and length, so a length that a third of all pieces have is numbered by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docketflow.llm import batches, library_ids, pieces as P
from docketflow.session import materialise

SEQUENCE = 2048
#: Ranks within one length stay below this.
MOST_RANKS = 1 << 48


class OpenSequences:
    """Runs of open sequences by their room, under a segment tree that tells which subtrees hold any."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int, value: int) -> None:
        node = room + self.leaves
        self.some[node] = value
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """``count`` sequences from number ``first`` on have this room; full ones are not kept."""
        if room and count:
            self.runs[room].append((first, count))
            if len(self.runs[room]) == 1:
                self._mark(room, 1)

    def tightest(self, length: int) -> int | None:
        """The least room of an open sequence that holds ``length``: up from the leaf to a subtree on the right, then down."""
        node = length + self.leaves
        if not self.some[node]:
            while node > 1 and (node % 2 or not self.some[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, 0)
        return run


def plan(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Steps of best-fit decreasing: rows of ``length, first rank, pieces, pieces per sequence, first sequence, offset``.

    ``counts``: pieces by length, 1 to ``size``. In a step, pieces of one length from the first rank on go in order into
    consecutive sequences, so many into each. Every length splits one run at most, so the steps grow with ``size`` only.
    """
    opened, steps, following = OpenSequences(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = opened.tightest(length)
            if room is None:
                room, first, count = size, following, -(-left // (size // length))
                following += count
            else:
                first, count = opened.take(room)
            each = room // length
            filled = min(count, left // each)
            for sequences, per in ((filled, each), (int(filled < count and left > filled * each), left - filled * each)):
                if sequences:
                    steps.append((length, rank, sequences * per, per, first, size - room))
                    opened.add(room - per * length, first, sequences)
                    rank, left, first, count = rank + sequences * per, left - sequences * per, first + sequences, count - sequences
            opened.add(room, first, count)
    return np.array(steps, np.int64).reshape(-1, 6)


def _free(key: str, *names: str) -> None:
    if key.lower() in names:
        raise ValueError(f"the key column can't be called {key}")


PIECE = "{key} bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _file int, _rank bigint"
PLACE = "{key} bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, size: int = SEQUENCE, key: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Documents' ids with ``end_id`` behind, only those longer than ``size`` cut: one row per piece.

    ``_file`` numbers the task, ``_rank`` the pieces of one length within it; store the rows before use.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, own, seen = TaskContext.get().partitionId(), library_ids.encoder(tokenizer_file), np.zeros(size + 1, np.int64)
        for batch in batches.bounded(rows, text, P.TEXT_BYTES):
            ids, sizes = P.with_end(*own.encode(batch.column(text)), end_id)
            number = -(-sizes // size)
            doc = np.repeat(np.arange(len(sizes)), number)
            piece = batches.gather(np.zeros(len(sizes), np.int64), number)
            start = piece * size
            length = np.minimum(sizes[doc] - start, size)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=size + 1)
            ends = np.cumsum(length)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist())]
            columns = [batch.column(key).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                       pa.array(np.full(len(doc), file, np.int32)), pa.array(rank)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32", "_file", "_rank", *["ids"] * with_ids])
        own.pool.release()

    source = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias(text))
    return source.mapInArrow(run, PIECE.format(key=key) + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, size: int = SEQUENCE, key: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Every piece of every document and its place: ``key, piece, start, length, ids_crc32, sequence_id, offset``, with ``ids`` if asked.

    A null text is empty: its one piece is ``end_id`` alone. Null keys and repeated rows are packed like others. Other
    columns are not read; ``key`` may not bear the name of a result column. An empty table gives an empty one.
    """
    _free(key, "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "_file", "_rank")
    stored = materialise(pieces(docs, tokenizer_file, end_id, size, key, text, with_ids), "pieces")
    counts = materialise(stored.groupBy("_file", "length").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_file")) - F.col("n")
    located = stored.join(counts.select("_file", "length", before.alias("_before")), ["_file", "length"])
    # one row per length at most, so no more than `size` rows
    steps = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    places = steps[:, 0] * MOST_RANKS + steps[:, 1]
    order = np.argsort(places)
    steps, places = steps[order], places[order]

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            step = steps[np.searchsorted(places, length * MOST_RANKS + rank, side="right") - 1]
            within = rank - step[:, 1]
            chosen = batch.select([key, "piece", "start", "length", "ids_crc32"]).columns
            found = [pa.array(step[:, 4] + within // step[:, 3]), pa.array(step[:, 5] + within % step[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*chosen, *found, *([batch.column("ids")] if with_ids else [])],
                                             [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids])

    ranked = located.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_file")
    return ranked.mapInArrow(place, PLACE.format(key=key) + (", ids array<int>" if with_ids else ""))


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sequences ready for training: ``sequence_id, ids``, and ``parts``: ``key, piece, offset, length`` of what stands in each."""
    part = F.struct("offset", key, "piece", "length", "ids")
    rows = F.array_sort(F.collect_list(part))
    return packed.groupBy("sequence_id").agg(rows.alias("_rows")).select(
        "sequence_id", F.flatten("_rows.ids").alias("ids"),
        F.transform("_rows", lambda r: F.struct(r[key].alias(key), r["piece"].alias("piece"), r["offset"].alias("offset"), r["length"].alias("length"))).alias("parts"))
