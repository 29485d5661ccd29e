"""Byte-level BPE through sentencepiece: a model serialised straight from a rank file; ids back to bytes by the inverse map.

The model's pieces are the vocabulary's byte strings with each byte written as one character, their scores the negative
ranks, the normaliser the identity. Merging the best-scored neighbours first is then the merging by lowest rank that the
rank file defines. Pre-tokens are cut by the tokenizer's pattern first and encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame, types as T

from docketflow.llm import batches, pieces

#: Pieces of text that don't stand alone.
STRANGE = pieces.strange_pattern([])
#: Where the 256 bytes go: characters that sentencepiece passes through unchanged.
FIRST_CHARACTER = 0x4E00


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in rank order; ranks have to run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def as_characters(raw: bytes) -> str:
    """Each byte as one character."""
    return (np.frombuffer(raw, dtype=np.uint8).astype("<u2") + np.uint16(FIRST_CHARACTER)).tobytes().decode("utf-16-le")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | np.float32) -> bytes:
    """One protocol buffer field: bytes length-delimited, numbers as varint, float32 as four bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, np.float32):
        return _varint(number << 3 | 5) + value.tobytes()
    return _varint(number << 3) + _varint(value)


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2  # fixed values of sentencepiece's model format
    out = [_field(1, _field(1, as_characters(token).encode()) + _field(2, np.float32(-rank)) + _field(3, normal))
           for rank, token in enumerate(vocabulary)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, np.float32(0)) + _field(3, unknown)))
    out.append(_field(2, _field(3, bpe) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary))
                      + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes texts; one per worker."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.ranks = {token: [rank] for rank, token in enumerate(vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(vocabulary))
        self.split = regex.compile(pattern).findall
        self.pool = pieces.Pool(self.ask, self._cuts())

    def _cuts(self) -> bool:
        """Whether the pattern cuts words, marks and lines as it is done here, tried on all their letters."""
        letters = [c for c in map(chr, range(65, 256)) if regex.fullmatch(f"[{pieces.LETTERS}]", c)]
        return all(self.split("".join(parts)) == parts for trial in pieces.trials(letters, lines=True)
                   for parts in (trial, *([[" " + trial[0], *trial[1:]]] * (trial[0] != "\n"))))

    def pre_tokens(self, wanted: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens: whole vocabulary entries by look-up, others by the model."""
        raws = [p.encode() for p in wanted]
        found = dict(zip(wanted, map(self.ranks.get, raws)))
        rest = [(p, raw) for p, raw in zip(wanted, raws) if found[p] is None]
        if rest:
            mapped, ends = as_characters(b"".join([raw for _, raw in rest])), list(accumulate(len(raw) for _, raw in rest))
            found.update(zip([p for p, _ in rest], self.model.encode([mapped[a:b] for a, b in zip([0, *ends], ends)], num_threads=1)))
        return found

    def ask(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return pieces.flat(self.lists([batches.ascii_word(piece) or self.split(piece) for piece in wanted]))

    def lists(self, cut: list[list[str]]) -> list[list[int]]:
        known = self.pre_tokens(list(dict.fromkeys(chain.from_iterable(cut))))
        return [known[parts[0]] if len(parts) == 1 else list(chain.from_iterable([known[p] for p in parts])) for parts in cut]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and each text's number of ids; null is empty."""
        return pieces.spaced(self.pool, pc.fill_null(texts, ""), STRANGE, lambda odd: self.lists([self.split(t) for t in odd]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.vocabulary[i] for i in ids.tolist()])


_CODECS: dict = {}


def codec(vocabulary_file: str, pattern: str) -> Codec:
    """The worker's codec for a file that was added to the session, or for a path that every machine has."""
    key = (vocabulary_file, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(vocabulary_file), pattern)
    return _CODECS[key]


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def _free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the input already has {sorted(taken)}: choose other names for the output")


def encode(docs: DataFrame, vocabulary_file: str, pattern: str, text: str = "text", ids: str = "ids", same: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text``; a null or empty text gives an empty list.

    ``same`` names a column that says whether the ids decode to the text, null being empty. ``vocabulary_file`` is a path that every
    machine has. Rows, order and other columns stay; ``ids`` and ``same`` must be new names.
    """
    _free(docs, ids, *[same] * bool(same))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_file, pattern)
        for batch in batches.bounded(rows, text, pieces.TEXT_BYTES):
            flat, sizes = own.encode(batch.column(text))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            added = {ids: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat.astype("<i4")))}
            if same:
                raws = pc.fill_null(batch.column(text), "").cast(pa.binary())
                added[same] = pa.array([own.decode(flat[a:b]) == raw.as_py() for a, b, raw in zip(starts, starts[1:], raws)], pa.bool_())
            yield _with(batch, **added)
        own.pool.release()

    added_fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(same, T.BooleanType())] if same else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added_fields]))


def decode(tokens: DataFrame, vocabulary_file: str, pattern: str, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that ``ids`` stand for; a null list gives empty bytes. ``raw`` must be a new name."""
    _free(tokens, raw)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_file, pattern)
        for batch in rows:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                yield _with(part, **{raw: pa.array([own.decode(np.array(x or [], "<u4")) for x in part.column(ids).to_pylist()], pa.binary())})

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(raw, T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: ``key, n_tokens, ids_sha256, decoded_sha256``.

    The ids hash as little-endian unsigned 32-bit integers. Null and empty texts have 0 tokens; repeated rows stay.
    """
    source = docs.select(key, text)
    kind = source.schema[key].dataType

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_file, pattern)
        for batch in batches.bounded(rows, text, pieces.TEXT_BYTES):
            flat, sizes = own.encode(batch.column(text))
            ends = np.cumsum(sizes)
            each = [flat[a:b] for a, b in zip(ends - sizes, ends)]
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array(sizes), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string()),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in each], pa.string()),
            ], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        own.pool.release()

    return source.mapInArrow(run, T.StructType([
        T.StructField(key, kind), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
