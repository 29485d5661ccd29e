"""What the operators of this subpackage share: Arrow batches of bounded size, list gathering, pieces of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one Python batch holds at most, unless a single text is longer.
BATCH_BYTES = 4 << 20

#: Characters that one or another pattern counts as white space.
SPACES = frozenset(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most ``limit`` bytes of text, one row at least.

    What the task leaves unused goes back to the system in the end: workers live on and serve other stages.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def trim() -> None:
    """Give memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator than glibc's
        pass


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()


def flat_list(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The lists' values in one array, and where each list starts (one more entry for the end)."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + sizes[i] - 1``, one run after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total, dtype=np.int64)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (runs of other than ASCII white space) as codes, where each text's codes start, and the distinct words."""
    flat, starts = flat_list(pc.ascii_split_whitespace(texts))
    filled = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(filled).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[starts], coded.dictionary


def ascii_word(piece: str) -> list[str] | None:
    """Pre-tokens of a piece that is an ASCII word with at most one comma or full stop behind, else None."""
    word, mark = (piece[:-1], piece[-1:]) if piece[-1:] in (",", ".") else (piece, "")
    if word.isascii() and word.removeprefix(" ").isalpha():
        return [word, mark] if mark else [word]
    return None


class Pieces:
    """Values of whole texts from the values of their pieces, each distinct piece worked out once.

    A single space that other than white space follows always begins a byte-level BPE pre-token, so what stands between
    such spaces is independent. ``learn`` maps pieces (with their leading space) to bytes, ``whole`` maps a text in which a
    space stands before white space, at the end, or next to ``special``. ``begin`` maps the pieces that texts begin with, which
    have no space before them (``learn`` if not given). ``limit``: pieces kept; then it starts anew.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], special: str = "", limit: int = 500_000,
                 begin: Callable[[list[str]], list[bytes]] | None = None):
        self.learn, self.whole, self.special, self.limit, self.begin = learn, whole, special, limit, begin or learn
        self.known: dict[str, bytes | None] = {}

    def _odd(self, part: str) -> bool:
        return not part or part[0] in SPACES or bool(self.special) and self.special in part

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        split = [t.split(" ") for t in texts]
        missing = [p for p in set().union(*split) if p not in known]
        plain = [p for p in missing if not self._odd(p)]
        known.update(dict.fromkeys(missing))
        for i in range(0, len(plain), 100_000):
            part = plain[i : i + 100_000]
            known.update(zip(part, self.learn([" " + p for p in part])))
        out = []
        first = self.begin([parts[0] if not self._odd(parts[0]) else "" for parts in split])
        for text, parts, start in zip(texts, split, first):
            if parts[0] and self._odd(parts[0]):
                out.append(self.whole(text))
                continue
            parts[0] = start
            try:
                out.append(start + b"".join([known[p] for p in islice(parts, 1, None)]))
            except TypeError:  # a piece that isn't independent has no value
                out.append(self.whole(text))
        return out
