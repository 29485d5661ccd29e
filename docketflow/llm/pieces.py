"""Token ids of whole texts from the ids of their pieces, each distinct piece worked out once.

Texts are cut at spaces side by side and their pieces turned into codes. Distinct pieces are cut further into words and marks; only those
that the worker doesn't know yet are worked out, many in one call. The ids of whole texts are then gathered from the pieces' ids without
touching single tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docketflow.llm import batches

#: Bytes that a worker keeps of pieces and their ids; then it starts anew.
KEPT_BYTES = 64 << 20
#: What a kept piece needs beside its characters and ids: two offsets, and its entry in the table that a look-up builds.
ENTRY_BYTES = 64
#: Pieces that are worked out at once.
AT_ONCE = 20_000
#: Text bytes that a batch holds, unless one text is longer.
TEXT_BYTES = 3 << 20


#: Marks that make one pre-token with all marks next to them, also behind a word of Latin letters, with the tokenizers that say so.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def escaped(characters: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in characters)


#: A word, with or without a space before it.
PLAIN = rf"\A ?[{LETTERS}]+\z"
#: The same with marks behind it or instead, then a line's end with another word and marks behind it.
CUT = rf"\A(?P<space> ?)(?P<word>[{LETTERS}]*)(?P<marks>[{escaped(MARKS)}]*)(?:(?P<line>\n)(?P<word2>[{LETTERS}]*)(?P<marks2>[{escaped(MARKS)}]*))?\z"


def trials(letters: list[str], lines: bool) -> Iterator[list[str]]:
    """Pre-tokens that a tokenizer has to cut their joined text into if words and marks, and ``lines`` if asked for, are known apart."""
    words = ["".join(letters), "re", "s"]
    for word in [*words, *letters]:
        yield [word]
        yield from ([word, mark] for mark in (MARKS if word in words else ".,"))
        if lines:
            yield [word, "\n", word]
            yield [word, ".", "\n", word, "."]
    if lines:
        yield from ([*start, "\n", *rest] for start in ([], ["s"], ["."]) for rest in ([], ["s"], ["."]))
    yield from ([*start, mark + other] for start in ([], ["s"]) for mark in (*MARKS, "") for other in MARKS)
    yield from ([*start, MARKS] for start in ([], ["s"]))


class Pool:
    """Pieces and their ids. ``ask`` gives pieces' ids: flat, and how many each has. With ``marks`` words, marks and lines are known apart."""

    def __init__(self, ask: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], marks: bool):
        self.ask, self.marks = ask, marks
        self.clear()

    def clear(self) -> None:
        self.known, self.ids, self.held = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), 0

    def release(self) -> None:
        """Forget everything at a task's end and give the memory back."""
        self.clear()
        batches.trim()

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Each piece's place in ``ids``; unknown ones are learned. Pieces differ from each other.

        If too much is held it starts anew, and places that were given before don't hold any longer.
        """
        if self.held > KEPT_BYTES:
            self.clear()
        place = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(place.is_null())
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            place[place < 0] = np.arange(len(new)) + len(self.known)
            # through numpy, which is several times faster than to_pylist
            listed = new.to_numpy(zero_copy_only=False).tolist()
            asked = [binary(*self.ask(listed[i : i + AT_ONCE])) for i in range(0, len(listed), AT_ONCE)]
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, *asked])
            self.held += new.nbytes + sum(a.nbytes for a in asked) + ENTRY_BYTES * len(new)
        return place

    def values(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces, each piece's as bytes. Pieces differ; a space that begins one stands before other than white space."""
        pieces = pieces.cast(pa.large_string())
        if not self.marks:
            return self.ids_at(self.find(pieces))
        single = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False).copy()
        others = np.flatnonzero(~single)
        cut = pc.extract_regex(pieces.take(pa.array(others)), CUT)
        single[others[cut.is_null().to_numpy(zero_copy_only=False)]] = True
        space, word, marks, *behind = cut.drop_null().flatten()
        bare = pc.equal(word, "")
        parts = [pieces.filter(pa.array(single)), pc.if_else(bare, word, joined(space, word)), pc.if_else(bare, joined(space, marks), marks), *behind]
        coded = pa.concat_arrays(parts).dictionary_encode()
        place = self.find(coded.dictionary)[coded.indices.to_numpy()]
        first = len(parts[0])
        ids = [self.ids_at(place[:first]), joined(*map(self.ids_at, place[first:].reshape(len(parts) - 1, len(word))))]
        order = np.empty(len(pieces), np.int64)
        order[single], order[~single] = np.arange(first), np.arange(first, len(pieces))
        return pa.concat_arrays(ids).take(pa.array(order))

    def ids_at(self, place: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(place))


def joined(*parts: pa.Array) -> pa.Array:
    """Row by row, all parts in one."""
    return pc.binary_join_element_wise(*parts, pa.scalar(b"" if pa.types.is_large_binary(parts[0].type) else "", parts[0].type))


def binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of ids as little-endian unsigned 32-bit integers, each run's bytes one value."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def gathered(values: pa.Array, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces with these places among ``values``, and how many each run of pieces has that begins at ``starts``."""
    if not len(places):
        return np.zeros(0, "<u4"), np.zeros(len(starts) - 1, np.int64)
    _, ends, ids = values.take(pa.array(places)).buffers()
    ends = np.frombuffer(ends, np.int64, len(places) + 1) // 4
    return np.frombuffer(ids, "<u4", ends[-1]), np.diff(ends[starts])


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and their lengths."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), "<u4", int(sizes.sum())), sizes


def strange_pattern(added: list[str]) -> str:
    """Pieces that don't stand alone: none, or white space, right behind a space; an added token."""
    return rf"\A(?:[{escaped(''.join(sorted(batches.SPACES)))}]|\z)" + "".join("|" + escaped(t) for t in added)


def apart(pool: Pool, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts whose pieces between white space all stand alone."""
    codes, starts, distinct = batches.words(texts)
    return gathered(pool.values(distinct), codes, starts)


def spaced(pool: Pool, texts: pa.Array, strange: str, whole: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts in which a single space that other than white space follows always begins a pre-token.

    A piece is what stands between such spaces, with the space before it. A text with a ``strange`` piece goes ``whole``.
    """
    if not len(texts):
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    flat_pieces, starts = batches.flat_list(pc.split_pattern(texts, " "))
    coded = flat_pieces.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    odd_piece = pc.match_substring_regex(distinct, strange).to_numpy(zero_copy_only=False)[codes]
    # the piece that a text begins with has no space before it and may be empty
    odd_piece[starts[:-1]] &= codes[starts[:-1]] != distinct.index("").as_py()
    odd = np.logical_or.reduceat(odd_piece, starts[:-1])
    begin = np.concatenate([[0], np.cumsum(np.diff(starts)[~odd])])
    if odd.any():
        codes = codes[np.repeat(~odd, np.diff(starts))]
    first = codes[begin[:-1]]
    leading, which = np.unique(first, return_inverse=True)
    needed = np.flatnonzero(np.bincount(codes, minlength=len(distinct)) > np.bincount(first, minlength=len(distinct)))
    values = pool.values(pa.concat_arrays([distinct.take(pa.array(leading)), pc.binary_replace_slice(distinct.take(pa.array(needed)), 0, 0, " ")]))
    place = np.zeros(len(distinct), np.int64)
    place[needed] = np.arange(len(leading), len(values))
    places = place[codes]
    places[begin[:-1]] = which
    ids, sizes = gathered(values, places, begin)
    if not odd.any():
        return ids, sizes
    odd_ids, odd_sizes = flat(whole(texts.filter(pa.array(odd)).to_pylist()))
    all_sizes, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    all_sizes[~odd], all_sizes[odd] = sizes, odd_sizes
    start[~odd], start[odd] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(odd_sizes) - odd_sizes
    return np.concatenate([ids, odd_ids])[batches.gather(start, all_sizes)], all_sizes


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each text's."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
