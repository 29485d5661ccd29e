"""Token counts under a unigram model: forward scores on a trie of distinct pre-tokens, once per shared prefix.

A text is cut into pre-tokens; each is segmented into vocabulary pieces so that the sum of the pieces' scores is largest.
The best score of a prefix depends on that prefix alone, so it is worked out once, at the prefix's trie node, for all
pre-tokens that begin with it; a pre-token's token count stands at its terminal node.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from docketflow.llm import batches, byte_bpe

#: Pre-tokens whose counts a worker keeps; then it starts anew, with the same results.
CACHE = 400_000
#: Bytes of a pre-token beyond which the recurrence runs along the word instead of down a trie.
LONG = 64
#: Random 64-bit values of the bytes, from which substring hashes are made.
MIXED = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64)
#: Score of a byte that no piece covers.
UNKNOWN = -1e4


def zipf_scores(vocabulary: list[bytes]) -> dict[bytes, float]:
    """Log probabilities that fall with the rank, as in a Zipf law: ``-log(rank + 2.7) - log(sum)``."""
    total = math.log(sum(1 / (rank + 2.7) for rank in range(len(vocabulary))))
    return {token: -math.log(rank + 2.7) - total for rank, token in enumerate(vocabulary)}


class Segmenter:
    """Counts tokens of many distinct words at once, level by level down their trie."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        by_size: dict[int, list[tuple[int, float]]] = {}
        for token, score in scores.items():
            by_size.setdefault(len(token), []).append((self._hash(token), score))
        self.tables = {}
        for size, entries in by_size.items():
            entries.sort()
            hashes = np.array([h for h, _ in entries], np.uint64)
            if (hashes[1:] == hashes[:-1]).any():
                raise ValueError("two pieces have one hash")
            self.tables[size] = hashes, np.array([s for _, s in entries])

    def _hash(self, token: bytes) -> int:
        """Mixed bytes times powers of an odd number, the last byte's power being 0."""
        out, power, base = 0, 1, int(self.BASE)
        for byte in reversed(token):
            out = (out + int(MIXED[byte]) * power) & 0xFFFFFFFFFFFFFFFF
            power = power * base & 0xFFFFFFFFFFFFFFFF
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; of equal scores the segmentation with fewer tokens counts."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        active, node = np.flatnonzero(sizes), np.zeros(len(words), np.int64)
        parents, edges = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        scores, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        depth = 0
        while len(active):
            depth += 1
            keys, mine = np.unique(node[active] << 8 | flat[begins[active] + depth - 1], return_inverse=True)
            node[active] = mine
            parents.append(keys >> 8)
            edges.append(keys & 255)
            best, few = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
            at, hashed, power = np.arange(len(keys)), np.zeros(len(keys), np.uint64), 1
            for size in range(1, min(depth, self.longest) + 1):
                hashed += MIXED[edges[depth - size + 1][at]] * np.uint64(power)
                at = parents[depth - size + 1][at]
                power = power * int(self.BASE) & 0xFFFFFFFFFFFFFFFF
                if size not in self.tables and size > 1:
                    continue
                hashes, values = self.tables.get(size, (np.zeros(1, np.uint64), np.array([UNKNOWN])))
                place = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
                score = scores[depth - size][at] + np.where(hashes[place] == hashed, values[place], UNKNOWN if size == 1 else -np.inf)
                used = tokens[depth - size][at] + 1
                better = (score > best) | (score == best) & (used < few)
                best, few = np.where(better, score, best), np.where(better, used, few)
            scores.append(best)
            tokens.append(few)
            ended = sizes[active] == depth
            out[active[ended]] = few[node[active[ended]]]
            active = active[~ended]
        return out

    def long_count(self, word: bytes) -> int:
        """The same recurrence along one long word, keeping the last scores only."""
        window, longest, scores = [(0.0, 0)], self.longest, self.scores
        for depth in range(1, len(word) + 1):
            best, tokens = -math.inf, 0
            for size in range(1, min(depth, longest) + 1):
                piece = scores.get(word[depth - size : depth], UNKNOWN if size == 1 else None)
                if piece is None:
                    continue
                score, before = window[-size]
                score += piece
                if score > best or score == best and before + 1 < tokens:
                    best, tokens = score, before + 1
            window.append((best, tokens))
            if len(window) > 4 * longest:
                del window[: 2 * longest]
        return window[-1][1]


class Counter:
    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.segmenter = Segmenter(zipf_scores(vocabulary))
        self.split = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self.pieces = batches.Pieces(self.learn, lambda text: self.learn([text])[0])

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Pre-tokens and tokens of each piece, as two 64-bit integers."""
        cut = [batches.ascii_word(p) or self.split(p) for p in pieces]
        if len(self.words) > CACHE:
            self.words.clear()
        known = self.words
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in known]
        raw = [w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        known.update(zip([new[i] for i in short], self.segmenter.count([raw[i] for i in short]).tolist()))
        known.update((w, self.segmenter.long_count(r)) for w, r in zip(new, raw) if len(r) > LONG)
        return [struct.pack("<qq", len(parts), sum([known[w] for w in parts])) for parts in cut]

    def texts(self, texts: list[str]) -> np.ndarray:
        """Pre-tokens and tokens of each text, one row each."""
        return np.array([np.frombuffer(x, "<i8").reshape(-1, 2).sum(axis=0) for x in self.pieces.texts(texts)], np.int64).reshape(-1, 2)


_COUNTERS: dict = {}


def token_counts(docs: DataFrame, vocabulary_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_pretokens, n_tokens`` of each row; null and empty texts have none. Rows stay as they are, repeated ones too.

    One pass without a shuffle: each batch's distinct new pre-tokens make one trie, of bounded size. Pre-tokens of more than
    64 bytes are scored by the same recurrence outside the trie. Other columns are not read.
    """
    source = docs.select(key, text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (vocabulary_file, pattern)
        own = _COUNTERS.get(name) or _COUNTERS.setdefault(name, Counter(byte_bpe.read_ranks(vocabulary_file), pattern))
        for batch in batches.bounded(rows, text):
            counts = own.texts(batches.texts_of(batch, text))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts[:, 0]), pa.array(counts[:, 1])], [key, "n_pretokens", "n_tokens"])

    return source.mapInArrow(run, T.StructType([
        source.schema[key], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))
