"""Ids by the library piece by piece, and best-fit packing, against plain versions."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docketflow.llm import best_fit, library_ids, pieces, queries

ALPHABET = [*" \n\t\r'sdtmlvre  ,.!aZé中ß12٣\x85\xa0 \x1c<|>😀́ͅİΣ​", "<|endoftext|>", "<|startoftext|>"]
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(30))) for _ in range(n)] + ["a" * 5000, "", " ", "it's  we'll \n x", "Étage, Über. ÿ. Ñu,"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    own, plain = library_ids.TextIds(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert own.library.cuts
    texts = _texts(3000)
    want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    for cuts in (True, False):
        own.library.cuts = own.pool.marks = cuts
        own.pool.clear()
        ids, sizes = own.encode(pa.array([*texts, None]))
        ends = np.cumsum(sizes)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [*want, []]
    ids, sizes = own.encode(pa.array([], pa.string()))
    assert len(ids) == len(sizes) == 0


def _words_and_marks(n, seed=5):
    """Texts of words with marks, line ends, digits and apostrophes around them."""
    rnd = random.Random(seed)
    words, others = ["one", "Two", "Étage", "ÿ", "re", "S", "straße", "ªb", "x7", "中a", "e\u0301"], [*".,!&#*-_<|>~\"(;", "...", "&&&", "\n", "\n", "\n\n", "'s", "'", "7", "\t", "\r\n", "<|endoftext|>"]
    return [" ".join("".join(rnd.choice(words if rnd.random() < 0.5 else others) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_words_between_marks_and_lines(name):
    own, plain, texts = library_ids.TextIds(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name)), _words_and_marks(6000)
    ids, sizes = own.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, end, size, want in zip(texts, ends, sizes, plain.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[end - size : end].tolist() == want.ids, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_asked_for_once_whatever_marks_are_around_them(name):
    own, asked = library_ids.TextIds(public_tokenizers.path(name)), []
    library = own.pool.ask
    own.pool.ask = lambda wanted: (asked.extend(wanted), library(wanted))[1]
    words, marks = ["one", "two", "three", "vier", "fünf"], ["", ".", ",", "!!", "&&&", ",###", "..."]
    for _ in range(2):
        own.encode(pa.array([f"a {word}{mark}{end}{other} b" for word in words for mark in marks for end in ("\n", " ") for other in words]))
    assert len(asked) == len(set(asked)) <= 2 * len(words) + len(marks) + 5


def test_a_full_pool_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 500)
    own, plain = library_ids.TextIds(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(5):
        texts = _words_and_marks(20, seed=i)
        assert own.encode(pa.array(texts))[0].tolist() == [k for t in texts for k in plain.encode(t, add_special_tokens=False).ids]
        assert len(own.pool.known) < 200
    own.pool.release()
    assert not len(own.pool.known) and not own.pool.held


def _plain_best_fit(lengths, size):
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=room.__getitem__)] -= length
        else:
            room.append(size - length)
    return sorted(room)


def test_plan_equals_best_fit_one_by_one():
    rnd = random.Random(1)
    for _ in range(200):
        size = rnd.choice([1, 7, 10, 64, 100])
        lengths = [rnd.randrange(1, size + 1) if rnd.random() < 0.7 else rnd.choice([1, -(-size // 2), size // 3 + 1]) for _ in range(rnd.randrange(200))]
        counts, ranked, held = collections.Counter(lengths), collections.Counter(), collections.defaultdict(list)
        for length, rank, count, each, first, offset in best_fit.plan(counts, size).tolist():
            assert ranked[length] == rank
            ranked[length] += count
            for i in range(count):
                held[first + i // each].append((offset + i % each * length, length))
        assert ranked == counts
        for parts in held.values():
            assert np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() == sorted(at for at, _ in parts)
        assert sorted(size - sum(n for _, n in parts) for parts in held.values()) == _plain_best_fit(lengths, size)


def test_packing_of_rough_rows(spark):
    """Nulls, empty texts, repeated rows, a very long text, a clashing column name, an empty table."""
    long = " ".join("word%d" % (i * i) for i in range(30_000))
    rows = [(i, t, "x") for i, t in enumerate(_texts(300))] + [(7, None, "x"), (None, "some text", None), (7, None, "x"), (900, long, "y"), (901, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string").repartition(5)
    size = 64
    packed = best_fit.pack(docs, WORDS, 0, size=size, with_ids=True)
    got = packed.collect()
    plain = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for key, text, _ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), size):
            part = ids[p : p + size]
            want[key, p // size, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        assert sum(n for _, n in parts) <= size and np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() == sorted(at for at, _ in parts)
    assert sorted(size - sum(n for _, n in parts) for parts in held.values()) == _plain_best_fit([r["length"] for r in got], size)
    whole = best_fit.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in got) and len(whole) == len(held)
    for r in whole:
        for part in r["parts"]:
            assert len(r["ids"][part["offset"] : part["offset"] + part["length"]]) == part["length"]
    assert best_fit.pack(docs.limit(0), WORDS, 0).collect() == []
    with pytest.raises(ValueError):
        best_fit.pack(docs.withColumnRenamed("doc_id", "piece"), WORDS, 0, key="piece")


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_best_fit(spark, sf).collect()
    held = collections.defaultdict(int)
    for r in got:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048 and len(held) == len(_plain_best_fit([r["length"] for r in got], 2048))
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
