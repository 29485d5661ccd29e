"""Merkle manifests and spelling variants against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docketflow.llm import merkle, permuterm, queries

SMALL = "/root/testdata/sf0.001"


def _hash(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _leaf(row):
    return _hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _plain_manifest(rows, arity):
    """doc_id, leaf, subroot, root, siblings' digest of each row (doc_id, source, lang, n_chars, text); and folding with another leaf."""
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([_hash(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        paths = []
        for i in range(len(nodes)):
            path = []
            for level in levels[:-1]:
                start = i // arity * arity
                run = level[start : start + arity]
                path.append((i - start, run[: i - start] + run[i - start + 1 :]))
                i //= arity
            paths.append(path)
        return levels[-1][0], paths

    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = []
    for g in order:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        found.append((ordered, *tree([_leaf(r) for r in ordered])))
    if not found:
        return []
    root, above = tree([subroot for _, subroot, _ in found])
    out = []
    for (ordered, subroot, paths), upper in zip(found, above):
        for row, path in zip(ordered, paths):
            path = path + upper
            tampered = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                tampered = (*row[:3], row[3] + 1, row[4])
            node = _leaf(tampered)
            for at, others in path:
                node = _hash(*others[:at], node, *others[at:])
            out.append((row[0], _leaf(row), subroot, root, _hash(*(x for _, others in path for x in others)), node, node == root))
    return out


def _manifest(docs, arity):
    other = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, merkle.leaf("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    proofs = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], arity=arity, carried={"tampered": other})
    tested = merkle.verified(proofs.withColumn("tested", F.coalesce("tampered", "leaf")), leaf="tested").collect()
    return collections.Counter((r["doc_id"], *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "siblings_digest", "folded_root")),
                                r["folded_root"] == r["root"]) for r in tested)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, _g string"


@pytest.mark.parametrize("arity, block", [(2, 4), (3, 512)])
def test_manifest(spark, monkeypatch, arity, block):
    """Trees of several rounds, nulls everywhere, repeated rows and ids, empty and long texts, clashing extra columns."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rnd = random.Random(arity)
    rows = [(i, rnd.choice(["s", None, ""]), rnd.choice(["en"] * 6 + ["de", "é", "", None]), rnd.choice([None, 5, 7]), rnd.choice(["", None, "text", "ß:1"])) for i in range(150)]
    rows += [rows[3], rows[3], (rows[3][0], "other", *rows[3][2:]), (None, None, None, None, None), (None, None, "en", 1, "x"), (9000, "s", "xx", 3, "long" * 300_000)]
    docs = spark.createDataFrame([(*r, "d", "g") for r in rows], SCHEMA).repartition(4)
    assert _manifest(docs, arity) == collections.Counter(_plain_manifest(rows, arity))


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 2, "x")], [(1, "a", "en", 2, "x"), (2, "a", "de", 2, "x")], [(1, "a", None, 2, None), (2, "a", None, None, "x")]])
def test_manifest_of_few_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "d", "g") for r in rows], SCHEMA)
    assert _manifest(docs, 2) == collections.Counter(_plain_manifest(rows, 2))


def test_manifest_refuses_clashes(spark):
    docs = spark.createDataFrame([(1, "en", "x")], "root bigint, lang string, text string")
    with pytest.raises(ValueError):
        merkle.manifest(docs, ["text"], key="root")
    with pytest.raises(ValueError):
        merkle.verified(docs.select(F.lit(b"").alias("leaf"), F.lit(b"").alias("proof"), "root", F.lit(1).alias("FOLDED_ROOT")))


def test_merkle_query(spark):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op12_merkle(spark, SMALL).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(_plain_manifest(rows, 2))
    assert got[0].asDict().keys() == {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain_groups(counts, ratio=2):
    form, near = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if _near(v, w)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, near[w], counts[form[w]] if form[w] is not None else None))
    return out


def _words(seed, size, alphabet="abÀ", longest=7):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, longest + 1))) for _ in range(size)}
    return {w: 2 ** rnd.randrange(12) + rnd.randrange(2) for w in sorted(words)}


@pytest.mark.parametrize("seed, size, batch", [(1, 200, 10_000), (2, 200, 7)])
def test_groups_and_pairs(spark, seed, size, batch):
    """Dense words with runs of equal letters and ties; groups that cross batches; one prefix for many words."""
    counts = _words(seed, size) | {c + "xyzw": 3 for c in "abcdefghijklmnop"} | {"xyzw": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = permuterm.grouped(words).collect()
        pairs = [tuple(r) for r in permuterm.neighbours(words).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(counts) and {tuple(r) for r in got} == _plain_groups(counts)
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in counts for b in counts if _near(a, b)}


def test_long_paths_and_empty(spark):
    counts = {"a" * k: 2 ** (40 - k) for k in range(1, 40)}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert {tuple(r) for r in permuterm.grouped(words).collect()} == _plain_groups(counts)
    assert permuterm.grouped(words.limit(0)).collect() == []
    assert permuterm.neighbours(words.limit(0)).collect() == []
    with pytest.raises(ValueError):
        permuterm.grouped(words, ratio=1)


def _plain_counts(rows):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_words_of_rough_rows(spark):
    rnd = random.Random(4)
    pool = ["Haus", "HAUSES", "hauses", "hause", "É×tages", "étages", "words", "word", "wörds", "a1bcdef", "straße", "naïve"]
    rows = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(60)))) for i in range(200)]
    rows += [(3, None), (None, "hauses, hauses"), (None, ""), (7, "x" * 400_000 + " words " * 50_000), rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n string").repartition(3)
    words = permuterm.vocabulary(permuterm.runs(docs.select("doc_id", "text")).select(queries._misspelt("doc_id", "word").alias("word")))
    want = _plain_counts(rows)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert permuterm.vocabulary(permuterm.runs(docs).limit(0)).collect() == []
    with pytest.raises(ValueError):
        permuterm.runs(docs.withColumnRenamed("n", "Word"))


def test_permuterm_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op11_permuterm(spark, SMALL).collect()
    assert {tuple(r) for r in got} == _plain_groups(_plain_counts(rows)) and len(got) == len(_plain_counts(rows))
