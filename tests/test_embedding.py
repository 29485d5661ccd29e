import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.operators import embedding as E


def _chunks(n, max_len):
    ids = [0, *range(10, 10 + n), 2]
    text = ids[1:-1]
    return ids, [[0, *text[i:i + max_len], 2] for i in range(0, len(text), max_len)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 9])
def test_chunk_tokens(one, n):
    ids, expected = _chunks(n, 4)
    got = one(lambda c: E.chunk_tokens(c, 4, first_only=False), [ids], "array<int>")[0]
    assert [r["input_ids"] for r in got] == expected
    assert [r["attention_mask"] for r in got] == [[1] * len(c) for c in expected]
    assert [r["chunk"] for r in got] == list(range(len(expected)))
    first = one(lambda c: E.chunk_tokens(c, 4, first_only=True), [ids], "array<int>")[0]
    assert [r["input_ids"] for r in first] == expected[:1]


def test_pad_batches(spark):
    rows = [(i, list(range(n)), [1] * n) for i, n in enumerate([3, 1, 2, 2, 5])]
    df = spark.createDataFrame(rows, "k int, input_ids array<int>, attention_mask array<int>")
    got = {r["k"]: r for r in E.pad_batches(df, ["k"]).collect()}
    assert [got[i]["batch"] for i in range(5)] == [0, 0, 1, 1, 2]
    assert got[1]["input_ids"] == [0, V.PAD_TOKEN, V.PAD_TOKEN] and got[1]["attention_mask"] == [1, 0, 0]
    assert got[0]["input_ids"] == [0, 1, 2] and got[4]["input_ids"] == [0, 1, 2, 3, 4]


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "k string, vector array<float>")
    assert {r["k"]: r["embedding"] for r in E.mean_pool(df, "k").collect()} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}


LONG = " ".join(["w"] * 198 + ["w."]) + " The cat. A cat cat sat!"


def test_embed_documents_with_the_hashing_encoder(spark):
    df = spark.createDataFrame([("a", LONG), ("b", "too short.")], "k string, text string")
    got = {r["k"]: r["embedding"] for r in E.embed_documents(df, "k", "text", E.hashing_encoder()).collect()}
    expected = [0.0] * 256
    for words in (["the", "cat."], ["a", "cat", "cat", "sat!"]):
        counts = [0.0] * 256
        for w in words:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:2], 16)] += 1
        norm = math.sqrt(sum(c * c for c in counts))
        expected = [e + c / norm / 2 for e, c in zip(expected, counts)]
    assert got["a"] == pytest.approx(expected) and got["b"] is None


def test_embed_documents_with_a_callers_encoder(spark):
    @F.pandas_udf("array<float>")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(len(t)), 1.0])

    df = spark.createDataFrame([("a", LONG)], "k string, text string")
    got = E.embed_documents(df, "k", "text", lambda d: d.withColumn("vector", encode("sentence"))).first()
    assert got["embedding"] == [(8 + 14) / 2, 1.0]


def test_embed_chunks_averages_all_chunks(spark):
    df = spark.createDataFrame([("a", _chunks(5, 4)[0])], "k string, ids array<int>")

    def encode(d):
        return d.withColumn("vector", F.array(F.size("input_ids").cast("double")))

    assert E.embed_chunks(df, "k", "ids", encode, 4, first_only=False).first()["embedding"] == [4.5]
    assert E.embed_chunks(df, "k", "ids", encode, 4, first_only=True).first()["embedding"] == [6.0]
    empty = spark.createDataFrame([("b", [0, 2])], "k string, ids array<int>")
    assert E.embed_chunks(df.union(empty), "k", "ids", encode, 4).orderBy("k").collect()[1]["embedding"] is None


def test_batch_encoder_loads_once_and_sorts(spark):
    def load():
        state = {"calls": 0}

        def predict(sentences):
            state["calls"] += 1
            return np.array([[len(s), state["calls"], len({len(x) for x in sentences})] for s in sentences], float)
        return predict

    df = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(400)], "k int, sentence string").coalesce(1)
    got = E.batch_encoder(load, 50)(df).collect()
    assert all(r["vector"][0] == len(r["sentence"]) for r in got) and len(got) == 400
    # one model saw all eight batches, and each batch had few lengths
    assert max(r["vector"][1] for r in got) == 8 and max(r["vector"][2] for r in got) <= 7
    assert E.batch_encoder(load)(df.limit(0)).collect() == []
