import math
import random
import re
from collections import Counter

import pytest

from docketflow.operators import sentences as N, vocabulary as W


def _plain_model(texts):
    n, k = Counter(), Counter()
    for text in texts:
        for token in (text or "").split():
            bare = re.sub(r"^[^\w]+|[^\w.]+$", "", token).lower()
            if re.search(r"[^\W\d_]", bare):
                word = bare.removesuffix(".")
                n[word] += 1
                k[word] += bare.endswith(".")
    p = min(max(sum(k.values()) / sum(n.values()), 1e-9), 1 - 1e-9)
    out = {}
    for w in n:
        if k[w]:
            chance = k[w] * math.log(p) + (n[w] - k[w]) * math.log(1 - p)
            always = k[w] * math.log(0.99) + (n[w] - k[w]) * math.log(0.01)
            inner = w.count(".")
            out[w] = (n[w], k[w], 2 * (always - chance) * math.exp(inner - len(w)) * (inner + 1) * float(len(w) - inner) ** -(n[w] - k[w]))
    return {w: x for w, x in out.items() if x[2] >= N.LEAST_SCORE}


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    words = ["court", "held", "appeal", "no", "the", "claim", "costs", "ward", "judge", "order"]
    texts = [None, ""]
    for _ in range(300):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            body = [rnd.choice(words) for _ in range(rnd.randrange(2, 9))]
            if rnd.random() < 0.5:
                body.insert(1, rnd.choice(["v.", "No.", "e.g.", "J.", "(cf."]))
            parts.append(" ".join(body).capitalize() + rnd.choice(".!?"))
        texts.append(rnd.choice([" ", "  ", "\n"]).join(parts))
    return texts


def test_abbreviations_are_learned(spark, corpus):
    df = spark.createDataFrame([(t,) for t in corpus], "text string").repartition(3)
    got = {r["word"]: (r["n"], r["with_stop"], r["score"]) for r in N.abbreviations(df, "text").collect()}
    want = _plain_model(corpus)
    assert {"v", "e.g", "cf"} <= set(want) and not {"court", "appeal", "costs"} & set(want)
    assert got.keys() == want.keys()
    for w in want:
        assert got[w] == pytest.approx(want[w])
    assert N.abbreviations(df.limit(0), "text").collect() == []


@pytest.mark.parametrize("limit", [W.HELD_BYTES, 0])
def test_no_sentence_ends_behind_them(spark, monkeypatch, limit):
    monkeypatch.setattr(W, "HELD_BYTES", limit)
    model = spark.createDataFrame([("v",), ("no",), ("e.g",), (None,)], "word string")
    cases = {
        "Smith v. Jones was heard. See No. 5 of it! Then J. Bloggs left.": ["Smith v. Jones was heard.", "See No. 5 of it!", "Then J. Bloggs left."],
        "It is e.g. this (No. 3) and that.": ["It is e.g. this (No. 3) and that."],
        "Say no! Then go. It ends with v.": ["Say no!", "Then go.", "It ends with v."],
        "One.": ["One."], "": [],
    }
    df = spark.createDataFrame([*((i, t) for i, t in enumerate(cases)), (99, None)], "k int, text string")
    got = {r["k"]: r["sentences"] for r in N.split_sentences(df, "text", model).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert got[99] is None or got[99] == []


def test_no_row_carries_its_sentences_along_one_by_one(spark):
    """Sentences are put together by column, whatever the rows: null, empty, all open, none open."""
    texts = [None, "", "See No. 5. End. Of J. Doe v.", "One. Two! Three?", "v. v. v."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(1)
    split = N.split_sentences(df, "text", spark.createDataFrame([("v",), ("no",)], "word string"))
    assert {r["k"]: r["sentences"] for r in split.collect()} == {
        0: None, 1: [], 2: ["See No. 5.", "End.", "Of J. Doe v."], 3: ["One.", "Two!", "Three?"], 4: ["v. v. v."]}
    assert "array_append" not in split._jdf.queryExecution().executedPlan().toString()
