import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from docketflow.functions import text as X
from docketflow.operators import features as T, vocabulary as W

DOCS = ["the cat sat, the CAT", "xylo the", "", "a well-known cat's hat", "nothing known here'"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "k int, text string")


@pytest.fixture(params=["held", "joined"])
def path(request, monkeypatch):
    """Tables that are small enough for the workers, and tables that are not."""
    if request.param == "joined":
        monkeypatch.setattr(W, "HELD_BYTES", 0)


@pytest.mark.parametrize("more", [0, 30_000])
def test_dictionary_filter(spark, docs, more, path):
    """The table's size, null words and repeated keys make no difference."""
    words = spark.createDataFrame([("the",), ("cat",), ("CAT",), ("hat",), ("well",), ("the",), ("'",), ("it's",), (None,)], "word string") \
        .union(spark.range(more).select(F.concat(F.lit("zz"), "id")))
    exclude = spark.createDataFrame([("hat",), (None,)], "word string")
    got = W.dictionary_filter(docs, "k", "text", words, exclude).orderBy("k").collect()
    assert [r["kept"] for r in got] == ["the cat the CAT ", "the ", "", "well cat ' ", "' "]
    none = words.filter("word = 'no'")
    assert [r["kept"] for r in W.dictionary_filter(docs, "k", "text", none).orderBy("k").collect()] == [""] * 5
    repeated = spark.createDataFrame([(1, "the cats sat"), (1, "a cat ran"), (2, None)], "k int, text string")
    assert sorted((r["k"], r["kept"]) for r in W.dictionary_filter(repeated, "k", "text", words).collect()) == [(1, "cat "), (1, "the "), (2, "")]


@pytest.mark.parametrize("more", [0, 30_000])
def test_lemmatize(spark, docs, more, path):
    table = spark.createDataFrame([("sat", "sit"), ("known", "know"), ("knew", "know"), ("xylo", "x'y"), (None, "x")], "form string, lemma string") \
        .union(spark.range(more).select(F.concat(F.lit("zz"), "id"), F.lit("z")))
    got = W.lemmatize(docs, "k", "text", table).orderBy("k").collect()
    assert [r["lemmas"] for r in got] == [
        ["the", "cat", "sit", "the", "CAT"], ["x'y", "the"], [], ["well", "know", "cat", "hat"], ["nothing", "know", "here"]]
    repeated = spark.createDataFrame([(1, "the sat"), (1, "it knew"), (1, None)], "k int, text string")
    assert sorted(r["lemmas"] for r in W.lemmatize(repeated, "k", "text", table).collect()) == [[], ["it", "know"], ["the", "sit"]]


def test_held_words_move_no_rows(spark, docs):
    words = spark.createDataFrame([("the",)], "word string")
    plan = W.dictionary_filter(docs, "k", "text", words)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def _plain_lemma(form, lexicon, exceptions, rules):
    if form in exceptions:
        hits = [w for w in [form, *exceptions[form]] if w in lexicon]
        return min(hits, key=lambda w: (len(w), w), default=form)
    level = [form]
    first = True
    while level:
        made = [w[: len(w) - len(old)] + new for w in level for old, new in rules if w.endswith(old) and len(w) > len(old)]
        hits = [w for w in made + (level if first else []) if w in lexicon]
        if hits:
            return min(hits, key=lambda w: (len(w), w))
        level, first = made, False
    return form


def test_rule_lemmas(spark):
    from docketflow import fixed_values as V
    lexicon = {"walk", "love", "carry", "go", "be", "walking", "see", "pass", "sing", "us", "bee", "b"}
    exceptions = {"went": ["go"], "been": ["be"], "gone": ["nowhere"], "seeds": ["see", "us"]}
    forms = ["walks", "walking", "walkings", "walked", "loves", "loving", "carries", "carried", "went", "been", "gone", "passes", "sing", "sings", "bees",
             "ing", "s", "seeds", "unknownings", "us", "being", "sinningsings", "walk", "", "walks"]
    got = {r["form"]: r["lemma"] for r in W.rule_lemmas(
        spark.createDataFrame([(f,) for f in [*forms, None]], "form string"), spark.createDataFrame([(w,) for w in [*lexicon, None]], "word string"),
        spark.createDataFrame([(f, l) for f, ls in exceptions.items() for l in ls], "form string, lemma string")).collect()}
    want = {f: _plain_lemma(f, lexicon, exceptions, V.VERB_ENDINGS) for f in forms}
    assert got == {f: w for f, w in want.items() if f != w}
    assert got["walkings"] == "walking" and got["loving"] == "love" and "gone" not in got
    nothing = spark.createDataFrame([], "form string")
    assert W.rule_lemmas(nothing, spark.createDataFrame([("a",)], "word string")).collect() == []


def _brute(docs, ngram, k, min_df, max_df):
    """TF-IDF by hand: words of 2+ letters, smooth idf, unit length."""
    import re
    lists = []
    for t in docs:
        w = re.findall(r"\w\w+", t.lower())
        lists.append(w + [" ".join(p) for n in range(2, ngram + 1) for p in zip(*[w[i:] for i in range(n)])])
    cf, df = Counter(x for w in lists for x in w), Counter(x for w in lists for x in set(w))
    n = len(docs)
    vocab = sorted((t for t in cf if min_df <= df[t] <= max_df * n), key=lambda t: (-cf[t], t))[:k]
    out = {}
    for i, w in enumerate(lists):
        raw = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(w).items() if t in vocab}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(i, t): v / norm for t, v in raw.items()})
    return vocab, out


@pytest.mark.parametrize("ngram,k,min_df,max_df", [(1, 4, 1, 1.0), (1, 100, 2, 1.0), (2, 5, 1, 0.5), (2, 100, 1, 0.2), (1, 5, 9, 1.0)])
def test_tfidf(spark, docs, ngram, k, min_df, max_df):
    df = docs.withColumn("terms", T.analyse(F.col("text"), ngram))
    model = T.fit_tfidf(df, "terms", k, min_df, max_df)
    vocab, expected = _brute(DOCS, ngram, k, min_df, max_df)
    assert model.terms == sorted(vocab)
    got = {(r["k"], r["term"]): r["weight"] for r in T.weights_long(model.transform(df), "k", model).collect()}
    assert got == pytest.approx(expected)
    # a document without a known term keeps its row, with nothing in it
    assert model.transform(df).count() == 5


def test_vectoriser_survives_saving(spark, docs):
    from pyspark.ml import PipelineModel

    from docketflow.session import scratch_path
    df = docs.withColumn("terms", T.analyse(F.col("text")))
    model = T.fit_tfidf(df, "terms", 10)
    path = scratch_path(spark, "t-vec")
    model.pipeline().write().save(path)
    again = PipelineModel.load(path).transform(df).select("k", vector_to_array("features").alias("f"))
    assert sorted(again.collect()) == sorted(model.transform(df).select("k", vector_to_array("features").alias("f")).collect())


def test_vocabulary_size_is_checked(docs):
    with pytest.raises(ValueError):
        T.fit_tfidf(docs, "text", 10_000_000)


def test_term_statistics(docs):
    df = docs.withColumn("terms", X.feature_words(F.col("text")))
    got = {r["term"]: (r["cf"], r["df"]) for r in T.term_stats(df, "terms").collect()}
    assert got["the"] == (3, 2) and got["cat"] == (3, 2) and got["known"] == (2, 2) and len(got) == 9
    assert T.term_frequencies(df, "k", "terms").filter("term = 'the' AND k = 0").first()["tf"] == 2


def test_ngrams_of_rare_words_are_not_counted(spark):
    texts = ["aa bb aa bb cc", "aa bb dd ee", "aa bb ff", None, "bb aa gg", "hh hh hh hh hh hh hh"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", T.analyse(F.col("text")))
    n, every = len(texts), T.term_stats(df.select(T.analyse(F.col("text"), 3).alias("words")), "words")
    for size, low, high in ((1, 1, 1.0), (3, 1, 1.0), (4, 2, 0.9), (500, 1, 1.0)):
        stats = T.leading_stats(df, "words", 3, n, size, low, high)
        assert T.vocabulary(stats, n, size, low, high).collect() == T.vocabulary(every, n, size, low, high).collect()
    assert T.leading_stats(df, "words", 3, n, 3).filter("term = 'dd ee'").count() == 0


def test_terms_are_counted_together_over_documents(spark, monkeypatch):
    rows = [(0, ["x", "y", "x"]), (1, ["x"]), (0, None), (0, []), (None, ["y", "x"]), (0, ["x"])]
    df = spark.createDataFrame(rows, "fold int, terms array<string>").coalesce(1)
    for size in (1 << 20, 1):
        monkeypatch.setattr(T, "COUNTED_TERMS", size)
        got = T.counted_terms(df, "terms", "fold").groupBy("term", "group").agg(F.sum("cf"), F.sum("df")).collect()
        assert sorted(map(tuple, got), key=str) == sorted([("x", 0, 3, 2), ("y", 0, 1, 1), ("x", 1, 1, 1), ("y", None, 1, 1), ("x", None, 1, 1)], key=str)
