"""Each cleaning step against the same rule written with Python's re, on the cases that differ between engines."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from docketflow import fixed_values as V
from docketflow.functions import text as X

WORDS = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 198, 199, 200, 201, 400)]
EDGE = [
    "", "plain words", "http://a.b/c rest of line\nnext line", "before\nhttps://a.b/c\n\n\nafter",
    "x\r\nhttp://y z\r\nq", "x\rhttp://not.at.line.start", "ftp://host/x", "ft://host", "htt://host", "no http://inside",
    "<a><b>bold</b>", "<a\nhref='x'>over two lines", "a < b > c", " \t padded  \x1f", "  \n ", "1a2b٣", "x² y",
    V.PUNCTUATION, "+ = £ | ` ‘q’", "well-known o'clock éte", "tab\tnbsp ff\x0cend", "_under_ score9",
    "\U0001f600 smile 😀x", *WORDS,
]


def py_word():
    return r"[^\W]+"


def py_urls(t):
    for p in V.URL_PATTERNS:
        t = re.sub(p, "", t, flags=re.MULTILINE)
    return t


def py_drop(t, n=200):
    t = re.sub(r"\w+", "", t, count=n)
    return re.sub("[" + V.CONTROL_SPACES + "]", "", t)


def py_punctuation(t):
    return "".join(c for c in t if c not in V.PUNCTUATION)


def py_clean(t):
    t = t.replace("\n", " ")
    t = re.sub("|".join(re.escape(p) for p in V.BOILERPLATE), "", t)
    t = re.sub("<.*?>", "", py_urls(t)).lower().strip()
    return py_drop(py_punctuation(re.sub(r"\d+", "", t)))


@pytest.mark.parametrize("fn,expected", [
    (X.newlines_to_spaces, lambda t: t.replace("\n", " ")),
    (X.remove_urls, py_urls),
    (X.remove_tags, lambda t: re.sub("<.*?>", "", t)),
    (X.strip_space, str.strip),
    (X.remove_digits, lambda t: re.sub(r"\d+", "", t)),
    (X.remove_punctuation, py_punctuation),
    (X.drop_first_words, py_drop),
    (X.clean, py_clean),
])
def test_step(one, fn, expected):
    assert one(fn, EDGE) == [expected(t) for t in EDGE]


def test_null_stays_null(one):
    assert one(X.clean, [None]) == [None]
    assert one(X.sentences, [None]) == [None]


def test_29_characters_deleted():
    assert len(V.PUNCTUATION) == len(set(V.PUNCTUATION)) == 29


def test_boilerplate(one):
    assert one(X.strip_boilerplate, ["a BAILII b", "@media print{x}", "World Lawyer"]) == ["a  b", "{x}", "yer"]


def test_url_only_text_is_emptied_after_newlines_went(one):
    assert one(lambda c: X.remove_urls(X.newlines_to_spaces(c)), ["http://a.b\nthe whole text"]) == [""]


@given(st.lists(st.text(alphabet="ab \n\t.,<>1٣_é- \x0c/:htpsf", max_size=60), min_size=1, max_size=20))
@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_clean_property(one, texts):
    assert one(X.clean, texts) == [py_clean(t) for t in texts]


def test_tokens_and_counts(one):
    got = one(X.tokens, ["It's 5 o-clock!", "", "a_b é1"])
    assert got == [["It", "'", "s", "5", "o", "-", "clock", "!"], [], ["a_b", "é1"]]
    assert one(X.word_count, ["It's 5 o-clock!", ""]) == [8, 0]


def test_feature_words(one):
    assert one(X.feature_words, ["A Cat x sat, O_K 12"]) == [["cat", "sat", "o_k", "12"]]


def test_ngrams(one):
    got = one(lambda c: X.ngrams(X.blank_separated(c), 3), ["a b c", "a", ""])
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_term_runs(one):
    got = one(lambda c: X.term_runs(X.blank_separated(c)), ["b a b c b", ""])
    assert [[(r["term"], r["tf"]) for r in row] for row in got] == [[("a", 1), ("b", 3), ("c", 1)], []]


def test_sentences(one):
    assert one(X.sentences, [" One. Two!  Three? four", "e.g. x", "", "end. "]) == [
        ["One.", "Two!", "Three?", "four"], ["e.g.", "x"], [], ["end."]]


def _sentence(n):
    return " ".join(["w"] * (n - 1) + ["w."])


@pytest.mark.parametrize("lengths,kept", [
    ([198, 5, 7], 1), ([199, 5, 7], 2), ([100, 99, 3], 1), ([198], 0), ([199], 0), ([10, 10], 0), ([], 0)])
def test_skip_leading_sentences(one, lengths, kept):
    text = " ".join(_sentence(n) for n in lengths)
    got = one(lambda c: X.skip_leading_sentences(X.sentences(c)), [text])[0]
    assert got == [_sentence(n) for n in lengths][len(lengths) - kept:]


def test_short_sentences(one):
    got = one(X.short_sentences, [["a" * 999, "b" * 1000, "c" * 1001]], "array<string>")[0]
    assert got == ["a" * 999]


def test_cap_draws_exactly_and_keeps_order(one):
    from pyspark.sql import functions as F
    parts = [f"s{i:02d}" for i in range(30)]
    got, same = one(lambda c: X.cap_sentences(c, F.lit("k"), 10), [parts, parts[:10]], "array<string>")
    assert len(got) == 10 and got == sorted(got) and set(got) < set(parts)
    assert same == parts[:10]
    other = one(lambda c: X.cap_sentences(c, F.lit("k"), 10, seed=2), [parts], "array<string>")[0]
    assert other != got


def test_text_to_encode(one):
    assert one(X.text_to_encode, [_sentence(199) + " Next one. Last."]) == ["Next one. Last."]
