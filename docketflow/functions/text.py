"""Text cleaning, tokens and sentences as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from docketflow import fixed_values as V

# One word character; the same set in Java, RE2 and Python for every code point.
WORD = r"[\p{L}\p{N}_]"
# White space as Unicode sees it, plus the four ASCII separators Python strips as well.
SPACE_SET = r"\s\x0B\x1c-\x1f\x85\p{Z}"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_{SPACE_SET}]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; plain reuse would evaluate it per use."""
    return F.transform(F.array(value), body)[0]


def newlines_to_spaces(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def boilerplate_pattern(phrases=V.BOILERPLATE) -> str:
    return "|".join(re.escape(p) for p in phrases)


def strip_boilerplate(text: Column, phrases=V.BOILERPLATE) -> Column:
    return F.regexp_replace(text, F.lit(boilerplate_pattern(phrases)), F.lit(""))


def remove_urls(text: Column) -> Column:
    """Remove a URL that starts a line, with the rest of that line and the line breaks after it."""
    for pattern in V.URL_PATTERNS:
        text = F.regexp_replace(text, F.lit("(?md)" + pattern), F.lit(""))
    return text


def remove_tags(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("(?d)" + V.TAG_PATTERN), F.lit(""))


def strip_space(text: Column) -> Column:
    """Strip every kind of white space at both ends; ``trim`` alone strips blanks only."""
    lead = rf"^[{SPACE_SET}]+"
    tail = rf"(?<![{SPACE_SET}])[{SPACE_SET}]++\z"
    return F.regexp_replace(F.regexp_replace(text, F.lit(lead), F.lit("")), F.lit(tail), F.lit(""))


def remove_digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\p{Nd}+"), F.lit(""))


def remove_punctuation(text: Column, chars: str = V.PUNCTUATION) -> Column:
    return F.translate(text, chars, "")


def drop_first_words(text: Column, n: int = V.FIRST_WORDS) -> Column:
    """Delete the first ``n`` words, keep what stood between them, then delete control spaces."""
    head_pattern = rf"^(?:[^\p{{L}}\p{{N}}_]*+{WORD}++){{1,{n}}}+"

    def cut(t):
        head = F.regexp_extract(t, head_pattern, 0)
        rest = F.substr(t, F.length(head) + 1)
        return F.concat(F.regexp_replace(head, F.lit(f"{WORD}+"), F.lit("")), rest)

    return F.translate(let(text, cut), V.CONTROL_SPACES, "")


def clean(text: Column, phrases=V.BOILERPLATE, first_words: int = V.FIRST_WORDS) -> Column:
    """The whole chain before the dictionary filter, in its fixed order."""
    text = strip_boilerplate(newlines_to_spaces(text), phrases)
    text = F.lower(remove_tags(remove_urls(text)))
    text = remove_punctuation(remove_digits(strip_space(text)))
    return drop_first_words(text, first_words)


def tokens(text: Column) -> Column:
    """Words and single symbols, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def feature_words(text: Column) -> Column:
    """Lower-case words of two or more characters: the default analyser of the vectoriser."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))


def ngrams(words: Column, n: int = 2) -> Column:
    """All word n-grams of lengths 1 to ``n``; single words come first."""

    def build(w):
        left = F.greatest(F.size(w) - 1, F.lit(0))
        out = F.concat(w, F.zip_with(F.slice(w, F.lit(1), left), F.slice(w, F.lit(2), left), lambda a, b: F.concat_ws(" ", a, b)))
        for size in range(3, n + 1):
            starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(
                F.array().cast("array<int>"))
            out = F.concat(out, F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " ")))
        return out

    return words if n == 1 else let(words, build)


def term_runs(words: Column) -> Column:
    """Distinct terms of one document with their counts, found by sorting inside the row (no shuffle)."""

    def runs(s):
        first = F.filter(
            F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda f: F.transform(f, lambda i, k: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).alias("tf"))))

    return let(F.sort_array(words), runs)


def sentences(text: Column) -> Column:
    """Split after ``. ! ?`` followed by white space."""
    return F.filter(F.split(strip_space(text), rf"(?<=[.!?])[{SPACE_SET}]+"), lambda s: s != "")


def blank_separated(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{SPACE_SET}]+"), lambda w: w != "")


def skip_leading_sentences(parts: Column, min_words: int = V.SKIP_WORDS) -> Column:
    """Drop whole sentences from the front until ``min_words`` words are gone.

    Fewer words than that in the whole document leave an empty list.
    """

    def cut(s):
        counts = F.transform(s, lambda x: F.size(blank_separated(x)))
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
        dropped = F.aggregate(
            counts, start,
            lambda acc, c: F.when(acc["words"] < min_words,
                                  F.struct((acc["words"] + c).alias("words"), (acc["n"] + 1).alias("n")))
            .otherwise(acc),
            lambda acc: acc["n"])
        return let(dropped, lambda n: F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0))))

    return let(parts, cut)


def short_sentences(parts: Column, max_chars: int | None = V.MAX_SENTENCE_CHARS) -> Column:
    """Sentences of fewer than ``max_chars`` characters; all of them for None."""
    return parts if max_chars is None else F.filter(parts, lambda s: F.length(s) < max_chars)


def cap_sentences(parts: Column, key: Column, cap: int | None = None, seed: int = V.SEED) -> Column:
    """A seeded draw of exactly ``cap`` sentences where there are more; their order is kept. No cap, no draw."""
    if cap is None:
        return parts

    def draw(s):
        drawn = F.slice(F.sort_array(F.transform(s, lambda x, i: F.struct(
            F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string"))).alias("h"),
            i.alias("i"), x.alias("x")))), 1, cap)
        kept = F.sort_array(F.transform(drawn, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
        return F.when(F.size(s) > cap, F.transform(kept, lambda r: r["x"])).otherwise(s)

    return let(parts, draw)


def text_to_encode(text: Column, min_words: int = V.SKIP_WORDS) -> Column:
    return F.array_join(skip_leading_sentences(sentences(text), min_words), " ")


def sentences_to_encode(text: Column, key: Column, min_words: int = V.SKIP_WORDS,
                        max_chars: int | None = None, cap: int | None = None,
                        seed: int = V.SEED) -> Column:
    return cap_sentences(short_sentences(skip_leading_sentences(sentences(text), min_words), max_chars),
                         key, cap, seed)
