"""Page markup, links and titles as column expressions."""

from __future__ import annotations

import json
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from docketflow import fixed_values as V
from docketflow.functions.text import let

# Tags that lists are made of; comments hide theirs.
LIST_TAG = r"(?is)<!--.*?(?:-->|\z)|</?(?:ul|ol|li)\b[^>]*>"
_HREF = r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ITEM_LINK = r"(?is)\A\s*" + _HREF
# The link sits one level deeper: the second node inside the item's first child.
NESTED_ITEM_LINK = r"(?is)\A\s*<[a-z][^>]*>[^<]*" + _HREF
COMMENT = r"(?s)<!--.*?-->"
SCRIPT_STYLE = r"(?is)<(script|style)\b.*?</(?:script|style)\s*>"
TAG = r"(?s)<[^>]*>"


def has_next_page(html: Column) -> Column:
    return F.contains(html, F.lit(V.NEXT_PAGE_MARK))


def item_spans(tags: str) -> list[int]:
    """Items of a page from its list tags, one character each: first and last tag of every item, one after the other.

    ``u`` and ``o`` begin a list, ``U`` and ``O`` end one, ``i`` and ``I`` begin and end an item; others are passed over. An item
    ends at its end tag, at the next item of its own list, at its list's end or with the page, whichever comes first, and
    holds the lists within it. An end tag without a list of its kind is passed over. Only items somewhere inside a ``u`` list
    count; they come in page order.
    """
    lists, opened, out = {"u": 0, "o": 0}, {}, []

    def end(at: int) -> None:
        item = opened.pop(lists["u"] + lists["o"], None)
        if item is not None:
            out[item + 1] = at

    for at, tag in enumerate(tags):
        if tag in lists:
            lists[tag] += 1
        elif tag in "UO":
            if lists[tag.lower()]:
                end(at)
                lists[tag.lower()] -= 1
        elif tag in "iI":
            end(at)
            if tag == "i" and lists["u"]:
                opened[lists["u"] + lists["o"]] = len(out)
                out += [at, len(tags)]
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _spans(tags: pd.Series) -> pd.Series:
    return tags.map(lambda t: item_spans(t or ""))


def list_items(html: Column) -> Column:
    """What stands between each list item's tags, items of nested lists too, in page order; a tag in between is ``<li>`` whatever it was.

    Tags are found and texts are cut in the JVM; only one character per list tag goes to Python, where a depth count finds the items' ends.
    """
    def code(tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"(?i)\A</?(ul|ol|li)\b", 1))
        mark = F.when(name == "li", "i").otherwise(F.substring(name, 1, 1))
        return F.when(name == "", "-").when(F.startswith(tag, F.lit("</")), F.upper(mark)).otherwise(mark)

    tags = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(LIST_TAG), F.lit(0)), code), "")

    def cut(parts: Column, spans: Column) -> Column:
        starts = F.filter(spans, lambda _, k: k % 2 == 0)
        return F.transform(starts, lambda first, k: F.array_join(
            F.slice(parts, first + 2, F.get(spans, 2 * k + 1) - first), "<li>"))

    return let(F.struct(F.split(html, LIST_TAG, -1).alias("parts"), _spans(tags).alias("spans")), lambda s: cut(s["parts"], s["spans"]))


def list_links(html: Column, nested: bool = False) -> Column:
    """``array<struct<href, title>>`` for the items of ``ul`` lists, at any depth, that begin with a link, in page order.

    The title is the text of the whole item: what stands behind the link and in lists within the item too. Character references in
    the address are decoded, and its quotes may be double, single or missing.
    """
    pattern = F.lit(NESTED_ITEM_LINK if nested else ITEM_LINK)

    def link(item):
        href = F.concat(*[F.regexp_extract(item, NESTED_ITEM_LINK if nested else ITEM_LINK, k) for k in (1, 2, 3)])
        return F.struct(decode_entities(href).alias("href"), F.trim(page_text(item)).alias("title"))

    return F.transform(F.filter(list_items(html), lambda i: F.regexp_like(i, pattern)), link)


def canonical_link(href: Column, host: str = V.HOST, redirect: str = V.REDIRECT_PREFIX) -> Column:
    return F.replace(F.concat(F.lit(host), href), F.lit(redirect), F.lit(""))


def decode_entities(text: Column) -> Column:
    """Numeric and named character references; only those that occur in the row are replaced."""
    # one literal in the plan, made a map when the plan is folded
    named = F.from_json(F.lit(json.dumps({n: chr(c) for n, c in name2codepoint.items() if n != "amp"})), "map<string,string>")

    def numeric(pattern, prefix, to_hex):
        def run(t):
            found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
            return F.aggregate(found, t, lambda acc, n: F.replace(
                acc, F.concat(F.lit(prefix), n, F.lit(";")),
                F.decode(F.unhex(F.lpad(to_hex(n), 8, "0")), "UTF-32")))
        return run

    def by_name(t):
        found = F.array_distinct(F.regexp_extract_all(t, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
        return F.aggregate(found, t, lambda acc, n: F.replace(
            acc, F.concat(F.lit("&"), n, F.lit(";")),
            F.coalesce(F.try_element_at(named, n), F.concat(F.lit("&"), n, F.lit(";")))))

    text = let(text, numeric(r"&#(\d{1,6});", "&#", lambda n: F.hex(n.cast("bigint"))))
    text = let(text, numeric(r"&#x([0-9a-fA-F]{1,5});", "&#x", lambda n: n))
    text = let(text, by_name)
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def page_text(html: Column, drop_script_style: bool = False) -> Column:
    """Text of a page: markup away, character references decoded. Style text stays unless asked otherwise."""
    html = F.regexp_replace(html, F.lit(COMMENT), F.lit(""))
    if drop_script_style:
        html = F.regexp_replace(html, F.lit(SCRIPT_STYLE), F.lit(""))
    return decode_entities(F.regexp_replace(html, F.lit(TAG), F.lit("")))


def title_year(title: Column, fallback: Column) -> Column:
    """The content of the last bracket pair in the title, else the page's year."""
    found = F.regexp_extract_all(title, F.lit(r"\[([^\]\n]*)\]"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), fallback.cast("string"))


def index_url(court: Column, year: Column, host: str = V.HOST) -> Column:
    return F.concat(F.lit(host + "/"), F.lower(F.substring(court, 1, 2)), F.lit("/cases/"), court,
                    F.lit("/"), year.cast("string"), F.lit("/"))


def court_file_name(court: Column) -> Column:
    return F.translate(court, "/", "_")


def mention_tag(text: Column, link: Column | None = None, keywords=V.KEYWORDS, hit: str = V.MENTION,
                miss: str = V.NO_MENTION, broken: str = V.NO_JUDGMENT) -> Column:
    """Tag a page by a case-sensitive substring test; a broken link is tagged without looking at the text."""
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(text, F.lit(word))
    tag = F.when(found, hit).otherwise(miss)
    if link is None:
        return tag
    return F.when(F.contains(link, F.lit(V.BROKEN_LINK_MARK)), broken).otherwise(tag)
