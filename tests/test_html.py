import random

from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions import html as H
from docketflow.operators import linking as L
from docketflow.sources import seeds


def test_list_links(one):
    page = '<ul><li><a href="/a">A</a></li>\n<LI class="x"> <A id=1 href="/b">B <i>b</i></A></li><li>none</li></ul><a href="/c">c</a>'
    got = one(H.list_links, [page])[0]
    assert [(r["href"], r["title"]) for r in got] == [("/a", "A"), ("/b", "B b")]


def test_nested_list_links(one):
    page = '<ul><li><b>1. <a href="/x">X</a></b></li><li><a href="/y">Y</a></li></ul>'
    got = one(lambda c: H.list_links(c, nested=True), [page])[0]
    assert [(r["href"], r["title"]) for r in got] == [("/x", "1. X")]


def test_item_text_and_quoting(one):
    """The title is the whole item, the address may be quoted in any way, and only ul items count."""
    page = ("<ul><li><a href=\"/a&amp;b.html\">Smith v Jones</a> [2005] EWHC 7</li><li><a href='/q.html'>Q</a></li>"
            "<li><a href=/n.html>N</a></ul><ol><li><a href=\"/o\">O</a></li></ol>")
    got = one(H.list_links, [page])[0]
    assert [(r["href"], r["title"]) for r in got] == [("/a&b.html", "Smith v Jones [2005] EWHC 7"), ("/q.html", "Q"), ("/n.html", "N")]
    assert one(H.list_links, ["", None])[0] == []


def _random_list(rnd, depth, listed, out):
    """Markup of a list and its text, with end tags of items left out at random; items inside a ``ul`` go to ``out`` in page order."""
    kind = rnd.choice(["ul", "ol", "UL"])
    listed = listed or kind.lower() == "ul"
    markup, text = f"<{kind} class='x'>", ""
    for _ in range(rnd.randrange(4)):
        name, place = f"n{rnd.randrange(10**6)}", len(out)
        linked = rnd.random() < 0.8
        if listed and linked:
            out.append(None)
        body, own = (f'<a href="/{name}">{name}</a>', name) if linked else ("plain", "plain")
        for _ in range(rnd.randrange(3) if depth else 0):
            inner, inner_text = _random_list(rnd, depth - 1, listed, out)
            body, own = body + inner + " z ", own + inner_text + " z "
        if rnd.random() < 0.2:
            body += "<!-- </li><li><ul> -->"
        if listed and linked:
            out[place] = ("/" + name, own.strip(" "))
        markup, text = markup + f"<li>{body}" + rnd.choice(["</li>", "", "</LI >"]), text + own
    return markup + f"</{kind}>", text


def test_lists_within_lists_and_open_items(one):
    """Against the tree that the markup was written from."""
    rnd = random.Random(5)
    pages, wanted = [], []
    for _ in range(120):
        markup, out = "</ul></li><li>stray", []
        for _ in range(rnd.randrange(4)):
            inner, _ = _random_list(rnd, 3, False, out)
            markup += rnd.choice(["", "<p>", "</ol>"]) + inner
        pages.append(markup)
        wanted.append(out)
    got = one(H.list_links, pages)
    assert [[(r["href"], r["title"]) for r in row] for row in got] == wanted
    assert sum(map(len, wanted)) > 300
    page = "<ul><li><a href=a>A<ul><li><a href=b>B</a></li></ul></li><li><a href=c>C"
    assert [(r["href"], r["title"]) for r in one(H.list_links, [page])[0]] == [("a", "AB"), ("b", "B"), ("c", "C")]


def test_many_items_take_linear_time(one):
    page = "<ul>" + "<li><a href=/x>x</a>" * 30_000 + "</ul>" + "<ul><li>" * 500
    assert len(one(H.list_links, [page])[0]) == 30_000


def test_canonical_link(one):
    got = one(lambda c: H.canonical_link(c, "https://h"), ["/a", "/cgi-bin/redirect.cgi?path=/uk/x", "x"])
    assert got == ["https://h/a", "https://h/uk/x", "https://hx"]


def test_page_text(one):
    pages = ["<p>a&amp;lt;b &lt; &copy;&#163;&#xe9;&nope;</p><!-- <b>gone</b> --><style>p{}</style>", "<a\nhref='x'>t</a>"]
    assert one(H.page_text, pages) == ["a&lt;b < ©£é&nope;p{}", "t"]
    assert one(lambda c: H.page_text(c, drop_script_style=True), pages)[0] == "a&lt;b < ©£é&nope;"


def test_title_year(one):
    titles = ["A v B", "A v B [2001]", "[1999] A v B [2003] EWCA", "odd ][ one", None]
    assert one(lambda c: H.title_year(c, F.lit(2010)), titles) == ["2010", "2001", "2003", "2010", "2010"]


def test_mention_tag(spark):
    rows = [("animal", "l"), ("Animal x", "l"), ("ANIMAL", "l"), ("animals", "l"), ("none", "l"), ("animal", "bad�")]
    df = spark.createDataFrame(rows, "t string, l string")
    got = [r[0] for r in df.select(H.mention_tag(F.col("t"), F.col("l"))).collect()]
    assert got == [V.MENTION, V.MENTION, V.NO_MENTION, V.MENTION, V.NO_MENTION, V.NO_JUDGMENT]


def test_next_page(one):
    assert one(H.has_next_page, ["<input value='Next 10 >>>'>", "x"]) == [True, False]


def test_seed_urls(spark):
    urls = seeds.seed_urls(seeds.court_seeds(spark), "https://h")
    counts = {r["court"]: r["count"] for r in urls.groupBy("court").count().collect()}
    assert len(counts) == 15 and counts["UKHL"] == 10 and counts["UKSC"] == 12 and counts["EWHC/QB"] == 21
    assert urls.filter("court = 'EWCA/Civ' AND year = 2004").first()["url"] == "https://h/ew/cases/EWCA/Civ/2004/"


def test_links_first_last_and_missed(spark):
    rows = [("x", 2, "b"), ("x", 1, "a"), ("y", 5, "c"), ("x", 3, "z")]
    df = spark.createDataFrame(rows, "link string, pos int, title string")
    assert {r["link"]: r["title"] for r in L.dedup_links(df, ["pos"]).collect()} == {"x": "a", "y": "c"}
    assert {r["link"]: r["title"] for r in L.last_per_key(df, "link", ["pos"]).collect()} == {"x": "z", "y": "c"}
    other = spark.createDataFrame([("y",), ("y",)], "link string")
    assert [r["link"] for r in L.links_missed(df, other).collect()] == ["x"]


def test_gather_fails_on_missing_vector(spark):
    import pytest
    keys = spark.createDataFrame([("a",), ("b",)], "link string")
    vectors = spark.createDataFrame([("a", [1.0]), ("a", [1.0])], "link string, embedding array<double>")
    assert L.gather_vectors(keys.filter("link = 'a'"), vectors).count() == 1
    with pytest.raises(Exception, match="no vector for b"):
        L.gather_vectors(keys, vectors).collect()


def test_court_codes(spark):
    df = spark.createDataFrame([("C/A", i) for i in (5, 3, 9)] + [("D", 1)], "court string, link int")
    got = {(r["court"], r["link"]): r["personal_code"] for r in L.court_codes(df, ["link"]).collect()}
    assert got == {("C/A", 3): "C/A1", ("C/A", 5): "C/A2", ("C/A", 9): "C/A3", ("D", 1): "D1"}
