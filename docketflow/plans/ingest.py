"""Queries over sources, sinks, links and keyword flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow import fixed_values as V, workflows
from docketflow.functions import html as H
from docketflow.operators import linking as L, publish as P
from docketflow.plans.common import (
    HOST, KEYWORDS, SQL_EXPERT, SQL_JUDGMENTS, expert, judgments, sql_hash, sql_split, table, texts)
from docketflow.plans.registry import Registry
from docketflow.session import scratch_path
from docketflow.sources import seeds, tables as S
from docketflow.operators.sampling import stratified_split

query = Registry()
_HIT = "(contains(text, 'the') OR contains(text, 'The'))"
_TAG = f"CASE WHEN {_HIT} THEN '{V.MENTION}' ELSE '{V.NO_MENTION}' END"


def _found(text):
    hit = F.lit(False)
    for k in KEYWORDS:
        hit = hit | F.contains(text, F.lit(k))
    return hit


@query(f"""SELECT count(*) AS checked, count(*) FILTER {_HIT.replace('(', '(WHERE (', 1)}) AS mentions,
    round(100 * count(*) FILTER (WHERE {_HIT}) / count(*), 2) AS percent FROM documents""")
def mention_summary(spark, sf):
    return P.mention_summary(table(spark, sf, "documents"), _found(F.col("text")))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, sf):
    docs, path = table(spark, sf, "documents"), scratch_path(spark, "csv")
    S.write_csv(docs, path)
    return S.read_csv(spark, path, docs.schema)


@query("SELECT count(*) AS n_rows, 0 AS n_different FROM documents")
def reload_check(spark, sf):
    docs, path = table(spark, sf, "documents"), scratch_path(spark, "csv")
    S.write_csv(docs, path)
    again = S.read_csv(spark, path, docs.schema)
    different = S.table_difference(docs, again).agg(F.count("*").cast("int").alias("n_different"))
    return again.agg(F.count("*").alias("n_rows")).withColumn("j", F.lit(1)) \
        .join(different.withColumn("j", F.lit(1)), "j").drop("j")


def _harvested(spark, sf):
    # tagged first, so the texts do not travel with the numbering
    tagged = judgments(spark, sf).withColumn("mention", H.mention_tag(F.col("text"), keywords=KEYWORDS)).drop("text")
    return L.court_codes(tagged, ["link"])


_SQL_HARVESTED = SQL_JUDGMENTS + f""", harvested AS (SELECT court || row_number() OVER (PARTITION BY court ORDER BY link)
    AS personal_code, court, case_name, year, link, {_TAG} AS mention FROM judgments)"""


@query(f"""WITH {_SQL_HARVESTED} SELECT court, link, personal_code FROM harvested""")
def court_codes(spark, sf):
    return _harvested(spark, sf).select("court", "link", "personal_code")


def _lines(spark, sf):
    h = _harvested(spark, sf)
    return h.select("court", "link", S.tagged_line(F.col("personal_code"), F.col("case_name"), F.col("year"),
                                                   F.col("link"), F.col("mention")).alias("line"))


_SQL_LINE = """personal_code || chr(9) || 'Case: ' || case_name || chr(9) || 'Year: ' || year || chr(9) || 'Link: '
    || link || chr(9) || 'Animal: ' || mention"""


@query(f"""WITH {_SQL_HARVESTED} SELECT {_SQL_LINE} AS line, link || chr(9) || mention AS short_line FROM harvested""")
def tagged_lines(spark, sf):
    h = _harvested(spark, sf)
    return h.select(
        S.tagged_line(F.col("personal_code"), F.col("case_name"), F.col("year"), F.col("link"), F.col("mention")).alias("line"),
        S.link_line(F.col("link"), F.col("mention")).alias("short_line"))


@query(f"""WITH {_SQL_HARVESTED} SELECT personal_code, case_name, CAST(year AS VARCHAR) AS year,
    CAST(link AS VARCHAR) AS link, mention FROM harvested""")
def tsv_scan(spark, sf):
    path = scratch_path(spark, "court-lines")
    _lines(spark, sf).select(F.col("line").alias("value")).write.text(path)
    return S.read_tagged(spark, path)


@query(f"""WITH {_SQL_HARVESTED}, kept AS (SELECT court, link, {_SQL_LINE} AS line FROM harvested
    WHERE mention = '{V.MENTION}')
    SELECT 'Line: ' || row_number() OVER (ORDER BY court, link) || chr(9) || 'Personal_code: ' || line AS line FROM kept""")
def multi_file_mentions(spark, sf):
    path = scratch_path(spark, "court-files")
    S.write_court_lines(_lines(spark, sf), path)
    kept = S.read_lines(spark, path).filter(F.contains("line", F.lit(V.MENTION)))
    # lines of one court in the order of their running code
    code = F.substring_index("line", "\t", 1)
    placed = kept.withColumn("n", F.substr(code, F.length("court_file") + 1).cast("bigint"))
    numbered = L.exact_rank(placed, [], ["court_file", "n"], "line_no")
    return numbered.select(S.mention_line(F.col("line_no"), F.col("line")).alias("line"))


@query(f"""WITH {SQL_EXPERT}, {sql_split('expert', 'link', 'label')}
    SELECT CAST(link AS VARCHAR) AS link, label, split FROM split_of""")
def split_roundtrip(spark, sf):
    path = scratch_path(spark, "split")
    S.write_split(stratified_split(expert(spark, sf).select("link", "label")), path)
    return S.read_split(spark, path)


@query("""SELECT CAST(vec_id AS VARCHAR) AS link, CAST(len(embedding) AS INTEGER) AS dims,
    round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last_value
    FROM embeddings""")
def embedding_scan(spark, sf):
    path = scratch_path(spark, "embeddings")
    S.write_embeddings(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("link"), "embedding"), path)
    return S.read_embeddings(spark, path).select(
        "link", F.size("embedding").alias("dims"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"),
        F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last_value"))


# Lists as a court's index writes them: by page the address is in double, single or no quotes, a year in brackets and a
# character reference stand behind the link, or items hold lists of their own and end without an end tag.
_ITEM = '<li><a href="([^"]*)">(.*?)</a></li>'
_WRITTEN = {1: "<li><a href='{0}?a&amp;b'>{1}</a> [1999] x</li>", 2: "<li><a href={0}>{1}</a> v &lt;J&gt; [2005]</li>",
            4: '<li><a href="{0}">{1}</a> <ul><li><a href="{0}/part">Part &amp; {1}</a></ul> [2001]</li>',
            5: '<li><a href="{0}">{1}</a><!-- <li> --><ol><li><a href="{0}/1">One</a> of<LI>none<li><a href="{0}/2">Two</a></ol>'}
_KINDS = 6


def _sql_pages() -> str:
    cases = " ".join(f"WHEN page_id % {_KINDS} = {k} THEN regexp_replace(html, '{_ITEM}', '{form.format(chr(92) + '1', chr(92) + '2').replace(chr(39), chr(39) * 2)}', 'g')"
                     for k, form in _WRITTEN.items())
    return f"written AS (SELECT page_id, CASE {cases} WHEN page_id % {_KINDS} = 3 THEN replace(replace(html, '<ul>', '<ol>'), '</ul>', '</ol>') ELSE html END AS html FROM pages)"


# The rule by depths: an item's level is the number of lists around it. It ends at the next item or item's end of its level, or at the
# end tag of its list, which counts to the level that it ends; so at whatever comes next on its level.
_TAGS = r"(?is)<!--.*?-->|</?(?:ul|ol|li)\b[^>]*>"
_SQL_LINKS = _sql_pages() + rf""", tagged AS (SELECT page_id, regexp_extract_all(html, '{_TAGS}') AS tags, string_split_regex(html, '{_TAGS}') AS parts FROM written),
    each_tag AS (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS k FROM tagged),
    kinds AS (SELECT page_id, k, lower(regexp_extract(tag, '^</?([a-zA-Z]+)', 1)) AS name, starts_with(tag, '</') AS closing FROM each_tag),
    steps AS (SELECT *, CASE WHEN name NOT IN ('ul', 'ol') THEN 0 WHEN closing THEN -1 ELSE 1 END AS step FROM kinds WHERE name <> ''),
    depths AS (SELECT *, sum(step) OVER w - least(step, 0) AS level, sum(CASE WHEN name = 'ul' THEN step ELSE 0 END) OVER w AS lists
      FROM steps WINDOW w AS (PARTITION BY page_id ORDER BY k)),
    ends AS (SELECT *, lead(k) OVER (PARTITION BY page_id, level ORDER BY k) AS stop FROM depths WHERE step < 1),
    listed_items AS (SELECT page_id, k, array_to_string(parts[k + 2 : coalesce(stop, len(tags)) + 1], '<li>') AS item
      FROM ends JOIN tagged USING (page_id) WHERE name = 'li' AND NOT closing AND lists > 0),
    numbered AS (SELECT page_id, item, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos FROM listed_items WHERE starts_with(item, '<a ')),
    linked AS (SELECT page_id, pos, regexp_extract(item, '<a href=["'']?([^"''>]*)', 1) AS href,
      regexp_replace(regexp_replace(item, '<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS title FROM numbered),
    links AS (SELECT page_id, pos, replace(href, '&amp;', '&') AS href,
      trim(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM linked)"""


def _written(spark, sf):
    html, kind = F.col("html"), F.col("page_id") % _KINDS
    pages = texts(spark, sf, "pages", "page_id", "html")
    written = F.when(kind == 3, F.replace(F.replace(html, F.lit("<ul>"), F.lit("<ol>")), F.lit("</ul>"), F.lit("</ol>"))).otherwise(html)
    for k, form in _WRITTEN.items():
        written = F.when(kind == k, F.regexp_replace(html, _ITEM, form.format("$1", "$2"))).otherwise(written)
    return pages.withColumn("html", written)


def _links(spark, sf):
    return L.extract_links(_written(spark, sf))


@query(f"WITH {_SQL_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, title FROM links")
def extract_links(spark, sf):
    return _links(spark, sf)


@query(f"""WITH {_SQL_LINKS}, red AS (SELECT page_id, pos, CASE WHEN pos % 2 = 1 THEN '/{V.REDIRECT_PREFIX}' || href[2:]
    ELSE href END AS href FROM links)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, replace('{HOST}' || href, '{V.REDIRECT_PREFIX}', '') AS link FROM red""")
def canonical_links(spark, sf):
    redirected = _links(spark, sf).withColumn("href", F.when(
        F.col("pos") % 2 == 1, F.concat(F.lit("/" + V.REDIRECT_PREFIX), F.substr("href", F.lit(2)))).otherwise(F.col("href")))
    return L.canonical_links(redirected, HOST).select("page_id", "pos", "link")


@query(f"""WITH {_SQL_LINKS} SELECT '{HOST}' || href AS link, min(page_id) AS page_id,
    CAST(arg_min(pos, (page_id, pos)) AS INTEGER) AS pos, arg_min(title, (page_id, pos)) AS title FROM links GROUP BY href""")
def dedup_links(spark, sf):
    links = L.canonical_links(_links(spark, sf), HOST)
    return L.dedup_links(links, ["page_id", "pos"]).select("link", "page_id", "pos", "title")


@query(f"""WITH {_SQL_LINKS}, h AS (SELECT page_id, '{HOST}' || href AS link FROM links)
    SELECT DISTINCT link FROM h WHERE page_id % 2 = 0 AND link NOT IN (SELECT link FROM h WHERE page_id % 2 = 1) ORDER BY 1""")
def links_missed(spark, sf):
    links = L.canonical_links(_links(spark, sf), HOST)
    return L.links_missed(links.filter("page_id % 2 = 0"), links.filter("page_id % 2 = 1"))


# Index pages are the pages; a judgment is the document whose first word its link names.
_SQL_HARVEST = f"""{_SQL_LINKS}, listed AS (SELECT 'C/' || page_id % 7 AS court, 2000 + page_id % 21 AS year, page_id, pos,
      '{HOST}' || href AS link, title FROM links),
    firsts AS (SELECT court, link, arg_min(struct_pack(y := year, p := page_id, i := pos, t := title), (year, page_id, pos)) AS f
      FROM listed GROUP BY court, link),
    tags AS (SELECT '{HOST}/' || regexp_extract(text, '[^ ]+') AS link, min({_TAG}) AS mention FROM documents GROUP BY 1)"""


@query(f"""WITH {_SQL_HARVEST} SELECT f.court, f.court || row_number() OVER (PARTITION BY f.court ORDER BY f.f.y, f.f.p, f.f.i) AS personal_code,
    f.f.t AS case_name, coalesce(nullif(regexp_extract(f.f.t, '\\[([0-9]+)\\][^\\[]*$', 1), ''), CAST(f.f.y AS VARCHAR)) AS year, f.link, coalesce(t.mention, '{V.NO_JUDGMENT}') AS mention
    FROM firsts f LEFT JOIN tags t ON t.link = f.link""")
def harvest(spark, sf):
    index = _written(spark, sf).select(
        F.concat(F.lit("C/"), (F.col("page_id") % 7).cast("string")).alias("court"),
        (2000 + F.col("page_id") % 21).alias("year"), F.col("page_id").alias("url"), "html")
    judged = texts(spark, sf).select(
        F.concat(F.lit(HOST + "/"), F.regexp_extract("text", "[^ ]+", 0)).alias("link"), F.col("text").alias("html"))
    return workflows.harvest(index, judged, HOST, KEYWORDS, html=False)


_SQL_PAGE = r"""regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"""
_SQL_DECODED = f"""replace(replace(replace(replace(replace(replace({_SQL_PAGE}, '&copy;', chr(169)), '&middot;', chr(183)),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""


@query(f"""SELECT page_id, contains(html, '{V.NEXT_PAGE_MARK}') AS has_next, {_SQL_DECODED} AS text FROM pages""")
def page_text(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", H.has_next_page(F.col("html")).alias("has_next"),
                                            H.page_text(F.col("html")).alias("text"))


@query("""WITH c AS (SELECT 'CU/' || o_custkey AS court, min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi
    FROM orders GROUP BY 1), y AS (SELECT court, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS year FROM c)
    SELECT court, year, '%s/' || lower(court[1:2]) || '/cases/' || court || '/' || year || '/' AS url FROM y""" % HOST)
def seed_urls(spark, sf):
    courts = table(spark, sf, "orders").groupBy(F.concat(F.lit("CU/"), F.col("o_custkey").cast("string")).alias("court")) \
        .agg(F.min(F.year("o_orderdate")).alias("year_min"), F.max(F.year("o_orderdate")).alias("year_max"))
    return seeds.seed_urls(courts, HOST)


@query("""WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN o_orderkey % 10 = 0 THEN 'Case ' || o_orderkey
    WHEN o_orderkey % 10 = 1 THEN '[1999] Case ' || o_orderkey || ' [' || year(o_orderdate) || ']'
    ELSE 'Case ' || o_orderkey || ' [' || year(o_orderdate) || ']' END AS title FROM orders)
    SELECT o_orderkey, title, CASE WHEN contains(title, '[') THEN regexp_extract_all(title, '\\[([^\\]]*)\\]', 1)[-1]
    ELSE '2000' END AS case_year FROM t""")
def title_year(spark, sf):
    key, year = F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")
    plain = F.concat(F.lit("Case "), key)
    dated = F.concat(plain, F.lit(" ["), year, F.lit("]"))
    title = F.when(F.col("o_orderkey") % 10 == 0, plain) \
        .when(F.col("o_orderkey") % 10 == 1, F.concat(F.lit("[1999] "), dated)).otherwise(dated)
    titles = table(spark, sf, "orders").select("o_orderkey", title.alias("title"))
    return L.with_year(titles, "title", F.lit("2000"))


@query(f"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN 'x' || chr(65533) || doc_id ELSE 'x' || doc_id END
    AS link FROM documents) SELECT doc_id, CASE WHEN contains(link, chr(65533)) THEN '{V.NO_JUDGMENT}'
    ELSE {_TAG} END AS mention FROM d""")
def keyword_flag(spark, sf):
    key = F.col("doc_id").cast("string")
    link = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("x" + V.BROKEN_LINK_MARK), key)).otherwise(F.concat(F.lit("x"), key))
    return table(spark, sf, "documents").select(
        "doc_id", H.mention_tag(F.col("text"), link, keywords=KEYWORDS).alias("mention"))


_SQL_SHEET = f"""sheet AS (SELECT row_number() OVER (ORDER BY link) AS idx, case_name, year, link,
    CAST(NULL AS INTEGER) AS classification, ' ' AS explanation FROM judgments WHERE {_HIT}),
    drawn AS (SELECT idx FROM sheet ORDER BY {sql_hash('idx')}, idx LIMIT {V.FIRST_SAMPLE})"""


@query(f"""WITH {SQL_JUDGMENTS}, {_SQL_SHEET} SELECT *, CASE WHEN idx IN (SELECT idx FROM drawn) THEN 1 ELSE 0 END AS sample
    FROM sheet""")
def labelling_sheet(spark, sf):
    found = judgments(spark, sf).filter(_found(F.col("text"))).select("case_name", "year", "link")
    return P.labelling_sheet(found, ["link"])


@query(f"""WITH {SQL_JUDGMENTS}, {_SQL_SHEET} SELECT * REPLACE (CAST(link AS VARCHAR) AS link), CASE WHEN idx IN (SELECT idx FROM drawn) THEN 1 ELSE 0 END AS sample,
    CAST(NULL AS INTEGER) AS og_sample FROM sheet""")
def sheet_file(spark, sf):
    """The labelling sheet written as CSV and read back by its declared schema."""
    path = scratch_path(spark, "sheet")
    S.write_sheet(labelling_sheet(spark, sf), path)
    return S.read_sheet(spark, path)


@query(f"""WITH {SQL_JUDGMENTS}, s AS (SELECT j.link AS idx, j.case_name, l.toxic AS classification FROM judgments j
    LEFT JOIN labels l ON l.doc_id = j.link),
    drawn AS (SELECT idx FROM s WHERE classification IS NULL ORDER BY {sql_hash('idx')}, idx LIMIT {V.SECOND_SAMPLE})
    SELECT idx, case_name, classification, CASE WHEN classification >= 0 THEN 1 WHEN idx IN (SELECT idx FROM drawn) THEN 1
    ELSE 0 END AS sample, CASE WHEN classification >= 0 THEN 1 ELSE 0 END AS og_sample FROM s""")
def label_sample(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("link"), F.col("toxic").alias("classification"))
    sheet = judgments(spark, sf).join(labels, "link", "left").select(
        F.col("link").alias("idx"), "case_name", "classification", F.lit(1).alias("sample"))
    return P.extend_sample(sheet).select("idx", "case_name", "classification", "sample", "og_sample")
