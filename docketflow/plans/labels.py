"""Queries over labels, samples, splits, joins and the published table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.operators import linking as L, publish as P, sampling as S
from docketflow.plans import common as C
from docketflow.plans.common import expert, judgments, table
from docketflow.plans.registry import Registry
from docketflow.session import scratch_path
from docketflow.sources import tables as files

query = Registry()


def _sheet(spark, sf):
    """Every document with its class, null where nobody labelled it; ``quality`` 0 splits class 0 in two."""
    labels = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(0).alias("classification"))
    return table(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left")


_SQL_SHEET = """sheet AS (SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 1
    WHEN l.quality = 0 THEN 2 ELSE 0 END AS classification FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"WITH {_SQL_SHEET} SELECT doc_id, source, classification FROM sheet WHERE classification >= 0")
def labelled_only(spark, sf):
    return P.labelled(_sheet(spark, sf))


@query(f"WITH {_SQL_SHEET} SELECT doc_id, source FROM sheet WHERE classification IS NULL")
def unlabelled_only(spark, sf):
    return P.unlabelled(_sheet(spark, sf)).drop("classification")


@query(f"""WITH {_SQL_SHEET} SELECT doc_id, CASE WHEN classification = 1 THEN 1 ELSE 0 END AS label FROM sheet
    WHERE classification >= 0""")
def narrow_label(spark, sf):
    return P.labelled(_sheet(spark, sf)).select("doc_id", P.narrow_label(F.col("classification")).alias("label"))


# The corrections of this corpus: documents whose text carries a license line are set to class 1.
_SQL_FIXES = "fixes AS (SELECT doc_id AS link, 1 AS fixed FROM documents WHERE contains(text, 'license'))"


def _fixes(spark, sf):
    return table(spark, sf, "documents").filter(F.contains("text", F.lit("license"))) \
        .select(F.col("doc_id").alias("link"), F.lit(1).alias("fixed"))


@query(f"""WITH {C.SQL_EXPERT}, {_SQL_FIXES} SELECT link, coalesce(fixed, label) AS label FROM expert
    LEFT JOIN fixes USING (link)""")
def label_corrections(spark, sf):
    return P.apply_corrections(expert(spark, sf).select("link", "label"), _fixes(spark, sf))


@query(f"WITH {C.SQL_EXPERT}, {C.sql_split('expert', 'link', 'label')} SELECT link, label, split FROM split_of")
def stratified_split(spark, sf):
    return S.stratified_split(expert(spark, sf).select("link", "label"))


@query(f"WITH {C.SQL_EXPERT}, {C.sql_folds('expert', 'link', 'label')} SELECT link, label, fold FROM fold_of")
def stratified_folds(spark, sf):
    return S.stratified_folds(expert(spark, sf).select("link", "label"))


@query(f"""WITH {C.SQL_EXPERT}, {C.sql_split('expert', 'link', 'label')} SELECT s.link, s.label, s.split, j.text
    FROM split_of s JOIN judgments j ON j.link = s.link""")
def split_with_text(spark, sf):
    split = S.stratified_split(expert(spark, sf).select("link", "label"))
    return split.join(judgments(spark, sf).select("link", "text"), "link")


@query(f"""WITH {C.SQL_EXPERT}, {C.sql_split('expert', 'link', 'label')} SELECT s.link, s.label, s.split,
    round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_value FROM split_of s JOIN embeddings e ON e.vec_id = s.link""")
def split_with_embedding(spark, sf):
    split = S.stratified_split(expert(spark, sf).select("link", "label"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("link"), "embedding")
    return split.join(vectors, "link").select(
        "link", "label", "split", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query(f"""WITH {C.sql_split('embeddings', 'vec_id', 'label')} SELECT s.vec_id, s.label, s.split,
    round(CAST(e.embedding[64] AS DOUBLE), 6) AS last_value FROM split_of s JOIN embeddings e USING (vec_id)""")
def gather_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    keys = S.stratified_split(vectors.select("vec_id", "label"), "vec_id")
    return L.gather_vectors(keys, vectors.select("vec_id", "embedding"), "vec_id").select(
        "vec_id", "label", "split", F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last_value"))


@query("""WITH l AS (SELECT source, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1)
    SELECT d.doc_id, d.source, l.lang, l.n_chars FROM documents d JOIN l USING (source)""")
def attach_metadata(spark, sf):
    docs = table(spark, sf, "documents")
    return L.attach(docs.select("doc_id", "source"), docs.select("source", "doc_id", "lang", "n_chars"), "source", ["doc_id"])


# Test-side predictions by a rule; the other judgments have none.
_SQL_PREDICTED = f"""{C.sql_split('expert', 'link', 'label')}, predicted AS (SELECT e.link,
    CAST(contains(e.text, 'able') AS INTEGER) AS prediction FROM expert e JOIN split_of s ON s.link = e.link AND s.split = 'test')"""


def _test_predictions(spark, sf):
    labelled = expert(spark, sf)
    test = S.stratified_split(labelled).filter("split = 'test'")
    return test.select("link", F.contains("text", F.lit("able")).cast("int").alias("prediction"))


@query(f"""WITH {C.SQL_EXPERT}, {_SQL_PREDICTED} SELECT e.link, e.label, p.prediction, CASE WHEN p.prediction IS NULL THEN NULL
    WHEN p.prediction = e.label THEN 1 ELSE 0 END AS class_match FROM expert e LEFT JOIN predicted p ON p.link = e.link""")
def class_match(spark, sf):
    return P.with_agreement(expert(spark, sf).select("link", "label"), _test_predictions(spark, sf))


_SQL_PUBLISHED = f"""WITH {C.SQL_EXPERT}, {_SQL_FIXES}, chosen AS (SELECT j.case_name, j.year, j.link,
      coalesce(e.label, CAST(contains(j.text, 'able') AS INTEGER)) AS classification,
      CASE WHEN e.label >= 0 THEN 'expert' ELSE 'ml' END AS expert_or_ml_classified
      FROM judgments j LEFT JOIN expert e ON e.link = j.link)
    SELECT case_name, year, link, coalesce(fixed, classification) AS classification, expert_or_ml_classified
    FROM chosen LEFT JOIN fixes USING (link) ORDER BY year, link"""


@query(_SQL_PUBLISHED)
def publish_repository(spark, sf):
    labelled = expert(spark, sf)
    rest = judgments(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("link")), "link", "left_anti")
    predicted = rest.withColumn("prediction", F.contains("text", F.lit("able")).cast("int"))
    return P.publish(labelled, predicted, _fixes(spark, sf))


@query(f"SELECT * REPLACE (CAST(link AS VARCHAR) AS link) FROM ({_SQL_PUBLISHED})")
def repository_file(spark, sf):
    """The published table written as CSV and read back by its declared schema."""
    path = scratch_path(spark, "repository")
    files.write_repository(publish_repository(spark, sf), path)
    return files.read_repository(spark, path)
