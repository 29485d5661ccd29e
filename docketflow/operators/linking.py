"""Harvesting, de-duplication and key lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketflow import fixed_values as V
from docketflow.functions.html import canonical_link, list_links, title_year
from docketflow.operators.ranking import exact_rank


def extract_links(pages: DataFrame, html: str = "html", nested: bool = False) -> DataFrame:
    """One row per list-item link with its position on the page; other columns are kept."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(list_links(F.col(html), nested)).alias("pos", "item")) \
        .select(*rest, "pos", "item.href", "item.title")


def canonical_links(links: DataFrame, host: str = V.HOST) -> DataFrame:
    return links.withColumn("link", canonical_link(F.col("href"), host))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. A minimum is combined before the shuffle, so a hot key stays small."""
    rest = [c for c in df.columns if c != key and c not in order]
    picked = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return picked.select(key, *[F.col(f"_first.{c}").alias(c) for c in df.columns if c != key])


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as a dictionary filled in order would hold it."""
    rest = [c for c in df.columns if c != key and c not in order]
    picked = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return picked.select(key, *[F.col(f"_last.{c}").alias(c) for c in df.columns if c != key])


def attach(df: DataFrame, lookup: DataFrame, key: str, order: list[str], missing: str = "error") -> DataFrame:
    """Attributes by key; where the lookup repeats a key its last row wins.

    A key without attributes is an error, as in a dictionary; ``missing="null"`` keeps its row with nulls.
    """
    if missing not in ("error", "null"):
        raise ValueError("missing is 'error' or 'null'")
    found = last_per_key(lookup, key, order).drop(*order).withColumn("_found", F.lit(True))
    joined = df.join(found, key, "left")
    if missing == "error":
        absent = F.raise_error(F.concat(F.lit("no attributes for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        joined = joined.withColumn(key, F.when(F.col("_found"), F.col(key)).otherwise(absent.cast(df.schema[key].dataType)))
    return joined.drop("_found")


def dedup_links(links: DataFrame, order: list[str]) -> DataFrame:
    return first_per_key(links, "link", order)


def links_missed(found: DataFrame, other: DataFrame, key: str = "link") -> DataFrame:
    """Distinct keys of ``found`` that ``other`` lacks, sorted."""
    return found.select(key).distinct().join(other.select(key).distinct(), key, "left_anti").orderBy(key)


def court_codes(cases: DataFrame, order: list[str], court: str = "court") -> DataFrame:
    """Running code per court, from 1."""
    return exact_rank(cases, [court], order, "_n") \
        .withColumn("personal_code", F.concat(F.col(court), F.col("_n").cast("string"))).drop("_n")


def gather_vectors(keys: DataFrame, vectors: DataFrame, key: str = "link") -> DataFrame:
    """Vectors for exactly the keys asked for; a key without a vector is an error, not a lost row."""
    one = vectors.groupBy(key).agg(F.min(F.struct(*[c for c in vectors.columns if c != key])).alias("_v"))
    joined = keys.join(one, key, "left")
    checked = F.when(F.col("_v").isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string")))) \
        .otherwise(F.col("_v"))
    return joined.withColumn("_v", checked).select(*keys.columns, "_v.*")


def with_year(titles: DataFrame, title: str, fallback: Column, out: str = "case_year") -> DataFrame:
    return titles.withColumn(out, title_year(F.col(title), fallback))
