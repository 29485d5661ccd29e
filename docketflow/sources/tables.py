"""Readers and writers for the file shapes of the pipeline. Parquet is the default between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docketflow import schemas
from docketflow import fixed_values as V
from docketflow.functions.html import court_file_name

# Quotes are doubled inside a quoted field, so text with quotes and line breaks survives.
# An empty string is written as "" and null as nothing, so both come back as they were.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# Bytes that a CSV file has on average at most, and the share of rows whose widths are looked at for it.
FILE_BYTES, WIDTH_SHARE = 64 << 20, 0.01


def row_width(df: DataFrame) -> float | None:
    """Mean bytes of a row as CSV, from a sample of the rows; from all of them where the sample is empty, None without any."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 1 for c in df.columns), F.lit(0))
    return next((mean for share in (WIDTH_SHARE, None) if (mean := (df if share is None else df.sample(share, 7)).agg(F.avg(width)).first()[0])), None)


def write_csv(df: DataFrame, path: str, bytes_per_file: int = FILE_BYTES) -> None:
    """CSV with header. Quoted line breaks make a file unsplittable, so a reader has as many tasks as files: wide rows come in
    files of few rows, whatever a task has to write."""
    rows = max(1, int(bytes_per_file / (row_width(df) or 1)))
    df.write.options(**CSV_OPTIONS).option("maxRecordsPerFile", rows).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # a field with nothing in it is null whatever the marker; one that no text holds keeps "" from becoming null
    options = {**CSV_OPTIONS, "emptyValue": "", "nullValue": "\u0000", "multiLine": True, "mode": "FAILFAST"}
    return spark.read.schema(schema).options(**options).csv(path)


def as_declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; one that ``df`` lacks is null, further ones go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_sheet(sheet: DataFrame, path: str) -> None:
    """The labelling sheet as CSV, as it goes to the expert."""
    write_csv(as_declared(sheet, schemas.LABELLING_SHEET), path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LABELLING_SHEET)


def write_repository(published: DataFrame, path: str) -> None:
    """The published table as CSV."""
    write_csv(as_declared(published, schemas.REPOSITORY), path)


def read_repository(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.REPOSITORY)


def tagged_line(code: Column, case_name: Column, year: Column, link: Column, mention: Column) -> Column:
    """One harvested line: the code, then named fields, tab separated.

    A null field is empty, and tabs and line breaks inside a field become blanks, so every line has every field.
    """
    named = zip(V.LINE_FIELDS[2:], (case_name, year, link, mention))
    return F.concat_ws("\t", _field(code), *[F.concat(F.lit(f"{n}: "), _field(c)) for n, c in named])


def _field(value: Column) -> Column:
    return F.translate(F.coalesce(value.cast("string"), F.lit("")), "\t\r\n", "   ")


def mention_line(line_no: Column, line: Column) -> Column:
    """The combined list's form: a line number and the code's name in front of a harvested line."""
    return F.concat(F.lit("Line: "), line_no.cast("string"), F.lit("\tPersonal_code: "), line)


def link_line(link: Column, mention: Column) -> Column:
    return F.concat_ws("\t", _field(link), _field(mention))


def write_court_lines(df: DataFrame, path: str, court: str = "court", line: str = "line") -> None:
    """One folder of text files per court; a large court is simply several files."""
    df.select(court_file_name(F.col(court)).alias("court_file"), F.col(line).alias("value")) \
        .write.partitionBy("court_file").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All courts' lines as one table with the court they came from."""
    return spark.read.schema("value string, court_file string").text(path) \
        .select("court_file", F.col("value").alias("line"))


def read_tagged(spark: SparkSession, path: str, schema: T.StructType = schemas.HARVESTED_LINE) -> DataFrame:
    """Header-less tab-separated lines; the field names in front of the values are removed."""
    raw = spark.read.schema(schema).options(sep="\t", quote="", mode="FAILFAST").csv(path)
    return strip_field_names(raw)


def strip_field_names(df: DataFrame) -> DataFrame:
    """Remove ``Name: `` from each named field, every time it occurs in that field."""
    of_column = dict(zip([f.name for f in schemas.MENTION_LINE.fields], V.LINE_FIELDS))
    return df.select(*[
        F.replace(F.col(c), F.lit(of_column[c] + ": "), F.lit("")).alias(c) if c in of_column else F.col(c)
        for c in df.columns])


def write_split(df: DataFrame, path: str) -> None:
    """Header-less ``link,label`` files, one folder per side of the split."""
    df.select("link", "label", "split").write.partitionBy("split").csv(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*schemas.SPLIT_FILE.fields, T.StructField("split", T.StringType())])
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Key and vector stay in one row, so nothing depends on the order of two files."""
    df.select("link", "embedding").write.parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDING).parquet(path)


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with the surplus in ``a`` as ``n``: one shuffle, empty when equal."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("n")).unionByName(b.select(*cols, F.lit(-1).alias("n")))
    return both.groupBy(*cols).agg(F.sum("n").alias("n")).filter("n <> 0")


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and table_difference(a, b).isEmpty()
