"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

COURT_SEED = T.StructType([
    T.StructField("court", T.StringType()),
    T.StructField("year_min", T.IntegerType()),
    T.StructField("year_max", T.IntegerType()),
])

HARVESTED_LINE = T.StructType([
    T.StructField("personal_code", T.StringType()),
    T.StructField("case_name", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("mention", T.StringType()),
])

MENTION_LINE = T.StructType([T.StructField("line", T.StringType()), *HARVESTED_LINE.fields])

LABELLING_SHEET = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("case_name", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("link", T.StringType()),
    T.StructField("classification", T.IntegerType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("sample", T.IntegerType()),
    T.StructField("og_sample", T.IntegerType()),
])

JUDGMENT = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("case_name", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("clean_text", T.StringType()),
])

SPLIT_FILE = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

EMBEDDING = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

REPOSITORY = T.StructType([
    T.StructField("case_name", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("link", T.StringType()),
    T.StructField("classification", T.IntegerType()),
    T.StructField("expert_or_ml_classified", T.StringType()),
])
