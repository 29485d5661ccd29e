import os

import pytest
from pyspark.sql import functions as F

from docketflow import schemas
from docketflow.operators import linking as L
from docketflow.session import materialise, scratch_path, spread
from docketflow.sources import tables as S

TEXTS = ['plain', 'with "quotes"', 'line\nbreak', 'a,b', '', None, ' padded ', 'back\\slash', '""', "tab\there", '"', 'cr\r\nlf']


def _table(spark):
    rows = [(f"l{i}", "case", 2000 + i, 1, 5, t, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, schemas.JUDGMENT)


def test_csv_roundtrip_keeps_every_text(spark):
    df, path = _table(spark), scratch_path(spark, "t-csv")
    S.write_csv(df, path)
    back = S.read_csv(spark, path, schemas.JUDGMENT)
    assert {r["link"]: r["text"] for r in back.collect()} == {f"l{i}": t for i, t in enumerate(TEXTS)}
    assert S.tables_equal(df, back)


def test_table_difference_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {(r["x"], r["n"]) for r in S.table_difference(a, b).collect()} == {(1, 1), (3, -1)}
    assert not S.tables_equal(a, b) and S.tables_equal(a, a)


def test_tagged_lines_roundtrip(spark):
    rows = [("UKPC1", 'A v "B" [2000]', "2000", "http://h/1", "animal_mention"), ("EWCA/Civ2", "Case: twice Case: x", "2001", "l", "n")]
    df = spark.createDataFrame(rows, schemas.HARVESTED_LINE)
    line = S.tagged_line(*[F.col(c) for c in df.columns])
    lines = [r[0] for r in df.select(line).collect()]
    assert lines[0] == 'UKPC1\tCase: A v "B" [2000]\tYear: 2000\tLink: http://h/1\tAnimal: animal_mention'
    path = scratch_path(spark, "t-tsv")
    df.select(line.alias("value")).write.text(path)
    back = {r["personal_code"]: r for r in S.read_tagged(spark, path).collect()}
    assert back["UKPC1"]["case_name"] == 'A v "B" [2000]' and back["UKPC1"]["year"] == "2000"
    # the name is removed wherever it occurs in the field
    assert back["EWCA/Civ2"]["case_name"] == "twice x"


def test_mention_list_form(spark):
    df = spark.createDataFrame([("C1\tCase: x\tYear: 1\tLink: l\tAnimal: m",)], "line string")
    path = scratch_path(spark, "t-list")
    df.select(S.mention_line(F.lit(7), F.col("line")).alias("value")).write.text(path)
    r = S.read_tagged(spark, path, schemas.MENTION_LINE).first()
    assert (r["line"], r["personal_code"], r["mention"]) == ("7", "C1", "m")


def test_court_files(spark):
    df = spark.createDataFrame([("EWCA/Civ", "a"), ("EWCA/Civ", "b"), ("UKPC", "c")], "court string, line string")
    path = scratch_path(spark, "t-courts")
    S.write_court_lines(df, path)
    got = {(r["court_file"], r["line"]) for r in S.read_lines(spark, path).collect()}
    assert got == {("EWCA_Civ", "a"), ("EWCA_Civ", "b"), ("UKPC", "c")}


def test_wide_rows_come_in_small_files(spark):
    """A task that writes much makes several files, and each is read by a task of its own."""
    df = spark.range(60).select(F.col("id"), F.repeat(F.lit('word "quoted"\n'), 20_000).alias("text"), F.lit(None).cast("string").alias("no")).coalesce(1)
    assert 250_000 < S.row_width(df) < 300_000 and S.row_width(df.limit(0)) is None
    path = scratch_path(spark, "t-wide")
    S.write_csv(df, path, bytes_per_file=2 << 20)
    back = S.read_csv(spark, path, df.schema)
    assert len(back.inputFiles()) >= 8 and back.rdd.getNumPartitions() >= 8
    assert S.tables_equal(df, back)
    empty = scratch_path(spark, "t-none")
    S.write_csv(df.limit(0), empty)
    assert S.read_csv(spark, empty, df.schema).count() == 0


def test_split_files(spark):
    df = spark.createDataFrame([("a", 1, "train"), ("b", 0, "test")], "link string, label int, split string")
    path = scratch_path(spark, "t-split")
    S.write_split(df, path)
    assert S.tables_equal(df, S.read_split(spark, path))


def test_embeddings_keep_their_key(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], schemas.EMBEDDING)
    path = scratch_path(spark, "t-emb")
    S.write_embeddings(df, path)
    assert {r["link"]: r["embedding"] for r in S.read_embeddings(spark, path).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}


def test_scratch_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scratch_of_a_local_session_without_the_setting():
    class Bare:  # a session whose settings can't be changed
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "local[2]", "bare"

    one, other = scratch_path(Bare, "x"), scratch_path(Bare, "x")
    assert one != other and os.path.dirname(one) == os.path.dirname(other)
    Bare.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        scratch_path(Bare, "x")


def test_materialise_and_spread(spark):
    df = spark.range(100).coalesce(1).withColumn("v", F.col("id") * 2)
    back = materialise(df, "t-mat", "id")
    assert back.rdd.getNumPartitions() >= 8 and back.agg(F.sum("v")).first()[0] == 9900
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide, "id") is wide


def test_tagged_line_keeps_every_field(spark):
    """A null field is empty and a tab or line break inside a field can't start another."""
    df = spark.createDataFrame([("C1", "A\tv\nB", None, "l", "m")], "code string, name string, year int, link string, mention string")
    line = df.select(S.tagged_line(F.col("code"), F.col("name"), F.col("year"), F.col("link"), F.col("mention"))).first()[0]
    assert line.split("\t") == ["C1", "Case: A v B", "Year: ", "Link: l", "Animal: m"]


def test_attach_policy(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    lookup = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, o int, v string")
    got = L.attach(keys, lookup, "k", ["o"], missing="null").orderBy("k").collect()
    assert [(r["k"], r["v"]) for r in got] == [(1, "b"), (2, None)]
    with pytest.raises(Exception, match="no attributes for 2"):
        L.attach(keys, lookup, "k", ["o"]).collect()
