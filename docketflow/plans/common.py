"""Inputs and SQL fragments shared by the registered queries.

The corpus tables stand in for judgments: ``documents`` are judgments (``doc_id`` is the link), ``labels.toxic``
the expert's narrow label, ``documents.source`` the court, words of ``benchmark`` the dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketflow import fixed_values as V
from docketflow.functions import text as X
from docketflow.session import spread

# Keyword spellings that occur in this corpus.
KEYWORDS = ("the", "The")
HOST = "https://host.example"
SEED = 1

WORD = X.WORD
SPACE = X.SPACE_SET
TOKEN = X.TOKEN


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text of a text table, spread over the cores for the work that follows."""
    return spread(table(spark, sf, name).select(key, text), key)


def quoted(s: str) -> str:
    """A DuckDB text literal; backslashes stand for themselves, control characters go through chr()."""
    parts, plain = [], ""
    for ch in s:
        if ord(ch) < 32 or ord(ch) == 160:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
            parts.append(f"chr({ord(ch)})")
            plain = ""
        else:
            plain += ch
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    """``link, case_name, year, court, text`` of every document."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("link"), F.concat(F.lit("Case "), F.col("doc_id").cast("string")).alias("case_name"),
        (2000 + F.pmod("doc_id", F.lit(21))).cast("int").alias("year"), F.col("source").alias("court"), "text")


SQL_JUDGMENTS = """judgments AS (SELECT doc_id AS link, 'Case ' || doc_id AS case_name,
    CAST(2000 + doc_id % 21 AS INTEGER) AS year, source AS court, text FROM documents)"""


def expert(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments with the expert's label."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("link"), F.col("toxic").alias("label"))
    return judgments(spark, sf).join(labels, "link")


SQL_EXPERT = SQL_JUDGMENTS + """, expert AS (SELECT j.*, l.toxic AS label
    FROM judgments j JOIN labels l ON l.doc_id = j.link)"""


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(WORD + "+"), F.lit(0))).alias("word")).distinct()


SQL_DICTIONARY = f"""dictionary AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}+')) AS word FROM benchmark)"""


def lemma_table(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary words with a verb-like ending, mapped to the word without it."""
    words = dictionary(spark, sf).filter(F.col("word").rlike("^.{2,}(ed|ing|s)$"))
    return words.select(F.col("word").alias("form"),
                        F.regexp_replace("word", F.lit("(ed|ing|s)$"), F.lit("")).alias("lemma"))


SQL_LEMMAS = SQL_DICTIONARY + """, lemma_table AS (SELECT word AS form, regexp_replace(word, '(ed|ing|s)$', '') AS lemma
    FROM dictionary WHERE regexp_matches(word, '^.{2,}(ed|ing|s)$'))"""


# --- cleaning steps as SQL text ---------------------------------------------------------------

def sql_boilerplate(t: str, phrases) -> str:
    return f"regexp_replace({t}, {quoted(X.boilerplate_pattern(phrases))}, '', 'g')"


def sql_urls(t: str) -> str:
    for p in V.URL_PATTERNS:
        t = f"regexp_replace({t}, {quoted('(?m)' + p)}, '', 'g')"
    return t


def sql_tags(t: str) -> str:
    return f"regexp_replace({t}, '{V.TAG_PATTERN}', '', 'g')"


def sql_strip(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '^[{SPACE}]+', ''), '[{SPACE}]+\z', '')"


def sql_digits(t: str) -> str:
    return rf"regexp_replace({t}, '\p{{Nd}}+', '', 'g')"


def sql_punctuation(t: str) -> str:
    return f"translate({t}, {quoted(V.PUNCTUATION)}, '')"


def sql_drop_words(t: str, n: int = V.FIRST_WORDS) -> str:
    head = rf"regexp_extract({t}, '^(?:[^\p{{L}}\p{{N}}_]*{WORD}+){{1,{n}}}')"
    joined = f"regexp_replace({head}, '{WORD}+', '', 'g') || substr({t}, length({head}) + 1)"
    return f"translate({joined}, {quoted(V.CONTROL_SPACES)}, '')"


def sql_newlines(t: str) -> str:
    return f"translate({t}, chr(10), ' ')"


def sql_tokens(t: str) -> str:
    return f"regexp_extract_all({t}, '{TOKEN}')"


def sql_sentences(t: str) -> str:
    marked = rf"regexp_replace({sql_strip(t)}, '([.!?])[{SPACE}]+', '\1' || chr(1), 'g')"
    return f"[x FOR x IN string_split({marked}, chr(1)) IF x <> '']"


def sql_words(t: str) -> str:
    """Default analyser: lower-case words of two or more characters."""
    return f"regexp_extract_all(lower({t}), '{WORD}{{2,}}')"


def sql_hash(key: str, seed: int = SEED) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def sql_split(source: str, key: str, label: str, share: float = V.TEST_SHARE) -> str:
    """``split_of``: key, label and side."""
    return f"""split_of AS (SELECT {key}, {label}, CASE WHEN row_number() OVER (PARTITION BY {label}
      ORDER BY {sql_hash(key)}, {key}) <= round({share} * count(*) OVER (PARTITION BY {label}))
      THEN 'test' ELSE 'train' END AS split FROM {source})"""


def sql_folds(source: str, key: str, label: str, folds: int = V.FOLDS) -> str:
    """``fold_of``: key, label and fold."""
    def part(j):
        return (f"(CAST(floor((st + n - 1 - {j} + {folds}) / {folds}) AS BIGINT)"
                f" - CAST(floor((st - 1 - {j} + {folds}) / {folds}) AS BIGINT))")
    tests = " + ".join(
        f"CASE WHEN r > {' + '.join(part(i) for i in range(j + 1))} THEN 1 ELSE 0 END" for j in range(folds - 1))
    return f"""ranked_f AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {key}) AS r FROM {source}),
    classes_f AS (SELECT {label}, count(*) AS n, min({key}) AS first FROM {source} GROUP BY 1),
    placed_f AS (SELECT {label}, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
      FROM classes_f),
    fold_of AS (SELECT k.{key}, k.{label}, CAST({tests} AS INTEGER) AS fold
      FROM ranked_f k JOIN placed_f p ON p.{label} = k.{label})"""


def sql_scores(by: str, source: str) -> str:
    """Confusion counts and scores per ``by`` as two named queries, ``counted`` and ``scored``."""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""counted AS (SELECT {lead}count(*) FILTER (prediction = 1 AND label = 1) AS tp,
      count(*) FILTER (prediction = 1 AND label = 0) AS fp, count(*) FILTER (prediction = 0 AND label = 1) AS fn,
      count(*) FILTER (prediction = 0 AND label = 0) AS tn FROM {source} {group}),
    f1s AS (SELECT *, CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp / (2*tp+fp+fn) ELSE 0.0 END AS f1_1,
      CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn / (2*tn+fp+fn) ELSE 0.0 END AS f1_0 FROM counted),
    scored AS (SELECT *, (f1_1 + f1_0) / 2 AS macro_f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM f1s)"""


# --- stand-in classifiers ---------------------------------------------------------------------

# Each says 1 when its text test holds, so results can be checked exactly.
RULES = {"base": None, "the": "the", "und": "und", "able": "able", "que": "que"}


def rule_predictions(df: DataFrame) -> DataFrame:
    """``link, label`` and one 0/1 prediction column per rule."""
    return df.select("link", "label", *[
        (F.lit(1) if word is None else F.contains("text", F.lit(word)).cast("int")).alias(name)
        for name, word in RULES.items()])


def rules_long(df: DataFrame) -> DataFrame:
    return rule_predictions(df).unpivot(["link", "label"], list(RULES), "model", "prediction")


def rules_correct(df: DataFrame) -> DataFrame:
    """One 0/1 correctness column per rule."""
    return rule_predictions(df).select("link", "label", *[
        (F.col(m) == F.col("label")).cast("int").alias(m) for m in RULES])


def _sql_rule(word: str | None) -> str:
    return "1" if word is None else f"CAST(contains(text, '{word}') AS INTEGER)"


SQL_RULES_LONG = SQL_EXPERT + ", rules_long AS (" + " UNION ALL ".join(
    f"SELECT link, label, '{m}' AS model, {_sql_rule(w)} AS prediction FROM expert" for m, w in RULES.items()) + ")"
SQL_RULES_CORRECT = SQL_EXPERT + ", rules_correct AS (SELECT link, label, " + ", ".join(
    f'CAST({_sql_rule(w)} = label AS INTEGER) AS "{m}"' for m, w in RULES.items()) + " FROM expert)"
