"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketflow.llm import adaptive_scan, best_fit, byte_bpe, merkle, odd_sketch, outliers, packed_ids, permuterm, raking, resharding, secret_scan, toxicity, trie_counts
from docketflow.plans.registry import Registry
from docketflow.session import materialise

query = Registry()

SHARDS = 24
OLD_SHARDS = 20
END_ID = 2
END_OF_PIECE = 0
MISSPELT_ONE_IN = 97
#: Share of all tokens that the mixing query draws.
TOKEN_BUDGET = 0.5
POWERS = {"source": 0.8, "lang": 0.8, "topic": 0.9}
TOXIC_FROM = 0.7


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query()
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by models learned from the rows that aren't held out."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.filter(~held_out), _table(spark, sf, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query()
def op2_reshard(spark: SparkSession, sf: str) -> DataFrame:
    """Documents from shards by source into 24 shards of equal bytes, read back from the rewritten files."""
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(OLD_SHARDS))
    done = resharding.reshard(spark, f"{sf}/documents.parquet", old, SHARDS)
    return done.select("doc_id", resharding.row_size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
                       F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all documents' ids and of what they decode to; a null text is empty."""
    return byte_bpe.round_trip(_table(spark, sf, "documents"), ranks_file(), pattern())


@query()
def op4_simple8b(spark: SparkSession, sf: str) -> DataFrame:
    """Token files written in ascending order, then read back."""
    import public_tokenizers

    path = packed_ids.token_file_path(spark)
    packed_ids.write_token_files(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, END_ID)
    return packed_ids.list_token_files(spark, path)


@query()
def op5_adaptive_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one; vectors that are null, zero or not finite take no part."""
    return adaptive_scan.search(_table(spark, sf, "embeddings"))


@query()
def op6_robust_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are measured once; the stored statistics serve the estimates and the verdicts."""
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    measured = materialise(outliers.measure(docs).drop("text"), "statistics")
    estimates, used = outliers.estimates_from(measured)
    return outliers.verdicts(measured, estimates, used).select("doc_id", *outliers.STATISTICS, "base_failed", "kept", "distance")


@query()
def op7_odd_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all documents under links from similarity 0.85; null and empty texts stand alone."""
    return odd_sketch.near_duplicates(_table(spark, sf, "documents"))


@query()
def op8_trie_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of all documents; a null text is empty."""
    return trie_counts.token_counts(_table(spark, sf, "documents"), ranks_file(), pattern())


def _oracle_mixing() -> str:
    """The same proportional fitting, written out round by round."""
    marks = " ".join(f"WHEN contains(coalesce(text, ''), {_text(mark)}) THEN '{name}'" for name, mark in raking.TOPICS)
    parts = [f"""counted AS (SELECT doc_id, source, lang, CASE {marks} ELSE 'prose' END AS topic,
      CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS tokens FROM documents)""",
             "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS w FROM counted GROUP BY ALL)"]
    for name, power in POWERS.items():
        parts.append(f"t_{name} AS (SELECT {name} AS v, pow(sum(w), {power}) / sum(pow(sum(w), {power})) OVER () AS target FROM cells GROUP BY {name} HAVING sum(w) > 0)")
    joins = " ".join(f"LEFT JOIN t_{n} ON t_{n}.v IS NOT DISTINCT FROM cells.{n}" for n in POWERS)
    targets = ", ".join(f"t_{n}.target AS target_{n}" for n in POWERS)
    parts.append(f"s0 AS MATERIALIZED (SELECT cells.*, w / sum(w) OVER () AS own, w / sum(w) OVER () AS share, {targets} FROM cells {joins})")
    step = 0
    for _ in range(raking.ROUNDS):
        for n in POWERS:
            parts.append(f"""s{step + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(share) OVER (PARTITION BY {n}) > 0
              THEN share * coalesce(target_{n}, 0) / sum(share) OVER (PARTITION BY {n}) ELSE 0 END AS share) FROM s{step})""")
            step += 1
    parts.append(f"f AS (SELECT source, lang, topic, CASE WHEN own > 0 THEN share / own ELSE 1.0 END AS factor FROM s{step})")
    # with all larger factors cut off at 1, the others share what is left of the budget
    parts.append(f"""weighed AS (SELECT f.*, cells.w FROM f JOIN cells ON cells.source IS NOT DISTINCT FROM f.source
      AND cells.lang IS NOT DISTINCT FROM f.lang AND cells.topic = f.topic)""")
    parts.append(f"""scaled AS (SELECT *, CASE WHEN sum(w * factor) OVER up > 0 THEN ({TOKEN_BUDGET} * sum(w) OVER () - (sum(w) OVER () - sum(w) OVER up))
      / sum(w * factor) OVER up END AS scale FROM weighed WINDOW up AS (ORDER BY factor))""")
    parts.append("g AS (SELECT *, least(1.0, coalesce(max(scale) OVER (), 1.0) * factor) AS probability FROM scaled)")
    draw = f"('0x' || substr(md5('{raking.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0"
    return "WITH " + ",\n".join(parts) + f"""
      SELECT doc_id, counted.source, counted.lang, counted.topic, tokens::BIGINT AS n_tokens, round(factor, 6) AS factor,
        round(probability, 6) AS probability, {draw} < probability AS sampled
      FROM counted JOIN g ON g.source IS NOT DISTINCT FROM counted.source AND g.lang IS NOT DISTINCT FROM counted.lang AND g.topic = counted.topic"""


def _text(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" if c in "\n'" else f"'{c}'" for c in value)


@query(_oracle_mixing())
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their raked factors and whether they are drawn, half of the tokens in all; null is a value of its own."""
    docs = _table(spark, sf, "documents").select("doc_id", "source", "lang", raking.topic().alias("topic"), "text")
    mixed = raking.sample(docs, POWERS, raking.word_count(), budget=TOKEN_BUDGET)
    return mixed.select("doc_id", "source", "lang", "topic", F.col("_tokens").alias("n_tokens"), F.round("_factor", 6).alias("factor"),
                        F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


@query()
def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of secrets in all documents and what they wrap; a null text has none."""
    return secret_scan.digest(secret_scan.scan(_table(spark, sf, "documents").select("doc_id", "text")))


def _misspelt(key: str, word: str) -> Column:
    """The word, without one code point where 97 divides the checksum of key and word; a null key is the empty text."""
    draw = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col(word)))
    at = F.pmod(draw, F.char_length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(F.pmod(draw, F.lit(MISSPELT_ONE_IN)) == 0, shorter).otherwise(F.col(word))


@query()
def op11_permuterm(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents, some with a code point taken out, and the forms and roots of all of them."""
    runs = permuterm.runs(_table(spark, sf, "documents").select("doc_id", "text"))
    return permuterm.grouped(permuterm.vocabulary(runs.select(_misspelt("doc_id", "word").alias("word"))))


@query()
def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves and proofs of all documents, then held against the root after a seventh of the rows were tampered with; a null id is never tampered with."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    other = F.when(tampered, merkle.leaf("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    proofs = merkle.manifest(_table(spark, sf, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], carried={"tampered": other})
    tested = merkle.verified(proofs.withColumn("tested", F.coalesce("tampered", "leaf")), leaf="tested")
    digests = {name: F.lower(F.hex(column)).alias(name) for name, column in
               {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof_sha256": "siblings_digest", "folded_root": "folded_root"}.items()}
    return tested.select("doc_id", *digests.values(), (F.col("folded_root") == F.col("root")).alias("verified"))


@query()
def op13_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    """All documents' pieces in sequences of 2,048 tokens."""
    import public_tokenizers

    return best_fit.pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_OF_PIECE)
