"""Queries over text cleaning, tokens, sentences and word tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions import text as X
from docketflow.operators import embedding as E, sentences as N, vocabulary as W
from docketflow.plans import common as C
from docketflow.plans.common import dictionary, lemma_table, table, texts
from docketflow.plans.registry import Registry
from docketflow.session import materialise

query = Registry()
# Phrases that occur in this corpus.
PHRASES = ("the ", "of and", "que de", "und", "license", "@")


def _docs(spark, sf, column, name="text"):
    return texts(spark, sf).select("doc_id", column.alias(name))


@query(f"SELECT doc_id, {C.sql_boilerplate(C.sql_newlines('text'), PHRASES)} AS text FROM documents")
def strip_boilerplate(spark, sf):
    return _docs(spark, sf, X.strip_boilerplate(X.newlines_to_spaces(F.col("text")), PHRASES))


# No document holds a URL, so the pages' URLs are put in front of lines of the texts with the same id.
_SQL_WITH_URL = """with_url AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(p.url, '') || ' cited' || chr(10) || d.text
    ELSE d.text || chr(10) || coalesce(p.url, '') || chr(13) || chr(10) || 'end ' || coalesce(p.url, '') END AS text
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


@query(f"WITH {_SQL_WITH_URL} SELECT doc_id, {C.sql_urls('text')} AS text FROM with_url")
def remove_urls(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    joined = table(spark, sf, "documents").join(pages, "doc_id", "left").withColumn("url", F.coalesce("url", F.lit("")))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("url", F.lit(" cited\n"), "text")) \
        .otherwise(F.concat("text", F.lit("\n"), "url", F.lit("\r\nend "), "url"))
    return joined.select("doc_id", X.remove_urls(text).alias("text"))


@query(f"SELECT page_id, {C.sql_tags('html')} AS text FROM pages")
def remove_tags(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", X.remove_tags(F.col("html")).alias("text"))


@query(f"SELECT doc_id, {C.sql_punctuation('lower(text)')} AS text FROM documents")
def remove_punct(spark, sf):
    return _docs(spark, sf, X.remove_punctuation(F.lower("text")))


@query(f"SELECT page_id, {C.sql_digits(C.sql_strip(C.sql_tags('html')))} AS text FROM pages")
def remove_digits(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select(
        "page_id", X.remove_digits(X.strip_space(X.remove_tags(F.col("html")))).alias("text"))


@query(f"SELECT doc_id, {C.sql_drop_words('text')} AS text FROM documents")
def drop_first_words(spark, sf):
    return _docs(spark, sf, X.drop_first_words(F.col("text")))


@query(f"SELECT doc_id, CAST(len({C.sql_tokens('text')}) AS INTEGER) AS words FROM documents")
def word_count(spark, sf):
    return _docs(spark, sf, X.word_count(F.col("text")), "words")


_SQL_CLEAN_STEPS = f"""c1 AS (SELECT doc_id, {C.sql_boilerplate(C.sql_newlines('text'), V.BOILERPLATE)} AS t FROM documents),
    c2 AS (SELECT doc_id, {C.sql_strip('lower(' + C.sql_tags(C.sql_urls('t')) + ')')} AS t FROM c1),
    c3 AS (SELECT doc_id, {C.sql_punctuation(C.sql_digits('t'))} AS t FROM c2),
    c4 AS (SELECT doc_id, {C.sql_drop_words('t')} AS t FROM c3)"""


def _sql_kept(source: str, text: str, words: str = "dictionary") -> str:
    return f"""toks AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos
      FROM (SELECT doc_id, {C.sql_tokens(text)} AS l FROM {source})),
    kept AS (SELECT doc_id, string_agg(word || ' ', '' ORDER BY pos) AS k FROM toks SEMI JOIN {words} USING (word)
      GROUP BY doc_id)"""


@query(f"""WITH {C.SQL_DICTIONARY}, allowed AS (SELECT word FROM dictionary WHERE NOT regexp_matches(word, '^th')),
    {_sql_kept('documents', 'text', 'allowed')}
    SELECT doc_id, coalesce(k, '') AS kept FROM documents LEFT JOIN kept USING (doc_id)""")
def dictionary_filter(spark, sf):
    words = dictionary(spark, sf)
    exclude = words.filter(F.col("word").startswith("th"))
    docs = texts(spark, sf)
    return W.dictionary_filter(docs, "doc_id", "text", words, exclude).select("doc_id", "kept")


@query(f"""WITH {C.SQL_DICTIONARY}, {_SQL_CLEAN_STEPS}, {_sql_kept('c4', 't')}
    SELECT doc_id, coalesce(k, '') AS clean_text FROM documents LEFT JOIN kept USING (doc_id)""")
def clean_text(spark, sf):
    docs = _docs(spark, sf, X.clean(F.col("text")))
    return W.dictionary_filter(docs, "doc_id", "text", dictionary(spark, sf), out="clean_text").drop("text")


@query(f"""WITH {C.SQL_LEMMAS}, toks AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos
      FROM (SELECT doc_id, [x FOR x IN {C.sql_tokens('text')} IF length(x) > 1] AS l FROM documents)),
    done AS (SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY pos) AS k FROM toks
      LEFT JOIN lemma_table ON form = word GROUP BY doc_id)
    SELECT doc_id, coalesce(k, '') AS lemmas FROM documents LEFT JOIN done USING (doc_id)""")
def lemmatize(spark, sf):
    docs = texts(spark, sf)
    return W.lemmatize(docs, "doc_id", "text", lemma_table(spark, sf)) \
        .select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


_SQL_RULES = ", ".join(f"('{old}', '{new}')" for old, new in V.VERB_ENDINGS)
# Forms of the lexicon that follow no rule here.
_SQL_IRREGULAR = "irregular AS (SELECT word AS form, 'the' AS lemma FROM dictionary WHERE regexp_matches(word, '^th..'))"


@query(f"""WITH RECURSIVE {C.SQL_DICTIONARY}, {_SQL_IRREGULAR}, rules AS (SELECT * FROM (VALUES {_SQL_RULES}) r(old, new)),
    forms AS (SELECT DISTINCT unnest({C.sql_tokens('text')}) AS form FROM documents),
    made AS (SELECT form, form AS word, 0 AS depth FROM forms WHERE form NOT IN (SELECT form FROM irregular)
      UNION SELECT form, word[:len(word) - len(old)] || new, depth + 1 FROM made JOIN rules ON ends_with(word, old) AND len(word) > len(old)),
    candidates AS (SELECT form, word, greatest(depth, 1) AS depth FROM made
      UNION SELECT form, lemma, 1 FROM irregular UNION SELECT form, form, 1 FROM irregular),
    hits AS (SELECT form, word, depth FROM candidates SEMI JOIN dictionary USING (word)),
    nearest AS (SELECT form, min(depth) AS depth FROM hits GROUP BY form),
    lemmas AS (SELECT form, arg_min(word, (len(word), word)) AS lemma FROM hits JOIN nearest USING (form, depth) GROUP BY form)
    SELECT form, lemma FROM lemmas JOIN forms USING (form) WHERE form <> lemma""")
def rule_lemmas(spark, sf):
    """Lemmas of all words of the documents by endings, a lexicon and a list of exceptions."""
    words = dictionary(spark, sf)
    forms = texts(spark, sf).select(F.explode(X.tokens(F.col("text"))).alias("form"))
    irregular = words.filter(F.col("word").rlike("^th..")).select(F.col("word").alias("form"), F.lit("the").alias("lemma"))
    return W.rule_lemmas(forms, words, irregular)


@query(f"""WITH w AS (SELECT doc_id, {C.sql_words('text')} AS l FROM documents)
    SELECT doc_id, array_to_string(l || [l[i] || ' ' || l[i + 1] FOR i IN range(1, greatest(len(l), 1))], '|') AS grams
    FROM w""")
def ngrams(spark, sf):
    return _docs(spark, sf, F.array_join(X.ngrams(X.feature_words(F.col("text")), 2), "|"), "grams")


_SQL_SENTENCES = f"""sents AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos
    FROM (SELECT doc_id, {C.sql_sentences('text')} AS s FROM documents))"""


@query(f"WITH {_SQL_SENTENCES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM sents")
def sentence_split(spark, sf):
    return texts(spark, sf).select(
        "doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


# The corpus has no abbreviations, so two of its words become some.
_ABBREVIATED = {" the ": " v. ", " of ": " No. ", " in ": " J. "}


def _abbreviated(spark, sf):
    text = F.col("text")
    for word, short in _ABBREVIATED.items():
        text = F.replace(text, F.lit(word), F.lit(short))
    return texts(spark, sf).select("doc_id", text.alias("text"))


_SQL_ABBREVIATED = "SELECT doc_id, " + "replace(" * len(_ABBREVIATED) + "text" + "".join(f", '{a}', '{b}')" for a, b in _ABBREVIATED.items()) + " AS text FROM documents"
_SQL_BARE = r"lower(regexp_replace({0}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g'))"
_SQL_MODEL = f"""short AS ({_SQL_ABBREVIATED}),
    toks AS (SELECT {_SQL_BARE.format('t')} AS t FROM (SELECT unnest(regexp_extract_all(text, '[^{C.SPACE}]+')) AS t FROM short)),
    counted AS (SELECT CASE WHEN ends_with(t, '.') THEN left(t, len(t) - 1) ELSE t END AS word, count(*) AS n, count(*) FILTER (ends_with(t, '.')) AS k FROM toks
      WHERE regexp_matches(t, '\\p{{L}}') GROUP BY 1),
    rated AS (SELECT *, least(greatest(sum(k) OVER () / sum(n) OVER (), 1e-9), 1 - 1e-9) AS p, len(word) - len(replace(word, '.', '')) AS inner_stops FROM counted),
    scored AS (SELECT word, n, k AS with_stop, 2 * (k * ln({N.WITH_STOP}) + (n - k) * ln(1 - {N.WITH_STOP}) - k * ln(p) - (n - k) * ln(1 - p))
      * exp(-(len(word) - inner_stops)) * (inner_stops + 1) * pow((len(word) - inner_stops)::DOUBLE, -(n - k)) AS score FROM rated WHERE k > 0),
    model AS (SELECT * FROM scored WHERE score >= {N.LEAST_SCORE})"""


@query(f"WITH {_SQL_MODEL} SELECT word, n, with_stop, round(score, 6) AS score FROM model")
def sentence_model(spark, sf):
    """Abbreviations learned from all documents."""
    return N.abbreviations(_abbreviated(spark, sf), "text").withColumn("score", F.round("score", 6))


@query(f"""WITH {_SQL_MODEL}, parts AS (SELECT doc_id, unnest(s) AS part, unnest(range(len(s))) AS pos FROM (SELECT doc_id, {C.sql_sentences('text')} AS s FROM short)),
    ends AS (SELECT *, {_SQL_BARE.format(f"regexp_extract(part, '[^{C.SPACE}]+$')")} AS t FROM parts),
    goes AS (SELECT doc_id, pos, part, ends_with(t, '.') AND (left(t, len(t) - 1) IN (SELECT word FROM model) OR regexp_matches(t, '^\\p{{L}}\\.$')) AS goes_on FROM ends),
    numbered AS (SELECT *, coalesce(sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM goes)
    SELECT doc_id, s::INT AS pos, string_agg(part, ' ' ORDER BY pos) AS sentence FROM numbered GROUP BY doc_id, s""")
def sentence_split_trained(spark, sf):
    """Sentences of all documents, not split behind learned abbreviations and initials."""
    docs = _abbreviated(spark, sf)
    model = materialise(N.abbreviations(docs, "text").select("word"), "abbreviations")
    return N.split_sentences(docs, "text", model).select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))


_SQL_AFTER = f"""{_SQL_SENTENCES}, counted_s AS (SELECT *, coalesce(sum(len(regexp_extract_all(sentence, '[^{C.SPACE}]+')))
    OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sents),
    after AS (SELECT * FROM counted_s WHERE before >= {V.SKIP_WORDS})"""
# Shorter than the library's limits, so both take effect on this corpus.
MAX_CHARS, CAP = 120, 10


@query(f"""WITH {_SQL_AFTER} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos,
    sentence FROM after WHERE length(sentence) < {MAX_CHARS}""")
def sentence_select(spark, sf):
    kept = X.short_sentences(X.skip_leading_sentences(X.sentences(F.col("text"))), MAX_CHARS)
    return texts(spark, sf).select("doc_id", F.posexplode(kept).alias("pos", "sentence"))


@query(f"""WITH {_SQL_AFTER}, short AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, sentence
      FROM after WHERE length(sentence) < {V.MAX_SENTENCE_CHARS}),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('1:' || doc_id || ':' || i), i) AS r FROM short)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, sentence
    FROM drawn WHERE r <= {CAP}""")
def sentence_cap(spark, sf):
    kept = X.sentences_to_encode(F.col("text"), F.col("doc_id"), max_chars=V.MAX_SENTENCE_CHARS, cap=CAP)
    return texts(spark, sf).select("doc_id", F.posexplode(kept).alias("pos", "sentence"))


@query(f"""WITH {_SQL_AFTER}, joined AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS t FROM after GROUP BY 1)
    SELECT doc_id, coalesce(t, '') AS to_encode FROM documents LEFT JOIN joined USING (doc_id)""")
def text_to_encode(spark, sf):
    return _docs(spark, sf, X.text_to_encode(F.col("text")), "to_encode")


# Stand-in token ids: word lengths between a start and an end marker.
MAX_LEN = 64
_SQL_IDS = f"""ids AS (SELECT doc_id, [length(x) + 3 FOR x IN regexp_extract_all(text, '{C.WORD}+')] AS t FROM documents)"""
_SQL_CHUNKS = f"""{_SQL_IDS}, starts AS (SELECT doc_id, t, unnest(range(0, len(t), {MAX_LEN})) AS st FROM ids),
    chunks AS (SELECT doc_id, CAST(st / {MAX_LEN} AS INTEGER) AS chunk, [0] || t[st + 1 : st + {MAX_LEN}] || [2] AS c FROM starts)"""


def _ids():
    words = F.regexp_extract_all("text", F.lit(C.WORD + "+"), F.lit(0))
    return F.concat(F.array(F.lit(0)), F.transform(words, lambda w: F.length(w) + 3), F.array(F.lit(2)))


def _joined(name):
    return F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), " ").alias(name)


@query(f"""WITH {_SQL_CHUNKS} SELECT doc_id, chunk, array_to_string(c, ' ') AS input_ids, CAST(len(c) AS INTEGER) AS attended
    FROM chunks""")
def chunk_tokens(spark, sf):
    chunks = texts(spark, sf).select("doc_id", F.explode(E.chunk_tokens(_ids(), MAX_LEN, False)).alias("c"))
    attended = F.aggregate("c.attention_mask", F.lit(0), lambda a, x: a + x).alias("attended")
    return chunks.select("doc_id", F.col("c.chunk").alias("chunk"), F.col("c.input_ids").alias("input_ids"), attended) \
        .select("doc_id", "chunk", _joined("input_ids"), "attended")


@query(f"""WITH {_SQL_CHUNKS}, firsts AS (SELECT doc_id, chunk, c, (row_number() OVER (ORDER BY doc_id, chunk) - 1) // {V.ENCODER_BATCH} AS batch
      FROM chunks), m AS (SELECT *, max(len(c)) OVER (PARTITION BY batch) AS longest FROM firsts)
    SELECT doc_id, chunk, batch, array_to_string(c || [{V.PAD_TOKEN} FOR x IN range(longest - len(c))], ' ') AS input_ids,
      array_to_string([1 FOR x IN c] || [{V.PAD_ATTENTION} FOR x IN range(longest - len(c))], ' ') AS attention_mask
    FROM m""")
def pad_batches(spark, sf):
    chunks = texts(spark, sf).select("doc_id", F.explode(E.chunk_tokens(_ids(), MAX_LEN)).alias("c")) \
        .select("doc_id", "c.chunk", "c.input_ids", "c.attention_mask")
    return E.pad_batches(chunks, ["doc_id", "chunk"]).select("doc_id", "chunk", "batch", _joined("input_ids"), _joined("attention_mask"))


@query(f"""WITH {_SQL_CHUNKS} SELECT doc_id, round(avg(len(c)), 6) AS mean_length, round(avg(list_sum(c)), 6) AS mean_sum
    FROM chunks GROUP BY doc_id""")
def embed_chunks(spark, sf):
    docs = texts(spark, sf).select("doc_id", _ids().alias("ids"))

    def encode(chunks):
        return chunks.withColumn("vector", F.array(
            F.size("input_ids").cast("double"),
            F.aggregate("input_ids", F.lit(0), lambda a, x: a + x).cast("double")))

    pooled = E.embed_chunks(docs, "doc_id", "ids", encode, MAX_LEN, first_only=False)
    return pooled.select("doc_id", F.round(F.col("embedding")[0], 6).alias("mean_length"),
                         F.round(F.col("embedding")[1], 6).alias("mean_sum"))


@query("""WITH v AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings)
    SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM v GROUP BY label, dim""")
def mean_pool(spark, sf):
    pooled = E.mean_pool(table(spark, sf, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "mean")) \
        .withColumn("mean", F.round("mean", 6))


_SQL_HASHED = f"""{_SQL_AFTER}, sw AS (SELECT doc_id, pos, md5(unnest(regexp_extract_all(lower(sentence), '[^{C.SPACE}]+')))[1:2] AS b
      FROM after),
    tf AS (SELECT doc_id, pos, b, count(*) AS n FROM sw GROUP BY ALL),
    unit AS (SELECT doc_id, pos, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, pos)) AS w FROM tf),
    per_doc AS (SELECT doc_id, count(*) AS sentences FROM after GROUP BY 1)"""


@query(f"""WITH {_SQL_HASHED}, pooled AS (SELECT doc_id, CAST(('0x' || b) AS INTEGER) AS dim, round(sum(w) / any_value(sentences), 6) AS weight
      FROM unit JOIN per_doc USING (doc_id) GROUP BY doc_id, b)
    SELECT doc_id, dim, weight FROM pooled
    UNION ALL SELECT doc_id, CAST(-1 AS INTEGER), CAST(0 AS DOUBLE) FROM documents ANTI JOIN per_doc USING (doc_id)""")
def embed_documents(spark, sf):
    docs = texts(spark, sf)
    vectors = E.embed_documents(docs, "doc_id", "text", E.hashing_encoder())
    # a document without sentences has a null embedding and appears once with dim -1
    long = vectors.select("doc_id", F.posexplode_outer("embedding").alias("dim", "weight"))
    return long.filter("dim IS NULL OR weight <> 0").select(
        "doc_id", F.coalesce("dim", F.lit(-1)).alias("dim"), F.coalesce(F.round("weight", 6), F.lit(0.0)).alias("weight"))


# A small model: counts of three letters against weights, one output cut off below.
_LETTERS, _WEIGHTS = "eta", ((1.1, -2.3, 0.7), (0.3, 0.55, -1.05))


def _load_model():
    weights = np.array(_WEIGHTS)

    def predict(sentences):
        counts = np.array([[s.count(c) for c in _LETTERS] for s in sentences], float).reshape(-1, len(_LETTERS))
        return np.maximum(counts @ weights.T, 0)

    return predict


_SQL_COUNTS = ", ".join(f"len(sentence) - len(replace(sentence, '{c}', '')) AS n{i}" for i, c in enumerate(_LETTERS))
_SQL_OUTPUTS = ", ".join("round(avg(greatest(" + " + ".join(f"{w} * n{i}" for i, w in enumerate(row)) + f", 0)), 9) AS out{k}" for k, row in enumerate(_WEIGHTS))


@query(f"""WITH {_SQL_AFTER}, counts AS (SELECT doc_id, {_SQL_COUNTS} FROM after), pooled AS (SELECT doc_id, {_SQL_OUTPUTS} FROM counts GROUP BY doc_id)
    SELECT doc_id, out0, out1 FROM documents LEFT JOIN pooled USING (doc_id)""")
def embed_batches(spark, sf):
    """Sentence vectors of a model that the workers load, averaged per document."""
    vectors = E.embed_documents(texts(spark, sf), "doc_id", "text", E.batch_encoder(_load_model))
    return vectors.select("doc_id", *[F.round(F.col("embedding")[k], 9).alias(f"out{k}") for k in range(len(_WEIGHTS))])
