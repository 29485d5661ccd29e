"""Queries over term statistics, TF-IDF, scores and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.operators import evaluation as E, features as T, sampling as S, significance as G
from docketflow.plans import common as C
from docketflow.plans.common import expert, table, texts
from docketflow.plans.registry import Registry
from docketflow.session import materialise

query = Registry()
K, MIN_DF, MAX_DF = 500, 2, 0.8


def _terms(df, ngram=1):
    return df.withColumn("terms", T.analyse(F.col("text"), ngram)).drop("text")


def _docs(spark, sf, ngram=1):
    return _terms(texts(spark, sf), ngram)


def sql_tf(source: str, key: str) -> str:
    return f"""occ AS (SELECT {key}, unnest({C.sql_words('text')}) AS term FROM {source}),
    tf AS (SELECT {key}, term, count(*) AS tf FROM occ GROUP BY ALL)"""


SQL_STATS = "stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term)"


def sql_vocabulary(n: str, source: str = "stats") -> str:
    return f"""vocab AS (SELECT term, cf, df FROM {source} WHERE df >= {MIN_DF} AND df <= {MAX_DF} * {n}
    ORDER BY cf DESC, term LIMIT {K})"""


def _sql_weights(key: str, n: str, tf: str = "tf") -> str:
    return f"""raw AS (SELECT {key}, term, tf * (ln((1 + {n}) / (1 + df)) + 1) AS w FROM {tf} JOIN vocab USING (term)),
    weights AS (SELECT {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 6) AS weight FROM raw)"""


@query(f"WITH {sql_tf('documents', 'doc_id')} SELECT doc_id, term, CAST(tf AS INTEGER) AS tf FROM tf")
def term_frequencies(spark, sf):
    return T.term_frequencies(_docs(spark, sf), "doc_id", "terms")


@query(f"WITH {sql_tf('documents', 'doc_id')}, {SQL_STATS} SELECT term, cf, df FROM stats")
def term_stats(spark, sf):
    return T.term_stats(_docs(spark, sf), "terms")


_SQL_BIGRAMS = f"""w AS (SELECT doc_id, {C.sql_words('text')} AS l FROM documents),
    occ AS (SELECT doc_id, unnest(l || [l[i] || ' ' || l[i + 1] FOR i IN range(1, greatest(len(l), 1))]) AS term FROM w),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL)"""


@query(f"WITH {_SQL_BIGRAMS}, {SQL_STATS}, {sql_vocabulary('(SELECT count(*) FROM documents)')} SELECT term, cf, df FROM vocab")
def vocabulary(spark, sf):
    docs = _docs(spark, sf)
    n_docs = docs.count()
    return T.vocabulary(T.leading_stats(docs, "terms", 2, n_docs, K, MIN_DF, MAX_DF), n_docs, K, MIN_DF, MAX_DF)


@query(f"""WITH {sql_tf('documents', 'doc_id')}, {SQL_STATS}, {sql_vocabulary('(SELECT count(*) FROM documents)')},
    {_sql_weights('doc_id', '(SELECT count(*) FROM documents)')} SELECT doc_id, term, weight FROM weights""")
def tfidf(spark, sf):
    docs = _docs(spark, sf)
    model = T.fit_tfidf(docs, "terms", K, MIN_DF, MAX_DF)
    return T.weights_long(model.transform(docs), "doc_id", model).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {C.SQL_EXPERT}, {C.sql_split('expert', 'link', 'label')},
    sided AS (SELECT e.link, e.text, s.split FROM expert e JOIN split_of s ON s.link = e.link),
    {sql_tf("sided", "link, split")}, train_tf AS (SELECT * FROM tf WHERE split = 'train'),
    stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM train_tf GROUP BY term),
    {sql_vocabulary("(SELECT count(*) FROM sided WHERE split = 'train')")},
    test_tf AS (SELECT link, term, tf FROM tf WHERE split = 'test'),
    {_sql_weights('link', "(SELECT count(*) FROM sided WHERE split = 'train')", 'test_tf')}
    SELECT link, term, weight FROM weights""")
def tfidf_transform(spark, sf):
    sided = _terms(S.stratified_split(expert(spark, sf).select("link", "label", "text")))
    model = T.fit_tfidf(sided.filter("split = 'train'"), "terms", K, MIN_DF, MAX_DF)
    test = model.transform(sided.filter("split = 'test'"))
    return T.weights_long(test, "link", model).withColumn("weight", F.round("weight", 6))


# --- scores of rule classifiers ---------------------------------------------------------------

def _counts(spark, sf):
    return E.confusion_counts(C.rules_long(expert(spark, sf)), ["model"])


_SQL_SCORED = f"{C.SQL_RULES_LONG}, {C.sql_scores('model', 'rules_long')}"


@query(f"""WITH {C.SQL_RULES_LONG} SELECT prediction, count(*) FILTER (label = 1) AS label_1,
    count(*) FILTER (label = 0) AS label_0 FROM rules_long WHERE model = 'the' GROUP BY prediction ORDER BY prediction DESC""")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(C.rules_long(expert(spark, sf)).filter("model = 'the'"))


@query(f"""WITH {_SQL_SCORED}, r AS (
    SELECT model, 0 AS class, tn AS hit, fn AS extra, fp AS miss FROM counted UNION ALL
    SELECT model, 1, tp, fp, fn FROM counted)
    SELECT model, class, round(CASE WHEN hit + extra > 0 THEN hit / (hit + extra) ELSE 0 END, 9) AS precision,
      round(CASE WHEN hit + miss > 0 THEN hit / (hit + miss) ELSE 0 END, 9) AS recall,
      round(CASE WHEN 2*hit + extra + miss > 0 THEN 2*hit / (2*hit + extra + miss) ELSE 0 END, 9) AS f1,
      hit + miss AS support FROM r""")
def classification_report(spark, sf):
    report = E.classification_report(_counts(spark, sf), ["model"])
    return report.select("model", "class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_SQL_SCORED} SELECT model, round(f1_1, 9) AS f1_1, round(f1_0, 9) AS f1_0, round(macro_f1, 9) AS macro_f1 FROM scored")
def macro_f1(spark, sf):
    return E.scores(_counts(spark, sf)).select("model", *[F.round(c, 9).alias(c) for c in ("f1_1", "f1_0", "macro_f1")])


@query(f"WITH {_SQL_SCORED} SELECT model, round(accuracy, 9) AS accuracy FROM scored")
def accuracy(spark, sf):
    return E.scores(_counts(spark, sf)).select("model", F.round("accuracy", 9).alias("accuracy"))


_SQL_CORRECT_LONG = C.SQL_RULES_CORRECT + """, correct_long AS (
    UNPIVOT rules_correct ON "base", "the", "und", "able", "que" INTO NAME model VALUE correct),
    cc AS (SELECT model, sum(correct) FILTER (label = 1) AS c1, count(*) FILTER (label = 1) AS n1,
      sum(correct) FILTER (label = 0) AS c0, count(*) FILTER (label = 0) AS n0 FROM correct_long GROUP BY model),
    own AS (SELECT *, CASE WHEN c1 = 0 THEN {zero} ELSE 2 * c1 / (2 * c1 + (n0 - c0) + (n1 - c1)) END AS one,
      CASE WHEN c0 = 0 THEN 0.0 ELSE 2 * c0 / (2 * c0 + (n1 - c1) + (n0 - c0)) END AS zero FROM cc)"""


@query(f"WITH {_SQL_CORRECT_LONG.replace('{zero}', '1.0')} SELECT model, round((one + zero) / 2, 9) AS macro_f1 FROM own")
def macro_f1_custom(spark, sf):
    long = C.rules_correct(expert(spark, sf)).unpivot(["link", "label"], list(C.RULES), "model", "correct")
    scored = E.macro_f1_of_correct(E.correct_counts(long, ["model"]), zero_tp=1.0)
    return scored.select("model", F.round("macro_f1", 9).alias("macro_f1"))


@query(f"""WITH {_SQL_CORRECT_LONG.replace('{zero}', '0.0')} SELECT model, CAST(c1 + c0 AS BIGINT) AS correct,
    round((one + zero) / 2, 9) AS macro_f1 FROM own""")
def model_scoreboard(spark, sf):
    board = E.scoreboard(C.rules_correct(expert(spark, sf)), list(C.RULES))
    return board.withColumn("macro_f1", F.round("macro_f1", 9))


@query(f"""WITH {_SQL_SCORED}, cells AS (SELECT model, 1 AS label, 1 AS correct, tp AS size FROM counted UNION ALL
      SELECT model, 1, 0, fn FROM counted UNION ALL SELECT model, 0, 1, tn FROM counted UNION ALL
      SELECT model, 0, 0, fp FROM counted)
    SELECT model, label, correct, unnest(range(1, size + 1)) AS n FROM cells""")
def published_predictions(spark, sf):
    return E.expand_counts(_counts(spark, sf), ["model"], chunk=50)


@query(f"""WITH {C.SQL_EXPERT}, {C.sql_split('expert', 'link', 'label')}, p AS (SELECT label, 1 AS prediction FROM split_of
    WHERE split = 'test'), {C.sql_scores('', 'p')}
    SELECT tp, fp, fn, tn, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy FROM scored""")
def baseline_all_positive(spark, sf):
    test = S.stratified_split(expert(spark, sf).select("link", "label")).filter("split = 'test'")
    counted = E.confusion_counts(test.withColumn("prediction", F.lit(1)))
    return E.scores(counted).select("tp", "fp", "fn", "tn", F.round("macro_f1", 9).alias("macro_f1"),
                                    F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH {C.SQL_EXPERT}, {C.sql_folds('expert', 'link', 'label')}, p AS (SELECT fold, label, 1 AS prediction FROM fold_of),
    {C.sql_scores('fold', 'p')} SELECT count(*) AS folds, round(avg(macro_f1), 9) AS mean_score FROM scored""")
def fold_baseline(spark, sf):
    folds = S.stratified_folds(expert(spark, sf).select("link", "label")).withColumn("prediction", F.lit(1))
    scored = E.scores(E.confusion_counts(folds, ["fold"]))
    return scored.agg(F.count("*").alias("folds"), F.round(F.avg("macro_f1"), 9).alias("mean_score"))


@query(f"""WITH {C.SQL_RULES_LONG}, {C.sql_folds('expert', 'link', 'label')},
    p AS (SELECT r.model || '/' || f.fold AS cell, r.label, r.prediction FROM rules_long r JOIN fold_of f ON f.link = r.link),
    {C.sql_scores('cell', 'p')}, means AS (SELECT split_part(cell, '/', 1) AS setting, avg(round(macro_f1, 9)) AS mean_score
      FROM scored GROUP BY 1)
    SELECT setting, round(mean_score, 8) AS mean_score FROM means ORDER BY means.mean_score DESC, setting LIMIT 1""")
def best_setting(spark, sf):
    folds = S.stratified_folds(expert(spark, sf).select("link", "label")).select("link", "fold")
    cells = C.rules_long(expert(spark, sf)).join(folds, "link")
    scored = E.scores(E.confusion_counts(cells, ["model", "fold"])) \
        .select(F.col("model").alias("setting"), F.round("macro_f1", 9).alias("macro_f1"))
    return E.best_setting(E.mean_of_folds(scored, ["setting"])) \
        .select("setting", F.round("mean_score", 8).alias("mean_score"))


@query("""SELECT vec_id, CAST(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) > 0.5 AS INTEGER) AS prediction FROM embeddings""")
def threshold_scores(spark, sf):
    score = 1 / (1 + F.exp(-F.col("embedding")[0].cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", E.threshold(score).alias("prediction"))


# Every baseline and rule against others, as many pairs as the reference compares.
PAIRS = [("base", "the"), ("base", "able"), ("base", "und"), ("base", "que"), ("und", "able"), ("que", "able"), ("the", "able"),
         ("und", "the"), ("que", "the"), ("que", "und"), ("able", "the"), ("und", "que")]
PERMUTATIONS = V.PERMUTATIONS


def _sql_permutation() -> str:
    pairs = " UNION ALL ".join(f"""SELECT link, label, '{w}' AS worse, '{b}' AS better, "{w}" AS w, "{b}" AS b FROM rules_correct"""
                               for w, b in PAIRS)

    def f1(c1, c0):
        return (f"((CASE WHEN {c1} = 0 THEN 0.0 ELSE 2 * ({c1}) / (2 * ({c1}) + (n0 - ({c0})) + (n1 - ({c1}))) END)"
                f" + (CASE WHEN {c0} = 0 THEN 0.0 ELSE 2 * ({c0}) / (2 * ({c0}) + (n1 - ({c1})) + (n0 - ({c0}))) END)) / 2")

    return f"""WITH {C.SQL_RULES_CORRECT}, paired AS ({pairs}),
    base AS (SELECT worse, better, sum(label) AS n1, sum(1 - label) AS n0, sum(w * label) AS w1, sum(w * (1 - label)) AS w0,
      sum(b * label) AS b1, sum(b * (1 - label)) AS b0, count(*) FILTER (w <> b AND label = 1) AS k1, count(*) FILTER (w <> b AND label = 0) AS k0,
      count(*) FILTER (w > b AND label = 1) AS d1, count(*) FILTER (w > b AND label = 0) AS d0 FROM paired GROUP BY ALL),
    hashed AS (SELECT worse, better, label, b - w AS move, block, CAST('0x' || md5('{C.SEED}:' || worse || '|' || better || ':' ||
      block || ':' || link)[1:15] AS BIGINT) AS h FROM paired, range({-(-PERMUTATIONS // G.COINS)}) t(block) WHERE w <> b),
    tossed AS (SELECT worse, better, label, block * {G.COINS} + j AS perm, move * ((h >> j) & 1) AS m
      FROM (SELECT *, unnest(range({G.COINS})) AS j FROM hashed)),
    moved AS (SELECT worse, better, perm, sum(m * label) AS m1, sum(m * (1 - label)) AS m0 FROM tossed
      WHERE perm < {PERMUTATIONS} GROUP BY ALL),
    stats AS (SELECT m.worse, m.better, {f1('(b1 - m1)', '(b0 - m0)')} - {f1('(w1 + m1)', '(w0 + m0)')} AS stat,
      {f1('b1', 'b0')} - {f1('w1', 'w0')} AS observed FROM moved m JOIN base USING (worse, better)),
    tested AS (SELECT worse, better, any_value(observed) AS observed, (1 + count(*) FILTER (stat >= observed)) / ({PERMUTATIONS} + 1) AS p
      FROM stats GROUP BY ALL),
    swaps AS (SELECT *, unnest(range(k1::BIGINT + 1)) AS h1 FROM base), grid AS (SELECT *, unnest(range(k0::BIGINT + 1)) AS h0 FROM swaps),
    chances AS (SELECT worse, better, {f1('b1', 'b0')} - {f1('w1', 'w0')} AS observed,
      {f1('(b1 - h1 + d1)', '(b0 - h0 + d0)')} - {f1('(w1 + h1 - d1)', '(w0 + h0 - d0)')} AS stat,
      exp(lgamma(k1 + 1) - lgamma(h1 + 1) - lgamma(k1 - h1 + 1) + lgamma(k0 + 1) - lgamma(h0 + 1) - lgamma(k0 - h0 + 1) - (k1 + k0) * ln(2)) AS chance FROM grid),
    exact AS (SELECT worse, better, sum(chance) FILTER (stat >= observed - 1e-12) AS p_exact FROM chances GROUP BY ALL)
    SELECT worse, better, round(observed, 9) AS observed, round(p, 9) AS p_value, p < {V.SIGNIFICANCE} AS significant, round(p_exact, 8) AS p_exact
    FROM tested JOIN exact USING (worse, better)"""


@query(_sql_permutation())
def permutation_test(spark, sf):
    """All pairs with the sampled p-value and, beside it, the one that all permutations together give."""
    correct = materialise(C.rules_correct(expert(spark, sf)), "correct")
    tested = G.permutation_test(correct, PAIRS, "link", permutations=PERMUTATIONS, seed=C.SEED)
    exact = G.exact_test(correct, PAIRS).select("worse", "better", F.round("p_value", 8).alias("p_exact"))
    return tested.join(exact, ["worse", "better"]).select(
        "worse", "better", F.round("observed", 9).alias("observed"), F.round("p_value", 9).alias("p_value"), "significant", "p_exact")
