import hashlib

import pytest
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.operators import evaluation as E, significance as G

# F1 of class 1, F1 of class 0, macro-F1, accuracy on the 100 published test rows.
PUBLISHED = {
    "base_pred": (0.2906, 0.0, 0.1453, 0.17), "tfidf_pred": (0.7742, 0.9586, 0.8664, 0.93),
    "USE_sk_pred": (0.7097, 0.9467, 0.8282, 0.91), "sBERT_sk_pred": (0.6486, 0.9202, 0.7844, 0.87),
    "tfidf_keras_pred": (0.6061, 0.9222, 0.7641, 0.87), "USE_keras_pred": (0.6829, 0.9182, 0.8006, 0.87),
    "sBERT_keras_pred": (0.6190, 0.8987, 0.7589, 0.84),
}


def test_published_scores(spark):
    got = {r["model"]: r for r in E.scores(E.published_counts(spark)).collect()}
    for model, expected in PUBLISHED.items():
        r = got[model]
        assert [round(r[c], 4) for c in ("f1_1", "f1_0", "macro_f1", "accuracy")] == pytest.approx(expected, abs=1.1e-4)


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_counts_expand_to_rows_and_back(spark, chunk):
    rows = E.expand_counts(E.published_counts(spark), ["model"], chunk)
    assert rows.count() == 700
    assert rows.groupBy("model", "label", "correct", "n").count().filter("count > 1").isEmpty()
    wide = rows.withColumn("prediction", F.when(F.col("correct") == 1, F.col("label")).otherwise(1 - F.col("label")))
    got = {r["model"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in E.confusion_counts(wide, ["model"]).collect()}
    assert got == V.PUBLISHED_COUNTS
    scored = E.macro_f1_of_correct(E.correct_counts(rows, ["model"])).collect()
    assert {r["model"]: round(r["macro_f1"], 4) for r in scored} == pytest.approx({m: p[2] for m, p in PUBLISHED.items()}, abs=1.1e-4)


def test_fold_baseline_figure(spark):
    folds = spark.createDataFrame([(f, 14 if f == 0 else 13) for f in range(5)], "fold int, pos int") \
        .selectExpr("fold", "pos tp", "80 - pos fp", "0 fn", "0 tn")
    assert round(E.mean_of_folds(E.scores(folds).withColumn("s", F.lit(1)), ["s"]).first()["mean_score"], 4) == 0.1416


def test_edge_scores(spark):
    df = spark.createDataFrame([("a", 0, 5, 3, 4), ("b", 5, 5, 0, 4)], "model string, c1 int, n1 int, c0 int, n0 int")
    plain = {r["model"]: r["macro_f1"] for r in E.macro_f1_of_correct(df).collect()}
    other = {r["model"]: r["macro_f1"] for r in E.macro_f1_of_correct(df, zero_tp=1).collect()}
    assert other["a"] - plain["a"] == pytest.approx(0.5) and other["b"] == plain["b"] == pytest.approx(10 / 14 / 2)


def test_report_and_matrix(spark):
    df = spark.createDataFrame([(1, 1)] * 12 + [(1, 0)] * 2 + [(0, 1)] * 5 + [(0, 0)] * 81, "prediction int, label int")
    matrix = [(r["label_1"], r["label_0"]) for r in E.confusion_matrix(df).collect()]
    assert matrix == [(12, 2), (5, 81)]
    report = {r["class"]: r for r in E.classification_report(E.confusion_counts(df)).collect()}
    assert report[1]["precision"] == pytest.approx(12 / 14) and report[1]["recall"] == pytest.approx(12 / 17)
    assert report[0]["support"] == 83 and report[0]["f1"] == pytest.approx(2 * 81 / (2 * 81 + 7))


def test_best_setting_first_wins(spark):
    df = spark.createDataFrame([(2, 0.5), (1, 0.7), (3, 0.7)], "setting int, mean_score double")
    assert E.best_setting(df).first()["setting"] == 1


def test_scoreboard(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 1, 1), (0, 0, 1)], "label int, a int, b int")
    assert {r["model"]: r["correct"] for r in E.scoreboard(df, ["a", "b"]).collect()} == {"a": 2, "b": 2}


# --- permutation test -------------------------------------------------------------------------

def _f1(c1, n1, c0, n0, zero_tp=0.0):
    one = zero_tp if c1 == 0 else 2 * c1 / (2 * c1 + (n0 - c0) + (n1 - c1))
    zero = 0 if c0 == 0 else 2 * c0 / (2 * c0 + (n1 - c1) + (n0 - c0))
    return (one + zero) / 2


def _permute(rows, worse, better, n, seed, ties):
    """Row by row, permutation by permutation."""
    def stat(pairs):
        n1, n0 = sum(y for y, *_ in pairs), sum(1 - y for y, *_ in pairs)
        score = [_f1(sum(p[i] for p in pairs if p[0]), n1, sum(p[i] for p in pairs if not p[0]), n0) for i in (1, 2)]
        return score[1] - score[0]
    base = [(r["label"], r[worse], r[better]) for r in rows]
    observed, hits = stat(base), 0
    for perm in range(n):
        swapped = []
        for r in rows:
            text = f"{seed}:{worse}|{better}:{perm // 60}:{r['row_id']}"
            coin = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) >> (perm % 60) & 1
            pair = (r[worse], r[better])
            swapped.append((r["label"], *(pair[::-1] if coin else pair)))
        s = stat(swapped)
        hits += s > observed + 1e-12 if ties == "strict" else s >= observed - 1e-12
    return observed, hits / n if ties == "strict" else (1 + hits) / (n + 1)


@pytest.fixture
def published(spark):
    rows = []
    for y, total in ((1, 17), (0, 83)):
        for i in range(total):
            r = {"row_id": len(rows), "label": y}
            for m, (tp, fp, fn, tn) in V.PUBLISHED_COUNTS.items():
                r[m] = int(i < (tp if y else tn))
            r["same"] = r["tfidf_pred"]
            rows.append(r)
    return rows


@pytest.mark.parametrize("ties", ["count", "strict"])
def test_permutation_against_brute_force(spark, published, ties):
    pairs = [("base_pred", "tfidf_pred"), ("USE_sk_pred", "tfidf_pred"), ("same", "tfidf_pred"), ("tfidf_pred", "USE_sk_pred")]
    got = G.permutation_test(spark.createDataFrame(published), pairs, permutations=130, ties=ties).collect()
    assert len(got) == 4
    for r in got:
        observed, p = _permute(published, r["worse"], r["better"], 130, 1, ties)
        assert r["observed"] == pytest.approx(observed) and r["p_value"] == pytest.approx(p)
        assert r["significant"] == (p < 0.05)
    same = next(r for r in got if r["worse"] == "same")
    assert same["p_value"] == (0.0 if ties == "strict" else 1.0)


def test_all_twelve_published_comparisons(spark, published):
    others = [m for m in V.PUBLISHED_COUNTS if m != "tfidf_pred"]
    pairs = [(m, "tfidf_pred") for m in others] + [("base_pred", m) for m in V.PUBLISHED_COUNTS if m != "base_pred"]
    got = {(r["worse"], r["better"]): r for r in
           G.permutation_test(spark.createDataFrame(published), pairs, permutations=600).collect()}
    assert len(got) == 11  # base against tfidf is in both series
    assert all(r["significant"] for (w, _), r in got.items() if w == "base_pred")


@pytest.mark.parametrize("ties", ["count", "strict"])
def test_exact_p_value(spark, ties):
    """Against every one of the possible swaps, and near the sampled value on the published counts."""
    import itertools
    import random
    for seed in range(4):
        rng = random.Random(seed)
        rows = [{"row_id": i, "label": int(rng.random() < 0.4), "a": rng.randrange(2), "b": rng.randrange(2), "c": 1} for i in range(11)]
        for r in G.exact_test(spark.createDataFrame(rows), [("a", "b"), ("b", "c"), ("c", "c")], ties=ties).collect():
            cells = [(x["label"], x[r["worse"]], x[r["better"]]) for x in rows]
            n1 = sum(y for y, _, _ in cells)

            def stat(coins):
                sides = [(y, *((b, w) if coin else (w, b))) for (y, w, b), coin in zip(cells, coins)]
                score = [_f1(sum(p[i] for p in sides if p[0]), n1, sum(p[i] for p in sides if not p[0]), len(rows) - n1) for i in (1, 2)]
                return score[1] - score[0]

            observed = stat([0] * len(rows))
            hits = [stat(coins) > observed + 1e-12 if ties == "strict" else stat(coins) >= observed - 1e-12 for coins in itertools.product((0, 1), repeat=len(rows))]
            assert r["observed"] == pytest.approx(observed) and r["p_value"] == pytest.approx(sum(hits) / len(hits))


def test_exact_p_value_of_many_rows(spark, published):
    pairs = [("USE_sk_pred", "tfidf_pred"), ("tfidf_pred", "USE_sk_pred")]
    sampled = {r["worse"]: r["p_value"] for r in G.permutation_test(spark.createDataFrame(published), pairs, permutations=3000).collect()}
    for r in G.exact_test(spark.createDataFrame(published), pairs).collect():
        assert r["p_value"] == pytest.approx(sampled[r["worse"]], abs=0.04)
    many = spark.range(400_000).select((F.col("id") % 5 == 0).cast("int").alias("label"), (F.col("id") % 3 > 0).cast("int").alias("a"),
                                       (F.col("id") % 7 > 1).cast("int").alias("b"), F.lit(1).alias("c"))
    got = {(r["worse"], r["better"]): r["p_value"] for r in G.exact_test(many, [("a", "b"), ("b", "a"), ("a", "a")]).collect()}
    assert got["a", "b"] < 1e-6 and got["b", "a"] > 1 - 1e-6 and got["a", "a"] == pytest.approx(1)


def test_threshold(one):
    assert one(lambda c: E.threshold(c), [0.5, 0.51, 0.2], "double") == [0, 1, 0]
