import inspect
from itertools import product

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SMALL
from docketflow import fixed_values as V
from docketflow.functions.text import feature_words
from docketflow.operators import features as T, linear as L, network as N, search as R, training as D
from docketflow.plans import all_queries
from docketflow.session import scratch_path


def _data(n=120, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=d) + 0.7 * rng.normal(size=n) > 0.3).astype(int)
    return x, y, np.arange(n) % 5


def _frame(spark, x, y, fold, sparse=False):
    def vector(row):
        return Vectors.sparse(len(row), [(i, float(v)) for i, v in enumerate(row) if v]) if sparse else Vectors.dense(row)
    rows = [(int(i), vector(r), int(c), int(f)) for i, (r, c, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, ["key", "features", "label", "fold"]).repartition(4, "key")


def _objective(w, x, y, c, loss):
    gap = np.maximum(1 - (2 * y - 1) * (np.hstack([x, np.ones((len(x), 1))]) @ w), 0)
    return 0.5 * w @ w + c * (gap @ gap if loss == "squared_hinge" else gap.sum())


def _dual_optimum(x, y, c, loss):
    """Coordinate descent on the dual, the textbook solver for both losses."""
    z = (2 * y - 1)[:, None] * np.hstack([x, np.ones((len(x), 1))])
    top, extra = (np.inf, 1 / (2 * c)) if loss == "squared_hinge" else (c, 0.0)
    a, w, size = np.zeros(len(x)), np.zeros(z.shape[1]), (z * z).sum(1) + extra
    for _ in range(3000):
        for i in range(len(x)):
            new = min(max(a[i] - (z[i] @ w - 1 + extra * a[i]) / size[i], 0), top)
            w += (new - a[i]) * z[i]
            a[i] = new
    return w


@pytest.mark.parametrize("sparse", [False, True])
def test_svms_reach_the_optimum(spark, sparse):
    x, y, fold = _data()
    if sparse:
        x[np.abs(x) < 0.8] = 0
    rows = D.training_rows(_frame(spark, x, y, fold, sparse)).cache()
    settings = [L.SvmSetting(c, loss, 0, f) for c in (0.1, 2) for loss in ("hinge", "squared_hinge") for f in (None, 1)]
    models = L.fit_svms(rows, settings, 5, max_passes=150, tolerance=1e-5)
    for s, m in zip(settings, models):
        used = np.ones(len(y), bool) if s.holdout is None else fold != s.holdout
        best = _objective(_dual_optimum(x[used], y[used], s.C, s.loss), x[used], y[used], s.C, s.loss)
        got = _objective(np.array([*m.weights, m.intercept]), x[used], y[used], s.C, s.loss)
        # the rounded corner may cost C * n * width / 2; the smooth loss is met closely
        slack = 1e-6 * best + (s.C * used.sum() * L.HINGE_CORNER / 2 if s.loss == "hinge" else 0)
        assert best - 1e-6 <= got <= best + slack


def test_scores_inside_spark_match(spark):
    x, y, fold = _data(30)
    df = _frame(spark, x, y, fold, sparse=True)
    model = L.LinearModel([0.5, -1.0, 2.0, 0.0, 0.25], -0.1, {"C": 1})
    path = scratch_path(spark, "t-svm")
    model.save(spark, path)
    for m in (model, L.LinearModel.load(spark, path)):
        got = {r["key"]: (r["score"], r["prediction"]) for r in m.predict(m.decision(df)).collect()}
        for i, row in enumerate(x):
            s = row @ np.array(model.weights) + model.intercept
            assert got[i] == (pytest.approx(s), int(s > 0))


def test_holdout_counts(spark):
    x, y, fold = _data(50)
    rows = D.training_rows(_frame(spark, x, y, fold))
    model = L.LinearModel([1.0, 0, 0, 0, 0], 0.0)
    got = L.holdout_counts(rows, [model] * 2, [L.SvmSetting(holdout=2), L.SvmSetting()], 5)
    for used, c in zip((fold == 2, np.ones(50, bool)), got):
        hit = x[:, 0] > 0
        assert c.tolist() == [(used & hit & (y == 1)).sum(), (used & hit & (y == 0)).sum(),
                              (used & ~hit & (y == 1)).sum(), (used & ~hit & (y == 0)).sum()]


def test_models_are_dealt_over_passes(spark, monkeypatch):
    x, y, fold = _data(60)
    rows = D.training_rows(_frame(spark, x, y, fold)).cache()
    settings = [L.SvmSetting(), L.SvmSetting(loss="hinge"), L.SvmSetting(C=3, holdout=2)]
    weights = np.random.default_rng(1).normal(size=(3, 6))
    at_once = L.objective(rows, settings, weights)
    monkeypatch.setattr(D, "PASS_WEIGHTS", 6)
    assert D.passes_for(3, 6) == 3
    for a, b in zip(vars(at_once).values(), vars(L.objective(rows, settings, weights)).values()):
        assert np.allclose(a, b)


def test_gradients_added_by_spark_and_by_the_driver_agree(spark, monkeypatch):
    x, y, fold = _data(60)
    rows = D.training_rows(_frame(spark, x, y, fold)).cache()
    settings, weights = [L.SvmSetting(), L.SvmSetting(loss="hinge")], np.full((2, 6), 0.1)
    here = L.objective(rows, settings, weights)
    monkeypatch.setattr(D, "DRIVER_NUMBERS", 0)
    for a, b in zip(vars(here).values(), vars(L.objective(rows, settings, weights)).values()):
        assert np.allclose(a, b)


def test_every_pass_bounds_the_optimum(spark):
    """Objective and lower bound against the plain formulas and the dual solver, at any weights."""
    x, y, fold = _data(80)
    rows = D.training_rows(_frame(spark, x, y, fold)).cache()
    settings = [L.SvmSetting(c, loss) for c in (0.1, 2) for loss in ("hinge", "squared_hinge")]
    found = L.objective(rows, settings, np.random.default_rng(3).normal(size=(4, 6)) * 0.3)
    weights = np.random.default_rng(3).normal(size=(4, 6)) * 0.3
    for k, s in enumerate(settings):
        best = _objective(_dual_optimum(x, y, s.C, s.loss), x, y, s.C, s.loss)
        assert found.primal[k] == pytest.approx(_objective(weights[k], x, y, s.C, s.loss))
        assert found.dual[k] <= best <= found.primal[k]


def test_svms_come_with_a_certificate(spark):
    x, y, fold = _data()
    rows = D.training_rows(_frame(spark, x, y, fold)).cache()
    settings = [L.SvmSetting(c, loss, 0, f) for c in (0.1, 5) for loss in ("hinge", "squared_hinge") for f in (None, 1)]
    for s, m in zip(settings, L.fit_svms(rows, settings, 5)):
        used = np.ones(len(y), bool) if s.holdout is None else fold != s.holdout
        best = _objective(_dual_optimum(x[used], y[used], s.C, s.loss), x[used], y[used], s.C, s.loss)
        got = _objective(np.array([*m.weights, m.intercept]), x[used], y[used], s.C, s.loss)
        assert m.report["stopped"] == 0 and m.report["gap"] <= L.GAP
        assert m.report["primal"] == pytest.approx(got) and m.report["dual"] <= best * (1 + 1e-9) and got <= best * (1 + L.GAP)
    with pytest.warns(UserWarning, match="stopped after 2 passes"):
        stopped = L.fit_svms(rows, settings[:1], 5, max_passes=2)[0]
    assert stopped.report["stopped"] == 1 and stopped.report["gap"] > L.GAP


def test_no_rows(spark):
    rows = D.training_rows(_frame(spark, *_data(10))).limit(0)
    model = L.fit_svms(rows, [L.SvmSetting()], 5)[0]
    assert model.weights == [0.0] * 5 and model.report["stopped"] == 0


def test_a_million_terms(spark):
    """Rows are scored and listed over their own terms; nothing is as long as the vocabulary but the vocabulary."""
    size = 1_000_000
    model = T.Tfidf([f"t{i:07d}" for i in range(size)], [1.0 + i % 7 for i in range(size)])
    df = spark.createDataFrame([(0, ["t0000003", "t0999999", "t0999999"]), (1, ["none"]), (2, [])], "k int, terms array<string>")
    weighted = model.transform(df)
    svm = L.LinearModel([((i * 13) % 5 - 2) / 4 for i in range(size)], 0.25)
    idf = [1.0 + 3 % 7, 2 * (1.0 + 999_999 % 7)]
    norm = np.hypot(*idf)
    want = {"t0000003": idf[0] / norm, "t0999999": idf[1] / norm}
    assert {r["term"]: r["weight"] for r in T.weights_long(weighted, "k", model).collect()} == pytest.approx(want)
    got = {r["k"]: r["score"] for r in svm.decision(weighted).select("k", "score").collect()}
    assert got == pytest.approx({0: 0.25 + want["t0000003"] * svm.weights[3] + want["t0999999"] * svm.weights[999_999], 1: 0.25, 2: 0.25})


def test_view_scales_and_normalises():
    block = np.array([[1.0, 2.0], [0.0, 0.0]])
    out = D.View(np.array([3.0, 2.0]), unit=True)(block)
    assert out.tolist() == [[0.6, 0.8], [0.0, 0.0]]


# --- networks ---------------------------------------------------------------------------------

def _network_loss(flat, s, x, y):
    p = np.clip(N._probability(x, flat, s.units), 1e-12, 1 - 1e-12)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


def test_network_gradient_is_the_slope_of_the_loss(spark):
    x, y, fold = _data(40, 3)
    rows = D.training_rows(_frame(spark, x, y, fold), key="key").cache()
    s = N.MlpSetting(units=4, holdout=0)
    flat = N._start(s, 3)
    loss, gradient, seen = N.gradient_of(rows, [s], [flat], 3, step=1)
    used = fold != 0
    assert loss[0] == pytest.approx(_network_loss(flat, s, x[used], y[used])) and seen[0] == used.sum()
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (_network_loss(up, s, x[used], y[used]) - _network_loss(down, s, x[used], y[used])) / 2e-5
        assert gradient[0][i] == pytest.approx(slope, abs=1e-4)


def test_dropout_masks_are_drawn_again_alike(spark):
    x, y, fold = _data(40, 3)
    rows = D.training_rows(_frame(spark, x, y, fold), key="key").cache()
    s = N.MlpSetting(units=4, dropout=0.2)
    task, width = N._network_task([(0, s)], [D.View()], [N._start(s, 3)], 3, 5)
    assert np.allclose(D.summed_gradients(rows, task, width, 1)[1], D.summed_gradients(rows, task, width, 1)[1])
    other, _ = N._network_task([(0, s)], [D.View()], [N._start(s, 3)], 3, 6)
    assert not np.allclose(D.summed_gradients(rows, task, width, 1)[1], D.summed_gradients(rows, other, width, 1)[1])


def test_dropout_does_not_depend_on_partitions(spark):
    x, y, fold = _data(60, 3)
    df = _frame(spark, x, y, fold)
    setting = N.MlpSetting(units=4, dropout=0.3)
    flat = [N._start(setting, 3)]
    sums = [N.gradient_of(D.training_rows(df.repartition(n), key="key"), [setting], flat, 3, step=4) for n in (1, 7)]
    assert np.allclose(sums[0][0], sums[1][0]) and np.allclose(sums[0][1][0], sums[1][1][0])
    kept = N.kept_inputs(np.arange(4000, dtype=np.uint64), 50, 1, 2, 0, 0.8)
    assert abs(kept.mean() - 0.8) < 0.01 and kept.mean(axis=0).min() > 0.75 and kept.mean(axis=1).std() < 0.1
    assert (kept != N.kept_inputs(np.arange(4000, dtype=np.uint64), 50, 1, 3, 0, 0.8)).mean() > 0.2


def test_batches_are_parts_of_the_rows(spark):
    x, y, fold = _data(90, 3)
    rows = D.training_rows(_frame(spark, x, y, fold), key="key")
    parts = [[r["row"] for r in part.collect()] for part in N.batch_parts(rows, 4)]
    assert sorted(sum(parts, [])) == sorted(r["row"] for r in rows.collect()) and all(10 < len(p) < 40 for p in parts)
    plan = N.batch_parts(rows, 4)[1]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_norm_limit_follows_dropout():
    s = N.MlpSetting(units=2, dropout=0.1)
    flat = np.full(s.size(4), 10.0)
    N._limit_norm(flat, s, 4)
    w1, b1, _, _ = N._parts(flat, 4, 2)
    assert np.allclose(np.sqrt((w1 * w1).sum(0)), 1.5) and (b1 == 10).all()
    free = np.full(8 + 5, 10.0)
    N._limit_norm(free, N.MlpSetting(units=2), 4)
    assert (free == 10).all()


@pytest.mark.parametrize("steps", [1, 3])
def test_network_learns_and_survives_saving(spark, steps):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, size=(200, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)     # no straight line separates these
    df = _frame(spark, x, y, np.zeros(200, int)).cache()
    rows = D.training_rows(df, key="key").cache()
    model = N.fit_networks(rows, [N.MlpSetting(units=16, learning_rate=0.1, epochs=60 // steps)], 2, steps_per_epoch=steps)[0]
    path = scratch_path(spark, "t-mlp")
    model.save(spark, path)
    for m in (model, N.MlpModel.load(spark, path)):
        got = m.predict(df).collect()
        assert len(got) == 200 and set(got[0].asDict()) == {"key", "label", "fold", "probability", "prediction"}
        assert np.mean([r["prediction"] == r["label"] for r in got]) > 0.9
        assert all((r["probability"] > 0.5) == r["prediction"] for r in got)


# --- searches ---------------------------------------------------------------------------------

def test_macro_f1_of_counts():
    assert R.macro_f1(np.array([[12.0, 2, 5, 81], [0, 0, 0, 0]])).round(4).tolist() == [0.8664, 0.0]


def _corpus(spark, n=200):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        words = [f"w{int(k)}" for k in rng.zipf(1.6, 30) if k < 500] + (["welfare"] if y and rng.random() < 0.9 else [])
        rows.append((i, y, i % 5, " ".join(words)))
    return spark.createDataFrame(rows, "link int, label int, fold int, text string").repartition(4, "link").cache()


@pytest.mark.parametrize("first_look", [4, 0.01])
def test_vocabularies_are_fitted_inside_the_fold(spark, first_look, monkeypatch):
    monkeypatch.setattr(R, "FIRST_LOOK", first_look)
    df = _corpus(spark).withColumn("terms", feature_words(F.col("text"))).drop("text")
    limits = list(product((0.3, 1.0), (1, 3), (20, 60)))
    ready = R.fold_vocabularies(df, "link", "terms", limits, 5)
    for max_df, min_df, size in limits:
        for f in (None, 0, 3):
            side = df if f is None else df.filter(F.col("fold") != f)
            want = T.fit_tfidf(side, "terms", size, min_df, max_df)
            scale = ready.views[ready.view_of[max_df, min_df, size, f]].scale
            got = {t: v for t, v in zip(ready.terms, scale) if v}
            assert got == pytest.approx(dict(zip(want.terms, want.idf)))
        assert ready.tfidfs[max_df, min_df, size].terms == T.fit_tfidf(df, "terms", size, min_df, max_df).terms


def test_tfidf_svm_search(spark):
    df = _corpus(spark)
    analysers = {(False, 1): T.analyse(F.col("text")), (False, 2): T.analyse(F.col("text"), 2)}
    grid = {"max_df": (0.8,), "min_df": (1, 2), "max_features": (100,)}
    out = R.search_tfidf_svm(df, "link", analysers, grid, cs=(0.1, 1), max_passes=25)
    assert len(out.results) == 2 * 2 * 2 * 2 and all(len(r.fold_scores) == 5 for r in out.results)
    assert out.best.mean == max(r.mean for r in out.results) > 0.7
    assert out.table(spark).count() == 16
    # the refitted model equals one fitted directly with the chosen setting
    terms = df.withColumn("terms", analysers[out.analyser])
    direct = T.fit_tfidf(terms, "terms", 100, out.best.setting["limits"][1], 0.8)
    assert direct.terms == out.tfidf.terms and direct.idf == pytest.approx(out.tfidf.idf)
    ready = direct.transform(terms)
    one = L.fit_svms(D.training_rows(ready).cache(), [L.SvmSetting(out.best.setting["C"], out.best.setting["loss"])],
                     len(direct.terms), max_passes=25)[0]
    assert np.allclose(one.weights, out.model.weights, atol=0.05)
    report = R.top_features(spark, out.tfidf, out.model, 5).collect()
    assert len(report) == 10 and report[0]["end"] == "low"
    assert max(report, key=lambda r: r["value"])["feature"] == "welfare"


def test_tfidf_network_search(spark):
    df = _corpus(spark)
    grid = {"max_df": (0.8,), "min_df": (1,), "max_features": (50,)}
    nets = {"epochs": (5, 15), "learning_rate": (0.1,), "dropout": (0.2, 0)}
    out = R.search_tfidf_mlp(df, "link", {(False, 1): T.analyse(F.col("text"))}, grid, nets, unit_shares=(10,))
    assert len(out.results) == 4 and out.model.width == len(out.tfidf.terms) == 50
    ready = out.tfidf.transform(df.withColumn("terms", T.analyse(F.col("text")))).select("link", "label", "features")
    assert out.model.predict(ready).count() == 200


def test_embedding_searches(spark):
    x, y, fold = _data(100, 4)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(100)],
                               "key int, embedding array<double>, label int, fold int")
    svm = R.search_svm(df, 4, "key", "embedding", cs=(0.1, 1), max_passes=20)
    assert len(svm.results) == 4 and svm.best.mean > 0.75
    net = R.search_mlp(df, 4, "key", "embedding", {"epochs": (30,), "learning_rate": (0.1,), "dropout": (0, 0.2)}, unit_shares=(1, 2))
    assert len(net.results) == 4 and net.best.mean > 0.7


def test_first_best_wins_ties():
    a, b = R.Result({"i": 0}, [0.5]), R.Result({"i": 1}, [0.5])
    assert R.first_best([a, b]) is a


def test_views_are_seen_without_making_them():
    rng = np.random.default_rng(3)
    block = rng.poisson(0.6, (40, 7)).astype(float)
    block[5] = 0
    views = [D.View(), D.View(rng.uniform(0, 2, 7), True), D.View(np.r_[np.zeros(4), 1, 1, 2], True), D.View(rng.uniform(0, 2, 7))]
    of, weights = [1, 0, 2, 1, 3], rng.normal(size=(5, 7))
    seeing = D.Views(views, of, 7)
    expected = np.array([views[v](block) @ w for v, w in zip(of, weights)]).T
    assert np.allclose(block @ (weights * seeing.scales()).T / seeing.lengths(block), expected)


def test_a_task_holds_few_numbers_of_a_block(spark, monkeypatch):
    """Blocks get shorter with more models too, and are small beside an Arrow batch of 10,000 rows."""
    x, y, fold = _data(60)
    rows = D.training_rows(_frame(spark, x, y, fold)).coalesce(1)
    batch = rows.toArrow().to_batches()[0]
    monkeypatch.setattr(D, "BLOCK_NUMBERS", 100)
    assert max(len(b) for b, _ in D.dense_blocks(batch, 5, 50)) == 2
    monkeypatch.undo()
    assert 10_000 * 600 > 10 * D.BLOCK_NUMBERS


def test_networks_with_one_draw_share_it_and_train_as_alone(spark):
    x, y, fold = _data(80)
    rows = D.training_rows(_frame(spark, x, y, fold), key="key")
    settings = [N.MlpSetting(units=u, dropout=d, holdout=f, epochs=3, learning_rate=0.1) for u, d, f in ((3, 0.2, 0), (5, 0.2, None), (4, 0, 1))]
    together = N.fit_networks(rows, settings, 5)
    for one, s in zip(together, settings):
        assert np.allclose(one.flat, N.fit_networks(rows, [s], 5)[0].flat, atol=1e-9)
    assert (N.network_counts(rows, together, settings).sum(axis=1) == [16, 80, 16]).all()


# --- whole grids ------------------------------------------------------------------------------

def _searched(monkeypatch, spark, name, query):
    """What a query hands to a search, defaults filled in, without the search."""
    search, found = getattr(R, name), {}

    def stand_in(*args, **kwargs):
        bound = inspect.signature(search).bind(*args, **kwargs)
        bound.apply_defaults()
        found.update(bound.arguments)
        raise LookupError

    monkeypatch.setattr(R, name, stand_in)
    with pytest.raises(LookupError):
        all_queries()[query](spark, SMALL)
    assert list(found["analysers"]) == list(product((True, False), (1, 2)))
    assert (found["grid"] or V.TFIDF_GRID) == V.TFIDF_GRID and found["folds"] == 5
    return found


def test_network_search_query_has_both_whole_grids(spark, monkeypatch):
    found = _searched(monkeypatch, spark, "search_tfidf_mlp", "mlp_search_tfidf")
    grid = found["mlp_grid"] or V.MLP_GRID
    assert grid == {"epochs": (10, 20, 50, 100), "learning_rate": (0.1, 0.01, 0.001), "dropout": (0.2, 0)}
    assert found["unit_shares"] == (20, 10, 4, 2)


def _viewed(spark, n=120, width=9):
    """Rows of counts, and three views of them: all columns as they are, and two with some columns weighted."""
    rng = np.random.default_rng(8)
    x, y, fold = rng.poisson(0.7, (n, width)).astype(float), (rng.random(n) < 0.4).astype(int), np.arange(n) % 5
    x[3] = 0
    scale = rng.uniform(1, 2, width)
    views = [D.View(), D.View(scale, True), D.View(np.where(np.arange(width) % 3 > 0, scale, 0), True)]
    return D.training_rows(_frame(spark, x, y, fold).repartition(3), key="key").cache(), views


@pytest.mark.parametrize("block_numbers, cached, kept", [(500_000, 1 << 16, 8_000_000), (60, 30, 10)])
def test_networks_with_all_rows_in_a_task_train_as_over_parts(spark, monkeypatch, block_numbers, cached, kept):
    rows, views = _viewed(spark)
    monkeypatch.setattr(D, "BLOCK_NUMBERS", block_numbers)
    monkeypatch.setattr(N, "CACHED_WEIGHTS", cached)
    monkeypatch.setattr(N, "KEPT_NUMBERS", kept)
    table = D.held(rows.withColumn("part", N._part(3)))
    for view, fold, dropout in ((2, 4, 0.2), (1, None, 0), (0, 1, 0.05)):
        networks = [N.MlpSetting(u, r, dropout, 5, view, fold) for u, r in product((3, 7), (0.1, 0.01))]
        together, taken = N._Together(table, networks, views[view], 9), 0
        for epoch in range(5):
            for part in np.random.default_rng(epoch).permutation(3):
                together.step(taken := taken + 1, part)
        over_parts = N.fit_networks(rows, networks, 9, views, 3)
        for i, m in enumerate(over_parts):
            assert np.allclose(together.flat(i), m.flat, atol=1e-9)
        assert np.array_equal(together.counts(), N.network_counts(rows, over_parts, networks))


def test_networks_dealt_over_tasks_are_the_same(spark, monkeypatch):
    rows, views = _viewed(spark)
    settings = [N.MlpSetting(u, 0.1, d, e, v, f) for u, d, e, (v, f) in product((7, 3), (0.2, 0), (2, 4), ((2, None), (1, 0)))]
    monkeypatch.setattr(N, "DEALT_WEIGHTS", 80)
    found = []
    for held_bytes in (D.HELD_BYTES, -1):
        monkeypatch.setattr(D, "HELD_BYTES", held_bytes)
        found.append(([m.flat for m in N.fit_networks_apart(rows, settings, 9, views, 3)], N.searched_counts(rows, settings, 9, views, 3)))
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(found[0][0], found[1][0], strict=True))
    assert np.array_equal(found[0][1], found[1][1]) and (found[0][1].sum(axis=1) == [120, 24] * 8).all()


def test_epochs_of_one_network_are_looked_at_on_the_way(spark, monkeypatch):
    rows, views = _viewed(spark)
    settings = [N.MlpSetting(4, 0.1, 0.2, e, 1, 2) for e in (6, 1, 3)]
    alone = [N.fit_networks(rows, [s], 9, views, 2)[0].flat for s in settings]
    steps = []
    count = N.gradient_of
    monkeypatch.setattr(N, "gradient_of", lambda r, s, *rest: steps.append(len(s)) or count(r, s, *rest))
    together = N.fit_networks(rows, settings, 9, views, 2)
    assert [m.setting["epochs"] for m in together] == [6, 1, 3] and steps == [1] * 12
    assert all(np.allclose(m.flat, one, atol=1e-12) for m, one in zip(together, alone))


def test_limits_with_one_vocabulary_are_fitted_once(spark, monkeypatch):
    df = _corpus(spark)
    analysers = {(False, 1): T.analyse(F.col("text"))}
    grid = {"max_df": (0.9, 1.0), "min_df": (1, 2), "max_features": (10, 30)}
    nets = {"epochs": (3, 6), "learning_rate": (0.1,), "dropout": (0,)}
    asked, count = [], R.searched_counts
    monkeypatch.setattr(R, "searched_counts", lambda rows, s, *rest: asked.append(s) or count(rows, s, *rest))
    out = R.search_tfidf_mlp(df, "link", analysers, grid, nets, unit_shares=(5,))
    assert len(out.results) == 16 and len(asked[0]) == len(set(asked[0])) < 16 * 5
    # the ten most frequent words are the same whether or not words of a single document may be chosen
    scores = {(r.setting["limits"], r.setting["epochs"]): r.fold_scores for r in out.results}
    assert all(scores[(d, 1, 10), e] == scores[(d, 2, 10), e] for d in (0.9, 1.0) for e in (3, 6))
    assert len({tuple(s) for s in scores.values()}) > 2


def test_svm_search_query_has_the_whole_grid(spark, monkeypatch):
    found = _searched(monkeypatch, spark, "search_tfidf_svm", "search_results")
    assert tuple(found["cs"]) == (0.1, 1, 2, 5) and set(found["losses"]) == {"hinge", "squared_hinge"}
    assert found["max_passes"] >= L.MAX_PASSES and max(found["gap"], found["tolerance"]) <= L.GAP


def test_svms_dealt_over_tasks_are_the_same(spark, monkeypatch):
    rows, views = _viewed(spark)
    settings = [L.SvmSetting(c, loss, v, f) for c, loss, (v, f) in product((0.1, 1, 5), V.SVM_LOSSES, ((1, 0), (2, 4), (2, None), (0, 1)))]
    monkeypatch.setattr(L, "DEALT_MODELS", 5)
    here = L.fit_svms(rows, settings, 9, views)
    for held_bytes in (D.HELD_BYTES, -1):
        monkeypatch.setattr(D, "HELD_BYTES", held_bytes)
        for a, b, s in zip(L.fit_svms_apart(rows, settings, 9, views), here, settings, strict=True):
            assert a.setting == vars(s) and a.report["gap"] <= L.GAP and not a.report["stopped"]
            assert a.report["primal"] == pytest.approx(b.report["primal"], rel=1e-3) and np.allclose(a.weights, b.weights, atol=0.05)
    with pytest.warns(UserWarning, match="of 24 models were stopped after 2 passes"):
        L.fit_svms_apart(rows, settings, 9, views, max_passes=2)
