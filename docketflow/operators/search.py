"""Cross-validated searches scored by macro-F1; the vectoriser is always fitted inside the fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketflow import fixed_values as V
from docketflow.operators.features import Tfidf, counted_terms, smooth_idf
from docketflow.operators.linear import MAX_PASSES, LinearModel, SvmSetting, fit_svms, fit_svms_apart, holdout_counts
from docketflow.operators.network import MlpModel, MlpSetting, fit_networks, fit_networks_apart, network_counts, searched_counts
from docketflow.operators.training import View, training_rows
from docketflow.session import materialise


# Models that are only compared are trained until they are this close to their best objective; the chosen one is fitted closer.
SEARCH_TOLERANCE, SEARCH_GAP = 0.05, 0.03


@dataclass
class Result:
    """One row of a search: the setting and its macro-F1 in every fold."""

    setting: dict
    fold_scores: list[float]

    @property
    def mean(self) -> float:
        return float(np.mean(self.fold_scores))


@dataclass
class SearchOutcome:
    results: list[Result]
    best: Result
    model: object
    tfidf: Tfidf | None = None
    analyser: tuple | None = None

    def save(self, spark, path: str) -> None:
        """Scores and parameters of every setting, the best one marked, as JSON lines."""
        place = self.results.index(self.best)
        self.table(spark).withColumn("best", F.col("setting") == place).write.json(path)

    def table(self, spark) -> DataFrame:
        rows = [(i, {k: str(v) for k, v in r.setting.items()}, r.fold_scores, r.mean) for i, r in enumerate(self.results)]
        return spark.createDataFrame(
            rows, "setting int, params map<string,string>, fold_scores array<double>, mean_score double")


def read_results(spark, path: str) -> DataFrame:
    """What ``SearchOutcome.save`` wrote: ``setting, params, fold_scores, mean_score, best``."""
    return spark.read.schema("setting int, params map<string,string>, fold_scores array<double>, mean_score double, best boolean").json(path)


def macro_f1(counts: np.ndarray) -> np.ndarray:
    """Macro-F1 from rows of ``tp, fp, fn, tn``; an empty class scores 0."""
    tp, fp, fn, tn = counts.T
    one, zero = 2 * tp + fp + fn, 2 * tn + fp + fn
    return (2 * tp / np.where(one > 0, one, 1) + 2 * tn / np.where(zero > 0, zero, 1)) / 2


def first_best(results: list[Result]) -> Result:
    return max(enumerate(results), key=lambda r: (r[1].mean, -r[0]))[1]


def _cross_validate(params: list[dict], folds: int, make: Callable, count: Callable) -> list[Result]:
    """Fit every (setting, fold) pair in one batch and score each on its own fold.

    Pairs that come to the same model, such as those of limits that choose the same vocabulary, are fitted once.
    """
    settings = [make(p, f) for p in params for f in range(folds)]
    place = {s: i for i, s in enumerate(dict.fromkeys(settings))}
    scores = macro_f1(count(list(place)))[[place[s] for s in settings]].reshape(len(params), folds)
    return [Result(p, [float(x) for x in row]) for p, row in zip(params, scores)]


def search_svm(df: DataFrame, width: int, key: str, features: str = "features", cs=V.SVM_EMBEDDING_C, losses=V.SVM_LOSSES,
               folds: int = V.FOLDS, max_passes: int = MAX_PASSES) -> SearchOutcome:
    """Grid search on given vectors; ``df`` has the vectors, ``label`` and ``fold``."""
    rows = materialise(training_rows(df, features, key=key), "svm-rows", "row")
    params = [{"C": c, "loss": loss} for c, loss in product(cs, losses)]
    results = _cross_validate(
        params, folds, lambda p, f: SvmSetting(p["C"], p["loss"], 0, f),
        lambda s: holdout_counts(rows, fit_svms(rows, s, width, None, max_passes, SEARCH_TOLERANCE, SEARCH_GAP), s, width))
    best = first_best(results)
    model = fit_svms(rows, [SvmSetting(best.setting["C"], best.setting["loss"])], width, max_passes=max_passes)[0]
    return SearchOutcome(results, best, model)


def search_mlp(df: DataFrame, width: int, key: str, features: str = "features", grid: dict | None = None,
               unit_shares=V.MLP_EMBEDDING_UNITS, folds: int = V.FOLDS, steps_per_epoch: int = 1) -> SearchOutcome:
    """Grid search of networks on given vectors."""
    grid = grid or V.MLP_GRID
    rows = materialise(training_rows(df, features, key=key), "mlp-rows", "row")
    params = _mlp_params(grid, width, unit_shares)
    results = _cross_validate(
        params, folds, lambda p, f: MlpSetting(holdout=f, **p),
        lambda s: network_counts(rows, fit_networks(rows, s, width, steps_per_epoch=steps_per_epoch), s))
    best = first_best(results)
    model = fit_networks(rows, [MlpSetting(**best.setting)], width, steps_per_epoch=steps_per_epoch)[0]
    return SearchOutcome(results, best, model)


def _mlp_params(grid: dict, width: int, unit_shares) -> list[dict]:
    units = [max(1, int(width / share)) for share in unit_shares]
    return [{"epochs": e, "units": u, "learning_rate": r, "dropout": d} for e, u, r, d in
            product(grid["epochs"], units, grid["learning_rate"], grid["dropout"])]


# ---- searches that fit the vectoriser too ----------------------------------------------------

@dataclass
class _FoldVocabularies:
    """Counts over the union of all vocabularies, and a view for every (vectoriser setting, fold); equal ones share it."""

    rows: DataFrame
    terms: list[str]
    views: list[View]
    view_of: dict           # (max_df, min_df, max_features, fold or None) -> view number
    tfidfs: dict            # (max_df, min_df, max_features) -> Tfidf fitted on all rows


def fold_vocabularies(df: DataFrame, key: str, terms: str, limits: list[tuple], folds: int) -> _FoldVocabularies:
    """Every vocabulary of the search from one scan: term statistics are kept per fold, and a training
    side is the total less its fold. Counts are then stored once over all terms in use."""
    n_in_fold = {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total = sum(n_in_fold.values())
    # the last place stands for "no fold left out"
    per_fold = [F.array(*[F.sum(F.when(F.col("group") == f, F.col(n)).otherwise(0)) for f in range(folds)],
                        F.lit(0).cast("bigint")).alias(f"fold_{n}") for n in ("cf", "df")]
    stats = materialise(
        counted_terms(df, terms, "fold").groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), *per_fold), "term-stats", "term")
    wanted = []
    for max_df, min_df, max_features in limits:
        for f in [*range(folds), None]:
            n = total - (0 if f is None else n_in_fold.get(f, 0))
            wanted.append((max_df, min_df, max_features, f, n))
    chosen = _top_terms(stats, wanted, folds)
    names = sorted({t for rows in chosen.values() for t, _ in rows}) or [""]
    place = {t: i for i, t in enumerate(names)}
    views, view_of, tfidfs, known = [], {}, {}, {}
    for number, (max_df, min_df, max_features, f, n) in enumerate(wanted):
        scale = np.zeros(len(names))
        for t, freq in chosen.get(number, []):
            scale[place[t]] = smooth_idf(freq, n)
        # limits that choose the same terms of the same rows have one view
        at = view_of[max_df, min_df, max_features, f] = known.setdefault(scale.tobytes(), len(views))
        if at == len(views):
            views.append(View(scale, unit=True))
        if f is None:
            kept = sorted(chosen.get(number, []))
            tfidfs[max_df, min_df, max_features] = Tfidf([t for t, _ in kept], [smooth_idf(d, n) for _, d in kept])
    counted = CountVectorizerModel.from_vocabulary(names, inputCol=terms, outputCol="features").transform(df)
    return _FoldVocabularies(materialise(training_rows(counted, key=key), "term-counts", "row"), names, views, view_of, tfidfs)


# Terms looked at first, as a multiple of the vocabulary size; each further round takes eight times more.
FIRST_LOOK = 4


def _top_terms(stats: DataFrame, wanted: list[tuple], folds: int) -> dict[int, list]:
    """The most frequent terms of every view as ``(term, df)``; a view is ``(max_df, min_df, size, fold, n)``.

    A view's count of a term is at most its total. So once a view is filled with terms that occur at
    least ``floor`` times on its side, no term below ``floor`` in total can belong to it. Only terms
    above the floor are expanded over the views, and the floor falls until every view is filled or
    all terms have been looked at.
    """
    # constants only, so the plan holds one literal however many views there are
    views = F.array(*[F.struct(
        F.lit(i).alias("view"), F.lit(folds if f is None else f).alias("fold"), F.lit(max(1, min_df)).alias("low"),
        F.lit(float(max_df) * n).alias("high"), F.lit(k).alias("k")) for i, (max_df, min_df, k, f, n) in enumerate(wanted)])
    level = F.floor(F.log2(F.col("cf").cast("double")) * 8).cast("int")
    levels = [(r["level"], r["n"]) for r in stats.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()]
    look = FIRST_LOOK * max(w[2] for w in wanted)
    while levels:
        floor, taken = 1.0, 0
        for at, n in sorted(levels, reverse=True):
            taken += n
            if taken >= look:
                floor = 2 ** (at / 8)
                break
        ranked = stats.filter(F.col("cf") >= floor).withColumn("v", F.explode(views)).select(
            "term", "v.*", (F.col("cf") - F.get("fold_cf", F.col("v.fold"))).alias("cf"),
            (F.col("df") - F.get("fold_df", F.col("v.fold"))).alias("df")).filter("df >= low AND df <= high") \
            .withColumn("rank", F.row_number().over(W.partitionBy("view").orderBy(F.desc("cf"), "term"))).filter("rank <= k")
        chosen: dict[int, list] = {}
        sure = [0] * len(wanted)
        for r in ranked.select("view", "term", "df", "cf").collect():
            chosen.setdefault(r["view"], []).append((r["term"], r["df"]))
            sure[r["view"]] += r["cf"] >= floor
        if floor <= 1 or all(have >= w[2] for have, w in zip(sure, wanted)):
            return chosen
        look *= 8
    return {}


def _own_terms(model_weights: np.ndarray, names: list[str], tfidf: Tfidf) -> list[float]:
    place = {t: i for i, t in enumerate(names)}
    return [float(model_weights[place[t]]) for t in tfidf.terms] or [0.0]


def search_tfidf_svm(df: DataFrame, key: str, analysers: dict[tuple, Column], grid: dict | None = None,
                     cs=V.SVM_TFIDF_C, losses=V.SVM_LOSSES, folds: int = V.FOLDS,
                     max_passes: int = MAX_PASSES, tolerance: float = SEARCH_TOLERANCE, gap: float = SEARCH_GAP) -> SearchOutcome:
    """Vectoriser x SVM grid. ``analysers`` maps ``(lemmas, ngrams)`` to a column of terms; ``df`` has
    ``label`` and ``fold``. Each analyser is one batch: all its vocabularies, C values, losses and folds
    share the rows. ``tolerance`` and ``gap`` say how closely models that are compared are fitted."""
    grid = grid or V.TFIDF_GRID
    limits = list(product(grid["max_df"], grid["min_df"], grid["max_features"]))
    results, prepared = [], {}
    for name, terms in analysers.items():
        ready = fold_vocabularies(df.select(key, "label", "fold", terms.alias("terms")), key, "terms", limits, folds)
        prepared[name] = ready
        width = len(ready.terms)
        params = [{"analyser": name, "limits": m, "C": c, "loss": loss} for m, c, loss in product(limits, cs, losses)]
        results += _cross_validate(
            params, folds,
            lambda p, f: SvmSetting(p["C"], p["loss"], ready.view_of[(*p["limits"], f)], f),
            lambda s: holdout_counts(ready.rows, fit_svms_apart(ready.rows, s, width, ready.views, max_passes, tolerance, gap), s, width, ready.views))
    best = first_best(results)
    ready, limit = prepared[best.setting["analyser"]], best.setting["limits"]
    setting = SvmSetting(best.setting["C"], best.setting["loss"], ready.view_of[(*limit, None)])
    fitted = fit_svms_apart(ready.rows, [setting], len(ready.terms), ready.views, max_passes)[0]
    tfidf = ready.tfidfs[limit]
    model = LinearModel(_own_terms(np.array(fitted.weights), ready.terms, tfidf), fitted.intercept, fitted.setting)
    return SearchOutcome(results, best, model, tfidf, best.setting["analyser"])


def search_tfidf_mlp(df: DataFrame, key: str, analysers: dict[tuple, Column], grid: dict | None = None,
                     mlp_grid: dict | None = None, unit_shares=V.MLP_TFIDF_UNITS, folds: int = V.FOLDS,
                     steps_per_epoch: int = 1) -> SearchOutcome:
    """Vectoriser x network grid, batched the same way."""
    grid, mlp_grid = grid or V.TFIDF_GRID, mlp_grid or V.MLP_GRID
    limits = list(product(grid["max_df"], grid["min_df"], grid["max_features"]))
    results, prepared = [], {}
    for name, terms in analysers.items():
        ready = fold_vocabularies(df.select(key, "label", "fold", terms.alias("terms")), key, "terms", limits, folds)
        prepared[name] = ready
        width = len(ready.terms)
        params = [{"analyser": name, "limits": m, **p} for m in limits
                  for p in _mlp_params(mlp_grid, len(ready.tfidfs[m].terms), unit_shares)]
        results += _cross_validate(
            params, folds, lambda p, f: _network_setting(p, ready, f),
            lambda s: searched_counts(ready.rows, s, width, ready.views, steps_per_epoch))
    best = first_best(results)
    ready, limit = prepared[best.setting["analyser"]], best.setting["limits"]
    setting = _network_setting(best.setting, ready, None)
    fitted = fit_networks_apart(ready.rows, [setting], len(ready.terms), ready.views, steps_per_epoch)[0]
    # keep only the rows of the first layer that belong to the chosen vocabulary
    tfidf = ready.tfidfs[limit]
    place = {t: i for i, t in enumerate(ready.terms)}
    flat, cut = np.array(fitted.flat), len(ready.terms) * setting.units
    first = flat[:cut].reshape(len(ready.terms), setting.units)[[place[t] for t in tfidf.terms]]
    model = MlpModel([*first.ravel().tolist(), *flat[cut:].tolist()], len(tfidf.terms), setting.units, fitted.setting)
    return SearchOutcome(results, best, model, tfidf, best.setting["analyser"])


def _network_setting(p: dict, ready: _FoldVocabularies, fold: int | None) -> MlpSetting:
    own = {k: p[k] for k in ("epochs", "units", "learning_rate", "dropout")}
    return MlpSetting(view=ready.view_of[(*p["limits"], fold)], holdout=fold, **own)


def top_features(spark, tfidf: Tfidf, model: LinearModel, n: int = V.TOP_FEATURES,
                 positive_above: float = V.POSITIVE_ABOVE) -> DataFrame:
    """The ``n`` lowest and ``n`` highest coefficients, both ends rising, with their ``position`` in that order."""
    zipped = spark.createDataFrame([(tfidf.terms, list(model.weights))], "term array<string>, weight array<double>")
    all_terms = zipped.select(F.explode(F.arrays_zip("term", "weight")).alias("z")) \
        .select(F.col("z.term").alias("feature"), F.col("z.weight").alias("value"))
    low = all_terms.orderBy("value", F.desc("feature")).limit(n).withColumn("end", F.lit("low"))
    high = all_terms.orderBy(F.desc("value"), "feature").limit(n).withColumn("end", F.lit("high"))
    order = W.orderBy(F.desc("end"), "value", F.desc("feature"))
    return low.unionByName(high).withColumn("abs_value", F.abs("value")) \
        .withColumn("sign", F.when(F.col("value") > positive_above, "positive").otherwise("negative")) \
        .withColumn("position", F.row_number().over(order)).orderBy("position")
