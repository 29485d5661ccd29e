"""Linear SVMs with hinge or squared hinge loss, many at once."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docketflow.operators.features import cells, constant_array
from docketflow.operators.training import (
    View, Views, column, dealt, dense_blocks, gradient_batch, held, holdouts, passes_for, summed_gradients)

# The hinge's corner is rounded over this margin at first, which changes the objective by at most C * n * width / 2.
HINGE_CORNER = 0.5
# It shrinks by this factor when the rounded problem is solved up to this share of what the bound still lacks.
SHRINK, SOLVED = 0.5, 0.5
MEMORY = 20
# A model is done when its objective is known to be this close to the best one, as a share of it.
GAP = 1e-3
MAX_PASSES = 500
# Models that a task trains together when they are dealt over the tasks.
DEALT_MODELS = 32


@dataclass(frozen=True)
class SvmSetting:
    C: float = 1.0
    loss: str = "squared_hinge"
    view: int = 0
    holdout: int | None = None      # the fold left out of training


@dataclass
class LinearModel:
    weights: list[float]
    intercept: float
    setting: dict = field(default_factory=dict)
    report: dict = field(default_factory=dict)      # primal, dual, gap, passes, stopped

    def decision(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """Weighted sum inside the JVM, over a row's stored values only."""
        weights = constant_array(list(map(float, self.weights)), "double")
        return df.withColumn(out, F.aggregate(
            cells(F.col(features)), F.lit(float(self.intercept)), lambda a, c: a + c["value"] * F.get(weights, c["at"])))

    def predict(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        return self.decision(df, features, "_score").withColumn(out, (F.col("_score") > 0).cast("int")).drop("_score")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.weights, self.intercept, {k: str(v) for k, v in self.setting.items()}, self.report)]
        spark.createDataFrame(rows, "weights array<double>, intercept double, setting map<string,string>, report map<string,double>") \
            .write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        r = spark.read.parquet(path).first()
        return LinearModel(list(r["weights"]), r["intercept"], dict(r["setting"]), dict(r["report"]))


def _loss(kind: str, gap: np.ndarray, corner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss with its corner rounded, its slope, and the loss itself, at ``gap = 1 - y * score``."""
    over = np.maximum(gap, 0)
    if kind == "squared_hinge":
        return over * over, 2 * over, over * over
    inside = over < corner
    return (np.where(inside, over * over / (2 * corner), over - corner / 2), np.where(inside, over / corner, 1.0), over)


# What a pass adds up beside the gradient: the loss itself, the dual variables and their squares.
_SUMS = 3


def _svm_task(settings: list[tuple[int, SvmSetting]], views: list[View], weights: np.ndarray, corners: np.ndarray):
    """Gradient sums over one task's rows. Weight rows follow ``settings``; the last column is the intercept."""
    width = weights.shape[1]

    def run(batches):
        loss, gradient, seen = np.zeros(len(settings)), np.zeros((len(settings), width + _SUMS)), False
        chosen = [s for _, s in settings]
        seeing = Views(views, [s.view for s in chosen], width - 1)
        inner, left_out, c = weights[:, :-1] * seeing.scales(), holdouts(chosen), np.array([s.C for s in chosen])
        kinds = [(k, at) for k in sorted({s.loss for s in chosen}) for at in [np.flatnonzero([s.loss == k for s in chosen])]]
        for batch in batches:
            for block, rows in dense_blocks(batch, width - 1, len(settings)):
                seen = True
                sign = (2.0 * column(batch, "label", rows) - 1)[:, None]
                used = column(batch, "fold", rows)[:, None] != left_out
                length = seeing.lengths(block)
                short = 1 - sign * (block @ inner.T / length + weights[:, -1])
                dual = np.zeros_like(short)
                for kind, at in kinds:
                    value, step, own = _loss(kind, short[:, at], corners[at])
                    loss[at] += c[at] * np.where(used[:, at], value, 0).sum(axis=0)
                    gradient[at, width] += c[at] * np.where(used[:, at], own, 0).sum(axis=0)
                    dual[:, at] = np.where(used[:, at], c[at] * step, 0)
                gradient[:, width + 1] += dual.sum(axis=0)
                gradient[:, width + 2] += (dual * dual).sum(axis=0)
                slope = -sign * dual
                gradient[:, width - 1] += slope.sum(axis=0)
                gradient[:, :width - 1] += (slope / length).T @ block
        if seen:
            gradient[:, :width - 1] *= seeing.scales()
            yield gradient_batch([m for m, _ in settings], loss, gradient)

    return run


@dataclass
class Objective:
    """A pass's sums at some weights, one entry per model.

    A row's dual variable is ``C`` times the slope of its loss, which always lies within the dual's limits. So every pass gives a lower bound
    of the best objective, whatever the weights: ``sum(a) - |sum(a y x)|^2 / 2``, less ``sum(a^2) / 4C`` for squared hinge.
    """

    value: np.ndarray       # with the corner rounded
    slope: np.ndarray
    primal: np.ndarray      # the objective itself
    dual: np.ndarray
    rounded_dual: np.ndarray


def objective(rows: DataFrame | pa.Table, settings: list[SvmSetting], weights: np.ndarray, views: list[View] | None = None,
              corners: np.ndarray | None = None, models: np.ndarray | None = None) -> Objective:
    """One pass over ``rows`` for the models at ``weights``, whose last column is the intercept."""
    chosen = np.arange(len(settings)) if models is None else models
    corners = np.full(len(settings), HINGE_CORNER) if corners is None else corners
    width = weights.shape[1]
    loss, sums = np.zeros(len(chosen)), np.zeros((len(chosen), width + _SUMS))
    # as many models in one pass as their gradients may take room
    for some in np.array_split(np.arange(len(chosen)), passes_for(len(chosen), width)):
        task = _svm_task([(int(k), settings[chosen[k]]) for k in some], views or [View()], weights[some], corners[chosen[some]])
        part = summed_gradients(rows, task, width + _SUMS, len(chosen))
        loss, sums = loss + part[0], sums + part[1]
    gradient, own, total, squares = sums[:, :width], *sums[:, width:].T
    size = 0.5 * (weights * weights).sum(axis=1)
    linear = total - 0.5 * (gradient * gradient).sum(axis=1)
    squared = np.array([settings[i].loss == "squared_hinge" for i in chosen], bool)
    c = np.array([settings[i].C for i in chosen])
    rounded = linear - np.where(squared, 1 / (4 * c), corners[chosen] / (2 * c)) * squares
    return Objective(loss + size, gradient + weights, own + size, np.where(squared, rounded, linear), rounded)


def fit_svms(rows: DataFrame | pa.Table, settings: list[SvmSetting], width: int, views: list[View] | None = None,
             max_passes: int = MAX_PASSES, tolerance: float = 1e-3, gap: float = GAP) -> list[LinearModel]:
    """Fit all settings together by limited-memory BFGS; one pass over ``rows`` serves all of them.

    The objective is ``|w|^2 / 2 + C * sum(loss)`` with the intercept as one more (penalised) weight.
    Each model has its own line search, so in one pass some take a new step while others shorten theirs. A model is done when the best objective found is within ``gap``, relatively, of the best lower
    bound found, with squared hinge also when its gradient has fallen to ``tolerance`` of the first one. For hinge loss that needs the rounded corner to be small: it shrinks, model by model, until the bound holds. What was
    reached is in ``LinearModel.report``; a warning tells of models that ``max_passes`` has stopped.
    """
    total, every = len(settings), np.arange(len(settings))
    w, corners = np.zeros((total, width + 1)), np.full(total, HINGE_CORNER)
    best, primal, dual, passes = w.copy(), np.full(total, np.inf), np.full(total, -np.inf), np.zeros(total, int)
    value, slope = np.full(total, np.inf), np.zeros_like(w)
    goal = np.full(total, np.inf)
    moves, changes, inverse = np.zeros((total, MEMORY, width + 1)), np.zeros((total, MEMORY, width + 1)), np.zeros((total, MEMORY))
    direction, step = np.zeros_like(w), np.zeros(total)
    running, first = np.ones(total, bool), True
    for _ in range(max_passes):
        active = every[running]
        if not len(active):
            break
        trial = w[active] + step[active, None] * direction[active]
        found = objective(rows, settings, trial, views, corners, active)
        expected = (slope[active] * direction[active]).sum(axis=1)
        passes[active] += 1
        for k, i in enumerate(active):
            dual[i] = max(dual[i], found.dual[k])
            if found.primal[k] < primal[i]:
                primal[i], best[i] = found.primal[k], trial[k]
            if not found.value[k] <= value[i] + 1e-4 * step[i] * expected[k]:
                step[i] *= 0.4
                if step[i] < 1e-10:  # no way down from here: rounding errors, or a worn-out estimate of the curve
                    running[i] = inverse[i, -1] > 0
                    inverse[i], direction[i], step[i] = 0, -slope[i], 1 / max(np.linalg.norm(slope[i]), 1.0)
                continue
            moved, changed = trial[k] - w[i], found.slope[k] - slope[i]
            curve = moved @ changed
            if curve > 1e-12 and np.isfinite(value[i]):
                moves[i], changes[i] = np.roll(moves[i], -1, 0), np.roll(changes[i], -1, 0)
                inverse[i] = np.roll(inverse[i], -1)
                moves[i, -1], changes[i, -1], inverse[i, -1] = moved, changed, 1 / curve
            w[i], value[i], slope[i] = trial[k], found.value[k], found.slope[k]
            size = np.linalg.norm(slope[i])
            if first:
                goal[i] = tolerance * size
            direction[i] = -_inverse_times(slope[i], moves[i], changes[i], inverse[i])
            step[i] = 1.0 if inverse[i, -1] else 1 / max(size, 1.0)
            wide = primal[i] - dual[i] > gap * primal[i]
            if not wide and (size <= goal[i] or settings[i].loss == "hinge"):
                running[i] = False
            elif settings[i].loss == "hinge" and wide and value[i] - found.rounded_dual[k] < SOLVED * (primal[i] - dual[i]):
                # the rounded problem is nearly solved, so its corner is what keeps the bound away
                corners[i] *= SHRINK
                value[i], direction[i], step[i] = np.inf, 0, 0
            elif wide and size <= goal[i]:
                goal[i] *= 0.1
        first = False
    left = (primal - dual) / np.where(primal > 0, primal, 1)
    models = [LinearModel(list(map(float, best[i, :-1])), float(best[i, -1]), vars(settings[i]).copy(),
                          {"primal": float(primal[i]), "dual": float(dual[i]), "gap": float(left[i]), "passes": float(passes[i]), "stopped": float(running[i])})
              for i in range(total)]
    _tell_of_stopped(models, max_passes)
    return models


def _tell_of_stopped(models: list[LinearModel], max_passes: int) -> None:
    stopped = [m.report["gap"] for m in models if m.report["stopped"]]
    if stopped:
        warnings.warn(f"{len(stopped)} of {len(models)} models were stopped after {max_passes} passes; the widest gap is {max(stopped):.2g}", stacklevel=3)


_REPORT = ("primal", "dual", "gap", "passes", "stopped")


def fit_svms_apart(rows: DataFrame, settings: list[SvmSetting], width: int, views: list[View] | None = None,
                   max_passes: int = MAX_PASSES, tolerance: float = 1e-3, gap: float = GAP) -> list[LinearModel]:
    """What ``fit_svms`` gives, up to rounding; when the rows are few, every task has all of them and trains some of the models to their end."""
    table = held(rows)
    if table is None:
        return fit_svms(rows, settings, width, views, max_passes, tolerance, gap)
    # neighbours share their view, so a task works few views' lengths out
    order = sorted(range(len(settings)), key=lambda i: settings[i].view)
    groups = [order[k:k + DEALT_MODELS] for k in range(0, len(order), DEALT_MODELS)]

    def work(group):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            models = fit_svms(table, [settings[i] for i in group], width, views, max_passes, tolerance, gap)
        yield gradient_batch(group, np.zeros(len(group)), np.array([[*m.weights, m.intercept, *(m.report[n] for n in _REPORT)] for m in models]))

    models: list = [None] * len(settings)
    for i, _, found in dealt(rows.sparkSession, groups, work):
        models[i] = LinearModel(found[:width].tolist(), float(found[width]), vars(settings[i]).copy(), dict(zip(_REPORT, found[width + 1:].tolist())))
    _tell_of_stopped(models, max_passes)
    return models


def _inverse_times(g: np.ndarray, moves: np.ndarray, changes: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The inverse Hessian estimate times ``g`` (two-loop recursion; unused slots have weight 0)."""
    q, shares = g.copy(), np.zeros(MEMORY)
    for j in reversed(range(MEMORY)):
        shares[j] = inverse[j] * (moves[j] @ q)
        q -= shares[j] * changes[j]
    if inverse[-1]:
        q *= 1 / (inverse[-1] * (changes[-1] @ changes[-1]))
    for j in range(MEMORY):
        q += moves[j] * (shares[j] - inverse[j] * (changes[j] @ q))
    return q


def holdout_counts(rows: DataFrame, models: list[LinearModel], settings: list[SvmSetting], width: int,
                   views: list[View] | None = None) -> np.ndarray:
    """``tp, fp, fn, tn`` of every model on the fold it did not see (all rows without one), in one pass."""
    views = views or [View()]
    weights = np.array([[*m.weights, m.intercept] for m in models])

    def run(batches):
        counts, seen = np.zeros((len(models), 4)), False
        seeing = Views(views, [s.view for s in settings], width)
        inner, left_out, on_all = weights[:, :-1] * seeing.scales(), holdouts(settings), np.array([s.holdout is None for s in settings], bool)
        for batch in batches:
            for block, part in dense_blocks(batch, width, len(models)):
                seen = True
                label = (column(batch, "label", part) == 1)[:, None]
                used = on_all | (column(batch, "fold", part)[:, None] == left_out)
                hit = block @ inner.T / seeing.lengths(block) + weights[:, -1] > 0
                counts += np.array([(used & hit & label).sum(axis=0), (used & hit & ~label).sum(axis=0),
                                    (used & ~hit & label).sum(axis=0), (used & ~hit & ~label).sum(axis=0)]).T
        if seen:
            yield gradient_batch(range(len(models)), np.zeros(len(models)), counts)

    return summed_gradients(rows, run, 4, len(models))[1]
