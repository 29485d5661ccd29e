"""One-hidden-layer relu networks with dropout, trained data-parallel with Adam, many at once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docketflow.operators.training import (
    PASS_WEIGHTS, View, Views, column, dealt, dense_blocks, gradient_batch, held, passes_for, summed_gradients)
from docketflow.session import scratch_path

# Adam's two averages decay by these; this keeps its step finite.
DECAYS, TINY = (0.9, 0.999), 1e-7
# Weights of the networks that a task trains together when they are dealt over the tasks, unless one alone has more.
DEALT_WEIGHTS = 4_000_000
# Numbers of dense rows that a task keeps from step to step; more are made anew from the stored ones.
KEPT_NUMBERS = 8_000_000
# Weights that a step changes at a time, so that they and their averages stay in the processor's cache.
CACHED_WEIGHTS = 1 << 16


@dataclass(frozen=True)
class MlpSetting:
    units: int = 32
    learning_rate: float = 0.001
    dropout: float = 0.0
    epochs: int = 10
    view: int = 0
    holdout: int | None = None
    seed: int = 1

    def size(self, width: int) -> int:
        return width * self.units + 2 * self.units + 1


def _parts(flat: np.ndarray, width: int, units: int):
    a = width * units
    return (flat[:a].reshape(width, units), flat[a:a + units], flat[a + units:a + 2 * units], flat[-1:])


def _start(s: MlpSetting, width: int) -> np.ndarray:
    """Uniform start scaled by the layer sizes; zero biases."""
    rng = np.random.default_rng(s.seed)
    flat = np.zeros(s.size(width))
    w1, _, w2, _ = _parts(flat, width, s.units)
    w1[:] = rng.uniform(-1, 1, w1.shape) * np.sqrt(6 / (width + s.units))
    w2[:] = rng.uniform(-1, 1, w2.shape) * np.sqrt(6 / (s.units + 1))
    return flat


def _limit_norm(flat: np.ndarray, s: MlpSetting, width: int) -> None:
    """Clip each hidden unit's incoming weights to norm ``15 * dropout``; off without dropout."""
    if s.dropout > 0:
        w1 = _parts(flat, width, s.units)[0]
        norm = np.sqrt((w1 * w1).sum(axis=0))
        w1 *= np.minimum(norm, 15 * s.dropout) / np.maximum(norm, 1e-7)


def _probability(x: np.ndarray, flat: np.ndarray, units: int) -> np.ndarray:
    return _output(x @ _parts(flat, x.shape[1], units)[0], flat, x.shape[1], units)


def _output(inputs: np.ndarray, flat: np.ndarray, width: int, units: int) -> np.ndarray:
    """The probability from what reaches the hidden units."""
    _, b1, w2, b2 = _parts(flat, width, units)
    return 1 / (1 + np.exp(-np.clip(np.maximum(inputs + b1, 0) @ w2 + b2, -500, 500)))


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kept_inputs(rows: np.ndarray, count: int, seed: int, step: int, layer: int, keep: float) -> np.ndarray:
    """Which of ``count`` inputs each row keeps in a step: a hash of the row's number, the input, seed, step and layer.

    A row draws the same whatever block, task or attempt it is read in.
    """
    return _kept(rows, np.arange(count), seed, step, layer, keep)


def _kept(rows: np.ndarray, inputs: np.ndarray, seed: int, step: int, layer: int, keep: float) -> np.ndarray:
    """The same for some inputs only."""
    salt = np.uint64(((seed * 1_000_003 + step) * 2 + layer) & 0xFFFFFFFFFFFFFFFF)
    places = _hashed(_hashed(inputs.astype(np.uint64) + np.uint64(1)) + salt)
    return (_hashed(rows[:, None] ^ places[None, :]) >> np.uint64(11)) * 2.0**-53 < keep


def _network_task(settings, views, weights, width, step):
    """Gradient sums of one step."""
    longest = max(len(f) for f in weights)

    def run(batches):
        loss, count = np.zeros(len(settings)), np.zeros(len(settings))
        gradient, seen = np.zeros((len(settings), longest)), False
        seeing = Views(views, [s.view for _, s in settings], width)
        # networks with the same draw of inputs share one product with the block
        draws: dict[tuple, list[int]] = {}
        for i, (_, s) in enumerate(settings):
            draws.setdefault((s.seed, s.dropout), []).append(i)
        groups = []
        for (seed, dropout), members in draws.items():
            sizes = [settings[i][1].units for i in members]
            first = np.hstack([seeing.scale(i)[:, None] * _parts(weights[i], width, u)[0] for i, u in zip(members, sizes)])
            groups.append((seed, dropout, members, sizes, first, np.zeros_like(first)))
        beside = max(sum(sizes) for _, _, _, sizes, _, _ in groups)
        for batch in batches:
            for block, rows in dense_blocks(batch, width, beside):
                seen = True
                y, fold = column(batch, "label", rows).astype(float), column(batch, "fold", rows)
                numbers = column(batch, "row", rows).astype(np.int64).view(np.uint64)
                length = seeing.lengths(block)
                for seed, dropout, members, sizes, first, slopes in groups:
                    keep, x, drawn = 1 - dropout, block, None
                    if dropout:
                        x = block * kept_inputs(numbers, width, seed, step, 0, keep) / keep
                        # a unit's draw doesn't depend on how many there are
                        drawn = kept_inputs(numbers, max(sizes), seed, step, 1, keep) / keep
                    inputs, start = x @ first, 0
                    for i, units in zip(members, sizes):
                        s, cut = settings[i][1], slice(start, start + units)
                        start += units
                        _, b1, w2, b2 = _parts(weights[i], width, units)
                        used = np.ones(len(fold), bool) if s.holdout is None else fold != s.holdout
                        pre = inputs[:, cut] / length[:, [i]] + b1
                        mask = 1.0 if drawn is None else drawn[:, :units]
                        hidden = np.maximum(pre, 0) * mask
                        p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -500, 500)))
                        safe = np.clip(p, 1e-7, 1 - 1e-7)
                        loss[i] -= (y * np.log(safe) + (1 - y) * np.log(1 - safe))[used].sum()
                        error = np.where(used, p - y, 0)
                        back = np.outer(error, w2) * mask * (pre > 0)
                        gradient[i, width * units: s.size(width)] += np.concatenate([back.sum(0), hidden.T @ error, [error.sum()]])
                        count[i] += used.sum()
                        inputs[:, cut] = back / length[:, [i]]
                    slopes += x.T @ inputs
        for _, _, members, sizes, _, slopes in groups:
            for i, part in zip(members, np.split(slopes, np.cumsum(sizes)[:-1], axis=1)):
                gradient[i, :part.size] = (seeing.scale(i)[:, None] * part).ravel()
        if seen:
            yield gradient_batch([m for m, _ in settings], loss, np.hstack([gradient, count[:, None]]))

    return run, longest + 1


@dataclass
class MlpModel:
    flat: list[float]
    width: int
    units: int
    setting: dict = field(default_factory=dict)
    view: View = View()

    def predict(self, df: DataFrame, features: str = "features", at: float = 0.5) -> DataFrame:
        """Adds ``probability`` and ``prediction``; batches go through numpy, other columns are passed along."""
        flat, width, units, view = np.array(self.flat), self.width, self.units, self.view
        renamed = df.withColumnRenamed(features, "features") if features != "features" else df
        schema = T.StructType([*[f for f in renamed.schema.fields if f.name != "features"],
                               T.StructField("probability", T.DoubleType())])

        def run(batches):
            for batch in batches:
                found = [_probability(view(block), flat, units) for block, _ in dense_blocks(batch, width)]
                kept = [n for n in batch.schema.names if n != "features"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(n)) for n in kept]
                    + [pa.array(np.concatenate(found) if found else [], pa.float64())], names=[*kept, "probability"])

        return renamed.mapInArrow(run, schema).withColumn("prediction", (F.col("probability") > at).cast("int"))

    def save(self, spark: SparkSession, path: str) -> None:
        scale = None if self.view.scale is None else [float(x) for x in self.view.scale]
        rows = [(self.flat, self.width, self.units, {k: str(v) for k, v in self.setting.items()}, scale, self.view.unit)]
        spark.createDataFrame(rows, "flat array<double>, width int, units int, setting map<string,string>, "
                                    "scale array<double>, unit boolean").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> MlpModel:
        r = spark.read.parquet(path).first()
        scale = None if r["scale"] is None else np.array(r["scale"])
        return MlpModel(list(r["flat"]), r["width"], r["units"], dict(r["setting"]), View(scale, r["unit"]))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(3)), F.lit(parts)).cast("int")


def batch_parts(rows: DataFrame, parts: int) -> list[DataFrame]:
    """The rows dealt by their number into parts of about the same size, stored part by part.

    A step then reads its own part's files and nothing else, so an epoch reads the table once.
    """
    if parts == 1:
        return [rows]
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "batches")
    rows.withColumn("part", _part(parts)) \
        .repartitionByRange("part", "row").write.partitionBy("part").parquet(path)
    stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])).parquet(path)
    return [stored.filter(F.col("part") == p).drop("part") for p in range(parts)]


def gradient_of(rows: DataFrame, settings: list[MlpSetting], flats: list[np.ndarray], width: int, views: list[View] | None = None,
                step: int = 0) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sums over ``rows`` at the given weights: each network's loss, its gradient and its number of rows."""
    loss, gradients, counts = np.zeros(len(settings)), [], np.zeros(len(settings))
    longest = max(len(f) for f in flats)
    for some in np.array_split(np.arange(len(settings)), passes_for(len(settings), longest)):
        task, numbers = _network_task([(int(k), settings[k]) for k in some], views or [View()], [flats[k] for k in some], width, step)
        found, sums = summed_gradients(rows, task, numbers, len(settings))
        loss[some], counts[some] = found[some], sums[some, -1]
        gradients += [sums[k, : len(flats[k])] for k in some]
    return loss, gradients, counts


def fit_networks(rows: DataFrame, settings: list[MlpSetting], width: int, views: list[View] | None = None,
                 steps_per_epoch: int = 1) -> list[MlpModel]:
    """Fit all settings together. An epoch reads the rows once, in ``steps_per_epoch`` parts chosen by the rows' numbers,
    and every part is one Adam step for every model still training. The parts come in another order each epoch."""
    views = views or [View()]
    networks, epochs = _trajectories(settings)
    flats = [_start(s, width) for s in networks]
    first, second = [np.zeros_like(f) for f in flats], [np.zeros_like(f) for f in flats]
    parts, taken = batch_parts(rows, steps_per_epoch), 0
    found = {(i, 0): f.copy() for i, f in enumerate(flats) if 0 in epochs[i]}
    for epoch in range(max(s.epochs for s in settings)):
        active = [i for i in range(len(networks)) if max(epochs[i]) > epoch]
        for part in np.random.default_rng(epoch).permutation(steps_per_epoch):
            taken += 1
            _, gradients, counts = gradient_of(parts[part], [networks[i] for i in active], [flats[i] for i in active], width, views, taken)
            for i, gradient, seen in zip(active, gradients, counts):
                if not seen:
                    continue
                g, s = gradient / seen, networks[i]
                first[i] = DECAYS[0] * first[i] + (1 - DECAYS[0]) * g
                second[i] = DECAYS[1] * second[i] + (1 - DECAYS[1]) * g * g
                flats[i] -= _rate(taken) * s.learning_rate * first[i] / (np.sqrt(second[i]) + TINY)
                _limit_norm(flats[i], s, width)
        found |= {(i, epoch + 1): flats[i].copy() for i in active if epoch + 1 in epochs[i]}
    place = {n: i for i, n in enumerate(networks)}
    return [MlpModel(found[place[replace(s, epochs=0)], s.epochs].tolist(), width, s.units, vars(s).copy(), views[s.view]) for s in settings]


def _rate(step: int) -> float:
    """What a step's learning rate is multiplied by, since both averages began at 0."""
    return np.sqrt(1 - DECAYS[1] ** step) / (1 - DECAYS[0] ** step)


def _trajectories(settings: list[MlpSetting]) -> tuple[list[MlpSetting], list[set[int]]]:
    """Settings that differ in nothing but their epochs are one network looked at after each of them: the network and those epochs."""
    epochs: dict[MlpSetting, set[int]] = {}
    for s in settings:
        epochs.setdefault(replace(s, epochs=0), set()).add(s.epochs)
    return list(epochs), list(epochs.values())


def network_counts(rows: DataFrame, models: list[MlpModel], settings: list[MlpSetting]) -> np.ndarray:
    """``tp, fp, fn, tn`` of every model on the fold it did not see, in one pass."""
    width = models[0].width

    def run(batches):
        counts, seen = np.zeros((len(models), 4)), False
        views, flats = {s.view: m.view for m, s in zip(models, settings)}, [np.array(m.flat) for m in models]
        seeing = Views(views, [s.view for s in settings], width)
        sizes = [m.units for m in models]
        first = np.hstack([seeing.scale(i)[:, None] * _parts(f, width, u)[0] for i, (f, u) in enumerate(zip(flats, sizes))])
        for batch in batches:
            for block, part in dense_blocks(batch, width, sum(sizes)):
                seen = True
                label, fold = column(batch, "label", part) == 1, column(batch, "fold", part)
                length, start, inputs = seeing.lengths(block), 0, block @ first
                for i, (flat, units, s) in enumerate(zip(flats, sizes, settings)):
                    hit = _output(inputs[:, start:start + units] / length[:, [i]], flat, width, units) > 0.5
                    start += units
                    used = np.ones(len(fold), bool) if s.holdout is None else fold == s.holdout
                    counts[i] += [(used & hit & label).sum(), (used & hit & ~label).sum(),
                                  (used & ~hit & label).sum(), (used & ~hit & ~label).sum()]
        if seen:
            yield gradient_batch(range(len(models)), np.zeros(len(models)), counts)

    return summed_gradients(rows, run, 4, len(models))[1]


class _Together:
    """Networks with one view, fold left out, seed and dropout, trained in a task that has all rows.

    Their first layers are one matrix, a column per hidden unit, with rows for the view's own terms, the units' biases and their output
    weights. Terms outside the view never reach a network, but their weights count in the limit of the norm, so their squares are kept.
    """

    def __init__(self, table: pa.Table, networks: list[MlpSetting], view: View, width: int):
        self.networks, self.view, self.width = networks, view, width
        self.own = np.arange(width) if view.scale is None else np.flatnonzero(view.scale)
        n, one = len(self.own), networks[0]
        self.seed, self.dropout, self.keep = one.seed, one.dropout, 1 - one.dropout
        units = np.array([s.units for s in networks])
        self.starts = np.concatenate([[0], np.cumsum(units)])
        self.owner = np.repeat(np.arange(len(networks)), units)
        self.unit = np.arange(len(self.owner)) - self.starts[self.owner]
        self.weights, self.bias = np.zeros((n + 2, len(self.owner))), np.zeros(len(networks))
        self.outside, self.shrunk = np.zeros(len(self.owner)), np.ones(len(self.owner))
        beyond = np.setdiff1d(np.arange(width), self.own)
        for i, s in enumerate(networks):
            first, _, out, _ = _parts(_start(s, width), width, s.units)
            cut = slice(*self.starts[i:i + 2])
            self.weights[:n, cut], self.weights[n + 1, cut] = first[self.own], out
            self.outside[cut] = (first[beyond] ** 2).sum(axis=0)
        self.rates = np.array([s.learning_rate for s in networks])
        # sums that decay, not averages: the step makes up for the factor
        self.moved, self.squares, self.slopes = (np.zeros_like(self.weights) for _ in range(3))
        self.bias_moved, self.bias_squares = np.zeros((2, len(networks)))
        self.keeps_rows = len(table) * (len(self.own) + 1) <= KEPT_NUMBERS
        fold, part = (np.asarray(table[c].combine_chunks()) for c in ("fold", "part"))
        trained = np.ones(len(fold), bool) if one.holdout is None else fold != one.holdout
        self.parts = [self._blocks(table.filter(pa.array(trained & (part == p)))) for p in range(max(part, default=0) + 1)]
        self.left_out = table if one.holdout is None else table.filter(pa.array(fold == one.holdout))

    def _blocks(self, table: pa.Table):
        """A function that gives the rows' own terms as the networks see them with a 1 behind, labels and numbers, in blocks."""
        def made():
            for batch in table.combine_chunks().to_batches():
                for block, rows in dense_blocks(batch, self.width):
                    x = np.ones((len(block), len(self.own) + 1))
                    x[:, :-1] = self.view(block)[:, self.own]
                    yield x, column(batch, "label", rows).astype(float), column(batch, "row", rows).astype(np.int64).view(np.uint64)

        if not self.keeps_rows:
            return made, len(table)
        kept = list(made())
        return lambda: kept, len(table)

    def _outputs(self, hidden: np.ndarray) -> np.ndarray:
        """Each network's probability (column) for each row."""
        sums = np.add.reduceat(hidden * self.weights[-1], self.starts[:-1], axis=1)
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))

    def step(self, number: int, part: int) -> None:
        blocks, seen = self.parts[part] if part < len(self.parts) else (None, 0)
        if not seen:
            return
        bias_slopes, begun = np.zeros(len(self.bias)), False
        for x, y, numbers in blocks():
            drawn = None
            if self.dropout:
                x = x.copy()
                x[:, :-1] *= _kept(numbers, self.own, self.seed, number, 0, self.keep)
                x[:, :-1] /= self.keep
                drawn = (kept_inputs(numbers, int(self.unit.max()) + 1, self.seed, number, 1, self.keep) / self.keep)[:, self.unit]
            pre = x @ self.weights[:-1]
            hidden = np.maximum(pre, 0)
            if drawn is not None:
                hidden *= drawn
            error = (self._outputs(hidden) - y[:, None]) / seen
            bias_slopes += error.sum(axis=0)
            error = error[:, self.owner]
            hidden *= error
            error *= self.weights[-1]
            error *= pre > 0
            if drawn is not None:
                error *= drawn
            if begun:
                self.slopes[:-1] += x.T @ error
                self.slopes[-1] += hidden.sum(axis=0)
            else:
                np.matmul(x.T, error, out=self.slopes[:-1])
                self.slopes[-1], begun = hidden.sum(axis=0), True
        self._move(_rate(number), bias_slopes)

    def _move(self, rate: float, bias_slopes: np.ndarray) -> None:
        """Adam's step, some rows of weights at a time, and the limit of the norm."""
        (fall, slow), n = DECAYS, len(self.own)
        rate, tiny = rate * self.rates * (1 - fall) / np.sqrt(1 - slow), TINY / np.sqrt(1 - slow)
        rates, height = rate[self.owner], max(1, CACHED_WEIGHTS // len(self.owner))
        norm, room = self.outside.copy(), np.empty((height, len(self.owner)))
        for start in range(0, n + 2, height):
            cut = slice(start, min(start + height, n + 2))
            slopes, moved, squares, weights = self.slopes[cut], self.moved[cut], self.squares[cut], self.weights[cut]
            change = room[: len(weights)]
            moved *= fall
            moved += slopes
            slopes *= slopes
            squares *= slow
            squares += slopes
            np.sqrt(squares, out=change)
            change += tiny
            np.divide(moved, change, out=change)
            change *= rates
            weights -= change
            if self.dropout and start < n:
                inner = weights[: n - start]
                norm += np.einsum("ij,ij->j", inner, inner)
        self.bias_moved = fall * self.bias_moved + bias_slopes
        self.bias_squares = slow * self.bias_squares + bias_slopes * bias_slopes
        self.bias -= rate * self.bias_moved / (np.sqrt(self.bias_squares) + tiny)
        if self.dropout:
            norm = np.sqrt(norm)
            factor = np.minimum(norm, 15 * self.dropout) / np.maximum(norm, 1e-7)
            if (factor != 1).any():
                self.weights[:n] *= factor
                self.shrunk *= factor
                self.outside *= factor * factor

    def counts(self) -> np.ndarray:
        """``tp, fp, fn, tn`` of every network on the fold it did not see."""
        counts = np.zeros((len(self.networks), 4))
        for x, y, _ in self._blocks(self.left_out)[0]():
            hit, label = self._outputs(np.maximum(x @ self.weights[:-1], 0)) > 0.5, (y == 1)[:, None]
            counts += np.array([(hit & label).sum(axis=0), (hit & ~label).sum(axis=0), (~hit & label).sum(axis=0), (~hit & ~label).sum(axis=0)]).T
        return counts

    def flat(self, i: int) -> np.ndarray:
        """A network's weights, terms outside its view included."""
        s, cut, n = self.networks[i], slice(*self.starts[i:i + 2]), len(self.own)
        flat = _start(s, self.width)
        first, inner, out, bias = _parts(flat, self.width, s.units)
        first *= self.shrunk[cut]
        first[self.own], inner[:], out[:], bias[:] = self.weights[:n, cut], self.weights[n, cut], self.weights[n + 1, cut], self.bias[i]
        return flat


def _apart(rows: DataFrame, settings: list[MlpSetting], width: int, views: list[View], steps_per_epoch: int, look):
    """``model, loss, gradient`` of what ``look(networks, i)`` gives of each setting's network after its epochs, or None for too many rows."""
    table = held(rows.withColumn("part", _part(steps_per_epoch)))
    if table is None:
        return None
    terms = {v: width if views[v].scale is None else int(np.count_nonzero(views[v].scale)) for v in {s.view for s in settings}}
    alike: dict[tuple, list[int]] = {}
    for i in sorted(range(len(settings)), key=lambda i: (settings[i].units, settings[i].learning_rate, settings[i].epochs)):
        s = settings[i]
        alike.setdefault((s.view, s.holdout, s.seed, s.dropout), []).append(i)
    groups = []
    for (view, *_), members in alike.items():
        size = np.inf
        for network, same in groupby(members, lambda i: replace(settings[i], epochs=0)):
            size += (terms[view] + 2) * network.units
            if size > DEALT_WEIGHTS:
                groups.append([])
                size = (terms[view] + 2) * network.units
            groups[-1] += same
    # the longest first, so that no task is left to run alone for long
    groups.sort(key=lambda g: -sum(terms[settings[i].view] * settings[i].units * settings[i].epochs for i in g))

    def work(group):
        chosen = [settings[i] for i in group]
        networks, epochs = _trajectories(chosen)
        place = {n: k for k, n in enumerate(networks)}
        together, taken = _Together(table, networks, views[chosen[0].view], width), 0
        for epoch in range(max(s.epochs for s in chosen) + 1):
            done = [i for i in group if settings[i].epochs == epoch]
            if done:
                for i, found in zip(done, look(together, [place[replace(settings[i], epochs=0)] for i in done])):
                    yield gradient_batch([i], np.zeros(1), found[None, :])
            if epoch < max(s.epochs for s in chosen):
                for part in np.random.default_rng(epoch).permutation(steps_per_epoch):
                    taken += 1
                    together.step(taken, part)

    return dealt(rows.sparkSession, groups, work)


def fit_networks_apart(rows: DataFrame, settings: list[MlpSetting], width: int, views: list[View] | None = None,
                       steps_per_epoch: int = 1) -> list[MlpModel]:
    """What ``fit_networks`` gives, up to rounding; when the rows are few, every task has all of them and trains some of the networks to their end."""
    views = views or [View()]
    found = _apart(rows, settings, width, views, steps_per_epoch, lambda networks, at: [networks.flat(i) for i in at])
    if found is None:
        return fit_networks(rows, settings, width, views, steps_per_epoch)
    flats = {i: flat.tolist() for i, _, flat in found}
    return [MlpModel(flats[i], width, s.units, vars(s).copy(), views[s.view]) for i, s in enumerate(settings)]


def searched_counts(rows: DataFrame, settings: list[MlpSetting], width: int, views: list[View] | None = None,
                    steps_per_epoch: int = 1) -> np.ndarray:
    """``tp, fp, fn, tn`` of every setting's network on the fold it did not see. Only these leave the tasks when the rows are few;
    otherwise as many networks are trained at a time as the driver has room for."""
    views = views or [View()]
    counts = np.zeros((len(settings), 4))
    found = _apart(rows, settings, width, views, steps_per_epoch, lambda networks, at: networks.counts()[at])
    if found is not None:
        for i, _, four in found:
            counts[i] = four
        return counts
    # those that differ in their epochs only are neighbours
    order = sorted(range(len(settings)), key=lambda i: (settings[i].view, str(replace(settings[i], epochs=0)), settings[i].epochs))
    while order:
        sizes = np.cumsum([settings[i].size(width) for i in order])
        now = max(1, int(np.searchsorted(sizes, PASS_WEIGHTS, side="right")))
        some, order = order[:now], order[now:]
        chosen = [settings[i] for i in some]
        counts[some] = network_counts(rows, fit_networks(rows, chosen, width, views, steps_per_epoch), chosen)
    return counts
