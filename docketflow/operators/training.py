"""One scan of the training rows advances every model of a search.

The rows stay on the executors. Each pass sends the current weights of all models to the tasks; a task
adds up gradients over its rows with numpy and returns one row per model, and a grouped sum combines
them. What reaches the driver is one gradient per model, whatever the number of rows.

A search has many models. When its rows are few (their size is measured), they go to the tasks whole and the models are
dealt over the tasks instead, each trained to its end where it is. Both give the same models, up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

# Numbers of one dense block inside a task: wide rows and many models make short blocks, so that what a task holds doesn't grow with its rows.
BLOCK_NUMBERS = 500_000
# Weights of the models that one pass serves, in numbers; more models take more passes.
PASS_WEIGHTS = 8_000_000
# Gradients of all tasks together, in numbers, that the driver may take in one pass.
DRIVER_NUMBERS = 2_000_000

# Bytes of stored rows that may be sent to every worker.
HELD_BYTES = 64 << 20

GRADIENT_SCHEMA = "model int, loss double, gradient array<double>"


@dataclass(frozen=True)
class View:
    """How stored features become model input: a weight per column, then unit length if asked."""

    scale: np.ndarray | None = None
    unit: bool = False

    def __call__(self, block: np.ndarray) -> np.ndarray:
        x = block if self.scale is None else block * self.scale
        if not self.unit:
            return x
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, 1.0)


class Views:
    """What many models see of a block through their views, worked out from products with the block itself.

    A view's input is ``block * scale / length``. So one product of the block with all models' weights, scaled once, gives all
    scores, and no view's input is ever made.
    """

    def __init__(self, views: list[View], of: list[int], width: int):
        used = sorted(set(of))
        self._place = np.array([used.index(v) for v in of], int)
        self._scales = np.array([np.ones(width) if views[v].scale is None else views[v].scale for v in used]).reshape(len(used), width)
        self._unit = np.array([views[v].unit for v in used], bool)
        self._squares = (self._scales[self._unit] ** 2).T

    def scale(self, model: int) -> np.ndarray:
        return self._scales[self._place[model]]

    def scales(self) -> np.ndarray:
        """One row of column weights per model."""
        return self._scales[self._place]

    def lengths(self, block: np.ndarray) -> np.ndarray:
        """What each model (column) divides each row by."""
        found = np.ones((len(block), len(self._unit)))
        if self._unit.any():
            norm = np.sqrt((block * block) @ self._squares)
            found[:, self._unit] = np.where(norm > 0, norm, 1.0)
        return found[:, self._place]


def holdouts(settings) -> np.ndarray:
    """The fold that each setting leaves out, and a number that is no fold for none."""
    return np.array([np.iinfo(np.int64).min if s.holdout is None else s.holdout for s in settings], np.int64)


def training_rows(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold",
                  key: str | None = None) -> DataFrame:
    """Just what a pass reads. A plain array column becomes a vector, so both kinds share one path."""
    kind = df.schema[features].dataType.typeName()
    vector = array_to_vector(F.col(features).cast("array<double>")) if kind == "array" else F.col(features)
    row = F.lit(0).cast("bigint") if key is None else F.xxhash64(key)
    return df.select(vector.alias("features"), F.col(label).cast("int").alias("label"),
                     F.col(fold).cast("int").alias("fold"), row.alias("row"))


def dense_blocks(batch: pa.RecordBatch, width: int, beside: int = 0) -> Iterator[tuple[np.ndarray, slice]]:
    """The batch's vectors as dense blocks; sparse and dense vectors may be mixed. ``beside`` is how many numbers the caller makes of a row."""
    column = batch.column(batch.schema.get_field_index("features"))
    kind = np.asarray(column.field("type"))
    values, indices = column.field("values"), column.field("indices")
    block_rows = max(1, BLOCK_NUMBERS // max(width, beside, 1))
    for start in range(0, batch.num_rows, block_rows):
        rows = slice(start, min(start + block_rows, batch.num_rows))
        block = np.zeros((rows.stop - rows.start, width))
        part_values = values.slice(start, rows.stop - rows.start)
        part_indices = indices.slice(start, rows.stop - rows.start)
        sparse = kind[rows] == 0
        lengths = np.asarray(part_values.value_lengths())
        at_row = np.repeat(np.arange(len(block)), lengths)
        flat = np.asarray(part_values.flatten())
        from_sparse = np.repeat(sparse, lengths)
        columns = np.empty(len(flat), dtype=np.int64)
        columns[from_sparse] = np.asarray(part_indices.flatten())
        if not sparse.all():
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns[~from_sparse] = inside[~from_sparse]
        block[at_row, columns] = flat
        yield block, rows


def column(batch: pa.RecordBatch, name: str, rows: slice) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)))[rows]


def gradient_batch(models, losses: np.ndarray, gradients: np.ndarray) -> pa.RecordBatch:
    rows, width = gradients.shape
    listed = pa.ListArray.from_arrays(np.arange(0, (rows + 1) * width, width, dtype=np.int32), gradients.ravel())
    return pa.RecordBatch.from_arrays(
        [pa.array(models, pa.int32()), pa.array(losses, pa.float64()), listed], names=["model", "loss", "gradient"])


def passes_for(models: int, width: int) -> int:
    """How many passes ``models`` of ``width`` weights each are dealt over."""
    return max(1, min(models, -(-models * width // PASS_WEIGHTS)))


def summed_gradients(rows: DataFrame | pa.Table, task: Callable, width: int, models: int) -> tuple[np.ndarray, np.ndarray]:
    """Run ``task`` over the rows and add its output up per model; over held rows it runs right here.

    What few tasks give is added up by the driver, which saves a shuffle in every pass; more than ``DRIVER_NUMBERS`` is added up in Spark first.
    """
    if isinstance(rows, pa.Table):
        batches = task(iter(rows.to_batches()))
    else:
        parts = rows.mapInArrow(task, GRADIENT_SCHEMA)
        if rows.rdd.getNumPartitions() * width * models > DRIVER_NUMBERS:
            parts = parts.groupBy("model").agg(
                F.sum("loss").alias("loss"), vector_to_array(Summarizer.sum(array_to_vector("gradient"))).alias("gradient"))
        batches = parts.toArrow().to_batches()
    loss, gradient = np.zeros(models), np.zeros((models, width))
    for batch in batches:
        model, values = np.asarray(batch.column(0)), np.asarray(batch.column(2).flatten())
        np.add.at(loss, model, np.asarray(batch.column(1)))
        np.add.at(gradient, model, values.reshape(len(model), width))
    return loss, gradient


def held(rows: DataFrame) -> pa.Table | None:
    """The training rows, if they are small enough to be sent to every worker; they are measured first."""
    numbers = F.greatest(F.size(F.unwrap_udt("features")["values"]), F.lit(0))
    size = rows.agg(F.sum(numbers * 12 + 64)).first()[0] or 0
    return rows.toArrow() if size <= HELD_BYTES else None


def dealt(spark, groups: list[list[int]], work: Callable) -> Iterator[tuple[int, float, np.ndarray]]:
    """``model, loss, gradient`` of all that ``work(group)`` gives, every group of models in a task of its own, in the order given."""
    def run(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield from work(groups[at])

    found = spark.range(0, len(groups), 1, len(groups)).mapInArrow(run, GRADIENT_SCHEMA).toArrow()
    for batch in found.to_batches():
        ends = np.asarray(batch.column(2).offsets)
        values = np.asarray(batch.column(2).values)
        for k, (model, loss) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield model, loss, values[ends[k]:ends[k + 1]]
