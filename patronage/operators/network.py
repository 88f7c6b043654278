"""A feed-forward network for a 0/1 label, trained by data-parallel gradient steps.

Rows are written once as blocks of numbers. Every step sends the weights to the tasks; each task runs
its blocks forward and back and adds up the gradient, the sums meet in a tree, and the driver makes
one Adam step. Only weights and gradients move, some thousands of numbers whatever the number of rows.
Hidden layers use ReLU with dropout; a row counts by the weight of its class if ``balanced``.

A step looks at one of ``parts`` shares of the blocks, an epoch makes that many steps. Shares and
dropout depend on the seed, the step and the number of a block alone, so that the same seed gives
the same network up to the rounding of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators.labels import with_class_weight
from patronage.session import settle

BLOCK_ROWS = 256

Weights = list[tuple[np.ndarray, np.ndarray]]


def _forward(weights: Weights, x: np.ndarray, keep: float, pick) -> tuple[list, list, np.ndarray]:
    """Inputs of all layers, masks of the hidden ones, and the log-odds."""
    inputs, masks = [x], []
    for i, (w, b) in enumerate(weights[:-1]):
        mask = (x @ w + b > 0).astype(float)
        if pick is not None and i < len(weights) - 2:
            mask *= (pick.random(mask.shape) < keep) / keep
        x = (x @ w + b) * mask
        masks.append(mask)
        inputs.append(x)
    w, b = weights[-1]
    return inputs, masks, (x @ w + b)[:, 0]


def _gradient(weights: Weights, rows: np.ndarray, keep: float, pick) -> np.ndarray:
    """The flat gradient of the weighted log-loss of rows (label, weight, features), and the weight."""
    y, weight, x = rows[:, 0], rows[:, 1], rows[:, 2:]
    inputs, masks, odds = _forward(weights, x, keep, pick)
    error = ((1 / (1 + np.exp(-odds)) - y) * weight)[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(weights) - 1, -1, -1):
        parts[:0] = [(inputs[i].T @ error).ravel(), error.sum(0)]
        if i:
            error = (error @ weights[i][0].T) * masks[i - 1]
    return np.append(np.concatenate(parts), weight.sum())


def _shaped(flat: np.ndarray, sizes: Sequence[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


@dataclass
class Network:
    """A trained network. It scores as an MLlib model does: ``transform`` adds ``prediction`` and
    ``probability``. Layers are (weights by output, bias) pairs."""

    features: list[str]
    layers: list[tuple[list[list[float]], list[float]]]

    @property
    def stages(self) -> list[Network]:
        return [self]

    def log_odds(self, x: Column) -> Column:
        """The network as an expression over an array of features, layer by layer."""
        def layer(rows: list[list[float]], bias: list[float], last: bool):
            matrix = F.array(*[F.struct(F.array(*map(F.lit, row)).alias("w"), F.lit(b).alias("b"))
                               for row, b in zip(rows, bias)])

            def outputs(values: Column) -> Column:
                def unit(u: Column) -> Column:
                    out = u["b"] + F.aggregate(F.zip_with(u["w"], values, lambda w, v: w * v),
                                               F.lit(0.0), lambda s, v: s + v)
                    return out if last else F.greatest(out, F.lit(0.0))
                return F.transform(matrix, unit)
            return outputs

        for i, (rows, bias) in enumerate(self.layers):
            # Inside a lambda a layer's values are computed once.
            x = F.get(F.transform(F.array(x), layer(rows, bias, i == len(self.layers) - 1)), 0)
        return F.get(x, 0)

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.features])
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(x)))
        return (df.withColumn("_p", p)
                .withColumns({"prediction": (F.col("_p") > 0.5).cast("double"),
                              "probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))})
                .drop("_p"))


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], 1)
            for at in range(0, len(rows), BLOCK_ROWS):
                part = np.nan_to_num(rows[at:at + BLOCK_ROWS].astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([part.tobytes()], pa.binary())], ["number", "rows"])
                number += 1
    return run


def fit(train: DataFrame, features: Sequence[str], label: str = "churn", *,
        hidden: Sequence[int] = (64, 32, 16), epochs: int = 50, parts: int = 4, rate: float = 0.01,
        dropout: float = 0.3, balanced: bool = False, seed: int = 42) -> Network:
    """A network trained for ``epochs`` passes; expects scaled features.

    Missing features count as 0, rows without a label are left out. Dropout follows every hidden
    layer but the last. A table without rows gives a network of its starting weights.
    """
    features, keep = list(features), 1 - dropout
    known = train.filter(F.col(label).isNotNull())
    data = with_class_weight(known, label) if balanced else known.withColumn("weight", F.lit(1.0))
    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(
        [f"`{label}`", "weight", *[f"`{c}`" for c in features]])]
    width = len(columns)
    blocks = settle(data.select(*columns).mapInArrow(_blocks(width), "number bigint, rows binary"))
    sizes = [len(features), *hidden, 1]
    pick = np.random.default_rng(seed)
    flat = np.concatenate([x for a, b in zip(sizes, sizes[1:]) for x in (
        pick.normal(size=a * b) * math.sqrt(2 / a), np.zeros(b))])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    shares = max(1, min(parts, blocks.count()))
    rdd = blocks.rdd.map(lambda r: (r["number"], bytes(r["rows"])))
    context = train.sparkSession.sparkContext
    for step in range(1, epochs * parts + 1):
        sent = context.broadcast(flat)

        def add(total, block, step=step, sent=sent):
            number, raw = block
            if ((number >> 33) + (number & ((1 << 33) - 1)) + step) % shares:
                return total
            drop = np.random.default_rng([seed, step, number])
            rows = np.frombuffer(raw).reshape(-1, width)
            return total + _gradient(_shaped(sent.value, sizes), rows, keep, drop if dropout else None)

        total = rdd.treeAggregate(np.zeros(len(flat) + 1), add, lambda a, b: a + b)
        sent.destroy()
        if total[-1] <= 0:
            continue
        slope = total[:-1] / total[-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
        flat = flat - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return Network(features, [(w.T.tolist(), b.tolist()) for w, b in _shaped(flat, sizes)])
