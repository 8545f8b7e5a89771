"""A network of one rectified hidden layer, trained by descent whose gradients Spark sums over each batch.

Weights are two matrices, (width + 1) x hidden and (hidden + 1) x classes; the last row of each holds the offsets. Only they
(and sums of their size) reach the driver: no figure there grows with the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut, forget
from ..plans.ship import ship_package
from .learning import probability_report

#: Cells of a gradient that travel in one row.
BLOCK = 64


def start(width: int, hidden: int, classes: int, seed: int = 0) -> list[np.ndarray]:
    """First weights: uniform, of variance 2 / (number of inputs), by md5 of seed:layer:input:output (from 1); offsets are 0."""
    layers = []
    for layer, (n, m) in enumerate(((width, hidden), (hidden, classes)), 1):
        w = np.zeros((n + 1, m))
        for i in range(n):
            for j in range(m):
                word = hashlib.md5(f"{seed}:{layer}:{i + 1}:{j + 1}".encode()).hexdigest()[:8]
                w[i, j] = math.sqrt(6 / n) * (int(word, 16) / 2**31 - 1)
        layers.append(w)
    return layers


def _with_ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and hidden values, each with a column of ones, and the probability of each class."""
    inputs = _with_ones(x)
    hidden = _with_ones(np.maximum(inputs @ layers[0], 0))
    scores = hidden @ layers[1]
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return inputs, hidden, p / p.sum(axis=1, keepdims=True)


def loss_sums(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows, summed log loss and summed gradient of both layers, as one vector."""
    inputs, hidden, p = forward(layers, x)
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(p[rows, y], 1e-300)).sum()
    p[rows, y] -= 1
    below = np.where(hidden[:, :-1] > 0, p @ layers[1][:-1].T, 0)
    return np.concatenate([[len(y), loss], (inputs.T @ below).ravel(), (hidden.T @ p).ravel()])


def gradient_blocks(rows: DataFrame, layers: list[np.ndarray]) -> DataFrame:
    """(block, g): the vector of ``loss_sums`` over all (x, y), BLOCK cells a row. A task sends one vector, Spark adds them up."""

    def partial(parts):
        import pandas as pd

        total = None
        for part in parts:
            if len(part):
                own = loss_sums(layers, np.vstack(part["x"].to_numpy()), part["y"].to_numpy().astype(int))
                total = own if total is None else total + own
        if total is not None:
            padded = np.append(total, np.zeros(-len(total) % BLOCK)).reshape(-1, BLOCK)
            yield pd.DataFrame({"block": range(len(padded)), "g": list(padded)})

    ship_package(rows.sparkSession)
    parts = rows.select("x", "y").mapInPandas(partial, "block int, g array<double>")
    return parts.groupBy("block").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(BLOCK)]).alias("g"))


def gradient(rows: DataFrame, layers: list[np.ndarray]) -> tuple[int, float, list[np.ndarray]]:
    """Rows, mean log loss and its mean gradient by layer; zeros without rows."""
    cells = np.zeros(2 + sum(w.size for w in layers) + BLOCK)
    for r in gradient_blocks(rows, layers).collect():  # as many cells as the network has weights
        cells[r.block * BLOCK : (r.block + 1) * BLOCK] = r.g
    n, middle = int(cells[0]), 2 + layers[0].size
    parts = cells[2:middle].reshape(layers[0].shape), cells[middle : middle + layers[1].size].reshape(layers[1].shape)
    return n, cells[1] / max(n, 1), [g / max(n, 1) for g in parts]


def gradient_cells(spark: SparkSession, rows: DataFrame, layers: list[np.ndarray]) -> DataFrame:
    """(layer, i, j, g): the mean gradient as rows, inputs i and outputs j from 1; the last i of a layer is its offsets. None without rows."""
    blocks = cut(spark, gradient_blocks(rows, layers), "gradient")  # read twice
    n = blocks.where("block = 0").select(F.col("g")[0].alias("n"))
    flat = blocks.select(F.col("block"), F.posexplode("g").alias("k", "g")).select((F.col("block") * BLOCK + F.col("k") - 2).alias("at"), "g")
    (a, m), (b, c) = (w.shape for w in layers)
    second = F.col("at") >= a * m
    at, wide = F.col("at") - F.when(second, a * m).otherwise(0), F.when(second, c).otherwise(m)
    cells = flat.where(F.col("at").between(0, a * m + b * c - 1)).join(F.broadcast(n))  # one row
    return cells.select(F.when(second, 2).otherwise(1).alias("layer"), (F.floor(at / wide) + 1).alias("i"), (at % wide + 1).cast("long").alias("j"), (F.col("g") / F.col("n")).alias("g"))


def usable(x: Column, width: int) -> Column:
    """Whether a vector has the width asked for and finite entries only."""
    return x.isNotNull() & (F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def scaled(rows: DataFrame, width: int) -> DataFrame:
    """x in units of the training rows: less their mean, over their population deviation (1 where it vanishes)."""
    x = [F.col("x")[k] for k in range(width)]
    m = rows.where("train").agg(F.array(*[F.avg(c) for c in x]).alias("mu"), F.array(*[F.stddev_pop(c) for c in x]).alias("sd")).first()
    sd = [v if v is not None and v >= 1e-8 else 1.0 for v in m.sd]
    mu = [v or 0.0 for v in m.mu]
    return rows.withColumn("x", F.array(*[(c - F.lit(a)) / F.lit(b) for c, a, b in zip(x, mu, sd)]))


def prepared(rows: DataFrame, width: int) -> DataFrame:
    """(key, x, y, train) of rows that can be used, scaled; see ``train``."""
    x = F.col("x").cast("array<double>")
    clean = rows.select("key", x.alias("x"), F.col("y").cast("int").alias("y"), "train").where(usable(F.col("x"), width) & F.col("y").isNotNull() & F.col("train").isNotNull())
    return scaled(clean, width)


def train(spark: SparkSession, rows: DataFrame, layers: list[np.ndarray], epochs: int = 60, batches: int = 1, rate: float = 0.5, decay: float = 1e-4) -> tuple[list[np.ndarray], list[float]]:
    """Weights after ``epochs`` passes, and the mean loss of each pass before its steps. rows: (key, x, y) as ``prepared`` gives them.

    Rows are dealt to batches by a hash of their key and written once, a folder a batch, so a step reads its own batch and a lost
    executor costs one step at most. A pass takes ``batches`` jobs however many rows there are. The rate halves twice, after a third
    and after two thirds of the passes; decay pulls on weights, not on offsets. A batch without rows takes no step.
    """
    layers = [w.copy() for w in layers]
    batch = F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")
    table = cut(spark, rows.select("x", "y", batch.alias("batch")), "batches", by=["batch"])
    losses = []
    for epoch in range(epochs):
        step = rate / 2 ** (3 * epoch // max(epochs, 1))
        seen, loss = 0, 0.0
        for k in range(batches):
            n, mean, slopes = gradient(table.where(F.col("batch") == k), layers)
            if n == 0:
                continue
            for w, g in zip(layers, slopes):
                w[:-1] *= 1 - step * decay
                w -= step * g
            seen, loss = seen + n, loss + n * mean
        losses.append(loss / max(seen, 1))
    forget(spark, table)
    return layers, losses


def predicted(rows: DataFrame, layers: list[np.ndarray]) -> DataFrame:
    """(label, prob): true class and the probability of each class, of (x, y)."""

    def score(parts):
        import pandas as pd

        for part in parts:
            if len(part):
                yield pd.DataFrame({"label": part["y"].astype(float), "prob": list(forward(layers, np.vstack(part["x"].to_numpy()))[2])})

    ship_package(rows.sparkSession)
    return rows.select("x", "y").mapInPandas(score, "label double, prob array<double>")


def network_report(spark: SparkSession, rows: DataFrame, width: int, classes: int, hidden: int = 128, universe: str = "both", seed: int = 0, **settings) -> DataFrame:
    """n, accuracy, top3, macro_f1 on the test side of (key, x array, y class index, train); see ``train`` for settings.

    Vectors that are null, of another width or not finite are left out on both sides. The last pass is judged: no pass is picked by the test side.
    """
    ready = cut(spark, prepared(rows, width), "scaled")
    layers, _ = train(spark, ready.where("train"), start(width, hidden, classes, seed), **settings)
    return probability_report(predicted(ready.where("not train"), layers), classes, universe)
