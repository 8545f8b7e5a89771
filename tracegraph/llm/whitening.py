"""Embedding whitening from an exact integer scatter.

Entries become integers; a shift is subtracted, sums and cross-products are accumulated without
rounding, and n·XᵀX - SSᵀ is formed exactly. Only then is it made floating point and decomposed.
Tasks give partial sums as limbs of 40 bits, which Spark adds up by cell, so that what reaches the
driver is one scatter matrix, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb. Spark's sums of limbs are exact up to 2^23 tasks.
LIMB = 40
#: Entries of this magnitude times the scale, or larger, are no longs and count as not finite.
LARGEST = 2.0**62


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector has entries, all of them finite; never null."""
    held = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)) & ~F.isnan(c))
    return F.coalesce((F.size(vector) > 0) & held, F.lit(False))


def matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """The vectors' entries as integers without the offset: floor(scale * entry), a row a vector."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.reshape(len(vectors), -1)).astype(np.int64)


def cross(y: np.ndarray) -> np.ndarray:
    """yᵀy exactly, as Python integers: floating point products in blocks whose sums stay below 2^53."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    most = int(max(-int(y.min()), int(y.max()), 1)) if y.size else 1
    block = 2**53 // (most * most)
    if block == 0:
        big = y.astype(object)
        return out + big.T.dot(big)
    for at in range(0, len(y), block):
        part = y[at : at + block].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def limbs(value: int) -> list[int]:
    """Digits of an integer to the base 2^LIMB, least first; the last carries the sign."""
    out = []
    while not -(1 << LIMB) < value < (1 << LIMB):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def scatter(vectors: DataFrame, width: int, scale: int, shift: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, cross-products) of the integers less ``shift``, exact. vectors: (vector) of ``width`` usable entries.

    Cell 0 counts, cells 1 to d are sums, the rest the upper triangle.
    """
    upper = np.triu_indices(width)

    def partial(batches):
        n, s, c = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column(0), scale) - shift
                n, s, c = n + len(y), s + y.astype(object).sum(axis=0), c + cross(y)
        if n:
            rows = [(cell, k, x) for cell, v in enumerate([n, *s.tolist(), *c[upper].tolist()]) for k, x in enumerate(limbs(int(v))) if x]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cell", "limb", "value"])

    total = [0] * (1 + width + len(upper[0]))
    for r in vectors.mapInArrow(partial, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value")).toLocalIterator():
        total[r.cell] += r.value << (LIMB * r.limb)
    products = np.zeros((width, width), object)
    products[upper] = total[1 + width :]
    return total[0], total[1 : 1 + width], products + np.triu(products, 1).T


def rank_of(exact: np.ndarray) -> int:
    """Rank of a matrix of integers, by elimination modulo two primes near 2^61: too low with a chance of about d / 2^60 for each."""
    best = 0
    for prime in (2**61 - 1, 2**61 - 31):
        rows, rank = [[int(x) % prime for x in row] for row in exact.tolist()], 0
        for col in range(len(rows)):
            pivot = next((r for r in range(rank, len(rows)) if rows[r][col]), None)
            if pivot is None:
                continue
            rows[rank], rows[pivot] = rows[pivot], rows[rank]
            inverse = pow(rows[rank][col], -1, prime)
            lead = [x * inverse % prime for x in rows[rank]]
            for r in range(rank + 1, len(rows)):
                if f := rows[r][col]:
                    rows[r] = [(a - f * b) % prime for a, b in zip(rows[r], lead, strict=True)]
            rank += 1
        best = max(best, rank)
    return best


def decompose(n: int, sums: list[int], products: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as columns, their eigenvalues by size, trace) of the covariance (n·XᵀX - SSᵀ) / n².

    At most as many as the exact matrix's rank: directions without variance have no component. Each
    component's largest entry is positive.
    """
    s = np.array(sums, object)
    exact = n * products - np.outer(s, s)
    covariance = np.array([[int(x) / (n * n) for x in row] for row in exact.tolist()], np.float64)  # correctly rounded
    values, components = np.linalg.eigh(covariance)
    k = min(most, rank_of(exact))
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    lead = components[np.abs(components).argmax(axis=0), np.arange(k)] if k else np.ones(0)
    return components * np.sign(lead), values, int(sum(exact.diagonal())) / (n * n)


def projected(y: np.ndarray, n: int, sums: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """(y - S/n) times ``axes``: a fixed order of sums, so that equal rows have equal values wherever they lie."""
    out = np.zeros((len(y), axes.shape[1]))
    for j in range(y.shape[1]):
        if n * (int(np.abs(y[:, j]).max(initial=0)) + 1) + abs(int(sums[j])) < 2**63:
            centred = (n * y[:, j] - int(sums[j])) / n
        else:
            centred = np.array([(n * int(v) - int(sums[j])) / n for v in y[:, j]])
        out += centred[:, None] * axes[j]
    return out


def deviations(y: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Per row the sum of (n * x - S)², exact."""
    reach = n * (int(np.abs(y).max(initial=0)) + 1) + max(abs(int(s)) for s in sums)
    if reach * reach * y.shape[1] < 2**63:
        return ((n * y - np.array([int(s) for s in sums], np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in y]


def whiten(spark: SparkSession, rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, shift: int | None = None, column: str = "white") -> DataFrame:
    """The rows with a usable vector, all their columns, plus ``column``: (n, deviation, whitened, explained, identity_error).

    A vector's integers are floor(scale * entry) + offset; ``shift`` (the offset unless given) is taken
    off them before sums are formed, which changes no result. whitened and explained are arrays, a
    component each; deviation is exact, null past 38 digits; identity_error is the largest absolute
    difference of the whitened rows' covariance from the identity.

    Rows whose vector is null, empty, or holds null, NaN, infinite entries or ones that are no longs are
    left out. So are vectors of another length than most have (ties: the longer). With equal vectors
    alone nothing varies: arrays are empty and the error is 0. Null and repeated ids and other columns
    stay as they are; a column named as ``column`` is replaced. An empty table gives an empty one. The
    frame is read three times and must give the same rows each time.
    """
    common.small_batches(spark, rows=4096)
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != column.lower()]
    good = rows.where(usable(F.col(f"`{vector}`"), scale))
    sizes = good.groupBy(F.size(f"`{vector}`").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    kind = "struct<n: long, deviation: decimal(38,0), whitened: array<double>, explained: array<double>, identity_error: double>"
    if sizes is None:
        return good.select(*kept, F.lit(None).cast(kind.replace(": ", ":")).alias(column))
    width = sizes.width
    good = good.where(F.size(f"`{vector}`") == width)
    vectors = good.select(F.col(f"`{vector}`").alias("vector"))
    less = offset if shift is None else shift
    n, sums, products = scatter(vectors, width, scale, less - offset)
    axes, values, trace = decompose(n, sums, products, components)
    axes, sums, k = axes / np.sqrt(values), np.array(sums, object), len(values)
    pairs = np.triu_indices(k)

    def moments(batches):
        s, c = np.zeros(k), np.zeros(len(pairs[0]))
        for batch in batches:
            if batch.num_rows:
                w = projected(matrix(batch.column(0), scale) - (less - offset), n, sums, axes)
                s, c = s + w.sum(axis=0), c + (w.T @ w)[pairs]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + len(c)), pa.int32()), pa.array(np.concatenate([s, c]))], ["cell", "value"])

    error = 0.0
    if k:
        total = np.zeros(k + len(pairs[0]))
        for r in vectors.mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toLocalIterator():
            total[r.cell] = r.value / n
        mean = total[:k]  # 0 but for rounding: rows are centred before they are multiplied
        error = float(np.abs(total[k:] - (mean[pairs[0]] * mean[pairs[1]]) - (pairs[0] == pairs[1])).max())
    explained = (values / trace).tolist() if k else []

    @F.arrow_udf(kind)
    def apply(v: pa.Array) -> pa.Array:
        y = matrix(v, scale) - (less - offset)
        big = [x if x < 10**38 else None for x in deviations(y, n, sums)] if len(y) else []
        w = projected(y, n, sums, axes)
        lists = lambda flat: pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), flat)
        parts = [pa.array([n] * len(y), pa.int64()), pa.array(big, pa.decimal128(38, 0)), lists(pa.array(w.ravel())), lists(pa.array(np.tile(np.array(explained), len(y)))), pa.array([error] * len(y), pa.float64())]
        return pa.StructArray.from_arrays(parts, ["n", "deviation", "whitened", "explained", "identity_error"])

    return good.select(*kept, apply(F.col(f"`{vector}`")).alias(column))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component: n, deviation (null past a long), whitened, explained, identity_error."""
    rows = whiten(spark, common.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    flat = rows.select("vec_id", "white.n", F.expr("try_cast(white.deviation as long)").alias("deviation"), "white.identity_error", F.posexplode(F.arrays_zip("white.whitened", "white.explained")).alias("at", "c"))
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
