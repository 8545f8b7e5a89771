"""Kneser-Ney character models: corpus counts in Spark, scoring against sorted hash arrays.

A word is a maximal run of non-space characters of the lower-cased text, closed by a boundary
symbol on either side. A gram packs up to ORDER symbols, BITS bits each, into one long: the
predicted symbol lowest, before it as much context as the word has. Dropping the top symbols of a
gram gives its lower orders. All counts cover the whole corpus they are asked for, and no gram is left
out of what is sent to the tasks: a model grows with the corpus' distinct grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

ORDER, BITS = 5, 10
BOUNDARY = 1
DISCOUNT = 0.75
#: Entries that a counting task holds before it sends them on.
HELD_ENTRIES = 3 << 20


def mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


def word_types(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a chunk: their starts and ends in ``data``, then for every word its type, and the rows' first words."""
    starts, ends, first = kernels.words(data, offsets)
    hashes = kernels.span_hashes(data, starts, ends)
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return starts[index], ends[index], inverse, first, index


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of the words data[starts:ends], joined, and each gram's word."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts + 1
    stops = np.cumsum(sizes)
    begin = stops - sizes
    at = np.arange(stops[-1]) - np.repeat(begin, sizes) + np.repeat(starts, sizes)
    joined = data[np.minimum(at, len(data) - 1)].copy()
    joined[stops - 1] = 10
    text = joined.tobytes().decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    end = code == 10
    symbol = np.where(code < 1 << BITS, code, (1 << (BITS - 1)) + code % (1 << (BITS - 1)))
    symbol = np.where(end, BOUNDARY, np.maximum(symbol, 2))
    word = np.cumsum(end) - end
    first = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1])
    inside = np.arange(len(code)) - first[word]
    packed = symbol.copy()
    for k in range(1, ORDER):
        back = np.zeros(len(code), np.int64)
        back[k:] = symbol[:-k]
        packed |= np.where(inside >= k, back, np.where(inside == k - 1, BOUNDARY, 0)) << (BITS * k)
    return packed, word


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def drain() -> Iterator[pa.RecordBatch]:
        for group, parts in held.items():
            keys, counts = _merge(parts)
            for a in range(0, len(keys), 1 << 17):
                k, c = keys[a : a + (1 << 17)], counts[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(k), pa.string()), pa.array(k), pa.array(c)], names=["grp", "gram", "n"])
        held.clear()

    for batch in batches:
        groups = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = lowered(batch.column(1))
        for group in dict.fromkeys(groups):
            for _, _, data, offsets in kernels.pieces(texts.filter(pa.array(groups == group))):
                starts, ends, types, _, _ = word_types(data, offsets)
                if not len(starts):
                    continue
                grams, word = grams_of(data, starts, ends)
                weight = np.bincount(types, minlength=len(starts))
                held.setdefault(group, []).append(_merge([(grams, weight[word].astype(np.int64))]))
        if sum(len(k) for parts in held.values() for k, _ in parts) > HELD_ENTRIES:
            held = {g: [_merge(parts)] for g, parts in held.items()}
            if sum(len(parts[0][0]) for parts in held.values()) > HELD_ENTRIES // 2:
                yield from drain()
    yield from drain()


def count_grams(rows: DataFrame) -> DataFrame:
    """(grp, gram, n) over all rows of (grp string, text string): every word of every text counts."""
    return rows.mapInArrow(_count, "grp string, gram long, n long").groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def lower_order(grams: DataFrame, order: int, keys: list[str]) -> DataFrame:
    """Counts one order below: distinct one-symbol extensions, or raw counts where a word's start allows none."""
    key = F.col("gram").bitwiseAND(F.lit(mask(order)))
    value = F.when(F.col("gram") <= mask(order), F.col("n")).otherwise(F.lit(1))
    return grams.groupBy(*keys, key.alias("gram")).agg(F.sum(value).alias("n"))


def context(column: Column) -> Column:
    return F.shiftright(column, BITS)


def with_context(grams: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ctx, total (the context's count) and kinds (its distinct continuations)."""
    rows = grams.withColumn("ctx", context(F.col("gram")))
    sums = rows.groupBy(*keys, "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return rows.join(sums, [*keys, "ctx"])


def levels(spark: SparkSession, counts: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Written tables (keys, gram, n, ctx, total, kinds) of the orders 1 to ORDER; counts are those of ORDER."""
    out = [common.materialize(spark, with_context(counts, keys), f"grams-{ORDER}")]
    for order in range(ORDER - 1, 0, -1):
        out.insert(0, common.materialize(spark, with_context(lower_order(out[0], order, keys), keys), f"grams-{order}"))
    return out


def interpolated(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, gram, p): interpolated Kneser-Ney probabilities of all grams seen at the highest order of ``levels``."""
    out = tables[0].select(*keys, "gram", (F.col("n") / F.col("total") * 0.999 + 0.001 / (1 << BITS)).alias("p"))
    for order, rows in enumerate(tables[1:], 2):
        joined = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit(mask(order - 1)))).join(out.withColumnsRenamed({"gram": "low", "p": "p_low"}), [*keys, "low"])
        own = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
        out = joined.select(*keys, "gram", (own + F.col("kinds") * DISCOUNT / F.col("total") * F.col("p_low")).alias("p"))
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` in the sorted array ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[r]:first[r + 1]], whole rows of a 2-d array or numbers, summed row by row."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out
