"""Bloom filters, broadcast to thin out rows before an exact join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels

#: Bits of a filter for each value, and of any filter, at most.
VALUE_BITS, MOST_BITS = 12, 1 << 29


def _slots(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = kernels.mix(values.view(np.uint64) + np.uint64(77))
    return (mixed & np.uint64(bits - 1)).astype(np.int64), ((mixed >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Values to (word, bits) of a Bloom filter, one row per touched word and batch."""
    for batch in batches:
        slots = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().copy(), bits)))
        if len(slots):
            word, bit = slots >> 6, np.int64(1) << (slots & 63)
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(word[edge]), pa.array(np.bitwise_or.reduceat(bit, edge))], names=["word", "bits"])


def bloom(spark: SparkSession, values: DataFrame):
    """A broadcast Bloom filter of a written table of one long column without nulls.

    Its size follows the number of values up to MOST_BITS (64 MB). Where that would let most rows
    through there is no filter: None, and the exact join that follows does all of the work.
    """
    n = values.count()
    bits = min(MOST_BITS, 1 << max(16, (VALUE_BITS * n).bit_length()))
    if 2 * n > bits:
        return None
    table = values.mapInArrow(partial(_words, bits=bits), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return spark.sparkContext.broadcast(words)


def maybe(column: str, words) -> Column:
    """Whether a long column's value may be in the filter; only that column goes to Python. Null: no."""
    if words is None:
        return F.col(column).isNotNull()

    @F.arrow_udf("boolean")
    def held(values: pa.Array) -> pa.Array:
        table = words.value
        a, b = _slots(values.fill_null(0).to_numpy(zero_copy_only=False).copy(), len(table) << 6)
        there = ((table[a >> 6] >> (a & 63)) & (table[b >> 6] >> (b & 63)) & 1).astype(bool)
        return pa.array(there & values.is_valid().to_numpy(zero_copy_only=False))

    return held(F.col(column))
