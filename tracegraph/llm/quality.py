"""Quality classification by supervised subword embeddings.

A document's features are hashed words and hashed character n-grams of its bytes. Each bucket has a
learned vector; the document is the mean of its features' vectors, and a softmax layer on top gives
the class. Trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.
Mean and output layer are linear, so for scoring each bucket keeps its logit: a document's logit is
the mean of its features' logits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import charlm, common, kernels

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSION = 8
#: Pseudo-words that each word gives which repeats the one before it: no n-gram stands for any repetition.
REPEAT_WORDS = 6
ROWS = BUCKETS + REPEAT_WORDS
EPOCHS = 6
RATE = 0.4
#: The sample that is fitted on: rows, characters of a text (longer ones are not sampled) and of all whole texts, at most.
SAMPLE_ROWS = 4096
SAMPLE_TEXT = 1 << 17
SAMPLE_CHARS = 24 << 20


@dataclass
class Model:
    logit: np.ndarray
    offset: float


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, row bounds) of the words, of pseudo-words for repeated words, then of each n-gram length, rows joined in order."""
    starts, ends, first = kernels.words(data, offsets)
    tokens = kernels.span_hashes(data, starts, ends)
    out = [((tokens >> np.uint64(40)).astype(np.int64) % BUCKETS, first)]
    again = np.zeros(len(tokens), bool)
    again[1:] = tokens[1:] == tokens[:-1]
    again[first[:-1][first[:-1] < len(tokens)]] = False
    repeats = np.concatenate([[0], np.cumsum(again)])[first]
    for k in range(REPEAT_WORDS):
        out.append((np.full(int(again.sum()), BUCKETS + k), repeats))
    for n in NGRAMS:
        grams = (kernels.byte_windows(data, n) >> np.uint64(40)).astype(np.int64) % BUCKETS
        low = np.minimum(offsets[:-1], len(grams))
        high = np.maximum(np.minimum(offsets[1:] - n + 1, len(grams)), low)
        inside = np.zeros(len(grams) + 1, np.int64)
        np.add.at(inside, low, 1)
        np.add.at(inside, high, -1)
        keep = np.cumsum(inside[:-1]) > 0
        out.append((grams[keep], np.concatenate([[0], np.cumsum(high - low)])))
    return out


def train(texts: list[str], labels: np.ndarray, seed: int = 1) -> Model:
    """Plain SGD, one document a step, rate falling linearly to 0; the order of rows is seeded."""
    if not len(texts):
        return Model(np.zeros(ROWS, np.float32), 0.0)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, data, offsets in kernels.pieces(pa.array(texts, pa.large_string())):
        parts = features(data, offsets)
        for r in range(len(offsets) - 1):
            ids, counts = np.unique(np.concatenate([f[b[r] : b[r + 1]] for f, b in parts]), return_counts=True)
            rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (ROWS, DIMENSION)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIMENSION, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, share = rows[k]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIMENSION, np.float32)
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[k]] -= 1
            rate = RATE * (1 - done / steps)
            done += 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= rate * error
            if len(ids):
                # a bucket's share is small; the step is scaled to the document's distinct features
                vectors[ids] -= (rate * len(ids) * 0.1 * share)[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def logits(column: pa.Array, model: Model) -> np.ndarray:
    out = np.full(len(column), model.offset)
    for a, b, data, offsets in kernels.pieces(column):
        total, count = np.zeros(b - a), np.zeros(b - a)
        for buckets, bounds in features(data, offsets):
            total += charlm.row_sums(model.logit[buckets].astype(np.float64), bounds)
            count += np.diff(bounds)
        out[a:b] += total / np.maximum(count, 1)
    return out


def _scorer(model):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(logits(texts, model.value), -50, 50))))

    return score.asNondeterministic()  # evaluated once a row, wherever the plan uses it


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    labels: (doc_id, quality). Learnt from whole texts of rows whose crc32(doc_id) mod 3 is not 1:
    the first by a hash of the id, up to SAMPLE_ROWS rows and SAMPLE_CHARS characters, without texts
    of over SAMPLE_TEXT characters. No label, language, source or id enters a score.

    Null text counts as empty; empty texts get the bias's score. Null labels are not learnt from,
    several labels of one id count as the largest; null doc_id is scored, never learnt from. Without
    labels every score is 0.5. Repeated rows are each scored. Empty table: no rows. Other columns are
    ignored, whatever their names.
    """
    common.small_batches(spark)
    held = F.pmod(common.key_crc(), F.lit(3)) == 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    order = (F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sample = rows.where(F.length("text") <= SAMPLE_TEXT).join(F.broadcast(picked), "doc_id").orderBy(*order).limit(SAMPLE_ROWS)  # at most SAMPLE_ROWS ids
    chars = F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    table = sample.withColumn("chars", chars).where(F.col("chars") <= SAMPLE_CHARS).orderBy(*order).select("text", "quality").toArrow()
    model = spark.sparkContext.broadcast(train(table.column(0).to_pylist(), (table.column(1).to_numpy() > 0).astype(int)))
    scored = rows.select("doc_id", held.alias("held_out"), _scorer(model)("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
