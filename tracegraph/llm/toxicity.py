"""Toxicity by class-conditional Kneser-Ney models.

Two character models, toxic and ordinary, share one backoff distribution, the interpolated model of
both classes' counts together: what one class has seen rarely or never leans on it, and an
expression that neither class has seen scores alike in both. A document's
evidence is its log-likelihood ratio per symbol, and that of its most toxic passage of a few words; a
logistic curve, fitted on a bounded sample of a labelled fold that the counts leave out, turns both
into a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charlm, common, kernels
from .bloom import bloom, maybe

#: Labelled rows of the left-out fold that the logistic curve is fitted on, at most.
CALIBRATION_ROWS = 8192
#: Words in a row that are also judged on their own: two toxic words do not show in a long text's mean.
PASSAGE = 3


@dataclass
class Model:
    """Sorted grams with their log ratio, and sorted contexts with the ratio of an unseen continuation."""

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray


def fit(spark: SparkSession, counts: DataFrame) -> Model:
    """counts: (grp, gram, n) with grp '1' toxic and '0' ordinary. Smoothing runs in Spark; every gram and context is in the model."""
    both = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("grp") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in "01"])
    both = common.materialize(spark, both, "classes")
    tables = charlm.levels(spark, both.select("gram", (F.col("n0") + F.col("n1")).alias("n")), [])
    shared = charlm.interpolated(tables, []).withColumnRenamed("p", "p_low")
    rows = both.withColumn("ctx", charlm.context(F.col("gram")))
    sums = rows.groupBy("ctx").agg(*[f(g) for g in "01" for f in (lambda g: F.sum(f"n{g}").alias(f"t{g}"), lambda g: F.sum((F.col(f"n{g}") > 0).cast("long")).alias(f"k{g}"))])
    sums = common.materialize(spark, sums, "contexts")
    d = charlm.DISCOUNT
    weight = {g: F.when(F.col(f"t{g}") > 0, d * F.col(f"k{g}") / F.col(f"t{g}")).otherwise(1.0) for g in "01"}
    own = {g: F.when(F.col(f"t{g}") > 0, F.greatest(F.col(f"n{g}") - d, F.lit(0.0)) / F.col(f"t{g}")).otherwise(0.0) for g in "01"}
    p = {g: own[g] + weight[g] * F.col("p_low") for g in "01"}
    backoff = F.log(weight["1"]) - F.log(weight["0"])
    seen = rows.join(sums, "ctx").join(shared, "gram").select("gram", (F.log(p["1"]) - F.log(p["0"])).alias("ratio"))
    unseen = sums.select("ctx", backoff.alias("ratio"))
    held = []
    for frame, key in ((seen, "gram"), (unseen, "ctx")):
        table = frame.select(key, F.col("ratio").cast("float")).toArrow()
        keys = table.column(0).to_numpy()
        at = np.argsort(keys)
        held += [keys[at], table.column(1).to_numpy()[at]]
    common.forget(spark, both, sums, *tables)
    return Model(*held)


def evidence(column: pa.Array, model: Model) -> np.ndarray:
    """Two length-normalised log-likelihood ratios of each text, in nats per symbol; 0 and 0 for texts without words.

    The first is the whole text's, every word counted as often as it stands there. The second is that
    of its passage of PASSAGE words in a row with the highest ratio (of all its words, if fewer).
    """
    out = np.zeros((len(column), 2))
    for a, b, data, offsets in kernels.pieces(charlm.lowered(column)):
        starts, ends, types, first, _ = charlm.word_types(data, offsets)
        if not len(starts):
            continue
        grams, word = charlm.grams_of(data, starts, ends)
        at, there = charlm.find(model.grams, grams)
        c_at, c_there = charlm.find(model.contexts, grams >> charlm.BITS)
        ratio = np.where(there, model.ratio[at] if len(model.ratio) else 0.0, np.where(c_there, model.unseen[c_at] if len(model.unseen) else 0.0, 0.0)).astype(np.float64)
        ratio, size = (np.bincount(word, weights, minlength=len(starts))[types] for weights in (ratio, None))
        total = charlm.row_sums(np.stack([ratio, size.astype(np.float64)], 1), first)
        out[a:b, 0] = total[:, 0] / np.maximum(total[:, 1], 1)
        row = np.repeat(np.arange(b - a), np.diff(first))
        best = np.full(b - a, -np.inf)
        for k in range(1, PASSAGE + 1):  # a passage is shorter only where the text is
            if len(ratio) < k:
                break
            n = len(ratio) - k + 1
            value = sum(ratio[j : n + j] for j in range(k)) / sum(size[j : n + j] for j in range(k))
            inside = (row[:n] == row[k - 1 :]) & ((np.diff(first)[row[:n]] == k) | (k == PASSAGE))
            np.maximum.at(best, row[:n][inside], value[inside])
        out[a:b, 1] = np.where(np.diff(first) > 0, best, 0.0)
    return out


def _evidence_of(model):
    @F.arrow_udf("struct<evidence:double,passage:double>")
    def get(texts: pa.Array) -> pa.Array:
        got = evidence(texts, model.value)
        return pa.StructArray.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["evidence", "passage"])

    return get.asNondeterministic()  # evaluated once a row, wherever the plan uses it


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the columns of x, then its offset (Newton's method, lightly penalised)."""
    if not len(x) or y.min() == y.max():
        return np.array([1.0] * x.shape[1] + [-5.0])
    m, s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z, w = np.concatenate([(x - m) / s, np.ones((len(x), 1))], 1), np.zeros(x.shape[1] + 1)
    penalty = np.array([1e-2] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / s, w[-1] - (w[:-1] * m / s).sum())


def score_column(spark: SparkSession, docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Every row and column of ``docs`` plus the struct ``name``: held_out, score, predicted, evidence, passage.

    See ``score_documents``; a column called ``name`` is replaced, no other is touched.
    """
    common.small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    fold = F.pmod(common.key_crc(), F.lit(5))
    known = common.materialize(spark, known.withColumn("fold", fold).where("fold > 0"), "known")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    counted = known.where("fold < 4").select("doc_id", "toxic")
    # texts without a label stay where they are: a filter on ids, then the exact join
    likely = base.where(fold.isin(1, 2, 3)).where(maybe("doc_id", bloom(spark, counted.select("doc_id"))))
    train = likely.join(counted, "doc_id").select(F.when(F.col("toxic") > 0, "1").otherwise("0").alias("grp"), "text")
    counts = common.materialize(spark, charlm.count_grams(train), "toxic-counts")
    find = _evidence_of(spark.sparkContext.broadcast(fit(spark, counts)))
    picked = known.where("fold = 4").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    sample = base.join(F.broadcast(picked), "doc_id")  # at most CALIBRATION_ROWS ids
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(CALIBRATION_ROWS)
    sample = sample.select(find("text").alias("e"), "toxic").select("e.evidence", "e.passage", "toxic").toArrow()
    got = np.stack([c.to_numpy().astype(float) for c in sample.columns], 1)
    weights = [float(w) for w in logistic(got[:, :2], (got[:, 2] > 0).astype(float))]
    e = common.fresh(docs, "_evidence")
    scored = docs.withColumn(e, find(common.text_column(docs)))
    score = 1 / (1 + F.exp(-(F.col(e)["evidence"] * weights[0] + F.col(e)["passage"] * weights[1] + weights[2])))
    value = F.struct(F.coalesce(fold == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col(e)["evidence"].alias("evidence"), F.col(e)["passage"].alias("passage"))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()], value.alias(name))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, passage for every row of ``docs``.

    labels: (doc_id, toxic). Learnt from rows whose crc32(doc_id) mod 5 is not 0: counts from
    remainders 1 to 3, the logistic curve from at most CALIBRATION_ROWS rows of remainder 4. No
    label, language, source or id enters a score.

    Null or empty text: evidence and passage 0, scored like any other. Null labels and labels without a text
    are not learnt from; several labels of one id count as the largest. Null doc_id: scored, never
    learnt from. Without labelled rows of both classes no score reaches 0.5. Repeated rows are each scored.
    Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return score_column(spark, rows, labels, "toxicity").select("doc_id", "toxicity.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
