"""Language identification by interpolated Kneser-Ney character models, one per language.

Counts come from the whole training part of the corpus. Each order's grams lie in one sorted array
with a column of log-probabilities per language; a gram that is not there backs off through the
sorted arrays of its contexts' weights. The language of lowest cross-entropy per symbol is chosen;
documents whose cross-entropy exceeds what a left-out fold of that language's training documents
shows are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charlm, common, kernels

#: Left-out training documents whose cross-entropy may lie above the rejection threshold, as a share.
REJECT_SHARE = 0.005
#: One in so many training rows is kept out of the counts; rejection is calibrated on these.
CALIBRATION_FOLDS = 4
#: How many left-out rows all languages' common limit counts as beside a language's own: a quantile of few rows is noise.
COMMON_ROWS = 50
UNKNOWN = "und"
#: Sharpness of the score: nats of cross-entropy per symbol are multiplied by it.
SHARPNESS = 8.0


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order - 1: sorted grams
    logp: list[np.ndarray]  # their log-probabilities, one column per language
    contexts: list[np.ndarray]  # by order - 1: sorted contexts
    weight: list[np.ndarray]  # log of the share left to lower orders


def fit(spark: SparkSession, counts: DataFrame) -> Model:
    """counts: (grp, gram, n). Smoothing and marginals run in Spark over all counts; every gram and context is in the model."""
    languages = sorted(r[0] for r in counts.select("grp").distinct().collect())
    tables = charlm.levels(spark, counts, ["grp"])
    d = charlm.DISCOUNT
    lang = (F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("grp")) - 1).cast("int").alias("lang")
    model = Model(languages, [], [], [], [])
    for order, rows in enumerate(tables if languages else [], 1):
        sums = rows.groupBy("grp", "ctx").agg(F.max("total").alias("total"), F.max("kinds").alias("kinds"))
        table = sums.select(lang, "ctx", F.log(d * F.col("kinds") / F.col("total")).cast("float")).toArrow()
        keys, at = np.unique(table.column(1).to_numpy(), return_inverse=True)
        weight = np.zeros((len(keys), len(languages)), np.float32)
        weight[at, table.column(0).to_numpy()] = table.column(2).to_numpy()
        model.contexts.append(keys)
        model.weight.append(weight)
        table = rows.select(lang, "gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")).cast("float")).toArrow()
        keys, at = np.unique(table.column(1).to_numpy(), return_inverse=True)
        own = np.zeros((len(keys), len(languages)))
        own[at, table.column(0).to_numpy()] = table.column(2).to_numpy()
        lower = lookup(model, keys & charlm.mask(order - 1), order - 1) if order > 1 else np.full((len(keys), len(languages)), -np.log(1 << charlm.BITS))
        model.keys.append(keys)
        model.logp.append(np.log(own + np.exp(backoff(model, keys, order) + lower)).astype(np.float32))
    common.forget(spark, *tables)
    return model


def backoff(model: Model, grams: np.ndarray, order: int) -> np.ndarray:
    """Log weight that the grams' contexts leave to the lower order; 0 for contexts not seen."""
    at, there = charlm.find(model.contexts[order - 1], grams >> charlm.BITS)
    if not len(model.contexts[order - 1]):
        return np.zeros((len(grams), len(model.languages)))
    return np.where(there[:, None], model.weight[order - 1][at], 0.0)


def lookup(model: Model, grams: np.ndarray, order: int) -> np.ndarray:
    """Log-probabilities (grams x languages): the stored ones, or backed off order by order."""
    if order == 0:
        return np.full((len(grams), len(model.languages)), -np.log(1 << charlm.BITS))
    at, there = charlm.find(model.keys[order - 1], grams)
    out = np.zeros((len(grams), len(model.languages)), np.float32)
    out[there] = model.logp[order - 1][at[there]]
    gone = np.flatnonzero(~there)
    if len(gone):
        rest = grams[gone]
        out[gone] = backoff(model, rest, order) + lookup(model, rest & charlm.mask(order - 1), order - 1)
    return out


def cross_entropies(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Nats per symbol (texts x languages), and whether each text has a letter."""
    low = charlm.lowered(column)
    letters = np.asarray(pc.match_substring_regex(low, r"\pL").to_numpy(zero_copy_only=False), bool)
    out = np.zeros((len(column), len(model.languages)))
    for a, b, data, offsets in kernels.pieces(low):
        starts, ends, types, first, _ = charlm.word_types(data, offsets)
        if not len(starts) or not model.languages:
            continue
        grams, word = charlm.grams_of(data, starts, ends)
        edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        per_word = np.add.reduceat(lookup(model, grams, charlm.ORDER).astype(np.float64), edge, axis=0)
        size = np.diff(np.append(edge, len(word))).astype(np.float64)
        total = charlm.row_sums(np.concatenate([per_word, size[:, None]], 1)[types], first)
        out[a:b] = -total[:, :-1] / np.maximum(total[:, -1:], 1)
    return out, letters


def _predictor(model):
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double,cross_entropy:double>")
    def predict(texts: pa.Array) -> pa.Array:
        m = model.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        ce, letters = cross_entropies(texts, m)
        if m.languages:
            best = ce.argmin(1)
            soft = np.exp(-SHARPNESS * (ce - ce.min(1, keepdims=True)))
            score, low = 1 / soft.sum(1), ce.min(1)
        else:
            best, score, low, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best = np.where(letters, best, len(names) - 1)
        columns = [pa.array(names[best].tolist(), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(low)]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return predict.asNondeterministic()  # evaluated once a row, wherever the plan uses it


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row of ``docs``.

    Learnt from text and non-null lang of rows whose crc32(doc_id) mod 3 is not 1; lang, source
    and doc_id never enter a prediction. One in CALIBRATION_FOLDS of these rows is not counted.
    ``rejected``: cross_entropy above a limit. Each language has the REJECT_SHARE upper quantile of the rows that were left out
    and named right, drawn to the common one (its median plus that quantile, over all languages, of what rows have above their
    language's median) as if that were COMMON_ROWS rows more; a language without left-out rows rejects nothing.

    Null text or one without letters: `und`, score 0, rejected. Null doc_id: predicted and, as the
    empty key, learnt from. Ties take the first language by name. Repeated rows are each predicted.
    Without training rows all are `und`. Empty table: no rows. Other columns are ignored.
    """
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), common.text_column(docs).alias("text"))
    held = F.pmod(common.key_crc(), F.lit(3)) == 1
    known = ~held & F.col("lang").isNotNull()
    left_out = F.pmod(F.floor(common.key_crc() / 3), F.lit(CALIBRATION_FOLDS)) == 0
    train = rows.where(known & ~left_out).select(F.col("lang").alias("grp"), "text")
    counts = common.materialize(spark, charlm.count_grams(train), "language-counts")
    predict = _predictor(spark.sparkContext.broadcast(fit(spark, counts)))
    raw = rows.select("doc_id", held.alias("held_out"), F.when(known & left_out, F.col("lang")).alias("checked"), predict("text").alias("p"))
    raw = common.materialize(spark, raw.select("doc_id", "held_out", "checked", "p.*"), "language-scores")
    right = raw.where(F.col("checked") == F.col("lang_pred")).select("lang_pred", "cross_entropy")
    top = lambda c: F.percentile_approx(c, 1 - REJECT_SHARE, 10000)
    own = right.groupBy("lang_pred").agg(F.count("*").alias("n"), F.percentile_approx("cross_entropy", 0.5, 10000).alias("mid"), top("cross_entropy").alias("own"))  # a row per language
    excess = right.join(F.broadcast(own), "lang_pred").agg(top(F.col("cross_entropy") - F.col("mid")).alias("excess"))
    limits = own.join(F.broadcast(excess)).select("lang_pred", ((F.col("n") * F.col("own") + COMMON_ROWS * (F.col("mid") + F.col("excess"))) / (F.col("n") + COMMON_ROWS)).alias("limit"))
    joined = raw.join(F.broadcast(limits), "lang_pred", "left")  # a row per language
    rejected = F.when(F.col("lang_pred") == UNKNOWN, True).otherwise(F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(False)))
    return joined.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", rejected.alias("rejected"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, common.read_table(spark, sf_dir, "documents"))
