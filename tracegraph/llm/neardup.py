"""MinHash near-duplicates with circulant permutations and exact verification.

Two permutations of the 32-bit hash space make all signature coordinates: the first scatters a
document's shingles once, the second is read at positions shifted circularly by the coordinate's
number. Bands of coordinates give buckets. Equal sets are one class from the start; a bucket gives
first a star around its most central class, then the pairs of what the verified stars left outside
its largest component. Pairs whose signatures rule out the threshold are dropped; the others are
verified on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components, kernels

WORDS = 5
#: Coordinates of a signature, at most; banding uses as many as its rows divide.
COORDINATES = 192
#: Chance, at most, that a pair of exactly the threshold's similarity shares no band.
MISS = 3e-7
#: op3's figure: link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Standard deviations that a signature's agreement may lie under the threshold before a pair is dropped unverified.
DEVIATIONS = 4.6
#: Signature length for classes in buckets that the first stars left apart.
LONG = 768
#: Classes of a bucket that a task compares at once with as many strays, about; larger buckets are split into such blocks.
BLOCK = 1024

U32 = np.uint32


@dataclass(frozen=True)
class Plan:
    """What follows from a threshold: the longest bands that keep MISS, and the bounds of agreement."""

    percent: int

    @property
    def rows(self) -> int:
        t = self.percent / 100
        return max((r for r in range(2, 13) if (1 - t**r) ** (COORDINATES // r) <= MISS), default=1)

    @property
    def bands(self) -> int:
        return COORDINATES // self.rows

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    def least(self, coordinates: int) -> float:
        """Share of agreeing coordinates below which a pair is not verified, in hundredths."""
        t = self.percent / 100
        return math.floor(100 * (t - DEVIATIONS * math.sqrt(t * (1 - t) / coordinates))) / 100


def permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of 32-bit words."""
    x = x ^ (x >> U32(16))
    x *= U32(a)
    x ^= x >> U32(15)
    x *= U32(b)
    x ^= x >> U32(16)
    return x


def signatures(values: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """(rows x coordinates) minima; rows without shingles have the largest word everywhere."""
    out = np.full((len(bounds) - 1, coordinates), 0xFFFFFFFF, U32)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    scattered = permuted((values >> np.uint64(32)).astype(U32), 0x7FEB352D, 0x846CA68B)
    starts = bounds[:-1][full]
    for k in range(coordinates):
        out[full, k] = np.minimum.reduceat(permuted(scattered + np.full(1, k, U32), 0x85EBCA6B, 0xC2B2AE35), starts)
    return out


def band_keys(signature: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows x bands) 64-bit keys of the bands; the band's number is part of the key."""
    rows = signature.reshape(len(signature), plan.bands, plan.rows).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(plan.rows):
        acc = kernels.mix(acc * kernels.BASE + rows[:, :, k])
    return acc.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "k1", "k2", "sketch", "bands"]
    for batch in batches:
        for a, b, data, offsets in kernels.pieces(batch.column(1)):
            values, bounds = kernels.shingles(data, offsets, WORDS)
            sizes = np.diff(bounds)
            keys = np.zeros((2, b - a), np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                for k, salt in enumerate((1, 2)):
                    keys[k, full] = np.add.reduceat(kernels.mix(values + np.array([salt], np.uint64) * kernels.BASE), bounds[:-1][full])
            signature = signatures(values, bounds, plan.coordinates)
            sketch = kernels.binary_rows((signature & U32(255)).astype(np.uint8).reshape(-1), np.arange(b - a + 1) * plan.coordinates)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * plan.bands), pa.array(band_keys(signature, plan).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), sketch, bands], names=names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in kernels.pieces(batch.column(1)):
            values, bounds = kernels.shingles(data, offsets, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), kernels.binary_rows(values, bounds)], names=["rep", "members"])


def _long_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, members) to (rep, sketch) of LONG coordinates."""
    for batch in batches:
        if len(batch):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            low = (signatures(np.concatenate(sets), bounds, LONG) & U32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), kernels.binary_rows(low.reshape(-1), np.arange(len(sets) + 1) * LONG)], names=["rep", "sketch"])


def _agreeing(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb, sa, sb) whose sizes and signatures allow a link, as (a, b)."""
    for batch in batches:
        if not len(batch):
            continue
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, plan.coordinates) for k in (4, 5))
        keep = ((sa == sb).mean(1) >= plan.least(plan.coordinates)) & (100 * np.minimum(na, nb) >= plan.percent * np.maximum(na, nb))
        kept = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, ma, mb) that are links on their full sets, as (a, b)."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common_size = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * common_size >= plan.percent * (len(p) + len(q) - common_size))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def _block_pairs(rows: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """Pairs of a stray class (side 0) and a class of another component in one block of one bucket.

    Only pairs that share no earlier bucket, and are alike enough on the long signatures.
    """
    bands = np.stack(rows["bands"].to_numpy()).astype(np.int64)
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    rep, comp, n, side = (rows[c].to_numpy() for c in ("rep", "comp", "n", "side"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    here = int(np.flatnonzero((bands == rows["key"].iloc[0]).all(0))[0])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for x in left:
        other = right[comp[right] != comp[x]]
        other = other[100 * np.minimum(n[other], n[x]) >= plan.percent * np.maximum(n[other], n[x])]
        other = other[(bands[other] == bands[x]).argmax(1) == here] if len(other) else other
        other = other[(sketch[other] == sketch[x]).mean(1) >= plan.least(LONG)]
        if len(other):
            out.append((np.full(len(other), rep[x]), rep[other]))
    a, b = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n (distinct shingles), k1, k2 (the set's address), sketch, bands of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return rows.mapInArrow(partial(_sketch, plan=plan), "doc_id long, n long, k1 long, k2 long, sketch binary, bands array<long>")


def class_links(spark: SparkSession, docs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between classes (rep, n, sketch, bands), enough to connect what is connected.

    Every bucket gives a star around its most central class. Where verified stars leave a bucket in
    several components, each class outside the bucket's largest one is compared with all of the bucket.
    """
    keyed = common.materialize(spark, classes.select("rep", F.explode("bands").alias("key")), "keyed")
    shared = common.materialize(spark, keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    buckets = common.materialize(spark, common.hot_join(keyed, shared.withColumn("size", F.col("m")), ["key"], "size"), "buckets")
    weight = buckets.groupBy("rep").agg(F.sum("m").alias("w"))
    weighed = buckets.join(weight, "rep")
    centre = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("minus"))).alias("c"), F.first("m").alias("size"))
    centre = common.materialize(spark, centre.select("key", (-F.col("c.minus")).alias("pivot"), "size"), "centres")
    star = common.hot_join(buckets, centre, ["key"], "size").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))

    pairs = common.materialize(spark, _plausible(star.distinct(), classes, plan), "pairs")
    many = buckets.where("m > 2")  # of two classes the star leaves nothing to compare
    wanted = pairs.select("a").union(pairs.select("b")).union(many.select("rep")).distinct().toDF("rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), common.text_column(docs).alias("text"))
    sets = common.materialize(spark, texts.join(wanted, "rep", "left_semi").mapInArrow(_sets, "rep long, members binary").dropDuplicates(["rep"]), "sets")
    links = common.materialize(spark, _verified(pairs, sets, plan), "links")

    around = components.connected(spark, links).toDF("rep", "comp")
    placed = common.materialize(spark, many.join(around, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "placed")
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    split = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    split = common.materialize(spark, split.select("key", F.col("top.comp").alias("main"), (F.col("size") - F.col("top.n")).alias("strays"), "size"), "split")
    apart = common.materialize(spark, common.hot_join(placed, split, ["key"], "size"), "apart")
    longer = sets.join(apart.select("rep").distinct(), "rep", "left_semi").mapInArrow(_long_sketches, "rep long, sketch binary")
    apart = apart.join(classes.drop("sketch").join(longer, "rep"), "rep")
    across, down = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("strays", "m"))
    block = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ("key", "rep", "comp", "n", "sketch", "bands", "i", "j", "side")
    strays = apart.where("comp <> main").withColumn("i", block(0, across)).withColumn("j", every(down)).withColumn("side", F.lit(0)).select(*columns)
    whole = apart.withColumn("i", every(across)).withColumn("j", block(1, down)).withColumn("side", F.lit(1)).select(*columns)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        return _block_pairs(part, plan)

    rest = common.materialize(spark, strays.union(whole).groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct(), "rest")
    found = common.materialize(spark, links.union(_verified(rest, sets, plan)), "all-links")
    common.forget(spark, keyed, shared, buckets, centre, pairs, sets, links, placed, split, rest)
    return found


def _plausible(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    side = classes.select("rep", "n", "sketch")
    rows = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(partial(_agreeing, plan=plan), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    rows = pairs.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b")
    return rows.select("a", "b", "ma", "mb").mapInArrow(partial(_verify, plan=plan), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Shingles: five words (runs of bytes other than ASCII white space, A-Z lowered), as a set; a text
    of fewer words is one shingle. component_id: the smallest doc_id reachable over links of Jaccard
    similarity ``percent`` / 100 and more, the row's own included; kept: doc_id = component_id.

    Null text, or text without words: n_shingles 0, linked with nothing. Null doc_id: component_id
    null and kept, linked with nothing. Repeated rows: each gets the result of its set. doc_id is taken
    to name one text; of several texts with one id each is counted and classed by its own set, but one
    of them, any, stands for the id where sets are compared. Ties need no rule. Empty table: no rows.
    Other columns are ignored, whatever their names.
    """
    common.small_batches(spark, 500)
    plan = Plan(percent)
    rows = common.materialize(spark, sketches(docs, plan), "sketches")
    usable = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    least = usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "sketch", "bands")).alias("x"))
    classes = common.materialize(spark, least.select("k1", "k2", F.col("x.doc_id").alias("rep"), "x.n", "x.sketch", "x.bands"), "classes")
    links = class_links(spark, docs, classes.select("rep", "n", "sketch", "bands"), plan)
    around = components.connected(spark, links).toDF("rep", "component")
    owner = classes.select("k1", "k2", "rep").join(around, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "k1", "k2").join(owner, ["k1", "k2"], "left")
    common.forget(spark, links)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, common.read_table(spark, sf_dir, "documents"), PERCENT)
