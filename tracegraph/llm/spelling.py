"""Spelling variants: words within one edit of each other, from a forward and a reversed sorted dictionary.

One edit leaves a half of a word intact, so near words share the first half (neighbours in the sorted
dictionary) or the second half (neighbours in the dictionary sorted from the end). Words are dealt by
ranges of these halves and every range is scanned for near words. A block of words with the same half
that is too large for a scan is subdivided in the same way: the edit lies in the one or the other half of
what is left, so that more of the word is shared. Blocks that cannot be subdivided differ in one code
point only. No block is cut off, and each near pair is found in exactly one block.

A block stands for the pairs whose first difference lies at a place from ``low`` to below ``high``:
replacements between words of ``size`` code points, or insertions that lead from a word of ``size``
to one of one more. Its words share ``low`` code points at the start, and at the end what lies past the
last place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the vocabulary: what a word is made of, its least length and count, the share of runs that lose a code point.
RUNS, SHORTEST, LEAST, DAMAGE = r"[A-Za-zÀ-ÿ]", 7, 2, 31
#: How many times as frequent a word's form is, at least.
FACTOR = 10
#: Words of a block that are compared in one scan; larger ones are subdivided. More than the letters of a vocabulary.
BLOCK = 128
#: Bytes of code points that a scan lays out at a time; a block of very long words is compared pair by pair.
SCAN_BYTES = 32 << 20
KEYS = ["insert", "size", "low", "high", "shared"]


def runs_of(docs: DataFrame, shortest: int = SHORTEST, damage: int = DAMAGE) -> DataFrame:
    """(word): every run of at least ``shortest`` letters in the texts of (doc_id, text), A-Z in lower case.

    A run whose crc32 with its document's id is a multiple of ``damage`` loses a code point; a result
    that is too short for it is left out. Null ids count as empty.
    """
    text = F.translate(common.text_column(docs), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUNS}{{{shortest},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the runs that occur at least ``least`` times; counts meet in partial aggregates."""
    return runs_of(docs, shortest, damage).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _key(low: Column, tail: Column) -> Column:
    """What a block's words share: the first ``low`` and the last ``tail`` code points. Their lengths are part of the block."""
    return F.concat(F.substring("word", F.lit(1), low), F.when(tail > 0, F.right("word", tail)).otherwise(""))


def _halves(words: DataFrame) -> DataFrame:
    """Each word's two blocks, one for each half of the places from ``low`` to below ``high``."""
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    ends = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))))
    split = words.withColumn("part", ends).select("word", "n", "insert", "size", "part.low", "part.high")
    tail = F.greatest(F.lit(0), F.col("size") - F.col("high") + F.when(F.col("insert"), 1).otherwise(0))
    return split.withColumn("shared", _key(F.col("low"), tail))


def _sized(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written rows with their block's number of words, without blocks of one word, and the written table of blocks."""
    rows = common.materialize(spark, rows, "halves")
    sizes = common.materialize(spark, rows.groupBy(*KEYS).agg(F.count("*").alias("words")).withColumn("held", F.col("words")), "blocks")
    return common.hot_join(rows, sizes.where("words > 1"), KEYS, "held"), [rows, sizes]


def blocks_of(spark: SparkSession, words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n, insert, size, low, high, shared): every word in each of its blocks of two to ``most`` words."""
    size = F.length("word").cast("int")
    kinds = F.explode(F.array(*[F.struct(F.lit(insert).alias("insert"), (size - longer).alias("size")) for insert, longer in ((False, 0), (True, 0), (True, 1))]))
    whole = words.withColumn("k", kinds).select("word", "n", "k.insert", "k.size", F.lit(0).alias("low"), (F.col("k.size") + F.when(F.col("k.insert"), 1).otherwise(0)).alias("high"))
    whole, done = whole.where("high > 0"), []
    at = _halves(whole.where("high > 1")).unionByName(whole.where("high = 1").withColumn("shared", F.lit("")))
    while True:
        sized, tables = _sized(spark, at)
        fits = (F.col("words") <= most) | (F.col("high") - F.col("low") <= 1)
        done.append(common.materialize(spark, sized.where(fits).drop("words"), "scans"))
        rest = common.materialize(spark, sized.where(~fits).drop("words"), "large")
        common.forget(spark, *tables)
        if rest.isEmpty():
            common.forget(spark, rest)
            break
        at = _halves(rest)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _near(a: np.ndarray, b: np.ndarray, insert: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of code points, a of m and b of m (insert: m + 1): whether one edit leads from a to b, and the first difference."""
    m = a.shape[1]
    if not insert:
        differs = a != b
        return differs.sum(axis=1) == 1, differs.argmax(axis=1)
    ahead = np.logical_and.accumulate(a == b[:, :m], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + back >= m, ahead


def _points(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint32)
    for k, w in enumerate(words):
        got = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[k, : len(got)] = got
    return out


def _scan(words: list[str], block: np.ndarray, insert: bool, size: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Near pairs (places) of words in runs of equal ``block``; each row is compared with those that follow it in its run.

    For insertions a run's words of ``size`` stand before the longer ones.
    """
    found, longer = [], np.array([len(w) > size for w in words]) if insert else None
    points, at, d = _points(words, size + insert), np.arange(len(words)), 0
    while True:
        d += 1
        at = at[at + d < len(words)]
        at = at[block[at] == block[at + d]]
        if not len(at):
            return found
        pick = at[longer[at + d] & ~longer[at]] if insert else at
        if len(pick):
            near, first = _near(points[pick, :size], points[pick + d, : size + insert], insert)
            near &= (first >= low[pick]) & (first < high[pick])
            found += zip(pick[near].tolist(), (pick[near] + d).tolist(), strict=True)


def near_words(spark: SparkSession, words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of the written table (word, n) that one inserted, deleted or replaced code point tells apart, once.

    Words are distinct and not null. Blocks are dealt by ranges and sorted, so that a scan meets each block whole; a scan
    holds at most ``most`` words of a block (more only where one code point tells all of them apart, one row each).
    """
    common.small_batches(spark, rows=10_000)
    order = ["insert", "size", "low", "high", "shared"]
    dealt = blocks_of(spark, words, most).repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order, F.length("word"), "word").select(*order, "word", "n")

    def scan(batches):
        held, kind = [], None

        def flush():
            if not held:
                return None
            w = [h[0] for h in held]
            a = np.array([h[2:] for h in held], np.int64)
            pairs = _scan(w, a[:, 0], kind[0], kind[1], a[:, 1], a[:, 2])
            both = [(w[i], held[i][1], w[j], held[j][1]) for x, y in pairs for i, j in ((x, y), (y, x))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*both, strict=True), (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "near", "near_n"]) if both else None

        block, number = None, 0
        for batch in batches:
            for insert, size, low, high, shared, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (insert, size, low, high, shared) != block:
                    if (insert, size) != kind or len(held) * 4 * (size + 2) > SCAN_BYTES:
                        if (out := flush()) is not None:
                            yield out
                        kind = (insert, size)
                    block, number = (insert, size, low, high, shared), number + 1
                held.append((word, n, number, low, high))
        if (out := flush()) is not None:
            yield out

    return dealt.mapInArrow(scan, "word string, n long, near string, near_n long")


def roots(spark: SparkSession, forms: DataFrame, limit: int = 64) -> DataFrame:
    """(word, root) of the words with a form (word, form): the last word that forms lead to. Chains are halved each round."""
    at = common.materialize(spark, forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(limit):
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.materialize(spark, at.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.where("moved").isEmpty()
        common.forget(spark, at)
        at = step
        if not moved:
            break
    return at.select("word", "root")


def variants(spark: SparkSession, words: DataFrame, factor: int = FACTOR, most: int = BLOCK) -> DataFrame:
    """word, n, form, root, n_near, form_n of each word (word, n).

    form is the near word of largest n (ties: the first in code-point order) if its n is at least ``factor``
    (two or more) times the word's; root is where forms lead, the word itself without a form. Words must be
    distinct; null words are left out, the empty word is a word of length 0. Other columns are not read.
    """
    words = common.materialize(spark, words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(spark, words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = words.join(near, "word", "left")
    enough = -F.col("best.minus") >= factor * F.col("n")
    known = common.materialize(spark, known.select("word", "n", F.when(enough, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.minus")).alias("form_n")), "variants")
    return known.join(roots(spark, known), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(spark, vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")
