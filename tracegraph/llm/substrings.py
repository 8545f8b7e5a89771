"""Removal of byte strings that occur again anywhere in the corpus.

A byte goes when some string of LENGTH bytes over it also starts elsewhere. Every such string has
an anchor: the window of GRAM bytes in it with the smallest hash (the leftmost such). Equal strings
have equal anchors at equal offsets, so only occurrences of one anchor need comparing:

1. each run of string starts with one anchor is a row: anchor hash, hash of the bytes that the
   run's strings cover, place;
2. anchors that occur once drop out (a Bloom filter of bounded size first, counts decide);
3. runs whose covered bytes occur twice are repeated whole;
4. of what is left, one context per distinct content is cut into pieces of STEP offsets. What all
   strings of a piece share is one symbol; a Burrows-Wheeler transform of the pieces and breadth-
   first backward extension give common prefixes up to the threshold of STEP symbols, and with them
   the repeated strings. Pieces whose shared part is very frequent are settled by counting the
   hashes of their strings instead, which needs no group in one task;
5. the repeated strings' spans are united per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, common, kernels
from .bloom import bloom, maybe

LENGTH = 200
GRAM = 41
STEP = 32  # (LENGTH - GRAM + 1) is a multiple of it
#: Pieces with one shared part that a task compares at once, at most; those of a hotter part are cut
#: down to single strings, which Spark groups by hash: the same result, in any number of tasks.
FREQUENT = 4096
#: Symbols that one transform covers, about.
BLOCK_SYMBOLS = 400_000


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, anchor, first start, last start) of the runs of string starts with one anchor."""
    width = length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    hashes = kernels.byte_windows(data, gram)
    value = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    if size < width:
        value = np.minimum(value[: len(value) - (width - size)], value[width - size :])
    anchor = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1
    valid = np.arange(len(anchor)) + length <= offsets[row + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return none
    anchor, row = anchor[start], row[start]
    edge = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(start)) - 1
    return row[first], hashes[anchor[first]], anchor[first], start[first], start[last]


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = kernels.powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total, down


def _span_hash(prefix: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
    total, down = prefix
    return kernels.mix(kernels.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)) + salt.astype(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (rid, anchor, content, place); place packs anchor position, largest and smallest offset."""
    for batch in batches:
        rids = batch.column(0).to_numpy()
        for a, _, data, offsets in kernels.pieces(batch.column(1)):
            row, anchor_hash, anchor, first, last = anchors_of(data, offsets, length, gram)
            if not len(row):
                continue
            content = _span_hash(_prefix(data), first, last + length, anchor - first)
            place = ((anchor - offsets[row]) << 16) | ((anchor - first) << 8) | (anchor - last)
            yield pa.RecordBatch.from_arrays([pa.array(rids[a + row]), pa.array(anchor_hash.view(np.int64)), pa.array(content.view(np.int64)), pa.array(place)], names=["rid", "anchor", "content", "place"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(text, rid, contexts (place, anchor, alone)) to pieces."""
    names = ["key", "rid", "at", "low", "high", "left", "right"]
    for batch in batches:
        rids = batch.column(1).to_numpy()
        for a, b, data, offsets in kernels.pieces(batch.column(0)):
            lists = batch.column(2).slice(a, b - a)
            flat = lists.flatten()
            count = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(b - a), count)
            place, anchor, alone = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            at, high, low = place >> 16, (place >> 8) & 255, place & 255
            parts = high // STEP - low // STEP + 1
            own = np.repeat(np.arange(len(place)), parts)
            block = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts) + (low // STEP)[own]
            o1, o2 = block * STEP, block * STEP + STEP - 1
            lo, hi = np.maximum(low[own], o1), np.minimum(high[own], o2)
            mid = offsets[row[own]] + at[own]
            key = _span_hash(_prefix(data), mid - o1, mid - o2 + length, anchor[own].view(np.uint64) + block.astype(np.uint64))
            raw = data.tobytes()
            left = [raw[x:y] for x, y in zip((mid - hi).tolist(), (mid - o1).tolist(), strict=True)]
            right = [raw[x:y] for x, y in zip((mid - o2 + length).tolist(), (mid - lo + length).tolist(), strict=True)]
            rid = pa.array(rids[a + row[own]], mask=~np.asarray(alone, bool)[own]) if len(own) else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rid, pa.array(at[own]), pa.array(lo), pa.array(hi), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=names)


def repeated_strings(keys: np.ndarray, left: list[bytes], right: list[bytes], high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the pieces' strings that occur in another piece of the same key.

    A piece's string at offset o is the last o - o1 bytes of ``left``, the shared part, and the first
    o2 - o bytes of ``right``; with the shared part as one symbol it has STEP symbols.
    """
    m = len(keys)
    codes = np.unique(keys, return_inverse=True)[1] + m + 256
    sizes = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    total = sizes[0] + sizes[1] + 2
    begin = np.cumsum(total) - total
    symbols = np.empty(int(total.sum()), np.int64)
    core, stop = begin + sizes[0], begin + total - 1
    symbols[:] = -1
    symbols[core], symbols[stop] = codes, np.arange(m)
    symbols[symbols < 0] = np.frombuffer(b"".join(x for p in zip(left, right, strict=True) for x in p), np.uint8).astype(np.int64) + m
    order, shared = bwt.common_at_least(symbols, m, STEP, int(total.max()))
    group = np.cumsum(~shared)
    piece = np.searchsorted(begin, order, "right") - 1
    inside = order - begin[piece]
    valid = (inside <= sizes[0][piece]) & (inside + STEP <= total[piece] - 1)
    count = np.bincount(group[valid], minlength=group[-1] + 1)
    found = valid & (count[group] > 1)
    piece, inside = piece[found], inside[found]
    return piece, high[piece] - inside


def _ranges(piece: np.ndarray, offset: np.ndarray, rid: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans (rid, start, end) of the given strings, neighbouring ones united."""
    order = np.lexsort((offset, piece))
    piece, offset = piece[order], offset[order]
    edge = np.concatenate([[True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(piece) else np.zeros(0, bool)
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(piece))[: len(first)] - 1
    p = piece[first] if len(first) else piece
    return pa.RecordBatch.from_arrays([pa.array(rid[p]), pa.array(at[p] - offset[last]), pa.array(at[p] - offset[first] + length)], names=["rid", "start", "end"])


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key to repeated spans, in blocks of whole keys."""
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> pa.RecordBatch:
        keys, rid, at, high = (table.column(c).combine_chunks() for c in ("key", "rid", "at", "high"))
        piece, offset = repeated_strings(keys.to_numpy(), table.column("left").to_pylist(), table.column("right").to_pylist(), high.to_numpy())
        known = rid.is_valid().to_numpy(zero_copy_only=False)
        keep = known[piece]
        return _ranges(piece[keep], offset[keep], rid.fill_null(-1).to_numpy(), at.to_numpy(), length)

    waiting = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        waiting += len(batch)
        if waiting * (STEP * 2 + 2) >= BLOCK_SYMBOLS:
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield settle(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                waiting = len(keys) - cut
    if waiting:
        yield settle(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to one row per string: its hash, and place."""
    for batch in batches:
        rows: list[tuple] = []
        for key, rid, at, low, high, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            base = low // STEP * STEP
            for o in range(low, high + 1):
                text = left[len(left) - (o - base) :] + b"\0" + right[: base + STEP - 1 - o]
                rows.append((int.from_bytes(hashlib.blake2b(text, digest_size=8, key=key.to_bytes(8, "little", signed=True)).digest(), "little", signed=True), o, rid, at))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["string", "o", "rid", "at"])


def repeated_spans(spark: SparkSession, rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, spans (start, end)) over all repeated strings of a written table of rows (rid, text); spans may overlap."""
    if (length - gram + 1) % STEP:
        raise ValueError("the offsets of an anchor must be a multiple of STEP")
    runs = common.materialize(spark, rows.mapInArrow(partial(_runs, length=length, gram=gram), "rid long, anchor long, content long, place long"), "runs")
    twice = common.materialize(spark, runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    thin = common.materialize(spark, runs.where(maybe("anchor", bloom(spark, twice))), "runs-again")
    common.forget(spark, runs, twice)
    contents = thin.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("x"))
    contents = common.materialize(spark, contents.select("anchor", "content", "n", "x.rid", "x.place"), "contents")

    whole = common.hot_join(thin, contents.where("n > 1").select("anchor", "content", "n"), ["anchor", "content"], "n")
    at = F.shiftright("place", 16)
    whole = whole.select("rid", (at - F.shiftright("place", 8).bitwiseAND(255)).alias("start"), (at - F.col("place").bitwiseAND(255) + length).alias("end"))

    several = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    mixed = contents.join(several, "anchor", "left_semi")
    lists = common.materialize(spark, mixed.groupBy("rid").agg(F.collect_list(F.struct("place", "anchor", (F.col("n") == 1).alias("alone"))).alias("contexts")), "contexts")
    some = rows.where(maybe("rid", bloom(spark, lists.select("rid"))))
    piece_schema = "key long, rid long, at long, low long, high long, left binary, right binary"
    pieces = common.materialize(spark, some.join(lists, "rid").select("text", "rid", "contexts").mapInArrow(partial(_cut, length=length), piece_schema), "pieces")
    sizes = common.materialize(spark, pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "piece-keys")
    usual = pieces.join(sizes.where(F.col("n") <= FREQUENT).select("key"), "key").repartition("key").sortWithinPartitions("key")
    few = usual.mapInArrow(partial(_compare, length=length), "rid long, start long, end long")

    strings = common.hot_join(pieces, sizes.where(F.col("n") > FREQUENT), ["key"], "n").select(*pieces.columns)
    strings = common.materialize(spark, strings.mapInArrow(_strings, "string long, o long, rid long, at long"), "strings")
    # a string seen in two pieces is repeated; pieces of contents that occur twice are settled above
    pairs = common.materialize(spark, strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1"), "string-pairs")
    frequent = common.hot_join(strings.where(F.col("rid").isNotNull()), pairs, ["string"], "n")
    frequent = frequent.select("rid", (F.col("at") - F.col("o")).alias("start"), (F.col("at") - F.col("o") + length).alias("end"))
    spans = whole.unionByName(few).unionByName(frequent).groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = common.materialize(spark, spans, "spans")
    common.forget(spark, thin, contents, lists, pieces, sizes, strings, pairs)
    return spans


def _finish(batches: Iterator[pa.RecordBatch], keep_bytes: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to the kept bytes and their figures."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    for batch in batches:
        out: dict[str, list] = {k: [] for k in names}
        for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode("utf-8")
            united: list[list[int]] = []
            for start, end in sorted((x["start"], x["end"]) for x in spans or ()):
                if united and start <= united[-1][1]:
                    united[-1][1] = max(end, united[-1][1])
                else:
                    united.append([start, end])
            edges = [0, *(e for span in united for e in span), len(raw)]
            rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            figures = (doc_id, len(raw), len(raw) - len(rest), len(united), hashlib.sha256(rest).hexdigest(), rest)
            for k, v in zip(names, figures, strict=False):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, types, strict=False)], names=names)


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row.

    Removes each byte covered by a string of ``length`` bytes that also starts anywhere else, same
    text included; overlapping occurrences count; strings are judged on the input.

    Null or empty texts: 0 bytes. Texts shorter than ``length`` stay whole. Null doc_id: judged and
    kept in the result. Repeated rows count as occurrences: both are removed. Empty table: no rows.
    Other columns are ignored, whatever their names. ``docs`` is read once and may be any frame.
    """
    common.small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), common.text_column(docs).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = common.materialize(spark, rows, "rows")  # the ids of a written table stay, however often it is read
    spans = repeated_spans(spark, rows.select("rid", "text"), length, gram)
    words = bloom(spark, spans.select("rid"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    touched = rows.where(maybe("rid", words)).join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(partial(_finish, keep_bytes=keep_bytes), schema)
    zero = F.lit(0).cast("long")
    others = rows.where(~maybe("rid", words)).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *[F.encode("text", "utf-8").alias("kept")] * keep_bytes)
    return touched.unionByName(others)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, common.read_table(spark, sf_dir, "documents"), keep_bytes=False)
