"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words are
lower-cased. Windows of five template words are hash-joined with the benchmark's windows; matches
that lie on one diagonal of (document position, item position) must fill the item's slots
consistently: one value of the item stands for one value of the document. That finds benchmark
questions as they are and with other numbers or names.

The benchmark's windows, and whole items that have too few literal words for one, are the build side,
sent to the tasks in blocks of a bounded size; the documents are read once a block and never
shuffled. Items of one template are one entry, whatever their number, and a template is looked at
only where one of its rarest windows is met.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charlm, common, kernels

WINDOW = 5
#: Template words of a window that are not placeholders, at least.
LITERALS = 3
#: Words of a whole item that are not placeholders, at least, for it to be found with other values.
WHOLE_LITERALS = 2
#: Share of an item's windows that a document must hold.
CONTAINMENT = 0.8
#: Benchmark windows that are sent to the tasks at once, at most.
BLOCK_WINDOWS = 1 << 21

#: Words that stand for a unit after a number.
UNITS = "mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kph hz khz mhz kb mb gb tb w kw v a".split()
NUMBER, NAME, UNIT = (kernels.mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each byte: 1 lower-case letter (all bytes above ASCII too), 2 upper-case letter, 3 digit, 0 other."""
    table = np.zeros(256, np.uint8)
    table[97:123] = table[128:] = 1
    table[65:91] = 2
    table[48:58] = 3
    return table


@lru_cache(maxsize=1)
def _stops() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in ".!?:\n"]] = True
    return table


@lru_cache(maxsize=1)
def _units() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = kernels.words(data, np.array([0, len(data)]))
    return np.sort(kernels.span_hashes(data, starts, ends))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, value hash, is placeholder, first word of each row) of the rows' words.

    A word is a run of letters or a run of digits. A number is a run of digits; a unit is a word of
    UNITS right after a number; a name is a capital and lower-case letters, not at a sentence's start.
    """
    low = kernels.lower_latin(data)
    kind = _classes()[data]
    group = (kind > 0).astype(np.int8) + (kind == 3)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = group[1:] != group[:-1]
    change |= edge
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    solid = group[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    first = np.searchsorted(starts, offsets)
    value = kernels.span_hashes(low, starts, ends)
    number = kind[starts] == 3
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    stops = np.concatenate([[0], np.cumsum(_stops()[data])])
    previous = np.concatenate([[0], ends[:-1]]) if len(starts) else ends
    opening = np.zeros(len(starts), bool)
    opening[first[:-1][first[:-1] < len(starts)]] = True
    opening |= stops[starts] > stops[previous]
    name = (kind[starts] == 2) & (upper[ends] - upper[starts] == 1) & (ends - starts > 1) & ~opening
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1]
    after[first[:-1][first[:-1] < len(starts)]] = False
    unit = after & np.isin(value, _units())
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return template, value, number | name | unit, first


@dataclass
class Windows:
    hash: np.ndarray
    start: np.ndarray  # first word, in the rows' joined words
    row: np.ndarray


def windows_of(template: np.ndarray, slot: np.ndarray, first: np.ndarray) -> Windows:
    """Windows of WINDOW template words within a row that hold LITERALS words; shorter rows are one window."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    literal = np.concatenate([[0], np.cumsum(~slot)])
    start = np.arange(max(0, len(template) - WINDOW + 1))
    keep = (row[: len(start)] == row[WINDOW - 1 :] if len(start) else np.zeros(0, bool)) & (literal[start + WINDOW] - literal[start] >= LITERALS if len(start) else np.zeros(0, bool))
    grams = kernels.windows(template, WINDOW)
    hashes, starts, rows = [grams[keep]], [start[keep]], [row[: len(start)][keep]]
    for r in np.flatnonzero((counts > 0) & (counts < WINDOW)):
        a, b = first[r], first[r + 1]
        if literal[b] - literal[a] >= min(LITERALS, b - a):
            hashes.append(kernels.mix(kernels._fold(template[a:b])))
            starts.append(np.array([a]))
            rows.append(np.array([r]))
    return Windows(np.concatenate(hashes), np.concatenate(starts), np.concatenate(rows))


def whole_windows(words: np.ndarray, first: np.ndarray, size: int, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and row of each run of ``size`` words within a row, in time linear in the words; of whole rows only if ``alone``."""
    counts = np.diff(first)
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    up, down = kernels.powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    start = np.arange(len(words) - size + 1)
    row, last = row[: len(start)], row[size - 1 :]
    keep = np.flatnonzero((row == last) & ((counts[row] == size) if alone else True))
    return kernels.mix((total[size:] - total[:-size])[keep] * down[keep]), keep, row[keep]


def _expand(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions low[k]..low[k] + count[k] - 1 in turn, and the k of each."""
    own = np.repeat(np.arange(len(low)), count)
    return low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count), own


@dataclass
class Template:
    """Items of one template whose slots are equal to each other in the same way: they differ in slot values only."""

    slots: np.ndarray  # positions of the placeholders
    pattern: np.ndarray  # for each slot, the first slot of the same value
    values: np.ndarray  # item x slot
    ids: list[int]
    hash: np.ndarray  # the windows, sorted by hash
    start: np.ndarray
    rank: np.ndarray  # of each window, the number of its distinct hash

    @property
    def total(self) -> int:
        return int(self.rank[-1]) + 1 if len(self.rank) else 0

    def judge(self, hashes: np.ndarray, starts: np.ndarray, value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
        """Share of the distinct windows that a row's windows hold on consistent diagonals, and the items with other values there."""
        low, high = np.searchsorted(self.hash, hashes, "left"), np.searchsorted(self.hash, hashes, "right")
        at, own = _expand(low, high - low)
        shift = starts[own] - self.start[at]
        order = np.argsort(shift, kind="stable")
        at, shift = at[order], shift[order]
        edges = np.flatnonzero(np.concatenate([[True], shift[1:] != shift[:-1], [True]]))
        covered, changed = np.zeros(self.total, bool), np.zeros(len(self.ids), bool)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            words = np.unique((self.start[at[a:b]][:, None] + np.arange(size)).ravel())
            held = np.flatnonzero(np.isin(self.slots, words, assume_unique=True))
            there = value[self.slots[held] + shift[a]]
            if len(set(zip(self.pattern[held].tolist(), there.tolist(), strict=True))) == len(set(self.pattern[held].tolist())):
                covered[self.rank[at[a:b]]] = True
                changed |= (self.values[:, held] != there).any(1)
        return covered.sum() / max(1, self.total), changed


@dataclass
class Block:
    """The windows of some templates in sorted arrays, and the whole templates that have no window."""

    templates: list[Template]
    hashes: np.ndarray  # all windows, distinct
    bounds: np.ndarray  # of each window, its entries in owners
    owners: np.ndarray  # templates that have to be looked at when the window is met
    loose: dict[tuple[int, bool], tuple[np.ndarray, list[list[int]]]]  # (words, alone) -> template hashes, templates
    exact: dict[tuple[int, bool], tuple[np.ndarray, list[list[tuple[int, int]]]]]  # (words, alone) -> value hashes, (template, item)


def build_block(items: list[tuple[int, str]], containment: float = CONTAINMENT) -> Block:
    """Index of items (id, text).

    An item of n windows is held if m = ceil(containment * n) of them are, so any n - m + 1 of its
    windows meet every row that holds it: only the rarest ones name the template as a candidate.
    """
    grouped: dict[tuple, list[tuple[int, np.ndarray]]] = defaultdict(list)
    shapes: dict[tuple, tuple] = {}
    for item, text in items:
        data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
        template, value, slot, first = tokens_of(data, np.array([0, len(data)]))
        slots = np.flatnonzero(slot)
        _, where, same = np.unique(value[slots], return_index=True, return_inverse=True)
        key = (template.tobytes(), slot.tobytes(), where[same].tobytes())
        grouped[key].append((item, value))
        shapes.setdefault(key, (template, slot, slots, where[same], first))
    templates: list[Template] = []
    loose: dict[tuple[int, bool], dict[int, list]] = defaultdict(lambda: defaultdict(list))
    exact: dict[tuple[int, bool], dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for key, members in grouped.items():
        template, slot, slots, pattern, first = shapes[key]
        found = windows_of(template, slot, first)
        order = np.lexsort((found.start, found.hash))
        distinct = np.cumsum(np.concatenate([[False], found.hash[order][1:] != found.hash[order][:-1]])) if len(order) else np.zeros(0, np.int64)
        k = len(templates)
        templates.append(Template(slots, pattern, np.stack([v[slots] for _, v in members]), [i for i, _ in members], found.hash[order], found.start[order], distinct))
        n, literals = len(template), int((~slot).sum())
        if n and (not len(found.hash) or (n < WINDOW and slot.any())):
            alone = not literals and n < WINDOW
            if literals >= WHOLE_LITERALS:
                loose[(n, alone)][int(whole_windows(template, first, n, alone)[0][0])].append(k)
            else:
                for m, (_, value) in enumerate(members):
                    exact[(n, alone)][int(whole_windows(value, first, n, alone)[0][0])].append((k, m))
    every, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(t.hash) for t in templates]]), return_counts=True)
    window, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, t in enumerate(templates):
        own = np.searchsorted(every, np.unique(t.hash))
        need = t.total - math.ceil(containment * t.total - 1e-9) + 1
        window.append(own[np.lexsort((own, count[own]))][:need] if t.total else own)
        owner.append(np.full(len(window[-1]), k))
    windows, owners = np.concatenate(window), np.concatenate(owner)
    order = np.argsort(windows, kind="stable")
    table = lambda held: {key: (np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for key, x in held.items()}
    return Block(templates, every, np.searchsorted(windows[order], np.arange(len(every) + 1)), owners[order], table(loose), table(exact))


def matches(block: Block, data: np.ndarray, offsets: np.ndarray, containment: float) -> dict[int, list[tuple[int, float, bool]]]:
    """row -> (item, contained share, with other slot values) for the items that a row holds."""
    template, value, slot, first = tokens_of(data, offsets)
    found = windows_of(template, slot, first)
    out: dict[int, list[tuple[int, float, bool]]] = defaultdict(list)
    at, there = charlm.find(block.hashes, found.hash)
    hit = np.flatnonzero(there)
    if len(hit):
        hit = hit[np.argsort(found.row[hit], kind="stable")]
        row, start, hashes, at = found.row[hit], found.start[hit], found.hash[hit], at[hit]
        entry, own = _expand(block.bounds[at], np.diff(block.bounds)[at])
        many = len(block.templates)
        for pair in np.unique(row[own] * many + block.owners[entry]).tolist():
            r, k = divmod(pair, many)
            lo, hi = np.searchsorted(row, [r, r + 1])
            t = block.templates[k]
            # texts shorter than a window are one window as a whole
            share, changed = t.judge(hashes[lo:hi], start[lo:hi], value, min(WINDOW, int(first[r + 1] - first[r])))
            if share >= containment - 1e-12:
                out[r] += [(i, float(share), c) for i, c in zip(t.ids, changed.tolist(), strict=True)]
    whole: dict[tuple[int, int], np.ndarray] = {}
    for (size, alone), (hashes, texts) in block.loose.items():
        grams, starts, rows = whole_windows(template, first, size, alone)
        at, there = charlm.find(hashes, grams)
        for w in np.flatnonzero(there):
            for k in texts[at[w]]:
                t = block.templates[k]
                held = value[starts[w] + t.slots]
                if (held == held[t.pattern]).all():  # each value of the item stands for one value
                    key = (int(rows[w]), k)
                    other = (t.values != held).any(1)
                    whole[key] = whole[key] & other if key in whole else other
    for (r, k), changed in whole.items():
        out[r] += [(i, 1.0, c) for i, c in zip(block.templates[k].ids, changed.tolist(), strict=True)]
    for (size, alone), (hashes, texts) in block.exact.items():
        grams, _, rows = whole_windows(value, first, size, alone)
        at, there = charlm.find(hashes, grams)
        for r, j in set(zip(rows[there].tolist(), at[there].tolist(), strict=True)):
            out[r] += [(block.templates[k].ids[m], 1.0, False) for k, m in texts[j]]
    return out


def best_of(found: list[tuple[int, float, bool]]) -> list[dict]:
    """One entry per item_id, in its order: the text of largest share, of equal ones the unchanged."""
    best = {}
    for item, share, changed in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        best.setdefault(item, {"item_id": item, "containment": share, "changed": changed})
    return list(best.values())


FOUND = "array<struct<item_id:long,containment:double,changed:boolean>>"


def _finder(block, containment: float):
    """Texts to FOUND; only the texts go to Python and only findings come back."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64()), ("changed", pa.bool_())]))

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        found: list[list[dict]] = [[]] * len(texts)
        for a, _, data, offsets in kernels.pieces(texts):
            for row, items in matches(block.value, data, offsets, containment).items():
                found[a + row] = best_of(items)
        return pa.array(found, kind)

    return find.asNondeterministic()  # evaluated once a row, wherever the plan uses it


def find_items(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, block_windows: int = BLOCK_WINDOWS, name: str = "found") -> DataFrame:
    """Every row and column of ``docs`` plus ``name``: the benchmark items it holds, by item_id.

    An item's entry has item_id, containment (share of its distinct windows found on consistent
    diagonals, at least the threshold) and changed (slot values differ from the item's).

    An item without a window of LITERALS words is searched as a whole: by its template, or by its
    values where it has fewer than WHOLE_LITERALS words that are not placeholders. Null or empty
    texts hold nothing; items without words are never found. An item shorter than five words is
    one window, found in texts as short, and as a whole in longer ones if it has a placeholder and
    another word. Null item_id: not searched. Repeated
    items of one id are searched apart and reported under their id, once, by the text of largest share. Rows that share a doc_id are
    judged apart; null doc_id is kept. Empty tables give no rows or no findings. All columns of
    ``docs`` stay as they are, but one named ``name`` is replaced.
    """
    common.small_batches(spark)
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), common.text_column(benchmark).alias("text")).distinct()
    items = common.materialize(spark, items, "items")
    # a text of n characters has fewer than n windows: blocks of a bounded size, one pass over the texts each
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-chars // block_windows))
    text = common.text_column(docs)
    out = docs.drop(name)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        block = spark.sparkContext.broadcast(build_block(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), containment))
        got = _finder(block, containment)(text)
        if not k:
            out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()], got.alias(name))
            continue
        more = common.fresh(out, "more")
        # a written table between two blocks: one block in a task's memory at a time
        out = common.materialize(spark, out, "found")
        text = common.text_column(out)
        got = _finder(block, containment)(text)
        both = F.array_sort(F.concat(F.transform(name, _ranked), F.transform(more, _ranked)))
        first = F.filter(both, lambda x, i: (i == 0) | (x["item_id"] != F.get(both, i - 1)["item_id"]))
        out = out.withColumn(more, got).withColumn(name, first).withColumn(name, F.transform(name, lambda x: F.struct(x["item_id"].alias("item_id"), (-x["minus"]).alias("containment"), x["changed"].alias("changed")))).drop(more)
    return out


def _ranked(x):
    return F.struct(x["item_id"].alias("item_id"), (-x["containment"]).alias("minus"), x["changed"].alias("changed"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find_items(spark, docs, common.read_table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.transform("found", lambda x: x["item_id"]).alias("item_ids"), F.size("found").cast("long").alias("n_items"), F.exists("found", lambda x: x["changed"]).alias("changed"))
