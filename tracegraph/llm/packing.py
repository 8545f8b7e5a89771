"""Vector bin packing of examples into fixed-length training sequences.

Dot-product heuristic: the open sequence takes, among the waiting examples that fit, the one whose
demand vector (tokens, segments, loss-bearing tokens) has the largest dot product with the room
that is left, each dimension weighted by its mean demand. What no whole example fits is filled by
cutting one, so that sequences end full. Each task packs its own rows in order, in bounded windows:
there is no shuffle, and a retried task repeats its result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEQUENCE = 1024
SEGMENTS = 64
#: Loss-bearing tokens of a sequence in the registered query, at most: as many as it holds, so that the limit costs no
#: padding where documents have no prompt of their own. Their first words count as the prompt.
LOSS, PROMPT_WORDS = SEQUENCE, 16
WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """An encoder with the vocabulary of the tokenizers file ``path`` (byte-level BPE, ids in merge order).

    ``tokens_of`` gives the same ids as ``tokenizers`` with add_special_tokens=False, at four times the speed.
    """
    import json

    import public_tokenizers
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take in white space or need word borders are not supported")
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tokens_of(encoder, text: str) -> list[int]:
    """The ids of a text; the file's added tokens in it are cut out first and stand for themselves."""
    return encoder.encode(text, allowed_special="all")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Packer:
    """Open-sequence state of one task. Capacities: tokens, segments, loss-bearing tokens.

    An example is (ids, prompt): all ids from number ``prompt`` on bear loss, but for the last one.
    """

    def __init__(self, size: int, segments: int, loss: int):
        self.capacity = np.array([size, segments, loss], np.float64)
        self.size, self.sequence = size, 0
        self.free = self.capacity.copy()
        self.placed: list[tuple[int, int, int, int, int]] = []  # (example, start, length, sequence, offset)

    def close(self) -> None:
        self.sequence += 1
        self.free = self.capacity.copy()

    def put(self, example: int, start: int, length: int, loss: int) -> None:
        self.placed.append((example, start, length, self.sequence, int(self.size - self.free[0])))
        self.free -= (length, 1, loss)

    def room(self, left: int, start: int, prompt: int) -> int:
        """Ids of the rest of an example that the open sequence can take."""
        take = int(min(left, self.free[0], max(0, prompt - start) + self.free[2]))
        return take + (take == left - 1 and take < self.free[0])  # the last id bears no loss

    def pack(self, total: np.ndarray, prompt: np.ndarray) -> None:
        """Place every example: whole sequences of long ones directly, the rest by the heuristic, cut where no whole one fits."""
        total, prompt = total.astype(np.int64), np.minimum(prompt.astype(np.int64), total.astype(np.int64) - 1)
        start = np.zeros(len(total), np.int64)
        bearing = lambda k, n: int(max(0, min(start[k] + n, total[k] - 1) - max(start[k], prompt[k])))
        if self.free[0] < self.size:
            self.close()
        for k in np.flatnonzero(total >= self.size):
            while total[k] - start[k] >= self.size:
                take = self.room(int(total[k] - start[k]), int(start[k]), int(prompt[k]))
                self.put(int(k), int(start[k]), take, bearing(k, take))
                self.close()
                start[k] += take
        left, losses = total - start, np.maximum(0, total - 1 - np.maximum(start, prompt))
        waiting = left > 0
        while waiting.any():
            if self.free.min() < 1:
                self.close()
            at = np.flatnonzero(waiting)
            demand = np.stack([left[at], np.ones(len(at)), losses[at]], 1) / self.capacity
            weight = demand.mean(0)
            fits = (demand * self.capacity <= self.free).all(1)
            value = (demand * (weight * self.free / self.capacity)).sum(1)
            if fits.any():
                best = at[np.flatnonzero(fits)[np.argmax(value[fits])]]
                length = int(left[best])
            else:
                best = at[np.argmax(value)]
                length = self.room(int(left[best]), int(start[best]), int(prompt[best]))
            self.put(int(best), int(start[best]), length, bearing(best, length))
            start[best] += length
            left[best] = total[best] - start[best]
            losses[best] = max(0, total[best] - 1 - max(start[best], prompt[best]))
            waiting[best] = left[best] > 0


def _tail(pieces: list[tuple]) -> list[tuple]:
    """Cut the pieces of a last, underfull sequence at the powers of two of its length: no padding there."""
    rest = sum(n for _, _, n, _, _ in pieces)
    out, used, room = [], 0, 1 << max(0, rest.bit_length() - 1)
    sequence = pieces[0][3] if pieces else 0
    for example, start, length, _, _ in pieces:
        while length:
            take = min(length, room - used)
            out.append((example, start, take, sequence, used))
            start, length, used, rest = start + take, length - take, used + take, rest - take
            if used == room and rest:
                sequence, used, room = sequence + 1, 0, 1 << (rest.bit_length() - 1)
    return out


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, size: int, segments: int, loss: int, window: int) -> Iterator[pa.RecordBatch]:
    encoder, packer = tokenizer(path), Packer(size, segments, loss)
    base = TaskContext.get().partitionId() << 40
    names = [x.split()[0] for x in PIECES.split(", ")]
    waiting: list[tuple] = []  # (doc_id, ids, ids of the prompt)
    opened: list[tuple] = []  # pieces of the open sequence

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        rows = [(key, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), base + q, o) for (key, ids), s, n, q, o in pieces]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

    def flush() -> pa.RecordBatch:
        nonlocal opened
        packer.pack(np.array([len(x[1]) for x in waiting], np.int64), np.array([x[2] for x in waiting], np.int64))
        pieces = opened + [(waiting[e][:2], s, n, q, o) for e, s, n, q, o in packer.placed]
        packer.placed.clear()
        waiting.clear()
        opened = [p for p in pieces if p[3] == packer.sequence]
        return batch_of([p for p in pieces if p[3] != packer.sequence])

    for batch in batches:
        for key, text, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.array([*tokens_of(encoder, text), 0], dtype="<u4")
            waiting.append((key, ids, len(tokens_of(encoder, prompt)) if prompt else 0))
            if len(waiting) >= window:
                yield flush()
    yield flush()
    yield batch_of(opened if packer.free[0] == 0 else _tail(opened))


def pack_documents(spark: SparkSession, docs: DataFrame, *, tokenizer_path: str | None = None, size: int = SEQUENCE, segments: int = SEGMENTS, loss_tokens: int | None = None, window: int = WINDOW, prompt: str | None = None) -> DataFrame:
    """Pack every document's ids (its text's, then id 0) into sequences of at most ``size`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Limits hold together: tokens, ``segments`` pieces and ``loss_tokens`` loss-bearing tokens a
    sequence. Loss-bearing are all ids but the closing 0 and the first ids that stand for
    the text of column ``prompt``, where one is named.

    Null text: empty, one id. Null doc_id: packed, its pieces carry null. Repeated rows: each is
    packed. Empty table: no rows. Ties take the earlier example. Other columns are ignored.
    """
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"), (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("prompt"))
    run = partial(_pack_batches, path=tokenizer_path or default_tokenizer(), size=size, segments=segments, loss=loss_tokens or size, window=window)
    return rows.mapInArrow(run, PIECES)


def with_prompt(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus the column ``name``: the first PROMPT_WORDS words of a text, which bear no loss."""
    return docs.withColumn(name, F.regexp_extract(common.text_column(docs), rf"^\s*(\S+\s+){{0,{PROMPT_WORDS - 1}}}\S*", 0))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(spark, with_prompt(docs, "prompt"), prompt="prompt", loss_tokens=LOSS)
