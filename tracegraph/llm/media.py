"""Media columns: audio payloads and their log-mel features as fixed-shape Arrow tensors.

A row's bytes are held as 8-bit PCM samples in a WAV container. Features: polyphase resampling by
a windowed-sinc low-pass, overlapped Hann frames, a mel filterbank in log energy, and segments of
the frame energy by hysteresis (a segment opens above a high threshold and closes below a low one).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE, UP, DOWN = 8000, 3, 4
FRAME, HOP, MELS, TENSOR_FRAMES = 256, 128, 20, 16
TAPS = 24
#: Frames that are transformed at once: a long text takes no more memory for its spectrum than this many.
FRAME_RUN = 4096
SCHEMA = "n_bytes long, payload_bytes long, media binary, payload binary, frames long, n_tensors long, tensors binary, spans array<struct<start_s:double,end_s:double>>, feature string"


def wav_of(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM WAV file whose samples are the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def payload_of(wav: bytes) -> bytes:
    """The samples of such a file, read by walking its chunks."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(wav):
        name, size = struct.unpack_from("<4sI", wav, at)
        if name == b"data":
            return wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def polyphase_bank(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """The low-pass filter's phases, one row each: row p holds the filter's taps p, p + up, ..."""
    n = taps * max(up, down)
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hanning(n) * up
    return np.pad(h, (0, -n % up)).reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase rational resampling; output k is phase (k * down) mod up of the filter bank."""
    bank = polyphase_bank(up, down)
    taps = bank.shape[1]
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    count = -(-len(x) * up // down)
    out = np.zeros(count, np.float32)
    for phase in range(up):
        k = np.flatnonzero((np.arange(min(up, count)) * down) % up == phase)
        if len(k):
            ks = np.arange(int(k[0]), count, up)
            at = ks * down // up
            acc = np.zeros(len(ks), np.float32)
            for j in range(taps):
                acc += bank[phase, j] * padded[at + taps - 1 - j]
            out[ks] = acc
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale from 0 to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins[None] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    fall = (hz[2:, None] - bins[None]) / (hz[2:] - hz[1:-1])[:, None]
    return np.ascontiguousarray(np.clip(np.minimum(rise, fall), 0, None).T)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n x MELS) of a signal and each frame's log energy; the last frame is padded.

    Computed in double precision and rounded, so that equal signals give equal values on any worker.
    """
    count = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, max(0, (count - 1) * HOP + FRAME - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:count]
    window, bank = np.hanning(FRAME), mel_bank(rate, FRAME, MELS)
    mel, energy = np.zeros((count, MELS), np.float32), np.zeros(count)
    for a in range(0, count, FRAME_RUN):
        run = frames[a : a + FRAME_RUN] * window
        half = np.fft.rfft(run, axis=1)
        mel[a : a + FRAME_RUN] = np.round(np.log((half.real**2 + half.imag**2) @ bank + 1e-6), 4)
        energy[a : a + FRAME_RUN] = np.round(np.log((run**2).mean(1) + 1e-8), 6)
    return mel, energy


def hysteresis(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames at or above ``low`` that reach ``high`` somewhere, as [start, end)."""
    on = energy >= low
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if (energy[a:b] >= high).any()]


def tensor_stream(mel: np.ndarray) -> tuple[bytes, int]:
    """Frames cut into fixed-shape tensors (TENSOR_FRAMES x MELS, the last one zero-padded), as an Arrow IPC stream."""
    count = max(1, -(-len(mel) // TENSOR_FRAMES))
    held = np.zeros((count, TENSOR_FRAMES, MELS), np.float32)
    held.reshape(-1, MELS)[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(held)
    batch = pa.record_batch({"log_mel": column})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes(), count


def features(payload: bytes) -> dict:
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    rate = RATE * UP // DOWN
    mel, energy = log_mel(y, rate)
    mean, spread = float(energy.mean()), float(energy.std())
    spans = hysteresis(energy, mean + 0.5 * spread, mean - 0.5 * spread)
    tensors, count = tensor_stream(mel)
    summary = ";".join(["%.2f" % v for v in mel.mean(0)] + [f"frames={len(mel)}", f"spans={len(spans)}"])
    return {"frames": len(mel), "n_tensors": count, "tensors": tensors, "spans": [(a * HOP / rate, ((b - 1) * HOP + FRAME) / rate) for a, b in spans], "feature": summary}


def _encode(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    span_type = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    types = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "media": pa.binary(), "payload": pa.binary(), "frames": pa.int64(), "n_tensors": pa.int64(), "tensors": pa.binary(), "spans": span_type, "feature": pa.string()}
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            rows: dict[str, list] = {k: [] for k in types}
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8")
                padded = raw + bytes(-len(raw) % 64 if raw else 64)
                media = wav_of(padded)
                back = payload_of(media)
                got = features(back)
                got["spans"] = [{"start_s": a, "end_s": b} for a, b in got["spans"]]
                for k, v in ({"n_bytes": len(raw), "payload_bytes": len(back), "media": media, "payload": back} | got).items():
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(rows[k], types[k]) for k in types if k in keep], names=["doc_id", *[k for k in types if k in keep]])


def audio_columns(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ("n_bytes", "payload_bytes", "media", "payload", "frames", "n_tensors", "tensors", "spans", "feature")) -> DataFrame:
    """Every text's bytes as a WAV file, the payload read back from it, and its features.

    Columns: doc_id and those of ``keep``: n_bytes, payload_bytes, media (the file), payload (read
    back), frames, n_tensors, tensors (an Arrow IPC stream of fixed-shape log-mel tensors), spans
    (seconds of the resampled signal), feature (mean log-mel bands, frame and span counts).

    Bytes are padded with 0 to a positive multiple of 64. Null or empty text: 64 zero bytes. Rows
    are independent: repeated rows and ties give equal values, an empty table no rows, null doc_id
    is kept, other columns are ignored, whatever their names.
    """
    common.small_batches(spark, 256)
    kinds = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return rows.mapInArrow(partial(_encode, keep=keep), ", ".join(["doc_id long", *[f"{k} {v}" for k, v in kinds.items() if k in keep]]))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audio_columns(spark, common.read_table(spark, sf_dir, "documents"), ("n_bytes", "payload_bytes", "media", "payload", "frames", "n_tensors", "tensors", "spans", "feature"))
    return rows.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "frames",
        "n_tensors",
        "tensors",
        "spans",
    )


