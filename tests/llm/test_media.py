"""Audio features against plain formulas: resampling, log-mel frames, hysteresis, tensors and time spans."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracegraph.llm import media


@pytest.mark.parametrize("up,down", [(1, 1), (1, 2), (3, 4), (5, 3)])
def test_resample_is_the_direct_sum(up, down):
    """Insert zeros, filter, keep every down-th sample."""
    x = np.random.default_rng(up).normal(size=97)
    n = media.TAPS * max(up, down)
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hanning(n) * up
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    want = np.convolve(spread, h)[: len(spread)][::down]
    got = media.resample(x.astype(np.float32), up, down)
    assert len(got) == -(-len(x) * up // down) and got == pytest.approx(want, abs=1e-4)


def test_log_mel_is_the_plain_formula(monkeypatch):
    x, rate = np.random.default_rng(2).normal(size=1000).astype(np.float32), 6000
    mel, energy = media.log_mel(x, rate)
    frames = max(1, math.ceil((len(x) - media.FRAME) / media.HOP) + 1)
    assert mel.shape == (frames, media.MELS) and energy.shape == (frames,)
    to_mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (to_mel(rate / 2) * k / (media.MELS + 1) / 2595) - 1) for k in range(media.MELS + 2)]
    for f in (0, 3, frames - 1):
        part = [x[f * media.HOP + k] * (0.5 - 0.5 * math.cos(2 * math.pi * k / (media.FRAME - 1))) if f * media.HOP + k < len(x) else 0.0 for k in range(media.FRAME)]
        power = [abs(sum(v * np.exp(-2j * np.pi * b * np.arange(media.FRAME)[k] / media.FRAME) for k, v in enumerate(part))) ** 2 for b in range(media.FRAME // 2 + 1)]
        for m in (0, 7, media.MELS - 1):
            total = 0.0
            for b, p in enumerate(power):
                hz = b * rate / media.FRAME
                total += p * max(0.0, min((hz - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - hz) / (edges[m + 2] - edges[m + 1])))
            assert mel[f, m] == pytest.approx(math.log(total + 1e-6), abs=1e-3)
        assert energy[f] == pytest.approx(math.log(sum(v * v for v in part) / media.FRAME + 1e-8), abs=1e-3)
    monkeypatch.setattr(media, "FRAME_RUN", 3)
    again = media.log_mel(x, rate)
    assert again[0] == pytest.approx(mel, abs=1e-5) and again[1] == pytest.approx(energy, abs=1e-5)


def test_hysteresis_is_the_state_machine():
    rng = np.random.default_rng(5)
    for _ in range(50):
        energy = rng.normal(size=40).round(1)
        want, begin, loud = [], None, False
        for k, e in enumerate([*energy, -np.inf]):
            if e >= -0.5:
                begin, loud = (k, e >= 0.5) if begin is None else (begin, loud or e >= 0.5)
            elif begin is not None:
                want += [(begin, k)] * int(loud)
                begin = None
        assert media.hysteresis(energy, 0.5, -0.5) == want


def test_columns_of_the_query(spark, tmp_path):
    texts = ["", None, "a", "é" * 40, "river stone " * 3000, "x" * 64, "river stone " * 3000]
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in enumerate(texts)], "doc_id long, text string, media int, feature string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op7_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        raw, r = (t or "").encode(), got[k]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_sha256 == hashlib.sha256(media.wav_of(padded)).hexdigest() and r.media_bytes == len(media.wav_of(padded))
        rate = media.RATE * media.UP // media.DOWN
        y = media.resample((np.frombuffer(padded, np.uint8).astype(np.float32) - 128) / 128)
        mel, energy = media.log_mel(y, rate)
        held = pa.ipc.open_stream(bytes(r.tensors)).read_all().column(0).combine_chunks()
        assert isinstance(held.type, pa.FixedShapeTensorType) and held.type.shape == [media.TENSOR_FRAMES, media.MELS]
        flat = held.to_numpy_ndarray().reshape(-1, media.MELS)
        assert len(held) == r.n_tensors and (flat[: len(mel)] == mel).all() and not flat[len(mel) :].any()
        mean, spread = float(energy.mean()), float(energy.std())
        runs = media.hysteresis(energy, mean + 0.5 * spread, mean - 0.5 * spread)
        assert [(s.start_s, s.end_s) for s in r.spans] == [(a * media.HOP / rate, ((b - 1) * media.HOP + media.FRAME) / rate) for a, b in runs]
    assert tuple(got[4])[1:] == tuple(got[6])[1:]  # equal texts, equal values
