"""Operators against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.llm import bwt, decontaminate, language, media, neardup, packing, quality, secrets, substrings, toxicity

WORDS = "river stone under cloud bright walk seven garden paper table window silent early orange motion winter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (60, 80, 120, 40, 300)]
    near = base[2].split()
    near[50] = "changed"
    shared = prose(rng, 60)
    out = [*base, base[0], base[0], " ".join(near), "", None, "two words", f"{prose(rng, 20)} {shared} {prose(rng, 20)}", f"{prose(rng, 9)} {shared}", "é" * 150 + "x" * 450, 'password = "hunter2hunter2" and token: short', "AKIA" + "Q" * 16 + " é " + "0123456789abcdef" * 2, prose(rng, 3000)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 7) for i, t in texts], "doc_id long, text string, lang string, found string, spans int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, found string, spans int")


def test_secrets(spark, docs, texts):
    found, ledger = secrets.scan_versions(docs)
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    for i, t in texts:
        t = t or ""
        want = [(m.start(), 0, "assign", m.end()) for m in rule.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert got[i] == [(k, a, b) for a, _, k, b in sorted(want)]
    _, nothing = secrets.scan_versions(docs, ledger=ledger)
    assert nothing.count() == 0  # every blob and rule version is known
    newer = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{32,}", 0, 32, version=2))
    again, fresh = secrets.scan_versions(docs, rules=newer, ledger=ledger)
    assert {tuple(r.rules) for r in fresh.select("rules").distinct().collect()} == {("hex@2",)}
    assert {r.doc_id: len(r.spans) for r in again.collect()} == {i: len(x) for i, x in got.items()}
    assert secrets.scan_versions(empty(spark))[0].count() == 0
    parts, ledger = secrets.scan_deliveries(spark, docs.union(docs), deliveries=3)
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in parts.collect()} == got and parts.count() == 2 * len(texts)
    assert ledger.count() == ledger.select("blob").distinct().count() == len({t or "" for _, t in texts})  # no blob is scanned twice
    named, _ = secrets.scan_versions(docs, columns=("address", "hits"))
    assert named.columns == [*docs.columns, "address", "hits"] and {r.spans for r in named.collect()} == {7}
    clean = found.select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).where("doc_id = 15").first().t
    assert clean == "[access] é [hex]"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark, docs, texts):
    got = {r.doc_id: r for r in neardup.near_duplicates(spark, docs).collect()}
    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}
    for _ in sets:
        for i, x in sets.items():
            for j, y in sets.items():
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert neardup.near_duplicates(spark, empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_large_bucket(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(200), rng.choice([0, 1, 2, 3, 6, 12])):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(6):
        for i, x in sets.items():
            for j, y in sets.items():
                if 100 * len(x & y) >= 85 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    assert got == label


def brute_repeats(texts, length):
    raw = {i: (t or "").encode() for i, t in texts}
    seen = {}
    for b in raw.values():
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = {}
    for i, b in raw.items():
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[i] = (len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [4096, 1])
def test_repeats(spark, docs, texts, frequent, monkeypatch):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(spark, docs).collect()}
    assert got == brute_repeats(texts, 200)
    again = substrings.remove_repeats(spark, docs.repartition(3).join(docs.select("doc_id"), "doc_id").repartition(5))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in again.collect()} == got
    for r in again.where("kept is not null").collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert substrings.remove_repeats(spark, empty(spark)).count() == 0


def test_bwt():
    rng = np.random.default_rng(3)
    for _ in range(30):
        parts = [rng.integers(0, 2, rng.integers(1, 30)) for _ in range(4)]
        symbols = np.concatenate([x for k, p in enumerate(parts) for x in (p + 4, [k])])
        order, shared = bwt.common_at_least(symbols, 4, 5, 40)
        suffixes = [tuple(symbols[k:]) for k in range(len(symbols))]
        assert [suffixes[k] for k in order] == sorted(suffixes)
        for k in range(1, len(order)):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert shared[k] == (a[:5] == b[:5] and len(a) >= 5 and len(b) >= 5)


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.default_tokenizer())
    reference.encode_special_tokens = True
    rows = packing.pack_documents(spark, docs, segments=4, window=5).collect()
    for i, t in texts:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for q in {r.sequence_id for r in rows}:
        inside = sorted((r for r in rows if r.sequence_id == q), key=lambda r: r.offset)
        assert [r.offset for r in inside] == [sum(x.length for x in inside[:k]) for k in range(len(inside))]
        assert sum(r.length for r in inside) <= 1024 and len(inside) <= 4
    assert packing.pack_documents(spark, empty(spark)).count() == 0


def test_media(spark, docs, texts):
    import pyarrow as pa

    for r in media.audio_columns(spark, docs).collect():
        raw = (dict(texts)[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert bytes(r.payload) == padded == media.payload_of(bytes(r.media)) and r.n_bytes == len(raw)
        held = pa.ipc.open_stream(bytes(r.tensors)).read_all().column(0).combine_chunks()
        assert held.to_numpy_ndarray().shape == (r.n_tensors, media.TENSOR_FRAMES, media.MELS)
        assert all(s.start_s < s.end_s for s in r.spans)
    assert media.audio_columns(spark, empty(spark)).count() == 0


def test_resample_keeps_low_tones():
    t = np.arange(4000)
    y = media.resample(np.sin(2 * np.pi * t / 80).astype(np.float32), 1, 2)
    assert len(y) == 2000 and abs(np.abs(np.fft.rfft(y)).argmax() - 50) <= 1


def test_decontamination(spark, docs):
    question = "A train leaves the old station at 60 km per hour and reaches Paris after 3 hours of steady travel"
    item = spark.createDataFrame([(1, question), (2, None), (3, "")], "item_id long, text string")
    other = question.replace("60", "85").replace("Paris", "London").replace("3 hours", "4 hours")
    torn = " ".join(question.split()[:9])
    extra = spark.createDataFrame([(100, f"Some words. {question}. More words."), (101, f"Some words. {other}. More"), (102, torn), (103, question.upper())], "doc_id long, text string")
    got = {r.doc_id: [(x.item_id, x.changed) for x in r.found] for r in decontaminate.find_items(spark, docs.select("doc_id", "text").union(extra), item).collect()}
    assert got[100] == [(1, False)] and got[101] == [(1, True)] and got[102] == []
    assert all(not x for i, x in got.items() if i < 100)
    assert decontaminate.find_items(spark, empty(spark), item).count() == 0


def labelled(spark, good, bad, n=240):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + (" " + rng.choice(bad) + " " + rng.choice(bad) if i % 3 == 0 else " " + rng.choice(good)), int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, toxic int, quality int"), {i: y for i, _, y in rows}


def test_classifiers(spark):
    docs, labels, truth = labelled(spark, ["pleasant", "useful"], ["grumbler", "grumbling"])
    extra = spark.createDataFrame([(1000, None), (None, "river stone")], "doc_id long, text string")
    for run, want in ((toxicity.score_documents, truth), (quality.classify, {i: 1 - y for i, y in truth.items()})):
        got = run(spark, docs.union(extra), labels).collect()
        assert len(got) == 242 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
        assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.9
    assert toxicity.score_documents(spark, docs.limit(0), labels.limit(0)).count() == 0
    assert quality.classify(spark, docs, labels.limit(0)).count() == 240


def test_language(spark):
    rng = random.Random(1)
    german = "und der die nicht schule wasser fenster garten himmel strasse abend morgen".split()
    rows = [(i, prose(rng, 20), "en") if i % 2 else (i, " ".join(rng.choice(german) for _ in range(20)), "de") for i in range(60)]
    rows += [(100, None, None), (101, "123 456", None), (102, "der garten und die schule", None)]
    got = {r.doc_id: r for r in language.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang)
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "de"
    assert language.identify(spark, empty(spark)).count() == 0
