"""Kneser-Ney models, subword embeddings and folds against plain-Python versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracegraph.llm import charlm, language, quality, toxicity

D = charlm.DISCOUNT
TEXTS = {"en": "the river and the stone are under the bright cloud again", "de": "der garten und die schule sind unter dem himmel", "fr": "la rivière été où le garçon dort"}


def grams(text):
    """Tuples of up to five symbols, the predicted one last; B closes a word on either side."""
    out = []
    for word in text.lower().split():
        s = ["B", *word, "B"]
        out += [tuple(s[max(0, k - 4) : k + 1]) for k in range(1, len(s))]
    return out


def orders(counts):
    out = {5: counts}
    for o in range(4, 0, -1):
        lower = Counter()
        for g, n in out[o + 1].items():
            lower[g[-o:]] += n if len(g) <= o else 1
        out[o] = lower
    return out


def contexts(counts):
    total, kinds = Counter(), Counter()
    for g, n in counts.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    return total, kinds


class KneserNey:
    def __init__(self, counts, shared=False):
        self.n, self.shared = orders(counts), shared
        self.c = {o: contexts(x) for o, x in self.n.items()}

    def p(self, g, o=5):
        if o == 0:
            return 1 / 1024
        total, kinds = self.c[o]
        n, ctx = self.n[o].get(g[-o:], 0), g[-o:][:-1]
        if o == 1 and self.shared:
            return n / total[ctx] * 0.999 + 0.001 / 1024
        if not total[ctx]:
            return self.p(g, o - 1)
        return max(n - D, 0) / total[ctx] + D * kinds[ctx] / total[ctx] * self.p(g, o - 1)


def counted(spark, texts):
    return charlm.count_grams(spark.createDataFrame(texts, "grp string, text string"))


def test_language_model(spark):
    model = language.fit(spark, counted(spark, [(k, t) for k, t in TEXTS.items()] + [("en", "the the")]))
    plain = {k: KneserNey(Counter(grams(t + (" the the" if k == "en" else "")))) for k, t in TEXTS.items()}
    probes = [*TEXTS.values(), "unseen wörter und the river", "zzz q", "été"]
    got, letters = language.cross_entropies(pa.array(probes), model)
    for r, text in enumerate(probes):
        g = grams(text)
        want = [-sum(math.log(plain[k].p(x)) for x in g) / len(g) for k in model.languages]
        assert got[r] == pytest.approx(want, rel=1e-4)
    assert letters.all() and model.languages == sorted(TEXTS)
    total = sum(plain["en"].p(("B", c)) for c in "abcdefghijklmnopqrstuvwxyzB")
    assert total == pytest.approx(1, abs=0.03)  # the rest is the share of symbols not seen


def test_toxicity_model(spark):
    bad, good = "pathetic loser trash pathetic idiot", "the river and the stone are bright"
    model = toxicity.fit(spark, counted(spark, [("1", bad), ("0", good), ("0", "the trash")]))
    n = {"1": Counter(grams(bad)), "0": Counter(grams(good)) + Counter(grams("the trash"))}
    shared, c = KneserNey(n["1"] + n["0"], shared=True), {g: contexts(x) for g, x in n.items()}

    def ratio(g):
        out = 0.0
        for k, sign in (("1", 1), ("0", -1)):
            total, kinds = c[k]
            ctx = g[:-1]
            weight = D * kinds[ctx] / total[ctx] if total[ctx] else 1.0
            own = max(n[k][g] - D, 0) / total[ctx] if total[ctx] else 0.0
            seen = n["1"][g] + n["0"][g]
            out += sign * math.log(own + weight * shared.p(g) if seen else weight)
        return out

    probes = [bad, good, "pathetic", "quite new words here the trash the trash", "", "a loser by the river", "stone " * 50 + "idiot"]
    got = toxicity.evidence(pa.array(probes), model)
    for r, text in enumerate(probes):
        per = [(sum(map(ratio, grams(w))), len(grams(w))) for w in text.split()]
        whole = sum(x for x, _ in per) / sum(k for _, k in per) if per else 0.0
        size = min(3, len(per))
        runs = [per[k : k + size] for k in range(len(per) - size + 1)] if per else []
        best = max((sum(x for x, _ in p) / sum(k for _, k in p) for p in runs), default=0.0)
        assert got[r] == pytest.approx([whole, best], rel=1e-4, abs=1e-6)


def test_quality_features_and_logits():
    texts = ["the the the cat", "", "é two  two\nwords é", "ab", "x " * 40]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    parts = quality.features(data, offsets)
    bucket = lambda f, r: sorted(np.concatenate([x[b[r] : b[r + 1]] for x, b in f]).tolist())
    for r, text in enumerate(texts):
        words = text.split()
        alone = quality.features(np.frombuffer(raw[r], np.uint8), np.array([0, len(raw[r])]))
        assert bucket(parts, r) == bucket(alone, 0)  # nothing crosses a row's end
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        assert len(bucket(parts, r)) == len(words) + quality.REPEAT_WORDS * repeats + sum(max(0, len(raw[r]) - n + 1) for n in quality.NGRAMS)
        assert sum(b >= quality.BUCKETS for b in bucket(parts, r)) == quality.REPEAT_WORDS * repeats
    model = quality.Model(np.random.default_rng(1).normal(size=quality.ROWS).astype(np.float32), 0.25)
    want = [0.25 + (np.mean(model.logit[bucket(parts, r)]) if bucket(parts, r) else 0) for r in range(len(texts))]
    assert quality.logits(pa.array(texts), model) == pytest.approx(want, rel=1e-5)


def test_quality_training_is_plain_sgd():
    """One step a document, rate falling linearly, against loops over features and dimensions."""
    texts, labels = ["good fine text", "bad bad bad", "more good text"], np.array([1, 0, 1])
    got = quality.train(texts, labels)
    rng = np.random.default_rng(1)
    v = rng.uniform(-1 / quality.DIMENSION, 1 / quality.DIMENSION, (quality.ROWS, quality.DIMENSION)).astype(np.float32).astype(float)
    layer, bias = rng.normal(0, 0.1, (quality.DIMENSION, 2)).astype(np.float32).astype(float), np.zeros(2)
    held = []
    for t in texts:
        d = np.frombuffer(t.encode(), np.uint8)
        held.append(Counter(np.concatenate([x for x, _ in quality.features(d, np.array([0, len(d)]))]).tolist()))
    done, steps = 0, quality.EPOCHS * len(texts)
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(texts)):
            total = sum(held[k].values())
            hidden = sum(n / total * v[f] for f, n in held[k].items())
            z = hidden @ layer + bias
            error = np.exp(z - z.max()) / np.exp(z - z.max()).sum() - np.eye(2)[labels[k]]
            rate = quality.RATE * (1 - done / steps)
            back = layer @ error
            for f, n in held[k].items():
                v[f] -= rate * len(held[k]) * 0.1 * n / total * back
            layer, bias, done = layer - rate * np.outer(hidden, error), bias - rate * error, done + 1
    assert got.logit == pytest.approx(v @ (layer[:, 1] - layer[:, 0]), abs=1e-4) and got.offset == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_long_text_does_not_empty_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_TEXT", 500)
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 4000)
    rows = [(k, ("good fine words " if k % 2 else "bad poor words ") * (200 if k % 5 == 0 else 3)) for k in range(60)]
    got = quality.classify(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.9


def test_folds_and_clashing_columns(spark):
    rng = random.Random(3)
    words = {"en": "river stone under cloud bright walk".split(), "de": "und der schule wasser fenster garten".split()}
    rows = []
    for k in range(120):
        lang = "en" if k % 2 else "de"
        bad = " trash" * 3 if k % 3 == 0 else ""
        rows.append((k, " ".join(rng.choice(words[lang]) for _ in range(20)) + bad, lang, "x", 0.5, 1, True, 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, evidence int, held_out boolean, toxic int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), k % 2) for k in range(120)], "doc_id long, toxic int, quality int")
    crc = {k: zlib.crc32(str(k).encode()) for k in range(120)}
    for got, mod, rest in ((language.identify(spark, docs), 3, 1), (quality.classify(spark, docs, labels), 3, 1), (toxicity.score_documents(spark, docs, labels), 5, 0)):
        assert {r.doc_id: r.held_out for r in got.collect()} == {k: c % mod == rest for k, c in crc.items()}
    whole = toxicity.score_column(spark, docs, labels, "held_out")
    assert whole.columns == [*[c for c in docs.columns if c != "held_out"], "held_out"] and {r.score for r in whole.collect()} == {0.5}
    # held-out labels are never read: turning them over changes nothing
    turned = spark.createDataFrame([(k, int((k % 3 == 0) != (crc[k] % 5 == 0)), 0) for k in range(120)], "doc_id long, toxic int, quality int")
    scores = lambda t: {r.doc_id: r.score for r in toxicity.score_documents(spark, docs, t).collect()}
    assert scores(labels) == scores(turned)
    hit = [r.predicted == int(r.doc_id % 3 == 0) for r in toxicity.score_documents(spark, docs, labels).collect() if r.held_out]
    assert np.mean(hit) > 0.9


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (None, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.predicted for r in toxicity.score_documents(spark, docs, none).collect()} == {0}
    assert {r.score for r in quality.classify(spark, docs, none).collect()} == {0.5}
    assert {r.lang_pred for r in language.identify(spark, docs.limit(0)).collect()} == set()
    assert {r.lang_pred for r in language.identify(spark, docs.where("doc_id is null")).collect()} == {"und"}


def test_rejection_of_held_out_texts(spark):
    """Few rightly named held-out texts of the tables are rejected, in each language; texts of no learnt language are."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000_001 + k, "xqzw jvkq wpzx qqkj zzxv " * 20, None) for k in range(20)], docs.schema)
    got = language.identify(spark, docs.unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").toPandas()
    named = got[got.held_out & (got.lang == got.lang_pred)]
    assert named.rejected.mean() < 0.02 and (named.groupby("lang").rejected.mean() < 0.06).all()
    assert got[got.doc_id > 10_000_000].rejected.all()
