"""Each stage of the pipeline, and the whole of it, against brute force on a small corpus."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tracegraph.llm import neardup, packing

WORDS = "river stone under cloud bright walk seven garden paper table window silent early orange motion winter".split()
QUESTION = "A train leaves the old station at 60 km per hour and reaches the coast after 3 hours of steady travel"
SECRET = 'password = "hunter2hunter2"'
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, found string, spans int, blob string, held_out boolean, evidence double, toxicity string, prompt string, score double, Text_ int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([20, 40, 90])) for _ in range(150)]
    toxic = set(range(0, 150, 6))
    for k in toxic:
        texts[k] += " pathetic trash loser pathetic trash"
    texts[31], texts[32] = texts[20] if 20 not in toxic else texts[21], texts[21]
    words = prose(rng, 120).split()
    texts[40] = " ".join(words)
    words[60] = "changed"
    texts[41] = " ".join(words)
    texts[50] = f"Before. {QUESTION}. After"
    texts[51] = f"Before. {QUESTION.replace('60', '85').replace('3 hours', '4 hours')}. After"
    texts[61] = f"{texts[61]} {SECRET} {'0123456789abcdef' * 2} end"
    texts[62] = SECRET + " " + SECRET
    texts += [None, "", "one", prose(rng, 6000)]
    rows = [(k, t, "en", "s", len(t) if t else None, "f", 5, "b", True, 0.5, "t", "p", 1.0, 3) for k, t in enumerate(texts)]
    rows.append((None, texts[3], *rows[3][2:]))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k in toxic), 1) for k in range(150)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, QUESTION), (2, "nothing of this question stands in any of the documents here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r for r in rows if r[0] is not None}, toxic


def stage(spark, corpus, name, docs=None):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet") if docs is None else docs
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, corpus[0])
    if name != "packing":
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
    return got


def kept(got, corpus, changed=()):
    """Ids of the rows, which must be whole and unchanged."""
    rows = got.collect()
    for r in rows:
        if r.doc_id is not None and r.doc_id not in changed:
            assert tuple(r) == corpus[1][r.doc_id]
    return sorted((r.doc_id for r in rows), key=lambda k: (k is None, k))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_toxicity(spark, corpus):
    _, rows, toxic = corpus
    gone = set(rows) - set(kept(stage(spark, corpus, "toxicity"), corpus))
    assert gone == toxic


def test_near_duplicates(spark, corpus):
    _, rows, _ = corpus
    sets = {k: shingles(r[1]) for k, r in rows.items()}
    label = {k: k for k in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert kept(stage(spark, corpus, "near_duplicates"), corpus) == [*[k for k in sorted(sets) if label[k] == k], None]


def test_decontamination(spark, corpus):
    assert kept(stage(spark, corpus, "decontamination"), corpus) == [*[k for k in sorted(corpus[1]) if k not in (50, 51)], None]


def test_secrets(spark, corpus):
    want = {k: r[1] for k, r in corpus[1].items()}
    rule = re.compile(r"password = \"[A-Za-z0-9]+|[0-9a-f]{32,}")
    for k in (61, 62):
        want[k] = rule.sub(lambda m: "[assign]" if m[0][0] == "p" else "[hex]", want[k])
    got = stage(spark, corpus, "secrets")
    assert kept(got, corpus, changed=(61, 62)) == [*sorted(corpus[1]), None]
    for r in got.where("doc_id in (61, 62)").collect():
        assert r.text == want[r.doc_id] and r.n_chars == len(r.text) and r.spans == 5 and r.blob == "b"


def test_packing_and_run(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0]).collect()
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, corpus, name, docs).collect(), COLUMNS)
    encoder = packing.tokenizer(packing.default_tokenizer())
    left = {r.doc_id: np.array([*packing.tokens_of(encoder, r.text or ""), 0], "<u4") for r in docs.collect()}
    assert {r.doc_id for r in got} == set(left) and not {0, 6, 41, 50, 51} & set(left)
    for k, ids in left.items():
        at = 0
        for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_empty_table(spark, corpus):
    none = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, corpus, name, none).count() == 0


def test_recall_of_near_duplicates(spark):
    """Pairs of similarity 0.85 to 0.87: each is found. 300 pairs; a miss is expected in less than one of 1,000 such tests."""
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(300):
        words = [f"{rng.randrange(10**6)}" for _ in range(204)]
        other = list(words)
        for j in rng.sample(range(5, 195, 6), 3):
            other[j] = "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        s = len(a & b) / len(a | b)
        assert 0.85 <= s <= 0.88
        want[2 * k + 1] = 2 * k
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert all(got[b] == a for b, a in want.items())
