"""Spelling variants against plain versions: the vocabulary, near pairs with and without subdivided blocks, forms and roots."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tracegraph.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        others = [(-m, x) for x, m in counts.items() if near(w, x)]
        best = min(others, default=None)
        form = best if best and -best[0] >= 10 * n else None
        out[w] = [n, form and form[1], len(others), form and -form[0]]
    for w in out:
        root = w
        while out[root][1]:
            root = out[root][1]
        out[w].append(root)
    return out


def words(seed):
    rng = random.Random(seed)
    stems = ["internat", "ab", "aaaaaaa", "überzäh", "zz"]
    got = set()
    for _ in range(420):
        w = rng.choice(stems) + "".join(rng.choice("abé") for _ in range(rng.randrange(0, 5)))
        if rng.random() < 0.3:
            k = rng.randrange(len(w))
            w = w[:k] + w[k + 1 :]
        got.add(w)
    return {w: rng.choice([2, 3, 25, 31, 400]) for w in got} | {"": 2, "a": 40, "b": 3, "𝔘nicode": 5, "𝔘nicodex": 90}


@pytest.mark.parametrize("most", [3, spelling.BLOCK])
def test_variants(spark, most):
    counts = words(most)
    table = spark.createDataFrame([*counts.items(), (None, 9)], "word string, n long")
    got = spelling.variants(spark, table, most=most).collect()
    assert len(got) == len(counts)
    assert {r.word: [r.n, r.form, r.n_near, r.form_n, r.root] for r in got} == plain(counts)


def test_pairs_come_once(spark):
    counts = words(5)
    table = spelling.common.materialize(spark, spark.createDataFrame([*counts.items()], "word string, n long"))
    got = [(r.word, r.near) for r in spelling.near_words(spark, table, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in counts for b in counts if near(a, b)}


def test_blocks_are_subdivided(spark):
    """A third of the words share both halves but for a letter; no scan holds more than the bound, or words that one letter tells apart."""
    counts = {f"gemein{a}{b}{c}schaft": 2 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    table = spelling.common.materialize(spark, spark.createDataFrame([*counts.items()], "word string, n long"))
    blocks = spelling.blocks_of(spark, table, 20).groupBy(*spelling.KEYS).count().collect()
    assert max(r["count"] for r in blocks) <= 20
    got = spelling.variants(spark, table, most=20).collect()
    assert all(r.n_near == 21 and r.form is None and r.root == r.word for r in got) and len(got) == 512


def test_vocabulary(spark):
    texts = ["Straßenbahn straßenbahn ÉTUDIANT étudiant x÷ymultiplied", None, "", "longword " * 200 + "tail", "longword-longword_longword2longword"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "longwords longwords"), (3, texts[3])]
    want = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.vocabulary(docs).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and got
    assert spelling.variants(spark, spelling.vocabulary(docs.limit(0))).count() == 0


def test_query_and_twin(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    names = "word, form, root, n, n_near, form_n"
    want = con.execute(f"select {names} from ({queries.SQL['op11_spelling']})").fetchall()
    got = [tuple(r) for r in spelling.op11_spelling(spark, SF).select(*names.split(", ")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r[1] for r in got)
