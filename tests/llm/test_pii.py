"""Personal data: spans against Python's regular expressions, checksums, scores, long texts and the twin."""

import re

import duckdb
import pytest

from tracegraph.llm import pii, queries

SF = "/root/testdata/sf0.001"
DIGITS = re.compile("[0-9]")


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def holds(kind, m):
    digits = "".join(DIGITS.findall(m))
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def plain(text):
    out = []
    for rule in pii.RULES[:4]:
        out += [(rule.kind, *m.span()) for m in re.finditer(rule.plain, text or "", re.ASCII) if holds(rule.kind, m[0])]
    return out


TEXTS = [
    None, "", "no data here", "mail bob.smith+x@mail.example.org, now", "a@b.c_d@e.f x@y x@y.", "@@a@b..c a@-.-", "é@ab.cd ünder@x.yz 😀a@b.co😀",
    "1.2.3.4 256.1.1.1 0001.02.3.255 1.2.3.4.5.6.7.8 1..2.3.4 00256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111", "4111  1111 1111 1111",
    "call +1 (234) 555-7713 or +49.30.123456.78 +1234 +1 (((((((( +123456789012345678", "+1+2345678901", "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE89370400440532013001", "my ssn is 123-45-6789, part 123-45-6789 000-12-3456", "card 4111111111111111 iban",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, pii string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii if s.kind in pii.BASE] for r in pii.find(docs).collect()}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)} and any(got.values())


def test_long_texts_stay_linear(spark):
    """Runs without an end and long lists of matches, where a pattern that backtracks would never finish or overflow its stack."""
    texts = {
        "a" * 2_000_000: [],
        "a@b" + ".c" * 300_000: [("email", 0, 600_003)],
        "7" * 1_000_000: [],
        "1." * 30_000: [("ip", 8 * k, 8 * k + 7) for k in range(7500)],
        "+1" + "(" * 500_000: [],
        "x@y.z " * 20_000: [("email", 6 * k, 6 * k + 5) for k in range(20_000)],
        "4 " * 300_000: [],
        "Aa@" * 200_000: [],
        "1-" * 100_000: [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii if s.kind in pii.BASE] for r in pii.find(docs).collect()}
    assert got == dict(enumerate(texts.values()))


def test_checksums_and_scores(spark):
    text = "iban DE89 3704 0044 0532 0130 00, not DE89370400440532013001; my ssn is 123-45-6789. " + "-" * 60 + " part 123-45-6789. " + "-" * 60 + " card: 4111111111111111 " + "-" * 60 + " order 4111111111111111 " + "-" * 60 + " 4111111111111111"
    row = pii.find(spark.createDataFrame([(text,)], "text string")).first()
    found = [(s.kind, text[s.start : s.end], s.score) for s in row.pii]
    assert [f[1:] for f in found if f[0] == "card"] == [("4111111111111111", 100), ("4111111111111111", 40), ("4111111111111111", 70)]
    assert [f[1:] for f in found if f[0] == "iban"] == [("DE89 3704 0044 0532 0130 00", 100)]
    assert [f[1:] for f in found if f[0] == "ssn"] == [("123-45-6789", 60)]  # the other one has no word that speaks for it


def test_mask_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "write to a@b.co or 10.0.0.1"), (1, "write to a@b.co or 10.0.0.1"), (None, None)], "doc_id long, text string")
    rows = pii.find(docs, column="found")
    assert rows.columns == ["doc_id", "text", "found"]
    masks = rows.select(pii.masked(rows.text, rows.found).alias("m")).collect()
    assert sorted(str(r.m) for r in masks) == ["None", "write to [email] or [ip]", "write to [email] or [ip]"]
    assert pii.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tables", ["given", "odd"])
def test_twin(spark, tables, tmp_path):
    path = SF
    if tables == "odd":
        path = str(tmp_path)
        spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet{'/*.parquet' if tables == 'odd' else ''}'")
    got = pii.op13_pii(spark, path)
    names = ", ".join(got.columns)
    want = con.execute(f"select {names} from ({queries.SQL['op13_pii']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
