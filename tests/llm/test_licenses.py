"""Licence scans against brute force over all segments and templates, without bounds."""

import re

from tracegraph.llm import licenses


TEMPLATES = {k: set(licenses.bigrams_of(v)) for k, v in licenses.TEMPLATES.items()}


def identity(name):
    return licenses.LICENSE_OF.get(name, name)


def brute(text):
    found = {}
    parts = re.split(r"\n\s*\n", text or "")
    runs = {"\n".join(parts[i : i + n]) for i in range(len(parts)) for n in range(1, licenses.RUN + 1)}
    for s in {text or "", *re.split(r"\n", text or ""), *re.split(r"[.!?]\s+", text or ""), *runs}:
        a = set(licenses.bigrams_of(s))
        own = {name: round(2 * len(a & b) / (len(a) + len(b)), 6) for name, b in TEMPLATES.items()}
        top = max(own.values())
        for name, d in own.items():
            if d >= licenses.THRESHOLD and d == top:
                found[name] = max(d, found.get(name, 0))
    ids = {identity(name) for name in found}
    return {k: v for k, v in found.items() if not any(i.startswith(identity(k) + "-") for i in ids)}


def test_scan(spark):
    t = licenses.TEMPLATES
    texts = [None, "", "one", "plain prose here\n" + t["Apache-2.0"] + "\nmore", "ALL RIGHTS RESERVED", "all rights are reserved", "x\n\n" + t["GPL-3.0"].replace("program", "library").replace(" it and", "\nit and") + "\n\ny", t["MIT-grant"].replace("any person", "all people"), "rights", t["MIT-SPDX"] + "\n" + t["ISC"], "public license " * 2000]
    docs = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)] + [(None, t["MIT"], 1)], "doc_id long, text string, licenses int")
    got = {r.doc_id: {m.template: m.dice for m in r.licenses} for r in licenses.scan(docs).collect()}
    assert got == {**{i: brute(x) for i, x in enumerate(texts)}, None: brute(t["MIT"])}
    assert got[3] and got[4] and got[6] and got[9]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_whole_texts(spark):
    """A licence file, one inside other paragraphs, a notice that shares its line, and a torn text."""
    t = licenses.TEMPLATES
    texts = ["MIT License\n\nCopyright (c) 2020 Acme\n\n" + t["MIT-text"], "About\n\nSome words here.\n\n" + t["BSD-2-Clause-text"] + "\n\nMore words.", "Copyright 2020 Acme. Released under the MIT License. And more.", t["Zlib-text"][:200], "/* " + t["MPL-2.0-header"].replace(". ", ".\n * ") + " */", t["GPL-3.0-header"]]
    got = {r.doc_id: {m.template: m.dice for m in r.licenses} for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute(x) for i, x in enumerate(texts)}
    for i, name in ((0, "MIT-text"), (0, "MIT-paragraph"), (1, "BSD-2-Clause-text"), (2, "MIT"), (4, "MPL-2.0-header"), (5, "GPL-3.0-header")):
        assert name in got[i]
    assert "Zlib-text" not in got[3]


def test_one_licence_of_many_templates(spark):
    """Templates of one licence count once, a text is not taken for the one it is like, and a family goes before its licence."""
    t = licenses.TEMPLATES
    bsd = t["BSD-3-Clause"]
    texts = {t["MIT-text"]: ["MIT"], t["GPL-3.0-header"]: ["GPL-3.0"], t["BSD-3-Clause-text"]: ["BSD-3-Clause"], t["BSD-2-Clause-text"]: ["BSD-2-Clause"], bsd: ["BSD"], "x\n\n" + t["Apache-2.0-header"] + "\n\n" + t["MIT-text"]: ["Apache-2.0", "MIT"], t["Zlib-text"]: ["Zlib"]}
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: sorted({m.license for m in r.licenses}) for r in got} == dict(enumerate(texts.values()))
    assert all({m.template: m.dice for m in r.licenses} == brute(r.text) for r in got)
    assert set(licenses.LICENSE_OF) <= set(t)
