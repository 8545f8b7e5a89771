"""Decontamination against a brute-force search over all documents, items and diagonals."""

import random
import re

import pytest

from tracegraph.llm import decontaminate as D

WORDS = "if then train leaves at old station speed of how far does it go in".split()
NAMES = ["Anna", "Boris", "Clara"]


def words_of(text):
    """(template, value, is slot) of each word."""
    out, before, number = [], 0, False
    for m in re.finditer("[A-Za-z\u0080-\U0010ffff]+|[0-9]+", text or ""):
        w = m[0]
        opening = before == 0 or bool(re.search("[.!?:\n]", text[before : m.start()]))
        if w[0].isdigit():
            out.append(("#number", w, True))
        elif number and w.lower() in D.UNITS:
            out.append(("#unit", w.lower(), True))
        elif re.fullmatch("[A-Z][^A-Z]+", w) and not opening:
            out.append(("#name", w.lower(), True))
        else:
            out.append((w.lower(), w.lower(), False))
        before, number = m.end(), w[0].isdigit()
    return out


def windows(words):
    if not words:
        return {}
    size = min(5, len(words))
    held = {p: words[p : p + size] for p in range(len(words) - size + 1)}
    return {p: tuple(t for t, _, _ in w) for p, w in held.items() if sum(not s for _, _, s in w) >= min(D.LITERALS, size)}


def consistent(pairs):
    return len(set(pairs)) == len({a for a, _ in pairs})


def judge(doc, item):
    """None or (share, changed)."""
    ours, theirs = windows(doc), windows(item)
    best = None
    if theirs and (len(item) >= 5 or len(doc) == len(item)):
        covered, changed = set(), False
        for shift in range(-len(item), len(doc) + 1):
            at = [p for p, w in theirs.items() if ours.get(p + shift) == w]
            held = {k for p in at for k in range(p, p + min(5, len(item))) if item[k][2]}
            pairs = [(item[k][1], doc[k + shift][1]) for k in held]
            if at and consistent(pairs):
                covered |= {theirs[p] for p in at}
                changed |= any(a != b for a, b in pairs)
        if len(covered) >= 0.8 * len(set(theirs.values())) - 1e-9:
            best = (len(covered) / len(set(theirs.values())), changed)
    slots, literals, n = [k for k, w in enumerate(item) if w[2]], sum(not w[2] for w in item), len(item)
    if n and (not theirs or (n < 5 and slots)):
        seen = []
        for p in range(len(doc) - n + 1):
            if not literals and n < 5 and len(doc) != n:
                continue
            k = 0 if literals >= D.WHOLE_LITERALS else 1
            if [w[k] for w in doc[p : p + n]] == [w[k] for w in item]:
                pairs = [(item[j][1], doc[p + j][1]) for j in slots]
                if consistent(pairs):
                    seen.append(any(a != b for a, b in pairs))
        if seen and (best is None or (-1.0, all(seen)) < (-best[0], best[1])):
            best = (1.0, all(seen))
    return best


def brute(texts, items):
    out = {}
    for i, text in texts:
        found = {}
        for item, t in items:
            got = judge(words_of(text), words_of(t)) if item is not None else None
            if got and (item not in found or (-got[0], got[1]) < (-found[item][0], found[item][1])):
                found[item] = got
        out[i] = [(k, round(s, 6), c) for k, (s, c) in sorted(found.items())]
    return out


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.7 else rng.choice([*NAMES, str(rng.randrange(4)), f"{rng.randrange(4)} km"]) for _ in range(n))


@pytest.mark.parametrize("block_windows", [1 << 21, 900])
def test_against_brute_force(spark, block_windows):
    rng = random.Random(5)
    items = [(k, sentence(rng, rng.choice([1, 2, 3, 4, 5, 7, 12, 20]))) for k in range(60)]
    items += [(3, items[10][1]), (3, items[3][1]), (None, "if then train leaves at"), (70, None), (71, ""), (72, "the the the the the the the the")]
    shared = "if then train leaves at"  # a window that many items have, some by one template
    items += [(100 + k, f"{shared} {k % 7} km of Anna {sentence(rng, 3)}") for k in range(40)]
    items += [(200 + k, f"{shared} {k % 5} and {k % 3} how far does it go") for k in range(40)]
    texts = [None, "", "if", shared, "the the the the the the the the the"]
    for _ in range(60):
        a, b = rng.choice(items)[1] or "", rng.choice(items)[1] or ""
        b = re.sub(r"\d", lambda m: str(rng.randrange(4)), b)
        parts = [sentence(rng, 4), a, sentence(rng, 3), b]
        rng.shuffle(parts)
        text = ". ".join(parts).split(" ")
        if rng.random() < 0.4:
            text[rng.randrange(len(text))] = "changed"
        texts.append(" ".join(text))
    texts += [texts[9], texts[9], " ".join(texts[5:40]) * 3]
    rows = [(k if k % 11 else None, k, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, row int, text string, _text string, more int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, found int")
    found = D.find_items(spark, docs, bench, block_windows=block_windows)
    assert found.columns == ["doc_id", "row", "text", "_text", "more", "found"]
    got = found.collect()
    assert {(r.row, r.doc_id, r.text, r._text, r.more) for r in got} == {(k, i, t, x, m) for i, k, t, x, m in rows}
    assert {r.row: [(x.item_id, round(x.containment, 6), x.changed) for x in r.found] for r in got} == brute(list(enumerate(texts)), items)


def test_name_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", 5)], "doc_id long, text string, found int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_items(spark, docs, none, name="hits").collect()[0].asDict() == {"doc_id": 1, "text": "some text", "found": 5, "hits": []}
    assert D.find_items(spark, docs.limit(0), none).count() == 0
