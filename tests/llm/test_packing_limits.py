"""Vector packing: limits, padding and the heuristic against a plain-Python version."""

import random

import numpy as np
import pytest

from tracegraph.llm import packing


def plain(examples, size, segments, loss):
    """(example, start, length, sequence) by the rule as stated, in loops. examples: (ids, prompt)."""
    out, sequence, free = [], 0, [size, segments, loss]
    start = [0] * len(examples)
    bears = lambda k, a, b: sum(1 for x in range(a, b) if examples[k][1] <= x < examples[k][0] - 1)

    def put(k, n):
        out.append((k, start[k], n, sequence))
        for d, x in enumerate((n, 1, bears(k, start[k], start[k] + n))):
            free[d] -= x
        start[k] += n

    def most(k):
        n = 0
        while start[k] + n < examples[k][0] and n < free[0] and bears(k, start[k], start[k] + n + 1) <= free[2]:
            n += 1
        return n

    for k, (n, _) in enumerate(examples):
        while n - start[k] >= size:
            put(k, most(k))
            sequence, free = sequence + 1, [size, segments, loss]
    while any(start[k] < n for k, (n, _) in enumerate(examples)):
        if min(free) < 1:
            sequence, free = sequence + 1, [size, segments, loss]
        rest = [k for k, (n, _) in enumerate(examples) if start[k] < n]
        need = {k: (examples[k][0] - start[k], 1, bears(k, start[k], examples[k][0])) for k in rest}
        limits = (size, segments, loss)
        mean = [sum(need[k][d] / limits[d] for k in rest) / len(rest) for d in range(3)]
        value = {k: sum(need[k][d] / limits[d] * mean[d] * free[d] / limits[d] for d in range(3)) for k in rest}
        fits = [k for k in rest if all(need[k][d] <= free[d] for d in range(3))]
        best = max(fits or rest, key=lambda k: (round(value[k], 12), -k))
        put(best, need[best][0] if fits else most(best))
    return out


@pytest.mark.parametrize("size,segments,loss", [(64, 5, 64), (64, 3, 50), (32, 8, 30), (100, 2, 90)])
def test_heuristic(size, segments, loss):
    rng = random.Random(size)
    for n in (0, 1, 40):
        examples = []
        for _ in range(n):
            total = rng.choice([1, 2, rng.randrange(1, size), rng.randrange(size, 4 * size)])
            examples.append((total, rng.randrange(0, total + 3)))
        packer = packing.Packer(size, segments, loss)
        packer.pack(np.array([t for t, _ in examples], np.int64), np.array([p for _, p in examples], np.int64))
        clipped = [(t, min(p, t - 1)) for t, p in examples]
        assert [p[:4] for p in packer.placed] == plain(clipped, size, segments, loss)


@pytest.mark.parametrize("loss", [256, 200])
def test_limits_and_padding(spark, loss):
    rng = random.Random(8)
    texts = ["", None, "one", *[" ".join(rng.choice("river stone under cloud bright".split()) for _ in range(rng.choice([5, 60, 100, 700]))) for _ in range(150)], "word " * 9000]
    docs = packing.with_prompt(spark.createDataFrame([(k if k % 7 else None, t, "x", 3) for k, t in enumerate(texts)], "doc_id long, text string, prompt string, length int").repartition(3), "first")
    rows = packing.pack_documents(spark, docs, size=256, segments=6, loss_tokens=loss, prompt="first").collect()
    encoder = packing.tokenizer(packing.default_tokenizer())
    ids = {k: len(packing.tokens_of(encoder, t or "")) + 1 for k, t in enumerate(texts)}
    prompts = {k: min(len(packing.tokens_of(encoder, " ".join((t or "").split(" ")[:16]))), ids[k] - 1) for k, t in enumerate(texts)}
    assert sum(r.length for r in rows) == sum(ids.values())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    waste = 0
    for held in sequences.values():
        total = sum(r.length for r in held)
        bearing = sum(max(0, min(r.start + r.length, ids[r.doc_id] - 1) - max(r.start, prompts[r.doc_id])) for r in held if r.doc_id is not None)
        assert total <= 256 and len(held) <= 6 and bearing <= loss
        waste += 0 if total & (total - 1) == 0 else 256 - total
    assert waste <= (0.02 if loss == 256 else 0.25) * sum(ids.values())
