"""Every operator on rows with nulls in all columns, repeated rows, repeated and null ids, a very long text and clashing names."""

import random

import pytest

from tracegraph.llm import decontaminate, language, licenses, media, neardup, packing, quality, secrets, substrings, toxicity

WORDS = "river stone under cloud bright walk seven garden paper table window silent early orange motion winter".split()
CLASHING = "n k1 k2 rep key bands sketch comp a b rid spans start end kept blob rules score held_out predicted evidence passage found licenses media payload frames feature prompt length offset sequence_id toxic quality fold item_id size text_ _text pos".split()


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [None, "", " \n ", "x", prose(80), prose(50), 'token = "abcdefgh12345678" ' + prose(20), prose(40_000), "\U0001f600 " * 70, "a\u0000b " + prose(10)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(4, texts[4], "en"), (40, texts[4], None), (None, texts[5], "en"), (None, None, None), (4, texts[4], "en")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wide = spark.createDataFrame([(*r, *[None if k % 3 == 0 else 7] * len(CLASHING)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    return plain, wide


def labels(spark):
    return spark.createDataFrame([(k, k % 2 if k != 3 else None, (k + 1) % 2) for k in range(10)] + [(4, 1, 1), (None, 1, 1), (999, 1, 0)], "doc_id long, toxic int, quality int")


RUNS = {
    "secrets": lambda s, d: secrets.scan_deliveries(s, d)[0].select("doc_id", "text", "blob", "spans"),
    "quality": lambda s, d: quality.classify(s, d, labels(s)),
    "near_duplicates": lambda s, d: neardup.near_duplicates(s, d),
    "language": lambda s, d: language.identify(s, d),
    "licenses": lambda s, d: licenses.scan(d).select("doc_id", "text", "licenses"),
    "toxicity": lambda s, d: toxicity.score_documents(s, d, labels(s)),
    "media": lambda s, d: media.audio_columns(s, d),
    "packing": lambda s, d: packing.pack_documents(s, d.coalesce(1)),
    "repeats": lambda s, d: substrings.remove_repeats(s, d),
    "decontamination": lambda s, d: decontaminate.find_items(s, d, s.createDataFrame([(1, "river stone under cloud"), (None, "x"), (1, None)], "item_id long, text string")).select("doc_id", "text", "found"),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_clashing_names_change_nothing(spark, frames, name):
    plain, wide = (RUNS[name](spark, f) for f in frames)
    assert plain.dtypes == wide.dtypes
    a, b = (sorted(str(tuple(r)) for r in f.collect()) for f in (plain, wide))
    assert a == b
    if name != "packing":
        assert len(a) == frames[0].count()
