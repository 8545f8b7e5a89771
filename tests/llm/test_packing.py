"""Packing: ids of texts that hold the tokenizer's added token."""

import zlib

import numpy as np

from tracegraph.llm import packing


def test_added_tokens(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a<|endoftext|>b", "<|endoftext|>", "one two <|endoftext|> three\n<|endoftext|><|endoftext|>", "a<|endoftext|", "plain"]
    assert reference.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    rows = packing.pack_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), segments=64).collect()
    for i, t in enumerate(texts):
        ids = np.array([*reference.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
