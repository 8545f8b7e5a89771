"""Decontamination: items that share an id, and items of few literal words."""

import pytest

from tracegraph.llm import decontaminate

LONG = "The careful keeper of the northern lighthouse wrote down every ship that passed the rocks before the storm"
SHORT = "Which metal melts first under the bright flame"


def found(spark, texts, items, **named):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.find_items(spark, docs, spark.createDataFrame(items, "item_id long, text string"), **named).collect()
    return {r.doc_id: [(x.item_id, round(x.containment, 6), x.changed) for x in r.found] for r in got}


@pytest.mark.parametrize("block_windows", [1 << 21, 40])
@pytest.mark.parametrize("items", [[(1, LONG), (1, SHORT)], [(1, SHORT), (1, LONG), (1, LONG)]])
def test_texts_of_one_id(spark, items, block_windows):
    texts = [f"Before. {LONG}. After.", f"Before. {SHORT}. After.", f"{SHORT}. {LONG}.", "nothing of the kind stands in here at all"]
    one = [(1, 1.0, False)]
    assert found(spark, texts, items, block_windows=block_windows) == {0: one, 1: one, 2: one, 3: []}


def test_few_literal_words(spark):
    items = [(1, "What is 12 + 35 * 7?"), (2, "Solve 3 + 4"), (3, "What do Anna, Ben and Clara Smith 5 6 7 8"), (4, "17 4 99 23 8 61"), (5, "42")]
    texts = [
        "Some words first. What is 12 + 35 * 7? And more.",
        "Some words first. What is 14 + 22 * 9? And more.",
        "Some words first. What is 14 + 22? And more.",
        "then solve 3 + 4 at once",
        "then solve 5 + 6 at once",
        "a row 17 4 99 23 8 61 of numbers",
        "a row 17 4 99 23 8 62 of numbers",
        "there are 42 of them",
        "42",
        "Some words first. What is 12 + 35 * 12? And more.",
    ]
    got = found(spark, texts, items)
    assert got[0] == [(1, 1.0, False)] and got[1] == [(1, 1.0, True)] and got[2] == []
    assert got[3] == [(2, 1.0, False)] and got[4] == []
    assert got[5] == [(4, 1.0, False)] and got[6] == [] and got[7] == [] and got[8] == [(5, 1.0, False)]
    assert got[9] == [(1, 1.0, True)]


def test_whole_item_needs_consistent_values(spark):
    items = [(1, "What is 8 + 8 * 2?")]
    texts = ["What is 5 + 5 * 3?", "What is 5 + 6 * 3?"]
    assert found(spark, texts, items) == {0: [(1, 1.0, True)], 1: []}
