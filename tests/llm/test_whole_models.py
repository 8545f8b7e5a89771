"""Language models of more than 2^20 grams: no gram and no context is left out."""

import numpy as np
from pyspark.sql import functions as F

from tracegraph.llm import charlm, language, toxicity

MANY, FEW = (1 << 20) + 150_000, 2_000


def counts(spark, many, few):
    """MANY five-symbol grams of one group, seen three times, and FEW others of a group that is seen once."""
    gram = sum((F.shiftleft(F.pmod(F.shiftright("id", 5 * k), F.lit(32)) + F.lit(2), charlm.BITS * k) for k in range(charlm.ORDER)), F.lit(0).cast("long"))
    here = spark.range(MANY).select(F.lit(many).alias("grp"), gram.alias("gram"), F.lit(3).cast("long").alias("n"))
    other = spark.range(FEW).select(F.lit(few).alias("grp"), (gram + F.lit(100 << 40)).alias("gram"), F.lit(1).cast("long").alias("n"))
    return here.union(other)


def test_language(spark):
    rows = counts(spark, "aa", "bb")
    model = language.fit(spark, rows)
    assert len(model.keys[charlm.ORDER - 1]) == MANY + FEW
    rare = np.sort(np.array([r.gram for r in rows.where("grp = 'bb'").collect()], np.int64))
    assert charlm.find(model.keys[charlm.ORDER - 1], rare)[1].all()
    assert charlm.find(model.contexts[charlm.ORDER - 1], np.unique(rare >> charlm.BITS))[1].all()


def test_toxicity(spark):
    rows = counts(spark, "0", "1")
    model = toxicity.fit(spark, rows)
    assert len(model.grams) == MANY + FEW
    assert len(model.contexts) == len(np.unique(model.grams >> charlm.BITS))
