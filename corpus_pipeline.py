"""The training-data pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Tables other than documents are read from sf_dir. A null or empty text passes every
filter and is packed as its closing id; an empty table stays empty. Further columns of any name pass
through unchanged, and rows that share a doc_id are judged apart, but go together as near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.llm import common, decontaminate, neardup, packing, secrets, toxicity

#: Jaccard similarity, in hundredths, from which the stage takes documents as near-duplicates; op3 has a figure of its own.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    name = common.fresh(docs, "toxicity")
    scored = toxicity.score_column(spark, docs, common.read_table(spark, sf_dir, "labels"), name)
    return scored.where(F.col(name)["predicted"] == 0).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.80 and more) the document of smallest doc_id stays."""
    gone = neardup.near_duplicates(spark, docs, NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    name = common.fresh(docs, "found")
    found = decontaminate.find_items(spark, docs, common.read_table(spark, sf_dir, "benchmark"), name=name)
    return found.where(F.size(name) == 0).drop(name)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind in brackets; n_chars follows the text."""
    blob, spans = common.fresh(docs, "blob"), common.fresh(docs, "spans")
    found, _ = secrets.scan_versions(docs, columns=(blob, spans))
    text = F.when(F.size(spans) > 0, secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences."""
    name = common.fresh(docs, "prompt")
    return packing.pack_documents(spark, packing.with_prompt(docs, name), prompt=name, loss_tokens=packing.LOSS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL has no language models, MinHash or byte-pair encoding; tests/llm/test_pipeline.py holds each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
