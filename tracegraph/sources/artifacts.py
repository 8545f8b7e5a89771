"""Trace records, JSON lines, feature tables, matrices and source snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learning import ranked

PREMISE = "struct<full_name:string,def_path:string,def_pos:array<int>,def_end_pos:array<int>>"
TACTIC = f"struct<tactic:string,state_before:string,state_after:string,annotated_tactic:struct<text:string,premises:array<{PREMISE}>>>"
TRACED = f"full_name string, file_path string, traced_tactics array<{TACTIC}>"
SPLITS = ("train", "val", "test")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_traces(spark: SparkSession, folder: str, schema: str = TRACED) -> DataFrame:
    """Split files of JSON arrays in split order; a missing split is skipped. Adds split and ordinal."""
    out = None
    for k, split in enumerate(SPLITS):
        path = f"{folder}/{split}.json"
        if not exists(spark, path):
            continue
        part = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("split", F.lit(split)).withColumn("ordinal", F.struct(F.lit(k).alias("split"), F.monotonically_increasing_id().alias("row")))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{schema}, split string, ordinal struct<split:int,row:bigint>")


def theorem_scan(traces: DataFrame) -> DataFrame:
    """Named theorems with tactics: full_name, file_path, tactic_count, statement_len (of the first state), tactics."""
    rows = traces.where("coalesce(full_name, '') <> '' and size(traced_tactics) > 0")
    return rows.select("full_name", "file_path", F.size("traced_tactics").alias("tactic_count"), F.coalesce(F.length(F.col("traced_tactics")[0]["state_before"]), F.lit(0)).alias("statement_len"), F.transform("traced_tactics", lambda t: t["tactic"]).alias("tactics"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, missing_ok: bool = False) -> DataFrame:
    """JSON lines without the blank ones; strict fails on a malformed line, otherwise such lines are dropped.

    With ``missing_ok`` a path that does not exist is an empty table.
    """
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_last(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines, of each key the last line: by file name, then by place in the file."""
    rows = read_jsonl(spark, path, schema)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    last = rows.select(F.struct("*").alias("r"), place.alias("place")).groupBy(F.col(f"r.{key}").alias("key")).agg(F.max_by("r", "place").alias("r"))
    return last.select("r.*")


def read_features(spark: SparkSession, path: str, low: int = 10, high: int = 10) -> DataFrame:
    """Wide feature CSV to name, file_path, category, degree, low and high arrays; rows that lack a column are skipped."""
    rows = spark.read.csv(path, header=True)
    columns = {p: [c for c in rows.columns if c.startswith(p)][:n] for p, n in (("low_", low), ("high_", high))}
    whole = rows.na.drop("any", subset=[*columns["low_"], *columns["high_"]])
    pick = lambda p: F.array(*[F.col(c).cast("double") for c in columns[p]])
    return whole.select("name", "file_path", "category", F.col("degree").cast("int"), pick("low_").alias("low"), pick("high_").alias("high"))


def write_features(df: DataFrame, path: str, arrays: dict[str, int]) -> None:
    """Array columns as wide CSV columns low_1, low_2, ...; arrays gives their lengths."""
    wide = [F.get(a, F.lit(k)).alias(f"{a}_{k + 1}") for a, n in arrays.items() for k in range(n)]
    df.select(*[c for c in df.columns if c not in arrays], *wide).write.csv(path, header=True)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """A small JSON document, such as the eigenvalues beside a feature table."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A report as one JSON document."""
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def write_sorted_jsonl(df: DataFrame, path: str, *keys: str) -> None:
    df.orderBy(*keys).write.json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows added to what is there; the committer takes the place of file locks."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_payloads(df: DataFrame, path: str, order: str, size: int, columns: list[str]) -> None:
    """The named columns in batches of ``size`` rows by ``order``, a folder a batch."""
    placed = ranked(df, [order], "_place").withColumn("batch", F.floor(F.col("_place") / size))
    placed.select("batch", *columns).repartition("batch").write.partitionBy("batch").json(path)


def write_matrix(df: DataFrame, path: str, name: str, vector: str) -> None:
    """Names and vectors in single precision."""
    df.select(F.col(name).alias("name"), F.col(vector).cast("array<float>").alias("vec")).write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name long, vec array<float>").parquet(path)


def read_sources(spark: SparkSession, folder: str, suffix: str = "", limit: int | None = None) -> DataFrame:
    """Whole files below a folder as (path, content): those whose names end with ``suffix``, the first ``limit`` by path."""
    reader = spark.read.option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    out = reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return out if limit is None else out.orderBy("path").limit(limit)
