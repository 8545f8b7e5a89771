"""Lineage ends in tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a temporary folder, on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tracegraph-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(spark: SparkSession, df: DataFrame, name: str = "step", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here.

    ``by`` names columns whose values get a folder each. The files outlive executors, so a lost executor never forces the work before this point.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_by(spark: SparkSession, df: DataFrame, keys: list[str], name: str = "table", dealt: bool = False) -> DataFrame:
    """``cut`` into a table bucketed by ``keys``, a file a bucket: joins and groups by them do not shuffle it.

    ``dealt``: the rows of a bucket lie in one partition already, so they are not shuffled for it.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    out = spark.read.table(table)
    out._cut_path, out._cut_table = path, table
    return out


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` or ``cut_by`` returned and that no later plan reads."""
    for frame in frames:
        if getattr(frame, "_cut_table", None):
            spark.sql(f"DROP TABLE {frame._cut_table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame._cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
