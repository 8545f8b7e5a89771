"""What the operators of this subpackage share: written tables, inputs, batch sizes and hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut as materialize
from ..plans.iterate import forget, shared_dir
from ..plans.ship import ship_package

__all__ = ["forget", "fresh", "hot_join", "key_crc", "materialize", "read_table", "shared_dir", "small_batches", "text_column"]

#: Seconds without a byte from a Python worker after which the task is given to another one. The slowest
#: stage (audio features) takes a text of some 100 MB in that time; for longer ones set
#: spark.python.worker.idleTimeoutSeconds, which then holds.
IDLE_SECONDS = 100
#: A key is hot if it has more than this share of all rows; so there are fewer than 1 / share hot keys.
HOT_SHARE = 1 / 1024


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Prepare a session for Python stages: sources on the executors, bounded Arrow batches, no waiting for dead workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if not spark.sparkContext.getConf().contains("spark.python.worker.idleTimeoutSeconds"):
        spark.conf.set("spark.sql.execution.pyspark.udf.idleTimeoutSeconds", str(IDLE_SECONDS))
        spark.conf.set("spark.sql.execution.pyspark.udf.killOnIdleTimeout", "true")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, column: str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def key_crc(column: str = "doc_id") -> Column:
    """crc32 of an id's decimal text, the key of the training folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and in ``count`` the key's number of rows.

    Hot keys, fewer than 1 / HOT_SHARE of them by their definition, are joined where the rows lie, by
    a broadcast; rows of all other keys are shuffled. Both frames are read twice, so they should be
    written tables. ``count`` is not part of the result.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) > total * HOT_SHARE).drop(count)
    cold = table.where(F.col(count) <= total * HOT_SHARE).drop(count)
    here = rows.join(F.broadcast(hot), keys)
    there = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return here.unionByName(there)
