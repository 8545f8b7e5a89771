"""All numbers of many result tables in one table, and claims held to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..plans.iterate import cut

KEYS = ["artifact", "case", "metric"]


def numbers(result: DataFrame, artifact: str, case: list[str]) -> DataFrame:
    """(artifact, case, metric, value) of every numeric column of ``result`` but those that name its rows.

    case is 'column=value' of the naming columns, comma-joined, empty where there are none; a null stands as nothing.
    Null numbers are not listed. A result without numeric columns gives no rows.
    """
    metrics = [f.name for f in result.schema.fields if f.name not in case and isinstance(f.dataType, NumericType)]
    label = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in case])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]) if metrics else F.expr("cast(array() as array<struct<metric:string,value:double>>)")
    rows = result.select(label.alias("case"), F.inline(cells))
    return rows.select(F.lit(artifact).alias("artifact"), "case", "metric", "value").where("value is not null")


def gathered(spark: SparkSession, artifacts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``numbers`` of all artifacts, name to (result, naming columns). Each is written when it is done, so the next one's plan is its own."""
    parts = [cut(spark, numbers(result, name, case), "numbers") for name, (result, case) in artifacts.items()]
    return reduce(DataFrame.unionByName, parts)


def checked(found: DataFrame, claims: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(artifact, case, metric, claimed, value, status) of every claim and every number.

    status: same (within tolerance times the larger of 1 and the value), differs, gone (claimed, not found) or new (not claimed).
    A claim of null is gone or differs. Names are taken to be unique on each side.
    """
    both = found.select(*KEYS, "value", F.lit(True).alias("here")).join(claims.select(*KEYS, F.col("value").cast("double").alias("claimed"), F.lit(True).alias("said")), KEYS, "full")
    close = F.abs(F.col("claimed") - F.col("value")) <= tolerance * F.greatest(F.lit(1.0), F.abs("value"))
    status = F.when(F.col("here").isNull(), "gone").when(F.col("said").isNull(), "new").when(F.coalesce(close, F.lit(False)), "same").otherwise("differs")
    return both.select(*KEYS, "claimed", "value", status.alias("status"))


def best_of(found: DataFrame, artifact: str, metric: str) -> DataFrame:
    """The row of an artifact whose metric is highest; ties go to the least case."""
    return found.where((F.col("artifact") == artifact) & (F.col("metric") == metric)).orderBy(F.desc("value"), "case").limit(1)
