"""Runs of several stages that continue where they stopped: a ledger of what is finished, written after the data.

A stage's rows lie in one folder for each key (a part of its input, or "all") and version. A key is
finished once its line stands in the ledger, which is appended after the data is written; a run that is
started again takes finished keys from their folders and makes the rest anew, whatever an interrupted one left
there. The version names the stage's parameters and all it was made from, so a change runs it and what follows again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut, forget
from . import traces as R

LEDGER = "stage string, key string, version string, rows long"


def version_of(*parts: object) -> str:
    """A short digest of parameters and of the versions that a stage builds on."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


class Run:
    """The stages of one run below ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def ledger(self) -> DataFrame:
        """(stage, key, version, rows) of what is finished, a line a key; empty before the first."""
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger").distinct()
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER)

    def stage(self, name: str, version: str, parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
        """The written rows of all ``parts``; those that the ledger has are not made again. At least one part is given."""
        done = {r.key for r in self.ledger().where((F.col("stage") == name) & (F.col("version") == version)).collect()}  # a line a part
        tables = []
        for key, make in parts.items():
            path = f"{self.folder}/{name}/{version}/{key}"
            if key not in done:
                rows = make()
                rows.write.mode("overwrite").parquet(path)
                written = self.spark.read.schema(rows.schema).parquet(path)
                self.spark.createDataFrame([(name, key, version, written.count())], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
            tables.append(self.spark.read.parquet(path))
        return reduce(DataFrame.unionByName, tables)


def part_of(name: Column, parts: int) -> Column:
    """A name's part: the first eight hex digits of its md5, modulo ``parts``; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(name, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % parts


def proof_graph(run: Run, traces: DataFrame, source: str, parts: int = 8, match: str = "state", mining: dict | None = None) -> dict[str, DataFrame]:
    """Typed edges of traces, labelled DAGs and, with ``mining`` (arguments of ``mine``), their frequent parts.

    source names the traces (a path and its version), so that other traces are not taken for these. Edges
    are made in ``parts`` by theorem, each finished on its own. Traces without a name have no edges.
    """
    made = version_of("edges", source, parts)
    dealt = []  # written once, by the first part that is made

    def part(k: int) -> DataFrame:
        if not dealt:
            dealt.append(cut(run.spark, traces.withColumn("_part", part_of(F.col("full_name"), parts)), "dealt", ["_part"]))
        return R.trace_edges(dealt[0].where(F.col("_part") == k).drop("_part"))

    edges = run.stage("edges", made, {str(k): lambda k=k: part(k) for k in range(parts)})
    forget(run.spark, *dealt)
    built = version_of("dags", made, match)
    dags = run.stage("dags", built, {"all": lambda: R.dag_edges(edges, match)})
    out = {"edges": edges, "dags": dags}
    if mining is not None:
        out["motifs"] = run.stage("motifs", version_of("motifs", built, sorted(mining.items())), {"all": lambda: R.mine(run.spark, dags, **mining)})
    return out
