"""The numbers of all reports in one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits
from . import views as V
from .registry import QUERIES, SQL, query

#: The reports by name: query, columns that name its rows, columns of numbers.
REPORTS = {
    "dependency graph": ("dep_stats", [], ["theorems", "occurrences", "edges", "premises"]),
    "hubs": ("top_hubs", ["name"], ["degree"]),
    "tactic heads": ("top_heads", ["head"], ["n"]),
    "source categories": ("top_source_categories", ["category"], ["n"]),
    "state graph": ("typed_edges", ["kind"], ["n", "fallbacks", "branching"]),
    "hyperedge outputs": ("output_size_hist", ["outs"], ["n"]),
    "proof shapes": ("tree_replay", ["theorem"], ["depth", "width", "n_tactic_steps", "n_leaves", "max_branching"]),
    "degree tail": ("ccdf_degree", ["x"], ["p"]),
    "depths": ("depth_percentiles", ["event_type"], ["mean", "median", "p90", "p99", "most"]),
    "motifs": ("motif_support_gain", ["motif"], ["support", "gain"]),
    "category prediction": ("category_sweep", ["spec"], ["n", "accuracy", "top3"]),
    "proof length": ("proof_length_small_sets", ["feature_set", "side"], ["n_features", "n", "r2", "pearson", "rmse"]),
    "length correlation": ("pearson_length", [], ["pearson", "n"]),
    "pathfinding": ("state_sweep", [], ["pairs", "found", "found_fraction", "mean_depth", "most"]),
    "pathfinding by tactic": ("dep_reach_by_head", ["tactic_head"], ["n", "found", "rate"]),
    "new declarations": ("manifest_stats_row", [], ["declarations", "fresh", "categories", "files"]),
    "declarations by category": ("manifest_stats", ["category"], ["n"]),
    "verification": ("verify_status_counts", ["status"], ["n"]),
    "attempts": ("pass_at_n", ["source"], ["passed", "n"]),
}


def _label(case: list[str]) -> str:
    return " || ', ' || ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '')" for c in case) or "''"


_NUMBERS = "WITH " + ", ".join(f"r{i} AS MATERIALIZED ({SQL[q]})" for i, (q, _, _) in enumerate(REPORTS.values())) + ", numbers AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS artifact, {_label(case)} AS \"case\", '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM r{i} WHERE {m} IS NOT NULL" for i, (name, (_, case, metrics)) in enumerate(REPORTS.items()) for m in metrics
) + ")"


#: Reports on the succession graph: they take its arcs, written once for all of them.
ON_ARCS = {"top_hubs", "ccdf_degree", "proof_length_small_sets", "pearson_length"}


def _numbers(s, d):
    arcs = V.arcs(s, d)
    return audits.gathered(s, {name: (QUERIES[q](s, d, *([arcs] if q in ON_ARCS else [])).select(*case, *metrics), case) for name, (q, case, metrics) in REPORTS.items()})


@query(f"{_NUMBERS} SELECT * FROM numbers")
def report_numbers(s, d):
    """Every number of nineteen reports."""
    return _numbers(s, d)


@query("SELECT 'hubs' AS artifact, 'name=' || name AS \"case\", 'degree' AS metric, CAST(claimed AS DOUBLE) AS claimed, CAST(value AS DOUBLE) AS value, CASE WHEN value IS NULL THEN 'gone' WHEN claimed IS NULL THEN 'new' WHEN value = claimed THEN 'same' ELSE 'differs' END AS status "
       f"FROM (SELECT coalesce(v.name, c.name) AS name, v.degree AS value, c.degree AS claimed FROM ({SQL['top_hubs']}) v FULL JOIN (SELECT l_partkey AS name, count(*) AS degree FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30) c ON c.name = v.name) q")
def hub_claims(s, d):
    """The hubs as if claimed by how often a part is ordered, held to their degrees."""
    claims = V.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "name").limit(30)
    return audits.checked(audits.numbers(QUERIES["top_hubs"](s, d).select("name", "degree"), "hubs", ["name"]), audits.numbers(claims, "hubs", ["name"]))
