"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger holds, for each blob
and rule version scanned, what was found. A scan groups the versions given by blob, removes the
(blob, rule version) pairs the ledger knows, runs the remaining rules once per blob, and joins the
findings back to all paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to match, leftmost and non-overlapping, and which matches to keep.

    ``group`` of a match must have ``least`` characters.
    """

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    """A pattern for a word whose letters a-z stand in either case. Flags for that differ between engines past ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base rules, in the order that breaks ties between spans, then added ones.
RULES = (
    Rule("assign", "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
)
BASE = ("assign", "access", "hex")
#: Parts in which the registered query takes its table, each scanned against the ledger of those before.
DELIVERIES = 2
FOUND = "array<struct<start:int,order:int,kind:string,end:int>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's kept spans in code points: matches, and the lengths of the gaps between them."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {FOUND})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(F.length(x["held"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.expr(f"cast(array() as {FOUND})"))


def blobs_of(versions: DataFrame) -> DataFrame:
    """One row per distinct text, whatever the number of paths; copies meet in partial aggregates."""
    return versions.groupBy("blob").agg(F.first("text").alias("text"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """New ledger rows (blob, rules, spans): the rule versions run now on each blob, and all their spans."""
    todo = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(todo, F.coalesce(F.col("seen"), F.expr("cast(array() as array<string>)")))
    blobs = blobs.select("blob", "text", todo.alias("rules")).where(F.size("rules") > 0)
    none = F.expr(f"cast(array() as {FOUND})")
    found = [F.when(F.array_contains("rules", r.key), spans_of(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    return blobs.select("blob", "rules", F.concat(*found).alias("spans"))


def addressed(versions: DataFrame, columns: tuple[str, str]) -> DataFrame:
    """The versions without columns of these names, plus the first: the address of the text."""
    kept = [F.col(f"`{c}`") for c in versions.columns if c.lower() not in {x.lower() for x in columns}]
    return versions.select(*kept, F.sha2(common.text_column(versions), 256).alias(columns[0]))


def scan_unseen(spark: SparkSession, versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New rows of the ledger, a written table (blob, rules, spans): what ``ledger`` lacks of the versions' blobs and the rules."""
    rows = versions.select(common.text_column(versions).alias("text")).withColumn("blob", F.sha2("text", 256))
    return common.materialize(spark, scan_blobs(blobs_of(rows), rules, ledger), "ledger")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, columns: tuple[str, str] = ("blob", "spans")) -> DataFrame:
    """Every row and column of ``versions`` plus blob and spans (start, order, kind, end; by start, then rule) from the ledger.

    A blob that has a hot share of all rows gets its findings by a broadcast, where its rows lie.
    """
    blob, spans = columns
    wanted = F.array(*[F.lit(r.kind) for r in rules])
    hits = ledger.where(F.size("spans") > 0).select("blob", F.filter("spans", lambda s: F.array_contains(wanted, s["kind"])).alias("spans"))
    hits = hits.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a blob has a row for each scan that had unseen rules
    hits = hits.select(F.col("blob").alias(blob), F.array_sort(F.array_distinct("spans")).alias(spans))
    rows = addressed(versions, columns)
    copies = rows.groupBy(blob).agg(F.count("*").alias("n"))
    hot = copies.where(F.col("n") > versions.count() * common.HOT_SHARE).select(blob)  # fewer than 1 / HOT_SHARE rows
    hot = common.materialize(versions.sparkSession, hot, "hot-blobs")
    here = rows.join(F.broadcast(hot), blob, "left_semi").join(F.broadcast(hits.join(F.broadcast(hot), blob, "left_semi")), blob, "left")
    there = rows.join(F.broadcast(hot), blob, "left_anti").join(hits, blob, "left")
    out = here.unionByName(there)
    return out.withColumn(spans, F.coalesce(spans, F.expr(f"cast(array() as {FOUND})"))).select(*rows.columns, spans)


def scan_versions(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, columns: tuple[str, str] = ("blob", "spans")) -> tuple[DataFrame, DataFrame]:
    """Scan versions (doc_id, text, ...) against a ledger: (findings per row, new ledger rows).

    Findings keep every row and column of ``versions`` and add ``blob`` and ``spans`` (start, order,
    kind, end; by start, then rule), from old and new ledger rows alike. Append the second frame to
    the ledger table; scan again and nothing is unseen.

    Words of rules match in either case of A-Z alone: a long s or a Kelvin sign is no letter of theirs.
    Null text counts as empty. Null doc_id and repeated rows are kept, each with its findings. An
    empty table gives empty frames. Ties (spans of two kinds at one start) follow the rules' order.
    ``columns`` names the two added columns; input columns of these names are replaced, no other is touched.
    """
    fresh = scan_unseen(versions.sparkSession, versions, rules, ledger)
    return findings(versions, fresh if ledger is None else fresh.unionByName(ledger), rules, columns), fresh


def scan_deliveries(spark: SparkSession, versions: DataFrame, rules: tuple[Rule, ...] = RULES, deliveries: int = DELIVERIES) -> tuple[DataFrame, DataFrame]:
    """``scan_versions`` of all versions, which arrive in parts by a hash of doc_id: each part is scanned
    against the ledger that the parts before it left, so that a blob is scanned once."""
    part, ledger = F.pmod(F.xxhash64("doc_id"), F.lit(deliveries)), None
    for k in range(deliveries):
        fresh = scan_unseen(spark, versions.where(part == k), rules, ledger)
        ledger = fresh if ledger is None else ledger.unionByName(fresh)
    return findings(versions, ledger, rules), ledger


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [kind]; overlapping spans merge into the earlier one's."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = scan_deliveries(spark, docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined_spans(base_spans(F.col("spans"))), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
