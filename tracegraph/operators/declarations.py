"""Declarations of source files, manifests of new ones, anchors and prompts. JVM functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import learning as L

LOOK_AHEAD, FALLBACK = 80, 12


def _header(lines: Column, at: Column) -> Column:
    """The statement from line ``at`` (0-based) up to its proof, closed by ' := by'.

    The statement ends on the first of 80 lines with an assignment (not of a local let or have) or a
    trailing 'by'; without one the first 12 lines stand.
    """
    ahead = F.slice(lines, at + 1, LOOK_AHEAD)
    local = lambda x: T.py_strip(x).rlike(r"^(?:let|letI|have) ")
    ends = lambda x, i: x.contains(":= by") | (x.contains(":=") & ~local(x)) | x.rlike(r"\sby\s*$") | ((i > 0) & x.rlike(r"^by\s*$"))
    stop = F.array_min(F.filter(F.transform(ahead, lambda x, i: F.when(ends(x, i), i)), lambda i: i.isNotNull()))
    last = F.get(ahead, stop)
    text = F.array_join(F.slice(ahead, 1, stop + 1), "\n")
    end = lambda x: F.regexp_replace(x, r"\s+$", "")
    assigned = F.when(last.contains(":= by"), F.substring_index(text, ":= by", 1)).when(last.contains(":=") & ~local(last), F.regexp_replace(text, r"(?s):=(?!.*:=).*$", ""))
    return F.when(stop.isNull(), end(F.array_join(F.slice(ahead, 1, FALLBACK), "\n"))).otherwise(
        F.coalesce(F.concat(end(assigned), F.lit(" := by")), end(F.regexp_replace(text, r"\sby\s*$", " := by")))
    )


def declarations(sources: DataFrame) -> DataFrame:
    """kind, name, full_name, file_path, line, category, declaration_header of sources (path, content).

    Namespaces are a fold over the lines that open, close or declare; any 'end' closes the innermost
    namespace, even that of a section. A dotted name is taken as full. Null content has no rows.
    """
    lines = sources.select(F.col("path").alias("file_path"), F.split("content", r"\r\n|\n|\r").alias("lines"))
    mark = lambda x, i: F.struct(
        i.alias("at"),
        F.regexp_extract(x, T.NAMESPACE, 1).alias("opens"),
        x.rlike(T.SCOPE_END).alias("ends"),
        F.regexp_extract(x, T.DECLARATION, 1).alias("kind"),
        F.regexp_extract(x, T.DECLARATION, 2).alias("name"),
    )
    marks = F.filter(F.transform("lines", mark), lambda m: (m["opens"] != "") | m["ends"] | (m["kind"] != ""))
    found_type = "array<struct<kind:string,name:string,scope:string,at:int>>"
    start = F.struct(F.array().cast("array<string>").alias("scope"), F.array().cast(found_type).alias("found"))

    def step(acc: Column, m: Column) -> Column:
        scope = F.when(m["opens"] != "", F.array_append(acc["scope"], m["opens"])).when(m["ends"] & (F.size(acc["scope"]) > 0), F.slice(acc["scope"], 1, F.size(acc["scope"]) - 1)).otherwise(acc["scope"])
        one = F.struct(m["kind"].alias("kind"), m["name"].alias("name"), F.array_join(acc["scope"], ".").alias("scope"), m["at"].alias("at"))
        return F.struct(scope.alias("scope"), F.when(m["kind"] != "", F.array_append(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = lines.select("file_path", "lines", F.explode(F.aggregate(marks, start, step, lambda acc: acc["found"])).alias("d"))
    full = F.when(F.contains("d.name", F.lit(".")) | (F.col("d.scope") == ""), F.col("d.name")).otherwise(F.concat_ws(".", "d.scope", "d.name"))
    return found.select("d.kind", "d.name", F.regexp_replace(full, r"^_root_\.", "").alias("full_name"), "file_path", (F.col("d.at") + 1).alias("line"), T.category(F.col("file_path")).alias("category"), _header(F.col("lines"), F.col("d.at")).alias("declaration_header"))


def manifest(new: DataFrame, base: DataFrame, limit: int) -> DataFrame:
    """Declarations of the new snapshot whose (file, full name) the base lacks, spread over categories by turns."""
    fresh = declarations(new).join(declarations(base).select("file_path", "full_name").distinct(), ["file_path", "full_name"], "left_anti")
    keyed = fresh.withColumn("order", F.struct("file_path", "line", "name"))
    return L.round_robin(keyed, "category", "order", limit).select("kind", "name", "full_name", "file_path", "line", "category", "declaration_header")


def prompts(rows: DataFrame) -> DataFrame:
    """Adds prompt: the statement in a code block between fixed texts."""
    # fixed values: the texts around a statement
    opening = "Think about and solve the following problem step by step in Lean 4.\n# Formal statement:\n```lean4\nimport Mathlib\nimport Aesop\nset_option maxHeartbeats 0\n"
    closing = "\n\n```\nReturn exactly one Lean 4 code block containing a complete proof."
    return rows.withColumn("prompt", F.concat(F.lit(opening), F.col("declaration_header"), F.lit(closing)))


def anchors(rows: DataFrame, known: DataFrame) -> DataFrame:
    """full_name, anchor_count, anchors, low: known names in each header, by full name or by an unambiguous last segment.

    known: (name, low array). low is the mean of the anchors' coordinates, null without anchors.
    """
    tokens = rows.select("full_name", F.explode(F.array_distinct(T.identifiers(F.col("declaration_header")))).alias("token"))
    names = known.select("name", "low", T.last_segment(F.col("name")).alias("segment"))
    only = names.groupBy("segment").agg(F.count("*").alias("n"), F.min("name").alias("by_segment")).where("n = 1").select(F.col("segment").alias("token"), "by_segment")
    exact = known.select(F.col("name").alias("token"), F.col("name").alias("by_name"))
    hit = tokens.join(exact, "token", "left").join(only, "token", "left").select("full_name", F.coalesce("by_name", "by_segment").alias("name")).where("name is not null").distinct()
    long = hit.join(known, "name").select("full_name", "name", F.posexplode("low").alias("j", "v"))
    means = long.groupBy("full_name", "j").agg(F.avg("v").alias("m")).groupBy("full_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("low"))
    listed = hit.groupBy("full_name").agg(F.count("*").alias("anchor_count"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, 50), ";").alias("anchors"))
    out = rows.select("full_name").distinct().join(listed, "full_name", "left").join(means, "full_name", "left")
    return out.select("full_name", F.coalesce("anchor_count", F.lit(0)).alias("anchor_count"), F.coalesce("anchors", F.lit("")).alias("anchors"), "low")


def spliced(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds code: the file with the declaration's lines, up to the next declaration, replaced by its header and 'sorry'.

    A declaration whose file is not there stands alone under the usual imports.
    """
    lines = F.split("content", "\n")
    later = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when((i >= F.col("line")) & x.rlike(T.DECLARATION), i)), lambda i: i.isNotNull()))
    body = F.concat(F.regexp_replace("declaration_header", r"\s+$", ""), F.lit("\n  sorry\n\n"))
    before = F.when(F.col("line") > 1, F.concat(F.array_join(F.slice(lines, F.lit(1), F.col("line") - 1), "\n"), F.lit("\n"))).otherwise("")
    after = F.when(later.isNotNull(), F.array_join(F.slice(lines, later + 1, F.size(lines)), "\n")).otherwise("")
    alone = F.concat(F.lit("import Mathlib\nimport Aesop\nset_option maxHeartbeats 0\n\n"), F.col("declaration_header"), F.lit("\n  sorry\n"))
    joined = rows.join(sources.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    return joined.withColumn("code", F.when(F.col("content").isNull(), alone).otherwise(F.concat(before, body, after))).drop("content")
