"""Column functions for names, states, tactics and code. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_GOALS = "NOGOALS__________"  # fixed value: the id of the solved state


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def stable_bucket(c: Column, mod: int = 10) -> Column:
    """md5 of the text as a 128-bit number modulo ``mod``, by four 32-bit digits."""
    digest, acc = F.md5(c.cast("binary")), F.lit(0).cast("long")
    for k in range(4):
        digit = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        acc = (acc * F.lit((1 << 32) % mod) + digit) % mod
    return acc


def tactic_head(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(\S+)", 1)


def category(path: Column, root: str = "Mathlib", min_parts: int = 2) -> Column:
    parts = F.split(path, "/")
    return F.when((F.size(parts) >= min_parts) & (parts[0] == root), parts[1]).otherwise("UNKNOWN")


def sha16(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)


def state_id(c: Column) -> Column:
    text = py_strip(c)
    return F.when(text == "no goals", NO_GOALS).otherwise(sha16(text))


def extract_goals(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?s)⊢\s*(.+?)(?=\n\ncase\s|\z)"), F.lit(1)), py_strip)


def goal_id(c: Column, on_no_goal: str = "null") -> Column:
    """Hash of the goals; without a goal null, or with on_no_goal='state' the hash of the whole state."""
    goals = extract_goals(c)
    rest = sha16(py_strip(c)) if on_no_goal == "state" else F.lit(None).cast("string")
    return F.when(F.size(goals) > 0, sha16(F.concat_ws("\n||\n", goals))).otherwise(rest)


def split_state(c: Column) -> Column:
    """The single-goal states of a printed state."""
    text = F.regexp_replace(py_strip(c), r"^\d+ goals\n", "")
    parts = F.filter(F.transform(F.split(text, r"\n\n(?=case\s)"), py_strip), lambda x: x != "")
    return F.when((text == "") | (text == "no goals") | (F.size(parts) == 0), F.array(F.lit("no goals"))).otherwise(parts)


def excerpt(c: Column, n: int = 220) -> Column:
    return F.substring(F.regexp_replace(py_strip(c), r"\s+", " "), 1, n)


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), 1, 140)


def last_segment(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{Nl}\p{No}_][\p{L}\p{N}_'.]*"), F.lit(0))


def last_code_block(c: Column) -> Column:
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```(?:lean4|lean)?\n(.*?)```"), F.lit(1))
    return py_strip(F.coalesce(F.try_element_at(blocks, F.lit(-1)), c))


def motif_gain(edges: Column, support: Column) -> Column:
    return (edges - 1) * support - edges


def premise_directions(annotated: Column) -> Column:
    """For each <a> tag: rev if an arrow stands in the eight characters before it, else fwd."""
    parts = F.split(annotated, "<a>")
    before = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(before, lambda p: F.when(F.substring(p, -8, 8).rlike("←|<-"), "rev").otherwise("fwd"))


def states_match(a: Column, b: Column) -> Column:
    """Whether two printed states agree up to white space; null counts as empty."""
    squeeze = lambda c: F.regexp_replace(py_strip(F.coalesce(c, F.lit(""))), r"\s+", " ")
    return squeeze(a) == squeeze(b)


def split_printed_goals(c: Column) -> Column:
    """Goals of a printed state for tree metrics: blank lines before a case split first, then before any text."""
    text = F.coalesce(c, F.lit(""))
    parts = lambda pattern: F.filter(F.transform(F.split(text, pattern), py_strip), lambda x: x != "")
    by_case, by_block = F.split(text, r"\n\n(?=case )"), F.split(text, r"\n\n(?=\S)")
    return (
        F.when(text.isin("", "no goals"), F.array(F.lit("no goals")))
        .when(F.regexp_count(text, F.lit("⊢")) <= 1, F.array(text))
        .when(F.size(by_case) > 1, parts(r"\n\n(?=case )"))
        .when(F.size(by_block) > 1, parts(r"\n\n(?=\S)"))
        .otherwise(F.array(text))
    )


def split_top_commas(c: Column) -> Column:
    """Pieces between the commas outside all brackets, stripped, empty ones dropped: one fold over the characters."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("piece"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch.isin("(", "[", "{"), 1).when(ch.isin(")", "]", "}"), -1).otherwise(0)
        ends = (ch == ",") & (acc["depth"] == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(ends, "").otherwise(F.concat(acc["piece"], ch)).alias("piece"),
            F.when(ends, F.array_append(acc["done"], acc["piece"])).otherwise(acc["done"]).alias("done"),
        )

    pieces = F.aggregate(F.split(c, ""), start, step, lambda acc: F.array_append(acc["done"], acc["piece"]))
    return F.filter(F.transform(pieces, py_strip), lambda x: x != "")


def suggested_lemmas(message: Column) -> Column:
    """Lemmas of the first bracketed list after 'Try this:', on its line or indented lines after it; null without a closed list."""
    # fixed value: what a suggestion is
    line = F.regexp_extract(message, r"Try this:\s*([^\n]+(?:\n\s+[^\n]+)*)", 1)
    opened = F.substring_index(line, "[", 1)
    rest = F.substring(line, F.length(opened) + F.lit(2), F.length(line))
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("held"))

    def step(acc: Column, ch: Column) -> Column:
        depth = F.when(acc["depth"] == 0, 0).otherwise(acc["depth"] + F.when(ch == "[", 1).when(ch == "]", -1).otherwise(0))
        return F.struct(depth.alias("depth"), F.when(depth == 0, acc["held"]).otherwise(F.concat(acc["held"], ch)).alias("held"))

    inner = F.aggregate(F.split(rest, ""), start, step)
    return F.when(line.contains("[") & (inner["depth"] == 0), split_top_commas(inner["held"]))


def has_brackets(tactic: Column) -> Column:
    """Whether a tactic names its lemmas in brackets; null: no."""
    return F.coalesce(tactic.contains("["), F.lit(False))


def replay_tactic(tactic: Column, head: Column, lemma: Column, direction: Column) -> Column:
    """One lemma of a rewriting tactic as a tactic of its own; what follows 'at' is kept."""
    at = F.regexp_extract(F.coalesce(tactic, F.lit("")), r"(?s)(\sat(?:\s.*)?)$", 1)
    return F.concat(head, F.lit(" ["), F.when(direction == "rev", "← ").otherwise(""), lemma, F.lit("]"), at)


# fixed values: the heads of each class of tactic
AUTOMATION = ["simp", "simpa", "simp_all", "simp_rw", "dsimp", "field_simp", "aesop"]
DECISION = ["omega", "decide", "native_decide", "ring", "ring_nf", "noncomm_ring", "abel", "abel_nf", "group", "linarith", "nlinarith", "polyrith", "norm_num", "norm_cast", "push_cast", "exact_mod_cast", "positivity", "gcongr", "tauto", "rfl", "trivial", "assumption"]
REWRITE = ["rw", "rwa", "erw", "nth_rw", "rw_mod_cast"]
TERM = ["exact", "refine", "apply", "convert"]


def tactic_kind(head: Column, has_premises: Column) -> Column:
    """Edge kind of a tactic taken as a whole: rewriting without premises counts as structural."""
    return (
        F.when(head.isin(*DECISION), "decision_opaque")
        .when(head.isin(*AUTOMATION), "simp_bundle")
        .when(head.isin(*REWRITE) & has_premises, "rewrite_step")
        .when(head.isin(*TERM), "term")
        .otherwise("structural")
    )


def candidate_block(code: Column, header: Column) -> Column:
    """A generated proof as a declaration: from its first declaration on, or put under the given header."""
    lines = F.filter(F.split(py_strip(code), r"\r?\n"), lambda x: ~py_strip(x).rlike(r"^(?:import|set_option) "))
    first = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(DECLARATION), i)), lambda i: i.isNotNull()))
    whole = F.array_join(F.slice(lines, F.coalesce(first, F.lit(0)) + 1, F.greatest(F.size(lines), F.lit(1))), "\n")
    proof = py_strip(F.array_join(lines, "\n"))
    end = lambda x: F.regexp_replace(x, r"\s+$", "")
    return (
        F.when(first.isNotNull(), F.concat(end(whole), F.lit("\n")))
        .when(proof.startswith("by"), F.concat(F.regexp_replace(header, r" := by$", ""), F.lit(" := "), proof, F.lit("\n")))
        .otherwise(F.concat(end(header), F.lit("\n"), proof, F.lit("\n")))
    )


# fixed values: the patterns of declarations and namespaces
DECLARATION = r"^\s*(?:private\s+|protected\s+)?(theorem|lemma)\s+([A-Za-z0-9_'.«»]+)"
NAMESPACE = r"^\s*namespace\s+([A-Za-z0-9_'.]+)"
SCOPE_END = r"^\s*end(?:\s+([A-Za-z0-9_'.]+))?\s*$"
