"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score; DataFrame functions only.

A rule's pattern is matched leftmost and without overlaps, a validator drops what does not hold
(no retries inside a dropped match), and the score of what stays starts at the rule's own and moves
with words that stand close to the span. Nothing is shuffled: every text is read where it lies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, secrets

FOUND = "array<struct<order:int,kind:string,start:int,end:int,score:int>>"
#: Code points before and after a span in which context words count, not across a neighbouring match of the same rule.
NEARBY = 40
#: Matches whose places are summed up in one go; longer lists are summed in two steps, so that work stays linear.
RUN = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    value = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(value, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    moved = F.concat(F.substring(text, 5, 1000), F.substring(text, 1, 4))
    value = F.transform(F.split(moved, ""), lambda c: F.ascii(c) - F.when(F.ascii(c) < 58, 48).otherwise(55))
    return F.aggregate(value, F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _card(match: Column) -> Column:
    digits = digits_of(match)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


@dataclass(frozen=True)
class Rule:
    """A kind of personal data.

    ``plain`` is the pattern as it is meant; ``pattern`` matches the same spans in time linear in the
    text, without recursion for repeated groups. ``needs`` is a string without which there is no match.
    Scores are in hundredths: ``base``, plus 30 for a word of ``raising`` and less 30 for one of
    ``lowering`` nearby, within 0 and 100. Spans under ``least`` are left out.
    """

    kind: str
    plain: str
    pattern: str
    valid: Callable[[Column], Column]
    base: int
    raising: tuple[str, ...]
    lowering: tuple[str, ...] = ()
    needs: str = ""
    least: int = 0


#: The base rules, in the order in which their spans are listed, then added ones.
RULES = (
    Rule(
        "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True), 60, ("mail", "email", "e-mail", "contact", "correo", "courriel"), ("example", "noreply"), "@",
    ),
    Rule(
        "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda m: m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"), 50, ("ip", "host", "server", "address", "login"), ("version", "release", "section"), ".",
    ),
    Rule("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", _card, 70, ("card", "visa", "mastercard", "credit", "payment", "karte", "tarjeta", "carte"), ("order", "invoice", "isbn", "serial")),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits_of(m)).between(9, 15), 60, ("phone", "tel", "call", "mobile", "fax", "telefon"), (), "+"),
    Rule(
        "iban", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
        lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), 90, ("iban", "account", "bank", "konto", "cuenta"),
    ),
    Rule(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda m: ~m.rlike(r"^(000|666|9)|-00-|0000$"), 30, ("ssn", "social", "security", "taxpayer"), ("part", "order", "serial"), "-", 50,
    ),
)
BASE = ("email", "ip", "card", "phone")


def words_pattern(words: tuple[str, ...]) -> str:
    """Any of the words (a-z and hyphens), not inside a longer run of a-z."""
    return f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"


def _sums(lengths: Column) -> Column:
    """The running total before each entry of an array of ints."""
    start = lambda at: F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    fold = lambda part, at: F.aggregate(part, start(at), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda k: F.slice(lengths, k * RUN + 1, RUN))
    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(runs, fold(totals, F.lit(0)), fold))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's kept spans (order, kind, start, end, score), in code points, by start."""
    found = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("matches"))

    def scored(x: Column) -> Column:
        near = F.translate(F.concat(F.right(x["pair"]["gap"], F.lit(NEARBY)), F.lit("\n"), F.left(x["after"], F.lit(NEARBY))), UPPER, LOWER)
        score = F.lit(rule.base) + F.when(near.rlike(words_pattern(rule.raising)), 30).otherwise(0)
        if rule.lowering:
            score = score - F.when(near.rlike(words_pattern(rule.lowering)), 30).otherwise(0)
        start = x["at"] + F.length(x["pair"]["gap"])
        return F.struct(F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), start.alias("start"), (start + F.length(x["pair"]["match"])).alias("end"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"))

    def kept(x: Column) -> Column:
        gaps, matches = x["gaps"], x["matches"]
        pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
        places = _sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["match"])))
        rows = F.arrays_zip(pairs.alias("pair"), places.alias("at"), F.slice(gaps, 2, F.size(matches)).alias("after"))
        spans = F.transform(F.filter(rows, lambda r: rule.valid(r["pair"]["match"])), scored)
        return F.filter(spans, lambda s: s["score"] >= rule.least) if rule.least else spans

    spans = F.get(F.transform(F.array(found), kept), F.lit(0))  # a lambda's argument is evaluated once
    some = text.rlike(rule.pattern)
    return F.when(F.contains(text, F.lit(rule.needs)) & some if rule.needs else some, spans).otherwise(F.expr(f"cast(array() as {FOUND})"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "pii", text: str = "text") -> DataFrame:
    """Every row and column of ``docs`` plus ``column``: the spans found (order, kind, start, end, score), by rule, then start.

    Null texts count as empty and have no spans. Null and repeated ids are kept, each row with its own
    spans; an empty table gives an empty one. Spans of two rules may overlap, those of one do not; ties
    (two rules at one start) stand in the rules' order. An input column named as ``column`` is replaced,
    no other is touched. Texts are read whole, at any length, in linear time.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()]
    whole = common.text_column(docs, text)
    return docs.select(*kept, F.concat(*[spans_of(whole, rule, k) for k, rule in enumerate(rules)]).alias(column))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [kind]; overlapping spans merge into the one that starts first."""
    return secrets.redacted(text, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base kinds, all spans, counts of the added kinds, and the score of each span."""
    found = find(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"), secrets.joined_spans(F.col("pii")).alias("spans"), *[of(r.kind) for r in RULES if r.kind not in BASE], scores)
