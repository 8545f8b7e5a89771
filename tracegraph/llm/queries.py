"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, licenses, media, neardup, packing, pii, quality, secrets, spelling, substrings, toxicity, whitening

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_quality": quality.op2_quality,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_language": language.op4_language,
    "op5_licenses": licenses.op5_licenses,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_media": media.op7_media,
    "op8_packing": packing.op8_packing,
    "op9_repeats": substrings.op9_repeats,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_spelling": spelling.op11_spelling,
    "op12_whitening": whitening.op12_whitening,
    "op13_pii": pii.op13_pii,
}


def _secret_kind(order: int, rule: secrets.Rule) -> str:
    """Spans of one rule: the gaps between matches give the starts."""
    pattern = rule.pattern.replace("'", "''")
    start = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, '{rule.kind}' AS k, {order} AS o, {rule.least} AS least, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'a': CAST({start} AS BIGINT), 'n': length(w[i]), 'h': length(h[i])}})) AS s
 FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {rule.group}) AS h FROM d WHERE regexp_matches(t, '{pattern}')) q"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Whether a match m of a rule of personal data holds, in DuckDB's terms.
_BYTE = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[-i] AS INTEGER) WHEN x[-i] > '4' THEN 2 * CAST(x[-i] AS INTEGER) - 9 ELSE 2 * CAST(x[-i] AS INTEGER) END)) % 10 = 0"
_MOD97 = "list_reduce(list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''), lambda c: CAST(ascii(c) - CASE WHEN c <= '9' THEN 48 ELSE 55 END AS BIGINT)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, CAST(0 AS BIGINT)) = 1"
_HOLDS = {
    "email": "true",
    "ip": f"regexp_matches(m, '^0*{_BYTE}(\\.0*{_BYTE}){{3}}$')",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN.replace('x', _DIGITS).replace(f'e{_DIGITS}', 'ex')}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": _MOD97.replace("substr(x,", "substr(replace(m, ' ', ''),"),
    "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|0000$')",
}


def _personal_kind(order: int, rule: pii.Rule) -> str:
    """Kept spans of one rule with their scores; the words nearby come from the gaps on both sides."""
    start = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)"
    near = f"translate(right(g[i], {pii.NEARBY}) || chr(10) || left(g[i + 1], {pii.NEARBY}), '{pii.UPPER}', '{pii.LOWER}')"
    moved = lambda words, by: f" {by} CASE WHEN regexp_matches(near, {_quoted(pii.words_pattern(words))}) THEN 30 ELSE 0 END" if words else ""
    return f"""SELECT * FROM (SELECT doc_id, {order} AS o, '{rule.kind}' AS k, s.a AS a, s.a + length(s.m) AS z, greatest(0, least(100, {rule.base}{moved(rule.raising, "+")}{moved(rule.lowering, "-")})) AS score
 FROM (SELECT doc_id, s, s.m AS m, s.near AS near FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'a': CAST({start} AS BIGINT), 'm': w[i], 'near': {near}}})) AS s
 FROM (SELECT doc_id, string_split_regex(t, {_quoted(rule.plain)}) AS g, regexp_extract_all(t, {_quoted(rule.plain)}, 0) AS w FROM d WHERE regexp_matches(t, {_quoted(rule.plain)})) q) q) q WHERE {_HOLDS[rule.kind]}) q WHERE score >= {rule.least}"""


#: crc32 of UTF-8 bytes: the table of a byte's eight shifts, then one step a byte.
_EIGHT = "i"
for _ in range(8):
    _EIGHT = f"(SELECT CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM (SELECT {_EIGHT} AS c))"
_CRC = "xor(list_reduce(list_transform(range(1, length(b) // 2 + 1), lambda i: CAST('0x' || substr(b, 2 * i - 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


SQL: dict[str, str] = {
    "op1_secrets": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(_secret_kind(k, r) for k, r in enumerate(secrets.RULES))}),
 k AS (SELECT doc_id, o, s.a AS a, k || ':' || s.a || ':' || (s.a + s.n) AS span FROM m WHERE s.h >= least),
 f AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(span, ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(span, ',' ORDER BY a, o) AS spans FROM k GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f ON d.doc_id = f.doc_id""",
    "op5_licenses": f"""WITH seg AS (SELECT DISTINCT doc_id, unnest(list_concat([t], list_concat(string_split(t, chr(10)), list_concat(string_split_regex(t, '[.!?]\\s+'), flatten(list_transform(range(1, {licenses.RUN + 1}), lambda n: list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:i + n - 1], chr(10))))))))) AS s FROM (SELECT doc_id, t, string_split_regex(t, '\\n\\s*\\n') AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) q) q),
 w AS (SELECT doc_id, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+') AS w FROM seg),
 g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
 t AS (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT license, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+') AS w FROM (VALUES {", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in kv) + ")" for kv in licenses.TEMPLATES.items())}) v(license, s)) q),
 d AS (SELECT doc_id, g, license, round(2.0 * len(list_intersect(g, b)) / (len(g) + len(b)), 6) AS dice FROM g, t), top AS (SELECT doc_id, license AS template, dice FROM d WHERE dice >= {licenses.THRESHOLD} QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, g)),
 i AS (SELECT doc_id, coalesce(id, template) AS id, template, dice FROM top LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in licenses.LICENSE_OF.items())}) v(name, id) ON name = template),
 f AS (SELECT doc_id, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS names, string_agg(DISTINCT template, ',' ORDER BY template) AS templates, max(dice) AS best FROM i WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.doc_id = i.doc_id AND starts_with(o.id, i.id || '-')) GROUP BY 1)
 SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(f.templates, '') AS templates, coalesce(best, 0.0) AS best_dice FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""",
    "op11_spelling": f"""WITH RECURSIVE t8 AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, {_EIGHT} AS c FROM range(256) r(i)) q),
 run AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{pii.UPPER}', '{pii.LOWER}'), '{spelling.RUNS}{{{{{spelling.SHORTEST},}}}}')) AS run FROM documents),
 few AS (SELECT id, run, count(*) AS n, lower(hex(coalesce(id, '') || ':' || run)) AS b FROM run GROUP BY 1, 2), h AS (SELECT run, n, {_CRC} AS h FROM few, t8),
 w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {spelling.DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) q WHERE length(word) >= {spelling.SHORTEST} GROUP BY 1 HAVING sum(n) >= {spelling.LEAST}),
 hole AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w) q),
 near AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a.word, b.word AS near, b.n AS m FROM hole a JOIN hole b ON a.p = b.p AND a.less = b.less AND a.word <> b.word
 UNION ALL SELECT w.word, h.word, h.n FROM hole h JOIN w ON w.word = h.less UNION ALL SELECT h.word, w.word, w.n FROM hole h JOIN w ON w.word = h.less) q),
 best AS (SELECT word, count(*) AS n_near, max(m) AS most, arg_min(near, {{{{'m': -m, 'near': near}}}}) AS near FROM near GROUP BY 1),
 f AS MATERIALIZED (SELECT w.word, w.n, CASE WHEN most >= {spelling.FACTOR} * w.n THEN near END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.FACTOR} * w.n THEN most END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
 up AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
 last AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
 SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN last ON last.word = f.word""".replace("{{", "{").replace("}}", "}"),
    "op13_pii": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(_personal_kind(k, r) for k, r in enumerate(pii.RULES))}),
 s AS (SELECT doc_id, o, k, a, score, k || ':' || a || ':' || z AS span FROM f),
 g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = '{r.kind}') AS n_{r.kind}" for r in pii.RULES)}, string_agg(span, ',' ORDER BY o, a) FILTER (o < {len(pii.BASE)}) AS base, string_agg(span, ',' ORDER BY o, a) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY o, a) AS scores FROM s GROUP BY doc_id)
 SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in pii.RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
}
