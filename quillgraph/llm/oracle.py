"""DuckDB SQL for those of the queries that SQL can express, over whole tables."""

from __future__ import annotations

import re

from . import licenses, neardup, quality, secrets, warc

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _chat() -> str:
    return """WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
h AS (SELECT *, sha256(role || chr(0) || text) AS h FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM h),
p AS (SELECT conv_id, pos, n, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM o),
f AS (SELECT prefix, max(n) AS n_turns, CASE WHEN bool_or(conv_id IS NULL) THEN NULL ELSE min(conv_id) END AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY prefix),
k AS (SELECT * FROM f WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT k.conv_id, n_turns, n_copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM k JOIN o ON o.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id, n_turns, n_copies"""


def _any_case(pattern: str) -> str:
    """Letters outside character classes and escapes in either case; RE2's own folding goes beyond ASCII."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = 4 if pattern[i + 1] == "x" else 2
            out, i = out + pattern[i : i + n], i + n
            continue
        inside = c == "[" or inside and c != "]"
        out += f"[{c}{c.upper()}]" if c.islower() and not inside else c
        i += 1
    return out


def _secrets() -> str:
    """Pieces between the matches and the matches themselves, whose lengths add up to the places."""
    kinds = []
    for k, (kind, _, pattern, group, least) in enumerate(secrets.RULES):
        text = _any_case(pattern.pattern) if pattern.flags & re.IGNORECASE else pattern.pattern
        quoted = text.replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS g, regexp_split_to_array(text, '{quoted}') AS s FROM d WHERE regexp_matches(text, '{quoted}')"
        )
    base = len(secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), e AS ({' UNION ALL '.join(kinds)}),
u AS (SELECT doc_id, k, kind, least, unnest(m) AS m, unnest(g) AS g, unnest(s[1:len(m)]) AS s, generate_subscripts(m, 1) AS i FROM e),
w AS (SELECT *, CAST(sum(length(s) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS stop FROM u),
f AS (SELECT *, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM w WHERE length(g) >= least),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k < {base}), '') AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


def _warc() -> str:
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= {warc.MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN winner != page_id THEN winner END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)"""


def _licenses() -> str:
    grams = ", ".join(
        f"('{name}', {i}, '{' '.join(w[i : i + licenses.K])}', {len(w) - licenses.K + 1})"
        for name, text in licenses.TEMPLATES.items() for w in [licenses._words(text)] for i in range(len(w) - licenses.K + 1)
    )
    phrases = ", ".join(f"({_array(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
t(template, tpos, gram, n_grams) AS (VALUES {grams}), b(phrase, label) AS (VALUES {phrases}),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d),
g AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {licenses.K}], ' ') AS gram FROM p WHERE pos + {licenses.K} <= len(w)),
h AS (SELECT doc_id, template, pos - tpos AS diagonal, n_grams, tpos, pos FROM g JOIN t USING (gram)),
i AS (SELECT doc_id, template, diagonal, list(tpos) AS ts, max(n_grams) AS n_grams, min(pos) AS lo, max(pos) AS hi FROM h GROUP BY doc_id, template, diagonal),
j AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.SHIFT} THEN 0 ELSE 1 END AS apart FROM i),
r AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM j),
m AS (SELECT doc_id, template, len(list_distinct(flatten(list(ts)))) / max(n_grams) AS share, max(hi) - min(lo) + 1 <= max(n_grams) + {licenses.SLACK} AS fits FROM r GROUP BY doc_id, template, run),
v AS (SELECT doc_id, list(regexp_replace(template, '-(notice|text)$', '')) AS more, max(share) AS share FROM m WHERE share >= {licenses.MIN_SHARE} AND fits GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS base FROM p JOIN b ON w[pos + 1 : pos + len(phrase)] = phrase GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN v USING (doc_id)"""


def _array(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _quality() -> str:
    base, rest = (" OR ".join(f"coalesce(({m.replace('/ n_words', '/ nullif(n_words, 0)').replace('/ n_lines', '/ nullif(n_lines, 0)')} {op} {x}), false)" for _, m, op, x, b in quality.RULES if b is which) for which in (True, False))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACED}')) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM d), g AS (SELECT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS gram, list(i) AS places FROM p GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, unnest(places) AS i FROM g), (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
q AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in quality.STOP_WORDS)}))) AS n_stop_words FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT ({base}) AND NOT ({rest}) AS kept FROM q"""


def _neardup() -> str:
    k, least = neardup.WORDS, neardup.PERCENT
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {k}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {k - 1}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {least} * (x.n + y.n - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
c AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON e.u = c.v),
m AS (SELECT u, min(v) AS least FROM c GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, least) AS component_id, d.doc_id <= coalesce(least, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON u = d.doc_id"""


ORACLE_SQL = {
    "op2_chat_formatting": _chat(), "op3_secret_scans": _secrets(), "op4_warc": _warc(), "op5_license_scans": _licenses(),
    "op7_quality_rules": _quality(), "op9_near_dedup": _neardup(),
}
