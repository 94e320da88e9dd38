"""The same queries as SQL, put together from named tables so that each rule is written once."""

from __future__ import annotations

import re

from ..functions import stopwords
from ..functions import text as X
from ..sources.fixtures import QUESTIONS


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{X.SPACE}', ''), '{X.SPACE}\\z', '')"


def _unframed(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{X.FRAMING}', '')")


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{X.SPACE}', ' ', 'g'))"


_PAD = "printf('%06d', {})"
_LISTS = " UNION ALL ".join(f"SELECT '{lang}' AS lang, unnest({_quoted(words)}) AS term" for lang, words in stopwords.default_lists().items())
_ASKED = ", ".join(f"({qid}, '{text}')" for qid, text in QUESTIONS)


def _word_tables(p: str, notes: str) -> dict[str, str]:
    """Tables of one corpus; ``p`` goes before their names."""
    return {
        f"{p}words": f"SELECT DISTINCT note_id, term FROM (SELECT note_id, unnest(regexp_extract_all(lower(text), '{X.WORD}')) AS term FROM {notes}) WHERE length(term) >= {X.MIN_TERM}",
        f"{p}vocab": f"SELECT DISTINCT term FROM {p}words",
        f"{p}scores": f"SELECT lang, count(*) AS n_found, (SELECT count(*) FROM {p}vocab) AS n_words FROM {p}vocab JOIN lists USING (term) GROUP BY lang",
        f"{p}detected": f"SELECT lang FROM {p}scores WHERE n_found * 2 >= (SELECT max(n_found) FROM {p}scores)",
        f"{p}stop": f"SELECT DISTINCT term FROM lists JOIN {p}detected USING (lang) WHERE length(term) >= {X.MIN_TERM}",
        f"{p}content": f"SELECT note_id, term FROM {p}words WHERE term NOT IN (SELECT term FROM {p}stop)",
        f"{p}postings": f"SELECT note_id, term FROM {p}content UNION SELECT note_id, lower(regexp_replace(regexp_extract(note_id, '[^/]*$'), '{X.EXTENSION}', '')) FROM {notes}",
        f"{p}idf": f"SELECT term, count(*) AS df, ln((SELECT count(*) FROM {notes}) / count(*)) AS idf FROM {p}postings GROUP BY term",
        f"{p}asked": f"SELECT qid, pos, term FROM (SELECT qid, term, min(pos) - 1 AS pos FROM (SELECT qid, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT qid, list_filter(regexp_extract_all(lower(text), '{X.WORD}'), lambda x: length(x) >= {X.MIN_TERM}) AS w FROM questions)) GROUP BY qid, term) WHERE term NOT IN (SELECT term FROM {p}stop)",
        f"{p}hits": f"SELECT qid, note_id, term, idf FROM {p}postings JOIN {p}asked USING (term) JOIN {p}idf USING (term)",
        f"{p}seeds": f"SELECT qid, note_id, count(*) AS n_shared, round(sum(idf), 9) AS worth, round(max(idf), 9) AS strongest FROM {p}hits GROUP BY qid, note_id",
        f"{p}leaders": f"SELECT qid, count(*) AS n_seeds, first(note_id ORDER BY worth DESC, note_id) AS by_worth, first(note_id ORDER BY strongest DESC, note_id) AS by_strongest FROM {p}seeds GROUP BY qid",
        f"{p}pairs": f"SELECT x.note_id AS a, y.note_id AS b, count(*) AS shared FROM {p}content x JOIN {p}content y ON x.term = y.term AND x.note_id < y.note_id GROUP BY 1, 2 HAVING count(*) >= 2",
    }


def _link_tables(p: str, notes: str) -> dict[str, str]:
    """Resolution of the table of targets of one corpus; ``p`` goes before the tables' names."""
    tried = [
        f"SELECT source, target, 1 AS rank, note_id FROM {p}targets JOIN {p}named ON note_id = target",
        f"SELECT source, target, 2, n.note_id FROM {p}targets JOIN {p}named s ON s.note_id = source JOIN {p}named n ON n.note_id = s.folder || '/' || target",
        f"SELECT source, target, 3, n.note_id FROM {p}targets JOIN {p}named s ON s.note_id = source JOIN {p}named n ON n.stem = s.folder || '/' || target",
        f"SELECT source, target, 4, note_id FROM {p}targets JOIN {p}named ON stem = target",
        f"SELECT source, target, 5, note_id FROM {p}targets JOIN {p}named ON bare = target",
    ]
    return {
        f"{p}named": f"SELECT note_id, regexp_replace(note_id, '{X.EXTENSION}', '') AS stem, regexp_replace(regexp_extract(note_id, '[^/]*$'), '{X.EXTENSION}', '') AS bare, regexp_extract(note_id, '^(.*)/', 1) AS folder FROM {notes}",
        f"{p}tried": " UNION ALL ".join(tried),
        f"{p}resolved": f"SELECT t.source, t.target, first(r.note_id ORDER BY rank, r.note_id) AS note FROM {p}targets t LEFT JOIN {p}tried r ON r.source = t.source AND r.target = t.target GROUP BY t.source, t.target",
        f"{p}links": f"SELECT DISTINCT least(source, note) AS a, greatest(source, note) AS b, 'link' AS kind, CAST(1 AS DOUBLE) AS weight FROM {p}resolved WHERE note IS NOT NULL AND note != source",
    }


TABLES = {
    "lists": _LISTS,
    "questions": f"SELECT * FROM (VALUES {_ASKED}) AS q(qid, text)",
    "notes": f"SELECT coalesce(source, 'unfiled') || '/' || {_PAD.format('doc_id')} || '.md' AS note_id, doc_id, coalesce(text, '') AS text FROM documents",
    "linked": f"SELECT note_id, doc_id, text || ' [[' || {_PAD.format('doc_id // 2')} || ']] [[' || {_PAD.format('doc_id * 7 % (SELECT count(*) FROM documents)')} || ']] [[missing-' || (doc_id % 10) || ']]'"
    f" || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Why is there nothing in ' || {_PAD.format('doc_id')} || '?' ELSE '' END AS text FROM notes",
    **_word_tables("", "notes"),
    **_word_tables("l_", "linked"),
    "targets": f"SELECT DISTINCT source, target FROM (SELECT source, {_strip('target')} AS target FROM (SELECT note_id AS source, unnest(regexp_extract_all(text, '{X.WIKI_LINK}', 1)) AS target FROM linked"
    f" UNION ALL SELECT * FROM (SELECT note_id, unnest(regexp_extract_all(text, '{X.INLINE_LINK}', 1)) AS target FROM linked) WHERE NOT contains(target, '://') AND NOT starts_with(target, '#') AND NOT starts_with(target, 'mailto:'))) WHERE target != ''",
    **_link_tables("", "linked"),
    # What each form of link names, by the adapter's rule and without a pattern.
    "styled": "SELECT n.note_id, n.doc_id, n.doc_id % 9 AS k, n.doc_id * 3 % (SELECT count(*) FROM notes) AS led FROM notes n",
    "styled_texts": f"SELECT s.note_id, 'About ' || {_PAD.format('s.doc_id')} || ': ' || CASE k WHEN 0 THEN '[[' || {_PAD.format('led')} || '|shown as]]' WHEN 1 THEN '[[ ' || {_PAD.format('led')} || '#part|shown]]'"
    f" WHEN 2 THEN '[shown](' || coalesce(n.note_id, 'gone.md') || ')' WHEN 3 THEN '[shown](' || coalesce(left(n.note_id, length(n.note_id) - 3), 'gone') || ')' WHEN 4 THEN '[shown](' || {_PAD.format('led')} || '.md)'"
    f" WHEN 5 THEN '[[' || {_PAD.format('led')} || ']] [a](https://e.org/' || {_PAD.format('led')} || ') [b](#here) [c](mailto:a@b)' WHEN 8 THEN '[[gone-' || {_PAD.format('led')} || ']]' ELSE 'no link' END || '.' AS text FROM styled s LEFT JOIN notes n ON n.doc_id = led",
    **_word_tables("s_", "styled_texts"),
    "s_adj": "SELECT a AS note, b AS other FROM s_links UNION SELECT b, a FROM s_links",
    "s_closure": "SELECT note, other FROM s_adj UNION SELECT c.note, s_adj.other FROM s_closure c JOIN s_adj ON s_adj.note = c.other",
    "s_forms": f"SELECT s.note_id AS source, CASE WHEN k IN (0, 1, 5) THEN {_PAD.format('led')} WHEN k = 2 THEN coalesce(n.note_id, 'gone.md') WHEN k = 3 THEN coalesce(left(n.note_id, length(n.note_id) - 3), 'gone')"
    f" WHEN k = 4 THEN {_PAD.format('led')} || '.md' WHEN k = 8 THEN 'gone-' || {_PAD.format('led')} END AS target FROM styled s LEFT JOIN notes n ON n.doc_id = led",
    "s_targets": "SELECT source, target FROM s_forms WHERE target IS NOT NULL",
    **_link_tables("s_", "styled"),
    "s_across": "SELECT split_part(a, '/', 1) AS sa, split_part(b, '/', 1) AS sb FROM s_links",
    "s_touches": "SELECT subject, other, count(*) AS pairs FROM (SELECT sa AS subject, sb AS other FROM s_across WHERE sa != sb UNION ALL SELECT sb, sa FROM s_across WHERE sa != sb) GROUP BY subject, other",
    "l_edges": "SELECT * FROM links UNION ALL SELECT a, b, 'cooccurrence', CAST(shared AS DOUBLE) FROM l_pairs",
    "adj": "SELECT a AS note, b AS other FROM links UNION SELECT b, a FROM links",
    "a_adj": "SELECT a AS note, b AS other FROM l_edges UNION SELECT b, a FROM l_edges",
    "a_walk": "SELECT note, 0 AS depth FROM start UNION SELECT other, depth + 1 FROM a_walk JOIN a_adj USING (note) WHERE depth < 12",
    "a_levels": "SELECT note, min(depth) AS depth FROM a_walk GROUP BY note",
    "a_hops": "SELECT DISTINCT l.note_id AS start, n AS note FROM (SELECT DISTINCT note_id FROM lifted) l JOIN (SELECT note, other AS n FROM a_adj UNION SELECT x.note, y.other FROM a_adj x JOIN a_adj y ON y.note = x.other) ON note = l.note_id WHERE n != l.note_id",
    "start": "SELECT note_id AS note FROM named WHERE bare = '000000'",
    "walk": "SELECT note, 0 AS depth FROM start UNION SELECT other, depth + 1 FROM walk JOIN adj USING (note) WHERE depth < 40",
    "levels": "SELECT note, min(depth) AS depth FROM walk GROUP BY note",
    "reached": "SELECT l.note, l.depth, min(p.note) AS via FROM levels l LEFT JOIN adj ON adj.note = l.note LEFT JOIN levels p ON p.note = adj.other AND p.depth = l.depth - 1 GROUP BY l.note, l.depth",
    "trail": "SELECT note, depth, note AS path FROM reached WHERE depth = 0 UNION ALL SELECT r.note, r.depth, t.path || ' ' || r.note FROM trail t JOIN reached r ON r.via = t.note AND r.depth = t.depth + 1",
    "closure": "SELECT note, other FROM adj UNION SELECT c.note, adj.other FROM closure c JOIN adj ON adj.note = c.other",
    "parts": "SELECT note, min(other) AS component FROM closure GROUP BY note",
    "q_walk": "SELECT note_id AS note, 0 AS depth FROM l_seeds WHERE qid = 1 UNION SELECT other, depth + 1 FROM q_walk JOIN adj USING (note) WHERE depth < 40",
    "gathered": "SELECT note, depth, coalesce(worth, 0) AS worth, note_id IS NOT NULL AS is_seed FROM (SELECT note, min(depth) AS depth FROM q_walk GROUP BY note) LEFT JOIN (SELECT * FROM l_seeds WHERE qid = 1) ON note_id = note",
    "placed": "SELECT *, row_number() OVER (ORDER BY worth DESC, depth, note) AS rank FROM gathered",
    "lines": f"SELECT note_id, generate_subscripts(x, 1) AS line, unnest(x) AS s FROM (SELECT note_id, regexp_split_to_array(text, '{X.LINE_END}') AS x FROM linked)",
    "spans": f"SELECT note_id, line, generate_subscripts(x, 1) AS span, unnest(x) AS s FROM (SELECT note_id, line, string_split(regexp_replace({_unframed('s')}, '([.!?]){X.SPACE}', '\\1' || chr(1), 'g'), chr(1)) AS x FROM lines)",
    "lifted": f"SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY line, span) AS pos, s AS question FROM (SELECT note_id, line, span, {_unframed('s')} AS s FROM spans) WHERE ends_with(s, '?') AND regexp_matches(s, '[\\p{{L}}\\p{{N}}_]')",
    "two_hops": "SELECT DISTINCT l.note_id AS start, n AS note FROM (SELECT DISTINCT note_id FROM lifted) l JOIN (SELECT note, other AS n FROM adj UNION SELECT x.note, y.other FROM adj x JOIN adj y ON y.note = x.other) ON note = l.note_id WHERE n != l.note_id",
    "proposed": "SELECT note_id, pos, question, string_agg(note, ' ' ORDER BY note) AS answers FROM lifted JOIN two_hops ON start = note_id WHERE pos <= 3 GROUP BY note_id, pos, question",
    "every": f"SELECT note_id, unnest(regexp_extract_all(lower(text), '{X.WORD}')) AS term FROM notes",
    "l_every": f"SELECT DISTINCT note_id, unnest(regexp_extract_all(lower(text), '{X.WORD}')) AS term FROM linked",
    "sizes": "SELECT n.note_id, count(e.term) AS n_tokens FROM notes n LEFT JOIN every e ON e.note_id = n.note_id GROUP BY n.note_id",
    "freqs": "SELECT note_id, term, count(*) AS freq FROM every WHERE term IN (SELECT term FROM asked) GROUP BY note_id, term",
    "bm_idf": "SELECT term, CASE WHEN w <= 0 THEN 1e-6 ELSE w END AS idf FROM (SELECT term, ln(((SELECT count(*) FROM notes) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM freqs GROUP BY term)",
    "bm25": "SELECT qid, note_id, round(-sum(idf * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * n_tokens / (SELECT avg(n_tokens) FROM sizes)))), 9) AS score FROM freqs JOIN bm_idf USING (term) JOIN asked USING (term) JOIN sizes USING (note_id) GROUP BY qid, note_id",
    "q_terms": f"SELECT DISTINCT note_id, pos, term FROM (SELECT note_id, pos, unnest(regexp_extract_all(lower(question), '{X.WORD}')) AS term FROM proposed) WHERE length(term) >= {X.MIN_TERM} AND term NOT IN (SELECT term FROM l_stop)",
    "support": "SELECT note_id, pos, unnest(string_split(answers, ' ')) AS note FROM proposed",
    "judged": "SELECT note_id, pos, question, count(*) AS n_support, count(*) FILTER (note NOT IN (SELECT note_id FROM linked)) AS n_absent, count(*) FILTER (EXISTS (SELECT 1 FROM q_terms t JOIN l_every e ON e.term = t.term WHERE t.note_id = s.note_id AND t.pos = s.pos AND e.note_id = s.note)) AS n_found FROM support s JOIN proposed USING (note_id, pos) GROUP BY ALL",
    "home": "SELECT note_id, split_part(note_id, '/', 1) AS subject FROM linked",
    "across": "SELECT x.subject AS sa, y.subject AS sb FROM links JOIN home x ON x.note_id = a JOIN home y ON y.note_id = b",
    "touches": "SELECT subject, other, count(*) AS pairs FROM (SELECT sa AS subject, sb AS other FROM across WHERE sa != sb UNION ALL SELECT sb, sa FROM across WHERE sa != sb) GROUP BY subject, other",
    "across_all": "SELECT x.subject AS sa, y.subject AS sb FROM (SELECT DISTINCT a, b FROM l_edges) JOIN home x ON x.note_id = a JOIN home y ON y.note_id = b",
    "touches_all": "SELECT subject, other, count(*) AS pairs FROM (SELECT sa AS subject, sb AS other FROM across_all WHERE sa != sb UNION ALL SELECT sb, sa FROM across_all WHERE sa != sb) GROUP BY subject, other",
    "said": "SELECT doc_id AS answer_id, text, CASE doc_id % 4 WHEN 1 THEN replace(substr(text, 21, 30), ' ', '  ' || chr(10)) || '..' WHEN 2 THEN substr(text, 21, 30) || ' zzz' WHEN 3 THEN ' . ' ELSE substr(text, 21, 30) END AS answer FROM notes",
    "cited": f"SELECT doc_id // 2 AS answer_id, CASE WHEN doc_id % 5 = 3 THEN 'gone/' || {_PAD.format('doc_id')} ELSE note_id END AS path,"
    f" CASE doc_id % 5 WHEN 1 THEN 'zzz ' || substr(text, 11, 40) WHEN 2 THEN {_PAD.format('doc_id')} || ' ' || substr(text, 11, 40) WHEN 4 THEN replace(substr(text, 11, 40), ' ', ' ' || chr(9) || chr(10) || ' ') ELSE substr(text, 11, 40) END AS quote FROM notes",
    "checked": f"SELECT answer_id, path, quote, CASE WHEN note_id IS NULL THEN 'no such note' WHEN NOT contains({_flat('text')}, {_flat('quote')}) THEN 'not in the note' END AS finding FROM cited LEFT JOIN notes ON note_id = path",
    "summed": "SELECT answer_id, count(*) AS total, count(*) FILTER (finding IS NULL) AS correct, count(finding) AS fabricated FROM checked GROUP BY answer_id",
    "attempts": "SELECT *, CASE WHEN outcome IN ('answer', 'parts') THEN doc_id % 3 END AS total, CASE WHEN outcome IN ('answer', 'parts') THEN greatest(doc_id % 3 - doc_id % 2, 0) END AS correct, CASE WHEN outcome IN ('answer', 'parts') THEN least(doc_id % 3, doc_id % 2) END AS fabricated,"
    " CASE WHEN outcome IN ('answer', 'parts', 'thin') THEN doc_id % 5 END AS seeds, CASE WHEN outcome IN ('answer', 'parts', 'thin') THEN 5 - doc_id % 5 END AS through_edges, CASE WHEN outcome IN ('answer', 'parts', 'thin') THEN doc_id % 11 != 0 END AS agree"
    " FROM (SELECT doc_id, doc_id % 4 != 0 AS kept, CASE WHEN doc_id % 4 != 0 THEN CASE doc_id % 7 WHEN 1 THEN 'answer' WHEN 2 THEN 'parts' WHEN 3 THEN 'absent' WHEN 4 THEN 'thin' WHEN 5 THEN 'unconnected' WHEN 6 THEN 'answer' END END AS outcome FROM documents)",
    "report": "SELECT count(*) AS proposed, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, count(*) FILTER (outcome = 'answer') AS answers, count(*) FILTER (outcome = 'parts') AS parts, count(*) FILTER (outcome IN ('absent', 'unconnected', 'thin')) AS refusals,"
    " CAST(coalesce(sum(total), 0) AS BIGINT) AS citations, CAST(coalesce(sum(correct), 0) AS BIGINT) AS correct, count(*) FILTER (total = 0) AS uncorroborated, CAST(coalesce(sum(fabricated), 0) AS BIGINT) AS fabricated,"
    " CAST(coalesce(sum(seeds), 0) AS BIGINT) AS read_from_questions, CAST(coalesce(sum(through_edges), 0) AS BIGINT) AS read_through_edges, count(seeds) AS grounded, count(*) FILTER (agree) AS breadth_agreed FROM attempts",
    "replies": "SELECT doc_id AS answer_id, CASE WHEN doc_id % 11 = 0 THEN '{\"answer\": \"cut' WHEN doc_id % 13 = 0 THEN '[1, 2]' ELSE '{\"answer\":\"' || CASE WHEN doc_id % 7 = 1 THEN ' Not in note. ' ELSE 'Answer ' || doc_id END || '\",\"note1\":' || CASE doc_id % 5 WHEN 1 THEN '\"one\"' WHEN 2 THEN 'true' ELSE CAST(doc_id % 4 AS VARCHAR) END"
    " || ',\"quote1\":\"quote a ' || doc_id || '\",\"note2\":' || (doc_id % 3) || ',\"quote2\":' || CASE doc_id % 6 WHEN 0 THEN '\"  \"' WHEN 1 THEN '7' ELSE '\"quote b ' || doc_id || '\"' END || '}' END AS reply FROM documents",
    "objects": "SELECT answer_id, CASE WHEN json_valid(reply) AND json_type(reply) = 'OBJECT' THEN reply END AS o FROM (SELECT answer_id, CASE WHEN json_valid(reply) THEN reply ELSE 'null' END AS reply FROM replies)",
    "read_replies": "SELECT answer_id, coalesce(json_extract_string(o, '$.answer'), '') AS answer, list_filter([" + ", ".join(
        f"CASE WHEN json_type(o, '$.quote{n}') = 'VARCHAR' AND trim(json_extract_string(o, '$.quote{n}')) != '' THEN CASE WHEN json_type(o, '$.note{n}') = 'UBIGINT' AND CAST(json_extract_string(o, '$.note{n}') AS VARCHAR) IN ('1', '2') THEN CASE json_extract_string(o, '$.note{n}') WHEN '1' THEN 'a.md' ELSE 'b.md' END ELSE json_extract_string(o, '$.note{n}') END || '=' || json_extract_string(o, '$.quote{n}') END"
        for n in (1, 2)
    ) + "], lambda x: x IS NOT NULL) AS c FROM objects",
    "stats": "SELECT note_id, doc_id, CAST(1 AS DOUBLE) AS mtime, length(text) AS size FROM notes",
}

FINAL = {
    "note_terms": "SELECT n.note_id, count(term) AS n_terms FROM notes n LEFT JOIN words w ON w.note_id = n.note_id GROUP BY n.note_id",
    "corpus_vocabulary": "SELECT term FROM vocab",
    "language_scores": "SELECT lang, n_found, n_words, round(n_found / n_words, 9) AS score FROM scores",
    "detected_languages": "SELECT lang FROM detected",
    "stopword_list": "SELECT term FROM stop",
    "stop_fingerprint": "SELECT sha256(string_agg(term, chr(10) ORDER BY term)) AS fingerprint FROM stop",
    "term_idf": "SELECT term, df, round(idf, 9) AS idf FROM idf",
    "terms_in_every_note": "SELECT term, df FROM idf WHERE idf = 0",
    "note_names": f"SELECT note_id, lower(regexp_replace(regexp_extract(note_id, '[^/]*$'), '{X.EXTENSION}', '')) AS name, regexp_replace(note_id, '{X.EXTENSION}', '') AS stem, regexp_extract(note_id, '^(.*)/', 1) AS folder FROM notes",
    "flattened_texts": f"SELECT note_id, length(f) AS n_chars, md5(f) AS digest FROM (SELECT note_id, {_flat('text')} AS f FROM linked)",
    "lifted_questions": "SELECT * FROM lifted",
    "questions_first_three": "SELECT * FROM lifted WHERE pos <= 3",
    "link_targets": "SELECT * FROM targets",
    "link_resolution": "SELECT * FROM resolved",
    "link_edges": "SELECT * FROM links",
    "reach_all": "SELECT l.note, l.depth, min(p.note) AS via FROM a_levels l LEFT JOIN a_adj ON a_adj.note = l.note LEFT JOIN a_levels p ON p.note = a_adj.other AND p.depth = l.depth - 1 GROUP BY l.note, l.depth",
    "question_proposals_all": "SELECT note_id, pos, question, count(*) AS n_answers, md5(string_agg(note, ' ' ORDER BY note)) AS digest FROM lifted JOIN a_hops ON start = note_id WHERE pos <= 3 GROUP BY note_id, pos, question",
    "styled_targets": "SELECT * FROM s_targets",
    "styled_resolution": "SELECT * FROM s_resolved",
    "styled_dangling": "SELECT source, target FROM s_resolved WHERE note IS NULL",
    "styled_unconnected": "SELECT note_id FROM notes WHERE note_id NOT IN (SELECT unnest([a, b]) FROM s_links)",
    "styled_note_set": "SELECT note_id AS note FROM notes WHERE doc_id % 2 = 0 UNION SELECT a FROM s_links UNION SELECT b FROM s_links",
    "styled_profile": "SELECT subject, notes, coalesce(inside, 0) AS inside, coalesce(touches, '') AS touches FROM (SELECT split_part(note_id, '/', 1) AS subject, count(*) AS notes FROM notes GROUP BY 1)"
    " LEFT JOIN (SELECT sa AS subject, count(*) AS inside FROM s_across WHERE sa = sb GROUP BY sa) USING (subject) LEFT JOIN (SELECT subject, string_agg(other || ':' || pairs, ' ' ORDER BY other) AS touches FROM s_touches GROUP BY subject) USING (subject)",
    "dangling_links": "SELECT source, target FROM resolved WHERE note IS NULL",
    "href_dangling": "SELECT page_id, href FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE href NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)",
    "cooccurrence_edges": "SELECT a, b, 'cooccurrence' AS kind, CAST(shared AS DOUBLE) AS weight FROM pairs",
    "edges_by_kind": "SELECT kind, count(*) AS n_edges FROM l_edges GROUP BY kind",
    "graph_metrics": "SELECT (SELECT count(*) FROM linked) AS notes, (SELECT count(*) FROM l_edges) AS edges, p AS pairs, round(2 * p / (SELECT count(*) FROM linked), 9) AS density, c AS connected, (SELECT count(*) FROM linked) - c AS unconnected"
    " FROM (SELECT count(*) AS p FROM (SELECT DISTINCT a, b FROM l_edges)), (SELECT count(DISTINCT n) AS c FROM (SELECT unnest([a, b]) AS n FROM l_edges))",
    "unconnected_notes": "SELECT note_id FROM notes",
    "unconnected_notes_all": "SELECT note_id FROM notes WHERE note_id NOT IN (SELECT unnest([a, b]) FROM pairs)",
    "adjacency_degree": "SELECT note, count(*) AS degree FROM adj GROUP BY note",
    "stage_filter_link": "SELECT * FROM links",
    "stage_filter_similarity": "SELECT * FROM links WHERE kind = 'similarity'",
    "reach_unbounded": "SELECT * FROM reached",
    "reach_depth2": "SELECT * FROM reached WHERE depth <= 2",
    "reach_paths": "SELECT * FROM trail",
    "reach_truncated": "SELECT max(depth) > 2 AS truncated FROM levels",
    "reach_left_out": "SELECT note_id AS note FROM linked WHERE note_id NOT IN (SELECT note FROM levels WHERE depth <= 2)",
    "connected_components": "SELECT * FROM parts",
    "has_cycle": "SELECT n_notes, n_pairs, n_components, n_pairs - n_notes + n_components > 0 AS has_cycle FROM (SELECT count(*) AS n_notes, count(DISTINCT component) AS n_components FROM parts), (SELECT count(*) // 2 AS n_pairs FROM adj)",
    "triangles": "SELECT x.note AS a, x.other AS b, y.other AS c FROM adj x JOIN adj y ON y.note = x.other AND y.other > y.note JOIN adj z ON z.note = x.note AND z.other = y.other WHERE x.note < x.other",
    "short_cycles": "SELECT 3 AS length, x.note || ' ' || x.other || ' ' || y.other AS cycle FROM adj x JOIN adj y ON y.note = x.other AND y.other > y.note JOIN adj z ON z.note = x.note AND z.other = y.other WHERE x.note < x.other"
    " UNION ALL SELECT 4, w.note || ' ' || w.other || ' ' || x.other || ' ' || y.other FROM adj w JOIN adj x ON x.note = w.other AND x.other > w.note JOIN adj y ON y.note = x.other AND y.other > w.other JOIN adj z ON z.note = y.other AND z.other = w.note WHERE w.note < w.other AND y.other != w.note",
    "question_seeds": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY worth DESC, note_id) AS rank FROM seeds",
    "seeds_by_strongest": "SELECT qid, note_id, strongest, row_number() OVER (PARTITION BY qid ORDER BY strongest DESC, note_id) AS rank FROM seeds",
    "seeds_agree": "SELECT *, by_worth = by_strongest AS agree FROM leaders",
    "evidence_topk": "SELECT * FROM placed WHERE rank <= 5",
    "withheld_notes": "SELECT note, depth, worth FROM placed WHERE rank > 5",
    "grounding": "SELECT count(*) FILTER (is_seed) AS seeds, count(*) FILTER (NOT is_seed) AS through_edges, (SELECT by_worth = by_strongest FROM l_leaders WHERE qid = 1) AS seeds_agree FROM placed WHERE rank <= 5 HAVING count(*) > 0",
    "styled_fork": "SELECT *, CASE WHEN n_seeds = 0 THEN 'absent' WHEN n_beyond = 0 THEN 'unconnected' WHEN n_beyond < 2 THEN 'thin' ELSE 'answerable' END AS outcome FROM (SELECT q.qid, count(DISTINCT s.note_id) AS n_seeds, count(DISTINCT coalesce(c.other, s.note_id)) AS n_reached,"
    " count(DISTINCT coalesce(c.other, s.note_id)) - count(DISTINCT s.note_id) AS n_beyond FROM questions q LEFT JOIN s_seeds s ON s.qid = q.qid LEFT JOIN s_closure c ON c.note = s.note_id GROUP BY q.qid)",
    "refusal_fork": "SELECT *, CASE WHEN n_seeds = 0 THEN 'absent' WHEN n_beyond = 0 THEN 'unconnected' WHEN n_beyond < 2 THEN 'thin' ELSE 'answerable' END AS outcome FROM (SELECT q.qid, count(DISTINCT s.note_id) AS n_seeds, count(DISTINCT coalesce(c.other, s.note_id)) AS n_reached,"
    " count(DISTINCT coalesce(c.other, s.note_id)) - count(DISTINCT s.note_id) AS n_beyond FROM questions q LEFT JOIN l_seeds s ON s.qid = q.qid LEFT JOIN closure c ON c.note = s.note_id GROUP BY q.qid)",
    "bm25_search": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, note_id) AS rank FROM bm25",
    "bm25_match_set": "SELECT qid, note_id FROM bm25",
    "reply_citations": "SELECT answer_id, answer, CASE WHEN regexp_replace(lower(trim(answer)), '[.!]+$', '') = 'not in note' THEN 0 ELSE len(c) END AS n_citations, CASE WHEN regexp_replace(lower(trim(answer)), '[.!]+$', '') = 'not in note' THEN '' ELSE array_to_string(c, '|') END AS citations FROM read_replies",
    "copied_answers": f"SELECT answer_id, said != '' AND contains({_flat('text')}, said) AS copied FROM (SELECT *, regexp_replace({_flat('answer')}, '[.]+\\z', '') AS said FROM said)",
    "citation_check": "SELECT * FROM checked",
    "citation_summary": "SELECT *, total > 0 AND fabricated = 0 AS allowed FROM summed",
    "guard_outcome": "SELECT answer_id, CASE WHEN fabricated = 0 THEN 'answer' WHEN correct > 0 THEN 'parts' ELSE 'thin' END AS outcome FROM summed",
    "fallback_parts": "SELECT answer_id, path, quote FROM checked JOIN summed USING (answer_id) WHERE fabricated > 0 AND finding IS NULL",
    "question_proposals": "SELECT * FROM proposed",
    "first_proposals": "SELECT note_id, pos, question FROM proposed ORDER BY note_id, pos LIMIT 20",
    "question_verdicts": "SELECT *, CASE WHEN n_support = 0 THEN 'no support' WHEN n_absent > 0 THEN 'support missing' WHEN n_found = n_support THEN 'search finds it' ELSE 'search falls short' END AS reason, CASE WHEN n_support > 0 AND n_absent = 0 AND n_found < n_support THEN 'kept' ELSE 'dropped' END AS verdict FROM judged",
    "subject_counts": "SELECT subject, count(*) AS notes, (SELECT count(*) FROM across WHERE sa = subject AND sb = subject) AS inside FROM home GROUP BY subject",
    "subject_touches": "SELECT * FROM touches",
    "subject_listing": "SELECT subject, string_agg(other, ', ' ORDER BY k) FILTER (k <= 4) AS listed, count(*) FILTER (k > 4) AS more FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY pairs DESC, other) AS k FROM touches) GROUP BY subject",
    "subject_counts_all": "SELECT subject, count(*) AS notes, (SELECT count(*) FROM across_all WHERE sa = subject AND sb = subject) AS inside FROM home GROUP BY subject",
    "subject_touches_all": "SELECT * FROM touches_all",
    "subject_listing_all": "SELECT subject, string_agg(other, ', ' ORDER BY k) FILTER (k <= 4) AS listed, count(*) FILTER (k > 4) AS more FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY pairs DESC, other) AS k FROM touches_all) GROUP BY subject",
    "kind_shares": "SELECT kind, CAST(round_even(100.0 * count(*) / (SELECT count(*) FROM l_edges), 0) AS BIGINT) AS percent FROM l_edges GROUP BY kind",
    "related_notes": "SELECT note_id, count(*) AS degree FROM (SELECT unnest([a, b]) AS note_id FROM (SELECT DISTINCT a, b FROM l_edges)) GROUP BY note_id",
    "eval_report": "SELECT * FROM report",
    "eval_rates": "SELECT m AS measured, kept - m AS unasked, round(coalesce(answers / nullif(m, 0), 0), 9) AS answer_rate, round(coalesce(correct / nullif(citations, 0), 0), 9) AS citation_rate, round(coalesce(read_through_edges / nullif(read_from_questions + read_through_edges, 0), 0), 9) AS edge_share, kept >= 10 AS is_a_comparison FROM (SELECT *, answers + parts + refusals AS m FROM report)",
    "refresh_diff": "SELECT coalesce(o.note_id, n.note_id) AS note_id, CASE WHEN o.note_id IS NULL THEN 'added' WHEN n.note_id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM (SELECT * FROM stats WHERE doc_id % 10 != 3) o FULL JOIN (SELECT note_id, mtime, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size FROM stats WHERE doc_id % 10 != 7) n ON n.note_id = o.note_id WHERE o.note_id IS NULL OR n.note_id IS NULL OR o.size != n.size OR o.mtime != n.mtime",
    "refreshed_edges": "SELECT a, b, 'cooccurrence' AS kind, CAST(shared AS DOUBLE) AS weight FROM pairs",
    "session_messages": "SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id",
}


def _needed(sql: str, have: dict[str, None]) -> None:
    for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,) \(?([a-z0-9_]+)\b", sql)):
        if name in TABLES and name not in have and TABLES[name] is not sql:
            _needed(TABLES[name], have)
            have.setdefault(name)


def statement(sql: str) -> str:
    """A query with the tables that it names, each before those that use it."""
    have: dict[str, None] = {}
    _needed(sql, have)
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({TABLES[name]})" for name in have) + " " + sql if have else sql


ORACLE_SQL = {name: statement(sql) for name, sql in FINAL.items()}
