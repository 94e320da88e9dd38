"""The pipeline's stages and the registered queries against plain Python and SQL, at sf0.001 and on odd rows."""

import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import chat, decontam, neardup, queries, tokens, warc
from quillgraph.llm.oracle import ORACLE_SQL
from tests.llm.test_brute_force import SF, docs, jaccard_components, plain_ftrl, plain_places, spark_hash, texts  # noqa: F401


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def kept_by_score(spark, rows):
    """Whether plain Python, trained on the same rows in the same order, scores rows (id, text) below one half."""
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            labels[r["doc_id"]] = max(r["toxic"], labels.get(r["doc_id"], 0))
    first = {}
    for i, t in rows:
        first.setdefault(i, t or "")
    ids = sorted((i for i in first if i in labels), key=lambda i: (spark_hash(i), i))
    weights, bias = plain_ftrl([plain_places(first[i]) for i in ids], [labels[i] for i in ids])
    return [bias + sum(weights.get(p, 0.0) for p in plain_places(t)) < 0 for _, t in rows]


def contaminated(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    present = set(w)
    for item in items:
        if len(set(item) & present) < 0.8 * len(set(item)):
            continue
        k = min(5, len(item))
        mine = Counter(item[a : a + k] for a in range(len(item) - k + 1))
        for s in range(len(w) - len(item) + 1):
            shared = sum((Counter(tuple(w[a : a + k]) for a in range(s, s + len(item) - k + 1)) & mine).values())
            if 100 * shared >= 80 * (2 * sum(mine.values()) - shared):
                return True
    return False


KINDS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 0, 20), ("hex", "[0-9a-f]+", 0, 0, 24), ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, 15), ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 20),
    ("pem", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ )?PRIVATE KEY-----)?", 0, 0, 20),
]


def redacted(text):
    if text is None:
        return None
    found = [(m.start(), -m.end(), kind) for kind, pattern, flags, group, least in KINDS for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    out, at = "", 0
    for a, b, kind in sorted(found, key=lambda x: x[:2]):
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, -b)
    return out + text[at:]


def test_pipeline(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
    rows = [r for r, keep in zip(rows, kept_by_score(spark, [r[:2] for r in rows]), strict=True) if keep]
    rows = [r for r, c in zip(rows, jaccard_components([(i, t or "", s) for i, t, s in rows], 80), strict=True) if c[3]]
    items = [tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not contaminated(r[1], [x for x in items if x])]
    rows = [(i, redacted(t), s) for i, t, s in rows]
    out = corpus_pipeline.run(spark, SF)
    assert set(frame.columns) <= set(out.columns)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and (r["n_chars"] == len(r["text"] or ""))
        taken[r["source"]] += r["taken"]
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= max(0.03 * r["target"], 2 * 64)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, docs, stage):  # noqa: F811
    """Nulls, empty and long texts, repeated rows and extra columns, some of them named as the stages name theirs."""
    run = dict(corpus_pipeline.STAGES)[stage]
    own = docs.withColumns({"score": F.lit("mine"), "contaminated": F.lit(7), "h": F.lit("h"), "n_shingles": F.lit(None).cast("string"), "taken_by": F.lit(1)})
    out = run(spark, own, SF)
    if stage != "mixing":
        assert out.columns == own.columns and [t for _, t in out.dtypes] == [t for _, t in own.dtypes]
        assert out.where("score != 'mine' OR contaminated != 7 OR h != 'h'").isEmpty()
    n = {"secrets": own.count(), "mixing": own.count()}.get(stage)
    assert n is None and 0 < out.count() <= own.count() or out.count() == n
    empty = run(spark, own.limit(0), SF)
    assert empty.isEmpty() and set(own.columns) - {"size"} <= set(empty.columns)


def test_near_copies_leave_one_row_each(spark, docs, texts):  # noqa: F811
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    want = Counter()
    seen = set()
    for (i, t, _), c in zip(texts, jaccard_components(texts, 80), strict=True):
        if c[3] and (c[1] == 0 or (i, t) not in seen):
            seen.add((i, t))
            want[i, t] += 1
    assert Counter((r["doc_id"], r["text"] or "") for r in kept) == want


def test_every_query_runs_over_whole_tables(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    per_row = {"op3_secret_scans": "documents", "op4_warc": "pages", "op5_license_scans": "documents", "op6_mixing": "documents", "op7_quality_rules": "documents", "op8_toxicity": "documents", "op9_near_dedup": "documents", "op10_token_counts": "documents"}
    for name, table in per_row.items():
        assert queries.QUERIES[name](spark, SF).count() == n[table], name


def test_extra_columns_that_clash(spark):
    clash = {c: F.lit("clash") for c in ("digest", "n", "winner", "refers_to", "pos", "prefix", "a", "b", "n_copies", "n_tokens", "score")}
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert warc.digest(spark, pages.withColumns(clash)).exceptAll(warc.digest(spark, pages)).isEmpty()
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert chat.chat(turns.withColumns(clash)).exceptAll(chat.chat(turns)).isEmpty()
    assert chat.chat(turns.limit(0)).isEmpty()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    assert tokens.count(spark, frame.withColumns(clash)).exceptAll(tokens.count(spark, frame)).isEmpty()
    assert neardup.digest(spark, frame.withColumns(clash)).exceptAll(neardup.digest(spark, frame)).isEmpty()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = decontam.matches(spark, frame.withColumns(clash), bench.withColumns(clash))
    assert found.exceptAll(decontam.matches(spark, frame, bench)).isEmpty()
    assert isinstance(decontam.search(pa.array(["x"]), {}), list)
