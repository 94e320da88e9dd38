"""Secret scans by an incremental blob ledger.

Every version of every path is content-addressed (SHA-256). The ledger remembers which pairs of
blob and rule version have been scanned and what was found; a run scans only pairs that it has not
seen, one copy of each blob, appends them to the ledger, and joins the findings back to all paths.

Spans are of code points, end exclusive. Null content counts as empty, null paths are kept, equal
rows each get their findings, and columns beside ``path``, ``version`` and ``content`` are ignored
or carried by the caller; an empty table gives an empty result. Texts of any length are scanned whole, by
patterns that take time in proportion to the text. Findings that start together go by the order of the rules. Rows that are equal
in path, version and content stand for each other: any of them is the copy that is scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

_ANY = re.ASCII | re.IGNORECASE
#: (kind, rule version, pattern, group that must have so many characters, those). Base kinds come first.
RULES = [
    ("assign", 1, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ANY), 2, 6),
    ("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", 1, re.compile(r"[0-9a-f]+"), 0, 24),
    ("github", 1, re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    ("slack", 1, re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    ("google", 1, re.compile(r"AIza[A-Za-z0-9_-]{35}"), 0, 39),
    ("jwt", 1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 20),  # searched by _web_tokens
    ("pem", 1, re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"), 0, 20),
]
BASE = ("assign", "access", "hex")
#: Equal to the rules above for matches that pass, and faster where most matches would fail.
_FAST = {"access": re.compile(r"AKIA[A-Z0-9]{16,}"), "hex": re.compile(r"[0-9a-f]{24,}")}
#: A run of token characters from where it begins, without a second look at any of them: what stands before its first eyJ, then the token.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")
FINDINGS = "array<struct<kind:int,start:int,stop:int>>"
BLOB = "blob string, kind string, rule_version int"


def _web_tokens(text: str) -> Iterator[re.Match]:
    """What the rule's pattern finds, in linear time: that pattern reads on from each eyJ of a long run, to no end."""
    return _TOKEN.finditer(text) if ".eyJ" in text else iter(())


def spans(text: str, kinds: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(index of the rule, start, end) of all findings, by start and then rule."""
    out = []
    for k, (kind, _, pattern, group, least) in enumerate(RULES):
        if kinds is None or kind in kinds:
            if kind == "jwt":
                out += [(k, m.start(1), m.end(1)) for m in _web_tokens(text)]
                continue
            for m in _FAST.get(kind, pattern).finditer(text):
                if m.end(group) - m.start(group) >= least:
                    out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [r[0] for r in RULES]
    kind_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    scanned: set[str] = set()
    for batch in batches:
        found, fresh = [], []
        for i, (blob, text, rules) in enumerate(zip(batch["blob"].to_pylist(), batch["content"], batch["rules"], strict=True)):
            if blob in scanned:  # rows that are equal in path, version and content
                continue
            scanned.add(blob)
            fresh.append(i)
            own = {kinds[i] for i in rules.as_py()}
            found.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans(text.as_py() or "", own)])
        at = pa.array(fresh, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["blob"].take(at), batch["rules"].take(at), pa.array(found, kind_type)], ["blob", "rules", "findings"])


def ledger_schema() -> str:
    return f"blob string, rules array<int>, versions array<int>, findings {FINDINGS}"


def scan_versions(spark: SparkSession, versions: DataFrame, ledger: str, scratch: Scratch) -> DataFrame:
    """``versions`` (path, version, content) with their blob and its findings; the ledger grows by what was not in it.

    One row per row of ``versions``: path, version, blob, findings (array of kind index, start, stop).
    """
    small_batches(spark)
    rows = versions.select("path", "version", F.coalesce(F.col("content"), F.lit("")).alias("content"))
    rows = rows.withColumn("blob", F.sha2("content", 256))
    every = scratch.save(rows.select("path", "version", "blob"), "versions")  # texts are read for their digests, and where a blob is scanned
    try:
        known = spark.read.schema(ledger_schema()).parquet(ledger)
    except Exception as e:  # noqa: BLE001  no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], ledger_schema())
    rule_ids = F.array(*[F.lit(i) for i in range(len(RULES))])
    done = known.select("blob", F.explode(F.arrays_zip("rules", "versions")).alias("r")).select("blob", "r.rules", "r.versions")
    now = F.when(F.lit(False), F.lit(0))
    for i, r in enumerate(RULES):
        now = now.when(F.col("rules") == i, F.lit(r[1]))
    done = done.where(F.col("versions") == now).groupBy("blob").agg(F.collect_set("rules").alias("had"))
    # One copy of each blob is scanned: the first path and version that hold it. Only digests are shuffled to find it.
    keys = every.select("blob", F.struct(F.coalesce(F.col("path"), F.lit("")).alias("p"), F.coalesce(F.col("version"), F.lit(0)).alias("v")).alias("at"))
    first = keys.groupBy("blob").agg(F.min("at").alias("at"))
    todo = (
        first.join(done, "blob", "left")
        .select("blob", "at", F.array_except(rule_ids, F.coalesce("had", F.array().cast("array<int>"))).alias("rules"))
        .where(F.size("rules") > 0)
    )
    todo = scratch.save(todo, "unseen")
    content = rows.select(F.col("blob"), F.coalesce(F.col("path"), F.lit("")).alias("p"), F.coalesce(F.col("version"), F.lit(0)).alias("v"), "content")
    want = todo.select("blob", F.col("at.p").alias("p"), F.col("at.v").alias("v"), "rules")
    picked = content.join(want, ["p", "v", "blob"])
    fresh = picked.select("blob", "rules", "content").mapInArrow(_scan, f"blob string, rules array<int>, findings {FINDINGS}")
    rule_version = F.transform("rules", lambda i: F.element_at(F.array(*[F.lit(r[1]) for r in RULES]), i + 1))
    fresh.select("blob", "rules", rule_version.alias("versions"), "findings").write.mode("append").parquet(ledger)
    found = (
        spark.read.schema(ledger_schema()).parquet(ledger)
        .where(F.size("findings") > 0)
        .select("blob", F.explode(F.arrays_zip(F.col("rules"), F.col("versions"))).alias("r"), "findings")
        .select("blob", F.col("r.rules").alias("rule"), F.col("r.versions").alias("versions"), "findings")
        .withColumnRenamed("rule", "rules").where(F.col("versions") == now)
        .select("blob", F.explode(F.filter("findings", lambda x: x["kind"] == F.col("rules"))).alias("x"))
        .distinct()
        .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("x.start", "x.kind", "x.stop"))).alias("sorted"))
        .select("blob", F.transform("sorted", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("findings"))
    )
    back = every.join(found, "blob", "left")
    return back.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def spelled(findings: F.Column | str, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the findings, comma-joined, as one string."""
    names = F.array(*[F.lit(r[0]) for r in RULES])
    base = [i for i, r in enumerate(RULES) if kinds is None or r[0] in kinds]
    kept = F.filter(findings, lambda x: x["kind"].isin(base))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Findings of every document: counts of the base kinds, SHA-256 of the base spans, all spans.

    A row per row of ``docs``; a null text has none. Documents are versions 0 of a path that is their id.
    """
    scratch = Scratch(spark, "secrets")
    versions = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))
    found = scan_versions(spark, versions, f"{scratch.root}/ledger", scratch)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == BASE.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").cast("long").alias("doc_id"), *[count(k) for k in BASE],
        F.sha2(spelled("findings", BASE), 256).alias("base_sha256"), spelled("findings").alias("spans"),
    )


def _hidden(text: str, found: list[dict]) -> str:
    parts, at = [], 0
    for x in sorted(found, key=lambda x: (x["start"], -x["stop"])):
        if x["start"] >= at:
            parts += [text[at : x["start"]], f"[{RULES[x['kind']][0]}]"]
        at = max(at, x["stop"])
    return "".join([*parts, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch[n] for n in batch.schema.names if n != "__findings"}
        some = np.flatnonzero(batch["__findings"].is_valid().to_numpy(zero_copy_only=False))
        if len(some):
            at = pa.array(some)
            new = [_hidden(*x) for x in zip(batch["text"].take(at).to_pylist(), batch["__findings"].take(at).to_pylist(), strict=True)]
            mask = np.zeros(batch.num_rows, bool)
            mask[some] = True
            columns["text"] = pc.replace_with_mask(batch["text"], pa.array(mask), pa.array(new, batch["text"].type))
            if "n_chars" in columns:
                kind = batch["n_chars"].type
                columns["n_chars"] = pc.replace_with_mask(batch["n_chars"], pa.array(mask), pa.array([len(x) for x in new], pa.int64()).cast(kind))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with each secret replaced by its kind in brackets; ``n_chars``, where there is one, follows."""
    scratch = Scratch(spark, "redact")
    versions = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))
    found = scan_versions(spark, versions, f"{scratch.root}/ledger", scratch).where(F.size("findings") > 0)
    found = scratch.save(found.select(F.col("blob").alias("__blob"), F.col("findings").alias("__findings")).dropDuplicates(["__blob"]), "found")
    keyed = docs.withColumn("__blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, "__blob", "left").drop("__blob")
    return keyed.mapInArrow(_redact, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
