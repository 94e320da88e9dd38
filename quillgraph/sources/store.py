"""The store of a corpus: versioned Parquet tables that grow by what changed.

Layout below the root: ``<table>/v=<n>`` for notes, unreadable, terms, targets, cooccurrence and gone
(the ids that version n took out or replaced), ``links/v=<n>``, ``dangling/v=<n>`` and ``stopwords/v=<n>``
whole, and ``meta/v=<n>``, written last: a version without it does not exist. A row is live if no later version
names its note in ``gone``; an edge if neither of its ends is named. So a refresh writes as much as
changed, reads no text of other notes, and a reader of an older version is not disturbed.

A refresh gives the tables that a rebuild would give. Links are resolved anew each time, from stored
targets, since a note that comes or goes can change what any link names. Stop words are a fact about
the whole corpus: when they change, all co-occurrence is derived again from stored terms. Questions
read stored terms and stop words, no texts but those of their evidence.

Before its first change beyond COMPACT_AFTER versions a refresh writes all live rows as one version.
The versions since the former base stay until the next such time, for readers that hold them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stopwords import Lists
from ..operators import cooccurrence, links, refresh, terms
from ..scratch import Scratch, delete
from . import branch as files

DERIVATION = 1
#: So many versions are read together at most.
COMPACT_AFTER = 32
SCHEMAS = {
    "notes": "note_id string, mtime double, size bigint, text string",
    "unreadable": "note_id string, mtime double, size bigint, reason string",
    "terms": "note_id string, terms array<string>",
    "targets": "source string, target string",
    "cooccurrence": "a string, b string, kind string, weight double",
    "links": "a string, b string, kind string, weight double",
    "dangling": "source string, target string",
    "stopwords": "term string",
    "gone": "note_id string",
    "meta": "derivation int, stop string, base int, edge_base int",
}


class StaleGraph(RuntimeError):
    """The store does not match the folder it was made of."""


@dataclass
class Read:
    """What a refresh did, as tables: ``changes`` (note_id, status), ``unreadable`` (note_id, reason), ``dangling`` (source, target).

    ``counts`` has a number for each status; ``rebuilt`` says that everything was derived.
    """

    counts: dict[str, int] = field(default_factory=dict)
    changes: DataFrame | None = None
    unreadable: DataFrame | None = None
    dangling: DataFrame | None = None
    rebuilt: bool = False

    @property
    def quiet(self) -> bool:
        return not self.counts and not self.rebuilt

    def names(self, status: str, most: int | None = None) -> list[str]:
        """Ids of one status in order, the first ``most``."""
        if self.changes is None:
            return []
        rows = self.changes.where(F.col("status") == status).select("note_id").orderBy("note_id")
        return [r[0] for r in (rows if most is None else rows.limit(most)).collect()]


class Store:
    def __init__(self, spark: SparkSession, root: str, branch: str | None = None, lists: Lists | None = None, derivation: int = DERIVATION):
        self.spark, self.root, self.branch, self.lists, self.derivation = spark, root if "://" in root else f"file://{root}", branch, lists, derivation

    # Versions

    def _path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v={version}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str = "meta") -> list[int]:
        """Complete versions of a table, in order."""
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        found = [x.getPath() for x in fs.listStatus(p)]
        jvm = self.spark.sparkContext._jvm
        return sorted(int(x.getName()[2:]) for x in found if x.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def meta(self) -> dict | None:
        done = self.versions()
        if not done:
            return None
        row = self.spark.read.schema(SCHEMAS["meta"]).parquet(self._path("meta", done[-1])).first()
        return row.asDict() | {"version": done[-1]}

    def derivation_version(self) -> int | None:
        return (self.meta() or {}).get("derivation")

    def stop_fingerprint(self) -> str:
        return (self.meta() or {}).get("stop", "")

    # Tables

    def _parts(self, table: str, since: int, upto: int) -> DataFrame:
        """Rows of the complete versions since .. upto with their version; ``upto`` may be in the making."""
        out, done = None, {*self.versions(), upto}
        for v in self.versions(table):
            if since <= v <= upto and v in done:
                part = self.spark.read.schema(SCHEMAS[table]).parquet(self._path(table, v)).withColumn("v", F.lit(v))
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], f"{SCHEMAS[table]}, v int")

    def _live(self, table: str, ends: tuple[str, ...], base: str = "base", at: dict | None = None) -> DataFrame:
        at = at or self.meta()
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = self._parts(table, at[base], at["version"])
        if at["version"] > at[base]:
            gone = self._parts("gone", at[base] + 1, at["version"]).groupBy("note_id").agg(F.max("v").alias("until"))
            for end in ends:
                rows = rows.join(gone.select(F.col("note_id").alias(end), "until"), end, "left").where("until IS NULL OR until <= v").drop("until")
        return rows.drop("v")

    def notes(self) -> DataFrame:
        """(note_id, text)."""
        return self._live("notes", ("note_id",)).select("note_id", "text")

    def note_ids(self) -> DataFrame:
        return self._live("notes", ("note_id",)).select("note_id")

    def note_text(self, note_id: str) -> str | None:
        row = self.notes().where(F.col("note_id") == note_id).first()
        return None if row is None else row["text"]

    def edges(self) -> DataFrame:
        """(a, b, kind, weight)."""
        at = self.meta()
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS["links"])
        stated = self.spark.read.schema(SCHEMAS["links"]).parquet(self._path("links", at["version"]))
        return stated.unionByName(self._live("cooccurrence", ("a", "b"), "edge_base", at).select(stated.columns))

    def dangling(self) -> DataFrame:
        at = self.meta()
        return self.spark.createDataFrame([], SCHEMAS["dangling"]) if at is None else self.spark.read.schema(SCHEMAS["dangling"]).parquet(self._path("dangling", at["version"]))

    def _stats(self, at: dict) -> DataFrame:
        """Stat keys of all files that were seen, readable or not."""
        keys = ["note_id", "mtime", "size"]
        return self._live("notes", ("note_id",), at=at).select(keys).unionByName(self._live("unreadable", ("note_id",), at=at).select(keys))

    def postings(self) -> DataFrame:
        """(note_id, term) as ``terms.postings`` makes them of the notes."""
        return terms.postings_of(self._live("terms", ("note_id",)), self.stop())

    def stop(self) -> DataFrame:
        """(term) of the version in force; derived from stored terms where an earlier layout has none."""
        at = self.meta()
        if at is not None and at["version"] in self.versions("stopwords"):
            return self.spark.read.schema(SCHEMAS["stopwords"]).parquet(self._path("stopwords", at["version"]))
        words = self._live("terms", ("note_id",)).select(F.explode("terms").alias("term")).distinct()
        return terms.stop_terms(words, self.lists)

    # Keeping up

    def current(self, entries: DataFrame | None = None) -> bool:
        at = self.meta()
        if at is None or at["derivation"] != self.derivation:
            return False
        return refresh.is_current(self._stats(at), entries if entries is not None else files.scan(self.spark, self.branch))

    def answer_from_current_graph(self) -> DataFrame:
        if not self.current():
            raise StaleGraph("the folder has changed since the graph was derived")
        return self.edges()

    def refresh(self, entries: DataFrame | None = None) -> Read:
        """Brings the store to the state of ``entries`` (note_id, path, mtime, size), by default of the folder."""
        entries = entries if entries is not None else files.scan(self.spark, self.branch)
        at = self.meta()
        if at is None or at["derivation"] != self.derivation:
            return self._write(entries, None, None)
        scratch = Scratch(self.spark, "refresh")
        moved = scratch.save(refresh.diff(self._stats(at), entries), "diff")
        if moved.isEmpty():
            return Read()
        if at["version"] - at["base"] >= COMPACT_AFTER:
            self.compact(at["base"])
            at = self.meta()
        return self._write(entries, at, moved)

    def _write(self, entries: DataFrame, at: dict | None, moved: DataFrame | None) -> Read:
        spark, scratch = self.spark, Scratch(self.spark, "refresh")
        version = max(self.versions("notes") + self.versions() + [0]) + 1
        put = lambda df, table: df.write.mode("overwrite").parquet(self._path(table, version))
        get = lambda table: spark.read.schema(SCHEMAS[table]).parquet(self._path(table, version))
        todo = entries if moved is None else entries.join(moved.where("status != 'removed'"), "note_id", "left_semi")
        opened = scratch.save(files.read(todo), "read")
        put(files.notes(opened).select("note_id", "mtime", "size", "text"), "notes")
        put(files.unreadable(opened).select("note_id", "mtime", "size", "reason"), "unreadable")
        fresh = get("notes")
        put(fresh.select("note_id", X.terms(F.col("text")).alias("terms")), "terms")
        put(links.targets(fresh), "targets")
        if moved is not None:
            put(moved.select("note_id"), "gone")
        base = version if at is None else at["base"]
        now = {"version": version, "base": base, "edge_base": version if at is None else at["edge_base"]}
        ids = scratch.save(self._live("notes", ("note_id",), at=now).select("note_id"), "ids")
        words = self._live("terms", ("note_id",), at=now).select("note_id", F.explode("terms").alias("term"))
        put(terms.stop_terms(words.select("term").distinct(), self.lists).coalesce(1), "stopwords")
        stop = get("stopwords")
        mark = terms.fingerprint(stop).first()[0]
        content = words.join(F.broadcast(stop), "term", "left_anti").select("note_id", "term")
        found = scratch.save(links.resolved(self._live("targets", ("source",), at=now), ids), "resolved")
        put(links.edges(found), "links")
        put(links.dangling(found), "dangling")
        whole = at is None or mark != at["stop"]
        pairs = cooccurrence.shared_terms(content, scratch, dirty=None if whole else moved.select("note_id"))
        put(cooccurrence.edges(pairs), "cooccurrence")
        if whole:
            now["edge_base"] = version
        put(spark.createDataFrame([(self.derivation, mark, now["base"], now["edge_base"])], SCHEMAS["meta"]).coalesce(1), "meta")
        return self._told(moved, version, fresh)

    def _told(self, moved: DataFrame | None, version: int, fresh: DataFrame) -> Read:
        get = lambda table: self.spark.read.schema(SCHEMAS[table]).parquet(self._path(table, version))
        changes = moved if moved is not None else fresh.select("note_id", F.lit("added").alias("status"))
        counts = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
        return Read(counts, changes, get("unreadable").select("note_id", "reason"), get("dangling"), moved is None)

    def compact(self, keep: int | None = None) -> None:
        """Writes all live rows as one version and drops the older ones, but for those from ``keep`` on."""
        at = self.meta()
        if at is None or at["version"] == at["base"]:
            return
        version = at["version"] + 1
        ends = {"notes": ("note_id",), "unreadable": ("note_id",), "terms": ("note_id",), "targets": ("source",), "cooccurrence": ("a", "b")}
        for table, keys in ends.items():
            self._live(table, keys, "edge_base" if table == "cooccurrence" else "base", at).write.mode("overwrite").parquet(self._path(table, version))
        for table in ("links", "dangling"):
            self.spark.read.schema(SCHEMAS[table]).parquet(self._path(table, at["version"])).write.mode("overwrite").parquet(self._path(table, version))
        self.stop().write.mode("overwrite").parquet(self._path("stopwords", version))
        self.spark.createDataFrame([(at["derivation"], at["stop"], version, version)], SCHEMAS["meta"]).coalesce(1).write.mode("overwrite").parquet(self._path("meta", version))
        for table in SCHEMAS:
            for v in self.versions(table):
                if v < (version if keep is None else min(version, keep)):
                    delete(self.spark, self._path(table, v))
