"""Folders of text files as notes.

``scan`` lists a folder without opening a file: names that begin with a dot are left out with all
below them, links to folders are not followed, links to files are, and only regular files count.
``read`` opens files in tasks, not on the driver; what is not strict UTF-8 or holds a NUL is no note
and is reported with the reason.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "note_id string, path string, mtime double, size bigint"
FILES_PER_TASK = 256


def _listed(branch: str) -> Iterator[tuple[str, str, float, int]]:
    seen: set[tuple[int, int]] = set()
    for where, folders, files in os.walk(branch, followlinks=False):
        own = os.stat(where)
        if (own.st_dev, own.st_ino) in seen:
            folders.clear()
            continue
        seen.add((own.st_dev, own.st_ino))
        folders[:] = sorted(d for d in folders if not d.startswith("."))
        for name in files:
            path = os.path.join(where, name)
            try:
                s = os.stat(path)
            except OSError:
                continue
            if not name.startswith(".") and stat.S_ISREG(s.st_mode):
                yield os.path.relpath(path, branch).replace(os.sep, "/"), path, s.st_mtime, s.st_size


def scan(spark: SparkSession, branch: str) -> DataFrame:
    """(note_id, path, mtime, size) of every file of the folder, by path."""
    rows = sorted(_listed(os.path.abspath(branch)))
    return spark.createDataFrame(rows, ENTRY).repartition(max(1, len(rows) // FILES_PER_TASK), "note_id")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            content = reason = None
            try:
                with open(row["path"], "rb") as f:
                    content = f.read()
            except OSError as e:
                reason = f"could not read: {e.strerror}"
            columns = [pa.array([row["note_id"]], pa.string()), pa.array([row["mtime"]], pa.float64()), pa.array([row["size"]], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([content], pa.binary()), pa.array([reason], pa.string())], ["note_id", "mtime", "size", "content", "reason"])


def read(entries: DataFrame) -> DataFrame:
    """(note_id, mtime, size, text, reason): a text, or a reason why there is none."""
    raw = entries.mapInArrow(_opened, "note_id string, mtime double, size bigint, content binary, reason string")
    whole = F.col("content").cast("string")
    fault = F.when(~F.is_valid_utf8(whole), "not text: not UTF-8").when(F.instr(whole, "\x00") > 0, "not text: it holds a NUL")
    return raw.select("note_id", "mtime", "size", F.coalesce("reason", fault).alias("reason"), whole.alias("text")).select(
        "note_id", "mtime", "size", F.when(F.col("reason").isNull(), F.col("text")).alias("text"), "reason"
    )


def notes(read_: DataFrame) -> DataFrame:
    return read_.where("reason IS NULL").drop("reason")


def unreadable(read_: DataFrame) -> DataFrame:
    return read_.where("reason IS NOT NULL").drop("text")
