"""A store that follows a stream of notes: each micro-batch is a refresh by what it holds.

The reference data model has no stream; this is the batch refresh driven by a file source. A batch
(note_id, path, mtime, size, removed) names files that came, changed or went; the rest stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Read, Store

EVENT = "note_id string, path string, mtime double, size bigint, removed boolean"


def apply_events(store: Store, events: DataFrame, root: str) -> Read:
    """One batch of events; the last event of a note counts. ``root`` is the folder that paths are joined to."""
    last = events.withColumn("__k", F.row_number().over(W.partitionBy("note_id").orderBy(F.desc("mtime"), F.desc("size")))).where("__k = 1")
    at = store.meta()
    entry = ["note_id", "path", "mtime", "size"]
    fresh = last.where("NOT coalesce(removed, false)").select(entry)
    if at is None:
        return store.refresh(fresh)
    path = F.concat(F.lit(root.rstrip("/") + "/"), "note_id")
    stayed = store._stats(at).select("note_id", path.alias("path"), "mtime", "size").join(last.select("note_id"), "note_id", "left_anti")
    return store.refresh(stayed.unionByName(fresh))


def follow(store: Store, events: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that applies a stream of events (EVENT). A batch that is run again changes nothing the second time."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_events(store, df, root))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
