"""WARC archives that are read through an index.

Writing makes one gzip member per record and an index row (file, offset, length, url, digest);
reading sorts the wanted index rows by file and offset, coalesces neighbouring byte ranges, and
parses only those. Files lie in a shared folder and are reached by URI through pyarrow's file
systems. A retried task writes a new file; the index names only files of tasks that ended, so what a
lost executor left is never read.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest page_id is a
response and the others are revisits of it; rows that repeat that page_id are responses too. Null
html counts as empty, a null url as "". Null page_ids are less than all others. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

MIN_REVISIT = 1000
GAP, RANGE = 1 << 16, 8 << 20
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers: int | None, kind: str) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP head of the payload that it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """(page_id, url, payload bytes, payload sha1, kind, refers to) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(s[len("<urn:page:") : -1]) if len(s) > len("<urn:page:>") else None
    kind = fields["WARC-Type"]
    if kind == "response":
        size, sha1 = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        sha1 = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), size, sha1, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    context = TaskContext.get()
                    name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
                    system, path = _opened(name)
                    system.create_dir(path.rpartition("/")[0])
                    out, at = system.open_output_stream(path, compression=None), 0  # the records are members already
                index = []
                for row in batch.to_pylist():
                    payload = (row["html"] or "").encode("utf-8", "replace")
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = packer.compress(record(row["page_id"], row["url"] or "", payload, row["digest"], row["refers_to"], row["record_type"])) + packer.flush()
                    out.write(packed)
                    index.append((row["page_id"], row["url"], row["digest"], row["record_type"], name, at, len(packed)))
                    at += len(packed)
                names = ("page_id", "url", "digest", "record_type", "file", "offset", "length")
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in index], t) for i, t in enumerate(types)], list(names))
        finally:
            if out is not None:
                out.close()

    return write


def decided(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, record_type and refers_to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"), F.octet_length(html).alias("n"))
    # Digests alone are shuffled; only those found twice matter, and html goes by page_id, which is spread evenly.
    small = rows.select("page_id", "digest", "n").where(F.col("n") >= MIN_REVISIT)
    winners = small.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1").select("digest", "winner")
    revisits = small.join(winners, "digest").where(~F.col("page_id").eqNullSafe(F.col("winner"))).select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "winner").distinct()
    out = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("digest") == F.col("__d")), "left")
    return out.select("page_id", "url", "html", "digest", F.when(F.col("__d").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("winner").alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Lazily writes the archives; the returned index must be saved once and read from there."""
    small_batches(pages.sparkSession)
    return decided(pages).mapInArrow(_writer(folder), INDEX)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files, offsets, lengths = batch["file"].to_pylist(), batch["offset"].to_numpy(), batch["length"].to_numpy()
        out, i, n, opened = [], 0, batch.num_rows, ("", None)
        while i < n:
            j = i + 1
            while j < n and files[j] == files[i] and 0 <= offsets[j] - offsets[j - 1] - lengths[j - 1] <= GAP and offsets[j] + lengths[j] - offsets[i] <= RANGE:
                j += 1
            if opened[0] != files[i]:
                if opened[1] is not None:
                    opened[1].close()
                system, path = _opened(files[i])
                opened = (files[i], system.open_input_file(path))
            raw = opened[1].read_at(int(offsets[j - 1] + lengths[j - 1] - offsets[i]), int(offsets[i]))
            for k in range(i, j):
                a = int(offsets[k] - offsets[i])
                out.append(parsed(zlib.decompress(raw[a : a + int(lengths[k])], 31)))
            i = j
        if opened[1] is not None:
            opened[1].close()
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(index: DataFrame) -> DataFrame:
    """The records of the chosen index rows, by coalesced byte ranges."""
    spark = index.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_reader, READ)


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages, reads all records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(spark, "warc")
    index = scratch.save(write(pages, f"{scratch.root}/archives"), "index")
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


