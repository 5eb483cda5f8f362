"""Web archives that are read through their index.

Writing gives the index first: each task packs the rows it has into archives of its own and returns, per
record, the archive, offset, length, URL and digest. Only what a finished task returned is in the index, so
archives of lost or repeated attempts are never read. Reading takes any selection of index rows, sorts
it by place, joins neighbours into byte ranges (``GAP`` bytes between records are read over, ``REACH`` bytes
make a range at most unless one record is longer), and opens each range once.

Records are gzip members of their own. Equal payloads of at least ``LEAST`` bytes are stored once, by the record
with the smallest key; the others are ``revisit`` records that refer to it. Rows that share this smallest key
as well as the payload are one page given several times and are all stored. A row without a key refers like
any other and is referred to only if no equal row has a key. A null payload is an empty one, a null URL is left
out of the record. Line breaks and other control characters of a URL are percent-encoded in the archive; the
index keeps the URL as it came.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from kittally.llm.common import values
from kittally.session import checkpoint_dir, cut

LEAST, ARCHIVE, GAP, REACH, TASK, LEVEL = 100, 256 << 20, 64 << 10, 4 << 20, 128 << 20, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "key long, url string, record_type string, refers_to long, payload_digest string, archive string, offset long, length long"
RECORD = "key long, url string, record_type string, refers_to long, payload_digest string, payload binary, intact boolean"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that Spark names; a bare path is a local one."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder)) if re.match(r"\w+:/", folder) else (pafs.LocalFileSystem(), folder)


def _record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}/{digest}')}>"


def _block(*fields: tuple[str, object]) -> bytes:
    return "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None).encode()


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None] | None, date: str) -> bytes:
    """One record, uncompressed; ``refers_to`` holds the key of the stored record where this one is a revisit."""
    http = b"HTTP/1.1 200 OK\r\n" + _block(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    body = http if refers_to else http + payload
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = _block(
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", _record_id(key, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", _record_id(refers_to[0], digest) if refers_to else None),
        ("WARC-Profile", PROFILE if refers_to else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(body)),
        ("X-Page-Key", key),
        ("X-Refers-To-Key", refers_to[0] if refers_to else None),
    )
    return b"WARC/1.1\r\n" + head + b"\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of one record, in lower case, and its payload (what follows the HTTP header)."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    head = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    body = raw[end + 4 : end + 4 + int(head["content-length"])]
    return head, body[body.index(b"\r\n\r\n") + 4 :]


def revisits(pages: DataFrame) -> DataFrame:
    """(key, digest, first) of the rows (key, digest, bytes) that repeat the payload of a smaller key."""
    large = pages.where(F.col("bytes") >= LEAST).groupBy("digest", "key").agg(F.lit(1).alias("one"))
    firsts = cut(large.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("keys")).where("keys > 1"))
    return large.join(firsts, "digest").where("NOT key <=> first").select("key", "digest", "first")


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per row into ``folder`` (a new one in the shared folder by default); returns the written index."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest")
    )
    repeats = cut(revisits(rows.select("key", "digest", F.octet_length("payload").alias("bytes"))))
    other = repeats.select(F.col("key").alias("k"), F.col("digest").alias("d"), F.col("first"), F.lit(True).alias("again"))
    typed = rows.join(other, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    typed = typed.select("key", "url", "payload", "digest", "first", F.coalesce("again", F.lit(False)).alias("again"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        stem = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        out, number, at = None, 0, 0
        try:
            for batch in batches:
                found = []
                for k, u, text, digest, first, again in values(batch, "key", "url", "payload", "digest", "first", "again"):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, number, at = f"{stem}-{number:04d}.warc.gz", number + 1, 0
                        out = system.open_output_stream(name, compression=None)
                    raw = record(k, u, text.encode("utf-8", "surrogatepass"), digest, (first,) if again else None, date)
                    member = gzip.compress(raw, LEVEL, mtime=0)
                    out.write(member)
                    found.append((k, u, "revisit" if again else "response", first, digest, name.rpartition("/")[2], at, len(member)))
                    at += len(member)
                yield _batch(found, INDEX)
        finally:
            if out is not None:
                out.close()

    index = typed.mapInArrow(write, INDEX)
    return cut(index).withColumn("folder", F.lit(folder))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def ranges(selected: DataFrame) -> DataFrame:
    """(folder, archive, start, stop, members): byte ranges that cover the selected index rows, each to be read once.

    A range starts where the gap to the record before is wide, and at every ``REACH`` bytes of the archive.
    """
    order = Window.partitionBy("folder", "archive").orderBy("offset", "length")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    last = F.lag(F.floor(F.col("offset") / REACH)).over(order)
    new = before.isNull() | (F.col("offset") - before > GAP) | (F.floor(F.col("offset") / REACH) != last)
    marked = selected.withColumn("new", new.cast("int")).withColumn("range", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    member = F.struct("offset", "length", "key", "url", "record_type", "refers_to", "payload_digest")
    return marked.groupBy("folder", "archive", "range").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(member)).alias("members")
    )


def read_records(selected: DataFrame) -> DataFrame:
    """The records of some rows of an index. ``payload`` is null for revisits.

    Type, reference and digest come from the archive, the URL from the index. ``intact`` is false where a record
    does not fit its index row or a stored payload does not have its digest.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, archive, start, stop, members in values(batch, "folder", "archive", "start", "stop", "members"):
                system, base = _open(folder)
                with system.open_input_file(f"{base}/{archive}") as file:
                    held = memoryview(file.read_at(stop - start, start))
                found, size = [], 0
                for m in members:
                    raw = gzip.decompress(held[m["offset"] - start : m["offset"] - start + m["length"]])
                    head, payload = parsed(raw)
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    stored = head["warc-type"] == "response"
                    key, refers = (int(head[n]) if n in head else None for n in ("x-page-key", "x-refers-to-key"))
                    fits = (key, head["warc-type"], refers, digest) == (m["key"], m["record_type"], m["refers_to"], m["payload_digest"])
                    fits = fits and (not stored or hashlib.sha256(payload).hexdigest() == digest)
                    found.append((key, m["url"], head["warc-type"], refers, digest, payload if stored else None, fits))
                    size += len(payload)
                    if size > REACH:  # highly compressed records leave in several batches
                        yield _batch(found, RECORD)
                        found, size = [], 0
                yield _batch(found, RECORD)

    size = selected.agg(F.sum("length")).first()[0] or 0  # ranges are small rows and much work: dealt out by bytes to read
    parts = max(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK)
    return ranges(selected).repartition(parts).mapInArrow(read, RECORD)


def resolve(records: DataFrame, *columns: str) -> DataFrame:
    """Give revisits the named columns of the record that they refer to (null-safe on its key, and its digest)."""
    stored = records.where("record_type = 'response'")
    again = records.where("record_type = 'revisit'").drop(*columns)
    source = stored.groupBy(F.col("key").alias("of"), F.col("payload_digest").alias("same")).agg(*(F.first(c).alias(c) for c in columns))
    filled = again.join(source, F.col("refers_to").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("same")), "left")
    return stored.unionByName(filled.select(*records.columns))
