"""WARC archives: writer, monolithic gzip normaliser and reader (operator 5).

A *monolithic* archive is one gzip stream over the whole file, so no record of
it can be read alone.  :func:`normalise` inflates such a stream once, front to
back, and writes every record as a gzip member of its own; the sidecar holds
each member's offset and length, so :func:`read_at` fetches one record by one
seek.  Memory is bounded by one record, not by the file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, bounded_batches, shared_path, slices, small_or_plain

#: Payloads of at least so many bytes are stored once.
MIN_REVISIT = 1000
#: Bytes of payload in one archive file before the next one begins.
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
LEVEL = 4


# --- records ------------------------------------------------------------------


def record(kind: str, uri: str, date: str, payload: bytes, extra: dict[str, str]) -> bytes:
    """One WARC/1.1 record; header values may hold no line break, so those of ``uri`` are percent-encoded."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{extra.pop('id')}>", "WARC-Date": date, "WARC-Target-URI": uri.replace("\r", "%0D").replace("\n", "%0A"), "Content-Type": "text/html", **extra, "Content-Length": str(len(payload))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + payload + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """response with the payload, or revisit with its digest and length only."""
    payload = (html or "").encode()
    name = "null" if page_id is None else str(page_id)
    extra = {"id": name, "WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest(), "X-Payload-Length": str(len(payload))}
    if refers_to is None:
        return record("response", url or "", "2000-01-01T00:00:00Z", payload, extra)
    extra |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record("revisit", url or "", "2000-01-01T00:00:00Z", b"", extra)


def read_record(stream) -> tuple[dict[str, str], bytes, bytes] | None:
    """Headers, payload and raw bytes of the next record, None at the end; a broken record raises ValueError."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    raw, head = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        raw.append(line)
        k, _, v = line.decode().partition(":")
        head[k.strip()] = v.strip()
    n = int(head["Content-Length"])
    payload, tail = stream.read(n), stream.read(4)
    if len(payload) < n or tail != b"\r\n\r\n":
        raise ValueError("the record is cut short")
    return head, payload, b"".join([*raw, line, payload, tail])


# --- archives -----------------------------------------------------------------


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def normalise(source, target) -> list[tuple[int, int, str]]:
    """Rewrite the gzip stream of ``source`` with one member a record; returns (offset, length, record id) of each.

    Several members in the source are read as one stream.  An empty stream
    gives an empty archive; a stream cut short raises EOFError or ValueError.
    """
    index, offset = [], 0
    with gzip.GzipFile(fileobj=source, mode="rb") as inflated:
        stream = io.BufferedReader(inflated, CHUNK)
        while (found := read_record(stream)) is not None:
            head, _, raw = found
            deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = deflate.compress(raw) + deflate.flush()
            target.write(member)
            index.append((offset, len(member), head["WARC-Record-ID"]))
            offset += len(member)
    return index


def normalise_file(path: str, target: str) -> int:
    """Normalise ``path`` into ``target`` and its sidecar ``target``.idx (JSON lines); returns the number of records."""
    fs, inner = file_system(path)
    _, out = file_system(target)
    with fs.open_input_stream(inner, compression=None) as source, fs.open_output_stream(out, compression=None) as sink:
        index = normalise(source, sink)
    with fs.open_output_stream(out + ".idx", compression=None) as side:
        for offset, length, name in index:
            side.write((json.dumps({"offset": offset, "length": length, "id": name}) + "\n").encode())
    return len(index)


def read_at(handle, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a normalised archive, by its place in the sidecar."""
    handle.seek(offset)
    head, payload, _ = read_record(io.BytesIO(zlib.decompress(handle.read(length), 31)))
    return head, payload


def read_index(path: str) -> list[dict]:
    fs, inner = file_system(path)
    with fs.open_input_stream(inner + ".idx", compression=None) as side:
        return [json.loads(line) for line in side.read().decode().splitlines()]


# --- tables -------------------------------------------------------------------


def digest_of(html: str = "html") -> tuple[Column, Column]:
    """SHA-1 and length of a page's payload."""
    payload = F.coalesce(html, F.lit("")).cast("binary")
    return F.sha1(payload), F.octet_length(payload)


def references(pages: DataFrame) -> DataFrame:
    """r_page, r_digest, refers_to: the payloads that revisit another page's: equal ones of MIN_REVISIT bytes or more, all but that of the largest page_id.

    Digests are summed up before they meet: by page and digest first, so rows
    that repeat are one, then by digest.  The join with the sums is on a hot
    digest only as wide as its pages, and AQE splits such a partition.
    """
    digest, size = digest_of()
    digests = Staged(pages.select("page_id", digest.alias("digest"), size.alias("bytes")).filter((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct(), "digests")
    shared = digests.df.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return digests.df.join(shared, "digest").filter("page_id < refers_to").select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")


INDEX = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Monolithic archives of all pages (page_id, url, html), normalised: one row a file (path, records).

    Nulls are written as the id "null", an empty url and an empty payload; no
    pages make no file; rows that repeat are records of their own; other columns
    aren't read.

    Each task writes files of its own names, by attempt, so a task that runs
    again leaves no file that the result names.  The monolithic file goes as
    soon as its normalised form stands.
    """
    bounded_batches(pages.sparkSession)
    refs = Staged(references(pages), "revisits")
    # a page may stand there with several payloads: what a row refers to follows from its page and its payload
    named = pages.select("page_id", "url", "html").withColumn("digest", digest_of()[0])
    joined = named.join(small_or_plain(refs.df, refs.df.count(), 80), (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_page", "r_digest", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, inner = file_system(folder)
        fs.create_dir(inner, recursive=True)
        state: dict = {"n": 0, "out": None}

        def start():
            name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{state['n']:05d}"
            state.update(n=state["n"] + 1, name=name, raw=fs.open_output_stream(file_system(name)[1] + ".mono.gz", compression=None), bytes=0)
            state["out"] = gzip.GzipFile(fileobj=state["raw"], mode="wb", compresslevel=LEVEL, mtime=0)

        def finish() -> pa.RecordBatch:
            state["out"].close()
            state["raw"].close()
            state["out"], name = None, state["name"]
            n = normalise_file(name + ".mono.gz", name + ".warc.gz")
            fs.delete_file(file_system(name)[1] + ".mono.gz")
            return pa.RecordBatch.from_arrays([pa.array([name + ".warc.gz"]), pa.array([n], pa.int64())], names=["path", "records"])

        for b in slices(batches, text="html"):
            for row in b.to_pylist():
                if state["out"] is None:
                    start()
                data = page_record(row["page_id"], row["url"], row["html"], row["refers_to"])
                state["out"].write(data)
                state["bytes"] += len(data)
                if state["bytes"] >= FILE_BYTES:
                    yield finish()
        if state["out"] is not None:
            yield finish()

    return joined.mapInArrow(run, INDEX)


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the archives that index (path) names, each fetched by its sidecar entry and checked: a response's digest and length are those of the payload read.

    A path that stands twice is read twice, a null one not at all; an archive
    without records gives none; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda s: None if (n := s.strip("<>").rpartition(":")[2]) == "null" else int(n)
        for b in batches:
            for path in filter(None, b.column("path").to_pylist()):
                fs, inner = file_system(path)
                entries = read_index(path)
                with fs.open_input_file(inner) as handle:
                    for lo in range(0, len(entries), 4096):
                        rows = []
                        for e in entries[lo : lo + 4096]:
                            head, payload = read_at(handle, e["offset"], e["length"])
                            digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                            if head["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"{path} at {e['offset']}: the payload isn't the one written")
                            to = page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                            rows.append((page(head["WARC-Record-ID"]), n, digest, head["WARC-Type"], to, path, e["offset"], e["length"]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    # a row is a whole archive: a stated number of partitions keeps them from being merged as small rows
    return index.select("path").repartition(max(1, min(index.count(), 100_000))).mapInArrow(run, READ)


ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to archives in ``folder`` (the cluster's shared one by default) and read them back.

    One row a page.  Null html is an empty payload, null url an empty one; a
    page with a null page_id is always a response and no one's target; rows
    that repeat a page_id are records of their own, with the same payload or
    another (those of a payload's largest page_id are all responses).  No pages,
    no archives and no rows.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    index = Staged(write_archives(pages, folder), "warc-index")
    return read_archives(index.df)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g USING (digest)
"""
