"""WARC archives through a table of payload chunks.

A payload becomes rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, cut out by the JVM.
Python tasks see one chunk at a time: they carry a running SHA-256 per record and emit each chunk as a
WARC record of its own, the first as ``response`` and later ones as ``continuation`` segments, the form
that the standard has for long records.  Spark's text writer puts the records into files; its line
separator is the blank line pair that ends a WARC record.  Files are gzipped and rolled after
``FILE_RECORDS``, so that one is at most FILE_RECORDS x CHUNK bytes when it is read.

Reading parses one archive at a time.  Records in one segment are digested there; segments of longer ones
travel as chunk rows, are sorted by record and number, and digested as a stream.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path, saved, small_batches

CHUNK = 1 << 16
FILE_RECORDS = 512
#: Chunks that a Python task holds at once.
CHUNKS = 512
#: Equal payloads shorter than this are all stored.
LEAST_REVISIT = 100
END = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
#: A fixed capture time: archives of equal input are equal.
DATE = "2024-01-01T00:00:00Z"


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, *others, payload_bytes, chunk_no, n_chunks, data) from rows with a binary ``payload``.

    An empty payload is one empty chunk.  Chunks of a record follow each other within a task.
    """
    others = [c for c in records.columns if c != "payload"]
    size = F.octet_length("payload").cast("long")
    sized = records.withColumn("payload_bytes", size).withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int"))
    cut = sized.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return cut.select(*others, "payload_bytes", "chunk_no", "n_chunks", F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})").alias("data"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digest over (page_id, mark, chunk_no, n_chunks, data); one row per record after its last chunk."""
    running, length = hashlib.sha256(), 0
    for batch in batches:
        ids, marks, out = batch.column("page_id"), batch.column("mark"), ([], [], [], [])
        for i, (no, n, data) in enumerate(zip(batch.column("chunk_no").to_pylist(), batch.column("n_chunks").to_pylist(), batch.column("data"))):
            if no == 0:
                running, length = hashlib.sha256(), 0
            running.update(data.as_buffer())
            length += len(data.as_buffer())
            if no == n - 1:
                for column, value in zip(out, (ids[i].as_py(), marks[i].as_py(), length, running.hexdigest())):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["page_id", "mark", "payload_bytes", "payload_digest"])


def chunk_digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("page_id", "mark", "chunk_no", "n_chunks", "data").mapInArrow(_digests, "page_id long, mark long, payload_bytes long, payload_digest string")


def _head(kind: str, uri: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{uri}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + END).encode()


def _uri(page_id: int | None, segment: int = 0) -> str:
    return f"urn:page:{'' if page_id is None else page_id}" + (f":{segment}" if segment else "")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records without their ending, from chunk rows of responses and revisits."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            pid, no, n, data = r["page_id"], r["chunk_no"], r["n_chunks"], r["data"]
            url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
            said = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"), ("X-Payload-Length", str(r["payload_bytes"]))]
            if r["record_type"] == "revisit":
                said += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_uri(r['refers_to'])}>"), ("Content-Type", "application/http; msgtype=response")]
                out.append(_head("revisit", _uri(pid), said, len(HTTP_HEAD)) + HTTP_HEAD)
                continue
            parts = [("WARC-Segment-Number", str(no + 1))] if n > 1 else []
            if no == 0:
                block = HTTP_HEAD + data
                out.append(_head("response", _uri(pid), [*said, *parts, ("Content-Type", "application/http; msgtype=response")], len(block)) + block)
            else:
                parts += [("WARC-Segment-Origin-ID", f"<{_uri(pid)}>"), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}")]
                if no == n - 1:
                    parts += [("WARC-Segment-Total-Length", str(r["payload_bytes"] + len(HTTP_HEAD)))]
                out.append(_head("continuation", _uri(pid, no), parts, len(data)) + data)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def with_revisits(digests: DataFrame) -> DataFrame:
    """(page_id, mark, payload_bytes, payload_digest, record_type, refers_to) for (page_id, mark, payload_bytes, payload_digest).

    Among equal digests of ``LEAST_REVISIT`` bytes or more the smallest page_id is the response.  The
    minimum pre-aggregates in the map tasks, so a payload shared by most pages is no hot key.
    """
    first = digests.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    revisits = F.col("first") != F.col("page_id")
    return digests.join(first, "payload_digest", "left").select(
        "page_id", "mark", "payload_bytes", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK) -> None:
    """Write one WARC record per row of ``pages`` (several segments for payloads over ``chunk`` bytes).

    Null payloads count as empty and null URLs as an empty URI.  Rows repeated under one page_id are all
    responses if it is the smallest of its payload.  Pages without an id are stored as responses.
    """
    # The mark tells payloads apart that come under one page_id; a page's record is known by both.
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    payloads = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload")).withColumn("mark", F.xxhash64("payload"))
    cut = chunk_table(payloads, chunk)
    with small_batches(pages.sparkSession, CHUNKS):
        digests = saved(chunk_digests(cut).distinct(), "warc-digests")
    kinds = saved(with_revisits(digests), "warc-kinds").select(F.col("page_id").alias("known_id"), F.col("mark").alias("known_mark"), F.col("payload_bytes").alias("full_bytes"), "payload_digest", "record_type", "refers_to")
    # What is joined and moved are chunks; of a revisit only the first is left, without its bytes.
    typed = cut.join(kinds, F.col("page_id").eqNullSafe(F.col("known_id")) & (F.col("mark") == F.col("known_mark")))
    response = F.col("record_type") == "response"
    typed = typed.where(response | (F.col("chunk_no") == 0)).withColumn("data", F.when(response, F.col("data")).otherwise(F.lit(b"")))
    rows = typed.select("page_id", "url", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "chunk_no", "n_chunks", "data")
    records = rows.mapInArrow(_segments, "record binary")
    # The cast keeps the bytes as they are; the text writer copies them.
    with small_batches(pages.sparkSession, CHUNKS):
        records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_archive(content: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(header fields, block) of the records of one archive, blocks not copied."""
    at, whole = 0, content.obj if isinstance(content.obj, bytes) else bytes(content)
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        lines = whole[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield fields, content[start:stop]
        at = stop + len(END)


def _id_of(uri: str) -> int | None:
    digits = uri.strip("<>").split(":")[2]
    return int(digits) if digits else None


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunk_no int, n_bytes long, data binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _READ.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse_archive(memoryview(gzip.decompress(content.as_py()))):
                kind = fields["WARC-Type"]
                if kind == "revisit":
                    rows.append((_id_of(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].split(":")[1], kind, _id_of(fields["WARC-Refers-To"]), None, None, None))
                elif kind == "continuation":
                    rows.append((_id_of(fields["WARC-Segment-Origin-ID"]), None, fields["WARC-Payload-Digest"].split(":")[1], None, None, int(fields["WARC-Segment-Number"]) - 1, None, bytes(block)))
                else:
                    pid, payload, said = _id_of(fields["WARC-Record-ID"]), block[len(HTTP_HEAD) :], fields["WARC-Payload-Digest"].split(":")[1]
                    if "WARC-Segment-Number" in fields:
                        rows.append((pid, None, said, None, None, 0, int(fields["X-Payload-Length"]), bytes(payload)))
                        continue
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest != said:
                        raise ValueError(f"payload of page {pid} has digest {digest}, its record says {said}")
                    rows.append((pid, len(payload), digest, kind, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names) if rows else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, kinds))))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of segmented records whose chunks come in order; a record ends when all its bytes are seen.

    Rows repeated under one page_id with one payload come as repeated chunks: each is digested once.
    """
    running, length, total, times, last = hashlib.sha256(), 0, None, 0, None
    for batch in batches:
        out = ([], [], [])
        for pid, no, size, digest, data in zip(*(batch.column(c) for c in ("page_id", "chunk_no", "n_bytes", "payload_digest", "data"))):
            chunk = (pid.as_py(), digest.as_py(), no.as_py())
            if chunk == last:
                times += chunk[2] == 0
                continue
            if chunk[2] == 0:
                running, length, total, times = hashlib.sha256(), 0, size.as_py(), 1
            last = chunk
            running.update(data.as_buffer())
            length += len(data.as_buffer())
            if length == total:
                if running.hexdigest() != chunk[1]:
                    raise ValueError(f"payload of page {chunk[0]} doesn't match its digest")
                for column, value in zip(out, (chunk[0], length, chunk[1])):
                    column.extend([value] * times)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["page_id", "payload_bytes", "payload_digest"])


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the archives under ``path``."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    found = saved(files.mapInArrow(_read, _READ), "warc-read")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = found.where("chunk_no is null").select(*names)
    segments = found.where("chunk_no is not null").select("page_id", "chunk_no", "n_bytes", "payload_digest", "data")
    streamed = segments.repartition("page_id", "payload_digest").sortWithinPartitions("page_id", "payload_digest", "chunk_no").mapInArrow(_joined, "page_id long, payload_bytes long, payload_digest string")
    return whole.unionByName(streamed.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, page_id, url, html)
    return read_archives(spark, path)
