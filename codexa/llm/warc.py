"""WARC archives with an index.

Writing: each task writes archives of gzip members, one for each record, to the shared folder and yields an index row with
file, offset, length, URL and digest of each record. A retried task writes new files; only rows of the attempt that ends
well reach the index, so files of lost attempts are never read. Reading: index rows are sorted by file and offset, and
ranges that lie close together are read at once, then cut into records.

Pages of equal payload (by SHA-1 and length) are found by a pre-aggregated minimum of page_id; only groups of two or more
are joined back, and adaptive execution splits a hot group.

Defined results: null html is an empty payload, null urls give records without a target URI; a null page_id comes after
all others; of rows with the same page_id and payload each is a response if that id is the smallest; ids of any type and
text are escaped in headers; pages of any length are whole records; other columns are not read; an empty table gives no
archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import slices, tidy

ARCHIVE_BYTES = 256 << 20
#: Ranges with at most so many bytes between them are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id {id}, file string, offset long, length long, url string, digest string"
RESULT = "page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One gzip member: a response, or a revisit without payload."""
    digest = digest_of(payload)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else _line(str(page_id))}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_line(str(refers_to))}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """Headers of a record, by lower-case name, with its type, payload (None for a revisit) and the payload's full length."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(out["content-length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record of another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["length"] = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    out["payload"] = payload if out["warc-type"] == "response" else None
    return out


def first_of_equal(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html and first: the smallest page_id of the rows of equal payload, where there are several rows."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("size", F.octet_length("html"))
    groups = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(scratch.keep(groups, "equal"), ["sha", "size"], "left").select("page_id", "url", "html", "first")


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives and gives the index; keep the result before reading it twice."""

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                index = []
                for x in slices(batch, "html"):
                    for page_id, url, html, first in zip(*(c.to_pylist() for c in x.columns), strict=True):
                        payload = html.encode()
                        member = record(page_id, url, payload, first if first is not None and first != page_id else None)
                        if out is None or at + len(member) > archive_bytes:
                            if out:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(member)
                        index.append((page_id, name, at, len(member), url, digest_of(payload)))
                        at += len(member)
                if index:
                    cols = list(zip(*index, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5])], ["page_id", "file", "offset", "length", "url", "digest"])
        finally:
            if out:
                out.close()

    return rows.mapInArrow(tidy(run), INDEX.format(id=rows.schema["page_id"].dataType.simpleString()))


def ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) pairs joined to (start, end, positions)."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(rows):
        if out and offset - out[-1][1] <= GAP_BYTES and offset + length - out[-1][0] <= READ_BYTES:
            start, end, who = out[-1]
            out[-1] = (start, max(end, offset + length), [*who, k])
        else:
            out.append((offset, offset + length, [k]))
    return out


def read(index: DataFrame, folder: str) -> DataFrame:
    """Reads the records of index rows back and checks their digests."""
    kind = index.schema["page_id"].dataType.simpleString()
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    selected = index.select("page_id", "file", "offset", "length", "digest").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            cols = {k: batch.column(i).to_pylist() for i, k in enumerate(("page_id", "file", "offset", "length", "digest"))}
            id_type = batch.schema.field(0).type
            i = 0
            while i < batch.num_rows:
                j = i
                while j < batch.num_rows and cols["file"][j] == cols["file"][i]:
                    j += 1
                with fs.open_input_file(f"{path}/{cols['file'][i]}") as f:
                    for start, end, who in ranges(list(zip(cols["offset"][i:j], cols["length"][i:j], strict=True))):
                        block, rows = f.read_at(end - start, start), []
                        for k in who:
                            a = cols["offset"][i + k] - start
                            r = parse(block[a : a + cols["length"][i + k]])
                            digest = r["warc-payload-digest"].removeprefix("sha1:")
                            if digest != cols["digest"][i + k] or (r["payload"] is not None and (digest_of(r["payload"]) != digest or len(r["payload"]) != r["length"])):
                                raise ValueError(f"{cols['file'][i]} at {cols['offset'][i + k]}: not the record of the index")
                            refers = r.get("warc-refers-to")
                            rows.append((cols["page_id"][i + k], r["length"], digest, r["warc-type"], _unline(refers[len("<urn:page:") : -1]) if refers else None))
                        c = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c[0], id_type), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3]), pa.array(c[4], pa.string()).cast(id_type)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                i = j

    return selected.mapInArrow(tidy(run), RESULT.format(id=kind))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    from .store import table

    scratch = Scratch(spark)
    folder = scratch.path("warc")
    folder = folder if "://" in folder or folder.startswith("/") else f"/{folder}"
    rows = first_of_equal(table(spark, sf_dir, "pages"), scratch)
    return read(scratch.keep(write(rows, folder), "index"), folder)


#: DuckDB has no base-32 function: each character is five bits of the digest's hex digits.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
digits AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex || '0000', (5 * k // 4 + 1)::INT, 3))::BIGINT >> (7 - 5 * k % 4)) & 31)::INT + 1, 1), '' ORDER BY k) AS payload_digest
  FROM d, range(0, 32) AS t(k) GROUP BY page_id)
SELECT d.page_id, payload_bytes, payload_digest, CASE WHEN d.page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN d.page_id <> first THEN first END AS refers_to
FROM d JOIN digits USING (page_id)
"""
