"""WARC archives: written with an index of every record, read back through the index.

Writing: each task appends gzip members, one per record, to an archive of its own and returns, as rows, the index of
what it wrote: archive, offset, length, URL and digest. Archive names are unique per attempt, so a repeated task
leaves an unused file and never a torn one; only indexed records are ever read. Reading starts from the index: the
selected records are dealt out by archive and sorted by offset, and neighbouring ranges are read in one request.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.storage import materialize, new_path, write_bytes_fs

#: Ranges closer than this are read in one request of at most MAX_READ bytes.
GAP, MAX_READ = 64 << 10, 8 << 20
FLUSH = 4 << 20
#: Records per archive; bounds what is lost with a writer.
ROLL = 256 << 20

INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of the payload, with its length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    address = " ".join(url.split()).encode()
    name = b"null" if page_id is None else b"%d" % page_id
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")).encode() + b">",
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + address,
        b"X-Page-ID: " + name,
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"X-Refers-To-Page-ID: %d" % refers_to]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """Headers and payload of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "payload_bytes": size}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def ranges(offsets: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Slices [a, b) of records, sorted by offset, that are read together."""
    out, a = [], 0
    for b in range(1, len(offsets) + 1):
        if b == len(offsets) or offsets[b] - (offsets[b - 1] + lengths[b - 1]) > GAP or offsets[b] + lengths[b] - offsets[a] > MAX_READ:
            out.append((a, b))
            a = b
    return out


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", minimum: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record per row and returns the index (INDEX), itself a table in the shared folder.

    Payloads are equal when their SHA-256 is; SHA-1, which can be made to collide, is only the format's digest. Of records with
    equal payloads of at least `minimum` bytes the one with the largest id is a response and the
    others revisit it; smaller ones are all responses. Null html is an empty payload, a null url an empty one. Rows
    whose id equals the response's id are responses too; where all ids of a payload are null, all are responses.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    digests = base.where(F.octet_length("payload") >= minimum).select("page_id", F.sha2("payload", 256).alias("same"))
    # only payloads that occur again; written first, so that Spark knows its size and broadcasts it only if small
    again = materialize(digests.groupBy("same").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first"), "payloads")
    rows = base.withColumn("same", F.sha2("payload", 256)).join(again, "same", "left").select("page_id", "url", "payload", "first")

    def write(batches):
        fs, root = write_bytes_fs(folder)
        fs.create_dir(root, recursive=True)
        out = name = None
        pending, size, at = [], 0, 0
        for batch in batches:
            index = []
            for page_id, url, data, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or at > ROLL:
                    if out is not None:
                        out.write(b"".join(pending))
                        out.close()
                        pending, size = [], 0
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest = sha1_base32(data)
                revisit = first is not None and page_id != first
                member = record(page_id, url, data, digest, first, revisit)
                index.append((page_id, f"{folder}/{name}", at, len(member), url, digest, "revisit" if revisit else "response"))
                pending.append(member)
                at += len(member)
                size += len(member)
                if size > FLUSH:
                    out.write(b"".join(pending))
                    pending, size = [], 0
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page_id", "archive", "offset", "length", "url", "digest", "record_type"])
        if out is not None:
            out.write(b"".join(pending))
            out.close()

    return materialize(rows.mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """The selected records: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A revisit has no payload of its own (null); its payload_bytes and payload_digest are those of the full payload.
    A response whose payload does not have the digest of its header raises.
    """
    spec = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in spec.split(", ")])

    def read(batches):
        for batch in batches:
            archive, offset, length = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows, held = [], 0
            for name in dict.fromkeys(archive):
                mine = np.array([i for i, a in enumerate(archive) if a == name])
                off, size = offset[mine], length[mine]
                fs, path = write_bytes_fs(name)
                with fs.open_input_file(path) as f:
                    for a, b in ranges(off, size):
                        data = f.read_at(int(off[b - 1] + size[b - 1] - off[a]), int(off[a]))
                        for i in range(a, b):
                            x = parse(data[off[i] - off[a] : off[i] - off[a] + size[i]])
                            h = x["fields"]
                            digest = h[b"warc-payload-digest"].decode().removeprefix("sha1:")
                            kind = h[b"warc-type"].decode()
                            if kind == "response" and (sha1_base32(x["payload"]) != digest or len(x["payload"]) != x["payload_bytes"]):
                                raise ValueError(f"damaged record in {name} at {off[i]}")
                            page = None if h[b"x-page-id"] == b"null" else int(h[b"x-page-id"])
                            to = int(h[b"x-refers-to-page-id"]) if kind == "revisit" else None
                            rows.append((page, h[b"warc-target-uri"].decode(), kind, to, x["payload_bytes"], digest, x["payload"] if kind == "response" else None))
                            held += len(x["payload"])
                            if held > FLUSH:
                                yield flush(rows)
                                rows, held = [], 0
            if rows:
                yield flush(rows)

    parts = max(index.sparkSession.sparkContext.defaultParallelism, index.rdd.getNumPartitions())
    sorted_index = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return sorted_index.mapInArrow(read, spec)


ORACLE = None
