"""WARC archives with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of the records that are to be archived. Each archive begins with a
skippable frame that holds it; each record is a frame of its own, compressed with it. Of pages with equal payloads one
is stored as a response, the others as revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, durable, read

# Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Bytes of records an archive takes in; bounds of the sample and the size of the dictionary.
ARCHIVE_BYTES = 8 << 20
SAMPLE_RECORDS = 1000
SAMPLE_RECORD_BYTES = 1 << 16
DICTIONARY_BYTES = 32 << 10
LEVEL = 3

_ID_SPACE = 0x57415243_5041_4745_0000000000000000  # upper half of record ids; the lower half is the page id
_NO_ID = 0x57415243_4E4F_4944_0000000000000000


def record_id(page_id: int | None, url: str, payload_sha1: bytes) -> str:
    if page_id is None:
        n = (_NO_ID & ~(2**64 - 1)) | int.from_bytes(hashlib.sha1(url.encode() + payload_sha1).digest()[:8], "big")
    else:
        n = (_ID_SPACE & ~(2**64 - 1)) | (page_id & (2**64 - 1))
    h = f"{n & (2**128 - 1):032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(record: str) -> int:
    n = int(re.sub(r"[^0-9a-f]", "", record[len("<urn:uuid:") : -1]), 16) & (2**64 - 1)
    return n - 2**64 if n >> 63 else n


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. payload is None for revisits; size and sha1 (hex) are the full payload's."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, uri, bytes.fromhex(sha1))}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, '', b'')}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or b"" where the samples are too few or too small for one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary if dictionary else b""


def open_archive(content: bytes):
    """Parsed records of an archive: (headers with lower-case names, block)."""
    dictionary, at = None, 0
    if len(content) >= 8 and struct.unpack("<I", content[:4])[0] == SKIPPABLE_DICTIONARY:
        size = struct.unpack("<I", content[4:8])[0]
        dictionary, at = zstandard.ZstdCompressionDict(content[8 : 8 + size]), 8 + size
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content[at:]), read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def with_roles(pages: DataFrame, dedupe_from: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), size, sha1, record_type, refers_to.

    Of payloads of ``dedupe_from`` bytes or more the largest page_id's record is the response (rows that repeat that
    id too); a null html is an empty payload; rows with a null id are revisits of a row with an id, else responses.
    Payloads never meet by digest: who is a revisit is settled on ids and digests, and joined to the pages by both.
    """
    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    d = d.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    last = d.where(F.col("size") >= dedupe_from).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = d.where(F.col("size") >= dedupe_from).select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1")).distinct()
    again = again.join(last, F.col("again_sha1") == F.col("sha1")).where(~F.coalesce(F.col("again_id") == F.col("last"), F.lit(False)) & F.col("last").isNotNull()).drop("sha1")
    d = d.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left")
    revisit = F.col("last").isNotNull()
    return d.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def _record_of(row: dict) -> bytes:
    return record(row["page_id"], row["url"], row["payload"], row["size"], row["sha1"], row["refers_to"], row["record_type"] == "revisit")


def archives(pages: DataFrame, dedupe_from: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """One row an archive: name, n_records, content (a whole .warc.zst file)."""
    rows = with_roles(pages, dedupe_from)
    n = pages.count()
    small = bounded_sample(pages, "page_id", SAMPLE_RECORDS, n, "warc").where(F.octet_length("html") <= SAMPLE_RECORD_BYTES).limit(2 * SAMPLE_RECORDS)
    sample = small.orderBy("page_id", "url").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html")).collect()
    texts = [(r.page_id, r.url, (r.html or "").encode()) for r in sample]
    dictionary = train_dictionary([record(i, u, p, len(p), hashlib.sha1(p).hexdigest(), None, False) for i, u, p in texts])
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def write(batches):
        zd = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zd, write_checksum=True)
        part, number = TaskContext.get().partitionId(), 0
        frames, size, count = [], 0, 0

        def close():
            nonlocal frames, size, count, number
            row = pa.RecordBatch.from_pylist([{"name": f"part-{part:06d}-{number:05d}.warc.zst", "n_records": count, "content": skippable(shared.value) + b"".join(frames)}], schema=pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("content", pa.binary())]))
            frames, size, count, number = [], 0, 0, number + 1
            return row

        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            for i in range(b.num_rows):
                raw = _record_of({c: v[i].as_py() for c, v in cols.items()})
                frames.append(pack.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    yield close()
        if count:
            yield close()

    return rows.mapInArrow(write, "name string, n_records long, content binary")


def records(archive_rows: DataFrame) -> DataFrame:
    """Read archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits).
    A response's digest is computed from its payload and must equal its header."""

    def parse(batches):
        for b in batches:
            for content in b.column("content"):
                out = []
                for head, block in open_archive(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    page = head.get("x-page-id")
                    out.append({"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(head["warc-refers-to"]) if kind == "revisit" else None, "html": payload.decode() if kind == "response" else None})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())]))

    return archive_rows.select("content").mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def save(archive_rows: DataFrame, folder: str) -> None:
    """Write each archive as a file of its own to a folder that all executors mount (whole files, then renamed)."""
    import os

    def put(rows):
        for r in rows:
            path = os.path.join(folder, r["name"])
            with open(path + ".tmp", "wb") as f:
                f.write(r["content"])
            os.replace(path + ".tmp", path)

    os.makedirs(folder, exist_ok=True)
    archive_rows.foreachPartition(put)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(durable(archives(read(spark, sf_dir, "pages")))).drop("html")


OP10_SQL = """
with p as (
  select page_id, coalesce(html, '') as x from pages
), d as (
  select page_id, strlen(x)::bigint as payload_bytes, sha1(x) as h, max(page_id) over (partition by x) as last from p
)
select page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, (1 + 5 * (k // 4))::int, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31)::int, 1)), '') as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id = last then null else last end as refers_to
from d
"""
