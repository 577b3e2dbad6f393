"""WARC archives with per-record Zstandard frames and an embedded dictionary.

Each archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the archive's own
records; every record is then a frame of its own, so any record can be read alone and ordinary tools can read all.
Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a response and the others are
revisits that refer to it and carry no payload.

Defined results: a null page is an empty payload; a null url is left out of the record
and control characters in a url are percent-encoded; a null id is written as <urn:page>, an empty one as <urn:page:>; a
null id is never referred to and comes last, so pages with equal payloads and null ids only are all responses; rows that
repeat the id of the response are that page, so all of them are responses; archives without enough records for a
dictionary have none; an empty table gives no archive; only the named columns are read.

Scale: equal payloads are found by digest with partial aggregation, and only digests that occur twice or more go back to
the pages. A task writes archives of bounded size under names of its attempt; the manifest, written once the tasks have
succeeded, lists those that count, so a repeated task harms nothing. Archives live in a folder that all executors share.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import batches, blobs, keyed, materialise, shared_dir, ship, table

LEAST = 100
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 16 << 20, 64 << 10, 3 << 20, 3
DATE = "1970-01-01T00:00:00Z"

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_MAGIC = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda x: "<urn:page>" if x is None else f"<urn:page:{quote(x, safe='')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    block = http if refers_to is not None else http + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on whole records spread evenly over an archive, or None where they are too few."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample))
    picked, room = [], sample
    for r in records[::step]:
        if len(r) <= room:
            picked.append(r)
            room -= len(r)
    size = min(size, sum(map(len, picked)) // 10)
    if len(picked) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, picked, k=256, d=8)
    except zstandard.ZstdError:
        return None


def pack(records: list[bytes], level: int = LEVEL) -> bytes:
    """An archive of records."""
    known = dictionary(records)
    out = []
    if known is not None:
        raw = known.as_bytes()
        out.append(struct.pack("<II", _MAGIC, len(raw)) + raw)
    coder = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True) if known else zstandard.ZstdCompressor(level=level, write_checksum=True)
    return b"".join(out + [coder.compress(r) for r in records])


def unpack(archive: bytes) -> Iterator[dict]:
    """The records of an archive: headers in lower case, HTTP headers and payload."""
    known, at = None, 0
    if len(archive) >= 8:
        magic, size = struct.unpack_from("<II", archive)
        if magic == _MAGIC:
            known, at = zstandard.ZstdCompressionDict(archive[8 : 8 + size]), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    data = decoder.stream_reader(io.BytesIO(archive[at:]), read_across_frames=True).readall()
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = _headers(data[at:end])
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        head, _, payload = block.partition(b"\r\n\r\n")
        yield {"headers": headers, "http": _headers(head), "payload": payload}
        at = end + 4 + length + 4


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def _writer(folder: str, most: int):
    def save(records: list[bytes]) -> dict:
        store, path = _open(f"{folder}/{uuid.uuid4().hex}.warc.zst")
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        data = pack(records)
        with store.open_output_stream(path) as out:
            out.write(data)
        return {"path": f"{folder}/{path.rsplit('/', 1)[1]}", "n_records": len(records), "n_bytes": len(data)}

    def made(stream: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for batch in stream:
            pages, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for row in zip(pages, urls, blobs(batch.column(2)), digests, refers, strict=True):
                made = record(row[0], row[1], row[2] or b"", row[3], row[4])
                held.append(made)
                size += len(made)
                if size >= most:
                    yield save(held)
                    held, size = [], 0
        if held:
            yield save(held)

    return lambda stream: batches(made(stream), _MANIFEST, 16)


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """One row per page: page_id, url, html, digest and refers_to."""
    read = keyed(pages, page_id=page_id, url=url, html=html).withColumn("html", F.coalesce("html", F.lit("")))
    hashed = read.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = hashed.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    joined = hashed.join(materialise(first, "payloads"), "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **options) -> DataFrame:
    """Write archives of pages below a shared folder; returns the manifest (path, n_records, n_bytes)."""
    ship(pages.sparkSession)
    rows = decided(pages, **options).select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    return materialise(rows.mapInArrow(_writer(folder, archive_bytes), "path string, n_records bigint, n_bytes bigint"), "manifest")


def _read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        name = lambda x: None if x == "<urn:page>" else unquote(x[len("<urn:page:") : -1])
        for batch in stream:
            for path in batch.column(0).to_pylist():
                store, local = _open(path)
                with store.open_input_stream(local) as f:
                    data = f.read()
                for r in unpack(data):
                    h = r["headers"]
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"a payload of {path} does not have its digest")
                    yield {"page_id": name(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload": r["payload"] if h["warc-type"] == "response" else None, "payload_bytes": int(r["http"]["content-length"]), "payload_digest": digest, "record_type": h["warc-type"], "refers_to": name(h["warc-refers-to"]) if "warc-refers-to" in h else None}

    return batches(rows(), pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]), 128)


def read(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest; a revisit has no payload of its own."""
    ship(manifest.sparkSession)
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(n, "path").select("path").mapInArrow(_read, "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from archives that were written for it."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = read(write(pages, shared_dir(spark, "warc")))
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


SQL = f"""
with p as (select page_id, coalesce(html, '') as html, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= {LEAST} group by 1)
select page_id, payload_bytes, p.payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""
