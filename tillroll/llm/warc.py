"""Dictionary-compressed WARC archives.

Every page becomes one WARC 1.1 record, compressed on its own as a Zstandard
frame, so a record can be read from its offset alone. All files share one
dictionary trained on a bounded sample of the records that are to be written;
each file begins with a skippable frame (magic 0x184D2A5D) that embeds it.

Of pages whose payloads are equal and at least ``least`` bytes long, the one
with the largest page_id is a response record and all others are revisit
records that refer to it and carry no payload. Which page that is comes from a
pre-aggregated maximum per payload digest, joined back by digest (a digest that
many pages share is split by adaptive skew handling).

Each task writes one file of its own name under the target folder (local, or
any store pyarrow.fs resolves) and reports it; only reported files belong to
the archive, so a task that ran twice leaves no record twice. The reader
streams each file frame by frame and checks every payload's digest.

Defined cases: null html is an empty payload; a null url leaves out the target
header; control characters in a url are percent-encoded; a null page_id counts
as the smallest and is written as an empty id; rows that repeat the largest
page_id of a payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.store import materialize, scratch_path

SKIPPABLE = 0x184D2A5D
LEAST = 1000
DICT_BYTES = 64 * 1024
SAMPLES = 2000
SAMPLE_BYTES = 4096
DATE = "2024-01-01T00:00:00Z"  # fixed: archives of equal pages are equal
FRAME = 1 << 16


def _header(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, kind: str, refers_to, digest: str, payload: bytes) -> bytes:
    """One WARC record. A revisit keeps the HTTP header and drops the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            .encode())
    body = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if kind == "revisit":
        head.append(f"WARC-Refers-To: {_record_id(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers, its HTTP Content-Length and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("damaged WARC record")
    if fields["WARC-Type"] == "warcinfo":
        return fields | {"payload": b"", "length": 0}
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return fields | {"payload": payload, "length": length}


def _info(dictionary: bytes) -> bytes:
    body = f"software: tillroll\r\nformat: WARC File Format 1.1\r\ndictionary: {len(dictionary)}\r\n".encode()
    return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info:tillroll>\r\nWARC-Date: {DATE}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of records: SAMPLES pages by a hash
    of their ids, the first SAMPLE_BYTES of each."""
    drawn = F.xxhash64("page_id", "digest")
    chosen = pages.select(drawn.alias("draw")).distinct().orderBy("draw").limit(SAMPLES)
    rows = (pages.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"), "digest",
                         drawn.alias("draw"))
            .join(F.broadcast(chosen), "draw", "left_semi").dropDuplicates(["draw"]).orderBy("draw").collect())
    records = [record(r["page_id"], r["url"], "response", None, r["digest"], bytes(r["payload"])) for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, records).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: plain records serve as content
        return b"".join(records)[:DICT_BYTES]


def _write(folder: str, dictionary: bytes, level: int):
    def run(batches):
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)
                                              if dictionary else None)
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, written = f"{path}/{uuid.uuid4().hex}.warc.zst", 0
        out = None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")),
                           strict=True):
                page_id, url, payload, digest, refers_to = (v.as_py() for v in row)
                if out is None:
                    out = store.open_output_stream(name, compression=None)
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                    out.write(compressor.compress(_info(dictionary)))
                kind = "response" if refers_to is None else "revisit"
                out.write(compressor.compress(record(page_id, url, kind, refers_to, digest, payload)))
                written += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([written])],
                                             ["file", "records"])
    return run


def frames(stream):
    """(dictionary, iterator of records) of an open archive, read piece by piece."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = stream.read(size)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def records():
        rest = b""
        while rest or (rest := stream.read(FRAME)):
            one = unpack.decompressobj()
            parts = [one.decompress(rest)]
            while not one.eof:
                more = stream.read(FRAME)
                if not more:
                    raise ValueError("truncated archive")
                parts.append(one.decompress(more))
            rest = one.unused_data
            yield b"".join(parts)
    return dictionary, records()


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str | None) -> int | None:
    text = None if urn is None else urn[len("<urn:page:"):-1]
    return int(text) if text else None


def _read(folder: str, batch_rows: int = 2000):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in frames(stream)[1]:
                        f = parse(raw)
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if f["WARC-Type"] == "response" and hashlib.sha1(f["payload"]).hexdigest() != digest:
                            raise ValueError(f"payload of {f['WARC-Record-ID']} does not match its digest")
                        rows.append((_page(f["WARC-Record-ID"]), f["length"], digest, f["WARC-Type"],
                                     _page(f.get("WARC-Refers-To"))))
                        seen += 1
                        if len(rows) == batch_rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                                zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{name}: {seen} records, {expected} written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    return run


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, level: int = 3) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``;
    returns the manifest (file, records)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Only payloads that occur more than once need their largest page. Written
    # first, as adaptive execution splits hot keys only between two scans.
    copies = materialize(rows.filter(F.length("payload") >= least).groupBy("digest")
                         .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
                         .filter("n > 1").select("digest", "last"), "copies")
    typed = rows.join(copies, "digest", "left").withColumn(
        "refers_to", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))
    dictionary = train_dictionary(rows)
    return materialize(typed.select("page_id", "url", "payload", "digest", "refers_to")
                       .mapInArrow(_write(folder, dictionary, level), "file string, records long"), "manifest")


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archive: READ."""
    spark: SparkSession = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 10 * spark.sparkContext.defaultParallelism))
    return manifest.repartition(tasks, "file").mapInArrow(_read(folder), READ)


def archive_roundtrip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to a fresh folder of the shared store and read it back."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archive(write_archive(pages, folder, least), folder)
