"""WARC archives with a Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh_dir, joinable

#: Fixed values of the format: magic of the dictionary's frame, and of compressed frames.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
WHEN = datetime(2024, 1, 1, tzinfo=UTC)
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 1024, 65_536, 112_640


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the one it repeats."""
    name = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{url}')}>",
        f"WARC-Date: {WHEN:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {name}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    block = http if revisit else http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; the payload and its checks for a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda k: int(fields[k]) if fields.get(k) else None
    out = {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": number("X-Payload-Length"), "refers_to": number("X-Refers-To-Page-ID"), "payload": None}
    if out["record_type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if len(out["payload"]) != out["payload_bytes"] or sha1_base32(out["payload"]) != out["payload_digest"]:
            raise ValueError(f"the payload of page {out['page_id']} doesn't match its digest")
    return out


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or for too few samples their raw content; empty for none."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


#: Bytes of an archive that are read at a time.
CHUNK = 1 << 16


def frames(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, read as a stream and decompressed one by one with the dictionary in its first frame."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    words = source.read(size)
    if words[:4] == struct.pack("<I", FRAME_MAGIC):
        words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    left = source.read(CHUNK)
    while left:
        one, parts = engine.decompressobj(), []
        while not one.eof:
            if not left:
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(left))
            left = one.unused_data if one.eof else source.read(CHUNK)
        yield b"".join(parts)
        left = left or source.read(CHUNK)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a plain path on this machine."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Archive:
    """One archive file: written under a name of its own, then moved into place."""

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str, dictionary: bytes):
        self.fs, self.name = fs, f"{name}.warc.zst"
        self.part, self.final = f"{folder}/_tmp-{uuid.uuid4().hex}", f"{folder}/{self.name}"
        self.out = fs.open_output_stream(self.part, compression=None)
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
        self.out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        self.engine = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.bytes = self.records = 0

    def write(self, raw: bytes) -> None:
        packed = self.engine.compress(raw)
        self.out.write(packed)
        self.bytes += len(packed)
        self.records += 1

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.part, self.final)
        return self.name


def dictionary_sample(pages: DataFrame, n: int) -> list[bytes]:
    """At most SAMPLE_ROWS archived records of at most SAMPLE_BYTES, of the ``n`` there are: those first by a hash of their digest."""
    draw = F.xxhash64(F.lit("dictionary"), "digest").bitwiseAND(F.lit((1 << 30) - 1))
    small = pages.filter(~F.col("revisit") & (F.length("payload") <= SAMPLE_BYTES) & (draw < F.lit(int(min(1.0, 1.2 * SAMPLE_ROWS / max(1, n)) * (1 << 30)))))
    rows = small.orderBy(draw, "digest", "page_id").limit(SAMPLE_ROWS).select("page_id", "url", "payload", "digest").toArrow()
    return [record(p, u, b, d, None, False) for p, u, b, d in sorted(zip(*(c.to_pylist() for c in rows.columns)), key=lambda r: (r[3], str(r[0])))]


def plan_records(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, int]:
    """Each page with payload, digest, revisit and refers_to, and how many different payloads are small enough for the sample.

    Of equal payloads of at least ``min_bytes`` bytes the largest key is the response and the
    others revisit it. Rows that repeat the largest key, and all rows where no copy has a key,
    are responses. Equal means equal length and SHA-1.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    sha = F.unhex(F.sha1(payload))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), sha.alias("sha"))
    groups = pages.select(F.col(key).alias("page_id"), F.length(payload).cast("long").alias("size"), sha.alias("sha"))
    groups = durable(groups.groupBy("sha", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first")))
    # Only payloads that repeat need a partner, so only those are joined.
    twice = groups.filter((F.col("n") > 1) & (F.col("size") >= min_bytes)).select(F.col("sha").alias("sha2"), F.col("size").alias("size2"), "first")
    met = rows.join(joinable(twice), (F.col("sha") == F.col("sha2")) & (F.length("payload") == F.col("size2")), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    plan = met.select("page_id", "url", "payload", F.hex("sha").alias("digest"), revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))
    return plan, groups.filter(F.col("size") <= SAMPLE_BYTES).count()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes ``pages`` as .warc.zst files below ``folder``; returns (uri, records) of the files.

    ``folder`` is a URI that every executor can write to. Each attempt of a task writes files of its
    own names and moves them into place whole; the files of the attempt that Spark took are those
    returned, so what a lost or repeated attempt leaves behind is never read. Null html is an empty payload, null urls are empty; the dictionary is trained
    on a bounded sample of the records themselves; an empty table gives no files.
    """
    plan, n = plan_records(pages, min_bytes, key, url, html)
    dictionary = build_dictionary(dictionary_sample(plan, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        attempt, done, now = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}", [], None
        for b in batches:
            for p, u, body, sha, revisit, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "revisit", "refers_to"))):
                if now is None:
                    now = Archive(fs, root, f"part-{attempt}-{len(done):03d}", dictionary)
                now.write(record(p, u, body, base64.b32encode(bytes.fromhex(sha)).decode(), refers, revisit))
                if now.bytes >= roll_bytes:
                    done.append((now.close(), now.records))
                    now = None
        if now is not None:
            done.append((now.close(), now.records))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{d}" for d, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["uri", "records"])

    return durable(plan.mapInArrow(run, "uri string, records long"))


def read_warc(spark: SparkSession, archives: str | DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (of responses).

    ``archives``: what ``write_warc`` returned, or a folder of which every .warc.zst file is read.
    Files are streamed, in chunks of records; payloads are held against their digests.
    """

    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *["payload"] * payloads]
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)

        for b in batches:
            for uri in b.column("uri").to_pylist():
                rows, size = [], 0
                fs, path = opened(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    for data in frames(source):
                        rows.append(parse(data))
                        size += len(data) * payloads + 256
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads
    if isinstance(archives, str):
        archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(archives).select(F.col("path").alias("uri"))
    return archives.select("uri").mapInArrow(run, schema)


def archived(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    files = write_warc(pages, fresh_dir(spark, "warc"), min_bytes, **columns)
    return read_warc(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
