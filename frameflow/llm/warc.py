"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of whole WARC records, and a footer in the public seekable format: a skippable frame with
the compressed and decompressed size of every frame. An index table maps each record to its bundle, frame, and offset in the frame, so one
record is read by decompressing one frame. Payloads that occur more than once are stored once, as a response; the others are revisit records.

Defined results: a null payload is empty; a null url leaves out the target header. The response of equal payloads has the largest id; rows that
repeat its id are responses too, rows with a null id revisit it (and are responses if no row has an id). Equality is by SHA-256 and length.
Other columns are ignored. An empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import pyspark
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import new_path, put_file

#: Decompressed bytes after which a frame ends, and compressed bytes after which a bundle ends; a record is never split.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1_000_000, 16_000_000, 3
#: The tables have no capture time; archives of pages that do have one pass it as date.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format and of the record format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record if refers_to is given; its HTTP header tells the payload's length either way."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    head.append("WARC-Record-ID: " + (f"<urn:page:{page_id}>" if page_id is not None else "<urn:page:unknown>"))
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset of the next one."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, data[start:stop], stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def frame_sizes(footer_of) -> list[tuple[int, int]]:
    """Sizes of all frames; footer_of(n) gives the last n bytes of the bundle."""
    n, flags, magic = struct.unpack("<IBI", footer_of(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    table = footer_of(9 + n * width)
    return [struct.unpack_from("<II", table, i * width) for i in range(n)]


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> tuple[str, DataFrame]:
    """Writes a record for each row; returns the folder and its index: id, bundle, frame, offset, length.

    Hashes and ids alone find the response of each payload (combined before the shuffle); then each payload moves once, and AQE splits a hot
    payload's rows among tasks.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    first = rows.groupBy("key", "size").agg(F.max("id").alias("response"))
    again = F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    placed = rows.join(first, ["key", "size"]).select("id", "url", F.when(again.isNull(), F.col("payload").cast("binary")).alias("payload"), "size", F.unhex(F.sha1("payload")).alias("sha1"), again.alias("refers_to"))

    def run(batches):
        part, bundle, held = pyspark.TaskContext.get().partitionId(), 0, []
        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        frames, index, size = [], [], 0

        def end_frame():
            nonlocal size
            data = b"".join(r for _, r in held)
            at = 0
            for i, r in held:
                index.append((i, len(frames), at, len(r)))
                at += len(r)
            frames.append((pack.compress(data), len(data)))
            size += len(frames[-1][0])
            held.clear()

        def end_bundle():
            nonlocal bundle, size
            name = f"part-{part:08d}-{bundle:06d}.warc.zst"
            put_file(folder, name, b"".join(f for f, _ in frames) + seek_table([(len(f), n) for f, n in frames]))
            ids, at, offsets, lengths = zip(*index, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(at, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["id", "bundle", "frame", "offset", "length"])
            frames.clear()
            index.clear()
            bundle, size = bundle + 1, 0
            return out

        waiting = 0
        for batch in batches:
            for i, url, payload, n, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = record(i, url, payload, n, base64.b32encode(sha1).decode(), refers_to, date)
                held.append((i, r))
                waiting += len(r)
                if waiting >= FRAME_BYTES:
                    end_frame()
                    waiting = 0
                if size >= BUNDLE_BYTES:
                    yield end_bundle()
        if held:
            end_frame()
        if frames:
            yield end_bundle()

    placed.mapInArrow(run, "id long, bundle string, frame int, offset long, length long").write.parquet(f"{folder}/index")
    return folder, spark.read.parquet(f"{folder}/index").withColumnRenamed("id", id_col)


def fetch(folder: str, bundle: str, frame: int, offset: int, length: int) -> bytes:
    """One record, read by its place in the index: the footer, then one frame."""
    store, at = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{at}/{bundle}") as f:
        size = f.size()
        sizes = frame_sizes(lambda n: f.read_at(n, size - n))
        data = f.read_at(sizes[frame][0], sum(c for c, _ in sizes[:frame]))
    return zstandard.ZstdDecompressor().decompress(data)[offset : offset + length]


def records(data: bytes):
    """(headers, block) of every record of a bundle, frame by frame."""
    at, unpack = 0, zstandard.ZstdDecompressor()
    for packed, _ in frame_sizes(lambda n: data[len(data) - n :]):
        frame = unpack.decompress(data[at : at + packed])
        at += packed
        i = 0
        while i < len(frame):
            head, block, i = parse(frame, i)
            yield head, block


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number and number != "unknown" else None


def read(spark: SparkSession, folder: str, id_col: str = "page_id") -> DataFrame:
    """A row per record read back: id, payload_bytes, payload_digest, record_type, refers_to. Digests of responses are computed from what was read."""
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in records(data.as_py()):
                    http, payload = block.split(b"\r\n\r\n", 1)
                    kind = head["WARC-Type"]
                    size, digest = int(http.rsplit(b"Content-Length: ", 1)[1]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((_page(head["WARC-Record-ID"]), size, digest, kind, _page(head.get("WARC-Refers-To"))))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

    return files.mapInArrow(run, schema)
