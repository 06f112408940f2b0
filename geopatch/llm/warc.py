"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that can be read on their own.  An archive ends
with a seek table in a skippable frame (sizes of all frames and a footer), so
any Zstandard reader can read it as one stream, and this module can go to one
frame.  An index maps each record to its archive, frame and place within the
frame.  Of equal payloads one is stored; the others refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import few, kept, shared_dir, sha256_of, sliced, small_batches

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame and of frames in an archive, from which the next one is begun.
FRAME, ARCHIVE = 1 << 20, 64 << 20
#: Payloads of at least so many bytes are stored once.
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id string, record_type string, path string, frame int, at long, size long"
BACK = "page_id string, record_type string, refers_to string, stated_digest string, payload binary"


def header(fields: dict[str, str | None], size: int) -> bytes:
    """The head of a record; fields without a value are left out, line breaks in values become blanks."""
    lines = [f"{k}: {' '.join(v.splitlines())}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {size}", "", ""]).encode()


def record(page: str | None, url: str | None, kind: str, first: str | None, digest: str, payload: bytes) -> bytes:
    """One response or revisit; a revisit has no payload."""
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "X-Page-ID": page,
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": first}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    return header(fields, len(block)) + block + b"\r\n\r\n"


def parse(data: memoryview, at: int) -> tuple[dict[str, str], memoryview, int]:
    """Fields, HTTP payload and end of the record at a place."""
    raw = bytes(data[at : at + 65536])
    end = raw.find(b"\r\n\r\n")
    while end < 0 and at + len(raw) < len(data):
        raw = bytes(data[at : at + 2 * len(raw)])
        end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.1\r\n") or end < 0:
        raise ValueError(f"no record at {at}")
    fields = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    low, high = at + end + 4, at + end + 4 + int(fields["Content-Length"])
    body = bytes(data[low : min(high, low + 4096)]).find(b"\r\n\r\n")
    return fields, data[low + body + 4 if body >= 0 else low : high], high + 4


class Bundle:
    """An archive being written: frames, then the seek table."""

    def __init__(self, folder: str, frame: int) -> None:
        self.frame = frame
        self.store, base = fs.FileSystem.from_uri(folder)
        self.path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(self.path, compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.held = bytearray()
        self.index: list[tuple] = []
        self.add(None, "warcinfo", header({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, 22) + b"format: WARC File 1.1\n" + b"\r\n\r\n")
        self.close_frame()

    @property
    def written(self) -> int:
        return sum(a for a, _ in self.sizes)

    def add(self, page: str | None, kind: str, data: bytes) -> None:
        self.index.append((page, kind, self.path, len(self.sizes), len(self.held), len(data)))
        self.held += data
        if len(self.held) >= self.frame:
            self.close_frame()

    def close_frame(self) -> None:
        if self.held:
            frame = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(bytes(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), len(self.held)))
            self.held = bytearray()

    def close(self) -> list[tuple]:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.index


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """``start, bytes in the file, bytes of records`` of each frame, from the end of the archive."""
    size = file.size()
    frames, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entries = struct.iter_unpack("<II", file.read_at(8 * frames, size - 9 - 8 * frames))
    out, at = [], 0
    for packed, plain in entries:
        out.append((at, packed, plain))
        at += packed
    return out


def frame_of(file: pa.NativeFile, place: tuple[int, int, int]) -> memoryview:
    start, packed, plain = place
    return memoryview(zstandard.ZstdDecompressor().decompress(file.read_at(packed, start), max_output_size=plain))


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def firsts(pages: DataFrame) -> DataFrame:
    """``digest, first``: the smallest id of each payload of at least LEAST bytes that several rows have.  Null ids come last."""
    rows = pages.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return rows.where("n > 1 and first is not null").select("digest", "first")


def write(pages: DataFrame, folder: str, frame: int = FRAME, size: int = ARCHIVE) -> DataFrame:
    """Writes archives of ``pages(page_id, url, html, digest, first)`` and returns their index.

    Records are responses if ``first`` is null or their own id.  A task that is
    run again writes other files; the index names only those of the run that
    counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in sliced(batches):
            for page, url, html, digest, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                bundle = bundle or Bundle(folder, frame)
                kind = "response" if first is None or first == page else "revisit"
                bundle.add(page, kind, record(page, url, kind, first, digest, html.encode()))
                if bundle.written >= size:
                    yield rows_of(bundle.close(), INDEX)
                    bundle = None
        if bundle:
            yield rows_of(bundle.close(), INDEX)

    text = lambda c: F.col(c).cast("string").alias(c)
    return kept(pages.select(text("page_id"), "url", "html", "digest", text("first")).mapInArrow(run, INDEX))


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records of index rows, read frame by frame: ``page_id, record_type, refers_to, stated_digest, payload``.

    Rows are put in the order of their archive and frame within a task, so a
    frame is read once for all its records there, and no frame without one is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        path, number, file, table, data = None, None, None, [], memoryview(b"")
        for batch in sliced(batches):
            out = []
            for where, frame, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if where != path:
                    if file is not None:
                        file.close()
                    file = store.open_input_file(where)
                    path, number, table = where, None, seek_table(file)
                if frame != number:
                    number, data = frame, frame_of(file, table[frame])
                fields, payload, _ = parse(data, at)
                out.append((fields.get("X-Page-ID"), fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"), fields["WARC-Payload-Digest"].removeprefix("sha256:"), bytes(payload)))
            yield rows_of(out, BACK)
        if file is not None:
            file.close()

    wanted = index.where("record_type <> 'warcinfo'").select("path", "frame", "at")
    return wanted.repartition("path", "frame").sortWithinPartitions("path", "frame", "at").mapInArrow(run, BACK)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **sizes: int) -> tuple[DataFrame, str]:
    """Writes one record a page below the shared folder and returns the index and the folder, which goes when the session's JVM ends.

    A null html is the empty payload, a null url or id has no header field.
    ``sizes`` are those of a frame and an archive (``write``).
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    rows = rows.withColumn("digest", sha256_of(F.col("html")))
    return write(rows.join(few(kept(firsts(rows))), "digest", "left"), folder, **sizes), folder


def report(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from the archives.

    Digests and sizes of responses are those of the bytes read back; those of
    revisits are of the response that they refer to.  Rows with the id and
    payload of a response are responses too; a null id refers to the smallest
    other one, and where all ids of a payload are null each is a response.
    """
    index, folder = archive(pages)
    back = fetch(index, folder).select("page_id", "record_type", "refers_to", "stated_digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    back = kept(back)
    wanted = back.where("refers_to is not null").select(F.col("refers_to").alias("page_id"), F.col("stated_digest").alias("payload_digest")).distinct()
    stored = kept(back.where("record_type = 'response'").join(few(kept(wanted)), ["page_id", "payload_digest"], "left_semi").select("page_id", "payload_bytes", "payload_digest").distinct())
    again = back.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("stated_digest").alias("payload_digest"))
    again = again.join(few(stored.withColumnRenamed("page_id", "refers_to")), ["refers_to", "payload_digest"], "left")
    kind = pages.schema["page_id"].dataType
    rows = back.where("record_type = 'response'").drop("stated_digest").unionByName(again)
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
