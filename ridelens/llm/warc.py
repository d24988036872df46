"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole records up
to ``FRAME`` bytes, and a last skippable frame with the seek table: compressed
and plain size of every frame, frame count, flags and magic number. Any
Zstandard reader can read the bundle whole. The index (a table) maps each
record to its bundle, frame and offset inside the plain frame, so one record
costs one ranged read and one frame.

Equal payloads: the smallest id is the response, the others are revisits
without a body; one aggregate by digest finds it and one join brings it back
(the only exchange of payloads; a digest with a third of all rows is split
by the skew join). Each task of that join streams its rows into bundles; a
task holds one frame at a time. Bundles are named by task attempt and only
those that the finished task listed are in the index, so a lost executor
leaves at most unlisted files.

Defined cases: a null payload is empty; rows with a null id are written and
read back with a null id and are never referred to; repeated rows are written each;
an empty table gives an empty index; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import stage
from ridelens.session import scratch_path

FRAME, BUNDLE, LEVEL = 1 << 18, 1 << 26, 3
LEAST_SHARED = 100  # smaller payloads are always stored
# FIXED VALUES: the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, path string, frame long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def make_record(page, url, payload: bytes, digest: str, refers) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    kind = "response" if refers is None else "revisit"
    body = payload if refers is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {url.strip()}" if url and url.isprintable() else None, f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {page}" if page is not None else None,
            f"WARC-Refers-To: {record_id(refers)}" if refers is not None else None, f"X-Refers-To-Page: {refers}" if refers is not None else None,
            "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(x for x in head if x).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("record length does not fit its header")
    return fields, body


def open_fs(uri: str):
    """(file system, path inside it) of a folder or file that Spark names: its S3 schemes are one, a plain path is local."""
    scheme, _, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    elif ":" not in uri.split("/", 1)[0]:
        uri = f"file://{uri}"
    try:
        return pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"no file system for archives in {uri}: use a file, hdfs, s3 (s3a), gs or abfs folder") from e


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(position, compressed size, plain size) of every frame."""
    size = file.size()
    count, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw, out, at = file.read_at(8 * count, size - 9 - 8 * count), [], 0
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


class BundleWriter:
    """Cuts records into frames and frames into bundles under one folder."""

    def __init__(self, folder: str, stem: str, frame: int = FRAME, bundle: int = BUNDLE):
        import zstandard

        self.frame, self.bundle = frame, bundle
        self.fs, self.root = open_fs(folder)
        self.uri, self.stem, self.n, self.out = folder, stem, 0, None
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.plain = bytearray()

    def add(self, record: bytes) -> tuple[str, int, int]:
        """Bundle, frame and offset at which the record lies."""
        if self.plain and len(self.plain) + len(record) > self.frame:
            self._end_frame()
        if self.out is None or self.size > self.bundle:
            self.close()
            self.n += 1
            self.name = f"{self.stem}-{self.n:05d}.warc.zst"
            self.out, self.frames, self.size = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), [], 0
        at = len(self.plain)
        self.plain += record
        return f"{self.uri}/{self.name}", len(self.frames), at

    def _end_frame(self) -> None:
        packed = self.packer.compress(bytes(self.plain))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.plain)))
        self.size += len(packed)
        self.plain = bytearray()

    def close(self) -> None:
        if self.out is not None:
            if self.plain:
                self._end_frame()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def with_responses(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, payload (binary), digest and ``refers_to`` (null for responses)."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = F.octet_length("payload") >= LEAST_SHARED
    first = rows.filter(shared).groupBy("digest").agg(F.min("page_id").alias("first")).withColumnRenamed("digest", "d2")
    rows = rows.join(first, (F.col("digest") == F.col("d2")) & shared, "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", payload_col: str = "html",
                   frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes the bundles; returns their index, written beside them."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    fs, root = open_fs(folder)  # a folder that executors could not open raises here, before any job
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer = BundleWriter(folder, f"part-{context.partitionId():05d}-{context.taskAttemptId()}", frame, bundle)
        for batch in batches:
            made = []
            for page, url, payload, digest, refers in zip(*[batch.column(i) for i in range(5)]):
                page, raw = page.as_py(), payload.as_py()
                record = make_record(page, url.as_py(), raw, digest.as_py(), refers.as_py())
                made.append((page, *writer.add(record), len(record)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))] if made
                                             else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())], names=["page_id", "path", "frame", "offset", "length"])
        writer.close()

    return stage(with_responses(pages, id_col, payload_col).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The indexed records, read from their bundles through the seek tables: only frames that hold a wanted
    record are read. Digest and length of every body are checked against its header."""
    schema = RECORDS + (", payload binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener, path, frame, file = zstandard.ZstdDecompressor(), None, None, None
        for batch in batches:
            made = []
            for row in zip(*[batch.column(c) for c in ("page_id", "path", "frame", "offset", "length")]):
                page, where, k, at, n = [x.as_py() for x in row]
                if where != path:
                    fs, inner = open_fs(where)
                    file, path, frame = fs.open_input_file(inner), where, None
                    table = read_seek_table(file)
                if k != frame:
                    begin, packed, plain = table[k]
                    data, frame = opener.decompress(file.read_at(packed, begin), max_output_size=plain), k
                fields, body = parse_record(data[at : at + n])
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                if fields["WARC-Type"] == "response":
                    digest, size = hashlib.sha256(body).hexdigest(), len(body)
                    if f"sha256:{digest}" != fields["WARC-Payload-Digest"] or size != int(fields["X-Payload-Length"]):
                        raise ValueError(f"payload of page {page} is damaged")
                said, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                made.append((int(said) if said else None, size, digest, fields["WARC-Type"], int(refers) if refers else None, body))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            columns = list(zip(*made)) if made else [()] * 6
            keep = 6 if payloads else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], types)], names=names[:keep])

    # rows of one frame side by side; a bundle of many small records spreads over tasks by runs of frames
    dealt = index.withColumn("_run", F.expr("frame div 64")).repartition("path", "_run").sortWithinPartitions("path", "frame", "offset")
    return dealt.drop("_run").mapInArrow(run, schema)
