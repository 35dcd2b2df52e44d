"""WARC archives of Zstandard frames (operator 6): one frame per record, the dictionary in a leading skippable frame.

Archives are written by tasks, each rolled at ``ROLL_BYTES`` of record bytes, into a folder that all executors share, and
read back with Spark's binary file source. The reader loads the dictionary, decodes one frame per record and checks frame
sizes, required headers, Content-Length, the HTTP length and the payload digest; a fault stops the read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._text import slices, string_column

ROLL_BYTES = 16 << 20  # uncompressed record bytes in one archive; a longer record makes an archive of its own
DICTIONARY_BYTES, SAMPLE_BYTES, LEAST_SAMPLES = 16 << 10, 2 << 20, 16  # the dictionary is trained on the archive's first records
DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that holds a dictionary (fixed value of the format)
FRAME_MAGIC = 0xFD2FB528
DATE = "1970-01-01T00:00:00Z"  # the tables carry no fetch time
_loaded: dict[str, object] = {}


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: the response with its payload, or a revisit that only has the HTTP head."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive(records: list[bytes]) -> bytes:
    """The archive's bytes: dictionary frame, then one frame per record."""
    samples, held = [], 0
    for r in records:
        samples.append(r[: SAMPLE_BYTES // LEAST_SAMPLES])
        held += len(samples[-1])
        if held >= SAMPLE_BYTES:
            break
    trained = None
    if len(samples) >= LEAST_SAMPLES:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too little or too uniform to train on
            trained = None
    raw = trained.as_bytes() if trained else b""
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(compressor.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its block headers."""
    try:
        if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        flags = data[at + 4]
        single = flags >> 5 & 1
        size = (1 if single else 0, 2, 4, 8)[flags >> 6]
        at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + size
        while True:
            block = data[at] | data[at + 1] << 8 | data[at + 2] << 16
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
    except (IndexError, struct.error) as e:
        raise ArchiveError("truncated frame") from e
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ArchiveError("truncated frame")
    return at


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    view = memoryview(data)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ArchiveError("no dictionary frame at the start")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    if at > len(data):
        raise ArchiveError("truncated dictionary")
    raw = data[8:at]
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    while at < len(data):
        end = frame_end(view, at)
        try:
            yield decoder.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise ArchiveError(f"frame at byte {at}: {e}") from e
        at = end


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d*)>", urn or "")
    if found is None:
        raise ArchiveError(f"bad record id {urn}")
    return int(found[1]) if found[1] else None


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, record type, refers to) of a record after all checks."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ArchiveError("no WARC header")
    names = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in names:
            raise ArchiveError(f"bad header line {line[:80]}")
        names[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if need not in names:
            raise ArchiveError(f"header {need} is missing")
    if not names["content-length"].isdigit() or len(rest) != int(names["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length does not match the block")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or length is None:
        raise ArchiveError("no HTTP header")
    size, kind, digest = int(length[1]), names["warc-type"], names["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or payload_digest(payload) != digest:
            raise ArchiveError("payload does not match its length or digest")
        return _page(names["warc-record-id"]), size, digest, kind, None
    if kind != "revisit" or payload:
        raise ArchiveError(f"bad record of type {kind}")
    return _page(names["warc-record-id"]), size, digest, kind, _page(names.get("warc-refers-to"))


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file:" + folder if folder.startswith("/") else folder)


def _store(folder: str, name: str, data: bytes) -> None:
    """Whole or not at all: a second run of a task replaces the file by an equal one."""
    system, base = _filesystem(folder)
    system.create_dir(base, recursive=True)
    part = posixpath.join(base, f".{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, posixpath.join(base, name))


def write_archives(pages: DataFrame, folder: str, *, revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns (archive, records, bytes), lazily.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, that with the largest page_id is the response and the
    others revisit it (rows that share this page_id are all responses; a group with only null ids too). Null html and url
    are empty. Extra columns are left out. Only digests are aggregated; the texts meet their group's row in one join,
    which Spark splits where a digest is hot. A task's rows are sorted, so a repeated task writes the same files.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.when(F.octet_length("html") >= revisit_bytes, F.sha1(F.col("html").cast("binary"))))
    copies = keyed.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    joined = keyed.join(copies.select("sha", "refers_to"), "sha", "left")
    joined = joined.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(None)).otherwise(F.col("refers_to")))
    ready = joined.select("page_id", "url", "html", "refers_to").sortWithinPartitions("page_id", "url", "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, roll, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shut() -> pa.RecordBatch:
            nonlocal roll, held, size
            name = f"part-{part:05d}-{roll:05d}.warc.zst"
            data = archive(held)
            _store(folder, name, data)
            out = pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})
            roll, held, size = roll + 1, [], 0
            return out

        for batch in batches:
            texts = string_column(batch, "html")
            ids, urls, refer = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "refers_to"))
            for first, end, data, offsets in slices(texts):
                for i in range(end - first):
                    payload = data[offsets[i] : offsets[i + 1]].tobytes()
                    held.append(record(ids[first + i], urls[first + i], payload, payload_digest(payload), refer[first + i]))
                    size += len(held[-1])
                    if size >= ROLL_BYTES:
                        yield shut()
        if held:
            yield shut()

    return ready.mapInArrow(work, "archive string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record below ``folder``; ArchiveError on a fault."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows = [parse(raw) for raw in records(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
