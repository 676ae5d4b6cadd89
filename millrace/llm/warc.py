"""WARC archives of pages, compressed record by record with a Zstandard dictionary.

A file begins with a skippable frame that holds its dictionary, built from the
records it archives; each record follows as a frame of its own, so any record can
be read from its offset with the dictionary alone. Addresses are archived as they
are. The table of pages has no time of capture, so that is a parameter. The files are written by the
executors to the shared folder under a temporary name and renamed when complete:
a task that is run again writes the same bytes to the same name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import files, shared_path

SKIPPABLE = 0x184D2A5D  # the frame that holds a dictionary
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
#: Records of about so many bytes make one file.
FILE_BYTES = 16 << 20
#: Pieces of records that the dictionary is trained on.
SAMPLE_BYTES = 2 << 10
CAPTURED = "1970-01-01T00:00:00Z"  # where nothing better is known


def record(page_id: int | None, url: str | None, html: bytes | None, captured: str = CAPTURED) -> bytes:
    """One WARC/1.1 resource record. Its id is made of page and content, so that it is the same at every writing."""
    body = html or b""
    name = uuid.UUID(bytes=hashlib.md5(repr((page_id, url, html is None)).encode() + body).digest(), version=4)
    head = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {captured}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in url or "\n" in url:  # no header can hold it as it is
            head.append("X-Original-URI: " + base64.b64encode(url.encode("utf-8", "surrogatepass")).decode())
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if html is None:
        head.append("X-Null-Payload: true")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, url, html (bytes or None), record_id, digest of a record; what a foreign record's header lacks is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for x in lines[1:]:
        name, _, value = x.partition(":")
        fields.setdefault(name.lower(), value.removeprefix(" "))
    url, page, digest = (fields.get(x) for x in ("warc-target-uri", "warc-page-id", "warc-payload-digest"))
    if "x-original-uri" in fields:
        url = base64.b64decode(fields["x-original-uri"]).decode("utf-8", "replace")
    return {
        "page_id": None if page is None else int(page),
        "url": url,
        "html": None if "x-null-payload" in fields else rest[: int(fields["content-length"])],
        "record_id": fields.get("warc-record-id"),
        "digest": None if digest is None else digest.removeprefix("sha256:"),
    }


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on pieces of all of ``records``, an eighth of their size at most; of the few that can't be trained on, their bytes."""
    samples = [x[i : i + SAMPLE_BYTES] for x in records for i in range(0, len(x), SAMPLE_BYTES)]
    size = min(size, max(256, sum(map(len, records)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # the trainer refuses: too few, or all alike
        return b"".join(dict.fromkeys(samples))[-size:]


def pack(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """A whole file, and (offset, length) of each record's frame."""
    raw = build_dictionary(records)
    held = zstandard.ZstdCompressionDict(raw)
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
    out, places = [struct.pack("<II", SKIPPABLE, len(raw)) + raw], []
    at = len(out[0])
    for x in records:
        frame = writer.compress(x)
        out.append(frame)
        places.append((at, len(frame)))
        at += len(frame)
    return b"".join(out), places


def frame_length(data: bytes, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from its header and those of its blocks (RFC 8878)."""
    kind = data[at + 4]
    single = kind >> 5 & 1
    to = at + 5 + (not single) + (0, 1, 2, 4)[kind & 3] + ((single, 2, 4, 8)[kind >> 6])
    last = False
    while not last:
        block = int.from_bytes(data[to : to + 3], "little")
        last = block & 1
        to += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a repeated byte is held once
    return to + (4 if kind & 4 else 0) - at


def unpack(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record of a file, in time linear in its size."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the file doesn't begin with a dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        length = frame_length(data, at)
        yield at, length, reader.decompress(data[at : at + length])
        at += length


def read_one(path: str, offset: int, length: int) -> dict:
    """One record by its place, as the index of :func:`write` has it."""
    fs, name = files(path)
    with fs.open_input_file(name) as f:
        _, size = struct.unpack("<II", f.read(8))
        held = zstandard.ZstdCompressionDict(f.read(size))
        f.seek(offset)
        return parse(zstandard.ZstdDecompressor(dict_data=held).decompress(f.read(length)))


def _writer(folder: str, captured: str):
    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = files(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        waiting: list[tuple[int | None, bytes]] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            data, places = pack([x for _, x in waiting])
            name = f"part-{task.partitionId():06d}-{number:05d}.warc.zst"
            temporary = f"{root}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, f"{root}/{name}")
            out = pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in waiting], pa.int64()), pa.array([name] * len(waiting)), pa.array([a for a, _ in places], pa.int64()), pa.array([b for _, b in places], pa.int64()), pa.array([len(x) for _, x in waiting], pa.int64())],
                names=["page_id", "file", "offset", "length", "record_bytes"],
            )
            waiting.clear()
            size, number = 0, number + 1
            return out

        for batch in batches:
            for i, url, html in zip(*(batch.column(k) for k in range(3)), strict=True):
                raw = html.as_py()
                x = record(i.as_py(), url.as_py(), raw, captured)
                waiting.append((i.as_py(), x))
                size += len(x)
                if size >= FILE_BYTES:
                    yield flush()
        if waiting:
            yield flush()

    return write_files


def write(pages: DataFrame, folder: str, captured: str = CAPTURED) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives to ``folder``; returns the index (page_id, file, offset, length, record_bytes), one row a record.

    The job runs once, here. A null html is an empty, marked record and comes back
    null; an empty one comes back empty; a null url or page_id has no header. A long
    html is one record, whole. Equal rows are as many records. Extra columns are
    ignored, whatever their names. An empty table gives no file. Every record has
    ``captured`` as its date.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"))
    index = rows.mapInArrow(_writer(folder, captured), "page_id long, file string, offset long, length long, record_bytes long")
    place = folder.rstrip("/") + "/index.parquet"
    index.write.parquet(place)
    return pages.sparkSession.read.schema(index.schema).parquet(place)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.binary()), ("record_id", pa.string()), ("digest", pa.string())]
    for batch in batches:
        for content in batch.column(0):
            found = [parse(raw) for _, _, raw in unpack(content.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in kinds], names=[n for n, _ in kinds])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in ``folder``: (page_id, url, html, record_id, digest); html is the bytes as they were."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(_reader, "page_id long, url string, html binary, record_id string, digest string")


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder, read the archives back: (page_id, url, html_bytes, html_sha256, payload_digest).

    ``html_sha256`` is of the html read back, ``payload_digest`` what the record's
    header says. With no pages the result is empty.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    index = write(pages, folder)
    if index.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, html_bytes long, html_sha256 string, payload_digest string")
    html = F.col("html")
    return read(spark, folder).select("page_id", "url", F.octet_length(html).cast("long").alias("html_bytes"), F.sha2(html, 256).alias("html_sha256"), F.col("digest").alias("payload_digest"))


SQL = """
        SELECT page_id, url, strlen(html)::BIGINT AS html_bytes, sha256(html) AS html_sha256, sha256(coalesce(html, '')) AS payload_digest
        FROM pages"""
