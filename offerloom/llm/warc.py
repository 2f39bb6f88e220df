"""WARC archives with an index: written by tasks, read back by coalesced byte ranges.

Every task writes archives of its own on the shared folder, one gzip member per record, and gives one index row
per record (archive, offset, length, url, digest).  The index is a table; readers sort the wanted index rows by
place and read neighbouring records in one request.  A failed task's archives are in no index.

Defined cases: a null page is an empty payload; a null or empty url has no target header; a row without page id
is always a response and gets a random record id; rows that repeat a page id each have their own record, and
all rows with the smallest page id of equal payloads are responses.  An empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ship
from offerloom.session import cut_lineage, ensure_checkpoint_dir

ship(__name__)

#: Equal payloads of at least this size are stored once.
LEAST_REVISIT = 100
#: An archive is closed when it has this size.
ARCHIVE_BYTES = 256 << 20
#: Records of one stretch of an archive are read by one task.
STRETCH_BYTES = 16 << 20
#: One request reads at most this much, over gaps up to the second figure.
REQUEST_BYTES, GAP_BYTES = 8 << 20, 64 << 10
WARC_DATE = "2024-01-01T00:00:00Z"

INDEX = (
    "page_id long, archive string, offset long, length long, url string, payload_digest string, "
    "record_type string, refers_to long"
)
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan_records(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT
) -> DataFrame:
    """Pages with the digest of the payload and what kind of record they become.

    Copies are counted on digests alone; the payload is joined to the few digests that repeat.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", F.sha2("html", 256))
    copies = (
        rows.where(F.octet_length("html") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    again = F.col("page_id") > F.col("first_id")
    return rows.join(copies, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(again, F.col("first_id")).alias("refers_to")
    )


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a Hadoop path."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder[5:]}"
    return pafs.FileSystem.from_uri(folder)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    name = f"urn:x-page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{refers_to}>",
            f"X-Payload-Length: {len(payload)}",
        ]
        block = f"{http}\r\n".encode()
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, payload) of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError(f"cut record {fields['WARC-Record-ID']}")
    page = re.fullmatch(r"<urn:x-page:(-?\d+)>", fields["WARC-Record-ID"])
    page_id = int(page[1]) if page else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        refers = int(re.fullmatch(r"<urn:x-page:(-?\d+)>", fields["WARC-Refers-To"])[1])
        return page_id, "revisit", refers, int(fields["X-Payload-Length"]), digest, None
    payload = block.partition(b"\r\n\r\n")[2]
    found = hashlib.sha256(payload).hexdigest()
    if found != digest:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not match")
    return page_id, "response", None, len(payload), found, payload


def _writer(folder: str, archive_bytes: int, level: int):
    names = [part.split()[0] for part in INDEX.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = record_bytes(page_id, url, html.encode(), digest, refers_to)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, name, offset, len(member), url, digest, kind, refers_to))
                    offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return write


def archive_folder(spark) -> str:
    """A new folder for archives, below the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/archives/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write the records of ``plan_records`` to archives in ``folder``; the index as a table."""
    rows = planned.select("page_id", "url", "html", "digest", "refers_to")
    return cut_lineage(rows.mapInArrow(_writer(folder, archive_bytes, level), INDEX))


def _reader(folder: str, with_payload: bool):
    names = [part.split()[0] for part in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def requests(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Neighbouring records that are read together."""
        archive, spans = None, []
        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spans and (
                    name != archive
                    or offset - sum(spans[-1]) > GAP_BYTES
                    or offset + length - spans[0][0] > REQUEST_BYTES
                ):
                    yield archive, spans
                    spans = []
                archive = name
                spans.append((offset, length))
        if spans:
            yield archive, spans

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        for archive, spans in requests(batches):
            start = spans[0][0]
            with files.open_input_file(f"{base}/{archive}") as source:
                piece = source.read_at(sum(spans[-1]) - start, start)
            rows = []
            for offset, length in spans:
                row = parse_record(zlib.decompress(piece[offset - start : offset - start + length], 31))
                rows.append(row if with_payload else (*row[:-1], None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return read


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows.

    Rows go to tasks by stretches of an archive, sorted by offset, so that one request serves many records.
    Every payload is checked against its digest.
    """
    stretch = F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch")
    # By the bytes that are read, not by the size of the index rows.
    tasks = -(-index.agg(F.coalesce(F.sum("length"), F.lit(1))).first()[0] // STRETCH_BYTES)
    wanted = index.select("archive", "offset", "length", stretch).repartition(tasks, "archive", "stretch")
    wanted = wanted.sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return wanted.mapInArrow(_reader(folder, with_payload), RECORD)
