"""WARC archives whose records are compressed one by one with a dictionary of the archive's own.

An archive is a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) with a Zstandard dictionary,
itself a Zstandard frame, then a frame per record. A record can be read by seeking to its frame. The
dictionary is built from the records of that archive, taken evenly over it.

Records with equal payloads of at least ``least_bytes`` bytes are archived once: the one with the
smallest page id is a ``response``, the others are ``revisit`` records that name it and carry the
payload's length and digest, not the payload.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .files import put

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 8 << 20  # bytes of records after which an archive ends with the record
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20  # bytes of an archive's records that its dictionary is built from, about


# ---- records ----


def record_id(page_id: int | None, digest: str) -> str:
    """The name of a page's record, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A whole record. A revisit has the HTTP head of the payload, with its length, and no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    # an address may hold anything; line ends would end the field
    target = "urn:page:none" if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "2020-01-01T00:00:00Z"),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode("utf-8", "surrogatepass")
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record, of its HTTP head, and the payload it has."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of another length than it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- archives ----


def build_archive(records: list[bytes], level: int = 6) -> bytes:
    """The archive's bytes. Without enough records for a dictionary there is an empty one."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[: DICT_BYTES] for r in records[::step]]
    try:
        trained = zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 8)), samples, level=level)
        raw = trained.as_bytes()
    except zstandard.ZstdError:  # too few or too small records to learn from
        raw = b""
    frame = zstandard.ZstdCompressor(level=level).compress(raw)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(frame)), frame, *map(compressor.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("archive without a dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    rest = memoryview(data)[8 + size :]
    while len(rest):
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


# ---- tables ----


def _payload() -> F.Column:
    return F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, refers_to``: null for a response. The payload's digest alone is
    grouped and joined; the pages themselves meet only what is said of their own id."""
    keyed = pages.select(F.col("page_id").cast("bigint"), F.octet_length(_payload()).alias("n"), F.sha1(_payload()).alias("sha1")).where(F.col("n") >= least_bytes)
    keyed = materialise(keyed.select("page_id", "sha1"), "warc-digests")
    groups = keyed.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null")
    visits = keyed.join(groups.select("sha1", "first"), "sha1").where("page_id is null or page_id > first").distinct()
    said = materialise(visits.select(F.col("page_id").alias("said_id"), F.col("sha1").alias("said_sha1"), F.col("first").alias("refers_to")), "warc-revisits")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn("sha1", F.sha1(_payload()))
    return rows.join(said, F.col("page_id").eqNullSafe(F.col("said_id")) & (F.col("sha1") == F.col("said_sha1")), "left").drop("said_id", "said_sha1")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``plan_records`` into ``folder``; returns ``file, n_records, bytes`` of
    the archives written, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            name, data = f"part-{task:06d}-{number:06d}.warc.zst", build_archive(held)
            put(folder, name, data)
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                held.append(build_record(page_id.as_py(), url.as_py(), payload, digest, len(payload), refers_to.as_py()))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    # in a fixed order, so that a task that is run again writes the same archives
    ordered = records.sortWithinPartitions("page_id", "sha1", "url")
    return materialise(ordered.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, "file string, n_records bigint, bytes bigint"), "warc-files")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, file`` of every record.
    A response's length and digest are those of the payload read; a revisit's are the ones it names."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: int(s) if s else None
        for batch in batches:
            for name, data in zip(batch["file"].to_pylist(), batch["content"]):
                out = []
                for raw in read_archive(data.as_py()):
                    fields, http, payload = parse_record(raw)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        size, found = len(payload), base32_sha1(payload)
                        if found != digest:
                            raise ValueError(f"{fields['WARC-Record-ID']}: payload of another digest")
                    else:
                        size = int(http["Content-Length"])
                    url = fields["WARC-Target-URI"]
                    url = None if url == "urn:page:none" else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    out.append((number(fields["X-Page-ID"]), url, size, digest, kind, number(fields.get("X-Refers-To-Page-ID")), name))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)


NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write every page into ``folder``, new for this call, and read the archives back: one row per
    page as ``read_archives`` gives it.

    * null html: an empty payload, equal to other empty ones; null url: kept as null;
    * very long html: one record, one frame;
    * null ``page_id``: a revisit if a page with an id has its payload, else a response;
    * repeated rows: rows with the smallest id are responses all, others revisits;
    * empty table: no archive, no rows. Other columns are ignored, whatever their names.
    """
    return read_archives(write_archives(plan_records(pages, least_bytes), folder), folder)
