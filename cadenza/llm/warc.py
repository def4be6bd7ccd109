"""WARC archives: writing monolithic gzip files, normalising them to one member a record, and reading them back.

``write_archives`` writes records as whole-file gzip streams, the form that crawlers without record compression leave.
``normalise`` inflates each such stream once, front to back, writes every record as a gzip member of its own and, beside the
members, a sidecar index (archive, record_no, offset, length, type, record id, target, payload digest); a file's members, joined in order,
are a valid ``.warc.gz`` in which any record can be read from its offset alone.  ``read_records`` reads the members back.

Files are kept as tables: an archive is rows (archive, chunk, content) of bounded size, so that Spark's committer decides which
attempt of a lost task counts, and any store that Spark reaches can hold them.  ``export_archives`` copies them to plain files.
``write_archives`` puts every archive into a Parquet file of its own with one row group, which a scan gives to one task in order, so
``normalise`` needs no shuffle for them; archives from elsewhere are first brought together and sorted.

Records of equal payload of at least ``least_bytes`` bytes: the one of the smallest page_id is the response, others are revisits
that carry the digest and length of the full payload and name its page and target.  Copies are counted by digest with a combining group-by, and only
payloads of that many bytes are joined with the counts, so small pages, which are often alike, meet nowhere.

Record ids are unique: they come from the archive and the record's place in it.  The page is a header of its own, as pages may share an id or have none.

Defined cases: null html is the empty payload; a null url is an empty target; a null page_id is written as an empty id, read back as null, and comes
after all others in its group (with no other id, its records are responses); repeated rows of the smallest page_id are all responses; line
breaks in urls are percent-encoded; an empty table writes empty archives' tables and reads no rows; other columns are ignored.  Memory is one
archive's compressed stream while its file is written or read, one Arrow batch, which Spark bounds by bytes, one chunk and one record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import pieces, remove, shared_dir

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = b"\r\n"


def page_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to, refers_to_url) of every row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("payload_bytes") >= least_bytes)
    # nulls are left out of the least page; an all-null group has none
    copied = large.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")).where("n > 1 and first is not null").select("payload_digest", "first")
    revisit = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    judged = large.join(copied, "payload_digest", "left").withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first.page_id")), "refers_to_url": F.when(revisit, F.col("first.url"))})
    small = rows.where(F.col("payload_bytes") < least_bytes).withColumn("record_type", F.lit("response"))
    return judged.drop("first").unionByName(small, allowMissingColumns=True).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to", "refers_to_url")


def _target(url: str) -> bytes:
    return url.replace("\r", "%0D").replace("\n", "%0A").encode()


def record_bytes(identity: str, page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_to_url: str | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and drops the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: {identity}".encode(), b"WARC-Target-URI: " + _target(url), f"WARC-Date: {_DATE}".encode(), b"Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}".encode()]
    lines.append(f"Page-ID: {'' if page_id is None else page_id}".encode())
    if kind == "revisit":
        lines += [f"Refers-To-Page-ID: {refers_to}".encode(), b"WARC-Refers-To-Target-URI: " + _target(refers_to_url or ""), f"WARC-Refers-To-Date: {_DATE}".encode(), f"WARC-Profile: {_PROFILE}".encode()]
    lines.append(f"Content-Length: {len(block)}".encode())
    return _BREAK.join(lines) + _BREAK * 2 + block + _BREAK * 2


class RecordParser:
    """Splits inflated bytes, given in pieces, into (headers, block, whole record)."""

    def __init__(self) -> None:
        self.rest = bytearray()

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """Yield the records that are now complete."""
        self.rest += piece
        at = 0
        while True:
            end = self.rest.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = bytes(self.rest[at:end]).split(_BREAK)
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("a record does not begin with a version line")
            headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
            start = end + 4
            stop = start + int(headers["content-length"])
            if len(self.rest) < stop + 4:
                break
            if self.rest[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a record does not end in two line breaks")
            yield headers, bytes(self.rest[start:stop]), bytes(self.rest[at : stop + 4])
            at = stop + 4
        del self.rest[:at]

    def close(self) -> None:
        """Nothing may be left over."""
        if self.rest:
            raise ValueError("the stream ends within a record")


_WRITTEN = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "refers_to_url")


def write_archives(records: DataFrame, path: str, archive_bytes: int = 64 << 20, chunk_bytes: int = 4 << 20, level: int = 1) -> DataFrame:
    """Write ``page_records`` as monolithic gzip streams, a table (archive, chunk, content), and return it.

    An archive ends with its task, or after so many chunks as make ``archive_bytes`` of the stream; that many rows are a file.
    """
    schema = pa.schema([("archive", pa.string()), ("chunk", pa.int64()), ("content", pa.binary())])
    chunks = max(1, archive_bytes // chunk_bytes)
    prefix = uuid4().hex  # ids of two crawls differ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chunk, record = TaskContext.get().partitionId(), 0, 0, 0
        out, stream = bytearray(), None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"crawl-{part:06d}-{number:05d}"]), pa.array([chunk], pa.int64()), pa.array([bytes(out)], pa.binary())], schema=schema)

        for batch in pieces(batches, 64):
            for r in zip(*(batch.column(k).to_pylist() for k in _WRITTEN), strict=True):
                if stream is None:
                    stream, chunk, record = zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = record_bytes(f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{prefix}/{part}/{number}/{record}')}>", *r)
                record += 1
                out += stream.compress(data)
                if len(out) >= chunk_bytes:
                    last = chunk + 1 == chunks
                    if last:
                        out += stream.flush()
                    yield row()
                    chunk, out = chunk + 1, bytearray()
                    if last:
                        stream, number = None, number + 1
        if stream is not None:
            out += stream.flush()
            yield row()

    table = records.select(*_WRITTEN).mapInArrow(run, "archive string, chunk long, content binary")
    table.write.option("maxRecordsPerFile", chunks).option("parquet.block.size", 1 << 30).parquet(path)
    return records.sparkSession.read.parquet(path)


_MEMBER = pa.schema(
    [("archive", pa.string()), ("record_no", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("payload_digest", pa.string()), ("content", pa.binary())]
)


def normalise(archives: DataFrame, path: str, level: int = 1, batch_bytes: int = 4 << 20, in_place: bool = False) -> tuple[DataFrame, DataFrame]:
    """Write members and the sidecar index under ``path`` and return both; takes streams of one member or many.

    ``in_place``: each archive lies whole and in order in one partition, as in what ``write_archives`` returns; a missing or misplaced chunk is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, inflate, parser = None, None, RecordParser()
        number = offset = held = expected = 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _MEMBER, strict=True)], schema=_MEMBER)

        for batch in pieces(batches, 1):
            for archive, chunk, content in zip(batch.column("archive").to_pylist(), batch.column("chunk").to_pylist(), batch.column("content"), strict=True):
                if archive != current:
                    parser.close()
                    current, inflate, parser, number, offset, expected = archive, zlib.decompressobj(31), RecordParser(), 0, 0, 0
                if in_place and chunk != expected:
                    raise ValueError(f"chunk {chunk} of {archive} comes where {expected} is due")
                expected += 1
                data = content.as_py()
                while data:
                    piece = inflate.decompress(data, 1 << 20)
                    if inflate.eof:
                        data, inflate = inflate.unused_data, zlib.decompressobj(31)
                    else:
                        data = inflate.unconsumed_tail
                    for headers, _, whole in parser.feed(piece):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(whole) + squeeze.flush()
                        rows.append((archive, number, offset, len(member), headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-payload-digest"), member))
                        number, offset, held = number + 1, offset + len(member), held + len(member)
                    if held >= batch_bytes:
                        yield flush()
                        rows, held = [], 0
        parser.close()
        if rows:
            yield flush()

    spark = archives.sparkSession
    ordered = archives if in_place else archives.repartition("archive").sortWithinPartitions("archive", "chunk")
    ordered.mapInArrow(run, "archive string, record_no long, offset long, length long, type string, record_id string, target string, payload_digest string, content binary").write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    members.drop("content").write.parquet(f"{path}/index")
    return members, spark.read.parquet(f"{path}/index")


def read_records(members: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload_ok) from the members alone."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            rows: list[tuple] = []
            for content in batch.column(0):
                parser = RecordParser()
                for headers, block, _ in parser.feed(zlib.decompress(content.as_py(), 31)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    stated = int(next(x.partition(b":")[2] for x in head.split(_BREAK) if x.lower().startswith(b"content-length")))
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    page, refers = headers["page-id"], headers.get("refers-to-page-id")
                    page = int(page) if page else None
                    if kind == "response":
                        found = hashlib.sha256(payload).hexdigest()
                        rows.append((page, len(payload), found, kind, None, found == digest and stated == len(payload)))
                    else:
                        rows.append((page, stated, digest, kind, int(refers) if refers else None, not payload))
                parser.close()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

    return members.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean")


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write and normalise archives of ``pages``; returns (records read back, members, index).  ``path`` is a folder that all executors share."""
    spark: SparkSession = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid4().hex}"
    members, index = normalise(write_archives(page_records(pages, least_bytes), f"{path}/monolithic"), path, in_place=True)
    remove(spark, f"{path}/monolithic")
    return read_records(members), members, index


def export_archives(members: DataFrame, folder: str) -> list[str]:
    """Copy normalised archives to plain ``.warc.gz`` files in a local folder, a row at a time; for hand-over, not for the cluster."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names: list[str] = []
    for r in members.orderBy("archive", "record_no").select("archive", "content").toLocalIterator():
        if not names or names[-1] != r.archive:
            names.append(r.archive)
            Path(folder, f"{r.archive}.warc.gz").write_bytes(b"")
        with Path(folder, f"{r.archive}.warc.gz").open("ab") as f:
            f.write(r.content)
    return [f"{folder}/{n}.warc.gz" for n in names]
