"""WARC archives through a table of payload chunks, so that no task holds a whole record.

The chunk table has a row per part of a payload: ``record_id`` (text), ``target_uri``, ``record_type`` (response or
revisit), ``refers_to`` (record id), ``payload_bytes`` and ``payload_digest`` (lower-case hex SHA-1) of the whole payload,
``chunk_no`` from 0, ``last`` and ``chunk``. Read back, it also has ``bytes_so_far`` and ``digest_so_far``, the length and
the SHA-1 of the payload up to and with the chunk: those of the last chunk are those of the payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm.common import scratch, staged, utf8

CHUNK = 256 << 10
FILE_BYTES = 64 << 20
#: Payloads with fewer bytes are always stored.
REVISIT_BYTES = 1000
#: What follows is fixed by the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNKS = (
    "record_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
    "chunk_no int, last boolean, chunk binary"
)
READ = CHUNKS + ", bytes_so_far long, digest_so_far string"


def records(pages: DataFrame, id: str = "page_id", uri: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """A record per row: chunk-table columns without the chunks, and ``payload``. A null payload is empty.

    Of records with equal payloads of ``revisit_bytes`` or more, the one with the largest id is the response and the others
    revisit it; rows that repeat that id are responses too. A null id is smaller than any other and becomes the empty
    record id; a null address is empty. Only digests that occur more than once are joined, so payloads are moved only if
    the table of those is too large to be broadcast.
    """
    own = pages.select(F.col(id).alias("__id"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("target_uri"), utf8(F.col(payload)).alias("payload"))
    sized = own.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    shared = (
        sized.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
        .agg(F.max("__id").alias("__keeper"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1 and __keeper is not null")
        .drop("__n")
    )
    shared = staged(shared, "shared-payloads")
    met = (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes"))
    other = F.col("__keeper").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__keeper"))
    return sized.join(shared, met, "left").select(
        F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("record_id"),
        "target_uri",
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("__keeper").cast("string")).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        "payload",
    )


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Cuts payloads into rows that stay together and in order; a revisit and an empty payload are one row without bytes."""
    stored = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.length("payload"))
    highest = F.greatest(F.ceil(stored / chunk_bytes) - 1, F.lit(0)).cast("int")
    cut = records.withColumn("__highest", highest).select(
        *[c for c in records.columns if c != "payload"], "payload", "__highest", F.explode(F.sequence(F.lit(0), F.col("__highest"))).alias("chunk_no")
    )
    part = F.substr(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return cut.select(
        *[c for c in records.columns if c != "payload"],
        "chunk_no",
        (F.col("chunk_no") == F.col("__highest")).alias("last"),
        F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(part).alias("chunk"),
    )


def _urn(record_id: str) -> str:
    return f"<urn:page:{quote(record_id, safe='')}>"


def _id(urn: str) -> str:
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">"))


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _head(row: dict) -> bytes:
    """The record's header, and the HTTP header that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    stored = row["payload_bytes"] if row["record_type"] == "response" else 0
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_urn(row['record_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(row['target_uri'], safe=';/?:@&=+$,#%[]!~*()')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{_base32(row['payload_digest'])}",
    ]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    lines.append(f"Content-Length: {len(http) + stored}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class ArchiveWriter:
    """Archives of a task, a gzip member per record, a new file when one has its bytes. Chunks pass through one by one."""

    def __init__(self, folder: str, name: str, file_bytes: int, level: int) -> None:
        self.system, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.name, self.file_bytes, self.level = name, file_bytes, level
        self.files: list[tuple[str, int, int]] = []
        self.stream, self.member, self.records, self.raw = None, None, 0, 0

    def add(self, row: dict) -> None:
        if row["chunk_no"] == 0:
            if self.stream is None:
                self.path = posixpath.join(self.folder, f"{self.name}-{len(self.files):04d}.warc.gz")
                self.stream, self.records, self.raw = self.system.open_output_stream(self.path, compression=None), 0, 0
            self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            self.digest, self.size, self.row = hashlib.sha1(), 0, row
            self._put(_head(row))
        elif self.member is None or row["record_id"] != self.row["record_id"] or row["chunk_no"] != self.row["chunk_no"] + 1:
            raise ValueError(f"chunk {row['chunk_no']} of record {row['record_id']} does not follow its predecessor")
        self.row = row
        self.digest.update(row["chunk"])
        self.size += len(row["chunk"])
        self._put(row["chunk"])
        if row["last"]:
            stored = row["record_type"] == "response"
            if stored and (self.size, self.digest.hexdigest()) != (row["payload_bytes"], row["payload_digest"]):
                raise ValueError(f"the chunks of record {row['record_id']} do not have its length and digest")
            self._put(b"\r\n\r\n")
            self.stream.write(self.member.flush())
            self.member = None
            self.records += 1
            if self.raw >= self.file_bytes:
                self.close()

    def _put(self, data: bytes) -> None:
        self.raw += len(data)
        self.stream.write(self.member.compress(data))

    def close(self) -> None:
        if self.member is not None:
            raise ValueError(f"record {self.row['record_id']} has no last chunk")
        if self.stream is not None:
            self.stream.close()
            self.files.append((self.path, self.records, self.raw))
            self.stream = None


def write_archives(chunks: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, level: int = 4) -> DataFrame:
    """Writes the chunk rows, which must be in order within each record, and returns the written list of archives: ``path``,
    ``records``, ``bytes`` before compression. A file's name has the task's attempt, and only files of tasks that succeeded
    are listed, so lost or repeated tasks do no harm. No rows make no files."""
    spark = chunks.sparkSession
    folder = folder or scratch(spark, "warc")
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = ArchiveWriter(folder, f"{task.partitionId():05d}-{task.taskAttemptId()}", file_bytes, level)
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                for row in batch.slice(begin, 64).to_pylist():
                    writer.add(row)
        writer.close()
        paths, counts, sizes = zip(*writer.files, strict=True) if writer.files else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"]
        )

    names = [field.split()[0] for field in CHUNKS.split(", ")]
    listed = chunks.select(*names).mapInArrow(write, "path string, records long, bytes long")
    return staged(listed.withColumn("folder", F.lit(folder)), "archives")


def _record_heads(stream) -> Iterator[tuple[dict[str, str], int]]:
    """Header fields of each record of an archive, the stream standing at its block; the block must be read before the next."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        yield fields, int(fields["content-length"])
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")


def _read(stream, chunk_bytes: int, payloads: bool) -> Iterator[tuple]:
    for fields, size in _record_heads(stream):
        http = {}
        while (line := stream.readline()) != b"\r\n":
            size -= len(line)
            name, _, value = line.decode().partition(":")
            http[name.lower()] = value.strip()
        size -= 2
        digest, done, number = hashlib.sha1(), 0, 0
        stored = fields["warc-type"] == "response"
        wanted = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        refers = _id(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        while True:
            data = stream.read(min(chunk_bytes, size - done))
            if not data and done < size:
                raise ValueError("a record is cut off")
            digest.update(data)
            done += len(data)
            last = done == size
            if last and stored and digest.hexdigest() != wanted:
                raise ValueError(f"record {fields['warc-record-id']} does not have its digest")
            yield (
                _id(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], refers, int(http["content-length"]), wanted,
                number, last, data if payloads else b"", done, digest.hexdigest(),
            )
            number += 1
            if last:
                break


def read_archives(spark: SparkSession, archives: DataFrame, chunk_bytes: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk rows of the listed archives (``path``, ``folder``), an archive per task at a time. Every stored payload is
    checked against its digest. Without ``payloads`` the bytes are read and digested, and not handed on."""
    files = archives.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()),
             ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())]
        )
        for batch in batches:
            for path, folder in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                system, _ = pyarrow.fs.FileSystem.from_uri(folder)
                held, size = [], 0
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in _read(stream, chunk_bytes, payloads):
                        held.append(row)
                        size += len(row[8]) + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("path", "folder").repartition(max(1, files)).mapInArrow(read, READ)


def record_table(chunks: DataFrame) -> DataFrame:
    """A row per record from chunk rows that were read: ``record_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``. The length and digest of a response are those of the bytes read; a revisit has those of the response that
    it names, found by id and digest."""
    ends = chunks.where("last").select("record_id", "record_type", "refers_to", "payload_digest", "bytes_so_far", "digest_so_far")
    ends = staged(ends, "records")
    responses = ends.where("record_type = 'response'")
    revisits = ends.where("record_type = 'revisit'")
    named = responses.select(
        F.col("record_id").alias("__id"), F.col("digest_so_far").alias("__digest"), F.col("bytes_so_far").alias("__bytes")
    ).distinct()
    found = revisits.join(named, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    columns = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(
        "record_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    ).unionByName(
        found.select("record_id", F.col("__bytes").alias("payload_bytes"), F.col("__digest").alias("payload_digest"), "record_type", "refers_to").select(*columns)
    )
