"""WARC archives through a chunked record table.

A record's payload lies in rows (record, chunk number, chunk) of bounded size; chunk 0 also
carries the record's own data. Writer tasks take the chunks of their records in order and
stream them into gzip members; reader tasks stream archives back into chunk rows that carry
the length and the SHA-1 of the payload up to and including the chunk. Neither holds a
whole payload.

Payloads of min_revisit bytes or more are kept once: of equal ones, the record with the
largest id (of repeated rows, one of them) is a response, the others are revisits that
refer to it. The archived HTTP head gives the payload's length for both.

Archives go to the shared folder. A task attempt writes under a name of its own, and only
names that committed tasks report are read, so lost or repeated attempts do no harm.

Defined results: a null payload is empty; a null id is kept and is the least; a null address
is archived as urn:none; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

CHUNK = 256 * 1024
#: Payload bytes that an archive holds on average, before compression, where there are many.
ARCHIVE = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "record_id string, record_type string, refers_to string, uri string, stated_digest string, stated_bytes bigint, "
    "chunk_no int, chunk binary, bytes_so_far bigint, digest_so_far string, is_last boolean"
)


def chunked(records: DataFrame, id_col: str, uri_col: str, payload_col: str, chunk: int = CHUNK) -> DataFrame:
    """uid, chunk_no, n_chunks, chunk; id, uri, bytes, digest on chunk 0 and null on the others."""
    raw = records.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        F.coalesce(uri_col, F.lit("urn:none")).alias("uri"),
        F.coalesce(payload_col, F.lit("")).cast("binary").alias("payload"),
    )
    sized = raw.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    sized = sized.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk)).cast("int"))
    rows = sized.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    first = lambda c: F.when(F.col("chunk_no") == 0, F.col(c)).alias(c)
    return rows.select(
        "uid", "chunk_no", "n_chunks", *map(first, ("id", "uri", "bytes", "digest")),
        F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"),
    )


def revisits(chunks: DataFrame, min_revisit: int) -> DataFrame:
    """uid and refers_to of the records whose payload another one holds."""
    records = chunks.where("chunk_no = 0").select("uid", "id", "bytes", "digest").where(F.col("bytes") >= min_revisit)
    kept = records.groupBy("digest", "bytes").agg(F.max(F.struct("id", "uid")).alias("kept"), F.count("*").alias("n"))
    # Written before the join: then both sides are plain scans, and a digest that very many rows share can be split.
    kept = cut(kept.where("n > 1").select("digest", "bytes", "kept"), "kept-payloads")
    return records.join(kept, ["digest", "bytes"]).where("uid <> kept.uid").select("uid", F.col("kept.id").alias("refers_to"))


def _urn(value: object) -> str:
    return f"<urn:record:{value}>"


def _plain(uri: str) -> str:
    """Without what would end a header line."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in uri)


def _head(row: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    revisit = row["revisit"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(row['id'])}",
        f"WARC-Target-URI: {_plain(row['uri'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write(chunks: DataFrame, folder: str, min_revisit: int = 1000, level: int = 6, archive: int = ARCHIVE) -> DataFrame:
    """Writes archives from a table of chunked(); returns path, n_records. Their number grows with the payloads: one task writes about `archive` bytes, and one reads them."""
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // archive))
    seen = cut(revisits(chunks, min_revisit), "revisits").withColumn("revisit", F.lit(True))
    placed = chunks.join(seen, "uid", "left").where("revisit is null or chunk_no = 0")
    empty = F.lit(None).cast("binary")
    ordered = placed.select(
        "uid", "chunk_no", "n_chunks", F.col("id").cast("string").alias("id"), "uri", "bytes", "digest",
        F.coalesce("revisit", F.lit(False)).alias("revisit"), F.col("refers_to").cast("string").alias("refers_to"),
        F.when(F.col("revisit"), empty).otherwise(F.col("chunk")).alias("chunk"),
    ).repartition(parts, "uid").sortWithinPartitions("uid", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, root = pafs.FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, member, n = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                if row["chunk_no"] == 0:
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(member.compress(_head(row)))
                    n += 1
                if row["chunk"]:
                    out.write(member.compress(row["chunk"]))
                if row["revisit"] or row["chunk_no"] == row["n_chunks"] - 1:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return cut(ordered.mapInArrow(run, "path string, n_records bigint"), "archives")


def _headers(stream: io.BufferedReader) -> tuple[str, dict[str, str], int]:
    """First line, headers by lower-case name, bytes read."""
    first, found, n = stream.readline(), {}, 0
    n += len(first)
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        n += len(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return first.decode("utf-8", "replace").strip(), found, n + len(line)


def _number(urn: str | None) -> str | None:
    value = urn.removeprefix("<urn:record:").removesuffix(">") if urn else None
    return None if value == "None" else value


def _records(stream: io.BufferedReader, size: int) -> Iterator[dict]:
    while True:
        first, warc, _ = _headers(stream)
        if not first:
            return
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        left = int(warc["content-length"])
        http = {}
        if warc.get("content-type", "").startswith("application/http"):
            _, http, n = _headers(stream)
            left -= n
        stated = warc.get("warc-payload-digest", "").removeprefix("sha1:")
        row = {
            "record_id": _number(warc.get("warc-record-id")), "record_type": warc["warc-type"], "refers_to": _number(warc.get("warc-refers-to")),
            "uri": warc.get("warc-target-uri"), "stated_digest": base64.b32decode(stated).hex() if stated else None,
            "stated_bytes": int(http["content-length"]) if "content-length" in http else None,
        }
        sha, so_far, number = hashlib.sha1(), 0, 0
        while True:
            chunk = stream.read(min(left, size))
            if len(chunk) < min(left, size):
                raise ValueError("the archive ends within a record")
            left -= len(chunk)
            so_far += len(chunk)
            sha.update(chunk)
            if not left and row["record_type"] == "response" and row["stated_digest"] not in (None, sha.hexdigest()):
                raise ValueError(f"record {row['record_id']}: the payload isn't what its digest says")
            yield row | {"chunk_no": number, "chunk": chunk, "bytes_so_far": so_far, "digest_so_far": sha.hexdigest(), "is_last": not left}
            number += 1
            if not left:
                break
        stream.read(4)


def read(archives: DataFrame, chunk: int = CHUNK, with_chunks: bool = True) -> DataFrame:
    """The chunk rows (CHUNK_SCHEMA) of the archives in column path; without chunks, the last row of each record."""
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()),
        ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()),
        ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = pafs.FileSystem.from_uri(path)
                with files.open_input_stream(name, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    rows, held = [], 0
                    for row in _records(stream, chunk):
                        if with_chunks or row["is_last"]:
                            row["chunk"] = row["chunk"] if with_chunks else None
                            rows.append(row)
                            held += 500 + len(row["chunk"] or b"")
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    # A task for each archive, more or less.
    return archives.select("path").repartitionByRange(max(1, archives.count()), "path").mapInArrow(run, CHUNK_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = cut(chunked(table(spark, sf_dir, "pages"), "page_id", "url", "html"), "chunks")
    archives = write(chunks, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    last = read(archives, with_chunks=False)
    revisit = F.col("record_type") == "revisit"
    return last.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
