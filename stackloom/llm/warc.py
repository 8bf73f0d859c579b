"""WARC archives: writing, reading back, and revisit resolution.

Headers (id, digest, length; no payload) are shuffled by payload digest. Of
records with equal payloads the one with the largest id stays a response, the
others become revisits with fresh headers and no payload. Archives are written
by Spark's text sink: a row is a whole record, the line separator is the
record's closing CRLF CRLF, so any store that Spark writes to will do. That sink
compresses whole files, not single records; files are bounded by bytes instead, and
a reader unpacks them piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, portions, release, scratch, stored, utf8

CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
#: Bytes of an archive file before compression; one longer record makes a file of its own.
FILE_BYTES = 32 << 20
#: Bytes that a reader unpacks at once.
PIECE = 1 << 20


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(rid: int | None, url: str | None, date: str, digest: str, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record without its closing blank lines; ``payload`` None makes a revisit."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    if payload is not None:
        http.append(b"Content-Length: %d" % len(payload))
    block = CRLF.join(http) + CRLF + CRLF + (payload or b"")
    uri = (url or "urn:x-unknown").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if rid is None else rid}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block


def unpacked(data: bytes) -> Iterator[bytes]:
    """The content of gzip members, one after another, in pieces of at most ``PIECE`` bytes."""
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(data, PIECE)
            data = member.unconsumed_tail
            if piece:
                yield piece
            elif not data and not member.eof:
                raise ValueError("an archive is cut short")
        data = member.unused_data


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, block) pairs of an archive's pieces, in order; header names in lower case.

    Holds one record at a time, and a piece.
    """
    source, held = iter(pieces), bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        seen = 0
        while (end := held.find(CRLF + CRLF, max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("an archive ends within a record's headers")
        version, *fields = held[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        head = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
        stop = end + 4 + int(head["content-length"])
        if not fill(stop + 4):
            raise ValueError("an archive ends within a record")
        yield head, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def _page_id(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(RECORD_ID)
    return int(number) if number else None


def headers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest)`` of each row; a null payload counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(payload_digest, texts), pa.string())], ["page_id", "payload_bytes", "payload_digest"])

    return pages.select(F.col(id_col).cast("long"), html_col).transform(map_arrow, run, "page_id long, payload_bytes long, payload_digest string")


def resolve_revisits(heads: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the largest id with the same digest if that is another row's, else null.

    Payloads under ``min_payload_bytes`` never refer; nor do rows with a null id,
    which cannot be referred to either. Rows that share the largest id all stay.
    """
    last = heads.where(F.col("payload_bytes") >= min_payload_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    # written, so that both sides of the join are plain shuffles and a digest that many pages share is split
    joined = heads.join(stored(last.select("payload_digest", "last"), "last-copies"), "payload_digest", "left")
    return joined.withColumn("refers_to", F.when((F.col("last") != F.col("page_id")) & (F.col("payload_bytes") >= min_payload_bytes), F.col("last"))).drop("last")


def write_archives(pages: DataFrame, path: str, min_payload_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages(page_id, url, html)`` under ``path``, payloads once.

    A null url is written as ``urn:x-unknown``, a null id as an empty record id;
    other columns are left out; an empty table writes no record.
    """
    heads = stored(headers(pages), "headers")
    same = resolve_revisits(heads, min_payload_bytes).where("refers_to is not null").select("page_id", "payload_digest", "refers_to").distinct()
    body = pages.select(F.col("page_id").cast("long"), "url", "html")
    moved = same.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("payload_digest", "refers_to"))).alias("moved"))
    joined = body.join(moved.hint("shuffle_hash"), "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = size = 0
        for whole in batches:
            for batch in portions(whole, 2):
                out, parts = [], []
                for rid, url, payload, move in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    digest = payload_digest(payload)
                    target = dict(move or ()).get(digest)
                    record = record_bytes(rid, url, date, digest, payload if target is None else None, target)
                    if size and size + len(record) > FILE_BYTES:
                        part, size = part + 1, 0
                    size += len(record)
                    out.append(record)
                    parts.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(parts, pa.int32())], ["value", "part"])

    records = joined.select("page_id", "url", "html", "moved").transform(map_arrow, run, "value binary, part int").select(F.col("value").cast("string"), "part")
    records.write.partitionBy("part").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    release(heads)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records under ``path`` as they stand: id, type, url, digest header, own payload's size and digest.

    Files are unpacked in pieces; a task holds a compressed file, a piece and some records. No file: no record.
    """
    names = ["page_id", "record_type", "url", "payload_digest", "refers_to", "own_bytes", "own_digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    schema = "page_id long, record_type string, url string, payload_digest string, refers_to long, own_bytes long, own_digest string"
    if payloads:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in parse_records(unpacked(data.as_py())):
                    body = block[block.index(CRLF + CRLF) + 4 :]
                    response = head["warc-type"] == "response"
                    row = (
                        _page_id(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"), head["warc-payload-digest"].removeprefix("sha1:"),
                        _page_id(head.get("warc-refers-to")), len(body) if response else None, payload_digest(body) if response else None,
                    )
                    rows.append((*row, body if response else None) if payloads else row)
                    size += len(body) if payloads else 200
                    if size > PIECE:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path)
    return files.select("content").transform(map_arrow, run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Per record its full payload's size and digest, revisits taking them from the response they refer to.

    The archives behind ``records`` are read once. A revisit whose response is missing has null for both.
    """
    records = stored(records.drop("payload"), "records")
    response = records.where("record_type = 'response'")
    full = response.select(F.col("page_id").alias("target"), F.col("own_bytes").alias("full_bytes"), F.col("own_digest").alias("full_digest")).distinct()
    full = stored(full.join(records.where("record_type = 'revisit'").select(F.col("refers_to").alias("target")).distinct(), "target", "left_semi"), "referred")
    revisit = records.where("record_type = 'revisit'")
    found = revisit.join(full, (revisit.refers_to == full.target) & (revisit.payload_digest == full.full_digest), "left")
    pick = lambda size, digest: ["page_id", F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), "record_type", "refers_to"]
    return response.select(*pick("own_bytes", "own_digest")).unionByName(found.drop("payload_digest").select(*pick("full_bytes", "full_digest")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return resolved(read_archives(spark, path))
