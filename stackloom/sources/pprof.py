"""The pprof interchange format: gzip or plain protobuf files to sample rows and back, and merging.

A sample row is ``(file, sample_types array<struct<type, unit>>, period_type, period_unit, period, time_nanos,
duration_nanos, frames, values, labels)``: stacks root first, inlined calls as frames of their own, a
location without lines as ``0x`` and its address. Files are decoded and encoded one to a task's
row by a small reader of protobuf's wire format; everything else is DataFrame work.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "file string, sample_types array<struct<type:string,unit:string>>, period_type string, period_unit string, period long, time_nanos long, "
    "duration_nanos long, frames array<string>, values array<long>, labels map<string,string>"
)
HEADER = ["sample_types", "period_type", "period_unit"]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("a profile is cut short")
        else:
            width = {1: 8, 5: 4}[kind]
            value, at = int.from_bytes(data[at : at + width], "little"), at + width
        yield tag >> 3, value


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ints(value: int | bytes) -> list[int]:
    """A repeated number, packed or not."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x)
    return out


def _message(data: bytes) -> dict[int, int]:
    return {k: v for k, v in _fields(data) if isinstance(v, int)}


def unpack(data: bytes, most: int = 0) -> bytes:
    """Uncompressed bytes, ``most`` at the most (0: any number); more are an error, found without unpacking them all."""
    if data[:2] == b"\x1f\x8b":
        opened = zlib.decompressobj(31)
        out = opened.decompress(data, most + 1 if most else 0)
    else:
        out = data
    if most and len(out) > most:
        raise ValueError(f"a profile has more than {most} bytes")
    return out


def decode(data: bytes, most: int = 0) -> list[tuple]:
    """The sample rows of one file, without its name. References that lead nowhere are an error."""
    try:
        return _decoded(unpack(data, most))
    except (IndexError, KeyError) as e:
        raise ValueError("a profile is cut short or refers to what it does not hold") from e


def _decoded(data: bytes) -> list[tuple]:
    text, types, samples, locations, functions, head, period_type = [], [], [], {}, {}, {}, {}
    for k, v in _fields(data):
        if k == 1:
            types.append(_message(v))
        elif k == 2:
            samples.append(v)
        elif k == 4:
            own, lines = 0, []
            address = 0
            for n, x in _fields(v):
                own, address = (x, address) if n == 1 else (own, x) if n == 3 else (own, address)
                if n == 4:
                    lines.append(_message(x).get(1, 0))
            locations[own] = (address, lines)
        elif k == 5:
            f = _message(v)
            functions[f.get(1, 0)] = f.get(2, 0)
        elif k == 6:
            text.append(v.decode("utf-8", "replace"))
        elif k == 11:
            period_type = _message(v)
        elif isinstance(v, int):
            head[k] = _signed(v)
    kinds = [{"type": text[t.get(1, 0)], "unit": text[t.get(2, 0)]} for t in types]
    of = [text[period_type.get(1, 0)], text[period_type.get(2, 0)]] if period_type else ["", ""]
    common = (kinds, *of, head.get(12, 0), head.get(9, 0), head.get(10, 0))
    rows = []
    for s in samples:
        stack, values, labels = [], [], {}
        for n, x in _fields(s):
            if n == 1:
                stack += _ints(x)
            elif n == 2:
                values += map(_signed, _ints(x))
            elif n == 3 and 2 in (pair := _message(x)):
                labels[text[pair.get(1, 0)]] = text[pair[2]]
        if len(values) != len(kinds):
            raise ValueError("a sample has not as many values as the profile has types")
        frames = []
        for location in stack:
            address, lines = locations[location]
            frames += [text[functions[f]] for f in lines] or [f"0x{address:x}"]
        rows.append((*common, frames[::-1], values, labels))
    return rows


def read(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """Sample rows of the files under ``path``; a file that unpacks to more than ``most`` bytes is an error."""
    return decoded(spark.read.format("binaryFile").load(path), most)


def decoded(files: DataFrame, most: int = 0) -> DataFrame:
    """Sample rows of ``files(path, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("file", pa.string()), ("sample_types", pa.list_(pa.struct([("type", pa.string()), ("unit", pa.string())]))), ("period_type", pa.string()), ("period_unit", pa.string()), ("period", pa.int64())]
            + [("time_nanos", pa.int64()), ("duration_nanos", pa.int64()), ("frames", pa.list_(pa.string())), ("values", pa.list_(pa.int64())), ("labels", pa.map_(pa.string(), pa.string()))]
        )
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file, *r[:-1], list(r[-1].items())) for r in decode(data.as_py(), most)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def merge(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One profile per ``by``: values of equal stacks and labels summed, the earliest time, durations summed, the largest period.

    Profiles of other sample or period types in one group are an error. Samples whose values are all 0 go.
    """
    # a file's header stands on each of its rows and counts once
    files = rows.groupBy(*by, "file", *HEADER).agg(F.first("time_nanos").alias("time_nanos"), F.first("duration_nanos").alias("duration_nanos"), F.first("period").alias("period"))
    kinds = F.count_distinct(F.struct(*HEADER))
    head = files.groupBy(*by).agg(kinds.alias("kinds"), *[F.first(c).alias(c) for c in HEADER], F.min("time_nanos").alias("time_nanos"), F.sum("duration_nanos").alias("duration_nanos"), F.max("period").alias("period"))
    head = head.withColumn("period", F.when(F.col("kinds") > 1, F.raise_error(F.lit("profiles of other types cannot be merged"))).otherwise(F.col("period"))).drop("kinds")
    each = rows.select(*by, "frames", F.array_sort(F.map_entries("labels")).alias("labels"), F.posexplode("values").alias("at", "v"))
    sums = each.groupBy(*by, "frames", "labels", "at").agg(F.sum("v").alias("v")).groupBy(*by, "frames", "labels")
    summed = sums.agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v")).select(*by, "frames", F.map_from_entries("labels").alias("labels"), F.col("v.v").alias("values"))
    summed = summed.where(F.exists("values", lambda v: v != 0))
    joined = summed.join(head, list(by)) if by else summed.crossJoin(F.broadcast(head))  # one row
    return joined.select(*by, *HEADER, "period", "time_nanos", "duration_nanos", "frames", "values", "labels")


def _number(x: int) -> bytes:
    out = bytearray()
    x &= (1 << 64) - 1
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def _part(field: int, value: int | bytes | list[int]) -> bytes:
    if isinstance(value, int):
        return _number(field << 3) + _number(value) if value else b""
    body = b"".join(map(_number, value)) if isinstance(value, list) else value
    return _number(field << 3 | 2) + _number(len(body)) + body


def encode(rows: list[dict]) -> bytes:
    """The gzip file of one profile's sample rows: a function and a location per distinct frame."""
    text, places = {"": 0}, {}
    ref = lambda s: text.setdefault(s or "", len(text))
    head = rows[0] if rows else {"sample_types": [], "period_type": "", "period_unit": "", "period": 0, "time_nanos": 0, "duration_nanos": 0}
    kind = lambda t, u: _part(1, ref(t)) + _part(2, ref(u))
    out = [_part(1, kind(t["type"], t["unit"])) for t in head["sample_types"]]
    for r in rows:
        ids = [places.setdefault(f, len(places) + 1) for f in reversed(r["frames"])]
        labels = [_part(3, _part(1, ref(k)) + _part(2, ref(v))) for k, v in sorted(dict(r["labels"] or {}).items())]
        out.append(_part(2, _part(1, ids) + _part(2, list(r["values"])) + b"".join(labels)))
    for name, i in places.items():
        out.append(_part(4, _part(1, i) + _part(4, _part(1, i))))
        out.append(_part(5, _part(1, i) + _part(2, ref(name))))
    out += [_part(9, head["time_nanos"]), _part(10, head["duration_nanos"]), _part(11, kind(head["period_type"], head["period_unit"])), _part(12, head["period"])]
    out += [_part(6, s.encode()) for s in text]
    return gzip.compress(b"".join(out), mtime=0)


def to_files(rows: DataFrame, by: str, most_samples: int = 0) -> DataFrame:
    """``(by, content)``: a profile's file per group of sample rows; more than ``most_samples`` in one (0: any number) are an error.

    A file is one value, so a group must fit a task: merge and truncate first.
    """
    n = F.count("*")
    listed = rows.groupBy(by).agg(F.collect_list(F.struct(*HEADER, "period", "time_nanos", "duration_nanos", "frames", "values", F.map_entries("labels").alias("labels"))).alias("rows"), n.alias("n"))
    if most_samples:
        listed = listed.withColumn("n", F.when(F.col("n") > most_samples, F.raise_error(F.lit("a profile has too many samples"))).otherwise(F.col("n"))).where("n > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [encode([{**r, "labels": {e["key"]: e["value"] for e in r["labels"]}} for r in rs]) for rs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], [by, "content"])

    return listed.select(by, "rows").mapInArrow(run, f"{by} {dict(rows.dtypes)[by]}, content binary")
