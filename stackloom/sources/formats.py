"""Text formats of stack samples: collapsed stacks, plain lines, perf script, speedscope JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_collapsed(lines: DataFrame, col: str = "value") -> DataFrame:
    """``a;b;c 12`` to ``(frames, value)``; the count follows the last blank, other lines are skipped."""
    at = F.regexp_extract(col, r"^(.*) (\d+)\s*$", 2)
    return lines.where(at != "").select(F.split(F.regexp_extract(col, r"^(.*) (\d+)\s*$", 1), ";").alias("frames"), at.cast("bigint").alias("value"))


def read_collapsed(spark: SparkSession, path: str) -> DataFrame:
    return parse_collapsed(spark.read.text(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One stack per line, counted."""
    return spark.read.text(path).where("value <> ''").groupBy(F.split("value", ";").alias("frames")).agg(F.count("*").alias("value"))


def parse_perf(events: DataFrame, col: str = "value") -> DataFrame:
    """``perf script`` events (text between blank lines) to ``(frames, value)``, the command as root."""
    lines = F.split(F.trim(F.col(col), F.lit("\n")), "\n")
    command = F.regexp_extract(F.get(lines, 0), r"^\s*(\S.*?)\s+\d+", 1)
    names = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.regexp_extract(x, r"^\s*[0-9a-fA-F]+ (.+?)(?:\+0x[0-9a-fA-F]+)?(?: \([^)]*\))?\s*$", 1))
    frames = F.concat(F.array(command), F.reverse(F.filter(names, lambda n: n != "")))
    return events.where(command != "").groupBy(frames.alias("frames")).agg(F.count("*").alias("value"))


def read_perf(spark: SparkSession, path: str) -> DataFrame:
    return parse_perf(spark.read.option("lineSep", "\n\n").text(path))


SPEEDSCOPE = "shared struct<frames:array<struct<name:string>>>, profiles array<struct<type:string,name:string,unit:string,samples:array<array<int>>,weights:array<double>,events:array<struct<type:string,frame:int,at:double>>,startValue:double>>"
#: Counts of one unit of time, which keep two places of it; bytes count as they are.
PRECISION = 100


def _weight(weight: Column, precise: Column) -> Column:
    """Whole units only, times the precision, except for bytes."""
    whole = F.when(weight < 0, F.raise_error(F.lit("a weight is negative"))).otherwise(F.floor(weight)).cast("bigint")
    return whole * F.when((F.col("unit") == "bytes") | ~precise, 1).otherwise(PRECISION)


def _spans(events: list, start: float) -> list[tuple[list[int], float, bool]]:
    """The stacks of opening and closing events, how long each stood, and whether a closing event ended it."""
    stack, out, at = [], [], start
    for e in events:
        if e["at"] < at:
            raise ValueError("events are not in order of time")
        closes = e["type"] == "C"
        if stack:
            out.append((list(stack), e["at"] - at, closes))
        at = e["at"]
        if not closes:
            stack.append(e["frame"])
        elif not stack or stack.pop() != e["frame"]:
            raise ValueError(f"frame {e['frame']} is closed but not open")
    return out


def parse_speedscope(files: DataFrame, col: str = "value") -> DataFrame:
    """Speedscope profiles, sampled and evented, to ``(profile, unit, frames, value)``; equal stacks are summed.

    An evented profile is a list of frames opening and closing; a stack's weight is the time it stands.
    Weights lose their fraction, then times count in hundredths, but for the time of an evented stack that ends
    when another frame opens: that counts in whole units. Empty stacks are left out; negative weights fail.
    """
    doc = files.select(F.from_json(col, SPEEDSCOPE).alias("d")).select(F.col("d.shared.frames.name").alias("names"), F.explode("d.profiles").alias("p"))
    doc = doc.select(F.col("p.name").alias("profile"), F.col("p.unit").alias("unit"), "names", "p")
    sampled = doc.where("p.type = 'sampled'").select("profile", "unit", "names", F.explode(F.arrays_zip(F.col("p.samples").alias("s"), F.col("p.weights").alias("w"))).alias("x")).withColumn("precise", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"s": s, "w": w, "c": c} for s, w, c in _spans(e or [], start or 0)] for e, start in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("s", pa.list_(pa.int32())), ("w", pa.float64()), ("c", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kind)], ["profile", "unit", "names", "x"])

    evented = doc.where("p.type = 'evented'").select("profile", "unit", "names", "p.events", "p.startValue").mapInArrow(run, "profile string, unit string, names array<string>, x array<struct<s:array<int>,w:double,c:boolean>>")
    rows = sampled.unionByName(evented.select("profile", "unit", "names", F.explode("x").alias("x")).select("profile", "unit", "names", F.struct("x.s", "x.w").alias("x"), F.col("x.c").alias("precise")))
    stack = F.transform(F.col("x.s"), lambda i: F.get(F.col("names"), i))
    return rows.where(F.size("x.s") > 0).select("profile", "unit", stack.alias("frames"), _weight(F.col("x.w"), F.col("precise")).alias("v")).groupBy("profile", "unit", "frames").agg(F.sum("v").alias("value"))


def read_speedscope(spark: SparkSession, path: str) -> DataFrame:
    return parse_speedscope(spark.read.option("wholetext", True).text(path))


#: What a file's extension says of its format.
EXTENSIONS = {"json": "json", "pprof": "pprof", "collapsed": "collapsed", "perf_script": "perf"}


def sniff(name: str, data: bytes) -> str:
    """The format of a file, by its extension, else by its first bytes: json, pprof, perf or collapsed."""
    extension = name.rpartition(".")[2] if "." in name else ""
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    text = "perf" if re.match(rb"^\S.*?\s+\d+.*:\s", data) and b"\n\t" in data else "collapsed"
    if extension == "txt":
        return text
    if len(data) < 2:
        raise ValueError("a profile has two bytes at least")
    if data[:1] == b"{":
        return "json"
    if data[:2] == b"\x1f\x8b":
        return "pprof"
    return text if all(chr(b).isprintable() or chr(b).isspace() for b in data[:100]) else "pprof"


def write_collapsed(tree: DataFrame, path: str) -> None:
    """A line per node with own value, in as many files as the table has partitions."""
    tree.where("self > 0").select(F.concat_ws(" ", F.concat_ws(";", "path"), "self").alias("value")).write.text(path)
