"""Helpers shared by the operators: shared storage, input tables, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What these operators call white space between words and around lines.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and the master is local (tests on one machine)
    is a local one made; on a cluster a missing setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote and that no unfinished result reads any more."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def wide_hash(col, *names: str) -> list:
    """128 bits of a column as two longs: XXH64 under two unrelated seeds."""
    return [F.xxhash64(col).alias(names[0]), F.xxhash64(F.lit(1), col).alias(names[1])]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col, mod: int):
    """crc32 of the id's decimal text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(col).cast("string")) % mod


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null gives an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def bounded_sample(rows: DataFrame, key: str, most: int, then=None) -> list:
    """At most ``most`` rows, chosen by a hash of ``key``, as a list: all of them if there are no more.

    ``then``, a function of DataFrames that keeps ``_draw``, is applied to the drawn rows before they are gathered.

    Tasks pass on only rows under a hash threshold set from the count, half as
    many again as needed are expected, so what reaches the driver does not grow
    with the table or its partitions.
    """
    share = min(1.0, 1.5 * most / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 31))
    drawn = rows.withColumn("_draw", draw).where(F.col("_draw") < int(share * (1 << 31)))
    got = (then(drawn) if then else drawn).collect()
    return sorted(got, key=lambda r: (r["_draw"], str(r)))[:most]


#: Bytes of rows that Spark hands to Python at once.
ARROW_BYTES = 4 << 20


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` in batches bounded by bytes: ten thousand whole texts at once can be any size.

    The bound is a setting of the session, and stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def portions(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` have about ``most`` bytes together, a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().cumsum()
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
