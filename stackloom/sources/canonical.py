"""Profile tables as they are stored, and their joins.

* ``profiles(profile_id, series_key, ts_ms, partition, labels, samples array<struct<stack_id, value, span_id, trace_id>>)``
* ``stacktraces(partition, stack_id, location_ids)``, leaf first
* ``locations(partition, location_id, address, mapping, lines array<struct<function_id, line>>)``, innermost line first
* ``functions(partition, function_id, name, filename)``

Ids mean something within a partition only. Stacks come out root first, inlined calls as frames of their own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import series_key
from ..functions.storage import cut
from .tables import order_samples


class Tables(NamedTuple):
    profiles: DataFrame
    stacktraces: DataFrame
    locations: DataFrame
    functions: DataFrame


def read(spark: SparkSession, path: str) -> Tables:
    return Tables(*[spark.read.parquet(f"{path}/{name}") for name in Tables._fields])


def write(tables: Tables, path: str) -> None:
    """Profiles are sorted by series and time in their files, so that filters on either skip row groups."""
    for name, table in zip(Tables._fields, tables, strict=True):
        sort = ("series_key", "ts_ms") if name == "profiles" else ("partition",)
        table.sortWithinPartitions(*sort).write.mode("overwrite").parquet(f"{path}/{name}")


def from_samples(samples: DataFrame, partitions: int = 16) -> Tables:
    """The tables of ``samples(profile_id, ts_ms, labels, frames, value, span_id, trace_id)``; a frame is a location of one line.

    Ids are 64-bit hashes of what they stand for. Null or empty stacks have no id and are left out.
    """
    part = F.pmod(F.xxhash64(series_key(F.col("labels"))), F.lit(partitions))
    rows = samples.where(F.size("frames") > 0).withColumns({"partition": part, "stack_id": F.xxhash64("frames"), "series_key": series_key(F.col("labels"))})
    entry = F.struct("stack_id", "value", "span_id", "trace_id")
    profiles = rows.groupBy("profile_id", "series_key", "ts_ms", "partition").agg(F.first("labels").alias("labels"), F.collect_list(entry).alias("samples"))
    # three tables are made of the stacks: the samples are read once for the profiles and once for these
    # stacks are keys first: an array picked per id would have every task sort all of its samples; of two stacks with one id the more frequent stays
    each = rows.groupBy("partition", "stack_id", "frames").agg(F.count("*").alias("n"))
    stacks = cut(each.groupBy("partition", "stack_id").agg(F.max_by("frames", "n").alias("frames")))
    ids = F.transform(F.reverse("frames"), lambda f: F.xxhash64(f))
    names = stacks.select("partition", F.explode("frames").alias("name")).distinct().withColumn("function_id", F.xxhash64("name"))
    line = F.array(F.struct("function_id", F.lit(0).alias("line")))
    return Tables(
        profiles,
        stacks.select("partition", "stack_id", ids.alias("location_ids")),
        names.select("partition", F.col("function_id").alias("location_id"), F.lit(0).cast("long").alias("address"), F.lit("").alias("mapping"), line.alias("lines")),
        names.select("partition", "function_id", "name", F.lit("").alias("filename")),
    )


def from_orders(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of the star schema's profiles, an order each, labelled with its status; every third line item has a span."""
    s = order_samples(spark, sf_dir, dealt=True)
    span = F.when(F.col("value") % 3 == 0, F.lpad(F.lower(F.hex(F.col("value"))), 16, "0"))
    trace = F.when(F.col("value") % 5 == 0, F.lpad(F.lower(F.hex(F.col("value"))), 32, "0"))
    labels = F.when(F.col("status") == "P", F.create_map(F.lit("service_name"), F.lit("pending"))).otherwise(F.create_map(F.lit("service_name"), F.lit("orders"), F.lit("status"), F.col("status")))
    return from_samples(s.withColumns({"span_id": span, "trace_id": trace, "labels": labels}))


def stacks(tables: Tables) -> DataFrame:
    """``(partition, stack_id, frames)``; a location without lines is named by its mapping and address, one that is missing by ``?``."""
    inner = tables.locations.select("partition", "location_id", "address", "mapping", F.posexplode_outer("lines").alias("at", "l")).select("partition", "location_id", "address", "mapping", "at", F.col("l.function_id").alias("function_id"))
    named = inner.join(tables.functions.select("partition", "function_id", "name"), ["partition", "function_id"], "left")
    bare = F.concat(F.when(F.coalesce(F.col("mapping"), F.lit("")) != "", F.concat("mapping", F.lit("!"))).otherwise(""), F.lit("0x"), F.lower(F.hex(F.coalesce("address", F.lit(0)))))
    name = F.when(F.col("at").isNull(), bare).otherwise(F.coalesce("name", F.lit("?")))
    whole = named.groupBy("partition", "location_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(0)).alias("at"), name.alias("name")))).alias("f"))
    places = tables.stacktraces.select("partition", "stack_id", F.posexplode("location_ids").alias("place", "location_id"))
    found = places.join(whole.select("partition", "location_id", F.col("f.name").alias("names")), ["partition", "location_id"], "left")
    listed = found.groupBy("partition", "stack_id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("names", F.array(F.lit("?"))).alias("names")))).alias("p"))
    return listed.select("partition", "stack_id", F.reverse(F.flatten("p.names")).alias("frames"))


def resolve(profiles: DataFrame, tables: Tables, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep…, frames, value)``: samples summed by stack id, then joined with the stacks that they use."""
    each = profiles.select("partition", *keep, F.inline("samples")).groupBy("partition", "stack_id", *keep).agg(F.sum("value").alias("value"))
    used = tables.stacktraces.join(each.select("partition", "stack_id").distinct(), ["partition", "stack_id"], "left_semi")
    return each.join(stacks(tables._replace(stacktraces=used)), ["partition", "stack_id"]).groupBy(*keep, "frames").agg(F.sum("value").alias("value"))
