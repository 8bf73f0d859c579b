"""Queries over stored profile tables and pprof files, made from the star schema, written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import ingest, tree
from ..sources import canonical, formats, pprof
from ..sources.tables import ORDERS_SQL, order_samples
from .registry import TREE_SQL, _flat, _query, _text


def _folder(spark, tag: str) -> str:
    """A new folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-") if known.isEmpty() else known.get()
    return f"{where.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _tables(spark, d: str) -> canonical.Tables:
    path = _folder(spark, "profiles")
    canonical.write(canonical.from_orders(spark, d), path)
    return canonical.read(spark, path)


#: Samples with the labels, spans and traces that the stored profiles have.
SAMPLES_SQL = f"""{ORDERS_SQL}, q AS (SELECT *, CASE WHEN value % 3 = 0 THEN lpad(lower(to_hex(value)), 16, '0') END AS span, CASE WHEN value % 5 = 0 THEN lpad(lower(to_hex(value)), 32, '0') END AS trace FROM s)"""


@_query(f"{ORDERS_SQL}, {TREE_SQL.format(src='s')} SELECT path, depth, self, total FROM t")
def tree_stored(spark, d):
    tables = _tables(spark, d)
    return _flat(tree.tree(canonical.resolve(tables.profiles, tables)))


@_query(f"{SAMPLES_SQL}, a AS (SELECT * FROM q WHERE span IN ('000000000000000c', '0000000000000003', '0000000000000021')), {TREE_SQL.format(src='a')} SELECT path, depth, self, total FROM t")
def tree_spans(spark, d):
    tables = _tables(spark, d)
    picked = ingest.select_samples(tables.profiles, spans=["000000000000000C", "0000000000000003", "0000000000000021", "0" * 16])
    return _flat(tree.tree(canonical.resolve(picked, tables)))


@_query(f"{SAMPLES_SQL}, a AS (SELECT * FROM q WHERE trace IN ('{'0' * 30}0a', '{'0' * 30}19')), {TREE_SQL.format(src='a')} SELECT path, depth, self, total FROM t")
def tree_traces(spark, d):
    tables = _tables(spark, d)
    return _flat(tree.tree(canonical.resolve(ingest.select_samples(tables.profiles, traces=["0" * 30 + "0A", "0" * 30 + "19"]), tables)))


@_query(f"""{ORDERS_SQL}, k AS (SELECT * FROM s WHERE status = 'P') SELECT array_to_string(frames, ';') AS path, CAST(sum(value) AS BIGINT) AS value FROM k GROUP BY 1""")
def series_lookup(spark, d):
    """Profiles of the series without a status label."""
    tables = _tables(spark, d)
    wanted = tables.profiles.dropDuplicates(["series_key"]).where(F.try_element_at("labels", F.lit("status")).isNull())
    return canonical.resolve(ingest.in_series(tables.profiles, wanted), tables).select(F.concat_ws(";", "frames").alias("path"), "value")


@_query(f"""{ORDERS_SQL} SELECT status, count(DISTINCT profile_id) AS n, CAST(sum(value) AS BIGINT) AS total FROM s WHERE status = 'F' GROUP BY 1""")
def key_value_groups(spark, d):
    rows = _tables(spark, d).profiles.where(ingest.has_pairs(F.col("labels"), {"service_name": "orders", "status": "F"}))
    return rows.select(F.try_element_at("labels", F.lit("status")).alias("status"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x["value"]).alias("total")).groupBy("status").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


def _as_pprof(spark, d):
    """Sample rows of one profile file per order status, of the values and their count."""
    s = order_samples(spark, d)
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(u).alias("unit")) for t, u in (("quantity", "count"), ("lines", "count"))])
    rows = s.groupBy("status", "frames").agg(F.array(F.sum("value"), F.count("*")).alias("values"))
    head = {"sample_types": kinds, "period_type": F.lit("cpu"), "period_unit": F.lit("nanoseconds"), "period": F.ascii("status").cast("long"), "time_nanos": F.ascii("status").cast("long") * 1000, "duration_nanos": F.lit(5).cast("long")}
    return rows.withColumns(head).withColumn("labels", F.create_map(F.lit("leaf"), F.element_at("frames", -1)))


def _pprof_files(spark, d) -> str:
    path = _folder(spark, "pprof")
    pprof.to_files(_as_pprof(spark, d), "status").select("content").write.parquet(path)
    return path


@_query(f"""{ORDERS_SQL} SELECT status, array_to_string(frames, ';') AS path, CAST(sum(value) AS BIGINT) AS quantity, count(*) AS n_lines, frames[-1] AS leaf FROM s GROUP BY status, frames""")
def pprof_round_trip(spark, d):
    """Profiles encoded to files and decoded again."""
    files = spark.read.parquet(_pprof_files(spark, d)).withColumn("path", F.md5("content"))
    rows = pprof.decoded(files)
    status = F.char(F.col("period"))
    return rows.select(status.alias("status"), F.concat_ws(";", "frames").alias("path"), F.get("values", F.lit(0)).alias("quantity"), F.get("values", F.lit(1)).alias("n_lines"), F.try_element_at("labels", F.lit("leaf")).alias("leaf"))


@_query(f"""{ORDERS_SQL}, h AS (SELECT min(ascii(status)) * 1000 AS time_nanos, 5 * count(DISTINCT status) AS duration_nanos, max(ascii(status)) AS period FROM s)
  SELECT array_to_string(frames, ';') AS path, CAST(sum(value) AS BIGINT) AS quantity, count(*) AS n_lines, CAST(any_value(time_nanos) AS BIGINT) AS time_nanos, CAST(any_value(duration_nanos) AS BIGINT) AS duration_nanos, CAST(any_value(period) AS BIGINT) AS period FROM s, h GROUP BY frames""")
def pprof_merge(spark, d):
    files = spark.read.parquet(_pprof_files(spark, d)).withColumn("path", F.md5("content"))
    out = pprof.merge(pprof.decoded(files))
    return out.select(F.concat_ws(";", "frames").alias("path"), F.get("values", F.lit(0)).alias("quantity"), F.get("values", F.lit(1)).alias("n_lines"), "time_nanos", "duration_nanos", "period")


@_query(f"""{ORDERS_SQL} SELECT status, array_to_string(frames, ';') AS path, CAST(sum(value) AS BIGINT) * 100 AS value FROM s GROUP BY status, frames""")
def speedscope(spark, d):
    """A speedscope document per order status, of its stacks' values in milliseconds."""
    s = order_samples(spark, d).groupBy("status", "frames").agg(F.sum("value").alias("value"))
    names = s.select("status", F.explode("frames").alias("name")).distinct().groupBy("status").agg(F.array_sort(F.collect_list("name")).alias("names"))
    rows = s.join(names, "status").withColumn("s", F.transform("frames", lambda f: F.array_position(F.col("names"), f).cast("int") - 1))
    listed = rows.groupBy("status", "names").agg(F.collect_list(F.struct("s", (F.col("value") + 0.75).alias("w"))).alias("x"))
    own = F.struct(F.lit("sampled").alias("type"), F.col("status").alias("name"), F.lit("milliseconds").alias("unit"), F.col("x.s").alias("samples"), F.col("x.w").alias("weights"))
    doc = F.to_json(F.struct(F.struct(F.transform("names", lambda n: F.struct(n.alias("name"))).alias("frames")).alias("shared"), F.array(own).alias("profiles")))
    return formats.parse_speedscope(listed.select(doc.alias("value"))).select(F.col("profile").alias("status"), F.concat_ws(";", "frames").alias("path"), "value")


@_query(f"""{ORDERS_SQL} SELECT array_to_string(frames, ';') AS path, CAST(sum(value) AS BIGINT) AS value FROM s GROUP BY frames""")
def collapsed_round_trip(spark, d):
    path = _folder(spark, "collapsed")
    formats.write_collapsed(tree.tree(order_samples(spark, d)), path)
    return formats.read_collapsed(spark, path).select(F.concat_ws(";", "frames").alias("path"), "value")


@_query(f"""{ORDERS_SQL}, l AS (SELECT CASE WHEN frames[1] IN ('ASIA', 'EUROPE') THEN 'region=' || frames[1] ELSE '' END AS labels, frames, value FROM s)
  SELECT labels, array_to_string(frames, ';') AS path, CAST(sum(value) AS BIGINT) AS value FROM l GROUP BY labels, frames""")
def samples_grouped(spark, d):
    """Samples told apart by one of their two labels."""
    region = F.when(F.get("frames", F.lit(0)).isin("ASIA", "EUROPE"), F.create_map(F.lit("region"), F.get("frames", F.lit(0)))).otherwise(F.create_map().cast("map<string,string>"))
    rows = order_samples(spark, d).withColumn("sample_labels", F.map_concat(region, F.create_map(F.lit("order"), F.col("profile_id").cast("string"))))
    out = ingest.group_by_labels(rows, [], ["region"])
    return out.select(_text("sample_labels").alias("labels"), F.concat_ws(";", "frames").alias("path"), "value")
