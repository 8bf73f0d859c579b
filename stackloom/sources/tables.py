"""Profiles made from star-schema tables: a scalar profile per event, a stack profile per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import deal, deal_join

USERS = 7


def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(profile_id, ts_ms, service_name, user, labels, total, span)``: one profile per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.pmod("user_id", F.lit(USERS)).cast("string")
    return e.select(
        F.col("event_id").alias("profile_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_type").alias("service_name"),
        user.alias("user"),
        F.create_map(F.lit("service_name"), F.col("event_type"), F.lit("user"), user).alias("labels"),
        F.floor(F.col("value") * 100).cast("bigint").alias("total"),
        F.get_json_object("props", "$.k").alias("span"),
    )


def order_samples(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``(profile_id, ts_ms, status, frames, value)``: one profile per order, one sample per line item, root first.

    ``dealt``: over tasks of bounded rows, orders by customer and then lines by profile, for what collects whole profiles.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyer = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name", "c_mktsegment")
    if dealt:
        order = deal_join(t("orders"), buyer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "o_orderkey")
    else:
        order = t("orders").join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    line = t("lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    # merged, not broadcast: the join keeps the deal
    rows = (deal(line, "l_orderkey").hint("merge") if dealt else line).join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    frames = F.array("r_name", "n_name", "c_mktsegment", "o_orderpriority", "l_returnflag")
    return rows.select(F.col("o_orderkey").alias("profile_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), F.col("o_orderstatus").alias("status"), frames.alias("frames"), F.col("l_quantity").cast("bigint").alias("value"))


#: The same two views in DuckDB's SQL.
EVENTS_SQL = f"""p AS (SELECT event_id AS profile_id, epoch_us(ts)//1000 AS ts_ms, event_type AS service_name, CAST(user_id % {USERS} AS VARCHAR) AS user,
  CAST(floor(value * 100) AS BIGINT) AS total, json_extract_string(props, '$.k') AS span FROM events)"""
ORDERS_SQL = """s AS (SELECT o_orderkey AS profile_id, epoch_us(o_orderdate)//1000 AS ts_ms, o_orderstatus AS status, [r_name, n_name, c_mktsegment, o_orderpriority, l_returnflag] AS frames, CAST(l_quantity AS BIGINT) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
