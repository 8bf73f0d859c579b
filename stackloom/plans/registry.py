"""Registered queries over the star-schema tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.selector import select
from ..operators import maintain, profiles, series, tree
from ..sources.tables import EVENTS_SQL, ORDERS_SQL, USERS, event_profiles, order_samples

#: A range of 30 days less an hour: not a multiple of the step.
START, END, STEP = 1704067200000, 1706655600000, 21_600_000
DAY = 86_400_000

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = f"WITH {sql}"
        return f

    return put


def _flat(nodes: DataFrame, *values: str) -> DataFrame:
    return nodes.select(F.concat_ws(";", "path").alias("path"), F.col("depth").cast("int").alias("depth"), *[F.col(v).cast("bigint").alias(v) for v in values or ("self", "total")])


def _text(labels):
    """A label map as one string, in order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def _columns() -> dict:
    """The label columns that selectors use in place of the map."""
    return {"service_name": F.col("service_name"), "user": F.col("user")}


TREE_SQL = """t AS (SELECT array_to_string(frames[1:i], ';') AS path, CAST(i AS INTEGER) AS depth, CAST(sum(CASE WHEN i = len(frames) THEN value ELSE 0 END) AS BIGINT) AS self, CAST(sum(value) AS BIGINT) AS total
  FROM (SELECT frames, value, unnest(range(1, len(frames) + 1)) AS i FROM {src} WHERE value > 0) GROUP BY ALL)"""
BUCKET_SQL = f"""b AS (SELECT *, {START} + CAST(greatest(0, ceil((ts_ms - {START})::DOUBLE / {STEP})) AS BIGINT) * {STEP} AS ts FROM p
  WHERE ts_ms BETWEEN {START - STEP} AND {START + (END - START) // STEP * STEP})"""


@_query(f"{ORDERS_SQL}, {TREE_SQL.format(src='s')} SELECT path, depth, self, total FROM t")
def tree_(spark, d):
    return _flat(tree.tree(order_samples(spark, d)))


_queries["tree"], _sql["tree"] = _queries.pop("tree_"), _sql.pop("tree_")


@_query(f"""{ORDERS_SQL}, {TREE_SQL.format(src='s')}, m AS (SELECT CASE WHEN count(*) > 64 THEN (SELECT min(total) FROM (SELECT total FROM t ORDER BY total DESC LIMIT 64)) ELSE 0 END AS low FROM t),
  k AS (SELECT path, self, total FROM t, m WHERE total >= low), u AS (SELECT CASE WHEN depth = 1 THEN '' ELSE regexp_replace(path, ';[^;]*$', '') END AS up, total FROM t, m WHERE total < low),
  o AS (SELECT up, sum(total) AS v FROM u WHERE up = '' OR up IN (SELECT path FROM k) GROUP BY up),
  a AS (SELECT path, self, total FROM k UNION ALL SELECT CASE WHEN up = '' THEN 'other' ELSE up || ';other' END, v, v FROM o)
  SELECT path, CAST(len(string_split(path, ';')) AS INTEGER) AS depth, CAST(self AS BIGINT) AS self, CAST(total AS BIGINT) AS total FROM a""")
def tree_truncated(spark, d):
    return _flat(tree.truncate(tree.tree(order_samples(spark, d)), 64))


@_query(f"""{ORDERS_SQL}, r AS (SELECT array_to_string(frames[1:i], ';') AS path, CAST(i AS INTEGER) AS depth, status, value, i = len(frames) AS leaf FROM (SELECT *, unnest(range(1, len(frames) + 1)) AS i FROM s WHERE value > 0 AND status IN ('F', 'O')))
  SELECT path, depth, CAST(sum(CASE WHEN status = 'F' AND leaf THEN value ELSE 0 END) AS BIGINT) AS self_left, CAST(sum(CASE WHEN status = 'F' THEN value ELSE 0 END) AS BIGINT) AS total_left,
  CAST(sum(CASE WHEN status = 'O' AND leaf THEN value ELSE 0 END) AS BIGINT) AS self_right, CAST(sum(CASE WHEN status = 'O' THEN value ELSE 0 END) AS BIGINT) AS total_right FROM r GROUP BY ALL""")
def tree_diff(spark, d):
    s = order_samples(spark, d)
    return _flat(tree.diff(tree.tree(s.where("status = 'F'")), tree.tree(s.where("status = 'O'"))), "self_left", "total_left", "self_right", "total_right")


@_query(f"{ORDERS_SQL}, {TREE_SQL.format(src='s')} SELECT path, depth, self, total FROM t")
def tree_merge(spark, d):
    s = order_samples(spark, d)
    return _flat(tree.merge(tree.tree(s.where("status = 'F'")), tree.tree(s.where("status <> 'F'"))))


@_query(f"""{ORDERS_SQL}, a AS (SELECT [frames[1], frames[2], lower(frames[3]), frames[4], frames[5]] AS frames, value FROM s), {TREE_SQL.format(src='a')} SELECT path, depth, self, total FROM t""")
def tree_renamed(spark, d):
    s = order_samples(spark, d)
    return _flat(tree.tree(tree.rename(s, lambda x: F.when(F.upper(x).isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), F.lower(x)).otherwise(x))))


@_query(f"""{ORDERS_SQL}, {TREE_SQL.format(src='s')}, n AS (SELECT string_split(path, ';') AS f, self, total FROM t)
  SELECT f[-1] AS name, CAST(sum(self) AS BIGINT) AS self, CAST(sum(CASE WHEN list_contains(f[1:len(f)-1], f[-1]) THEN 0 ELSE total END) AS BIGINT) AS total FROM n GROUP BY 1""")
def top_table(spark, d):
    return tree.top_table(tree.tree(order_samples(spark, d)))


@_query(f"""{ORDERS_SQL}, a AS (SELECT frames[list_position(frames, 'BUILDING'):len(frames)] AS frames, value FROM s WHERE list_contains(frames, 'BUILDING')), {TREE_SQL.format(src='a')} SELECT path, depth, self, total FROM t""")
def sandwich_callees(spark, d):
    return _flat(tree.callees(order_samples(spark, d), "BUILDING"))


@_query(f"""{ORDERS_SQL}, a AS (SELECT list_reverse(frames[1:list_position(frames, 'BUILDING')]) AS frames, value FROM s WHERE list_contains(frames, 'BUILDING')), {TREE_SQL.format(src='a')} SELECT path, depth, self, total FROM t""")
def sandwich_callers(spark, d):
    return _flat(tree.callers(order_samples(spark, d), "BUILDING"))


@_query(f"""{ORDERS_SQL}, a AS (SELECT frames, value FROM s WHERE frames[1] = 'ASIA'), {TREE_SQL.format(src='a')} SELECT path, depth, self, total FROM t""")
def tree_call_site(spark, d):
    s = order_samples(spark, d)
    return _flat(tree.tree(s.where(tree.in_call_site(F.col("frames"), ["ASIA"]))))


@_query(f"""{ORDERS_SQL} SELECT CAST(coalesce(sum(value) FILTER (WHERE frames[1:2] = ['ASIA', 'CHINA'] AND len(frames) = 2), 0) AS BIGINT) AS flat, CAST(coalesce(sum(value) FILTER (WHERE frames[1:2] = ['ASIA', 'CHINA']), 0) AS BIGINT) AS total,
  CAST(coalesce(sum(value) FILTER (WHERE frames[-1] = 'CHINA'), 0) AS BIGINT) AS location_flat, CAST(coalesce(sum(value) FILTER (WHERE list_contains(frames, 'CHINA')), 0) AS BIGINT) AS location_total FROM s""")
def call_site_values(spark, d):
    return tree.call_site_values(order_samples(spark, d), ["ASIA", "CHINA"])


@_query(f"""{ORDERS_SQL} SELECT array_to_string(frames[4:5], ';') AS path, CAST(sum(value) AS BIGINT) AS value FROM s GROUP BY 1""")
def go_pgo(spark, d):
    return tree.keep_leaves(order_samples(spark, d), 2).select(F.concat_ws(";", "frames").alias("path"), F.col("value"))


@_query(f"""{ORDERS_SQL}, n AS (SELECT frames, value, unnest(list_distinct(frames)) AS name FROM s) SELECT name, CAST(sum(CASE WHEN frames[-1] = name THEN value ELSE 0 END) AS BIGINT) AS flat, CAST(sum(value) AS BIGINT) AS cum FROM n GROUP BY name""")
def call_graph_nodes(spark, d):
    return tree.call_graph(order_samples(spark, d))[0]


@_query(f"""{ORDERS_SQL}, e AS (SELECT value, frames[i] AS caller, frames[i+1] AS callee FROM (SELECT *, unnest(range(1, len(frames))) AS i FROM s)) SELECT caller, callee, CAST(sum(value) AS BIGINT) AS weight FROM e WHERE caller <> callee GROUP BY ALL""")
def call_graph_edges(spark, d):
    return tree.call_graph(order_samples(spark, d))[1]


@_query(f"{EVENTS_SQL}, {BUCKET_SQL} SELECT service_name, ts, CAST(sum(total) AS DOUBLE) AS value FROM b GROUP BY ALL")
def series_sum(spark, d):
    return series.series(event_profiles(spark, d), ["service_name"], START, END, STEP).withColumn("value", F.col("value").cast("double"))


@_query(f"{EVENTS_SQL}, {BUCKET_SQL} SELECT service_name, ts, CAST(floor(sum(total)::DOUBLE / count(*)) AS BIGINT) AS value FROM b GROUP BY ALL")
def series_avg(spark, d):
    return series.series(event_profiles(spark, d), ["service_name"], START, END, STEP, "avg").withColumn("value", F.floor("value").cast("bigint"))


@_query(f"""{EVENTS_SQL}, {BUCKET_SQL}, v AS (SELECT "user", ts, sum(total) AS value FROM b GROUP BY ALL), g AS (SELECT "user" FROM v GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 3)
  SELECT "user", ts, CAST(value AS BIGINT) AS value FROM v WHERE "user" IN (SELECT "user" FROM g)""")
def series_top(spark, d):
    return series.top_series(series.series(event_profiles(spark, d), ["user"], START, END, STEP), ["user"], 3)


@_query(f"""{EVENTS_SQL}, {BUCKET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY service_name, ts ORDER BY total DESC, profile_id) AS n, sum(total) OVER (PARTITION BY service_name, ts) AS value FROM b)
  SELECT service_name, ts, CAST(value AS BIGINT) AS value, profile_id AS exemplar_id, ts_ms AS exemplar_ts, total AS exemplar_value FROM r WHERE n = 1""")
def series_exemplars(spark, d):
    return series.exemplars(event_profiles(spark, d), ["service_name"], START, END, STEP).drop("exemplar_labels")


@_query(f"""e AS (SELECT user_id AS profile_id, epoch_us(ts)//1000 // {DAY} * {DAY} AS ts_ms, event_type, CAST(user_id % {USERS} AS VARCHAR) AS u, CAST(floor(value * 100) AS BIGINT) AS total FROM events WHERE epoch_us(ts)//1000 // {DAY} * {DAY} BETWEEN {START - STEP} AND {START + (END - START) // STEP * STEP}),
  q AS (SELECT u, ts_ms, profile_id, sum(total) AS total, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS service FROM e GROUP BY ALL),
  b AS (SELECT *, {START} + CAST(greatest(0, ceil((ts_ms - {START})::DOUBLE / {STEP})) AS BIGINT) * {STEP} AS ts FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY u, ts ORDER BY total DESC, profile_id) AS n FROM b)
  SELECT u AS "user", ts, profile_id AS exemplar_id, CAST(total AS BIGINT) AS exemplar_value, service AS exemplar_service FROM r WHERE n = 1""")
def series_exemplars_merged(spark, d):
    """Profiles with rows of several services: their values are summed, labels that differ go."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = event_profiles(spark, d).join(e.select(F.col("event_id").alias("profile_id"), "user_id"), "profile_id")
    rows = rows.select(F.col("user_id").alias("profile_id"), (F.floor(F.col("ts_ms") / DAY) * DAY).cast("long").alias("ts_ms"), "user", "labels", "total")
    found = series.exemplars(rows, ["user"], START, END, STEP)
    return found.select("user", "ts", "exemplar_id", "exemplar_value", F.try_element_at("exemplar_labels", F.lit("service_name")).alias("exemplar_service"))


@_query(f"""{EVENTS_SQL}, g AS (SELECT unnest(range({START}, {END} // {STEP} * {STEP}, {STEP})) AS ts), v AS (SELECT ts_ms // {STEP} * {STEP} AS ts, sum(total) AS value FROM p GROUP BY 1)
  SELECT ts, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g LEFT JOIN v USING (ts)""")
def timeline(spark, d):
    return series.timeline(event_profiles(spark, d).withColumnRenamed("total", "value"), START, END, STEP // 1000)


_HEAT_SQL = f"""w AS (SELECT * FROM {{src}} WHERE ts_ms BETWEEN {START - STEP} AND {END}), lh AS (SELECT min(total) AS lo, CASE WHEN max(total) = min(total) THEN min(total) + 1 ELSE max(total) END AS hi FROM w),
  e AS (SELECT list_transform(range(0, 21), lambda i: lo + CAST(floor(i * (hi - lo)::DOUBLE / 20) AS BIGINT)) AS edges FROM lh),
  c AS (SELECT w.*, least({START} + CAST(greatest(0, ceil((ts_ms - {START})::DOUBLE / {STEP})) AS BIGINT) * {STEP}, {START} + ({END} - {START} + {STEP - 1}) // {STEP} * {STEP}) AS ts, edges,
    coalesce(list_filter(range(0, 20), lambda i: total >= edges[i + 1] AND total < edges[i + 2])[1], 19) AS y FROM w, e)
  SELECT service_name, ts, CAST(y AS INTEGER) AS y, count(*) AS count, any_value(edges[y + 1]) AS y_min FROM c GROUP BY service_name, ts, y"""


@_query(f"{EVENTS_SQL}, {_HEAT_SQL.format(src='p')}")
def heatmap_individual(spark, d):
    return series.heatmap(event_profiles(spark, d), ["service_name"], START, END, STEP)


@_query(f"""{EVENTS_SQL}, m AS ({{heat}}), e AS (SELECT list_transform(range(0, 20), lambda i: lo + CAST(floor(i * (hi - lo)::DOUBLE / 20) AS BIGINT)) AS y_min FROM (SELECT min(total) AS lo, CASE WHEN max(total) = min(total) THEN min(total) + 1 ELSE max(total) END AS hi FROM p WHERE ts_ms BETWEEN {START - STEP} AND {END}))
  SELECT service_name, ts, array_to_string(any_value(e.y_min), ',') AS y_min, array_to_string(list_transform(range(0, 20), lambda y: coalesce(list_extract(list(m.count ORDER BY m.y), list_position(list(m.y ORDER BY m.y), y)), 0)), ',') AS counts,
  array_to_string(list(m.best ORDER BY m.y), ',') AS exemplars FROM m, e GROUP BY service_name, ts""".replace("{heat}", "WITH " + _HEAT_SQL.format(src="p").replace("any_value(edges[y + 1]) AS y_min", "arg_min(profile_id, (-total, ts_ms, profile_id)) AS best")))
def heatmap_slots(spark, d):
    out = series.heatmap_slots(event_profiles(spark, d), ["service_name"], START, END, STEP)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("service_name", "ts", text("y_min").alias("y_min"), text("counts").alias("counts"), text("exemplars.profile_id").alias("exemplars"))


@_query(f"{EVENTS_SQL}, q AS (SELECT service_name, ts_ms, span, CAST(sum(total) AS BIGINT) AS total FROM p WHERE span IS NOT NULL GROUP BY ALL), {_HEAT_SQL.format(src='q')}")
def heatmap_span(spark, d):
    return series.heatmap(series.span_points(event_profiles(spark, d), ["service_name"]), ["service_name"], START, END, STEP)


@_query(f"""{EVENTS_SQL} SELECT service_name, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM p WHERE service_name IN ('click', 'view', 'purchase') AND "user" <> '3' AND regexp_full_match("user", '[0-4]') GROUP BY 1""")
def selector(spark, d):
    hit = select('{service_name=~"click|view|purchase", user!="3", user=~"[0-4]", missing=""}', _columns(), F.col("labels"))
    return event_profiles(spark, d).where(hit).groupBy("service_name").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@_query(f"""{EVENTS_SQL}, m AS (SELECT map(['service_name', 'user'], [service_name, "user"]) AS l FROM p) SELECT DISTINCT unnest(map_keys(l)) AS name FROM m""")
def label_names(spark, d):
    return series.label_names(event_profiles(spark, d))


@_query(f"{EVENTS_SQL} SELECT DISTINCT service_name AS value FROM p WHERE service_name <> ''")
def label_values(spark, d):
    return series.label_values(event_profiles(spark, d), "service_name")


@_query(f"""{EVENTS_SQL} SELECT DISTINCT service_name, "user" FROM p""")
def series_labels(spark, d):
    return series.series_labels(event_profiles(spark, d), ["service_name", "user"])


@_query(f"""{EVENTS_SQL} SELECT 'service_name' AS name, count(DISTINCT service_name) AS n_values FROM p UNION ALL SELECT 'user', count(DISTINCT "user") FROM p""")
def label_cardinality(spark, d):
    return series.cardinality(event_profiles(spark, d))


@_query(f"{EVENTS_SQL} SELECT count(*) > 0 AS data_ingested, min(ts_ms) AS oldest, max(ts_ms) AS newest FROM p")
def profile_stats(spark, d):
    return series.stats(event_profiles(spark, d))


@_query(f"""{EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY service_name, "user", ts_ms // {DAY} ORDER BY ts_ms, profile_id) AS n FROM p) SELECT profile_id, service_name, "user", ts_ms, total FROM r WHERE n = 1""")
def dedup(spark, d):
    rows = event_profiles(spark, d).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    return maintain.dedup(rows, ["service_name", "user", "day"], ["ts_ms", "profile_id"]).select("profile_id", "service_name", "user", "ts_ms", "total")


@_query(f"""{ORDERS_SQL} SELECT status, ts_ms // {30 * DAY} * {30 * DAY} AS ts_ms, array_to_string(frames, ';') AS path, CAST(sum(value) AS BIGINT) AS value FROM s GROUP BY ALL""")
def downsample(spark, d):
    s = order_samples(spark, d)
    return maintain.downsample(s, ["status"], 30 * 86_400).select("status", "ts_ms", F.concat_ws(";", "frames").alias("path"), "value")


_CUM_SQL = f"""{EVENTS_SQL}, r AS (SELECT *, total - lag(total) OVER (PARTITION BY service_name, "user" ORDER BY ts_ms, total) AS delta FROM p)"""


@_query(f"""{_CUM_SQL} SELECT service_name, "user", ts_ms, total, delta FROM r WHERE delta >= 0""")
def delta(spark, d):
    rows = event_profiles(spark, d).select("service_name", "user", "ts_ms", "total")
    return series.delta(rows, ["service_name", "user"])


@_query(f"""{EVENTS_SQL} SELECT 'tenant-' || "user" AS tenant, service_name, CAST(sum(total) AS BIGINT) AS value FROM p WHERE span IS NOT NULL AND service_name <> 'view' GROUP BY ALL""")
def recording_rule(spark, d):
    rows = event_profiles(spark, d).withColumn("tenant", F.concat(F.lit("tenant-"), "user"))
    return maintain.recording_rule(rows, F.col("span").isNotNull() & select('{service_name!="view"}', _columns(), F.col("labels")), ["service_name"])


@_query(f"""{EVENTS_SQL} SELECT upper(service_name) AS service, ('0x' || right(md5("user"), 16))::UBIGINT % 4 AS shard, count(*) AS n FROM p WHERE regexp_full_match(service_name, '.*c.*') GROUP BY ALL""")
def relabel(spark, d):
    rules = [
        {"action": "keep", "source_labels": ["service_name"], "regex": ".*c.*"},
        {"action": "uppercase", "source_labels": ["service_name"], "target_label": "service"},
        {"action": "hashmod", "source_labels": ["user"], "target_label": "shard", "modulus": 4},
        {"action": "labeldrop", "regex": "service_name|user"},
    ]
    new, keep = L.relabel(F.col("labels"), rules)
    rows = event_profiles(spark, d).where(keep).select(new.alias("l"))
    return rows.groupBy(F.col("l.service").alias("service"), F.col("l.shard").cast("bigint").alias("shard")).agg(F.count("*").alias("n"))


@_query("""a AS (SELECT DISTINCT l_partkey * 37 AS address FROM lineitem), y AS (SELECT p_partkey * 64 AS va, 40 AS len, 0 AS depth, p_name || '#' || p_partkey AS nm FROM part
    UNION ALL SELECT p_partkey * 64 + 8, 16, 1, 'in#' || p_partkey FROM part WHERE p_size > 25)
  SELECT 'bin' AS "binary", CAST(address AS BIGINT) AS address, coalesce(string_agg(nm, ';' ORDER BY depth DESC), 'bin!0x' || lower(to_hex(address))) AS names FROM a LEFT JOIN y ON address >= va AND address < va + len GROUP BY address""")
def symbolize(spark, d):
    asked = spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit("bin").alias("binary"), (F.col("l_partkey") * 37).alias("address")).distinct()
    part = spark.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey")
    outer = part.select(F.lit("bin").alias("binary"), (key * 64).alias("va"), F.lit(40).alias("len"), F.concat("p_name", F.lit("#"), key.cast("string")).alias("name"), F.lit(0).alias("depth"))
    inner = part.where("p_size > 25").select(F.lit("bin").alias("binary"), (key * 64 + 8).alias("va"), F.lit(16).alias("len"), F.concat(F.lit("in#"), key.cast("string")).alias("name"), F.lit(1).alias("depth"))
    return tree.resolve_addresses(asked, outer.unionByName(inner)).withColumn("names", F.array_join("names", ";"))


@_query(f"""{ORDERS_SQL}, d AS (SELECT array_to_string(frames[1:i], ';') AS path, i AS depth, sum(CASE WHEN status = 'O' THEN value ELSE -value END) AS total, sum(CASE WHEN i < len(frames) THEN 0 WHEN status = 'O' THEN value ELSE -value END) AS self
    FROM (SELECT *, unnest(range(1, len(frames) + 1)) AS i FROM s WHERE value > 0 AND status IN ('F', 'O')) GROUP BY ALL),
  g AS (SELECT * FROM d WHERE total > 0), u AS (SELECT path, depth, unnest(list_transform(range(1, depth + 1), lambda k: array_to_string(string_split(path, ';')[1:k], ';'))) AS up FROM g),
  w AS (SELECT u.path FROM u JOIN g ON u.up = g.path GROUP BY u.path, u.depth HAVING count(*) = u.depth)
  SELECT path, CAST(depth AS INTEGER) AS depth, CAST(greatest(self, 0) AS BIGINT) AS self, CAST(total AS BIGINT) AS total FROM g WHERE path IN (SELECT path FROM w)""")
def tree_subtract(spark, d):
    s = order_samples(spark, d)
    return _flat(tree.subtract(tree.tree(s.where("status = 'O'")), tree.tree(s.where("status = 'F'"))))


@_query(f"""{ORDERS_SQL}, {TREE_SQL.format(src='s')} SELECT path, depth, CAST(floor(self * 3 / 2.0) AS BIGINT) AS self, CAST(floor(total * 3 / 2.0) AS BIGINT) AS total FROM t""")
def tree_scaled(spark, d):
    return _flat(tree.scale(tree.tree(order_samples(spark, d)), 3, 2))


TYPE_SQL = """y AS (SELECT DISTINCT 'process_cpu:' || service_name || CASE WHEN user = '1' THEN ':count' WHEN user = '2' THEN ':count:cpu:ns:delta' ELSE ':count:cpu:ns' END AS id FROM p)"""


@_query(f"""{EVENTS_SQL}, {TYPE_SQL}, z AS (SELECT id, string_split(id, ':') AS f FROM y) SELECT id, f[1] AS name, f[2] AS sample_type, f[3] AS sample_unit, f[4] AS period_type, f[5] AS period_unit FROM z WHERE len(f) >= 5""")
def profile_types(spark, d):
    tail = F.when(F.col("user") == "1", ":count").when(F.col("user") == "2", ":count:cpu:ns:delta").otherwise(":count:cpu:ns")
    return profiles.profile_types(event_profiles(spark, d).select(F.concat(F.lit("process_cpu:"), "service_name", tail).alias("profile_type")))


@_query(f"""{ORDERS_SQL} SELECT CASE WHEN value - 10 < 0 THEN 'negative_value' ELSE 'ok' END AS reason, count(*) AS n FROM s GROUP BY 1""")
def check_samples(spark, d):
    good, bad = profiles.check(order_samples(spark, d).withColumn("value", F.col("value") - 10))
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@_query(f"""{EVENTS_SQL}, h AS (SELECT *, right(md5(coalesce(span, '')), 1) || '000000000000000' AS sp FROM p) SELECT service_name, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM h WHERE sp IN ('a000000000000000', '5000000000000000') GROUP BY 1""")
def span_selector(spark, d):
    span = F.concat(F.right(F.md5(F.coalesce("span", F.lit(""))), F.lit(1)), F.lit("0" * 15))
    rows = profiles.in_spans(event_profiles(spark, d).withColumn("span", span), ["A" + "0" * 15, "5" + "0" * 15, "0" * 16])
    return rows.groupBy("service_name").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@_query(f"""{ORDERS_SQL} SELECT profile_id, ts_ms, CAST(sum(value) AS BIGINT) AS total, 'true' AS sampled FROM s WHERE value > 0 GROUP BY ALL""")
def totals_only(spark, d):
    return profiles.totals_only(order_samples(spark, d), ["profile_id", "ts_ms"])


@_query(f"""{ORDERS_SQL} SELECT ts_ms // {30 * DAY} * {30 * DAY} AS ts, CAST(sum(CASE WHEN frames[1:2] = ['ASIA', 'CHINA'] THEN value ELSE 0 END) AS BIGINT) AS value FROM s GROUP BY 1""")
def series_call_site(spark, d):
    rows = profiles.call_site_totals(order_samples(spark, d), ["profile_id", "ts_ms"], ["ASIA", "CHINA"])
    return rows.groupBy((F.floor(F.col("ts_ms") / (30 * DAY)) * 30 * DAY).cast("bigint").alias("ts")).agg(F.sum("total").alias("value"))


@_query(f"""{EVENTS_SQL}, {BUCKET_SQL} SELECT service_name, ts, CAST(sum(total) AS BIGINT) AS value, array_to_string(list_sort(list_distinct(list("user"))), ',') AS annotations FROM b GROUP BY ALL""")
def series_annotations(spark, d):
    parts = series.series(event_profiles(spark, d), ["service_name", "user"], START, END, STEP).withColumn("annotations", F.array("user"))
    return profiles.merge_points(parts, ["service_name"]).withColumn("annotations", F.array_join("annotations", ","))


@_query(f"""{EVENTS_SQL} SELECT "user" AS label_value, CAST(sum(total) AS BIGINT) AS value FROM p WHERE ts_ms > {START} AND ts_ms <= {END} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def top_label_values(spark, d):
    return profiles.top_label_values(event_profiles(spark, d), "user", START, END, 5)


@_query(f"""{EVENTS_SQL} SELECT count(DISTINCT (service_name, "user")) AS n_series, count(*) AS n_profiles, count(DISTINCT ts_ms // {DAY}) AS n_days FROM p WHERE ts_ms BETWEEN {START} AND {END}""")
def query_scope(spark, d):
    return profiles.query_scope(event_profiles(spark, d), START, END, ["service_name", "user"])


@_query(f"""{EVENTS_SQL}, m AS ({{heat}}), k AS (SELECT service_name FROM m GROUP BY 1 ORDER BY sum(count) DESC, 1 LIMIT 2) SELECT * FROM m WHERE service_name IN (SELECT service_name FROM k)""".replace("{heat}", f"WITH {_HEAT_SQL.format(src='p')}"))
def heatmap_top(spark, d):
    return profiles.top_heatmap(series.heatmap(event_profiles(spark, d), ["service_name"], START, END, STEP), ["service_name"], 2)


@_query(f"""{ORDERS_SQL}, a AS (SELECT sum(value) AS v FROM s), n AS (SELECT name, sum(value) AS cum FROM (SELECT value, unnest(list_distinct(frames)) AS name FROM s) GROUP BY 1), k AS (SELECT name FROM n, a WHERE cum >= 0.005 * v ORDER BY cum DESC, name LIMIT 20),
  e AS (SELECT frames[i] AS caller, frames[i+1] AS callee, sum(value) AS weight FROM (SELECT *, unnest(range(1, len(frames))) AS i FROM s) GROUP BY ALL)
  SELECT caller, callee, CAST(weight AS BIGINT) AS weight FROM e, a WHERE weight >= 0.001 * v AND caller <> callee AND caller IN (SELECT name FROM k) AND callee IN (SELECT name FROM k)""")
def call_graph_trimmed(spark, d):
    s = order_samples(spark, d)
    nodes, edges = tree.call_graph(s)
    return profiles.trim_call_graph(nodes, edges, tree.sum_stacks(s).agg(F.sum("value").alias("value")), 20)[1]


@_query(f"""{EVENTS_SQL}, lim AS (SELECT {START} + 15 * {DAY} AS now) SELECT CASE WHEN ts_ms <= now - {DAY} THEN 'too_far_behind' WHEN ts_ms >= now + {DAY} THEN 'too_far_ahead' ELSE 'ok' END AS reason, count(*) AS n FROM p, lim GROUP BY 1""")
def ingestion_window(spark, d):
    good, bad = maintain.ingestion_window(event_profiles(spark, d), START + 15 * DAY, DAY, DAY)
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import ingest, stored  # noqa: F401  these modules add theirs

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
