"""Queries of the rules on the way in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import units
from ..functions.selector import select
from ..operators import ingest, maintain, series, tree
from ..sources.tables import EVENTS_SQL, ORDERS_SQL, event_profiles, order_samples
from .registry import DAY, END, START, _query, _text


@_query(f"""{EVENTS_SQL}, n AS (SELECT service_name, NULLIF("user", '3') AS u, total FROM p) SELECT service_name, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM n WHERE regexp_full_match(coalesce(u, ''), '(1|2)?') AND coalesce(u, '') <> '1' GROUP BY 1""")
def selector_nulls(spark, d):
    """Null labels equal the empty string."""
    rows = event_profiles(spark, d).withColumn("user", F.when(F.col("user") != "3", F.col("user")))
    hit = select('{user=~"(1|2)?", user!="1", user=~".*"}', {"user": F.col("user")}, F.col("labels"))
    return rows.where(hit).groupBy("service_name").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@_query(f"""{EVENTS_SQL} SELECT upper(service_name) || '-' || "user" AS who, CASE WHEN "user" = '2' THEN 'two' ELSE '' END AS two, count(*) AS n FROM p WHERE service_name <> 'view' AND "user" <> '5' GROUP BY ALL""")
def relabel_more(spark, d):
    rules = [
        {"action": "drop", "source_labels": ["service_name"], "regex": "view"},
        {"action": "uppercase", "source_labels": ["service_name"], "target_label": "upper"},
        {"action": "lowercase", "source_labels": ["upper"], "target_label": "lower"},
        {"action": "keepequal", "source_labels": ["lower"], "target_label": "service_name"},
        {"action": "replace", "source_labels": ["upper", "user"], "separator": "/", "regex": "(?P<a>.*)/(\\w+)", "target_label": "who", "replacement": "${a}-$2"},
        {"action": "replace", "source_labels": ["user"], "regex": "(2)", "target_label": "u$1", "replacement": "two"},
        {"action": "replace", "replacement": "5", "target_label": "five"},
        {"action": "dropequal", "source_labels": ["five"], "target_label": "user"},
        {"action": "labelmap", "regex": "u(2)", "replacement": "user_${1}"},
        {"action": "labelkeep", "regex": "who|user_.*"},
    ]
    new, keep = L.relabel(F.col("labels"), rules)
    rows = event_profiles(spark, d).where(keep).select(new.alias("l"))
    return rows.groupBy(L.get(F.col("l"), "who").alias("who"), L.get(F.col("l"), "user_2").alias("two")).agg(F.count("*").alias("n"))


@_query(f"""{EVENTS_SQL} SELECT CASE WHEN service_name = 'view' THEN 'missing_labels' WHEN service_name = 'click' THEN 'label_value_too_long' WHEN "user" = '1' THEN 'labels_invalid' WHEN "user" = '2' THEN 'duplicate_label_names' WHEN "user" = '3' THEN 'max_label_names_per_series' ELSE 'ok' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def check_labels(spark, d):
    base = {"__name__": F.lit("cpu"), "service_name": F.when(F.col("service_name") == "view", "").otherwise(F.col("service_name"))}
    odd = F.when(F.col("service_name").isin("view", "click"), F.create_map(F.lit("a"), F.lit("x" * 20))).when(F.col("user") == "1", F.create_map(F.lit("1a"), F.lit("x"))).when(F.col("user") == "2", F.create_map(F.lit("a.b"), F.lit("x"), F.lit("a_b"), F.lit("y")))
    odd = odd.when(F.col("user") == "3", F.create_map(*[F.lit(x) for x in "abcdef"])).otherwise(F.create_map(F.lit("a"), F.lit("x")))
    rows = event_profiles(spark, d).withColumn("l", F.map_concat(F.create_map(*[x for k, v in base.items() for x in (F.lit(k), v)]), odd))
    return rows.select(F.coalesce(ingest.label_problem(F.col("l"), 4, 20, 16), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@_query(f"""{EVENTS_SQL} SELECT CASE WHEN "user" = '0' THEN 'none' WHEN "user" = '1' THEN 'none' ELSE lpad(lower(to_hex((profile_id * 7919 + 4294967296 * ("user"::BIGINT)) % 10)), 16, '0') END AS session, count(*) AS n FROM p GROUP BY 1""")
def session_ids(spark, d):
    own = F.when(F.col("user") == "0", "not hex").otherwise(F.lpad(F.lower(F.hex(F.col("profile_id") * 7919 + F.lit(1 << 32) * F.col("user").cast("long"))), 16, "0"))
    labels = F.when(F.col("user") == "1", F.col("labels")).otherwise(F.map_concat("labels", F.create_map(F.lit(ingest.SESSION), own)))
    out = event_profiles(spark, d).select(ingest.limit_sessions(labels, 10).alias("l"))
    return out.groupBy(F.coalesce(F.try_element_at("l", F.lit(ingest.SESSION)), F.lit("none")).alias("session")).agg(F.count("*").alias("n"))


@_query(f"""{EVENTS_SQL} SELECT CASE WHEN "user" = '4' THEN 'user-4' WHEN service_name = 'click' THEN 'clicks' WHEN service_name = 'view' THEN 'svc/view' ELSE 'none' END AS usage_group, CAST(CASE WHEN "user" = '4' THEN 0.25 WHEN service_name = 'click' THEN 0.5 WHEN service_name = 'view' THEN 0.125 END AS DOUBLE) AS share, count(*) AS n FROM p GROUP BY ALL""")
def usage_groups(spark, d):
    """The group that decides whether a profile is kept."""
    groups = {"clicks": '{service_name="click"}', "svc/${labels.service_name}": '{service_name=~"v.*|c.*"}', "user-4": '{user="4"}', "x${labels.nothing}": '{user=~".+"}'}
    by = ingest.sampling(F.col("labels"), groups, {"clicks": 0.5, "svc/view": 0.125, "svc/click": 0.01, "user-4": 0.25, "x": 0.1})
    rows = event_profiles(spark, d).select(by.alias("by"))
    return rows.groupBy(F.coalesce("by.usage_group", F.lit("none")).alias("usage_group"), F.col("by.share").alias("share")).agg(F.count("*").alias("n"))


@_query(f"""{ORDERS_SQL} SELECT frames[1] || '.f;' || frames[3] || ';' || frames[4] || '[go.shape.x' AS path, CAST(sum(value) AS BIGINT) AS value FROM s GROUP BY 1""")
def go_type_parameters(spark, d):
    f = lambda i: F.get("frames", F.lit(i))
    frames = F.array(F.concat(f(0), F.lit("[go.shape."), f(1), F.lit("[int]].f")), f(2), F.concat(f(3), F.lit("[go.shape.x")))
    rows = order_samples(spark, d).select(frames.alias("frames"), "value")
    return ingest.drop_go_type_parameters(rows).select(F.concat_ws(";", "frames").alias("path"), "value")


@_query("""l AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'go' WHEN p_size % 7 = 1 THEN 'java' WHEN p_size % 7 = 2 THEN 'ruby' WHEN p_size % 7 = 3 THEN 'dotnet' WHEN p_size % 7 = 4 THEN 'python' ELSE 'unknown' END AS language FROM part) SELECT language, count(*) AS n FROM l GROUP BY 1""")
def languages(spark, d):
    mark = F.col("p_size") % 7
    first = F.when(mark == 0, "main.go").when(mark == 1, "java/lang").when(mark == 2, "x.rb").when(mark == 3, "System.IO").when(mark == 4, "x.py").otherwise("x.c")
    rows = spark.read.parquet(f"{d}/part.parquet").select(ingest.language(F.array("p_name", first, F.lit("none"))).alias("language"))
    return rows.groupBy("language").agg(F.count("*").alias("n"))


@_query(f"""{EVENTS_SQL} SELECT 'n:' || t || ':' || u || ':cpu:ns' AS profile_type, service_name, count(*) AS n FROM p, (VALUES ('alloc', 'bytes'), ('inuse', 'count')) AS k(t, u) WHERE NOT (service_name = 'view' AND t = 'alloc') AND u = 'bytes' OR t = 'inuse' AND service_name <> 'click' GROUP BY ALL""")
def sample_types(spark, d):
    """A series per sample type, of which rules drop some."""
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(u).alias("unit")) for t, u in (("alloc", "bytes"), ("inuse", "count"))])
    rows = event_profiles(spark, d).select("labels", F.lit("n").alias("name"), kinds.alias("sample_types"), F.lit("cpu").alias("period_type"), F.lit("ns").alias("period_unit"))
    rules = [{"action": "drop", "source_labels": ["__type__", "__service_name__"], "regex": "alloc;view"}, {"action": "drop", "source_labels": ["__unit__", "service_name"], "regex": "count;click"}]
    kept = ingest.relabel_sample_types(ingest.sample_series(rows), rules)
    return kept.groupBy(L.get(F.col("labels"), "__profile_type__").alias("profile_type"), L.get(F.col("labels"), "service_name").alias("service_name")).agg(F.count("*").alias("n"))


@_query(f"""{EVENTS_SQL} SELECT total, CASE WHEN total >= 1073741824 THEN printf('%.2f', total / 1073741824.0) || 'GB' WHEN total >= 1048576 THEN printf('%.2f', total / 1048576.0) || 'MB' WHEN total >= 1024 THEN regexp_replace(printf('%.2f', total / 1024.0), '[.]00$', '') || 'kB' WHEN total = 0 THEN '0' ELSE total || 'B' END AS size, count(*) AS n FROM p GROUP BY ALL""")
def unit_labels(spark, d):
    rows = event_profiles(spark, d).select("total", units.label(F.col("total"), "bytes").alias("size"))
    return rows.groupBy("total", "size").agg(F.count("*").alias("n"))


@_query(f"""{EVENTS_SQL} SELECT 'service_name=' || service_name || ',user=' || "user" AS labels FROM p WHERE service_name = 'view' UNION SELECT 'service_name=' || service_name || ',user=' || "user" FROM p WHERE "user" < '4'""")
def label_sets_merged(spark, d):
    rows = event_profiles(spark, d)
    return series.merge_label_sets(rows.where("service_name = 'view'"), rows.where("user < '4'")).select(_text("labels").alias("labels"))


@_query(f"""{EVENTS_SQL} SELECT service_name, ts_ms // {DAY} * {DAY} AS ts_ms, CAST(sum(total) AS BIGINT) AS total, array_to_string(list_sort(list_distinct(list("user"))), ',') AS attributes FROM p WHERE span IS NOT NULL GROUP BY service_name, ts_ms // {DAY} * {DAY}, span""")
def heatmap_points(spark, d):
    """Points of one day, service and span made one."""
    rows = event_profiles(spark, d).where("span is not null").select("service_name", (F.floor(F.col("ts_ms") / DAY) * DAY).cast("long").alias("ts_ms"), F.lit("p").alias("profile_id"), F.col("span").alias("span_id"), F.lit(None).cast("string").alias("trace_id"), "total", F.array("user").alias("attributes"))
    out = series.merge_heatmap_points(rows, ["service_name"])
    return out.select("service_name", "ts_ms", "total", F.array_join("attributes", ",").alias("attributes"))


@_query(f"""{EVENTS_SQL} SELECT profile_id, total, service_name FROM p ORDER BY total DESC, ts_ms, profile_id LIMIT 25""")
def exemplar_list(spark, d):
    found, names = series.list_exemplars(event_profiles(spark, d), 25, 1)
    assert names, "no labels"
    return found.select("profile_id", "total", L.get(F.col("labels"), "service_name").alias("service_name"))


def delta_by_stack(spark, d):
    """Deltas of one cumulative value per service and user, the service's users being its stacks; a day is a profile. SQL cannot carry the resets."""
    rows = event_profiles(spark, d).select("service_name", (F.floor(F.col("ts_ms") / DAY) * DAY).cast("long").alias("ts_ms"), "user", "total")
    days = rows.groupBy("service_name", "ts_ms", "user").agg(F.max("total").alias("total"))
    return series.delta(days, ["service_name"], stack="user")


_query()(delta_by_stack)


@_query(f"""{EVENTS_SQL} SELECT DISTINCT 'tenant-' || "user" AS tenant FROM p WHERE "user" <> '0'""")
def tenants(spark, d):
    rows = event_profiles(spark, d).select(F.when(F.col("user") != "0", F.concat(F.lit("tenant-"), "user")).otherwise("").alias("tenant"))
    return rows.where("tenant <> ''").distinct()


@_query(f"""{ORDERS_SQL}, n AS (SELECT frames, sum(value) AS v FROM s WHERE status = 'O' GROUP BY 1), o AS (SELECT frames, sum(value) AS v FROM s WHERE status = 'F' GROUP BY 1)
  SELECT array_to_string(n.frames, ';') AS path, CAST(n.v - coalesce(o.v, 0) AS BIGINT) AS value FROM n LEFT JOIN o USING (frames) WHERE n.v > coalesce(o.v, 0)""")
def stack_difference(spark, d):
    s = order_samples(spark, d)
    return tree.stack_difference(s.where("status = 'O'"), s.where("status = 'F'")).select(F.concat_ws(";", "frames").alias("path"), "value")


@_query(f"""{EVENTS_SQL} SELECT "user" AS tenant, count(*) AS n FROM p WHERE ts_ms >= {END} - CASE "user" WHEN '1' THEN 3 WHEN '2' THEN 20000 ELSE 10 END * {DAY}::BIGINT GROUP BY 1""")
def retention(spark, d):
    rows = event_profiles(spark, d).withColumn("tenant", F.col("user"))
    return maintain.retained(rows, END, 10, {"1": 3, "2": 0}).groupBy("tenant").agg(F.count("*").alias("n"))


@_query(f"""{EVENTS_SQL} SELECT service_name, count(*) AS n FROM p WHERE ts_ms < {START} + 5 * {DAY} AND "user" <> '1' OR ts_ms >= {START} + 5 * {DAY} AND "user" <> '2' GROUP BY 1""")
def two_generations(spark, d):
    rows = event_profiles(spark, d)
    return maintain.generations(rows.where("user <> '1'"), rows.where("user <> '2'"), START + 5 * DAY).groupBy("service_name").agg(F.count("*").alias("n"))
