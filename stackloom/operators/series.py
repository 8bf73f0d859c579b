"""Time series, heat maps, exemplars, top-n and timelines over profile rows.

Rows have ``ts_ms`` and a numeric ``total``; groups are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import small
from ..functions.times import bucket

ROWS = 20  # value buckets of a heat map


def _steps(rows: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Rows from one step before ``start`` to the last full step, labelled with their step's right edge."""
    if step < 1:
        raise ValueError("a step has one millisecond at least")
    last = start + (end - start) // step * step
    return rows.where(F.col("ts_ms").between(start - step, last)).withColumn("ts", bucket(F.col("ts_ms"), start, step))


def series(rows: DataFrame, by: list[str], start: int, end: int, step: int, how: str = "sum") -> DataFrame:
    """``(by…, ts, value)`` per step that has points; ``how`` is sum or avg."""
    if how not in ("sum", "avg"):
        raise ValueError(how)
    value = F.sum("total") if how == "sum" else F.avg("total")
    return _steps(rows, start, end, step).groupBy(*by, "ts").agg(value.alias("value"))


def top_series(points: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The points of the ``limit`` groups of largest sum; ties go by group in order; 0 keeps all."""
    if not limit:
        return points
    best = points.groupBy(*by).agg(F.sum("value").alias("_sum")).orderBy(F.desc("_sum"), *by).limit(limit).drop("_sum")
    return points.join(small(best, limit), by, "left_semi")


def profile_exemplars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one ``keys``, profile and time made one: totals summed, ``labels`` (if there are any) intersected.

    Rows without a profile id count, under a null id, but are no exemplars.
    """
    labels = "labels" in rows.columns
    entries = F.collect_list(F.map_entries("labels"))
    common = F.aggregate(F.slice(entries, 2, F.size(entries)), F.get(entries, F.lit(0)), lambda a, x: F.array_intersect(a, x))
    shared = [F.map_from_entries(common).alias("labels")] if labels else []
    return rows.groupBy(*keys, "profile_id", "ts_ms").agg(F.sum("total").alias("total"), *shared)


def exemplars(rows: DataFrame, by: list[str], start: int, end: int, step: int) -> DataFrame:
    """The largest profile of every point, with the labels its rows share; ties go to the smallest id."""
    summed = profile_exemplars(_steps(rows, start, end, step), [*by, "ts"])
    own = [F.to_json("labels").alias("labels")] if "labels" in summed.columns else []
    pick = F.min(F.when(F.col("profile_id").isNotNull(), F.struct((-F.col("total")).alias("down"), "profile_id", "ts_ms", *own)))
    found = summed.groupBy(*by, "ts").agg(F.sum("total").alias("value"), pick.alias("e"))
    shared = [F.from_json("e.labels", "map<string,string>").alias("exemplar_labels")] if own else []
    return found.select(*by, "ts", "value", F.col("e.profile_id").alias("exemplar_id"), F.col("e.ts_ms").alias("exemplar_ts"), (-F.col("e.down")).alias("exemplar_value"), *shared)


def timeline(points: DataFrame, start_ms: int, end_ms: int, step_s: int) -> DataFrame:
    """``(ts, value)`` at every step from ``start`` snapped down; empty steps are 0."""
    step = step_s * 1000
    first, last = start_ms // step * step, end_ms // step * step
    spark = points.sparkSession
    grid = spark.range(first, max(last, first + step), step).select(F.col("id").alias("ts"))
    found = points.select((F.floor(F.col("ts_ms") / step) * step).alias("ts"), "value").groupBy("ts").agg(F.sum("value").alias("value"))
    return grid.join(found, "ts", "left").select("ts", F.coalesce(F.col("value").cast("bigint"), F.lit(0)).alias("value"))


#: Up to this many seconds between points, the step in seconds.
STEPS = [
    (17.5, 15), (25, 20), (45, 30), (90, 60), (210, 120), (450, 300), (750, 600), (1050, 900), (1500, 1200), (2700, 1800), (5400, 3600), (9000, 7200),
    (16_200, 10_800), (32_400, 21_600), (86_400, 43_200), (604_800, 86_400), (1_814_400, 604_800), (3_628_799, 2_592_000),
]
LONGEST_STEP = 31_536_000


def auto_step_s(start_ms: int, end_ms: int, points: int = 1500) -> int:
    """The round step, 15 seconds at least, nearest to what gives ``points`` points."""
    raw = (end_ms - start_ms) / 1000 / points
    return next((step for most, step in STEPS if raw <= most), LONGEST_STEP)


def _grid_time(ts: Column, start: int, end: int, step: int) -> Column:
    last = start + -(-(end - start) // step) * step
    return F.least(bucket(ts, start, step), F.lit(last))


def heatmap(rows: DataFrame, by: list[str], start: int, end: int, step: int, exemplar: tuple[str, ...] = ()) -> DataFrame:
    """``(by…, ts, y, y_min, count)`` of points ``(by…, ts_ms, total)``, with ``exemplar`` columns also the largest point.

    That is a struct of its value, time and these columns; ties go to the earliest, then in order of the columns.

    20 value buckets lie between the least and the largest value over all groups;
    a value is in the first bucket that holds it, the largest in the last. Only
    filled cells are listed. Two passes: a one-row aggregate, then the counts.
    """
    seen = rows.where(F.col("ts_ms").between(start - step, end))
    low_high = seen.agg(F.min("total").alias("lo"), F.max("total").alias("hi")).select("lo", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))
    edge = lambda i: F.col("lo") + F.floor(i * (F.col("hi") - F.col("lo")) / ROWS).cast("bigint")
    edges = low_high.select(F.transform(F.sequence(F.lit(0), F.lit(ROWS)), edge).alias("edges"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda i: (F.col("total") >= F.get("edges", i)) & (F.col("total") < F.get("edges", i + 1)))
    cell = F.coalesce(F.get(inside, F.lit(0)), F.lit(ROWS - 1)).alias("y")
    point = F.struct((-F.col("total")).alias("down"), F.col("ts_ms").alias("at"), *exemplar).alias("point")
    placed = seen.crossJoin(F.broadcast(edges)).select(*by, _grid_time(F.col("ts_ms"), start, end, step).alias("ts"), cell, "edges", *([point] if exemplar else []))
    best = [F.min("point").alias("point")] if exemplar else []
    cells = placed.groupBy(*by, "ts", "y").agg(F.count("*").alias("count"), F.first("edges").alias("edges"), *best)
    named = F.struct((-F.col("point.down")).alias("value"), F.col("point.at").alias("ts_ms"), *[F.col(f"point.{c}").alias(c) for c in exemplar])
    return cells.select(*by, "ts", "y", "count", F.get("edges", F.col("y")).alias("y_min"), *([F.slice("edges", 1, ROWS).alias("edges"), named.alias("exemplar")] if exemplar else []))


def heatmap_slots(rows: DataFrame, by: list[str], start: int, end: int, step: int, exemplar: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """``(by…, ts, y_min, counts, exemplars)``: a row per group and step, all 20 value buckets with their counts, and an exemplar for each filled one."""
    cells = heatmap(rows, by, start, end, step, exemplar)
    filled = F.map_from_entries(F.collect_list(F.struct("y", "count")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda y: F.coalesce(F.try_element_at(filled, y), F.lit(0)))
    best = F.transform(F.array_sort(F.collect_list(F.struct("y", "exemplar"))), lambda x: x["exemplar"])
    return cells.groupBy(*by, "ts").agg(F.first("edges").alias("y_min"), counts.alias("counts"), best.alias("exemplars"))


def merge_heatmap_points(points: DataFrame, by: list[str]) -> DataFrame:
    """Points of one group, time, profile, span and trace made one: values summed, ``attributes`` united and sorted."""
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_set("attributes"))))
    return points.groupBy(*by, "ts_ms", "profile_id", "span_id", "trace_id").agg(F.sum("total").alias("total"), united.alias("attributes"))


def list_exemplars(points: DataFrame, limit: int, labels: int = 3) -> tuple[DataFrame, list[str]]:
    """The ``limit`` largest points, and the names of the ``labels`` labels with most different values among all points (ties by name)."""
    counted = points.select(F.explode("labels").alias("name", "value")).groupBy("name").agg(F.count_distinct("value").alias("n"))
    names = [r["name"] for r in counted.orderBy(F.desc("n"), "name").limit(labels).collect()]
    return points.orderBy(F.desc("total"), "ts_ms", "profile_id").limit(limit), names


def span_points(samples: DataFrame, by: list[str]) -> DataFrame:
    """Samples summed per profile time and span, for a heat map of spans; samples without one are left out."""
    return samples.where(F.col("span").isNotNull()).groupBy(*by, "ts_ms", "span").agg(F.sum("total").alias("total"))


def delta(rows: DataFrame, keys: list[str], time: str = "ts_ms", value: str = "total", stack: str | None = None) -> DataFrame:
    """Differences of a cumulative value in order of time; the first row of a key and any reset yield none.

    With ``stack``, the rows of a key and time are one profile: ``(keys…, time,
    stack, value, delta)``, values summed per stack. The first profile yields
    nothing; a stack not seen before, or not since the last reset, its full value;
    a missing stack keeps its last value; a decrease of any stack resets the key:
    that profile yields nothing and is all that is known from there.
    """
    if stack is None:
        before = F.lag(value).over(Window.partitionBy(*keys).orderBy(time, value))
        out = rows.withColumn("delta", F.col(value) - before)
        return out.where("delta >= 0")
    summed = rows.groupBy(*keys, time, stack).agg(F.sum(value).alias(value)).withColumn("_key", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    own = Window.partitionBy("_key", stack).orderBy(time)
    seen = summed.withColumns({"_before": F.lag(value).over(own), "_at": F.lag(time).over(own)})
    falls = seen.where(F.col(value) < F.col("_before")).groupBy("_key", F.col(time).alias("_fall")).agg(F.max("_at").alias("_since"))
    kinds = dict(seen.dtypes)
    resets = falls.repartition("_key").sortWithinPartitions("_key", "_fall").mapInPandas(_resets, f"_key string, _reset {kinds[time]}")
    marked = seen.join(resets.withColumnRenamed("_key", "_of"), (F.col("_key") == F.col("_of")) & (F.col(time) == F.col("_reset")), "left")
    key = Window.partitionBy("_key")
    marked = marked.withColumns({"_last": F.max("_reset").over(key.orderBy(time)), "_first": F.min(time).over(key)})
    known = F.col("_at").isNotNull() & (F.col("_last").isNull() | (F.col("_at") >= F.col("_last")))
    out = marked.where(F.col("_reset").isNull() & (F.col(time) > F.col("_first")))
    return out.select(*keys, time, stack, value, F.when(known, F.col(value) - F.col("_before")).otherwise(F.col(value)).alias("delta"))


def _resets(batches):
    """Of each key's falls, in order, those from a value that is known since the last reset."""
    key = last = None
    for batch in batches:
        hit = []
        for k, at, since in zip(batch["_key"], batch["_fall"], batch["_since"], strict=True):
            if k != key:
                key, last = k, None
            hit.append(last is None or since >= last)
            if hit[-1]:
                last = at
        yield batch.loc[hit, ["_key", "_fall"]].rename(columns={"_fall": "_reset"})


def _label_sets(rows: DataFrame) -> DataFrame:
    """The distinct label sets: they are few where rows are many, and the maps are opened only after that."""
    return rows.select(F.array_sort(F.map_entries("labels")).alias("entries")).distinct()


def label_names(rows: DataFrame) -> DataFrame:
    return _label_sets(rows).select(F.explode("entries.key").alias("name")).distinct()


def label_values(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.try_element_at("labels", F.lit(name)).alias("value")).where("value <> ''").distinct()


def series_labels(rows: DataFrame, names: list[str]) -> DataFrame:
    """Distinct label subsets, one column per name, empty where missing; a set that has none of the names is left out."""
    rows = rows.where(F.arrays_overlap(F.map_keys("labels"), F.array(*[F.lit(n) for n in names]))) if names else rows
    return rows.select(*[F.coalesce(F.try_element_at("labels", F.lit(n)), F.lit("")).alias(n) for n in names]).distinct()


def cardinality(rows: DataFrame) -> DataFrame:
    """Distinct values of each label, exact."""
    pairs = _label_sets(rows).select(F.explode("entries").alias("e")).select(F.col("e.key").alias("name"), "e.value").distinct()
    return pairs.groupBy("name").agg(F.count("*").alias("n_values"))


def top_cardinality(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` labels with most values; ties go by name."""
    return cardinality(rows).orderBy(F.desc("n_values"), "name").limit(limit)


def merge_label_sets(*reports: DataFrame) -> DataFrame:
    """The union of several reports' ``labels``, each set once, whatever the order of its names."""
    sets = [_label_sets(r) for r in reports]
    whole = sets[0]
    for s in sets[1:]:
        whole = whole.unionByName(s)
    return whole.distinct().select(F.map_from_entries("entries").alias("labels"))


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg((F.count("*") > 0).alias("data_ingested"), F.min("ts_ms").alias("oldest"), F.max("ts_ms").alias("newest"))
