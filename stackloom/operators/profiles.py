"""Profile-level operators: types, checks with a reason, sampling to totals, spans, call sites, annotations, scope of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.storage import cut, small
from . import tree

UNKNOWN = "<unknown>"


def profile_types(rows: DataFrame, col: str = "profile_type") -> DataFrame:
    """Distinct types ``name:sample_type:sample_unit:period_type:period_unit``, split; a sixth part ``delta`` may follow, others are skipped."""
    names = ["name", "sample_type", "sample_unit", "period_type", "period_unit"]
    ids = rows.select(F.col(col).alias("id")).distinct().where(_well_formed())
    return ids.select("id", *[F.get(F.split("id", ":"), F.lit(i)).alias(n) for i, n in enumerate(names)])


def _well_formed() -> Column:
    part = F.split("id", ":")
    return (F.size(part) == 5) | ((F.size(part) == 6) & (F.get(part, F.lit(5)) == "delta"))


def check(samples: DataFrame, max_depth: int = 1000, max_name: int = 65_535) -> tuple[DataFrame, DataFrame]:
    """Samples within the limits, and rejected ones with ``reason``.

    Stacks deeper than ``max_depth`` keep the frames nearest the root; of longer
    names the end is kept. Null or empty stacks and null or negative values are rejected.
    """
    reason = F.when(F.col("frames").isNull() | (F.size("frames") == 0), "no_stack").when(F.col("value").isNull(), "no_value").when(F.col("value") < 0, "negative_value")
    marked = samples.withColumn("reason", reason)
    cut = F.transform(F.slice("frames", 1, max_depth), lambda f: F.right(f, F.lit(max_name)))
    return marked.where("reason is null").drop("reason").withColumn("frames", cut), marked.where("reason is not null")


def in_spans(rows: DataFrame, spans: list[str], col: str = "span") -> DataFrame:
    """Rows of the given spans (16 hex digits each); the zero span and null match nothing."""
    for s in spans:
        if len(s) != 16 or set(s.lower()) - set("0123456789abcdef"):
            raise ValueError(f"span {s!r} is not 16 hex digits")
    wanted = sorted({s.lower() for s in spans} - {"0" * 16})
    return rows.where(F.lower(col).isin(*wanted) if wanted else F.lit(False))


def totals_only(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One stackless row per profile, its total, marked as sampled out."""
    return samples.where("value > 0").groupBy(*keys).agg(F.sum("value").alias("total")).withColumn("sampled", F.lit("true"))


def call_site_totals(samples: DataFrame, keys: list[str], site: list[str]) -> DataFrame:
    """Per profile the value of the stacks below a call site; profiles without one count 0."""
    inside = F.when(tree.in_call_site(F.col("frames"), site) & (F.col("value") > 0), F.col("value")).otherwise(0)
    return samples.groupBy(*keys).agg(F.sum(inside).alias("total"))


def merge_points(points: DataFrame, by: list[str]) -> DataFrame:
    """Partial points of one group and time made one: values are summed, ``annotations`` become one sorted set."""
    notes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("annotations"))))
    return points.groupBy(*by, "ts").agg(F.sum("value").alias("value"), notes.alias("annotations"))


def top_label_values(rows: DataFrame, label: str, start: int, end: int, limit: int) -> DataFrame:
    """``(label_value, value)`` of the ``limit`` values of largest sum after ``start`` (excluded); a missing label is ``<unknown>``."""
    value = L.get(F.col("labels"), label)
    named = rows.where((F.col("ts_ms") > start) & (F.col("ts_ms") <= end)).select(F.when(value == "", UNKNOWN).otherwise(value).alias("label_value"), "total")
    return named.groupBy("label_value").agg(F.sum("total").alias("value")).orderBy(F.desc("value"), "label_value").limit(limit)


def query_scope(rows: DataFrame, start: int, end: int, by: list[str]) -> DataFrame:
    """One row: how many series and profiles a query over the range reads, and how many days they touch."""
    seen = rows.where(F.col("ts_ms").between(start, end))
    days = seen.groupBy(*by, F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.count("*").alias("n"))
    return days.agg(F.count_distinct(F.struct(*by)).alias("n_series"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_profiles"), F.count_distinct("day").alias("n_days"))


def top_heatmap(cells: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The cells of the ``limit`` groups of most points; ties go by group in order; 0 keeps all."""
    if not limit:
        return cells
    best = cells.groupBy(*by).agg(F.sum("count").alias("_n")).orderBy(F.desc("_n"), *by).limit(limit).drop("_n")
    return cells.join(small(best, limit), by, "left_semi")


def trim_call_graph(nodes: DataFrame, edges: DataFrame, total: DataFrame, max_nodes: int, node_share: float = 0.005, edge_share: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Nodes of at least ``node_share`` of the one-row ``total``, the ``max_nodes`` largest of them, and edges between these.

    Ties of cumulative values go by name. Edges need ``edge_share`` of the total.
    """
    whole = F.broadcast(total.select(F.col("value").alias("_all")))  # one row
    big = cut(nodes.crossJoin(whole).where(F.col("cum") >= node_share * F.col("_all")).drop("_all").orderBy(F.desc("cum"), "name").limit(max_nodes))
    names = small(big.select("name"), max_nodes)
    strong = edges.crossJoin(whole).where(F.col("weight") >= edge_share * F.col("_all")).drop("_all")
    kept = strong.join(names.withColumnRenamed("name", "caller"), "caller", "left_semi").join(names.withColumnRenamed("name", "callee"), "callee", "left_semi")
    return big, kept.select("caller", "callee", "weight")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The statements of a trimmed graph in DOT, a line each, without the enclosing braces."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    node = nodes.select(F.concat(quoted("name"), F.lit(" [flat="), F.col("flat").cast("string"), F.lit(" cum="), F.col("cum").cast("string"), F.lit("]")).alias("line"))
    return node.unionByName(edges.select(F.concat(quoted("caller"), F.lit(" -> "), quoted("callee"), F.lit(" [weight="), F.col("weight").cast("string"), F.lit("]")).alias("line")))
