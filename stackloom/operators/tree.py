"""Call trees as tables: ``(path array<string>, name, depth, self, total)``, root first.

Samples are summed by whole stack before anything is exploded, so the rows that
grow with the depth of a stack are distinct stacks, not samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut

OTHER = "other"


def sum_stacks(samples: DataFrame) -> DataFrame:
    """``(frames, value)`` per distinct stack; values of 0 and below are ignored."""
    return samples.where((F.col("value") > 0) & (F.size("frames") > 0)).groupBy("frames").agg(F.sum("value").alias("value"))


def prefixes(frames: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(frames)), lambda i: F.slice(frames, F.lit(1), i))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select("path", F.element_at("path", -1).alias("name"), F.size("path").alias("depth"), "self", "total")


def _key(frames: Column, *names: str) -> list[Column]:
    """128 bits of a stack, as two longs: XXH64 under two unrelated seeds."""
    return [F.xxhash64(frames).alias(names[0]), F.xxhash64(F.lit(1), frames).alias(names[1])]


def tree(samples: DataFrame) -> DataFrame:
    """The prefix tree of ``(frames, value)``: every prefix gets the total, the whole stack also the own value.

    Prefixes are summed by their 128-bit hash, so that a stack's rows do not grow with the
    square of its depth; each node's path is then cut from one of its stacks.
    """
    stacks_ = cut(sum_stacks(samples).select("frames", "value", *_key(F.col("frames"), "s1", "s2")))
    keys = F.transform(F.sequence(F.lit(1), F.size("frames")), lambda i: F.struct(i.alias("depth"), *_key(F.slice("frames", F.lit(1), i), "h1", "h2")))
    rows = stacks_.select("value", "s1", "s2", F.size("frames").alias("d"), F.inline(keys))
    own = F.when(F.col("depth") == F.col("d"), F.col("value")).otherwise(0)
    nodes = rows.groupBy("h1", "h2").agg(F.first("depth").alias("depth"), F.sum(own).alias("self"), F.sum("value").alias("total"), F.min(F.struct("s1", "s2")).alias("s"))
    whole = nodes.select("depth", "self", "total", "s.s1", "s.s2").join(stacks_.select("s1", "s2", "frames"), ["s1", "s2"])
    return _named(whole.select(F.slice("frames", F.lit(1), F.col("depth")).alias("path"), "self", "total"))


def merge(*trees: DataFrame) -> DataFrame:
    """Node by node sum."""
    rows = trees[0].select("path", "self", "total")
    for t in trees[1:]:
        rows = rows.unionByName(t.select("path", "self", "total"))
    return _named(rows.groupBy("path").agg(F.sum("self").alias("self"), F.sum("total").alias("total")))


def stacks(nodes: DataFrame) -> DataFrame:
    """Back to ``(frames, value)``: the nodes with own value."""
    return nodes.where("self > 0").select(F.col("path").alias("frames"), F.col("self").alias("value"))


def rename(samples: DataFrame, name) -> DataFrame:
    """Frames renamed by a column function; stacks that become equal are added up."""
    return sum_stacks(samples.select(F.transform("frames", name).alias("frames"), "value"))


def min_value(nodes: DataFrame, max_nodes: int, by: str = "total") -> DataFrame:
    """One row ``low``: the ``max_nodes``-th largest total, 0 if there are no more nodes than that."""
    top = nodes.select(by).orderBy(F.desc(by)).limit(max(max_nodes, 0) + 1).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(by), asc=False).alias("v"))
    return top.select(F.when((F.col("n") > max_nodes) & F.lit(max_nodes > 0), F.get("v", F.lit(max_nodes - 1))).otherwise(0).alias("low"))


def truncate(nodes: DataFrame, max_nodes: int, values: tuple[str, ...] = ("self", "total"), by: Column | None = None) -> DataFrame:
    """Keep nodes of at least the ``max_nodes``-th total, and ``other`` nodes below kept ones.

    Dropped children of a node are added up in its child ``other``. Ties may keep
    more than ``max_nodes``. The threshold is global and exact. The nodes are computed
    once; one join with the kept ones tells which dropped nodes hang below them.
    """
    nodes = cut(nodes.withColumn("_by", by if by is not None else F.col("total")))
    low = min_value(nodes, max_nodes, "_by").first()["low"]
    big, small = nodes.where(F.col("_by") >= low), nodes.where(F.col("_by") < low)
    # an "other" node is kept with its nearest ancestor that is not one
    others = small.where(F.col("name") == OTHER).withColumn("_base", _without_trailing_other(F.col("path")))
    bases = big.select(F.col("path").alias("_base"))
    with_base = others.join(bases, "_base", "left_semi").unionByName(others.where(F.size("_base") == 0))
    kept = big.select("path", *values).unionByName(with_base.select("path", *values))
    totals = [c for c in values if c.startswith("total")]
    gone = small.where(F.col("name") != OTHER).unionByName(others.where(F.size("_base") > 0).join(bases, "_base", "left_anti").drop("_base"))
    gone = gone.withColumn("_up", F.slice("path", F.lit(1), F.size("path") - 1))
    parent = kept.select(F.col("path").alias("_up")).unionByName(kept.sparkSession.range(1).select(F.array().cast("array<string>").alias("_up")))
    folded = gone.join(parent, "_up", "left_semi").groupBy("_up").agg(*[F.sum(c).alias(c) for c in totals])
    other = folded.select(F.concat("_up", F.array(F.lit(OTHER))).alias("path"), *[F.col(c.replace("self", "total")).alias(c) for c in values])
    out = kept.unionByName(other).groupBy("path").agg(*[F.sum(c).alias(c) for c in values])
    return out.select("path", F.element_at("path", -1).alias("name"), F.size("path").alias("depth"), *values)


def _without_trailing_other(path: Column) -> Column:
    places = F.transform(path, lambda x, i: F.when(x != OTHER, i + 1).otherwise(0))
    return F.slice(path, F.lit(1), F.array_max(places))


def diff(left: DataFrame, right: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Two trees aligned by path, a missing side being 0; optionally truncated by the larger total.

    The synthetic root counts as one of ``max_nodes``.
    """
    a = left.select("path", F.col("self").alias("self_left"), F.col("total").alias("total_left"))
    b = right.select("path", F.col("self").alias("self_right"), F.col("total").alias("total_right"))
    cols = ["self_left", "total_left", "self_right", "total_right"]
    both = a.join(b, "path", "full").select("path", F.element_at("path", -1).alias("name"), F.size("path").alias("depth"), *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    if max_nodes is None:
        return both
    return truncate(both, max_nodes - 1, tuple(cols), F.greatest("total_left", "total_right"))


def subtract(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Newer minus older per node; a node whose total has not grown goes, and all below it."""
    both = cut(diff(older, newer))
    left = lambda c: F.greatest(F.col(f"{c}_right") - F.col(f"{c}_left"), F.lit(0)).alias(c)
    grown = both.where("total_right > total_left").select("path", "name", "depth", left("self"), left("total"))
    above = grown.select("path", "depth", F.explode(prefixes(F.col("path"))).alias("up"))
    whole = above.join(grown.select(F.col("path").alias("up")), "up").groupBy("path", "depth").agg(F.count("*").alias("n")).where("n = depth")
    return grown.join(whole.select("path"), "path", "left_semi").select("path", "name", "depth", "self", "total")


def stack_difference(newer: DataFrame, older: DataFrame) -> DataFrame:
    """``(frames, value)`` of newer samples less those of older ones, stack by stack; what has not grown goes."""
    a, b = sum_stacks(newer), sum_stacks(older).withColumnRenamed("value", "before")
    return a.join(b, "frames", "left").select("frames", (F.col("value") - F.coalesce("before", F.lit(0))).alias("value")).where("value > 0")


def scale(nodes: DataFrame, multiplier: int, divisor: int = 1) -> DataFrame:
    by = lambda c: F.floor(F.col(c) * multiplier / divisor).cast("bigint").alias(c)
    return nodes.select("path", "name", "depth", by("self"), by("total"))


def in_call_site(frames: Column, site: list[str]) -> Column:
    """Whether a stack starts with the frames of ``site``."""
    return F.slice(frames, 1, len(site)) == F.array(*[F.lit(s) for s in site]) if site else F.lit(True)


def call_site_values(samples: DataFrame, site: list[str]) -> DataFrame:
    """One row: own and total value in the call site, and of its last function anywhere."""
    name, f = F.lit(site[-1]), F.col("frames")
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("value")).otherwise(0)), F.lit(0)).cast("bigint")
    under = in_call_site(f, site)
    return sum_stacks(samples).agg(
        pick(under & (F.size(f) == len(site))).alias("flat"),
        pick(under).alias("total"),
        pick(F.element_at(f, -1) == name).alias("location_flat"),
        pick(F.array_contains(f, name)).alias("location_total"),
    )


def keep_leaves(samples: DataFrame, locations: int) -> DataFrame:
    """Only the ``locations`` frames nearest the leaf, as compilers' profile-guided builds take them."""
    n = F.size("frames")
    return sum_stacks(samples.select(F.slice("frames", F.greatest(n - locations, F.lit(0)) + 1, F.lit(locations)).alias("frames"), "value"))


def top_table(nodes: DataFrame) -> DataFrame:
    """``(name, self, total)`` per function; of recursive calls only the outermost counts in the total."""
    outermost = ~F.array_contains(F.slice("path", F.lit(1), F.size("path") - 1), F.col("name"))
    return nodes.groupBy("name").agg(F.sum("self").alias("self"), F.sum(F.when(outermost, F.col("total")).otherwise(0)).alias("total"))


def callees(samples: DataFrame, name: str) -> DataFrame:
    """The tree below every outermost occurrence of a function."""
    rows = sum_stacks(samples).where(F.array_contains("frames", name))
    at = F.array_position("frames", F.lit(name)).cast("int")
    return tree(rows.select(F.slice("frames", at, F.size("frames")).alias("frames"), "value"))


def callers(samples: DataFrame, name: str) -> DataFrame:
    """The tree of callers, from the function towards the root, sized by what they contribute."""
    rows = sum_stacks(samples).where(F.array_contains("frames", name))
    at = F.array_position("frames", F.lit(name)).cast("int")
    return tree(rows.select(F.reverse(F.slice("frames", F.lit(1), at)).alias("frames"), "value"))


def call_graph(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(name, flat, cum)`` and edges ``(caller, callee, weight)``; a sample counts once at each."""
    rows = sum_stacks(samples)
    leaf = F.element_at("frames", -1)
    nodes = rows.select("value", leaf.alias("leaf"), F.explode(F.array_distinct("frames")).alias("name"))
    nodes = nodes.groupBy("name").agg(F.sum(F.when(F.col("name") == F.col("leaf"), F.col("value")).otherwise(0)).alias("flat"), F.sum("value").alias("cum"))
    pairs = F.transform(F.slice("frames", F.lit(1), F.size("frames") - 1), lambda x, i: F.struct(x.alias("caller"), F.get(F.col("frames"), i + 1).alias("callee")))
    edges = rows.select("value", F.explode(F.array_distinct(pairs)).alias("e")).where("e.caller <> e.callee")
    return nodes, edges.groupBy("e.caller", "e.callee").agg(F.sum("value").alias("weight"))


def resolve_addresses(addresses: DataFrame, symbols: DataFrame, page: int = 1 << 12) -> DataFrame:
    """``(binary, address, names)``: the symbols whose ``[va, va + len)`` hold an address, innermost first, else ``binary!0xaddr``.

    ``symbols(binary, va, len, name, depth)``: functions have depth 0, what is inlined into them more
    (no column: all 0). Ranges are taken from the last start back to the first function that holds the address;
    of equal starts the deeper, then the shorter one is the inner. Repeated addresses come out once.
    A range join by pages: symbols are listed under each page they touch.
    """
    pages = F.explode(F.sequence(F.floor(F.col("va") / page), F.floor((F.col("va") + F.col("len") - 1) / page)))
    depth = F.col("depth") if "depth" in symbols.columns else F.lit(0)
    listed = symbols.where("len > 0").select("binary", "va", "len", depth.alias("depth"), F.col("name").alias("symbol"), pages.alias("page"))
    asked = addresses.withColumn("page", F.floor(F.col("address") / page))
    on = [asked.binary == listed.binary, asked.page == listed.page, F.col("address") >= F.col("va"), F.col("address") < F.col("va") + F.col("len")]
    fallback = F.array(F.concat(F.col("binary"), F.lit("!0x"), F.lower(F.hex("address"))))
    held = F.when(F.col("symbol").isNotNull(), F.struct((-F.col("va")).alias("start"), (-F.col("depth")).alias("deep"), "len", "symbol"))
    chain = asked.join(listed, on, "left").select(asked.binary, "address", held.alias("s")).groupBy("binary", "address").agg(F.array_sort(F.collect_set("s")).alias("s"))
    outer = F.array_position(F.transform("s.deep", lambda d: d == 0), F.lit(True)).cast("int")
    inside = F.slice(F.col("s.symbol"), F.lit(1), F.when(outer > 0, outer).otherwise(F.size("s")))
    return chain.select("binary", "address", F.when(F.size("s") > 0, inside).otherwise(fallback).alias("names"))


def check_unresolved(addresses: DataFrame, limit: int) -> DataFrame:
    """The distinct addresses, if they are ``limit`` at most (0: any number); else an error."""
    found = addresses.select("binary", "address").distinct()
    if limit and found.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} unresolved addresses")
    return found
