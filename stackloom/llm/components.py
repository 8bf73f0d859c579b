"""Connected components of an edge table, by alternating star contractions.

Edges lie once, from the greater node to the smaller. Every half round is a
grouped minimum, written, and one join of the edges with it; both sides of the join
are plain shuffles, so Spark splits the neighbours of a hub over tasks. A
node that is less than all its neighbours changes nothing and is left out of the
minima. Nothing is gathered on the driver but a row count and a checksum that
tell when the edges have stopped changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _down(src, dst):
    return F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours above a node are tied to the least of its neighbourhood."""
    least = stored(edges.groupBy("src").agg(F.min("dst").alias("low")).withColumnRenamed("src", "dst"), "least")
    moved = edges.join(least, "dst", "left").select("src", F.coalesce("low", "dst").alias("dst"))
    return stored(moved.distinct(), "edges"), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours below a node, and the node, are tied to the least of them."""
    least = stored(edges.groupBy("src").agg(F.min("dst").alias("low"), F.max("dst").alias("high")), "least")
    several = least.where("low < high").select("src", "low")
    moved = edges.join(several, "src").where("dst > low").select(*_down("dst", "low"))
    return stored(moved.unionByName(least.select("src", F.col("low").alias("dst"))).distinct(), "edges"), least


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``edges(src, dst)`` of longs to ``(node, component)``, component being the least node reachable.

    Repeated edges and loops are allowed, rows with a null end are ignored, and
    an empty table gives an empty result. Only nodes on some edge between two
    different nodes are returned. Raises if ``max_rounds`` do not suffice.
    """
    now = stored(edges.select(*_down("src", "dst")).where("src <> dst").distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        large, low = _large_star(now)
        release(now, low)
        now, low = _small_star(large)
        release(large, low)
        before, state = state, _state(now)
        if before == state:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
    raise RuntimeError(f"components still change after {max_rounds} rounds")
