"""Storage upkeep and ingestion rules: duplicates, downsampling, compaction, retention, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

#: Blocks of a level that are compacted together, and the longest wait in seconds.
LEVELS = [(20, 36), (10, 720), (10, 10_800)]


def dedup(rows: DataFrame, keys: list[str], prefer: list[str]) -> DataFrame:
    """One row per key: the first in the order of ``prefer``, nulls first. Each task keeps one row per key before the shuffle."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*prefer))
    return rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(first.alias("_row")).select("_row.*")


def downsample(samples: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Sums per key, ``floor(ts / seconds)`` window and stack; windows are named by their start."""
    window = (F.floor(F.col("ts_ms") / (seconds * 1000)) * seconds * 1000).cast("bigint")
    return samples.withColumn("ts_ms", window).groupBy(*keys, "ts_ms", "frames").agg(F.sum("value").alias("value"))


def compact(rows: DataFrame, path: str, files: int, sort: tuple[str, ...] = ("service_name", "ts_ms")) -> None:
    """Rewrite rows as ``files`` range-partitioned, sorted files."""
    rows.repartitionByRange(files, *sort).sortWithinPartitions(*sort).write.parquet(path)


def pick_resolution(step_ms: int, available_s: tuple[int, ...] = (300, 3600)) -> int:
    """The coarsest downsampled table that divides the step; 0 is the source."""
    return max((s for s in available_s if step_ms >= s * 1000 and step_ms % (s * 1000) == 0), default=0)


def retained(rows: DataFrame, now_ms: int, days: int = 31, tenants: dict[str, int] | None = None) -> DataFrame:
    """What retention keeps: everything not older than ``days``, or than the tenant's own number of days; 0 keeps all."""
    keep = F.lit(days)
    for tenant, own in (tenants or {}).items():
        keep = F.when(F.col("tenant") == tenant, own).otherwise(keep)
    return rows.where((keep == 0) | (F.col("ts_ms") >= F.lit(now_ms) - keep * F.lit(86_400_000)))


def generations(old: DataFrame, new: DataFrame, split_ms: int) -> DataFrame:
    """One table of two generations of storage: what is older than ``split_ms`` from the old one, the rest from the new one."""
    return old.where(F.col("ts_ms") < split_ms).unionByName(new.where(F.col("ts_ms") >= split_ms))


def normalise_samples(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Without negative and zero values and without stacks of no frames; equal stacks are summed."""
    return samples.where((F.col("value") > 0) & (F.size("frames") > 0)).groupBy(*keys, "frames").agg(F.sum("value").alias("value"))


def limit_depth(samples: DataFrame, depth: int) -> DataFrame:
    """At most ``depth`` frames, those nearest the root."""
    return samples.withColumn("frames", F.slice("frames", 1, depth))


def split_by_labels(samples: DataFrame, labels: str = "labels", sample_labels: str = "sample_labels") -> DataFrame:
    """Every distinct set of sample labels becomes a series; labels of the series win."""
    whole = L.canonical(L.merge(F.col(sample_labels), F.col(labels)))
    keyed = samples.withColumn("series", F.to_json(whole))
    return keyed.groupBy("profile_id", "ts_ms", "series", "frames").agg(F.sum("value").alias("value"))


def ingestion_window(rows: DataFrame, now_ms: int, before_ms: int = 3_600_000, after_ms: int = 600_000) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with ``reason``; 0 turns a bound off."""
    old = (F.col("ts_ms") <= now_ms - before_ms) if before_ms else F.lit(False)
    new = (F.col("ts_ms") >= now_ms + after_ms) if after_ms else F.lit(False)
    reason = F.when(F.col("ts_ms").isNull(), "no_timestamp").when(old, "too_far_behind").when(new, "too_far_ahead")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def recording_rule(rows: DataFrame, where, by: list[str]) -> DataFrame:
    """The rule's sum by tenant and labels; tenants without a match have no row."""
    return rows.where(where).groupBy("tenant", *by).agg(F.sum("total").alias("value"))
