"""Structured Streaming: windowed pre-aggregation, deltas of cumulative values, recording rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.maintain import recording_rule


def window_sums(rows: DataFrame, by: list[str], window: str = "15 seconds", late: str = "1 hour") -> DataFrame:
    """Sums per tumbling event-time window and series; ``rows`` has ``ts`` (timestamp) and ``total``.

    State is dropped once the watermark passes; rows later than that should be
    taken out before, with a reason, by ``maintain.ingestion_window``.
    """
    sums = rows.withWatermark("ts", late).groupBy(F.window("ts", window), *by).agg(F.sum("total").alias("value"), F.count("*").alias("n"))
    return sums.select(F.unix_millis("window.start").alias("ts_ms"), *by, "value", "n")


def deltas(rows: DataFrame, key: str) -> DataFrame:
    """``(key, ts_ms, delta)`` of a cumulative ``total`` per key, as rows arrive.

    The first value of a key and any decrease (a reset) emit nothing. Rows of a
    key are taken in order of time within a micro-batch.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        rows = pd.concat(frames).sort_values(["ts_ms", "total"], kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for ts, total in zip(rows.ts_ms, rows.total, strict=True):
            if last is not None and total >= last:
                out.append((k[0], int(ts), int(total - last)))
            last = int(total)
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts_ms", "delta"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "ts_ms", "total").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts_ms long, delta long", "last long", "append", GroupStateTimeout.NoTimeout)


def stack_deltas(rows: DataFrame, key: str, stack: str = "stack_id") -> DataFrame:
    """``(key, ts_ms, stack, delta)`` of a cumulative ``total`` per key and stack, as ``series.delta`` has it with ``stack``.

    The rows of a profile, of one key and time, come in one micro-batch.
    """
    kinds = dict(rows.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else None
        out = []
        for ts, profile in pd.concat(list(batches)).groupby("ts_ms", sort=True):
            now = {s: int(v) for s, v in profile.groupby(stack)["total"].sum().items()}
            if known is None or any(v < known.get(s, v) for s, v in now.items()):
                known = now
                continue
            out += [(k[0], int(ts), s, v - known.get(s, 0)) for s, v in now.items()]
            known |= now
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(out, columns=[key, "ts_ms", stack, "delta"])

    out, kept = f"{key} {kinds[key]}, ts_ms long, {stack} {kinds[stack]}, delta long", f"stacks array<{kinds[stack]}>, highest array<long>"
    return rows.select(key, "ts_ms", stack, "total").groupBy(key).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def record(rows: DataFrame, where, by: list[str], path: str, checkpoint: str):
    """Start a query that evaluates a recording rule on each micro-batch and appends its rows to ``path``.

    A batch writes its own folder, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        recording_rule(batch, where, by).withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
