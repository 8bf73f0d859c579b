"""Times, steps and intervals; everything is integer milliseconds."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "sec": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "M": 2_592_000_000, "mon": 2_592_000_000, "y": 31_536_000_000}


def parse_time(text: str, now_ms: int) -> int:
    """``now``, ``now-12h``, seconds, milliseconds or ``YYYYMMDD`` as epoch milliseconds."""
    text = text.strip()
    if m := re.fullmatch(r"(?:now)?(?:([+-])(\d+)\s*([a-zA-Z]+))?", text):
        if not m[1]:
            return now_ms
        if m[3] not in _UNITS:
            raise ValueError(f"unknown unit {m[3]!r}")
        return now_ms + (1 if m[1] == "+" else -1) * int(m[2]) * _UNITS[m[3]]
    if re.fullmatch(r"\d{8}", text):
        return int(datetime.strptime(text, "%Y%m%d").replace(tzinfo=UTC).timestamp() * 1000)
    if text.isdigit():
        return int(text) * (1000 if len(text) <= 10 else 1)
    raise ValueError(f"bad time {text!r}")


def default_range(start_ms: int, end_ms: int, now_ms: int) -> tuple[int, int]:
    """The range as it is, or the last hour if an end is missing or it ends before it starts."""
    return (start_ms, end_ms) if start_ms and end_ms and start_ms <= end_ms else (now_ms - 3_600_000, now_ms)


def validate_range(start_ms: int, end_ms: int, max_length_ms: int | None = None) -> tuple[int, int]:
    if not start_ms or not end_ms:
        raise ValueError("a time range needs both ends")
    if start_ms > end_ms:
        raise ValueError("the range ends before it starts")
    if max_length_ms and end_ms - start_ms > max_length_ms:
        raise ValueError("the range is too long")
    return start_ms, end_ms


def bucket(ts: Column, start: int, step: int) -> Column:
    """The right edge of the step that holds ``ts``; what lies before ``start`` goes to ``start``."""
    steps = F.ceil((ts - F.lit(start)) / F.lit(step)).cast("bigint")
    return F.lit(start) + F.greatest(steps, F.lit(0)) * F.lit(step)


def split_interval(start_ms: int, end_ms: int, interval_ms: int) -> list[tuple[int, int]]:
    """The range cut at multiples of the interval; pieces do not overlap, ends are inclusive."""
    out, at = [], start_ms
    while at <= end_ms:
        stop = min((at // interval_ms + 1) * interval_ms - 1, end_ms)
        out.append((at, stop))
        at = stop + 1
    return out
