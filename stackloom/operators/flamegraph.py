"""Flame graphs: level encoding of trees that are already truncated (driver side, bounded by max_nodes)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .tree import diff, truncate

DEFAULT_NODES, MOST_NODES = 8192, 1 << 20


def check_nodes(max_nodes: int | None) -> int:
    n = DEFAULT_NODES if not max_nodes else max_nodes
    if n > MOST_NODES:
        raise ValueError(f"max_nodes {n} is over {MOST_NODES}")
    return n


def _encode(values: dict[tuple, tuple[list[int], list[int]]]) -> dict:
    """``values``: path to (selves, totals), one entry per side."""
    sides = len(next(iter(values.values()))[0]) if values else 1
    below: dict[tuple, list[tuple]] = {}
    for path in sorted(values):
        below.setdefault(path[:-1], []).append(path)
    root = ([0] * sides, [sum(values[p][1][k] for p in below.get((), [])) for k in range(sides)])
    names, places, found = [], {}, []
    stack = [((), [0] * sides)]
    while stack:
        path, x = stack.pop()
        own, total = values.get(path, root)
        name = path[-1] if path else "total"
        if name not in places:
            places[name] = len(names)
            names.append(name)
        found.append((len(path), x, total, own, places[name]))
        at = [a + s for a, s in zip(x, own, strict=True)]
        for child in below.get(path, []):
            stack.append((child, list(at)))
            at = [a + t for a, t in zip(at, values[child][1], strict=True)]
    levels: list[list[int]] = []
    ends: list[list[int]] = []
    for depth, x, total, own, name in sorted(found, key=lambda r: (r[0], r[1], r[4])):
        while len(levels) <= depth:
            levels.append([])
            ends.append([0] * sides)
        for k in range(sides):
            levels[depth] += [x[k] - ends[depth][k], total[k], own[k]]
            ends[depth][k] = x[k] + total[k]
        levels[depth].append(name)
    return {"names": names, "levels": levels, "total": sum(root[1]), "max_self": max((max(r[3]) for r in found), default=0)}


def flame_graph(nodes: DataFrame, max_nodes: int | None = None) -> dict:
    """Names and delta-coded levels of a tree: offset, total, own value and name of each bar, left to right."""
    rows = truncate(nodes, check_nodes(max_nodes)).collect()
    return _encode({tuple(r.path): ([r["self"]], [r.total]) for r in rows})


def flame_graph_diff(left: DataFrame, right: DataFrame, max_nodes: int | None = None) -> dict:
    """Like ``flame_graph`` with offset, total and own value of both sides; negative values are refused."""
    rows = diff(left, right, check_nodes(max_nodes)).collect()
    if any(min(r.self_left, r.self_right) < 0 for r in rows):
        raise ValueError("a profile to compare has negative values")
    return _encode({tuple(r.path): ([r.self_left, r.self_right], [r.total_left, r.total_right]) for r in rows})


def decode(names: list[str], levels: list[list[int]]) -> list[tuple[list[str], int]]:
    """(frames, own value) of each bar of a one-sided flame graph that has one."""
    out, above = [], []
    for depth, level in enumerate(levels):
        bars, x, at = [], 0, 0
        for k in range(0, len(level), 4):
            x += level[k]
            while at < len(above) and above[at][1] <= x:  # bars of both levels lie in order
                at += 1
            path = above[at][2] if at < len(above) and above[at][0] <= x else []
            bars.append((x, x + level[k + 1], [*path, names[level[k + 3]]] if depth else []))
            if level[k + 2] and depth:
                out.append((bars[-1][2], level[k + 2]))
            x += level[k + 1]
        above = bars
    return out


def validate(fg: dict, sides: int = 1) -> None:
    """Raise unless every level is made of whole bars, names exist and values are not negative."""
    width = 3 * sides + 1
    if not fg["names"]:
        raise ValueError("a flame graph has names")
    for level in fg["levels"]:
        if len(level) % width:
            raise ValueError(f"a level is not made of bars of {width} numbers")
        for k in range(0, len(level), width):
            if not 0 <= level[k + width - 1] < len(fg["names"]):
                raise ValueError("a bar has no name")
            if min(level[k : k + width - 1]) < 0:
                raise ValueError("a bar has a negative number")


def read_json(text: str) -> list[tuple[list[str], int]]:
    """(frames, own value) of a one-sided flame graph's JSON document, ``{"flamebearer": {"names", "levels"}, "metadata": {"format"}}``."""
    doc = json.loads(text)
    if doc.get("metadata", {}).get("format", "single") != "single":
        raise ValueError("only one-sided flame graphs hold one profile")
    validate(doc["flamebearer"])
    return decode(doc["flamebearer"]["names"], doc["flamebearer"]["levels"])
