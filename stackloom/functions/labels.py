"""Label sets as ``map<string,string>``: projection, algebra, rewriting."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(labels: Column) -> Column:
    """The map with its entries in order of name, so that equal sets are equal values."""
    return F.map_from_entries(F.array_sort(F.map_entries(labels)))


def series_key(labels: Column) -> Column:
    """One string per label set, for grouping."""
    return F.to_json(canonical(labels))


def get(labels: Column, name: str) -> Column:
    """A missing label equals the empty string."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def with_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(*names) if names else F.lit(False))


def without_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(*names)) if names else labels


def _without(labels: Column, name: Column) -> Column:
    return F.map_filter(labels, lambda k, v: k != name)


def drop_private(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.startswith("__"))


def legacy_names_only(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, v: k.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"))


def intersect(a: Column, b: Column) -> Column:
    return F.map_from_entries(F.array_intersect(F.map_entries(a), F.map_entries(b)))


def subtract(a: Column, b: Column) -> Column:
    return F.map_from_entries(F.array_except(F.map_entries(a), F.map_entries(b)))


def merge(low: Column, high: Column) -> Column:
    """The union; on a shared name ``high`` wins."""
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.array_contains(F.map_keys(high), k)), high)


def sanitize_names(labels: Column) -> Column:
    """Dots in names become underscores; of names that meet, the last in order wins."""
    entries = F.array_sort(F.map_entries(labels))
    renamed = F.transform(entries, lambda e: F.struct(F.replace(e["key"], F.lit("."), F.lit("_")).alias("key"), e["value"].alias("value")))
    last = F.filter(renamed, lambda e, i: ~F.exists(F.slice(renamed, i + 2, F.size(renamed)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


#: The rewriting actions there are.
ACTIONS = {"replace", "keep", "drop", "keepequal", "dropequal", "lowercase", "uppercase", "hashmod", "labelmap", "labeldrop", "labelkeep"}


def _matching(labels: Column, regex: str, hit: bool) -> Column:
    return F.map_filter(labels, lambda k, v: k.rlike(regex) == F.lit(hit))


def _renamed(labels: Column, regex: str, to: str) -> Column:
    """Names rewritten in order; of names that meet the last wins."""
    entries = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.struct(expand(e["key"], regex, to).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def _java(regex: str) -> str:
    return regex.replace("(?P<", "(?<")


def expand(value: Column, regex: str, template: str) -> Column:
    """``template`` with ``$1``, ``${1}``, ``$name`` and ``${name}`` replaced by the groups of ``regex`` in ``value``.

    An unknown group is empty, ``$$`` is a dollar sign.
    """
    groups = re.compile(regex.replace("(?<", "(?P<") if "(?P<" not in regex and re.search(r"\(\?<[a-zA-Z]", regex) else regex)
    parts, at = [], 0
    for m in re.finditer(r"\$(?:\$|\{(\w+)\}|(\w+))", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        name = m[1] or m[2]
        if name is None:
            parts.append(F.lit("$"))
            continue
        group = int(name) if name.isdigit() else groups.groupindex.get(name, -1)
        if 0 <= group <= groups.groups:
            parts.append(F.regexp_extract(value, _java(regex), group))
    return F.concat(*parts, F.lit(template[at:]))


def relabel(labels: Column, rules: list[dict]) -> tuple[Column, Column]:
    """Apply rewriting rules in order: the new labels, and whether the row is kept.

    A rule has ``action`` and, where the action uses them, ``source_labels``,
    ``separator`` (";"), ``regex`` ("(.*)", fully anchored), ``target_label``,
    ``replacement`` ("$1") and ``modulus``.
    """
    state = F.struct(labels.alias("labels"), F.lit(True).alias("keep"))
    for rule in rules:
        # a bound variable for what came before: its expression stands in the plan once, not once for each use
        state = F.get(F.transform(F.array(state), _rule(rule)), F.lit(0))
    return state["labels"], state["keep"]


def _rule(rule: dict) -> Callable[[Column], Column]:
    """The rule as a function of ``struct<labels, keep>``."""
    action = rule.get("action", "replace").lower()
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    plain, target = rule.get("regex", "(.*)"), rule.get("target_label", "")
    regex = "(?s)^(?:" + _java(plain) + ")$"

    def run(state: Column) -> Column:
        labels, keep = state["labels"], state["keep"]
        value = F.concat_ws(rule.get("separator", ";"), *[get(labels, n) for n in rule.get("source_labels", [])])
        put = lambda name, new: merge(labels, F.create_map(name, new))
        if action in ("keep", "drop"):
            hit = value.rlike(regex)
            keep = keep & (hit if action == "keep" else ~hit)
        elif action in ("keepequal", "dropequal"):
            same = get(labels, target) == value
            keep = keep & (same if action == "keepequal" else ~same)
        elif action in ("lowercase", "uppercase"):
            labels = put(F.lit(target), F.lower(value) if action == "lowercase" else F.upper(value))
        elif action == "hashmod":
            tail = F.conv(F.right(F.md5(value), F.lit(16)), 16, 10).cast("decimal(20,0)")
            labels = put(F.lit(target), (tail % F.lit(rule["modulus"])).cast("bigint").cast("string"))
        elif action == "replace":
            new, name = expand(value, regex, rule.get("replacement", "$1")), expand(value, regex, target)
            hit = value.rlike(regex) & name.rlike("^[a-zA-Z_][a-zA-Z0-9_.]*$")
            labels = F.when(hit & (new != ""), put(name, new)).when(hit, _without(labels, name)).otherwise(labels)
        elif action == "labelmap":
            labels = merge(labels, _renamed(_matching(labels, regex, True), regex, rule.get("replacement", "$1")))
        else:
            labels = _matching(labels, regex, action == "labelkeep")
        return F.struct(labels.alias("labels"), keep.alias("keep"))

    return run
