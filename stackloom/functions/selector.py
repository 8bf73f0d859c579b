"""Label selectors ``name{a="b", c!="d", e=~"f.*", g!~"h"}`` as column predicates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import get

_MATCHER = re.compile(r'\s*([a-zA-Z_][\w.]*)\s*(=~|!~|!=|=)\s*("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')\s*(,|$)')


def parse(text: str) -> list[tuple[str, str, str]]:
    """(name, operator, value) of each matcher; a leading metric name matches ``__name__``."""
    text = text.strip()
    head, brace, body = text.partition("{")
    found = [("__name__", "=", head.strip())] if head.strip() else []
    if not brace:
        return found
    if not body.endswith("}"):
        raise ValueError(f"unclosed selector: {text}")
    body, at = body[:-1].strip(), 0
    while at < len(body):
        m = _MATCHER.match(body, at)
        if not m:
            raise ValueError(f"bad matcher at {body[at:]!r}")
        found.append((m[1], m[2], re.sub(r"\\(.)", r"\1", m[3][1:-1])))
        at = m.end()
    return found


def _matches_empty(pattern: str) -> bool:
    """Whether the empty string matches, true also where that cannot be told."""
    try:
        return re.fullmatch(pattern, "") is not None
    except re.error:
        return True


def predicate(matchers: list[tuple[str, str, str]], columns: dict[str, Column] | None = None, labels: Column | None = None) -> Column:
    """All matchers hold. Labels with a column of their own use it, so that the filter reaches the scan.

    A missing label equals the empty string. Regular expressions match the whole
    value; plain alternatives become an IN list.
    """
    out = F.lit(True)
    for name, op, value in matchers:
        if columns and name in columns:
            bare = op == "=" and value != "" or op == "=~" and not _matches_empty(value)
            at = columns[name] if bare else F.coalesce(columns[name], F.lit(""))
        else:
            at = get(labels, name)
        if op in ("=", "!="):
            hit = at == value
        elif re.fullmatch(r"[\w\-/ ]+(\|[\w\-/ ]+)*", value):
            hit = at.isin(*value.split("|"))
        else:
            hit = at.rlike(f"(?s)^(?:{value})$")
        out = out & (hit if op in ("=", "=~") else ~hit)
    return out


def select(text: str, columns: dict[str, Column] | None = None, labels: Column | None = None) -> Column:
    return predicate(parse(text), columns, labels)


def usage_group(text: str, labels: Column) -> Column:
    """Like a selector, but a missing label never matches."""
    has: Callable[[str], Column] = lambda n: F.array_contains(F.map_keys(labels), n)
    out = F.lit(True)
    for m in parse(text):
        out = out & has(m[0]) & predicate([m], labels=labels)
    return out
