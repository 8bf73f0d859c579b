"""Rules that profiles pass on their way in: selection of samples, clean-ups of names and labels, sampling.

Profiles are rows with ``labels`` and ``samples array<struct<stack_id, value, span_id, trace_id, ...>>``
or single samples ``(frames, value, sample_labels)``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.selector import usage_group
from ..functions.storage import cut, small

SAMPLED = "__sampled__"
SESSION = "__session_id__"


def exclude_sampled(rows: DataFrame) -> DataFrame:
    """Without profiles of which only totals were kept."""
    return rows.where(L.get(F.col("labels"), SAMPLED) != "true")


def with_ids(rows: DataFrame, ids: list[str], col: str = "profile_id") -> DataFrame:
    """Profiles of the given UUIDs, however they are written; what is no UUID is an error."""
    wanted = sorted({str(uuid.UUID(i)) for i in ids})
    return rows.where(F.lower(col).isin(*wanted) if wanted else F.lit(False))


def in_series(rows: DataFrame, series: DataFrame, key: str = "series_key") -> DataFrame:
    """Profiles of the series whose keys are listed.

    Few keys are broadcast: a shuffle by key would bring all profiles of a series to one task.
    """
    keys = cut(series.select(key).distinct())
    return rows.join(small(keys, keys.count()), key, "left_semi")


def has_pairs(labels: Column, pairs: dict[str, str]) -> Column:
    """Whether all the pairs are in the map."""
    out = F.lit(True)
    for name, value in pairs.items():
        out = out & F.coalesce(F.try_element_at(labels, F.lit(name)) == value, F.lit(False))
    return out


def select_samples(rows: DataFrame, spans: list[str] | None = None, traces: list[str] | None = None) -> DataFrame:
    """Profiles with only the samples of the given spans (16 hex digits) or traces (32), not of both; zero and null match nothing.

    Profiles left without samples go.
    """
    if spans and traces:
        raise ValueError("spans and traces exclude each other")
    if not spans and not traces:
        return rows
    ids, n, col = (spans, 16, "span_id") if spans else (traces, 32, "trace_id")
    for i in ids:
        if not re.fullmatch(f"[0-9a-fA-F]{{{n}}}", i):
            raise ValueError(f"{i!r} is not {n} hex digits")
    wanted = sorted({i.lower() for i in ids} - {"0" * n})
    hit = F.filter("samples", lambda s: F.lower(s[col]).isin(*wanted) if wanted else F.lit(False))
    return rows.withColumn("samples", hit).where(F.size("samples") > 0)


def hex_id(col: Column, digits: int) -> Column:
    """A span or trace id in lower case, null if it is not that many hex digits or is zero."""
    return F.when(col.rlike(f"^[0-9a-fA-F]{{{digits}}}$") & ~col.rlike("^0+$"), F.lower(col))


def extract_ids(samples: DataFrame, labels: str = "sample_labels") -> DataFrame:
    """Adds ``span_id`` and ``trace_id`` from the sample labels of these names, which go."""
    at = lambda name: F.try_element_at(F.col(labels), F.lit(name))
    rest = L.without_labels(F.col(labels), ["span_id", "trace_id"])
    return samples.withColumns({"span_id": hex_id(at("span_id"), 16), "trace_id": hex_id(at("trace_id"), 32)}).withColumn(labels, rest)


def rename_label(labels: Column, old: str, new: str) -> Column:
    """One label under another name; if that one exists already, it stays and the old one goes."""
    value = F.try_element_at(labels, F.lit(old))
    moved = L.merge(F.create_map(F.lit(new), value), L.without_labels(labels, [old]))
    return F.when(value.isNull(), labels).otherwise(moved)


def group_by_labels(samples: DataFrame, keys: list[str], names: list[str] | None = None, labels: str = "sample_labels") -> DataFrame:
    """Samples of equal stack and equal labels summed; with ``names`` only these labels tell groups apart, and only they are kept."""
    own = F.col(labels) if names is None else L.with_labels(F.col(labels), names)
    rows = samples.withColumn(labels, F.array_sort(F.map_entries(own))).groupBy(*keys, labels, "frames").agg(F.sum("value").alias("value"))
    return rows.withColumn(labels, F.map_from_entries(labels))


def split_by(samples: DataFrame, keys: list[str], names: list[str], labels: str = "labels", sample_labels: str = "sample_labels") -> DataFrame:
    """Each set of the chosen sample labels becomes a series, whose own labels win; other sample labels go; equal stacks are summed."""
    whole = L.merge(L.with_labels(F.col(sample_labels), names), F.col(labels))
    rows = samples.withColumn("series", F.array_sort(F.map_entries(whole))).groupBy(*keys, "series", "frames").agg(F.sum("value").alias("value"))
    return rows.withColumn("labels", F.map_from_entries("series")).drop("series")


def sample_series(profiles: DataFrame) -> DataFrame:
    """A row per sample type of ``profiles(name, sample_types array<struct<type, unit>>, period_type, period_unit, labels)``.

    Adds ``pos`` (which value of the samples it is) and the labels ``__type__``, ``__unit__``, ``__period_type__``,
    ``__period_unit__``, ``__profile_type__`` and ``__service_name__``.
    """
    each = profiles.select("*", F.posexplode("sample_types").alias("pos", "t"))
    kind = F.concat_ws(":", "name", "t.type", "t.unit", F.coalesce("period_type", F.lit("")), F.coalesce("period_unit", F.lit("")))
    new = {"__type__": F.col("t.type"), "__unit__": F.col("t.unit"), "__period_type__": F.col("period_type"), "__period_unit__": F.col("period_unit"), "__profile_type__": kind, "__service_name__": L.get(F.col("labels"), "service_name")}
    made = F.map_filter(F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull() & ((v != "") | (k != "__service_name__")))
    return each.withColumn("labels", L.merge(F.col("labels"), made)).drop("t")


def relabel_sample_types(series: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows of :func:`sample_series` whose type and unit the rules keep."""
    _, keep = L.relabel(F.col("labels"), rules)
    return series.where(keep)


def label_problem(labels: Column, max_labels: int = 30, max_name: int = 1024, max_value: int = 2048) -> Column:
    """Why a label set is refused, null if it is not; lengths are in bytes, and the first label in order that is wrong tells."""
    entries = F.array_sort(F.map_entries(labels))
    plain = lambda n: F.replace(n, F.lit("."), F.lit("_"))
    why = F.transform(
        entries,
        lambda e: F.when(F.octet_length(e["key"]) > max_name, "label_name_too_long")
        .when(F.octet_length(e["value"]) > max_value, "label_value_too_long")
        .when(~plain(e["key"]).rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), "labels_invalid")
        .when(F.size(F.filter(entries, lambda o: plain(o["key"]) == plain(e["key"]))) > 1, "duplicate_label_names"),
    )
    return (
        F.when(labels.isNull() | (F.size(labels) == 0), "missing_labels")
        .when(F.size(labels) > max_labels, "max_label_names_per_series")
        .when(L.get(labels, "__name__") == "", "labels_invalid")
        .when(L.get(labels, "service_name") == "", "missing_labels")
        .otherwise(F.get(F.filter(why, lambda w: w.isNotNull()), F.lit(0)))
    )


def limit_sessions(labels: Column, most: int) -> Column:
    """The session id modulo ``most``; an id that is not 16 hex digits goes, and with 0 every one."""
    if not most:
        return L.without_labels(labels, [SESSION])
    own = F.try_element_at(labels, F.lit(SESSION))
    # the low 63 bits suffice where ``most`` divides 2 ** 63; else the high half counts with its remainder
    high, low = F.conv(F.substring(own, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(own, 9, 8), 16, 10).cast("bigint")
    rest = ((high % most) * ((1 << 32) % most) + low) % most
    new = L.merge(labels, F.create_map(F.lit(SESSION), F.lpad(F.lower(F.hex(rest)), 16, "0")))
    return F.when(own.isNull(), labels).when(own.rlike("^[0-9a-fA-F]{16}$"), new).otherwise(L.without_labels(labels, [SESSION]))


def inject_version(build_id: Column, repository: Column, ref: Column, root: Column) -> Column:
    """A mapping's build id as JSON with where its sources are; unchanged if no part is known."""
    known = F.coalesce(repository, ref, root).isNotNull()
    return F.when(known, F.to_json(F.struct(repository.alias("repository"), ref.alias("git_ref"), build_id.alias("build_id"), root.alias("root_path")))).otherwise(build_id)


def expand_group(template: str, labels: Column) -> Column:
    """A usage group's name with each ``${labels.x}`` replaced; null if one of these labels is missing or empty."""
    parts = re.split(r"(\$\{labels\.[^}]*\}?)", template)
    out, ok = [], F.lit(True)
    for part in parts:
        if not part.startswith("${labels."):
            out.append(F.lit(part))
            continue
        name = part[9:-1]
        if not part.endswith("}") or not name:
            raise ValueError(f"bad placeholder in {template!r}")
        ok = ok & (L.get(labels, name) != "")
        out.append(L.get(labels, name))
    return F.when(ok, F.concat(*out))


def sampling(labels: Column, groups: dict[str, str], shares: dict[str, float]) -> Column:
    """``(usage_group, share)`` that decides whether a profile is kept, null if no group with a share matches.

    ``groups`` are names (or templates) and their selectors, ``shares`` the shares to keep by resolved or configured
    name. A plain name beats a template; else the lowest share decides, and of equal ones the later group.
    """
    found = []
    for i, (name, selector) in enumerate(groups.items()):
        resolved = expand_group(name, labels)
        share = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))]), resolved), F.lit(shares.get(name)).cast("double"))
        template = F.lit(int("${labels." in name))
        one = F.struct(template.alias("template"), share.alias("share"), F.lit(-i).alias("order"), resolved.alias("usage_group"))
        found.append(F.when(usage_group(selector, labels) & resolved.isNotNull() & share.isNotNull(), one))
    best = F.get(F.array_sort(F.filter(F.array(*found), lambda g: g.isNotNull())), F.lit(0))
    return F.struct(best["usage_group"].alias("usage_group"), best["share"].alias("share"))


def sample_profiles(rows: DataFrame, groups: dict[str, str], shares: dict[str, float], key: str = "profile_id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Kept profiles, and those sampled out. A hash of the key decides, so a profile that is read again falls alike."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    marked = rows.withColumn("_by", sampling(F.col("labels"), groups, shares)).withColumn("_keep", F.col("_by.share").isNull() | (draw <= F.col("_by.share")))
    return marked.where("_keep").drop("_by", "_keep"), marked.where(~F.col("_keep")).drop("_by", "_keep")


#: Languages in order, and what their symbols or files start or end with.
LANGUAGES = [
    ("go", (".go", "/usr/local/go/")),
    ("java", ("java/", "sun/")),
    ("ruby", (".rb", "gems/")),
    ("nodejs", ("./node_modules/", ".js")),
    ("dotnet", ("System.", "Microsoft.")),
    ("python", (".py",)),
    ("rust", ("main.rs", "core.rs")),
]


def language(symbols: Column) -> Column:
    """The language of the first symbol that tells one, else ``unknown``."""

    def told(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, marks in reversed(LANGUAGES):
            hit = F.lit(False)
            for m in marks:
                hit = hit | s.startswith(m) | s.endswith(m)
            out = F.when(hit, name).otherwise(out)
        return out

    return F.coalesce(F.get(F.filter(F.transform(symbols, told), lambda x: x.isNotNull()), F.lit(0)), F.lit("unknown"))


def script_names(frames: Column, absolute_stay: bool = False) -> Column:
    """Frames ``struct<name, filename>`` of scripting languages as ``<file> <function>``; files with an absolute path may stay out."""
    named = lambda f: F.concat_ws(" ", f["filename"], f["name"])
    return F.transform(frames, lambda f: F.when(f["filename"].startswith("/"), f["name"]).otherwise(named(f)) if absolute_stay else named(f))


def plain_sample_type(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def clear_address(address: Column, has_functions: Column) -> Column:
    """0 where the mapping has its functions' names."""
    return F.when(has_functions, F.lit(0)).otherwise(address)


def sanitise(samples: DataFrame, locations: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of profiles without dangling references: ``samples(…, location_ids)``, ``locations(location_id, function_ids)``, ``functions(function_id)``.

    Locations lose functions that do not exist, samples with a location that does not exist go, and so do
    functions and locations that nothing refers to. Ids of 0 refer to nothing; of repeated ids the rows are taken as one.
    """
    known = functions.where("function_id <> 0").dropDuplicates(["function_id"])
    lines = locations.where("location_id <> 0").dropDuplicates(["location_id"]).select("location_id", F.posexplode_outer("function_ids").alias("at", "function_id"))
    held = lines.join(known.select("function_id", F.lit(True).alias("known")), "function_id", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("at", "function_id"))))
    whole = held.groupBy("location_id").agg(kept.alias("f")).select("location_id", F.col("f.function_id").alias("function_ids"))
    tagged = samples.withColumn("_row", F.monotonically_increasing_id())
    uses = tagged.select("_row", F.explode("location_ids").alias("location_id"))
    dangling = uses.join(whole, "location_id", "left_anti").select("_row").distinct()
    good = tagged.join(dangling, "_row", "left_anti").drop("_row")
    used = whole.join(good.select(F.explode("location_ids").alias("location_id")).distinct(), "location_id", "left_semi")
    return good, used, known.join(used.select(F.explode("function_ids").alias("function_id")).distinct(), "function_id", "left_semi")


_SHAPE = "[go.shape."


def _without_shapes(name: str) -> str:
    at = name.find(_SHAPE)
    while at >= 0:
        depth, end = 0, at
        for end in range(at, len(name)):
            depth += {"[": 1, "]": -1}.get(name[end], 0)
            if not depth:
                break
        if depth:
            break
        name = name[:at] + name[end + 1 :]
        at = name.find(_SHAPE, at)
    return name


def _plain_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(plain=batch["name"].map(_without_shapes))


def drop_go_type_parameters(samples: DataFrame) -> DataFrame:
    """Stacks whose frames have lost the brackets of shaped type parameters, equal ones summed.

    Brackets nest, so no regular expression does; each distinct frame is rewritten once, in Python.
    """
    names = samples.select(F.explode("frames").alias("name")).where(F.col("name").contains(_SHAPE)).distinct()
    new = names.mapInPandas(_plain_names, "name string, plain string")
    rows = samples.groupBy("frames").agg(F.sum("value").alias("value"))
    has = F.exists("frames", lambda f: f.contains(_SHAPE))
    keyed = rows.where(has).withColumn("_s", F.xxhash64("frames")).withColumn("_t", F.xxhash64(F.lit(1), "frames"))
    parts = keyed.select("_s", "_t", "value", F.posexplode("frames").alias("at", "name")).join(new, "name", "left")
    back = parts.groupBy("_s", "_t").agg(F.first("value").alias("value"), F.array_sort(F.collect_list(F.struct("at", F.coalesce("plain", "name").alias("name")))).alias("f"))
    whole = rows.where(~has).unionByName(back.select(F.col("f.name").alias("frames"), "value"))
    return whole.groupBy("frames").agg(F.sum("value").alias("value"))
