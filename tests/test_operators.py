"""Inline cases of trees, flame graphs, series, heat maps, formats and upkeep."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from stackloom.functions import labels as L
from stackloom.functions import selector, times
from stackloom.operators import flamegraph, maintain, profiles, series, tree
from stackloom.sources import formats


def samples(spark, text):
    return formats.parse_collapsed(spark.createDataFrame([(x.strip(),) for x in text.split(",")], "value string"))


def shown(nodes, *cols):
    return {";".join(r.path): tuple(r[c] for c in cols or ("self", "total")) for r in nodes.collect()}


def random_stacks(seed, n=60, names="pqrstu", depth=6):
    rng = random.Random(seed)
    return [([rng.choice(names) for _ in range(rng.randint(1, depth))], rng.randint(0, 9)) for _ in range(n)]


def table(spark, stacks):
    return spark.createDataFrame(stacks, "frames array<string>, value long")


def brute_tree(stacks):
    own, total = collections.Counter(), collections.Counter()
    for frames, value in stacks:
        if value > 0:
            own[tuple(frames)] += value
            for i in range(len(frames)):
                total[tuple(frames[: i + 1])] += value
    return {p: (own[p], t) for p, t in total.items()}


def paths(nodes, *cols):
    return {tuple(r.path): tuple(r[c] for c in cols or ("self", "total")) for r in nodes.collect()}


def test_tree_against_brute_force(spark):
    stacks = [*random_stacks(1), ([], 5), (None, 5), (["p"], -3)]
    assert paths(tree.tree(table(spark, stacks))) == brute_tree([x for x in stacks if x[0]])
    assert tree.tree(table(spark, [])).count() == 0


def test_deep_recursive_stacks(spark):
    deep = [(["f", "g"] * 500, 3), (["f"] * 1000, 2), (["f", "g"] * 400, 1)]
    got = paths(tree.tree(table(spark, deep)))
    assert got == brute_tree(deep) and len(got) == 1999
    kept = paths(tree.truncate(tree.tree(table(spark, deep)), 5))
    assert kept[("f",)] == (0, 6) and sum(s for s, _ in kept.values()) == 6


@pytest.mark.parametrize("most", [1, 3, 10, 40])
def test_truncation_against_brute_force(spark, most):
    stacks = random_stacks(most) + [(["p", "other"], 1), (["p", "q", "other"], 2)]
    nodes = brute_tree(stacks)
    by_size = sorted((t for _, t in nodes.values()), reverse=True)
    low = by_size[most - 1] if len(by_size) > most else 0

    def base(path):
        while path and path[-1] == "other":
            path = path[:-1]
        return path

    kept = {p for p, (_, t) in nodes.items() if t >= low or (p[-1] == "other" and (not base(p) or nodes[base(p)][1] >= low))}
    want = collections.defaultdict(lambda: (0, 0))
    want |= {p: nodes[p] for p in kept}
    for p, (_, t) in nodes.items():
        if p not in kept and (len(p) == 1 or p[:-1] in kept):
            at = (*p[:-1], "other")
            want[at] = (want[at][0] + t, want[at][1] + t)
    assert paths(tree.truncate(tree.tree(table(spark, stacks)), most)) == dict(want)


def bars(fg, sides=1):
    """The bars of encoded levels: (depth, name, (start, total, own) of each side)."""
    out, width = set(), 3 * sides + 1
    for depth, level in enumerate(fg["levels"]):
        at = [0] * sides
        for k in range(0, len(level), width):
            bar = []
            for side in range(sides):
                start = at[side] + level[k + 3 * side]
                bar.append((start, *level[k + 3 * side + 1 : k + 3 * side + 3]))
                at[side] = start + level[k + 3 * side + 1]
            out.add((depth, fg["names"][level[k + width - 1]], tuple(bar)))
    return out


def brute_bars(trees):
    """The same from the nodes of each side: children lie after their parent's own value, in order of their names."""
    every = sorted({p for t in trees for p in t})
    at = {(): [0] * len(trees)}
    out = {(0, "total", tuple((0, sum(v[1] for p, v in t.items() if len(p) == 1), 0) for t in trees))}
    for path in every:
        own = [t.get(path, (0, 0)) for t in trees]
        start = at[path[:-1]]
        out.add((len(path), path[-1], tuple((s, v[1], v[0]) for s, v in zip(start, own, strict=True))))
        at[path] = [s + v[0] for s, v in zip(start, own, strict=True)]
        at[path[:-1]] = [s + v[1] for s, v in zip(start, own, strict=True)]
    return out


def test_flame_graph_against_brute_force(spark):
    stacks = random_stacks(7, 40)
    nodes = brute_tree(stacks)
    fg = flamegraph.flame_graph(tree.tree(table(spark, stacks)))
    assert fg["names"][0] == "total" and len(set(fg["names"])) == len(fg["names"])
    got, want = bars(fg), brute_bars([nodes])
    assert {(d, n, b[0][1:]) for d, n, b in got} == {(d, n, b[0][1:]) for d, n, b in want} and len(got) == len(want)
    spans = lambda bs, d: sorted((b[0][0], b[0][0] + b[0][1]) for depth, _, b in bs if depth == d)
    for depth in range(1, len(fg["levels"])):  # bars do not overlap and lie below a bar
        line = spans(got, depth)
        assert all(a[1] <= b[0] for a, b in zip(line, line[1:]))
        assert all(any(s <= a and b <= e for s, e in spans(got, depth - 1)) for a, b in line)
    assert fg["total"] == sum(v for _, v in stacks) and fg["max_self"] == max(s for s, _ in nodes.values())
    back = collections.Counter()
    for frames, value in flamegraph.decode(fg["names"], fg["levels"]):
        back[tuple(frames)] += value
    assert dict(back) == {p: s for p, (s, _) in nodes.items() if s}


def test_diff_against_brute_force(spark):
    left, right = random_stacks(3, 30), random_stacks(4, 30, "qrstuvw")
    a, b = brute_tree(left), brute_tree(right)
    got = paths(tree.diff(tree.tree(table(spark, left)), tree.tree(table(spark, right))), "self_left", "total_left", "self_right", "total_right")
    assert got == {p: (*a.get(p, (0, 0)), *b.get(p, (0, 0))) for p in a.keys() | b.keys()}
    fg = flamegraph.flame_graph_diff(tree.tree(table(spark, left)), tree.tree(table(spark, right)), 4096)
    sizes = lambda bs: sorted((d, n, *[x[1:] for x in v]) for d, n, v in bs)
    assert sizes(bars(fg, 2)) == sizes(brute_bars([a, b])) and fg["total"] == sum(v for _, v in left + right)
    small = tree.diff(tree.tree(table(spark, left)), tree.tree(table(spark, right)), 5)
    top = small.where("depth = 1").agg(F.sum("total_left"), F.sum("total_right")).first()
    assert tuple(top) == (sum(v for _, v in left), sum(v for _, v in right)) and small.count() < len(got)


@pytest.mark.parametrize("site", ["p", "p;q", "q;r;p", "p;p", "x"])
def test_call_sites_against_brute_force(spark, site):
    stacks, want = random_stacks(9, 120, "pqr", 4), site.split(";")
    inside = [(f, v) for f, v in stacks if f[: len(want)] == want]
    expected = (sum(v for f, v in inside if f == want), sum(v for _, v in inside), sum(v for f, v in stacks if f[-1] == want[-1]), sum(v for f, v in stacks if want[-1] in f))
    assert tuple(tree.call_site_values(table(spark, stacks), want).first()) == expected


@pytest.mark.parametrize("step", [7, 10, 33])
def test_series_against_brute_force(spark, step):
    rng, start, end = random.Random(step), 100, 200
    rows = [(rng.randint(80, 220), rng.choice("xyz"), rng.randint(1, 9)) for _ in range(200)]
    rows += [(start - step, "x", 5), (start - step - 1, "x", 5), (start, "x", 1), (end, "y", 2), (end + 1, "y", 2)]
    last, sums = start + (end - start) // step * step, collections.defaultdict(list)
    for ts, k, v in rows:
        if start - step <= ts <= last:
            sums[k, next(e for e in range(start, last + 1, step) if ts <= e)].append(v)
    df = spark.createDataFrame(rows, "ts_ms long, k string, total long")
    assert {(r.k, r.ts): r.value for r in series.series(df, ["k"], start, end, step).collect()} == {k: sum(v) for k, v in sums.items()}
    assert {(r.k, r.ts): r.value for r in series.series(df, ["k"], start, end, step, "avg").collect()} == {k: sum(v) / len(v) for k, v in sums.items()}


def test_grid_times_are_the_next_edge(spark):
    for start, end, step in ((30, 210, 20), (7, 100, 13), (0, 50, 25)):
        edges = [start]
        while edges[-1] < end:
            edges.append(edges[-1] + step)
        got = spark.range(0, 250).select("id", series._grid_time(F.col("id"), start, end, step).alias("ts")).collect()
        assert {r.id: r.ts for r in got} == {i: next((e for e in edges if i <= e), edges[-1]) for i in range(250)}


def test_timeline_fills_every_step(spark):
    points, step = [(12_345, 4), (12_999, 5), (31_000, 6), (60_000, 7)], 5
    got = series.timeline(spark.createDataFrame(points, "ts_ms long, value long"), 11_111, 58_000, step).orderBy("ts").collect()
    sums = collections.Counter()
    for ts, v in points:
        sums[ts // 5000 * 5000] += v
    assert [(r.ts, r.value) for r in got] == [(ts, sums[ts]) for ts in range(10_000, 55_000, 5000)]


def test_auto_steps():
    hour = 3_600_000
    got = [series.auto_step_s(0, ms) for ms in (1000, hour, 7 * 24 * hour, 30 * 24 * hour, 17 * 1500 * 1000, 20 * 1500 * 1000, 700_000 * 1500 * 1000)]
    assert got == [15, 15, 300, 1800, 15, 20, 604_800]


def test_exemplars_sum_rows_and_share_labels(spark):
    rows = [("a", 5, {"x": "1", "y": "1"}, 3), ("a", 5, {"x": "1", "y": "2"}, 4), ("b", 6, {"x": "1"}, 6), (None, 6, {"x": "1"}, 50)]
    got = series.exemplars(spark.createDataFrame(rows, "profile_id string, ts_ms long, labels map<string,string>, total long"), [], 0, 10, 10).first()
    assert (got.value, got.exemplar_id, got.exemplar_value, got.exemplar_labels) == (63, "a", 7, {"x": "1"})


def test_truncation_keeps_the_root_total(spark):
    nodes = tree.tree(samples(spark, "a;b 5, a;c 1, d 1, e;f;g 2"))
    for k in (1, 2, 3):
        assert tree.truncate(nodes, k).where("depth = 1").agg(F.sum("total")).first()[0] == 9


def test_subtract_prunes_below_what_has_not_grown(spark):
    newer, older = tree.tree(samples(spark, "a;b 5, a;c;d 3, e;f 2")), tree.tree(samples(spark, "a;b 1, a;c;x 4, e 2"))
    assert shown(tree.subtract(newer, older)) == {"a": (0, 3), "a;b": (4, 4)}


def test_profile_checks(spark):
    rows = spark.createDataFrame([(["a", "bcd"], 1), ([], 1), (None, 1), (["a"], None), (["a"], -1), (["a", "b", "c"], 2)], "frames array<string>, value long")
    good, bad = profiles.check(rows, max_depth=2, max_name=2)
    assert sorted(map(tuple, good.collect())) == [(["a", "b"], 2), (["a", "cd"], 1)]
    assert sorted(r.reason for r in bad.collect()) == ["negative_value", "no_stack", "no_stack", "no_value"]
    with pytest.raises(ValueError):
        profiles.in_spans(rows, ["12"])
    kinds = spark.createDataFrame([("a:b:c:d:e",), ("a:b:c:d:e:delta",), ("a:b:c:d:e:f",), ("a",), (None,), ("a",)], "profile_type string")
    assert sorted(r.id for r in profiles.profile_types(kinds).collect()) == ["a:b:c:d:e", "a:b:c:d:e:delta"]
    nodes, edges = tree.call_graph(samples(spark, 'a;b"x 3'))
    assert {r.line for r in profiles.dot_lines(nodes, edges).collect()} == {'"a" [flat=0 cum=3]', '"b\\"x" [flat=3 cum=3]', '"a" -> "b\\"x" [weight=3]'}


def test_recursion_counts_once_in_the_top_table(spark):
    got = {r.name: (r.self, r.total) for r in tree.top_table(tree.tree(samples(spark, "f;g;f 3, f 1"))).collect()}
    assert got == {"f": (4, 4), "g": (0, 3)}


def test_selector(spark):
    df = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "xy", "b": "1"}), (3, {})], "id int, labels map<string,string>")
    ids = lambda s: sorted(r.id for r in df.where(selector.select(s, labels=F.col("labels"))).collect())
    assert ids('{a="x"}') == [1]
    assert ids('{a!="x"}') == [2, 3]
    assert ids('{a=~"x.*"}') == [1, 2]
    assert ids('{a=~"x"}') == [1]
    assert ids('{b=""}') == [1, 3]
    assert ids('{a!~"x|xy"}') == [3]
    assert sorted(r.id for r in df.where(selector.usage_group('{b!="2"}', F.col("labels"))).collect()) == [2]
    with pytest.raises(ValueError):
        selector.parse('{a="x"')


def test_labels(spark):
    df = spark.createDataFrame([({"a.b": "1", "__x": "2", "c": "3"},)], "labels map<string,string>")
    one = lambda c: df.select(c).first()[0]
    assert one(L.sanitize_names(F.col("labels"))) == {"a_b": "1", "__x": "2", "c": "3"}
    assert one(L.drop_private(F.col("labels"))) == {"a.b": "1", "c": "3"}
    new, _ = L.relabel(F.col("labels"), [{"action": "labelmap", "regex": "__(.*)"}, {"action": "replace", "source_labels": ["c"], "regex": "(.)", "target_label": "d", "replacement": "v$1"}])
    assert one(new) == {"a.b": "1", "__x": "2", "c": "3", "x": "2", "d": "v3"}


def test_downsample_and_delta(spark):
    rows = [("s", 1703853310000, ["abc"], 30), ("s", 1703853559000, ["abc"], 40), ("s", 1703854209000, ["abc"], 40)]
    got = maintain.downsample(spark.createDataFrame(rows, "k string, ts_ms long, frames array<string>, value long"), ["k"], 300).orderBy("ts_ms").collect()
    assert [r.value for r in got] == [70, 40]
    rows = [("s", 1, 5), ("s", 2, 7), ("s", 3, 1), ("s", 4, 4)]
    got = series.delta(spark.createDataFrame(rows, "k string, ts_ms long, total long"), ["k"]).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.delta) for r in got] == [(2, 2), (4, 3)]


def test_ingestion_window(spark):
    ok, bad = maintain.ingestion_window(spark.createDataFrame([(0,), (5_000_000,), (9_000_000,)], "ts_ms long"), 5_000_000)
    assert [r.ts_ms for r in ok.collect()] == [5_000_000]
    assert {r.ts_ms: r.reason for r in bad.collect()} == {0: "too_far_behind", 9_000_000: "too_far_ahead"}


def test_formats(spark):
    doc = '{"shared":{"frames":[{"name":"a"},{"name":"b"}]},"profiles":[{"type":"sampled","name":"p","unit":"seconds","samples":[[0,1],[0],[0,1]],"weights":[1,2,3]}]}'
    got = formats.parse_speedscope(spark.createDataFrame([(doc,)], "value string")).collect()
    assert {";".join(r.frames): r.value for r in got} == {"a;b": 400, "a": 200}
    doc = doc.replace('"seconds"', '"milliseconds"').replace("[1,2,3]", "[1.5,2,3.9]")
    got = formats.parse_speedscope(spark.createDataFrame([(doc,)], "value string")).collect()
    assert {";".join(r.frames): r.value for r in got} == {"a;b": 400, "a": 200}
    events = [("O", 0, 1), ("O", 1, 4), ("C", 1, 9.5), ("C", 0, 10)]
    listed = ",".join(f'{{"type":"{t}","frame":{f},"at":{at}}}' for t, f, at in events)
    doc = f'{{"shared":{{"frames":[{{"name":"a"}},{{"name":"b"}}]}},"profiles":[{{"type":"evented","name":"p","unit":"seconds","startValue":1,"endValue":10,"events":[{listed}]}}]}}'
    got = formats.parse_speedscope(spark.createDataFrame([(doc,)], "value string")).collect()
    assert {";".join(r.frames): r.value for r in got} == {"a": 3, "a;b": 500}  # 3 whole units to an opening frame, 5 to a closing one, none after 9.5
    perf = "java 123 456.7: cycles:\n\t7f01 leaf+0x1 (/lib/x.so)\n\t7f02 mid (/bin/y)"
    assert formats.parse_perf(spark.createDataFrame([(perf,)], "value string")).first().frames == ["java", "mid", "leaf"]
    kinds = {("x", b"a;b 1\n"): "collapsed", ("x.pb.gz", b"\x1f\x8b"): "pprof", ("x.txt", b"{}"): "collapsed", ("x", b"{}"): "json", ("x", b"\x0a\x04\x08\x01\x10\x02"): "pprof", ("x.pprof", b""): "pprof"}
    assert {k: formats.sniff(*k) for k in kinds} == kinds
    with pytest.raises(ValueError):
        formats.sniff("x", b"a")


def test_times():
    assert times.parse_time("now-12h", 43_200_000) == 0
    assert times.parse_time("19700102", 0) == 86_400_000
    assert times.split_interval(5, 25, 10) == [(5, 9), (10, 19), (20, 25)]
    with pytest.raises(ValueError):
        times.validate_range(5, 1)


def test_streaming_deltas_equal_batch(spark, tmp_path):
    from stackloom.streaming import jobs

    rows = spark.createDataFrame([("s", 1, 5), ("s", 2, 7), ("s", 3, 1), ("t", 4, 4), ("t", 5, 4)], "k string, ts_ms long, total long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.deltas(stream, "k").writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in series.delta(rows, ["k"]).select("k", "ts_ms", "delta").collect()}
    assert {tuple(r) for r in spark.sql("select * from deltas").collect()} == want


def test_deltas_per_stack(spark, tmp_path):
    from stackloom.streaming import jobs

    profiles_ = [{2: 1, 3: 1}, {2: 1, 3: 1}, {3: 6, 5: 1}, {3: 0, 5: 1}, {2: 4, 3: 2}, {5: 3}]
    rows = spark.createDataFrame([(k, ts, s, v) for k in ("a", "b") for ts, p in enumerate(profiles_) for s, v in p.items()], "k string, ts_ms long, stack_id long, total long")
    want = {(k, *x) for k in ("a", "b") for x in [(1, 2, 0), (1, 3, 0), (2, 3, 5), (2, 5, 1), (4, 2, 4), (4, 3, 2), (5, 5, 2)]}
    assert {(r.k, r.ts_ms, r.stack_id, r.delta) for r in series.delta(rows, ["k"], stack="stack_id").collect()} == want
    for part in ("ts_ms < 3", "ts_ms >= 3"):  # the state is carried over
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = jobs.stack_deltas(stream, "k").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_flame_graph_documents(spark):
    import json

    fg = flamegraph.flame_graph(tree.tree(samples(spark, "a;b 2, c 3")))
    doc = json.dumps({"flamebearer": fg, "metadata": {"format": "single"}})
    assert sorted(flamegraph.read_json(doc)) == [(["a", "b"], 2), (["c"], 3)]
    for wrong in ({"names": [], "levels": []}, {"names": ["a"], "levels": [[0, 1, 1]]}, {"names": ["a"], "levels": [[0, 1, 1, 1]]}, {"names": ["a"], "levels": [[0, -1, 1, 0]]}):
        with pytest.raises(ValueError):
            flamegraph.validate(wrong)
    with pytest.raises(ValueError):
        flamegraph.read_json(doc.replace("single", "double"))
    assert times.default_range(0, 5, 7_200_000) == (3_600_000, 7_200_000) and times.default_range(1, 2, 9) == (1, 2)
