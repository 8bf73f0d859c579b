"""Rules on the way in, stored tables, pprof files and units, on small cases."""

import collections
import gzip
import re

import pytest
from pyspark.sql import functions as F

from stackloom.functions import labels as L
from stackloom.functions import selector, storage, units
from stackloom.operators import ingest, series, tree
from stackloom.plans import stored
from stackloom.sources import canonical, pprof, tables
from stackloom.sources.tables import order_samples

DATA = "/root/testdata/sf0.001"


def test_selectors_take_null_columns_as_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, u string")
    ids = lambda s: [r.id for r in df.where(selector.select(s, {"u": F.col("u")}, F.create_map())).orderBy("id").collect()]
    assert ids('{u=~".*"}') == ids('{u=~"a|"}') == ids('{u=~"(a)?"}') == [1, 2, 3]
    assert ids('{u=""}') == ids('{u!="a"}') == ids('{u!~"a.*"}') == [2, 3]
    assert ids('{u="a"}') == ids('{u=~"a.*"}') == ids('{u=~".+"}') == [1]


def test_relabel_templates(spark):
    row = spark.createDataFrame([({"u1": "x", "v1": "y", "k": "p-q"},)], "l map<string,string>")
    one = lambda *rules: row.select(L.relabel(F.col("l"), list(rules))[0]).first()[0]
    assert one({"action": "labelmap", "regex": "[uv](.)", "replacement": "n${1}"}) == {"u1": "x", "v1": "y", "k": "p-q", "n1": "y"}
    assert one({"source_labels": ["k"], "regex": "(?P<a>\\w)-(\\w)", "target_label": "t_$a", "replacement": "${2}${a}$$$3"})["t_p"] == "qp$"
    assert "k" not in one({"source_labels": ["u1"], "replacement": "", "target_label": "k"})
    assert one({"source_labels": ["k"], "target_label": "$1", "replacement": "z"}) == {"u1": "x", "v1": "y", "k": "p-q"}  # "p-q" is no name
    with pytest.raises(ValueError):
        one({"action": "unknown"})


def test_selected_samples(spark):
    s = lambda i, span, trace: (i, 1, span, trace)
    a, t = "00000000000000aB", "0" * 30 + "0C"
    rows = spark.createDataFrame([("p", [s(1, a.lower(), None), s(2, None, t.lower())]), ("q", [s(3, "0" * 16, "0" * 32)])], "profile_id string, samples array<struct<stack_id:long,value:long,span_id:string,trace_id:string>>")
    ids = lambda df: [(r.profile_id, [x.stack_id for x in r.samples]) for r in df.collect()]
    assert ids(ingest.select_samples(rows, spans=[a, "0" * 16])) == [("p", [1])]
    assert ids(ingest.select_samples(rows, traces=[t])) == [("p", [2])]
    assert ids(ingest.select_samples(rows, spans=["0" * 16])) == [] and ingest.select_samples(rows).count() == 2
    for wrong in ({"spans": ["ab"]}, {"traces": [a]}, {"spans": [a], "traces": [t]}):
        with pytest.raises(ValueError):
            ingest.select_samples(rows, **wrong)
    u = "12345678-1234-1234-1234-1234567890AB"
    named = spark.createDataFrame([(u.lower(),), ("x",), (None,)], "profile_id string")
    assert ingest.with_ids(named, [u]).count() == 1 and ingest.with_ids(named, []).count() == 0
    with pytest.raises(ValueError):
        ingest.with_ids(named, ["x"])
    kept = spark.createDataFrame([({"__sampled__": "true"},), ({},), ({"__sampled__": "no"},)], "labels map<string,string>")
    assert ingest.exclude_sampled(kept).count() == 2


def test_sample_labels(spark):
    rows = spark.createDataFrame([(["a"], 1, {"span_id": "00000000000000AB", "trace_id": "zz", "k": "1"}), (["a"], 2, {"k": "1"}), (["a"], 4, {"k": "2", "j": "x"})], "frames array<string>, value long, sample_labels map<string,string>")
    first = ingest.extract_ids(rows).first()
    assert (first.span_id, first.trace_id, first.sample_labels) == ("00000000000000ab", None, {"k": "1"})
    assert sorted((r.value, r.sample_labels) for r in ingest.group_by_labels(rows, [], ["k"]).collect()) == [(3, {"k": "1"}), (4, {"k": "2"})]
    split = ingest.split_by(rows.withColumn("labels", F.create_map(F.lit("j"), F.lit("own"))), [], ["j", "k"])
    assert sorted((r.value, sorted(r.labels.items())) for r in split.collect()) == [(3, [("j", "own"), ("k", "1")]), (4, [("j", "own"), ("k", "2")])]
    one = lambda c: rows.limit(1).select(c).first()[0]
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(ingest.rename_label(m, "a", "c")) == {"c": "1", "b": "2"} and one(ingest.rename_label(m, "a", "b")) == {"b": "2"} and one(ingest.rename_label(m, "x", "y")) == {"a": "1", "b": "2"}


def test_names(spark):
    cases = {"f[go.shape.int]": "f", "a[go.shape.struct{x []int}].b[go.shape.x]": "a.b", "f[go.shape.int": "f[go.shape.int", "m[int].f": "m[int].f", "x[go.shape.a[b]].y[go.shape.": "x.y[go.shape."}
    assert {k: ingest._without_shapes(k) for k in cases} == cases
    got = ingest.drop_go_type_parameters(spark.createDataFrame([(["r", "f[go.shape.int]"], 1), (["r", "f"], 2), (["g[go.shape.x]", "r"], 4)], "frames array<string>, value long"))
    assert {tuple(r.frames): r.value for r in got.collect()} == {("r", "f"): 3, ("g", "r"): 4}
    files = spark.createDataFrame([([("f", "x.rb"), ("g", "/y.rb")],)], "f array<struct<name:string,filename:string>>")
    assert files.select(ingest.script_names(F.col("f"))).first()[0] == ["x.rb f", "/y.rb g"]
    assert files.select(ingest.script_names(F.col("f"), absolute_stay=True)).first()[0] == ["x.rb f", "g"]


def test_dangling_references_go(spark):
    samples = spark.createDataFrame([([1, 2], 1), ([1, 9], 2), ([3], 3)], "location_ids array<long>, value long")
    locations = spark.createDataFrame([(1, [5, 7]), (2, []), (3, [5]), (4, [6]), (0, [5])], "location_id long, function_ids array<long>")
    functions = spark.createDataFrame([(5, "f"), (6, "g"), (0, "z")], "function_id long, name string")
    s, loc, f = ingest.sanitise(samples, locations, functions)
    assert sorted(r.value for r in s.collect()) == [1, 3]
    assert {r.location_id: r.function_ids for r in loc.collect()} == {1: [5], 2: [], 3: [5]} and [r.name for r in f.collect()] == ["f"]


def test_sampling_keeps_alike(spark):
    rows = spark.range(4000).select(F.col("id").alias("profile_id"), F.create_map(F.lit("s"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("labels"))
    kept, gone = ingest.sample_profiles(rows, {"e": '{s="even"}'}, {"e": 0.25})
    assert kept.where("labels['s'] = 'odd'").count() == 2000 and 400 < kept.where("labels['s'] = 'even'").count() < 600
    assert kept.count() + gone.count() == 4000
    with pytest.raises(ValueError):
        ingest.expand_group("a${labels.", F.col("labels"))


def test_stored_tables_round_trip(spark, tmp_path):
    rows = [(1, 5, {"k": "a"}, ["r", "f", "f"], 2), (1, 5, {"k": "a"}, ["r"], 3), (2, 6, {"k": "b"}, ["r", "f", "f"], 4), (3, 7, {}, None, 1), (4, 8, {}, [], 1)]
    s = spark.createDataFrame(rows, "profile_id long, ts_ms long, labels map<string,string>, frames array<string>, value long").withColumns({c: F.lit(None).cast("string") for c in ("span_id", "trace_id")})
    canonical.write(canonical.from_samples(s), str(tmp_path))
    tables = canonical.read(spark, str(tmp_path))
    got = {tuple(r.frames): r.value for r in canonical.resolve(tables.profiles, tables).collect()}
    assert got == {("r", "f", "f"): 6, ("r",): 3} and tables.profiles.count() == 2
    line = spark.createDataFrame([(0, 1, 255, "lib", []), (0, 2, 0, "", [(8, 1), (9, 2)]), (0, 3, 16, "", None)], "partition long, location_id long, address long, mapping string, lines array<struct<function_id:long,line:int>>")
    names = spark.createDataFrame([(0, 8, "inner"), (0, 9, "outer"), (1, 8, "elsewhere")], "partition long, function_id long, name string")
    stacks = spark.createDataFrame([(0, 1, [2, 1]), (0, 2, [3, 77])], "partition long, stack_id long, location_ids array<long>")
    found = canonical.stacks(canonical.Tables(tables.profiles, stacks, line, names))
    assert {r.stack_id: r.frames for r in found.collect()} == {1: ["lib!0xff", "outer", "inner"], 2: ["?", "0x10"]}


def test_pprof_files(spark, tmp_path):
    head = {"sample_types": [{"type": "cpu", "unit": "ns"}], "period_type": "cpu", "period_unit": "ns", "period": 10, "time_nanos": 5, "duration_nanos": 7}
    rows = [{**head, "frames": ["r", "f"], "values": [-3], "labels": {"k": "v"}}, {**head, "frames": ["r", "f"], "values": [4], "labels": {}}, {**head, "frames": [], "values": [0], "labels": {}}]
    data = pprof.encode(rows)
    got = pprof.decode(data)
    assert [(r[6], r[7], r[8]) for r in got] == [(r["frames"], r["values"], r["labels"]) for r in rows]
    assert got[0][:6] == ([{"type": "cpu", "unit": "ns"}], "cpu", "ns", 10, 5, 7) and pprof.decode(gzip.decompress(data)) == got
    with pytest.raises(ValueError):
        pprof.decode(data, most=20)
    with pytest.raises(ValueError):
        pprof.decode(gzip.decompress(data)[:-3])
    # a location with two lines, one without, values not packed
    part, number = pprof._part, pprof._number
    raw = b"".join(part(6, t) for t in (b"", b"cpu", b"ns", b"outer", b"inner")) + part(1, part(1, 1) + part(2, 2))
    raw += part(4, part(1, 1) + part(4, part(1, 2)) + part(4, part(1, 1))) + part(4, part(1, 2) + part(3, 171)) + part(5, part(1, 1) + part(2, 3)) + part(5, part(1, 2) + part(2, 4))
    raw += part(2, number(8) + number(1) + number(8) + number(2) + number(16) + number(9))
    assert [(r[6], r[7]) for r in pprof.decode(raw)] == [(["0xab", "outer", "inner"], [9])]
    for i in range(2):
        (tmp_path / f"{i}.pb.gz").write_bytes(data)
    merged = pprof.merge(pprof.read(spark, str(tmp_path))).collect()
    assert {(tuple(r.frames), tuple(sorted(r.labels.items())), tuple(r["values"])) for r in merged} == {(("r", "f"), (("k", "v"),), (-6,)), (("r", "f"), (), (8,))}
    assert {(r.time_nanos, r.duration_nanos, r.period) for r in merged} == {(5, 14, 10)}
    (tmp_path / "2.pb.gz").write_bytes(pprof.encode([{**rows[0], "period_unit": "count"}]))
    with pytest.raises(Exception, match="other types"):
        pprof.merge(pprof.read(spark, str(tmp_path))).collect()


def test_addresses_in_nested_ranges(spark):
    symbols = spark.createDataFrame([("b", 0, 100, "f", 0), ("b", 10, 30, "g", 1), ("b", 10, 20, "h", 2), ("b", 100, 10, "k", 0), ("b", 5, 0, "empty", 0)], "binary string, va long, len long, name string, depth int")
    asked = spark.createDataFrame([("b", a) for a in (15, 35, 50, 105, 200, 15)] + [("c", 15)], "binary string, address long")
    for page in (16, 4096):
        got = {(r.binary, r.address): r.names for r in tree.resolve_addresses(asked, symbols, page).collect()}
        assert got == {("b", 15): ["h", "g", "f"], ("b", 35): ["g", "f"], ("b", 50): ["f"], ("b", 105): ["k"], ("b", 200): ["b!0xc8"], ("c", 15): ["c!0xf"]}
    assert tree.check_unresolved(asked, 6).count() == 6
    with pytest.raises(ValueError):
        tree.check_unresolved(asked, 5)


def test_units(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lab = lambda v, u, t="auto": one(units.label(F.lit(v), u, t))
    assert [lab(0, "bytes"), lab(2048, "bytes"), lab(1536, "kb"), lab(-1500, "ms"), lab(90, "minutes"), lab(7, "count"), lab(3, "s", "ms")] == ["0", "2kB", "1.50MB", "-1.50s", "90", "7", "3000ms"]
    assert one(units.percentage(F.lit(1), F.lit(8))) == "12.50%" and one(units.percentage(F.lit(9996), F.lit(10000))) == "100%" and one(units.percentage(F.lit(1), F.lit(0))) == "0.0000%"
    assert one(units.mapping_name(F.lit("/usr/lib/libc.so.6"))) == "libc.so.6"


def test_deltas_of_the_table_against_brute_force(spark):
    import __spark_entry__ as entry

    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_type", (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86_400_000) * 86_400_000).alias("day"), (F.col("user_id") % 7).cast("string").alias("u"), F.floor(F.col("value") * 100).alias("v")).collect()
    cumulative = collections.defaultdict(lambda: collections.defaultdict(dict))
    for r in rows:
        at = cumulative[r.event_type][r.day]
        at[r.u] = max(at.get(r.u, r.v), r.v)
    want = set()
    for key, profile in cumulative.items():
        known = None
        for day in sorted(profile):
            now = profile[day]
            if known is None or any(v < known.get(s, v) for s, v in now.items()):
                known = dict(now)
                continue
            want |= {(key, day, s, v - known.get(s, 0)) for s, v in now.items()}
            known |= now
    got = {(r.service_name, r.ts_ms, r.user, r.delta) for r in entry.queries()["delta_by_stack"](spark, DATA).collect()}
    assert got == want and len(want) > 50


def test_heatmap_of_nothing(spark):
    none = spark.createDataFrame([], "k string, ts_ms long, total long, profile_id string")
    assert series.heatmap_slots(none, ["k"], 0, 10, 5).count() == 0


def test_listed_series_are_broadcast_and_stacks_computed_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "series_key string, v int")
        hit = ingest.in_series(rows, rows.where("v <> 3"))
        plan = hit._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.v for r in hit.collect()) == [1, 2]
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tables = canonical.from_orders(spark, DATA)
    for table in tables[1:]:
        assert "lineitem" not in table._jdf.queryExecution().optimizedPlan().toString() and "parquet" not in table._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_deal_samples_by_their_count(spark, monkeypatch):
    parts = storage.deal(spark.range(1000).withColumn("v", F.lit(1)), "id", 100).groupBy("id").agg(F.collect_list("v")).rdd.glom().map(len).collect()
    assert len(parts) == 10 and sum(parts) == 1000 and max(parts) < 200
    seen = []
    monkeypatch.setattr(canonical, "cut", lambda df: seen.append(df) or storage.cut(df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tables = canonical.from_orders(spark, DATA)
        assert tables.profiles.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
        orders = spark.read.parquet(f"{DATA}/lineitem.parquet").agg(F.countDistinct("l_orderkey"), F.count("*")).first()
        assert tables.profiles.agg(F.count("*"), F.sum(F.size("samples"))).first() == orders
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    kind, keys = re.findall(r"(\w+Aggregate)\(keys?=\[([^\]]*)\]", seen[0]._jdf.queryExecution().sparkPlan().toString())[-1]
    assert kind == "HashAggregate" and "frames" in keys


def test_traces_read_profiles_that_several_tasks_wrote(spark, monkeypatch):
    made, plain = [], stored._tables
    monkeypatch.setattr(stored, "_tables", lambda *a: made.append(plain(*a)) or made[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = stored.tree_traces(spark, DATA)
        files = made[0].profiles.inputFiles()
        assert len(files) == spark.sparkContext.defaultParallelism > 1
        hit = order_samples(spark, DATA).where("value in (10, 25)")  # the two traces
        assert found.agg(F.sum("self")).first() == hit.agg(F.sum("value")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_orders_meet_customers_in_tasks_of_bounded_rows(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        # one key has nearly all rows, one has no partner, one is null
        left = spark.range(2000).select(F.when(F.col("id") < 1800, 7).when(F.col("id") < 1990, F.col("id")).cast("long").alias("k"), "id")
        right = spark.range(1990).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")).where("k != 1801")
        found = storage.deal_join(left, right, "k", "id", 100)
        assert found.columns == ["k", "id", "name"]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "name").collect()))
        each = found.rdd.glom().map(len).collect()
        assert len(each) == 20 and sum(each) == 1989 and max(each) < 600
        # with the joins of the stored tables
        seen, plain = [], tables.deal_join
        monkeypatch.setattr(tables, "deal_join", lambda *a: seen.append(plain(*a, rows=100)) or seen[-1])
        rows = tables.order_samples(spark, DATA, dealt=True)
        tasks = -(-spark.read.parquet(f"{DATA}/orders.parquet").count() // 100)
        assert seen[0].rdd.getNumPartitions() == tasks > 1
        assert sorted(map(str, rows.collect())) == sorted(map(str, tables.order_samples(spark, DATA).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
