"""Each operator against brute force on small fixtures, with nulls, empty texts and tables, repeats and ties."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stackloom.llm import ann, bpe, chat, components, decontam, langid, linededup, quality, registry, simhash, substring, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, fp string, words int"
BLANK = " \t\n\x0b\x0c\r"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choice(vocab, n)) for n in (3, 30, 50, 80, 120, 200)]
    passage = " ".join(rng.choice(vocab, 45))
    near = base[4].split()
    near[60] = "changed"
    mixed = [base[2] + " " + passage + " end", "start " + passage + "\n" + base[3], passage + " x " + passage]
    return [*base, *mixed, " ".join(near), base[1], base[1], None, "", " \t ", "ÀÉ ÜÖ x", base[5].upper(), "a\n" * 3, "one two"]


def test_simhash_matches_brute_force(spark, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}

    def fingerprint(t):
        words = [w for w in re.split(f"[{BLANK}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    comp = list(range(len(texts)))
    for _ in comp:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert [got[i].component_id for i in range(len(texts))] == comp


def test_bit_slices_find_every_link():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    fps[200:250] = fps[0] ^ np.uint64(0b11110000)
    for radius in (1, 4, 12):
        a, b = simhash.near_in_groups(fps, np.full(300, 300), radius)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        assert near[a, b].all()
        want = simhash.forest(300, *np.nonzero(np.triu(near, 1)), np.zeros(int(np.triu(near, 1).sum())))
        assert len(a) == len(want)  # a forest of as many links joins the same components


def test_near_copies_are_verified(spark, texts):
    found = simhash.near_duplicates(docs(spark, texts), shingle=5, radius=12, min_similarity=0.8)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got[9] == 4 and got[10] == got[11] == 1 and got[16] == 5 and got[0] == 0
    found = simhash.near_duplicates(docs(spark, texts), shingle=5, radius=12, min_similarity=0.8, tables=3)
    assert {r.doc_id: r.component_id for r in found.collect()} == got
    twice = docs(spark, ["a b c d e f", "a b c d e f", "x y"], [7, 7, 8])
    assert sorted(r.doc_id for r in simhash.keep_one(twice, simhash.near_duplicates(twice)).collect()) == [7, 8]
    other = spark.createDataFrame([(7, "a b c d e f", "x"), (7, "other words are under it", "y"), (7, "a b c d e f", "z")], "doc_id long, text string, kept string")
    for found in (simhash.near_duplicates(other), simhash.near_duplicates(other, shingle=5, min_similarity=0.8)):
        assert {r.component_id for r in found.collect()} == {7} and found.count() == 3
        kept = simhash.keep_one(other, found)
        assert kept.columns == other.columns and sorted(r.text for r in kept.collect()) == ["a b c d e f", "other words are under it"]


def test_the_last_row_is_compared(monkeypatch):
    fps = np.array([1 << 5, 1 << 40, (1 << 40) + 1], dtype=np.uint64)
    monkeypatch.setattr(simhash, "ITEMS", 2)  # two rows with one word each
    assert [x.tolist() for x in simhash.near_in_groups(fps, np.full(3, 3), 1)] == [[1], [2]]


def similar_groups(texts, least=0.8, shingle=5):
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (t.split() for t in texts)]
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(texts))]


def test_texts_of_one_fingerprint_are_all_compared(spark):
    rng = np.random.default_rng(11)
    made = []
    for k in range(12):
        own = [f"own{k}x{j}" for j in range(60)]
        edit = list(own)
        edit[int(rng.integers(60))] = "edited"
        made += [" ".join(["the same old phrase again"] * 60 + w) for w in (own, own, edit)]
    found = simhash.near_duplicates(docs(spark, made), shingle=5, radius=12, min_similarity=0.8, tables=2).collect()
    assert len({r.fp for r in found}) < 12  # the phrase decides the fingerprints
    want = similar_groups(made)
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(want)) and len(set(want)) == 12


def test_every_pair_at_the_least_similarity_is_found(spark):
    rng = np.random.default_rng(11)
    made = []
    for k in range(20):
        base = [f"f{k}w{j}" for j in rng.integers(0, 400, 150)]
        for _ in range(30):
            words = list(base)
            for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
                words[at] = f"e{rng.integers(10**6)}"
            made.append(" ".join(words))
    found = simhash.near_duplicates(docs(spark, made), shingle=5, radius=12, min_similarity=0.8, tables=2).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(similar_groups(made)))


def test_similar_pairs_among_many_nearly_similar_ones_are_all_found(spark):
    rng = np.random.default_rng(12)
    base, made = [f"w{j}" for j in range(600)], []
    for k in range(150):  # twins have two of eight edits in common and a similarity of about 0.82, most others of 0.76
        at = rng.choice(600, 14, replace=False)
        for own in (at[:8], at[6:]):
            words = list(base)
            for j in own:
                words[j] = f"e{k}x{j}"
            made.append(" ".join(words))
    found = simhash.near_duplicates(docs(spark, made), shingle=5, min_similarity=0.8, tables=2).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(similar_groups(made)))


def test_cells_return_forests_of_all_links():
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.choice(60, int(rng.integers(20, 50)))) for _ in range(200)]
    label = rng.integers(0, 150, 200)
    sizes = np.array([len(x) for x in sets])
    got = simhash.similar_in_cell(label, np.concatenate(sets), sizes, 0.6)
    comp = components_of(200, [(a, b) for a in range(200) for b in range(a) if label[a] == label[b] or len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b])) - 1e-9])
    same = [(a, b) for a in range(200) for b in range(a) if label[a] == label[b]]
    assert components_of(200, same + got) == comp and 0 < len(got) < 200
    for a, b in got:
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b])) - 1e-9
    parity = simhash.parities(np.concatenate(sets), sizes)
    assert all(np.bitwise_count(parity[a] ^ parity[b]).sum() <= len(np.setxor1d(sets[a], sets[b])) for a in range(200) for b in range(a))


def components_of(n, links):
    comp = list(range(n))
    for a, b in links:
        x, y = comp[a], comp[b]
        comp = [min(x, y) if c in (x, y) else c for c in comp]
    return comp


def test_the_radius_and_the_buckets_hold_similar_sets(spark):
    rng = np.random.default_rng(8)
    made = []
    for _ in range(200):
        a = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        b = list(a)
        for at in rng.choice(300, 6, replace=False):
            b[at] = "changed"
        made += [" ".join(a), " ".join(b)]
    got = {r.doc_id: r for r in simhash.sketches(docs(spark, made), 5, 2).collect()}
    near = met = total = 0
    for k in range(0, 400, 2):
        sets = [{tuple(w[i : i + 5]) for i in range(296)} for w in (made[k].split(), made[k + 1].split())]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            total += 1
            near += sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(got[k].words, got[k + 1].words, strict=True)) <= simhash.radius_at(0.8, 128)
            met += bool(set(got[k].least) & set(got[k + 1].least))
    assert total > 100 and near == met == total


def test_near_duplicates_of_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = simhash.near_duplicates(spark.createDataFrame(rows), shingle=5, min_similarity=0.8, tables=2).collect()
    ids = [r.doc_id for r in rows]
    assert {r.doc_id: r.component_id for r in found} == {i: ids[k] for i, k in zip(ids, similar_groups([re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "") for r in rows]), strict=True)}


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 8), (9, 8), (2, 1), (20, 9)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 8}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[7] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (420, [1.0, None] * 8), (None, x[0].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=10).collect()
    x, hit = x.astype(np.float64), 0
    for q in range(0, 400, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 and r.vec_id != q for r in mine)
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:10].tolist()) & {r.vec_id for r in mine})
    assert {r.query_id for r in got} == set(range(0, 400, 20)) and hit >= 0.9 * 200


def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(set)
    for r in ann.op2_nearest_neighbours(spark, DATA).collect():
        got[r.query_id].add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.argsort(-score)[:20]].tolist())
        hit, total = hit + len(best & got[ids[q]]), total + 20
    assert hit >= 0.9 * total


@pytest.mark.parametrize("hot", [substring.HOT, 1])
def test_substring_matches_brute_force(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    got = {r.doc_id: r for r in substring.dedup_substrings(docs(spark, texts)).collect()}
    words = [[w for w in re.split(f"[{BLANK}]+", t or "") if w] for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for i, w in enumerate(words):
        gone = {j + k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), len(gone), kept)
    assert got[8].n_removed == 90


def test_substring_blocks_hold_whole_anchors_when_joins_change_while_they_run(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 20)
    rng = np.random.default_rng(8)
    passages = [rng.choice(300, 60).astype(str).tolist() for _ in range(40)]
    texts = [" ".join([f"a{i}", *passages[i % 40 if i < 120 else 0], f"b{i}"]) for i in range(150)]
    set_to = {
        "spark.sql.autoBroadcastJoinThreshold": "1",  # planned as sort-merge joins, which turn into broadcasts
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.openCostInBytes": "100m",
    }
    before = {k: spark.conf.get(k, None) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    try:
        got = substring.dedup_substrings(docs(spark, texts).repartition(8)).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [(r.n_words, r.n_removed, r.text) for r in sorted(got)] == [(62, 60, f"a{i} b{i}") for i in range(150)]


def test_factors_are_the_longest_matches():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 12, 60)
    last = np.cumsum(sizes)
    ends, group = np.repeat(last, sizes), np.repeat(rng.integers(0, 3, 60), sizes)
    w = rng.integers(0, 4, last[-1]).astype(np.int64)
    length, source = substring.longest_matches(group, w, ends)

    def shared(a, b):
        k = 0
        while a + k < ends[a] and b + k < ends[b] and (group[a + k], w[a + k]) == (group[b + k], w[b + k]):
            k += 1
        return k

    for a in range(len(w)):
        assert length[a] == max(shared(a, b) for b in range(len(w)) if b != a)
        assert not length[a] or shared(a, source[a]) == length[a]
    at, segment = substring.parse(length, last - sizes, last)
    covered = {int(a) + k for a in at for k in range(length[a])}
    assert covered == set(np.flatnonzero(length > 0).tolist()) and (ends[at] == last[segment]).all()
    assert [x.tolist() for x in substring.longest_matches(np.zeros(2, int), np.arange(2), np.array([2, 2]))] == [[0, 0], [-1, -1]]


def test_factors_name_a_source_that_holds_the_words(spark, texts, monkeypatch):
    words = {}
    for row in substring._keyed(docs(spark, texts), "doc_id", "text").collect():
        words[row.t1, row.t2] = row.text.encode().split()
    for hot in (substring.HOT, 1):  # 1: every window is counted
        monkeypatch.setattr(substring, "HOT", hot)
        found = substring.duplicate_spans(docs(spark, texts)).where("factors is not null").collect()
        assert len(found) >= 5
        for r in found:
            for f in r.factors:
                assert f.n_words >= 35 and (f.source_t1 is None) == (hot == 1)
                if hot == 1:
                    continue
                assert (r.t1, r.t2, f.start) != (f.source_t1, f.source_t2, f.source_start)
                there = words[f.source_t1, f.source_t2]
                assert words[r.t1, r.t2][f.start : f.start + f.n_words] == there[f.source_start : f.source_start + f.n_words]


def test_decontamination(spark, texts):
    item = " ".join(texts[4].split()[20:50])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one, TWO"), (5, "not there at all today"), (1, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontam.leaks(docs(spark, [*texts, item.upper().replace(" ", ", ")]), items).collect()}
    n = len(texts)
    assert got == {(4, 1): 1.0, (n, 1): 1.0, (n - 1, 4): 1.0} | ({(9, 1): 1.0})
    kept = decontam.decontaminate(docs(spark, texts, [None if i == 4 else i for i in range(n)]), items)
    assert kept.columns == docs(spark, texts).columns and kept.count() == n - 3


def test_quality_learns_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    assert ((quality.train(x[:1500], y[:1500]).score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9
    assert quality.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_quality_query(spark, texts):
    got = {r.doc_id: r for r in quality.op5_quality_classifier(spark, DATA).collect()}
    held = [r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.85
    assert [len(r.x) for r in quality.text_features(docs(spark, texts)).collect()] == [len(quality.FEATURES)] * len(texts)


def flipped(spark, tmp_path, table, column, held, to):
    """The table's folder with every other table as it is, ``column`` changed where ``held`` of the id."""
    for name in ("documents", "labels"):
        t = spark.read.parquet(f"{DATA}/{name}.parquet")
        if name == table:
            t = t.withColumn(column, F.when(held(F.crc32(F.col("doc_id").cast("string"))), to).otherwise(F.col(column)))
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_held_out_labels_teach_nothing(spark, tmp_path):
    other = flipped(spark, tmp_path, "labels", "quality", lambda c: c % 4 == 2, 1 - F.col("quality"))
    a, b = ({r.doc_id: (r.score, r.predicted, r.held_out) for r in quality.op5_quality_classifier(spark, d).collect()} for d in (DATA, other))
    assert a == b and all(0 <= s <= 1 and p == (s >= 0.7) for s, p, _ in a.values())
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, (_, _, h) in a.items())


def test_held_out_languages_teach_nothing(spark, tmp_path):
    other = flipped(spark, tmp_path, "documents", "lang", lambda c: c % 3 == 1, F.lit("xx"))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.op9_language_id(spark, d).collect()} for d in (DATA, other))
    assert a == b and "xx" not in {x for x, _ in a.values()}


def test_odd_texts_have_a_quality(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([None, "", "  ", "a", "word " * 50_000, "\x00", "日本語"] + [f"some words {i} of a text" for i in range(12)])]
    spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(19)] + [(5, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op5_quality_classifier(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(19), 3]) and all(0 <= r.score <= 1 for r in got)


def test_language_query(spark):
    got = {r.doc_id: r for r in langid.op9_language_id(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in held) and len(got) == len(rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95


def test_language_of_odd_texts(spark):
    model = langid.train([langid.gram_counts(t) for t in ["the cat and the dog"] * 6 + ["el perro y la gata"] * 6], ["en"] * 6 + ["es"] * 6)
    got = langid.predict(docs(spark, ["the dog", None, "", "12 !?", "la gata"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "und", "und", "und", "es"]
    assert [r.score for r in got][1:4] == [0, 0, 0] and not got[1].accepted
    assert {r.lang_pred for r in langid.predict(docs(spark, ["x"]), langid.train([], [])).collect()} == {"und"}


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>same</p>", "<p>same</p>", None, "", "é\r\n\r\nWARC/1.1\r\n", "<p>same</p>"]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path, payloads=True)
    got = {r.page_id: r for r in warc.resolved(records).collect()}
    body = {r.page_id: r.payload for r in records.collect()}
    assert body[4] == html[4].encode() and body[0] is None
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: got[i].refers_to for i in got} == {0: 5, 1: 5, 2: 3, 3: None, 4: None, 5: None}
    assert {i for i in got if got[i].record_type == "revisit"} == {0, 1, 2}


def test_warc_query_against_brute_force(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    bodies = ["", "x" * 3000, *("".join(rng.choice(list("ab\r\né"), 40)) for _ in range(20))]
    rows = [(int(i), f"http://x/{i}", bodies[int(rng.integers(len(bodies)))]) for i in rng.permutation(90)] + [(90, None, None), (5, "http://again", "x" * 3000), (None, "u", "no id")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    monkeypatch.setattr(warc, "PIECE", 64)
    got = sorted((tuple(r) for r in warc.op6_warc(spark, str(tmp_path)).collect()), key=str)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = last.get(h or "") if i is not None and last[h or ""] != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError):
        list(warc.parse_records([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"]))
    with pytest.raises(ValueError):
        list(warc.parse_records([b"GET / HTTP/1.1\r\n\r\n"]))


def test_helper_columns_never_clash(spark):
    rows = spark.createDataFrame([(i, "menu\nown %d" % i if i < 12 else None, 1, 2, 3, 4, 5) for i in range(13)], "doc_id long, text string, of int, gone int, Kept int, _id int, leaky int")
    out = linededup.dedup_lines(rows)
    assert out.columns == [*rows.columns, "n_lines", "n_dropped"]
    assert [(r.text, r.n_dropped, r["of"], r.gone, r.Kept, r._id) for r in out.where("doc_id = 3").collect()] == [("own 3", 1, 1, 2, 3, 4)]
    items = spark.createDataFrame([(1, "own 3 menu")], "item_id long, text string")
    assert decontam.decontaminate(rows, items).columns == rows.columns and decontam.decontaminate(rows, items).count() == 13


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there\n\nHow are you?\n"), (1, 1, "assistant", "> How are  you?\nFine, thanks"), (1, 2, "user", "> > how are you?\n> Fine, thanks\nGood."), (1, 3, "user", "> unknown\nx > y"), (1, 4, "user", "> Good.\nyes"), (2, 0, "user", None), (None, 0, "user", "a"), (2, 1, "user", "> Good.\nother talk")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")
    got = {(r.conv_id, r.turn): (r.text, r.reply_to, r.thread, r.depth, r.place) for r in chat.format_conversations(table).collect()}
    assert got == {
        (1, 0): ("Hello there\n\nHow are you?", None, 0, 0, 0), (1, 1): ("Fine, thanks", 0, 0, 1, 1), (1, 2): ("Good.", 1, 0, 2, 2), (1, 4): ("yes", 2, 0, 3, 3),
        (1, 3): ("x > y", None, 3, 0, 0), (2, 0): ("", None, 0, 0, 0), (2, 1): ("other talk", None, 1, 0, 0), (None, 0): ("a", None, 0, 0, 0),
    }
    assert {tuple(r) for r in chat.quotation_links(table).collect()} == {(1, 1, 1, 0), (1, 2, 1, 1), (1, 2, 2, 0), (1, 4, 1, 2)}


def test_parts_of_a_message_and_deeper_quotes_link(spark):
    said = "One two\nthree four\nfive six\n\nSecond part\ngoes on\n\nThird part"
    rows = [
        (1, 0, said), (1, 1, "other"), (1, 2, "> three four\n> five six\ntwo lines"), (1, 3, "> One two\n> three four\n> five six\n>\n> Second part\n> goes on\ntwo paragraphs"),
        (1, 4, ">> other\nonly deeper"), (1, 5, "> not said\n> > other\nonly deeper links"), (1, 6, "> other\n>> two lines\nthe first level goes first"),
    ]
    table = spark.createDataFrame([(c, n, "user", t) for c, n, t in rows], "conv_id long, turn long, role string, text string")
    assert {r.turn: r.reply_to for r in chat.format_conversations(table).collect()} == {0: None, 1: None, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}


def test_line_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    pool = ["Home", " home\t", "About", "©", "", "  ", "x1", "x2", "HOME"]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 6))) for _ in range(40)] + [None, "", "\n\n"]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANK))
    lines = [(t or "").split("\n") for t in texts]
    seen = collections.Counter(k for x in lines for k in {key(y) for y in x} if k)
    for i, x in enumerate(lines):
        kept = [y for y in x if seen[key(y)] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(x), len(x) - len(kept), "\n".join(kept))


@pytest.mark.parametrize("fanout", [2, 3])
def test_line_runs(spark, fanout):
    runs = linededup.LineRuns(spark, fanout=fanout)
    batch = lambda *k: spark.createDataFrame([(x, 0, 1) for x in k], "h1 long, h2 long, n long")
    for ks in ((1, 2), (2, 3), (3, 4, 2)):
        runs.add(batch(*ks), 2)
    want = {1: 1, 2: 2, 3: 2, 4: 1}  # 2 was settled when the third batch came, but for runs not merged yet
    assert {r.h1: r.n for r in runs.counts().collect()} == want
    assert [len(x) for x in runs.levels] == ([1, 1] if fanout == 2 else [0, 1])
    runs.close()
    again = linededup.LineRuns(spark, fanout=fanout, path=runs.path)  # as another session would
    assert again.levels == runs.levels and {r.h1: r.n for r in again.counts().collect()} == want
    assert [r.h1 for r in again.unsettled(batch(2, 4, 9, 9), 1).collect()] == [9]
    plan = again.unsettled(batch(2, 4), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan  # the batch moves, the runs do not
    again.add(batch(5, 5))
    assert {r.h1: r.n for r in again.counts().collect()} == want | {5: 2}
    again.close()


def test_bpe_is_tiktoken(spark, texts):
    import public_tokenizers as P

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, P.PATTERN)
    more = [*texts, "<|endoftext|> don't  stop\n\n ", "日本語 mañana 🎉" * 3, "a" * 5000, "\x00\x01"]
    got = bpe.decode(bpe.encode(docs(spark, more), codec), codec).collect()
    for r in got:
        text = more[r.words] or ""
        assert r.ids == want.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert all(codec.hash.find(t) is not None for t in list(ranks)[::97]) and codec.hash.find(b"no such token") is None


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [])
    codec = bpe.Codec({bytes([i]): i for i in range(256)}, r"\w+|\W+")
    model = langid.train([langid.gram_counts("a")], ["en"])
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (
        simhash.near_duplicates(none), simhash.near_duplicates(none, shingle=5, radius=12, min_similarity=0.8), substring.dedup_substrings(none), decontam.leaks(none, items), decontam.leaks(docs(spark, ["a b"]), items.limit(0)),
        langid.predict(none, model), linededup.dedup_lines(none), bpe.encode(none, codec, bytes_col="b"), ann.nearest(vectors, F.lit(True)), quality.text_features(none),
        chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.count() == 0
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    cols = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in cols]
    got = registry.queries()[name](spark, DATA).select(*cols)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_pipeline_stages(spark):
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, now = whole.collect(), whole
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        outs.append(now)
        if len(outs) < len(corpus_pipeline.STAGES):
            assert now.columns == whole.columns
            now = spark.createDataFrame(now.collect(), whole.schema)
    lang, line, near, clean, coded = (o.collect() for o in outs)
    assert len(lang) >= 0.98 * len(rows) and len(line) == len(lang)
    assert all(r.n_chars == len(r.text) for r in line)
    # each stage against brute force on its own input
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    lines = {r.doc_id: (r.text or "").split("\n") for r in lang}
    seen = collections.Counter(k for x in lines.values() for k in {low(y.strip(BLANK)) for y in x} if k)
    assert {r.doc_id: r.text for r in line} == {i: "\n".join(y for y in x if seen[low(y.strip(BLANK))] < 10) for i, x in lines.items()}
    ordered = sorted(line, key=lambda r: r.doc_id)
    want = similar_groups([low(r.text or "") for r in ordered])
    assert sorted(r.doc_id for r in near) == sorted({ordered[g].doc_id for g in want})
    con = duckdb.connect()
    con.register("documents", now_near := pd.DataFrame([(r.doc_id, r.text) for r in near], columns=["doc_id", "text"]))
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    leaky_ids = {r[0] for r in con.execute(f"SELECT doc_id FROM ({registry.oracle_sql()['op4_decontamination']})").fetchall()}
    assert {r.doc_id for r in clean} == set(now_near.doc_id) - leaky_ids
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r.text.lower().split() for r in near)]
    alike = sum(len(a & b) >= 0.9 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if len(a) > 50)
    assert alike == 0 and len(near) < len(line)
    assert len({r.doc_id for r in near}) == len(near)
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in near if any(i in " ".join(re.findall(r"\w+", r.text.lower())) for i in items)}
    assert leaky.isdisjoint({r.doc_id for r in clean}) and len(coded) == len(clean)
