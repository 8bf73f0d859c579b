"""Substring deduplication by relative Lempel-Ziv parsing against indexed blocks.

The reference is the whole collection, cut into blocks by content. The anchor of
a window of ``window`` words is the least hash among its ``gram``-word shingles;
consecutive windows of one anchor form a segment, and a block holds the segments
of its anchors. Equal windows have equal anchors, so a window can be found in
one block only, and parsing every segment against the block of its anchor
is parsing every document against every block. The steps:

* equal texts are folded: of a text that occurs twice every window is repeated;
* anchors that occur once in the folded collection are discarded (a count): no
  other place holds one of their windows;
* the segments of the other anchors are dealt to the blocks. A block is indexed
  by sorting the suffixes of its segments, and each segment is parsed greedily
  from the left: a factor is the longest match that starts elsewhere in the block,
  at least ``window`` words long; where there is none one word is copied;
* the windows over a factor's end are looked up too, so that factors which meet or
  overlap leave no gap.

The words of the factors are the duplicate spans. Segments of anchors that more
than ``HOT`` texts share would make one block too large: their windows are
counted one by one, pre-aggregated, and runs of repeated ones are the factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, mix64, portions, release, stored, utf8, wide_hash

TEXT_KEY = ["t1", "t2"]
MULTIPLIER = 0x9E3779B97F4A7C15
#: Occurrences of an anchor beyond which its windows are counted instead of going to a block.
HOT = 1024
#: Windows a block holds, more only where one anchor has more.
BLOCK = 1 << 18
FACTOR = "t1 long, t2 long, start int, n_words int, source_t1 long, source_t2 long, source_start int"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *wide_hash(text, *TEXT_KEY))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` items, equal runs getting equal hashes wherever they start."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = np.full(len(hashes), MULTIPLIER, dtype=np.uint64)
    power[0] = 1
    back = np.full(n, pow(MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes ^ np.uint64(MULTIPLIER)) * np.cumprod(power))])
    return mix64((total[size:] - total[:n]) * np.cumprod(back))


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window its anchor: the place of its least shingle hash (leftmost of equals), and that hash."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g = rolling(hashes, gram)
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1)
    at = at + np.arange(len(at))
    return at, g[at]


def longest_matches(group: np.ndarray, w: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest match of every window of a block: its number of windows, and the place in the block where it starts.

    Windows lie segment after segment; ``group`` numbers their anchors, ``w`` hashes
    their words, ``last`` is the end of their segment (excluded). Length 0: the
    window occurs nowhere else. Suffixes are sorted by doubling; the longest match of
    one is the longer of those with its two neighbours.
    """
    n = len(w)
    length, source = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    order = np.lexsort((w, group))
    new = np.ones(n, dtype=bool)
    new[1:] = (np.diff(group[order]) != 0) | (w[order][1:] != w[order][:-1])
    cls = np.empty(n, dtype=np.int64)
    cls[order] = np.cumsum(new) - 1
    known = np.bincount(cls)[cls] > 1
    at = np.flatnonzero(known)
    if not len(at):
        return length, source
    unknown = np.append(np.flatnonzero(~known), n)
    stop = np.minimum(last, unknown[np.searchsorted(unknown, np.arange(n))])
    rank, reach, k = cls.copy(), int((stop[at] - at).max()), 1
    while True:
        order = np.argsort(rank[at], kind="stable")
        if k >= reach:
            break
        ahead = np.full(len(at), -1, dtype=np.int64)
        on = at + k < stop[at]
        ahead[on] = rank[at[on] + k]
        order = np.lexsort((ahead, rank[at]))
        mine, then = rank[at][order], ahead[order]
        rank[at[order]] = np.cumsum(np.append(True, (mine[1:] != mine[:-1]) | (then[1:] != then[:-1])))
        k *= 2
    a, b = at[order][:-1], at[order][1:]
    shared, live, k = np.zeros(len(a) + 2, dtype=np.int64), np.arange(len(a)), 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        same = (x < stop[a[live]]) & (y < stop[b[live]])
        same[same] = cls[x[same]] == cls[y[same]]
        live = live[same]
        k += 1
        shared[live + 1] = k
    before = shared[:-1] > shared[1:]
    length[at[order]] = np.maximum(shared[:-1], shared[1:])
    source[at[order]] = np.where(before, np.append(-1, a), np.append(b, -1))
    return length, source


def parse(length: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greedy factors of segments: the window where each starts, and its segment.

    A factor takes the longest match at the first window that has one. The windows over
    its end are looked up next: the first of them that has a match starts
    another factor.
    """
    found = np.append(np.flatnonzero(length > 0), len(length))
    nxt = found[np.searchsorted(found, np.arange(len(length) + 1))]
    segment, at = np.arange(len(first)), first.copy()
    starts, segments = [], []
    while len(segment):
        at = nxt[at]
        on = at < last[segment]
        segment, at = segment[on], at[on]
        starts.append(at)
        segments.append(segment)
        at = at + length[at]
    return (np.concatenate(starts), np.concatenate(segments)) if starts else (np.zeros(0, dtype=np.int64),) * 2


def _find_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1):
                found = []
                for text in utf8(batch.column(1)):
                    at, h = anchors(word_hashes(text.split()), window, gram)
                    found.append(h[np.flatnonzero(np.diff(at, prepend=-1))].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "anchors"])

    return run


def _find_segments(window: int, gram: int):
    """Texts with their known anchors, and those of them that are hot, to segments: ``w`` hashes the segment's windows, the first of which starts at word ``start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 2):
                rows, anchor, start, sizes, w, hot = ([np.zeros(0, dtype=np.int64)] for _ in range(6))
                for row, (text, known, many) in enumerate(zip(utf8(batch.column(2)), batch.column(3), batch.column(4), strict=True)):
                    hashes = word_hashes(text.split())
                    place, h = anchors(hashes, window, gram)
                    hit = np.flatnonzero(np.isin(h.view(np.int64), known.values.to_numpy()))
                    first = np.flatnonzero(np.diff(place[hit], prepend=-1))
                    rows.append(np.full(len(first), row))
                    anchor.append(h[hit][first].view(np.int64))
                    start.append(hit[first])
                    sizes.append(np.diff(np.append(first, len(hit))))
                    w.append(rolling(hashes, window)[hit].view(np.int64))
                    hot.append(np.isin(anchor[-1], many.values.to_numpy()))
                edge = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                rows = pa.array(np.concatenate(rows))
                windows = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(w)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(anchor)), pa.array(np.concatenate(start), pa.int32()), windows, pa.array(np.concatenate(hot).astype(bool))], ["t1", "t2", "h", "start", "w", "hot"])

    return run


def _parse_blocks(window: int):
    """Segments in order of their anchors to factors; a block ends where an anchor does."""

    def block(part: pa.Table) -> pa.RecordBatch:
        h, t1, t2, start = (part.column(k).to_numpy() for k in range(4))
        w = part.column(4).combine_chunks()
        sizes = w.value_lengths().to_numpy()
        last = np.cumsum(sizes)
        group = np.repeat(np.cumsum(np.append(True, h[1:] != h[:-1])), sizes)
        length, source = longest_matches(group, w.flatten().to_numpy(), np.repeat(last, sizes))
        at, own = parse(length, last - sizes, last)
        there = source[at]
        other = np.searchsorted(last, there, side="right")
        place = lambda where, segment: start[segment] + where - (last - sizes)[segment]
        columns = [t1[own], t2[own], place(at, own).astype(np.int32), (length[at] + window - 1).astype(np.int32), t1[other], t2[other], place(there, other).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in FACTOR.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(4).flatten())
            if n < BLOCK:
                continue
            part = pa.Table.from_batches(held)
            h = part.column(0).to_numpy()
            edge = np.flatnonzero(h != h[-1])
            if len(edge):
                yield block(part.slice(0, edge[-1] + 1))
                held = part.slice(edge[-1] + 1).to_batches()
                n = sum(len(b.column(4).flatten()) for b in held)
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def _counted(segments: DataFrame, window: int) -> DataFrame:
    """The factors of hot segments, without a source: the windows that are not the only ones of their words, in runs.

    Only the lone windows come back from the count, each with its place, so nothing is joined by a hot key.
    """
    each = segments.select("h", "t1", "t2", F.col("start").alias("of"), F.posexplode("w").alias("k", "w"))
    lone = each.groupBy("h", "w").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "of", "k")).alias("at")).where("n = 1")
    parts = segments.select("t1", "t2", F.col("start").alias("of"), F.size("w").alias("n"), F.lit(None).cast("int").alias("k")).unionByName(lone.select("at.t1", "at.t2", "at.of", F.lit(None).cast("int").alias("n"), "at.k"))
    whole = parts.groupBy("t1", "t2", "of").agg(F.max("n").alias("n"), F.collect_list("k").alias("lone"))
    known = whole.withColumn("known", F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "lone"))
    edge = lambda step: F.filter("known", lambda k: ~F.array_contains("known", k + step))
    runs = known.select("t1", "t2", "of", F.explode(F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b"))).alias("run"))
    return runs.select("t1", "t2", (F.col("of") + F.col("run.a")).alias("start"), (F.col("run.b") - F.col("run.a") + window).alias("n_words"), *[F.lit(None).cast(kind).alias(f"source_{c}") for c, kind in (("t1", "long"), ("t2", "long"), ("start", "int"))])


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(t1, t2, copies)`` of every distinct text, and the factors of the collection of distinct texts.

    ``t1, t2`` hash a whole text, ``copies`` counts the rows that hold it. A factor
    ``(t1, t2, start, n_words, source_t1, source_t2, source_start)`` says that from word
    ``start`` the text's ``n_words`` words are also found in the source's; the source is
    null where every window of the run was only counted (``HOT``).
    """
    keyed = _keyed(docs, id_col, text_col)
    seen = keyed.select("doc_id", "text", "t1", "t2").transform(map_arrow, _find_anchors(window, gram), "doc_id " + dict(keyed.dtypes)["doc_id"] + ", t1 long, t2 long, anchors array<long>")
    folded = stored(seen.groupBy(*TEXT_KEY).agg(F.count("*").alias("copies"), F.min("doc_id").alias("pick"), F.first("anchors").alias("anchors")), "texts")
    rep = folded.select("t1", "t2", F.explode("anchors").alias("h"))
    twice = stored(rep.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    hits = stored(rep.join(twice, "h").groupBy(*TEXT_KEY).agg(F.collect_set("h").alias("known"), F.collect_set(F.when(F.col("n") > HOT, F.col("h"))).alias("hot")).join(folded.select("t1", "t2", "pick"), TEXT_KEY), "anchor-hits")
    mine = keyed.join(hits.hint("shuffle_hash"), TEXT_KEY).where(F.col("doc_id").eqNullSafe(F.col("pick")))
    segments = stored(mine.select("t1", "t2", "text", "known", "hot").transform(map_arrow, _find_segments(window, gram), "t1 long, t2 long, h long, start int, w array<long>, hot boolean"), "segments")
    texts = stored(folded.select("t1", "t2", "copies"), "copies")
    release(folded, hits, twice)

    # dealt straight from the stored table: after a join by h Spark takes this repartition for a repeat, drops it, and may then read the join's shuffle in other pieces than whole anchors
    dealt = segments.where("not hot").select("h", "t1", "t2", "start", "w").repartition("h").sortWithinPartitions("h")
    found = dealt.transform(map_arrow, _parse_blocks(window), FACTOR)
    out = stored(found.unionByName(_counted(segments.where("hot"), window)), "factors")
    release(segments)
    return texts, out


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8) -> DataFrame:
    """``(t1, t2, copies, factors)`` for every text that is repeated or has factors, see :func:`factors`."""
    texts, found = factors(docs, id_col, text_col, window, gram)
    listed = found.groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "n_words", "source_t1", "source_t2", "source_start"))).alias("factors"))
    return texts.join(listed, TEXT_KEY, "left").where("copies > 1 or factors is not null")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_words, n_removed, text)``.

    Words are maximal runs without ASCII blanks, unchanged. A word goes if a window
    of ``window`` words that covers it also starts anywhere else, in the same or
    another row; windows are judged on the input. The kept words are joined by one
    space. Null, empty and shorter texts have no window and lose nothing; repeated
    rows repeat each other and so lose every word if they have a window; ids may
    be null or repeated and only name the rows; other columns are ignored.
    """
    texts, found = factors(docs, id_col, text_col, window, gram)
    listed = found.groupBy(*TEXT_KEY).agg(F.collect_list(F.struct("start", "n_words")).alias("f"))
    listed = listed.select(*TEXT_KEY, F.col("f.start").alias("starts"), F.col("f.n_words").alias("sizes"))
    spans = stored(texts.join(listed, TEXT_KEY, "left").where("copies > 1 or starts is not null"), "spans")
    release(texts, found)
    joined = _keyed(docs, id_col, text_col).join(spans.hint("shuffle_hash"), TEXT_KEY, "left").select("doc_id", "text", "copies", "starts", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1):
                total, removed, kept = [], [], []
                for text, copies, starts, sizes in zip(utf8(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    words = text.split()
                    n = len(words)
                    if copies and copies > 1 and n >= window:
                        words = []
                    elif starts:
                        edge = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, np.add(starts, sizes), -1)
                        words = [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]
                    total.append(n)
                    removed.append(n - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return joined.transform(map_arrow, run, "doc_id " + dict(joined.dtypes)["doc_id"] + ", n_words long, n_removed long, text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
