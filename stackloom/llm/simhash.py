"""SimHash near-duplicates: bit-sliced comparison of fingerprints within buckets.

A document's fingerprint holds, bit by bit, the majority of its word shingles'
XXH64 hashes. Fingerprints within the radius are found in three steps:

* equal fingerprints are folded into one representative first, so copies are
  never expanded;
* the 64 bits are cut into ``radius + 2`` bands; fingerprints at most
  ``radius`` bits apart agree in at least two of them, so each representative
  goes to one bucket for each pair of bands, and no link is lost. A bucket over
  ``CELL`` rows is dealt into blocks, and every pair of blocks becomes a cell
  of its own, so that no task gets a whole hot bucket;
* in a cell the fingerprints lie as vertical bit planes, 64 to a machine word.
  A carry-save counter per lane adds up differing bits, plane by plane, and
  words in which every lane has passed the radius are abandoned.

A cell returns a spanning forest of its links, nearest pairs first, not all
pairs; components are then taken over the forests of all cells.

Where a similarity is asked for as well, texts of one shingle set are folded
first, buckets are shared shingles, and a link only counts once verified by the
exact Jaccard similarity of the two shingle sets. Each text goes to the buckets
of its ``LEAST`` shingles of least hash: of the shingles that either of two texts of
similarity ``t`` has, each of the least is in both with probability ``t``, so a pair at 0.8
shares no bucket with probability ``0.2 ** LEAST`` at most. In the buckets the SimHashes of the sets,
64 bits for each table, are compared with a radius four standard deviations above the
distance expected at ``t``. A cell proposes ``FORESTS`` forests without common links. Where some
proved dissimilar, they may have stood for similar pairs: a pair that is left unlinked by that lies in two
components with such ends. The texts of these components go to their buckets once more, now with their
shingle sets, and every pair of different components is verified there unless it is linked already. A cell
returns a forest of verified links, so no pair is dropped for another, and no cell returns more links than it has texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, mix64, portions, release, stored, utf8
from .components import connected_components

#: Rows of a bucket that one cell takes from each of two blocks.
CELL = 4096
#: Rows a task holds while it compares.
BUFFER = 1 << 17
#: (row, word) items compared at once.
ITEMS = 1 << 17
#: Shingles whose bits are unpacked at once.
SLICE = 1 << 15
#: Added to a hash before it is scrambled for the next table (0 would stay 0).
SALT = np.uint64(0x9E3779B97F4A7C15)
#: Buckets of a text where a similarity is asked for, and the forests that a cell then proposes.
LEAST, FORESTS = 12, 3
#: Shingle hashes of a block of texts whose sets are compared, and that a task holds while it does.
SETS, HELD = 1 << 20, 1 << 22
#: Bits of the parity of a shingle set.
PARITY = 512
#: One text in so many is counted to find the buckets over ``CELL``.
COUNTED = 16


def _digests(text: bytes, shingle: int) -> bytes:
    """The XXH64 digests of a text's word shingles, one after another (of all its words if they are fewer)."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(joined, 42)
    ends = list(accumulate((len(w) + 1 for w in words)))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)])


def majority(hashes: np.ndarray) -> bytes:
    """Eight big-endian bytes: the bits that more than half of the hashes have."""
    counts, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, SLICE):
        counts += np.unpackbits(hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprint_bytes(text: bytes, shingle: int = 4) -> bytes:
    """Eight big-endian bytes: the SimHash of the text's word shingles, repeats included."""
    return majority(np.frombuffer(_digests(text, shingle), dtype=">u8"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)``: each text's fingerprint as a signed long. Null or blank texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join([fingerprint_bytes(t, shingle) for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, dtype=">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_arrow, run, "doc_id long, fp long")


def sketches(docs: DataFrame, shingle: int, tables: int) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp, k1, k2, words, least)``.

    ``fp`` is the text's fingerprint; ``k1, k2`` are a 128-bit hash of its set of shingles, ``words``
    that set's SimHashes, one for each table (each table scrambles the hashes once more), and
    ``least`` its shingles of least hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1):
                fps, keys, words, least = [], [], [], []
                for text in utf8(batch.column(1)):
                    hashes = np.frombuffer(_digests(text, shingle), dtype=">u8")
                    own = np.unique(hashes.astype(np.uint64))
                    fps.append(majority(hashes))
                    keys.append(xxhash.xxh128_digest(own.tobytes()))
                    least.append(own[:LEAST].view(np.int64))
                    for k in range(tables):
                        own = mix64(own + SALT) if k else own
                        words.append(majority(own))
                long = lambda parts, n: np.frombuffer(b"".join(parts), dtype=">i8").astype(np.int64).reshape(-1, n)
                keys, words = long(keys, 2), long(words, tables)
                columns = [batch.column(0), pa.array(long(fps, 1)[:, 0]), *[pa.array(keys[:, k].copy()) for k in (0, 1)], pa.array(list(words), pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "k1", "k2", "words", "least"])

    return docs.select("doc_id", "text").transform(map_arrow, run, "doc_id long, fp long, k1 long, k2 long, words array<long>, least array<long>")


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of each band; widths differ by one at most."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bucket_keys(fp, radius: int):
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in _bands(radius)]
    return F.array(*[F.shiftleft(part[a], 32).bitwiseOR(part[b]).bitwiseOR(F.lit(k << 56)) for k, (a, b) in enumerate(combinations(range(len(part)), 2))])


def forest(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the links of a minimum spanning forest of ``n`` rows."""
    label = np.arange(n)
    up = label.tolist()
    order = np.argsort(distance, kind="stable")
    kept: list[int] = []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    step = 1 << 14
    for at in range(0, len(order), step):
        part = order[at : at + step]
        part = part[label[a[part]] != label[b[part]]]
        before = len(kept)
        for i, x, y in zip(part.tolist(), a[part].tolist(), b[part].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(i)
        if len(kept) > before:
            label = np.array(up)
            while not np.array_equal(further := label[label], label):
                label = further
            up = label.tolist()
    return np.array(kept, dtype=np.int64)


def near_in_groups(fps: np.ndarray, last: np.ndarray, radius: int, forests: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The links of spanning forests of all pairs of a group within the radius, nearest first.

    Groups lie one after another; ``last`` is, for each row, the end of its group
    (excluded). A fingerprint is one word, or a row of several. Further forests
    are of the links that are left. The two arrays hold rows, the smaller one first.
    """
    fps = fps.reshape(len(fps), -1)
    n = len(fps)
    words = (n + 63) >> 6
    lanes = np.zeros((words << 6, fps.shape[1]), dtype=np.uint64)
    lanes[:n] = fps
    planes = np.empty((64 * fps.shape[1], words), dtype=np.uint64)
    for bit in range(len(planes)):
        planes[bit] = np.packbits(((lanes[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
    kept = [np.zeros((2, 0), dtype=np.int64)]
    rows = np.flatnonzero(np.arange(1, n + 1) < last)
    spans = ((last[rows] - 1) >> 6) - ((rows + 1) >> 6) + 1
    cuts = np.append(np.searchsorted(np.cumsum(spans), np.arange(0, spans.sum(), ITEMS)), len(rows)) if len(rows) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        own, span = rows[a:b], spans[a:b]
        query = np.repeat(own, span)
        step = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        word = ((query + 1) >> 6) + step
        low = np.clip(query + 1 - (word << 6), 0, 63).astype(np.uint64)
        high = np.clip(last[query] - (word << 6), 1, 64).astype(np.uint64)
        alive = (np.uint64(0xFFFFFFFFFFFFFFFF) << low) & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - high))
        kept.append(_spanning(fps, *_within(planes, fps, query, word, alive, radius), forests))
    return _spanning(fps, *np.concatenate(kept, axis=1), forests)


def _spanning(fps: np.ndarray, a: np.ndarray, b: np.ndarray, forests: int) -> np.ndarray:
    out = [np.zeros((2, 0), dtype=np.int64)]
    distance = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64)
    for _ in range(forests):
        if not len(a):
            break
        rows, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        tree = forest(len(rows), ends[: len(a)], ends[len(a) :], distance)
        out.append(np.stack([a[tree], b[tree]]))
        rest = np.ones(len(a), dtype=bool)
        rest[tree] = False
        a, b, distance = a[rest], b[rest], distance[rest]
    return np.concatenate(out, axis=1)


def _within(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The (row, lane) pairs of the items' live lanes that are within the radius."""
    value = fps[query]
    counter = [np.zeros(len(query), dtype=np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(query), dtype=np.uint64)
    one = np.uint64(1)
    for bit in range(0, len(planes), 2):
        d = [planes[b][word] ^ (np.uint64(0) - ((value[:, b >> 6] >> np.uint64(b & 63)) & one)) for b in (bit, bit + 1)]
        either = d[0] ^ d[1]
        carry = (counter[0] & either) | (d[0] & d[1])
        counter[0] ^= either
        for place in range(1, len(counter)):
            up = counter[place] & carry
            counter[place] ^= carry
            carry = up
        over |= carry
        if bit % 16 == 14:
            live = alive & ~(over | _above(counter, radius))
            keep = np.flatnonzero(live)
            if len(keep) < len(live):
                query, word, value, over = query[keep], word[keep], value[keep], over[keep]
                counter = [c[keep] for c in counter]
            alive = live[keep]
            if not len(keep):
                break
    at, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(alive) else (np.zeros(0, dtype=np.int64),) * 2
    return query[at], (word[at] << 6) + lane


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, in binary planes, is over the radius."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], 0xFFFFFFFFFFFFFFFF)
    for place in reversed(range(len(counter))):
        if radius >> place & 1:
            same &= counter[place]
        else:
            more |= same & counter[place]
            same &= ~counter[place]
    return more


def _compare(radius: int, words: int = 1, forests: int = 1):
    """Rows ``(bucket, cell, rep, word, …)`` in order of their cells to ``(src, dst)``."""
    n = 3 + words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(final: bool) -> pa.RecordBatch | None:
            nonlocal held
            rows = np.concatenate(held, axis=1) if held else np.zeros((n, 0), dtype=np.int64)
            edge = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            end = rows.shape[1] if final else (edge[-1] if len(edge) else 0)
            held = [rows[:, end:]]
            rows, edge = rows[:, :end], edge[edge < end]
            if not end:
                return None
            start = np.concatenate([[0], edge])
            size = np.diff(np.concatenate([start, [end]]))
            a, b = near_in_groups(np.ascontiguousarray(rows[3 : 3 + words].T).view(np.uint64), np.repeat(start + size, size), radius, forests)
            pairs = np.unique(np.sort(np.stack([rows[2][a], rows[2][b]]), axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[1].copy()), pa.array(pairs[0].copy())], ["src", "dst"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(n)]).astype(np.int64))
            if sum(x.shape[1] for x in held) >= BUFFER and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return run


def _in_cells(keyed: DataFrame, hot: DataFrame, radius: int, forests: int = 1) -> DataFrame:
    """``keyed(bucket, rep, word, …)`` to the links of its cells; ``hot(bucket, blocks)`` are the buckets over ``CELL``."""
    columns = keyed.columns[2:]
    dealt = _dealt(keyed.join(hot, "bucket", "left"), *columns)
    return dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "rep").transform(map_arrow, _compare(radius, len(columns), forests), "src long, dst long")


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows(bucket, rep, blocks, …)`` once for every cell of their bucket: one, or one for each pair of its blocks."""
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.expr("transform(sequence(0, blocks - 1), c -> least(c, block) * blocks + greatest(c, block))"))
    return rows.withColumn("block", block).select("bucket", F.explode(cells).alias("cell"), "rep", *columns)


def links(groups: DataFrame, radius: int = 4) -> DataFrame:
    """``groups(fp, rep)`` with distinct fp to ``(src, dst)`` of reps: a forest that connects what the radius connects."""
    keyed = groups.select(F.explode(_bucket_keys(F.col("fp"), radius)).alias("bucket"), "rep", "fp")
    hot = stored(keyed.groupBy("bucket").count().where(F.col("count") > CELL).select("bucket", F.ceil(F.col("count") / CELL).cast("int").alias("blocks")), "hot-buckets")
    return _in_cells(keyed, hot, radius)


def radius_at(similarity: float, bits: int) -> int:
    """Differing bits, of ``bits``, that two sets of this Jaccard similarity pass with four standard deviations to spare."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return min(bits, ceil(bits * p + 4 * sqrt(bits * p * (1 - p))))


def proposals(sets: DataFrame, least: float, tables: int) -> DataFrame:
    """``sets(rep, words, least)`` to pairs ``(src, dst)``: forests of those that share a bucket and are within the radius of the similarity."""
    keyed = sets.select(F.explode("least").alias("bucket"), "rep", *[F.col("words")[k].alias(f"word{k}") for k in range(tables)])
    # a bucket over CELL has CELL / COUNTED of the counted texts, give or take; one missed or too many changes no result
    few = keyed.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(COUNTED)) == 0).groupBy("bucket").agg((F.count("*") * COUNTED).alias("count"))
    hot = stored(few.where(F.col("count") > CELL // 2).select("bucket", F.ceil(F.col("count") / (CELL // 2)).cast("int").alias("blocks")), "hot-buckets")
    return _in_cells(keyed, hot, radius_at(least, 64 * tables), FORESTS).distinct()


def parities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set, lying one after another, which of ``PARITY`` bits an odd number of its hashes have: two sets differ in at least as many items as bits."""
    bit = (mix64(flat.view(np.uint64)) % np.uint64(PARITY)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * PARITY + bit, minlength=len(sizes) * PARITY).reshape(len(sizes), PARITY) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)


def similar_in_cell(label: np.ndarray, flat: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A forest that joins what links of similarity ``least`` between sets join, those of one label being joined already."""
    root, links_ = np.unique(label, return_inverse=True)[1], []
    parity, end = parities(flat, sizes), np.cumsum(sizes)
    for i in range(len(sizes) - 1):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        far = np.bitwise_count(parity[j] ^ parity[i]).sum(axis=1, dtype=np.int64)
        close = far <= (sizes[j] + sizes[i]) * ((1 - least) / (1 + least)) + 1e-6
        j = j[close][np.argsort(far[close], kind="stable")]
        mine = flat[end[i] - sizes[i] : end[i]]
        for k in j.tolist():
            if root[k] == root[i]:
                continue
            shared = len(np.intersect1d(mine, flat[end[k] - sizes[k] : end[k]], assume_unique=True))
            if shared >= least * (sizes[i] + sizes[k] - shared) - 1e-9:
                links_.append((i, k))
                root[root == root[k]] = root[i]
    return links_


def _link_cells(least: float):
    """Rows ``(bucket, cell, rep, label, has)`` in order of their cells to the verified links ``(src, dst)``."""

    def linked(part: pa.Table) -> pa.RecordBatch:
        bucket, cell, rep, label = (part.column(k).to_numpy() for k in range(4))
        has = part.column(4).combine_chunks()
        flat, sizes = has.flatten().to_numpy(), has.value_lengths().to_numpy().astype(np.int64)
        end = np.cumsum(sizes)
        edge = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(cell) != 0)) + 1
        out = []
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(rep)], strict=True):
            if (label[a:b] != label[a]).any():
                out += [(rep[a + i], rep[a + k]) for i, k in similar_in_cell(label[a:b], flat[end[a] - sizes[a] : end[b - 1]], sizes[a:b], least)]
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(4).flatten())
            if n < HELD:
                continue
            part = pa.Table.from_batches(held)
            bucket, cell = (part.column(k).to_numpy() for k in (0, 1))
            edge = np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1]))
            if len(edge):
                yield linked(part.slice(0, edge[-1] + 1))
                held = part.slice(edge[-1] + 1).to_batches()
                n = sum(len(b.column(4).flatten()) for b in held)
        if held:
            yield linked(pa.Table.from_batches(held))

    return run


def completed(again: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified links ``(src, dst)`` that join the labels of ``again(rep, least, label)`` whose texts share a bucket and are similar; ``sets(doc_id, has)``."""
    has = sets.select(F.col("doc_id").alias("rep"), "has")
    keyed = stored(again.join(has.select("rep", F.size("has").alias("n")), "rep").select(F.explode("least").alias("bucket"), "rep", "label", "n"), "again")
    mixed = keyed.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("rows"), F.sum("n").alias("items")).where("a <> b")
    blocks = F.ceil(F.greatest(F.col("rows") / CELL, F.col("items") / SETS)).cast("int")
    buckets = stored(mixed.select("bucket", F.when(blocks > 1, blocks).alias("blocks")), "mixed-buckets")
    dealt = _dealt(keyed.join(buckets, "bucket"), "label").join(has, "rep").select("bucket", "cell", "rep", "label", "has")
    return dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "rep").transform(map_arrow, _link_cells(least), "src long, dst long")


def _shingle_sets(edges: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, has)``: the shingle sets of the edges' ends."""
    ends = edges.select(F.col("src").alias("doc_id")).unionByName(edges.select(F.col("dst").alias("doc_id"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                sets = [shingle_set(t, shingle) for t in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "has"])

    sets = docs.join(ends.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text").transform(map_arrow, run, "doc_id long, has array<long>")
    return stored(sets.dropDuplicates(["doc_id"]), "shingle-sets")


def _verified(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the distinct edges whose ends' shingle sets have a Jaccard similarity of ``least`` or more."""
    a = sets.select(F.col("doc_id").alias("src"), F.col("has").alias("one"))
    b = sets.select(F.col("doc_id").alias("dst"), F.col("has").alias("two"))
    shared = F.size(F.array_intersect("one", "two"))
    joined = edges.join(a, "src").join(b, "dst").select("src", "dst", shared.alias("shared"), (F.size("one") + F.size("two")).alias("sizes"))
    return stored(joined.where(F.col("shared") >= F.lit(least) * (F.col("sizes") - F.col("shared")) - F.lit(1e-9)).select("src", "dst"), "verified")


def _similar_components(sets: DataFrame, more: DataFrame, docs: DataFrame, shingle: int, least: float, tables: int) -> DataFrame:
    """``(node, component)`` over the verified links of ``sets(rep, words, least)`` and the edges ``more``."""
    near = stored(proposals(sets, least, tables), "near")
    has = _shingle_sets(near, docs, shingle)
    good = _verified(near, has, least)
    found = stored(connected_components(good.unionByName(more)), "found")
    bad = stored(near.join(good, ["src", "dst"], "left_anti"), "rejected")
    ends = bad.select(F.col("src").alias("node")).unionByName(bad.select(F.col("dst").alias("node"))).distinct()
    failed = ends.join(found, "node", "left").select(F.coalesce("component", "node").alias("label")).distinct()
    placed = sets.join(found, sets.rep == found.node, "left").select("rep", "least", F.coalesce("component", "rep").alias("label"))
    again = placed.join(stored(failed, "failed"), "label", "left_semi").select("rep", "least", "label")
    good = stored(completed(again, has, least).distinct(), "completed")
    release(near, has)
    if good.isEmpty():
        return found
    return connected_components(found.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(good))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles (of all its words if they are fewer)."""
    return np.unique(np.frombuffer(_digests(text, shingle), dtype=">i8").astype(np.int64))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, min_similarity: float | None = None, tables: int = 1) -> DataFrame:
    """One row per document: ``(doc_id, fp, fingerprint, component_id)``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the least id of
    the documents reachable over links of at most ``radius`` differing bits or,
    with ``min_similarity``, over verified links of at least that Jaccard similarity of
    the shingle sets; then ``radius`` is not used, and ``tables`` is the number of
    fingerprint words by which pairs are proposed. More tables than one need ``min_similarity``.
    Null, empty and blank texts have fingerprint zero and link like others;
    repeated rows stay as many rows; rows that share an id share a component; rows with a null
    id have a null component; other columns are ignored; an empty table gives an empty result.
    """
    if tables > 1 and min_similarity is None:
        raise ValueError("several tables need a similarity to verify")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if min_similarity is not None:
        sets = stored(sketches(texts, shingle, tables), "sketches")
        known = sets.where("doc_id is not null").groupBy("k1", "k2")
        folded = stored(known.agg(F.min("doc_id").alias("rep"), F.first("words").alias("words"), F.first("least").alias("least")), "sets")
        found = _similar_components(folded.select("rep", "words", "least"), _same_id(sets, folded), texts, shingle, min_similarity, tables)
        placed = folded.join(found, folded.rep == found.node, "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
        named = sets.select("doc_id", "fp", "k1", "k2").join(stored(placed, "components"), ["k1", "k2"], "left")
        named = named.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        release(folded)
    else:
        fps = stored(fingerprints(texts, shingle=shingle), "fingerprints")
        groups = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-groups")
        found = connected_components(links(groups, radius))
        named = groups.join(found, groups.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
        named = fps.join(named, "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return named.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _same_id(sets: DataFrame, folded: DataFrame) -> DataFrame:
    """Edges between the sets of rows that share an id."""
    several = sets.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("n")).where("n > 1").select("doc_id")
    reps = sets.join(several, "doc_id").select("doc_id", "k1", "k2").join(folded.select("k1", "k2", "rep"), ["k1", "k2"])
    return reps.select(F.greatest("doc_id", "rep").alias("src"), F.least("doc_id", "rep").alias("dst")).where("src <> dst")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group: those of its least id; rows with a null id all stay.

    Of rows that share such an id and their text, one stays; different texts under one id all stay.
    """
    kept = fresh(docs, "kept")
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(kept))
    again = stored(first.groupBy(kept).count().where("count > 1").select(kept), "repeated-ids")
    stay = docs.join(first.distinct(), docs[id_col] == F.col(kept), "left_semi")
    if not again.isEmpty():
        twice = stay.join(again, stay[id_col] == F.col(kept), "left_semi").dropDuplicates([id_col, text_col])
        stay = stay.join(again, stay[id_col] == F.col(kept), "left_anti").unionByName(twice)
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
