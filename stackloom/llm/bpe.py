"""Byte-level BPE, two tiers: a minimal perfect hash, then a heap over linked bytes.

A pre-token that is a vocabulary entry is resolved by a minimal perfect hash
(hash and displace, one slot per entry). Any other is merged: its bytes form a
linked list, a heap yields the lowest-ranked neighbouring pair, leftmost first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, portions

#: Encoded pre-tokens in each of the two generations that a worker remembers.
MEMO = 120_000


class PerfectHash:
    """Distinct byte strings to 0..n-1 without gaps; strings outside the set map to None.

    Keys fall into buckets by one hash; each bucket, the largest first, gets the
    first seed under which its keys hash to free slots. Buckets of one key name
    a free slot directly.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, n // 4 + 1
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for k in keys:
            groups[xxhash.xxh64_intdigest(k) % self.buckets].append(k)
        self.seed = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        free = n - 1
        for bucket in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            own = groups[bucket]
            if len(own) == 1:
                while self.slots[free] is not None:
                    free -= 1
                self.seed[bucket] = -1 - free
                self.slots[free] = own[0]
                continue
            seed = 0
            while own:
                seed += 1
                at = [xxhash.xxh64_intdigest(k, seed) % n for k in own]
                if len(set(at)) == len(own) and all(self.slots[s] is None for s in at):
                    for k, s in zip(own, at, strict=True):
                        self.slots[s] = k
                    self.seed[bucket] = seed
                    break

    def find(self, key: bytes) -> int | None:
        if not self.n:
            return None
        seed = self.seed[xxhash.xxh64_intdigest(key) % self.buckets]
        slot = -1 - seed if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n
        return slot if self.slots[slot] == key else None


class Memo(dict):
    """Pre-token to ids, filled by the two tiers on a miss.

    Bounded by two generations: when the young one is full it becomes the old
    one, and what is still in use moves up from there.
    """

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.codec.encode_piece(piece.encode())
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    @classmethod
    def of_process(cls, codec: Codec) -> Memo:
        """The memo that this worker's tasks share, as long as they use the same vocabulary."""
        global _memo
        if _memo is None or _memo.codec is not codec:
            _memo = cls(codec)
        return _memo


_memo: Memo | None = None


class Codec:
    """Ranks and splitting pattern of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks))
        self.ids = [ranks[k] for k in self.hash.slots]
        self.tokens = {i: t for t, i in ranks.items()}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        """Read a rank file: a base64 token and its rank on each line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        slot = self.hash.find(piece)
        return (self.ids[slot],) if slot is not None else tuple(self._merge(piece))

    def _merge(self, piece: bytes) -> list[int]:
        rank, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here, and so the next part's start; 0: merged away
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:  # one of the two has changed since
                continue
            end[i], end[j], before[stop] = stop, 0, i
            if stop < n and (r := rank(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out


def encode(docs: DataFrame, codec: Codec, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the token ids of the whole text as ``array<int>``.

    Each match of the pattern is encoded on its own, without special tokens. Null
    and empty texts get an empty array; a column of that name is replaced. With
    ``bytes_col`` the ids are decoded again, in the same pass, into that column.
    """
    known = docs.sparkSession.sparkContext.broadcast(codec)  # as large as the vocabulary, whatever the input
    keep = [c for c in docs.columns if c not in (ids_col, bytes_col)]
    at = keep.index(text_col)
    new = [ids_col, *([bytes_col] if bytes_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, split, token = Memo.of_process(known.value), regex.compile(known.value.pattern).findall, known.value.tokens.__getitem__
        for whole in batches:
            for batch in portions(whole, at):
                ids = [list(chain.from_iterable(map(memo.__getitem__, split(t)))) if t else [] for t in batch.column(at).to_pylist()]
                columns = [*batch.columns, pa.array(ids, pa.list_(pa.int32()))]
                if bytes_col:
                    columns.append(pa.array([b"".join(map(token, x)) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *new])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes)
    return docs.select(*[f"`{c}`" for c in keep]).transform(map_arrow, run, f"{schema}, `{ids_col}` array<int>" + (f", `{bytes_col}` binary" if bytes_col else ""))


def decode(docs: DataFrame, codec: Codec, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns and the bytes of the ids. Null ids give no bytes; an id outside the vocabulary raises."""
    known = docs.sparkSession.sparkContext.broadcast(codec)
    keep = [c for c in docs.columns if c != bytes_col]
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = known.value.tokens.__getitem__
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                out = [b"".join(map(token, ids)) if ids else b"" for ids in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*keep, bytes_col])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes)
    return docs.select(*[f"`{c}`" for c in keep]).transform(map_arrow, run, f"{schema}, `{bytes_col}` binary")


def default_codec() -> Codec:
    """The multilingual 50k vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return Codec.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoding ``docs(doc_id, text)`` and decoding again."""
    coded = encode(docs, codec, bytes_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_codec())
