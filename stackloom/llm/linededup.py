"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps, per line key, in how many documents it was seen: runs of
``(h1, h2, n)``, bucketed and sorted by hash, each level holding fewer than ``fanout`` runs of like
size; a full level is merged into one run of the next. A new batch is shuffled once, into
the runs' buckets; there it is merge-joined with every run, none of which moves, so that
what they have settled is not stored again, and then becomes a run of its own. A
manifest is written after every change; another session takes the runs up from it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, LOWER, UPPER, fresh, release, scratch, stored, wide_hash

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def lines_of(text) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    """128 bits of a key, as two longs: at 1e13 distinct lines no collision is expected."""
    return F.struct(*wide_hash(key, *KEY))


class LineRuns:
    """Counts of line keys in levelled, bucketed, sorted runs under one folder of the shared storage.

    A folder that holds runs already is taken up as its last manifest has it.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, path: str | None = None):
        self.spark, self.fanout, self.path = spark, fanout, path or scratch(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: dict[str, str] = {}
        self._made = self._version = 0
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*/_SUCCESS")
        self._fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        written = sorted(str(s.getPath().getParent().getName()) for s in self._fs.globStatus(where) or [])
        if written:
            self._version = int(written[-1].removeprefix("manifest-"))
            for r in spark.read.schema("level int, run string, buckets int, made int").parquet(f"{self.path}/{written[-1]}").collect():
                self._put(r.run, r.level)
                self.buckets, self._made = r.buckets, max(self._made, r.made)

    def _put(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _write(self, counts: DataFrame) -> str:
        """A new run of counts that lie in the runs' buckets."""
        self._made += 1
        run = f"run-{self._made:06d}"
        out = counts.select(*KEY, "n").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        self._tables[run] = f"line_runs_{uuid.uuid4().hex}"
        out.option("path", f"{self.path}/{run}").option("compression", "zstd").saveAsTable(self._tables[run])
        return run

    def _commit(self, gone: list[str]) -> None:
        """The manifest of what there is now; then runs that were merged can go."""
        rows = [(level, run, self.buckets, self._made) for level, runs in enumerate(self.levels) for run in runs]
        self._version += 1
        self.spark.createDataFrame(rows, "level int, run string, buckets int, made int").coalesce(1).write.parquet(f"{self.path}/manifest-{self._version:06d}")
        for run in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(run)}")
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}"), True)

    def _read(self, run: str) -> DataFrame:
        if run not in self._tables:
            self._tables[run] = f"line_runs_{uuid.uuid4().hex}"
            keys = ", ".join(KEY)
            self.spark.sql(f"CREATE TABLE {self._tables[run]} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(self._tables[run])

    def close(self) -> None:
        """Take the runs' tables out of the session's catalog; their files stay."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables = {}

    def counts(self) -> DataFrame:
        """``(h1, h2, n)`` over all runs; a key is in a run once, so only several runs are shuffled and summed."""
        return self._summed([run for level in self.levels for run in level])

    def _summed(self, runs: list[str]) -> DataFrame:
        # read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed, but does not line up their buckets
        schema = "h1 long, h2 long, n long"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], schema)
        return rows if len(runs) < 2 else rows.repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def unsettled(self, batch: DataFrame, least: int = 1) -> DataFrame:
        """The batch's counts, one row per key, of keys that the runs have seen in fewer than ``least`` documents."""
        now = batch.repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n")).withColumn("seen", F.lit(0).cast("long"))
        for run in (r for level in self.levels for r in level):
            now = now.join(self._read(run).hint("merge").withColumnRenamed("n", "more"), KEY, "left").select(*KEY, "n", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("seen"))
        return now.where(F.col("seen") < least).select(*KEY, "n")

    def add(self, batch: DataFrame, least: int | None = None) -> None:
        """Store the batch's counts as a run of level 0, without keys seen ``least`` times already, and merge the levels that are full."""
        self._put(self._write(self.unsettled(batch, 1 << 62 if least is None else least)), 0)
        gone, level = [], 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._write(self._merged(full)), level + 1)
            gone += full
            level += 1
        self._commit(gone)

    def _merged(self, runs: list[str]) -> DataFrame:
        """Two runs are merged bucket by bucket; of more, all are shuffled."""
        if len(runs) > 2:
            return self._summed(runs)
        a, b = (self._read(r).hint("merge").withColumnRenamed("n", n) for r, n in zip(runs, ("n1", "n2"), strict=True))
        return a.join(b, KEY, "full").select(*KEY, (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))


def frequent_keys(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``(h1, h2)`` of the keys of at least ``min_chars`` code points that at least ``min_docs`` rows hold."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.char_length(k) >= max(min_chars, 0)))
    seen = docs.select(F.pmod(F.xxhash64(text_col), F.lit(batches)).cast("int").alias("batch"), F.explode(F.transform(keys, key_hash)).alias("k"))
    seen = stored(seen.groupBy("batch", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("n")), "line-keys")
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        new = seen.where(F.col("batch") == b).select("h1", "h2", "n")
        runs.add(new, min_docs)
    found = stored(runs.counts().where(F.col("n") >= min_docs).select("h1", "h2"), "frequent-lines")
    runs.close()
    release(seen)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """All rows and columns of ``docs``, the text without frequent lines, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII blanks, A-Z lower-cased. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` rows hold lose all
    their lines; repeats in one row count once. A null or empty text is one empty
    line and comes back empty. Repeated rows count as rows of their own. Ids may be
    null or repeated: they only bring found keys back to their rows. Columns named
    like the two new ones are replaced.
    """
    gone = frequent_keys(docs, text_col, min_docs, min_chars, batches)
    hashes = F.array_distinct(F.transform(lines_of(F.col(text_col)), lambda x: key_hash(line_key(x))))
    own = docs.select(F.col(id_col).alias("id"), F.explode(hashes).alias("k")).select("id", "k.h1", "k.h2")
    of, held, kept = (fresh(docs, n) for n in ("of", "gone", "kept"))
    hits = own.join(gone, KEY).groupBy(F.col("id").alias(of)).agg(F.collect_set(F.struct("h1", "h2")).alias(held))
    joined = docs.join(hits.hint("shuffle_hash"), docs[id_col].eqNullSafe(hits[of]), "left").drop(of)
    lines = lines_of(F.col(text_col))
    stay = F.when(F.col(held).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(held), key_hash(line_key(x)))))
    out = joined.withColumn(kept, stay).withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(kept)).cast("long"), text_col: F.array_join(kept, "\n")})
    return out.drop(kept, held)


ORACLE = r"""
WITH l AS (
  SELECT d.doc_id, u.pos, d.lines[u.pos] AS line,
         translate(trim(d.lines[u.pos], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       unnest(range(1, len(d.lines) + 1)) AS u(pos)
), f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.doc_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
