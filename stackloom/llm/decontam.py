"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item leaks into a document that holds at least ``threshold`` of the
item's distinct word shingles. Items are partitioned by size (powers of two of
their shingle count). An item of n shingles may miss at most
``floor((1 - threshold) * n)`` of them, so its signature is one more than that
of its least shingle hashes, the count taken from its partition's largest size:
a document that holds the item holds at least one of them, and looking up all
of a document's hashes among the signatures loses nothing however long the
document is. Pairs found, with enough shingles in the document, are verified by
exact containment of the shingles themselves. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored


def words_of(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, size: int, make) -> Column:
    """``make`` of each run of ``size`` words; of all words if they are fewer; none of none."""

    def runs(w: Column) -> Column:
        last = F.when(F.size(w) > 0, F.greatest(F.size(w) - size + 1, F.lit(1))).otherwise(F.lit(0))
        return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), F.lit(1), last), lambda i: make(F.slice(w, i, size)))

    # as a lambda's variable the words are evaluated once, whatever the optimizer inlines
    return F.element_at(F.transform(F.array(words), runs), 1)


def shingle_hashes(words: Column, size: int) -> Column:
    return _shingles(words, size, lambda run: F.xxhash64(run))


def shingle_texts(words: Column, size: int) -> Column:
    return F.array_distinct(_shingles(words, size, lambda run: F.array_join(run, " ")))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` of every leak.

    Words are runs of letters and digits, lower-cased; shingles are sets of
    ``shingle`` words (a text with fewer words is one shingle, one without words
    has none: such items leak nowhere). Repeated rows of an id, on either side,
    count once, with the largest containment; rows with a null id are searched
    like others and reported under null. Other columns are ignored.
    """
    test = items.select(F.col(item_col).alias("item_id"), words_of(item_text_col).alias("words")).where(F.size("words") > 0)
    test = test.select("item_id", shingle_texts(F.col("words"), shingle).alias("texts"), F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), shingle))).alias("hashes")).distinct()
    n = F.size("texts")
    largest = (F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1).cast("int")
    allowed = F.floor(largest * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    test = stored(test.withColumns({"n": n, "need": F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int"), "item_key": F.xxhash64("item_id", "texts")}).withColumn("signature", F.slice("hashes", F.lit(1), allowed + 1)), "items")
    signatures = stored(test.select("item_key", "need", F.explode("signature").alias("h")), "signatures")

    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = text.select("doc_id", shingle_hashes(words_of("text"), shingle).alias("hs"))
    found = hashed.select("doc_id", F.size("hs").alias("size"), F.explode_outer("hs").alias("h")).join(signatures, "h").where(F.col("size") >= F.col("need"))
    pairs = stored(found.select("doc_id", "item_key").distinct(), "pairs")

    wanted = pairs.groupBy("doc_id").agg(F.collect_set("item_key").alias("item_keys")).withColumnRenamed("doc_id", "want_id")
    near = text.join(wanted, text.doc_id.eqNullSafe(F.col("want_id"))).select("doc_id", "item_keys", shingle_texts(words_of("text"), shingle).alias("own"))
    checked = near.withColumn("item_key", F.explode("item_keys")).join(test.select("item_key", "item_id", "texts", "n", "need"), "item_key")
    shared = checked.select("doc_id", "item_id", "n", "need", F.size(F.array_intersect("own", "texts")).alias("shared")).where(F.col("shared") >= F.col("need"))
    best = shared.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("c"), "n", "shared")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n").cast("long").alias("n_shingles"), F.col("best.shared").cast("long").alias("n_shared"), F.col("best.c").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with their columns as they were."""
    leaky = fresh(docs, "leaky")
    bad = leaks(docs, items, id_col, **options).select(F.col("doc_id").alias(leaky)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(leaky)), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
     b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
     ds AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) > 0),
     bs AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) > 0),
     bn AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, any_value(bn.n) AS n_shingles, count(*) AS n_shared, count(*)::DOUBLE / any_value(bn.n) AS containment
FROM ds JOIN bs USING (s) JOIN bn ON bn.id = bs.id
GROUP BY ds.id, bs.id HAVING count(*) >= 0.8 * any_value(bn.n)
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
