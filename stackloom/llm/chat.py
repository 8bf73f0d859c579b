"""Chat formatting by quotation linking, in DataFrame functions only.

A message's quoted lines (``>`` after optional blanks) are peeled off level by
level. The passage at each level, normalised and hashed, is joined to the message
of the same conversation that first said it; what nobody said as a whole is held
against it by paragraphs, and those by lines. The latest message quoted at the
shallowest level that links is the one replied to. Replies form threads; messages come out
without quotes, each with its thread and its place in it, originals first.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, wide_hash

MARK = "\x01"
QUOTED = r"^[ \t]*>"
#: Turns in a slice of a thread; places within a slice are counted in one group.
SLICE = 4096


def _lines(text: Column) -> Column:
    return F.split(F.translate(text, MARK, " "), "\r?\n", -1)


def own_text(text: Column) -> Column:
    """The lines that quote nothing, without blank lines at either end."""
    return F.trim(F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(QUOTED)), "\n"), F.lit("\n"))


def quoted_blocks(text: Column) -> Column:
    """Each run of quoted lines, one level of marks removed."""
    peeled = F.transform(_lines(text), lambda x: F.when(x.rlike(QUOTED), F.regexp_replace(x, QUOTED + " ?", "")).otherwise(F.lit(MARK)))
    return F.filter(F.transform(F.split(F.array_join(peeled, "\n"), MARK, -1), lambda b: F.trim(b, F.lit("\n"))), lambda b: F.trim(b) != "")


def normalised(passage: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def _passages(own: Column) -> Column:
    """What others may quote of a message: the whole, a paragraph, a line."""
    parts = F.concat(F.array(own), F.split(own, "\n[ \t]*\n"), F.split(own, "\n"))
    return F.filter(F.array_distinct(F.transform(parts, normalised)), lambda p: p != "")


def _quoted_parts(own: Column) -> Column:
    """``(rank, para, p)`` of a quoted passage: the whole (0), its paragraphs (1), their lines (2)."""
    part = lambda rank, para, p: F.struct(F.lit(rank).alias("rank"), para.alias("para"), normalised(p).alias("p"))
    paras = F.split(own, "\n[ \t]*\n")
    lines = F.flatten(F.transform(paras, lambda x, i: F.transform(F.split(x, "\n"), lambda y: part(2, i, y))))
    return F.filter(F.concat(F.array(part(0, F.lit(-1), own)), F.transform(paras, lambda x, i: part(1, i, x)), lines), lambda x: x.p != "")


def _hash(passage: Column) -> list[Column]:
    return wide_hash(passage, "h1", "h2")


def quotation_links(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, said_turn)``: passages quoted at a level and the earlier turn that first said them.

    A paragraph counts where its whole block was not found, a line where its paragraph was not.
    """
    base = messages.where("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", "text")
    said = base.select("conv_id", "turn", F.explode(_passages(own_text(F.col("text")))).alias("p")).select("conv_id", "turn", *_hash(F.col("p")))
    first = said.groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("said_turn"))
    found, inner = None, base.where(F.col("text").contains(">"))
    for level in count(1):
        inner = stored(inner.select("conv_id", "turn", F.explode(quoted_blocks(F.col("text"))).alias("text")), "quotes")
        if inner.isEmpty():
            break
        block = inner.select("conv_id", "turn", F.lit(level).alias("level"), own_text(F.col("text")).alias("own"))
        at = block.select("conv_id", "turn", "level", F.xxhash64("own").alias("block"), F.inline(_quoted_parts(F.col("own")))).select("conv_id", "turn", "level", "block", "rank", "para", *_hash(F.col("p")))
        found = at if found is None else found.unionByName(at)
        inner = inner.where(F.col("text").contains(">"))
    if found is None:
        return messages.sparkSession.createDataFrame([], "conv_id long, turn long, level int, said_turn long")
    block = ["conv_id", "turn", "level", "block"]
    known = found.distinct().join(first, ["conv_id", "h1", "h2"]).where("said_turn < turn")
    least = lambda *keys: F.min("rank").over(Window.partitionBy(*keys))
    known = known.withColumns({"whole": least(*block), "coarsest": least(*block, "para")})
    return known.where("rank = 0 or (whole > 0 and rank = coarsest)").select("conv_id", "turn", "level", "said_turn").distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, root, depth)`` from ``(conv_id, turn, up)`` with up < turn, by doubling the pointers."""
    now = stored(parents.select("conv_id", "turn", "up", F.lit(1).alias("depth")), "replies")
    while True:
        ahead = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        now_ = now.join(ahead, ["conv_id", "up"], "left")
        new = stored(now_.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")), "replies")
        if new.where("moved").isEmpty():
            return new.select("conv_id", "turn", F.col("up").alias("root"), "depth")
        now = new.drop("moved")


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per message: ``(conv_id, turn, role, text, reply_to, thread, depth, place)``.

    ``text`` is the message without quoted lines; ``reply_to`` the turn it answers
    (null if it quotes nothing known), ``thread`` the first turn of its chain of
    replies, ``depth`` its distance from there, ``place`` its number from 0 in the
    thread in order of turns, in which a reply always follows what it answers.

    Null texts come out empty; rows with a null conversation or turn get no reply
    and are placed with equal ones; rows that repeat a turn share its reply and
    follow one another by role and text; other columns are ignored. Quotes of
    later turns or of other conversations link nothing.
    """
    base = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    shallowest = F.max(F.struct((-F.col("level")).alias("up_to"), "said_turn"))["said_turn"]
    links = stored(quotation_links(base).groupBy("conv_id", "turn").agg(shallowest.alias("up")), "links")
    clean = base.select("conv_id", "turn", "role", F.coalesce(own_text(F.col("text")), F.lit("")).alias("text"))
    if links.isEmpty():
        told = clean.select("*", F.lit(None).cast("long").alias("reply_to"), F.col("turn").alias("thread"), F.lit(0).alias("depth"))
    else:
        chains = links.join(_roots(links), ["conv_id", "turn"])
        told = clean.join(chains, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "text", F.col("up").alias("reply_to"), F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
    told = told.withColumn("part", F.floor(F.col("turn") / SLICE))
    thread = ["conv_id", "thread"]
    sizes = told.groupBy(*thread, "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*thread).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in [*thread, "part"]], before.alias("start"))
    same = [told[c].eqNullSafe(starts[f"_{c}"]) for c in [*thread, "part"]]
    within = F.row_number().over(Window.partitionBy(*thread, "part").orderBy("turn", "role", "text")) - 1
    return told.join(starts, same).withColumn("place", (F.col("start") + within).cast("long")).select("conv_id", "turn", "role", "text", "reply_to", "thread", "depth", "place")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
