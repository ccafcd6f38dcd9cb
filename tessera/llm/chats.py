"""Chat formatting with collapse of cumulative snapshots (9).

A chat log often holds the same conversation several times, each snapshot a
turn longer.  Every turn gets a rolling hash of the conversation up to it:
the exclusive-or of two 64-bit hashes of (position, role, text), which is a
running sum and so needs no task that holds a whole conversation.  A
conversation whose last hash some other one has before its end is a prefix of
that one; an anti-join leaves the maximal conversations, one of each set of
equal ones, and their turns are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.operators.corpus import grouped_index

#: The markers of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART_TURNS = 16_384


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """Per turn: ``conv``, ``group`` (its key), ``pos`` (from 0), ``role``,
    ``text``, and the hashes ``h1``, ``h2`` of the turns up to it."""
    conv = F.col(conv_col)
    rows = turns.select(
        conv.alias("conv"), F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string"))).alias("group"),
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = grouped_index(rows, ["group"], [F.col("turn"), F.col("role"), F.col("text")], "pos")
    rows = rows.withColumn("part", F.floor(F.col("pos") / PART_TURNS))
    own = [F.xxhash64(F.lit(k), "pos", "role", "text").alias(f"x{k}") for k in (1, 2)]
    rows = stored(rows.select("conv", "group", "part", "pos", "role", "text", *own), "chat-turns")
    parts = rows.groupBy("group", "part").agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("group", "part", *[F.coalesce(F.bit_xor(f"p{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    inside = Window.partitionBy("group", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"i{k}": F.bit_xor(f"x{k}").over(inside) for k in (1, 2)}).join(parts, ["group", "part"])
    return rows.select("conv", "group", "pos", "role", "text",
                       *[F.col(f"i{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal(hashes: DataFrame) -> DataFrame:
    """(group, n_turns, copies) of the conversations that stay: those no
    longer one begins with, of equal ones the smallest id (null first)."""
    last = hashes.groupBy("group").agg(F.max(F.struct("pos", "h1", "h2")).alias("l"), F.first("conv").alias("conv"))
    ends = last.groupBy((F.col("l.pos") + 1).alias("n"), F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2")) \
               .agg(F.min(F.struct("conv", "group")).alias("rep"), F.count("*").alias("copies"))
    ends = stored(ends, "chat-ends")
    seen = hashes.groupBy((F.col("pos") + 1).alias("n"), "h1", "h2").agg(F.count("*").alias("times"))
    longer = seen.join(ends, ["n", "h1", "h2"]).filter("times > copies").select("n", "h1", "h2")
    return ends.join(longer, ["n", "h1", "h2"], "left_anti") \
               .select(F.col("rep.group").alias("group"), F.col("n").alias("n_turns"), "copies")


def rendered(role: Column, text: Column) -> Column:
    """A turn in chat markup; markers inside a text are broken by a space."""
    def safe(x: Column) -> Column:
        return F.replace(F.replace(x, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn of each conversation that stays: id, ``pos``,
    ``n_turns``, ``copies`` (equal conversations), ``rendered``.

    Turns are in order of (turn, role, text), nulls first, so gaps and
    repeated turn numbers do no harm; repeated rows are turns of their own.
    Null roles and texts count as empty; rows with a null id are one
    conversation.  An empty table gives no rows.  A conversation's whole
    text is its ``rendered`` values in order of ``pos``: ``whole_chats``.
    """
    h = stored(prefix_hashes(turns, conv_col, turn_col, role_col, text_col), "chat-hashes")
    return h.join(maximal(h), "group").select(
        F.col("conv").alias(conv_col), "pos", "n_turns", "copies", rendered(F.col("role"), F.col("text")).alias("rendered"))


def whole_chats(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, for logs whose conversations fit a row each."""
    turns = chats.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct("pos", "rendered"))).alias("t"))
    return turns.select(conv_col, F.array_join(F.transform("t", lambda t: t["rendered"]), "").alias("chat"))
