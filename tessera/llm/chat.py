"""Chat formatting after collapsing cumulative snapshots, with DataFrame functions only.

A logged conversation that is a prefix of a longer one, or the same as one with a smaller id, is a snapshot; only maximal
conversations are rendered. Every turn gets a rolling hash of its whole prefix: the xor of position-salted turn hashes, two
of 64 bits. Prefix hashes are made distinct before they meet the conversations' last hashes in an anti-join, so that a first
turn shared by a third of all conversations is one row of it.

The rolling sums are made in two levels, blocks of BLOCK turns and turns in a block, and a rendered conversation comes in
parts of one block each, so no task or row gathers a conversation of any length.

Defined results: turns are ordered by turn (null first), then role, then text; repeated rows are repeated turns; a null role
or text is the empty string; rows whose conversation id is null form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a block; a conversation of up to so many turns is one rendered row.
BLOCK = 1024


def positioned(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, block, pos (0-based among the conversation's turns), role, text, and the prefix hashes x1 and x2."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.floor(F.col(turn) / BLOCK), F.lit(-(1 << 62))).cast("long").alias("block"))
    sums = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    by_block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("first"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.join(starts, on).withColumn("pos", F.col("first") + F.row_number().over(inner) - 1).drop("c", "b", "first", "turn")
    salted = placed.withColumn("h1", F.xxhash64(F.lit(1), "pos", "role", F.lit("|"), "text")).withColumn("h2", F.xxhash64(F.lit(2), "text", F.lit("|"), "role", "pos"))
    part = salted.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"))
    before = part.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.bit_xor(x).over(by_block), F.lit(0)).cast("long").alias(y) for x, y in (("p1", "s1"), ("p2", "s2"))])
    rolling = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return salted.join(before, on).select("conv_id", "block", "pos", "role", "text", *[F.col(s).bitwiseXOR(F.bit_xor(h).over(rolling)).alias(x) for s, h, x in (("s1", "h1", "x1"), ("s2", "h2", "x2"))])


def maximal(turns: DataFrame) -> DataFrame:
    """positioned() -> conv_id, n_turns, n_copies of each conversation that no other one contains as a prefix."""
    last = turns.groupBy("conv_id").agg(F.max(F.struct("pos", "x1", "x2")).alias("z"))
    ends = last.groupBy("z").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    owned = ends.select("conv_id", "n_copies", F.col("z.pos").alias("pos"), F.col("z.x1").alias("x1"), F.col("z.x2").alias("x2"))
    # prefixes proper to some conversation: all turns but each conversation's last
    z = last.select(F.col("conv_id").alias("c"), F.col("z.pos").alias("end"))
    inner = turns.select("conv_id", "pos", "x1", "x2").join(z, F.col("conv_id").eqNullSafe(F.col("c"))).where(F.col("pos") < F.col("end")).select("pos", "x1", "x2").distinct()
    return owned.join(inner, ["pos", "x1", "x2"], "left_anti").select("conv_id", (F.col("pos") + 1).alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, part, n_parts, rendered: <|role|>, a line break, the text and <|end|> for each turn."""
    turns = positioned(conversations)
    kept = maximal(turns).withColumnRenamed("conv_id", "k")
    chosen = turns.select("conv_id", "pos", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("k"))).withColumn("part", F.floor(F.col("pos") / BLOCK).cast("int"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    return chosen.groupBy("conv_id", "n_turns", "n_copies", "part").agg(F.concat_ws("", lines).alias("rendered")).select("conv_id", "n_turns", "n_copies", "part", F.ceil(F.col("n_turns") / BLOCK).cast("int").alias("n_parts"), "rendered")
