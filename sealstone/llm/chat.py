"""Chat formatting with collapse of cumulative snapshots.

Chat logs often hold a conversation once after each turn. A conversation is
dropped if its turns are the first turns of a longer one, or all turns of an
equal one with a smaller id; what stays is rendered with a chat template.

Each turn adds a hash of its number, role and text to a running sum, so the
sums are prefix hashes: four sums of 32-bit parts of two 64-bit hashes, which
don't overflow. Running sums stream over the turns of a conversation in order
and are taken in blocks of turns first, so a conversation that holds a large
part of all rows is spread over tasks. A conversation is a snapshot if its
last prefix hash is an inner prefix hash of another: an anti-join of one row
per conversation with the distinct inner prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BLOCK = 4096
LANES = ("a", "b", "c", "d")


def segment(role: Column, text: Column) -> Column:
    """One rendered turn; markers inside a text are broken up so that it can't end its turn."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", r"<| $1 |>")
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, last, a, b, c, d): prefix hashes of each conversation after its n-th turn."""
    role, text = F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.floor(F.col("turn") / BLOCK).alias("block"))
    # Texts meet once, to order turns of one number; from here on there are only their hashes.
    inside = F.row_number().over(W.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    rows = rows.select("conv_id", "block", inside.alias("inside"), F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("g"), "text", "role").alias("y"))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("count"))
    before = F.coalesce(F.sum("count").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("count").over(W.partitionBy("conv_id"))
    starts = blocks.select(F.col("conv_id").alias("c_id"), F.col("block").alias("c_block"), before.alias("before"), total.alias("total"))
    same = rows.conv_id.eqNullSafe(starts.c_id) & rows.block.eqNullSafe(starts.c_block)
    numbered = rows.join(starts, same).drop("c_id", "c_block").withColumn("n", F.col("before") + F.col("inside"))
    h, g = F.xxhash64("n", "x", "y"), F.xxhash64("y", "n", "x")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    numbered = numbered.select(
        "conv_id", "block", "n", F.col("total"), low(h).alias("a"), F.shiftrightunsigned(h, 32).alias("b"), low(g).alias("c"), F.shiftrightunsigned(g, 32).alias("d"),
    )
    sums = numbered.groupBy("conv_id", "block").agg(*(F.sum(x).alias(x) for x in LANES))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col("conv_id").alias("c_id"), F.col("block").alias("c_block"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}0") for x in LANES))
    running = W.partitionBy("conv_id", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    local = numbered.select("conv_id", "block", "n", "total", *(F.sum(x).over(running).alias(x) for x in LANES))
    same = local.conv_id.eqNullSafe(base.c_id) & local.block.eqNullSafe(base.c_block)
    return local.join(base, same).select("conv_id", "n", (F.col("n") == F.col("total")).alias("last"), *((F.col(x) + F.col(f"{x}0")).alias(x) for x in LANES))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): the conversations that stay, and how many equal ones each stands for."""
    marks = scratch(prefixes(turns.select("conv_id", "turn", "role", "text")), "chat")
    whole = marks.where("last").groupBy("n", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = marks.where("not last").select("n", *LANES).distinct()
    return whole.join(inner, ["n", *LANES], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, segment) for the turns of maximal conversations: the streaming form, a row a turn."""
    keep = maximal(turns).select(F.col("conv_id").alias("kept_id"))
    return turns.join(keep, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi").select("conv_id", "turn", segment(F.col("role"), F.col("text")).alias("segment"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, rendered: one row for each maximal conversation.

    Turns go by number, then role and text; a null text is an empty turn, a
    null role an empty role, and for comparison null and empty differ. Rows of
    null conv_id form one conversation, and rows of null turn come first.
    Repeated rows are turns of their own. An empty table gives no rows; other
    columns are not read. The one string that a conversation becomes is built
    in one task, as the result asks for it; `segments` avoids that.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    keep = scratch(maximal(turns), "chat_kept").withColumnRenamed("conv_id", "kept_id")
    rows = turns.join(keep, turns.conv_id.eqNullSafe(keep.kept_id))
    made = F.struct("turn", F.coalesce("role", F.lit("\0")).alias("role"), F.coalesce("text", F.lit("\0")).alias("text"), segment(F.col("role"), F.col("text")).alias("s"))
    listed = rows.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(made)).alias("t"))
    return listed.select("conv_id", "n_turns", "copies", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("rendered"))
