"""Chat formatting: cumulative-snapshot collapse, then rendering. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns joined into one output row at most; a longer conversation gives several numbered parts.
PART_TURNS = 1000


def turns_in_order(chats: DataFrame) -> DataFrame:
    """(conv_id, k, role, text, h1, h2): turns numbered from 1 by (turn, role, text), each with the
    rolling hash of the turns up to it: the exclusive or of hashes of (number, role, text), which
    a streaming window keeps, in two independent 64-bit halves."""
    rows = chats.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = rows.withColumn("k", F.row_number().over(w))
    w = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.select(
        "conv_id", "k", "role", "text",
        F.bit_xor(F.xxhash64(F.lit(1), "k", "role", "text")).over(w).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "k", "text", "role")).over(w).alias("h2"),
        F.lead("k").over(Window.partitionBy("conv_id").orderBy("k")).isNull().alias("last"),
    )


def maximal_conversations(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no prefix of a longer one; of equal ones, the
    smallest conv_id."""
    turns = turns_in_order(chats)
    whole = turns.where("last").groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = turns.where("not last").select("k", "h1", "h2").distinct()
    return whole.join(prefixes, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").alias("n_turns"))


def render(chats: DataFrame, keep: DataFrame) -> DataFrame:
    """(conv_id, n_turns, part, rendered) of the conversations in keep: each turn as
    <|im_start|>role, a line break, the text, <|im_end|> and a line break."""
    piece = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    rows = turns_in_order(chats).join(keep, "conv_id").select(
        "conv_id", "n_turns", F.floor((F.col("k") - 1) / PART_TURNS).cast("int").alias("part"), F.struct("k", piece.alias("t")).alias("s")
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "")
    return rows.groupBy("conv_id", "n_turns", "part").agg(joined.alias("rendered"))


def format_conversations(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, part, rendered): every maximal conversation, rendered.

    Rows without conv_id belong to no conversation and are left out. A null turn number comes last;
    a null role or text counts as empty; exactly repeated rows count once; turns with equal numbers
    are ordered by role, then text. An empty table gives an empty result; other columns are ignored.
    """
    return render(chats, maximal_conversations(chats))
