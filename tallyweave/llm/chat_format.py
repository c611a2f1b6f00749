"""Chat formatting: collapse cumulative snapshots of conversations, then render.

A log that stores a conversation anew after each turn holds every prefix of it.
Hashes of turn prefixes find the conversations that are a proper prefix of another;
an anti-join keeps the others, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm._shared import Scratch, running_sums

#: Turns of a part of a rendered conversation.
PART = 256
#: A turn: opening mark, role, text, closing mark.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_SUMS = ("h1", "h2", "h3")


def _turn_hashes(place: Column) -> list[Column]:
    """Three 40-bit whole numbers from the md5 of a turn and its place. Their sums
    over a prefix identify it: 120 bits, and no overflow below 2**23 turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marks = F.concat(F.when(F.isnull("role"), "n").otherwise("r"), F.when(F.isnull("text"), "n").otherwise("t"))
    digest = F.md5(F.concat_ws("|", place.cast("string"), marks, F.length(role).cast("string"), role, text).cast("binary"))
    return [F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("long").alias(_SUMS[i]) for i in range(3)]


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place (from 0) and the rolling hash of the turns up to it.

    Order: turn, nulls first, then role, then text. A conversation of very many turns
    is summed in blocks of turn numbers, so that it does not fall to one task; rows of a
    conversation that share a turn number, or have none, are one block. Rows with a null conv_id belong to no conversation and are left out.
    """
    known = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    blocks = known.withColumn("block", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62))).cast("long")).withColumn("one", F.lit(1).cast("long"))
    placed = running_sums(blocks, ["conv_id"], "block", ["turn", "role", "text"], {"one": "place"})
    hashed = placed.select("conv_id", "turn", "role", "text", "place", *_turn_hashes(F.col("place"))).withColumn("block", F.floor(F.col("place") / PART))
    rolled = running_sums(hashed, ["conv_id"], "block", ["place"], {h: f"{h}_before" for h in _SUMS})
    return rolled.select("conv_id", "turn", "role", "text", "place", *((F.col(f"{h}_before") + F.col(h)).alias(h) for h in _SUMS))


def render_turn() -> Column:
    """A turn in the chat format; a null role or text renders as empty."""
    return F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))


def maximal_conversations(turns: DataFrame, spark: SparkSession) -> DataFrame:
    """``conv_id``, ``n_turns``, ``part``, ``rendered``: the conversations that are
    not a proper prefix of another, in the chat format, in parts of ``PART`` turns
    (nearly all have one). Of equal conversations the smallest conv_id stays.

    Null roles and texts differ from empty ones in comparisons and render like them. Turns of
    one number, or of none, come by role, then text; repeated rows are turns of their own. Texts
    of any length are rendered whole. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "chat")
    rolled = scratch.hold(prefixes(turns))
    sizes = rolled.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    marked = scratch.hold(rolled.join(sizes, "conv_id").select("conv_id", "place", "n_turns", *_SUMS))
    whole = marked.filter("place = n_turns - 1").groupBy("n_turns", *_SUMS).agg(F.min("conv_id").alias("conv_id"))
    inner = marked.filter("place < n_turns - 1").select((F.col("place") + 1).alias("n_turns"), *_SUMS).distinct()
    kept = scratch.keep(whole.join(inner, ["n_turns", *_SUMS], "left_anti").select("conv_id", "n_turns"), "kept")
    parts = (
        rolled.join(kept, "conv_id")
        .withColumn("part", F.floor(F.col("place") / PART).cast("int"))
        .groupBy("conv_id", "n_turns", "part")
        .agg(F.sort_array(F.collect_list(F.struct("place", render_turn().alias("shown")))).alias("turns"))
    )
    return parts.select("conv_id", "n_turns", "part", F.array_join(F.col("turns.shown"), "").alias("rendered"))

