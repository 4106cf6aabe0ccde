"""Chat formatting: collapse logged snapshots of growing conversations, then render.

A log that stores a conversation after every turn holds all its prefixes.  Rolling
hashes of the turns name each prefix; a conversation whose own hash is that of a proper
prefix of a longer one goes, and of equal conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 1_024
HASH_BITS = 38    # sums of up to 2**25 turns stay within 63 bits
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
KEYS = ("c", "no_c", "t", "no_t", "h1", "h2")


def _turn_keys() -> list[Column]:
    """A turn's conversation, number, role and text as columns without nulls, so that equality is exact."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("no_c"),
            F.coalesce("turn", F.lit(0)).alias("t"), F.col("turn").isNull().alias("no_t"),
            F.xxhash64(role, text).alias("h1"), F.xxhash64(text, role, F.lit(1)).alias("h2")]


def _later_blocks(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """For blocks behind a conversation's first: the sums of ``values`` over the blocks before.

    The windows see a row for each block.  Conversations of one block, most of them, have
    no row here, so the join with this table is small.
    """
    sums = rows.groupBy("c", "no_c", "block").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    order = Window.partitionBy("c", "no_c").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c", "no_c")
    sums = sums.select("c", "no_c", "block", *[F.sum(k).over(earlier).alias(k) for k in values],
                       F.max("block").over(whole).alias("last_block"), F.min("block").over(whole).alias("first_block"))
    return sums.filter("first_block < last_block").drop("first_block").select(
        F.col("c").alias("lc"), F.col("no_c").alias("ln"), F.col("block").alias("lb"), "last_block",
        *[F.coalesce(k, F.lit(0)).alias(f"{k}_before") for k in values])


def _joined(rows: DataFrame, later: DataFrame) -> DataFrame:
    return rows.join(later, (F.col("c") == F.col("lc")) & (F.col("no_c") == F.col("ln")) & (F.col("block") == F.col("lb")),
                     "left").drop("lc", "ln", "lb")


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, c, no_c, t, no_t, h1, h2, position, p1, p2, last): each turn with its prefix's hashes.

    Turns are ordered by turn (null first), then by the hash of role and text; a turn
    logged twice (same conv_id, turn, role and text) counts once.  Null role or text
    counts as empty, null conv_id as a conversation of its own.  ``last`` marks a
    conversation's last turn.  Positions and prefix sums are taken block-wise, so a
    conversation of any length is spread over tasks; turns that are sparse make small
    blocks, turns without a number share one.  Both tables are stored without texts.
    """
    turns = conversations.select("conv_id", *_turn_keys())
    turns = turns.withColumn("block", F.when(F.col("no_t"), F.lit(-(2 ** 62))).otherwise(F.floor(F.col("t") / BLOCK)))
    turns = turns.dropDuplicates(list(KEYS))       # combined on the map side, so a turn logged often is no hot key
    inside = Window.partitionBy("c", "no_c", "block").orderBy("t", "h1", "h2")
    turns = stored(turns.withColumn("at", F.row_number().over(inside)), "chat-turns")
    rows = _joined(turns, _later_blocks(turns, {"n": F.lit(1)}))
    rows = rows.withColumn("position", F.col("at") + F.coalesce("n_before", F.lit(0)))

    def term(h: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64("position", h), 64 - HASH_BITS)

    later = _later_blocks(rows.drop("last_block", "n_before"), {"p1": term("h1"), "p2": term("h2")})
    block = Window.partitionBy("c", "no_c", "block").orderBy("position")
    rows = rows.drop("last_block", "n_before").select(
        "*", F.sum(term("h1")).over(block).alias("p1"), F.sum(term("h2")).over(block).alias("p2"),
        F.lead("position").over(block).isNull().alias("ends_block"))
    rows = _joined(rows, later)
    return stored(rows.select("conv_id", *KEYS, "position", *[
        (F.col(p) + F.coalesce(f"{p}_before", F.lit(0))).alias(p) for p in ("p1", "p2")],
        (F.col("ends_block") & (F.col("block") == F.coalesce("last_block", "block"))).alias("last")), "chat-prefixes")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with."""
    whole = (prefixes.filter("last").groupBy(F.col("position").alias("n_turns"), "p1", "p2")
                     .agg(F.min(F.struct("conv_id")).alias("first")))
    proper = prefixes.filter("not last").select(F.col("position").alias("n_turns"), "p1", "p2").distinct()
    kept = whole.join(proper, ["n_turns", "p1", "p2"], "left_anti")
    return kept.select(F.col("first.conv_id").alias("conv_id"), "n_turns")


def escaped(text: Column) -> Column:
    """Text in which no control mark of the format can be read."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(F.coalesce(role, F.lit("unknown"))), F.lit("\n"),
                    escaped(F.coalesce(text, F.lit(""))), F.lit(CLOSE), F.lit("\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, position, n_turns, rendered) of the maximal conversations.

    One row per turn, in order of ``position``: their concatenation is the rendered
    conversation, so a conversation of any length needs no single task.  Extra columns
    are not carried; an empty table gives no rows.  A null role renders as ``unknown``.
    """
    prefixes = turn_prefixes(conversations)
    kept = maximal_conversations(prefixes).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("no_c"), "n_turns")
    places = prefixes.join(kept, ["c", "no_c"]).select(*KEYS, "position", "n_turns")
    texts = conversations.select("conv_id", *_turn_keys(), rendered_turn(F.col("role"), F.col("text")).alias("rendered"))
    return (texts.dropDuplicates(list(KEYS)).join(places, list(KEYS))
                 .select("conv_id", "position", "n_turns", "rendered"))
