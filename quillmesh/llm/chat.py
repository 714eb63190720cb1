"""Chat formatting: keep the longest of logged snapshots of a conversation, then render.

A chat service that logs the whole history with every answer leaves conversations that are
prefixes of longer ones. Each turn gets a rolling hash of all turns up to it; a
conversation whose last hash occurs inside a longer one is a snapshot and goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Turns per block. A conversation is worked on in blocks, so that one of any length is spread
# over tasks; nearly all have one block.
BLOCK = 256
# Turn numbers per cell, and the leading bits of the hash that part the turns of one number:
# places are found by counts per cell, number and slot.
CELL = 256
SLOT_BITS = 12
TURN = ["_c", "_cell", "_t", "_l1", "_l2"]
SLOT = ["_c", "_cell", "_t", "_slot"]


def _turns(df: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("_c"),
        # Turns without a number come last.
        F.coalesce(F.floor(F.col("turn") / F.lit(CELL)), F.lit(2**62)).cast("bigint").alias("_cell"),
        F.coalesce("turn", F.lit(0)).alias("_t"),
        "conv_id", role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(1), role, text).alias("_l1"),
        F.xxhash64(F.lit(2), text, role).alias("_l2"),
    )


def _groups(turns: DataFrame) -> DataFrame:
    """One row per turn that differs from the others of its conversation, and how often it
    is there (`_m`): repeated rows meet as partial aggregates. Texts are not moved."""
    return turns.groupBy(*TURN).agg(F.count(F.lit(1)).alias("_m")).withColumn(
        "_slot", F.shiftright("_l1", 64 - SLOT_BITS)
    )


def _starts(groups: DataFrame) -> DataFrame:
    """Per slot the turns of the conversation in front of it (`_start`), and `n_turns`."""
    slots = groups.groupBy(*SLOT).agg(F.sum("_m").alias("_n"))
    earlier = Window.partitionBy("_c").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = slots.groupBy("_c", "_cell").agg(F.sum("_n").alias("_all")).select(
        "_c", "_cell", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_all").over(Window.partitionBy("_c")).alias("n_turns"),
    )
    inside = Window.partitionBy("_c", "_cell").orderBy("_t", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(cells, ["_c", "_cell"]).select(
        *SLOT, (F.col("_before") + F.col("_inside")).alias("_start"), "n_turns"
    )


def _pieces(groups: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """The places of each turn, block by block: from `_from` (counted from 0) up to `_to`."""
    inside = Window.partitionBy(*SLOT).orderBy("_l1", "_l2").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_m").over(inside), F.lit(0))
    placed = groups.join(starts, SLOT).withColumn("_first", first).withColumn("_end", F.col("_first") + F.col("_m"))
    blocks = F.sequence(F.floor(F.col("_first") / block), F.floor((F.col("_end") - 1) / block))
    return (
        placed.withColumn("segment", F.explode(blocks))
        .withColumn("_from", F.greatest("_first", F.col("segment") * block))
        .withColumn("_to", F.least("_end", (F.col("segment") + 1) * block))
        .drop("_slot", "_m", "_start", "_first", "_end")
    )


def _prefixes(groups: DataFrame, block: int) -> DataFrame:
    """Per turn its number of turns up to it (`length`) and the hash of that prefix.

    The hash is the XOR of the hashes of (place, turn) in two lanes of 64 bits. XOR adds up
    over blocks, so no task needs a whole conversation. Texts are not moved, only hashes.
    """
    rolling = Window.partitionBy("_c", "segment").orderBy("length")
    pieces = _pieces(groups, _starts(groups), block).repartition("_c", "segment")
    inside_block = (
        pieces.withColumn("length", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))))
        .withColumns({f"_h{i}": F.xxhash64("length", f"_l{i}") for i in (1, 2)})
        .select("_c", "segment", "length", "n_turns", *[F.bit_xor(f"_h{i}").over(rolling).alias(f"_x{i}") for i in (1, 2)])
    )
    # The last prefix of a block is the XOR of the block; earlier blocks add theirs. Only
    # conversations of several blocks have such rows.
    tails = inside_block.filter((F.col("length") == (F.col("segment") + 1) * block) & (F.col("length") < F.col("n_turns")))
    later = Window.partitionBy("_c").orderBy("segment")
    bases = tails.select(
        "_c", (F.col("segment") + 1).alias("segment"),
        *[F.bit_xor(f"_x{i}").over(later).alias(f"_base{i}") for i in (1, 2)],
    )
    joined = inside_block.join(bases, ["_c", "segment"], "left")
    return joined.select(
        "_c", "length", "n_turns",
        *[
            F.col(f"_x{i}").bitwiseXOR(F.coalesce(f"_base{i}", F.lit(0))).alias(f"_p{i}")
            for i in (1, 2)
        ],
    )


def maximal(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """The conversations that are no proper prefix of another: `_c`, copies.

    Of conversations with equal turns that with the smallest id stays; `copies` counts them.
    """
    turns = _turns(df)
    prefixes = _prefixes(_groups(turns), block)
    key = ["length", "_p1", "_p2"]
    ended = prefixes.filter(F.col("length") == F.col("n_turns"))
    ids = turns.select("_c", "conv_id").groupBy("_c").agg(F.min("conv_id").alias("conv_id"))
    # Equal conversations and shared prefixes meet as partial aggregates, one row per key
    # and task, so that a common first turn or conversation is no hot key of the join.
    full = (
        ended.join(ids, "_c")
        .groupBy(*key)
        .agg(
            F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "_c")).alias("_first"),
            F.count(F.lit(1)).alias("copies"),
        )
    )
    inner = prefixes.filter(F.col("length") < F.col("n_turns")).select(*key).distinct()
    return full.join(inner, key, "left_anti").select(F.col("_first")["_c"].alias("_c"), "copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_chats(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Collapse snapshots and render what is left as training text.

    Input: conv_id, turn, role, text; more columns are ignored. A conversation is a prefix
    of another if its (role, text) pairs in the order of `turn` are the first ones of the
    other; of equal conversations the smallest id stays. Returns conv_id, segment, n_turns,
    copies, text: one row per conversation and block of 256 turns, so that no row grows
    with the longest conversation, whatever its turn numbers; segments count from 0 and follow each other.

    NULL roles and texts are empty; turns without a number come last; turns of one number
    are ordered by a hash of their content; repeated turns count each time; rows without
    conv_id form one conversation (a NULL id comes after all others). An empty table gives
    no rows.
    """
    turns = _turns(df)
    groups = _groups(turns)
    kept = _starts(groups).join(maximal(df, block), "_c")
    texts = turns.groupBy(*TURN).agg(F.first("conv_id").alias("conv_id"), F.first(rendered(F.col("role"), F.col("text"))).alias("text"))
    piece = F.struct("_from", F.repeat("text", (F.col("_to") - F.col("_from")).cast("int")).alias("text"))
    return (
        _pieces(groups, kept, block).join(texts, TURN)
        .groupBy("_c", "conv_id", "segment", "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(piece)).alias("_pieces"))
        .select(
            "conv_id", F.col("segment").cast("int").alias("segment"), "n_turns", "copies",
            F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("text"),
        )
    )
