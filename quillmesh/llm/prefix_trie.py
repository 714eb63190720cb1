"""Conversation prefix trie: conversations that share their first turns, as nodes of a tree.

Identical conversations are collapsed into one weighted sequence with the list of those that
end there. Sequences that are proper prefixes of others go by an anti-join, which leaves the
leaves; every prefix of the sequences left over from the collapse is a node, and what a node
says about its subtree is a sum over the sequences through it. No step walks the tree, so its
depth costs no rounds, and every sum has partial aggregates, so that a first turn that a third
of all conversations share is one row per task.

Turns and prefixes are told apart by two hashes of 64 bits; texts are not moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.joins import salted_join
from quillmesh.llm.common import parts, stored

# Turns per block of a long conversation, and ids per piece of a list of ends.
BLOCK = 256
IDS = 4096
NODE = ["depth", "_x1", "_x2"]
PARENT = ["_up", "_p1", "_p2"]


def numbered(df: DataFrame) -> DataFrame:
    """`conv_id`, `place` (from 0 in the order of `turn`), the hashes of the turn, `bytes` of
    its text, and `n_turns`.

    Rows are dealt by ranges of (conversation, turn, hashes) and numbered where they lie, so a
    conversation of any length is spread over tasks; what stands in front of a piece of a
    conversation is a sum over its pieces, one per partition at most.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = df.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.xxhash64(F.lit(1), role, text).alias("_l1"), F.xxhash64(F.lit(2), text, role).alias("_l2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "_l1", "_l2"]
    # Rows repeated in full are equal in all keys; where they stood deals them out.
    dealt = turns.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts(df), *order, "_at")
    sorted_ = stored(
        dealt.sortWithinPartitions(*order).select(
            "conv_id", "_l1", "_l2", "bytes",
            F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_part"),
        ),
        "turns",
    )
    pieces = sorted_.groupBy("conv_id", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "conv_id", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("n_turns"),
    )
    return sorted_.join(starts, ["conv_id", "_part"]).select(
        "conv_id", (F.col("_before") + F.col("_at") - F.col("_first")).alias("place"), "_l1", "_l2", "bytes", "n_turns"
    )


def share_heads(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Give every conversation c the first h turns of conversation c - c % family, then its own
    after the first h, with h = crc32(decimal c) % (most + 1).

    Returns the turns (as of `numbered`) and the ids of all conversations, also of those left
    without turns.
    """
    conv = F.col("conv_id")
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % (most + 1)
    base = lambda c: c - c % family
    sizes = turns.groupBy("conv_id").agg(F.first("n_turns").alias("_n"))
    bases = sizes.filter(conv % family == 0).select(conv.alias("_base"), F.col("_n").alias("_base_n"))
    plans = (
        sizes.withColumn("_base", base(conv)).join(bases, "_base", "left")
        .select("conv_id", "_base", head(conv).alias("_h"), F.least(head(conv), F.coalesce("_base_n", F.lit(0))).alias("_given"))
    )
    # At most `most` turns of a conversation are given, each to less than 2 * family others.
    given = turns.filter((conv % family == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "_base")
    taken = plans.join(given, "_base").filter(F.col("place") < F.col("_h"))
    own = turns.filter(F.col("place") >= head(conv)).join(plans, "conv_id")
    columns = ["_l1", "_l2", "bytes"]
    rebuilt = taken.select("conv_id", "place", *columns).unionByName(
        own.select("conv_id", (F.col("_given") + F.col("place") - F.col("_h")).alias("place"), *columns)
    )
    return rebuilt, plans.select("conv_id")


def _prefixes(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Every prefix of every conversation, the empty one too: `depth`, its hash in two lanes
    (`_x`), that of the prefix one shorter (`_p`), the `bytes` of its last text and of all its
    texts (`_sum`).

    The hash is the XOR of the hashes of (place, turn). XOR and bytes add up over blocks, so no
    task needs a whole conversation.
    """
    inside = Window.partitionBy("conv_id", "_block").orderBy("place")
    lanes = {f"_h{i}": F.xxhash64("place", f"_l{i}") for i in (1, 2)}
    rolling = (
        turns.withColumn("_block", F.floor(F.col("place") / block)).withColumns(lanes)
        .withColumns({f"_x{i}": F.bit_xor(f"_h{i}").over(inside) for i in (1, 2)})
        .withColumn("_sum", F.sum("bytes").over(inside))
    )
    totals = rolling.filter((F.col("place") + 1) % block == 0)  # only of conversations beyond one block
    later = Window.partitionBy("conv_id").orderBy("_block")
    bases = totals.select(
        "conv_id", (F.col("_block") + 1).alias("_block"),
        *[F.bit_xor(f"_x{i}").over(later).alias(f"_b{i}") for i in (1, 2)],
        F.sum("_sum").over(later).alias("_b"),
    )
    zero = F.lit(0).cast("bigint")
    full = lambda i: F.col(f"_x{i}").bitwiseXOR(F.coalesce(f"_b{i}", zero))
    named = rolling.join(bases, ["conv_id", "_block"], "left").select(
        "conv_id", (F.col("place") + 1).alias("depth"),
        full(1).alias("_x1"), full(2).alias("_x2"),
        full(1).bitwiseXOR(F.col("_h1")).alias("_p1"), full(2).bitwiseXOR(F.col("_h2")).alias("_p2"),
        "bytes", (F.col("_sum") + F.coalesce("_b", zero)).alias("_sum"), "_l1", "_l2",
    )
    root = convs.select("conv_id", *[zero.alias(c) for c in named.columns[1:]])
    return named.unionByName(root)


def _sequences(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct whole sequences: `conv_id` (the smallest), `weight`, `_total` bytes and
    whether it is a `leaf`; and where each conversation ends."""
    last = F.max(F.struct(*NODE, "_sum")).alias("_last")
    ends = stored(
        prefixes.groupBy("conv_id").agg(last).select("conv_id", *[F.col("_last")[c].alias(c) for c in (*NODE, "_sum")]),
        "trie-ends",
    )
    collapsed = ends.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("_sum").alias("_total")
    )
    return collapsed, ends


def _ends(ends: DataFrame) -> DataFrame:
    """`ends_sha256` of the comma-joined ids, in rising order, of the conversations that end at a node.

    Ids are joined in pieces of one range of ids, which holds 4,096 at most; the pieces of a
    node pass through the hash one after the other. A list of any length is never held.
    """
    lists = (
        ends.groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("_range"))
        .agg(F.array_sort(F.collect_set("conv_id")).alias("_ids"))
        .select(*NODE, "_range", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("_ids"))
    )
    schema = "depth bigint, _x1 bigint, _x2 bigint, ends_sha256 string"
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "_range").mapInArrow(_hash_lists, schema)


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, hashed, done = None, None, []
    for batch in batches:
        rows = batch.to_pydict()
        for *node, ids in zip(*[rows[c] for c in NODE], rows["_ids"]):
            if node == now:
                hashed.update(b",")
            else:
                done += [(*now, hashed.hexdigest())] if now else []
                now, hashed = node, hashlib.sha256()
            hashed.update(ids.encode())
        if done:
            yield _rows(done)
            done = []
    if now:
        yield _rows([(*now, hashed.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())],
        names=[*NODE, "ends_sha256"],
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations, with what their subtrees share.

    `turns` has conv_id, place (from 0, without gaps), `_l1`, `_l2` (hashes of the turn) and
    bytes, as `numbered` or `share_heads` give them; `convs` has the conv_id of every
    conversation, also of those without turns. Returns per distinct sequence of first turns:
    conv_id (smallest member), depth, parent_conv_id (that of the sequence one turn shorter,
    NULL for the empty one), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    hashes `_l1`, `_l2` of its last turn (for `with_turns`).

    Of a subtree's nodes each is owned by its smallest member. The nodes a sequence owns are
    the last ones of its path, so the bytes of the distinct nodes below a node are the bytes
    that the sequences through it own, but for the node's own owner, all of whose path from
    the node on counts. No conversations give no rows.
    """
    prefixes = stored(_prefixes(turns, convs, block), "trie-prefixes")
    sequences, ends = _sequences(prefixes)
    collapsed = prefixes.join(sequences.select("conv_id", "weight", "_total", F.col("depth").alias("_length")), "conv_id")
    kept = stored(collapsed, "trie-weighted")
    # A whole sequence that is a proper prefix of another one is no leaf.
    inner = kept.filter(F.col("depth") < F.col("_length")).select(*NODE).distinct()
    leaves = kept.filter(F.col("depth") == F.col("_length")).join(inner, NODE, "left_anti")
    below = kept.join(leaves.select("conv_id", F.lit(1).cast("bigint").alias("_leaf")), "conv_id", "left")

    rest = F.col("_total") - F.col("_sum") + F.col("bytes")  # bytes from the node's turn to the end
    nodes = stored(
        below.groupBy(*NODE).agg(
            F.min(F.struct("conv_id", rest.alias("rest"))).alias("_owner"), F.sum("weight").alias("n_convs"),
            F.sum(F.coalesce("_leaf", F.lit(0))).alias("n_leaves"), F.sum(F.col("weight") * rest).alias("_all"),
            *[F.first(c).alias(c) for c in ("bytes", "_p1", "_p2", "_l1", "_l2")],
        ).withColumn("conv_id", F.col("_owner.conv_id")),
        "trie-nodes",
    )
    owned = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("_owned"))
    unique = kept.join(owned, "conv_id", "left").withColumn("_owned", F.coalesce("_owned", F.lit(0))).groupBy(*NODE).agg(
        F.sum("_owned").alias("_owned"), F.min(F.struct("conv_id", "_owned")).alias("_first")
    )
    once = F.col("_owned") - F.col("_first._owned") + F.col("_owner.rest")

    above = (F.col("depth") - 1).alias("_up")
    children = nodes.filter("depth > 0").groupBy(above, "_p1", "_p2").agg(F.count(F.lit(1)).alias("n_children"))
    as_node = [F.col(a).alias(b) for a, b in zip(PARENT, NODE)]
    as_parent = [F.col(b).alias(a) for a, b in zip(PARENT, NODE)]
    # A node may have a third of all nodes as children.
    parents = salted_join(
        nodes.filter("depth > 0").select(*NODE, above, "_p1", "_p2"),
        nodes.select(*as_parent, F.col("conv_id").alias("parent_conv_id")),
        PARENT, "_x1", "left", children.withColumnRenamed("n_children", "_rows"),
    ).select(*NODE, "parent_conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(unique, NODE)
        .join(children.select(*as_node, "n_children"), NODE, "left")
        .join(parents, NODE, "left")
        .join(_ends(ends), NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves", (F.col("_all") - once).alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"), "_l1", "_l2",
        )
    )


def with_turns(nodes: DataFrame, df: DataFrame) -> DataFrame:
    """Nodes with `role` and `text` of their last turn (the root has NULL)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lanes = [F.xxhash64(F.lit(1), role, text).alias("_l1"), F.xxhash64(F.lit(2), text, role).alias("_l2")]
    turns = df.select(*lanes, role.alias("role"), text.alias("text")).groupBy("_l1", "_l2").agg(
        F.first("role").alias("role"), F.first("text").alias("text")
    )
    below = nodes.filter("depth > 0").join(turns, ["_l1", "_l2"], "left")
    empty = F.lit(None).cast("string")
    return below.unionByName(nodes.filter("depth = 0").withColumns({"role": empty, "text": empty})).drop("_l1", "_l2")


def shared_prefixes(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the conversations rebuilt by `share_heads`.

    Input: conv_id, turn, role, text; more columns are ignored. NULL roles and texts are empty.
    Turns come in the order of `turn`, those without a number first; turns of one number are
    ordered by hashes of their content; repeated rows count each time. Rows without conv_id
    belong to no conversation and go. An empty table gives no rows.
    """
    turns = numbered(df.select("conv_id", "turn", "role", "text"))
    rebuilt, convs = share_heads(turns)
    return prefix_trie(rebuilt, convs, block)
