"""Seeded random order, dense positions and exact per-group cut-offs without a global window.

A row's place in a seeded order is md5(seed, key). Rows are counted per leading hash
digits first; only that small count table is summed up in order. Ranking then happens
inside one hash bucket at a time, so neither a big source nor the whole table ever has
to be sorted by a single task. `key` must identify a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import as_column

# 16**4 hash buckets: a source of 10^11 rows leaves about 1.5 million rows per bucket.
BUCKET_DIGITS = 4


def order_key(seed: int, *keys: Column | str) -> Column:
    """Hash that puts rows in a fixed pseudo-random order."""
    parts = [as_column(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def _bucket(seed: int, key: str) -> Column:
    return F.substring(order_key(seed, key), 1, BUCKET_DIGITS)


def bucket_sizes(df: DataFrame, key: str, seed: int, by: str | None = None) -> DataFrame:
    """Rows (`_n`) per group and hash bucket: the one count that all else is derived from.

    Several uses in one plan share its shuffle.
    """
    group = [by] if by else []
    hashed = df.select(*group, _bucket(seed, key).alias("_bucket"))
    return hashed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))


def bucket_offsets(df: DataFrame, key: str, seed: int, by: str | None = None) -> DataFrame:
    """Per group and bucket the rows in it (`_n`), in front of it (`_offset`), and in the whole
    group (`_all`).

    The counts are used once, so they are in a plan once. They are gathered by block (the upper
    two digits, 256 buckets at most), and the blocks of a group in one row (256 at most), where
    each block learns what the earlier ones hold; inside a block the sum runs over its buckets.
    """
    group = [by] if by else []
    counts = bucket_sizes(df, key, seed, by).withColumn("_block", F.substring("_bucket", 1, 2))
    blocks = counts.groupBy(*group, "_block").agg(
        F.collect_list(F.struct("_bucket", "_n")).alias("_buckets"), F.sum("_n").alias("_in")
    )
    gathered = blocks.groupBy(*group).agg(F.collect_list(F.struct("_block", "_buckets", "_in")).alias("_blocks"))
    total = lambda chosen: F.aggregate(chosen, F.lit(0).cast("bigint"), lambda n, b: n + b["_in"])

    def told(block: Column) -> Column:
        lower = F.filter("_blocks", lambda other: other["_block"] < block["_block"])
        return F.struct(
            block["_block"].alias("_block"), total(lower).alias("_base"), total(F.col("_blocks")).alias("_all"),
            block["_buckets"].alias("_buckets"),
        )

    each = gathered.select(*group, F.inline(F.transform("_blocks", told))).repartition(*group, "_block")
    earlier = (
        Window.partitionBy(*group, "_block")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    return each.select(*group, "_block", "_base", "_all", F.inline("_buckets")).select(
        *group, "_bucket", "_n", (F.col("_base") + inside).alias("_offset"), "_all"
    )


def dense_position(
    df: DataFrame, key: str, seed: int, name: str = "position", by: str | None = None
) -> DataFrame:
    """Add 0-based positions in the seeded order, of the table or of each group `by`.

    One shuffle of the rows, by hash bucket. The bucket offsets are joined without moving
    the rows again: of a whole table they are at most 16^4 rows and broadcast, those of
    groups are joined on the key by which the rows are already placed.
    """
    group = [by] if by else []
    cell = [*group, "_bucket"]
    hashed = df.withColumn("_h", order_key(seed, key)).withColumn("_bucket", _bucket(seed, key))
    offsets = bucket_offsets(df, key, seed, by).drop("_n", "_all")
    if not by:
        offsets = F.broadcast(offsets)
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_h"))
    return (
        hashed.withColumn("_rank", rank)
        .join(offsets, cell)
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_h", "_bucket", "_rank", "_offset")
    )


def hash_cutoffs(
    df: DataFrame, key: str, seed: int, wanted: DataFrame | int, by: str | None = None
) -> DataFrame:
    """The hash (`_cut`) of the k-th row in seeded order, of the table or of each group.

    `wanted` is k, or a table (`by`, `_k`) with one row per named group, small by
    construction and therefore broadcast. Where k is 0 or above the size there is no row.
    """
    counts = bucket_offsets(df, key, seed, by)
    if isinstance(wanted, int):
        counts = counts.withColumn("_k", F.lit(wanted).cast("bigint"))
    else:
        counts = counts.join(F.broadcast(wanted), by)
    boundary = counts.filter(
        (F.col("_offset") < F.col("_k")) & (F.col("_k") <= F.col("_offset") + F.col("_n"))
    ).withColumn("_rest", F.col("_k") - F.col("_offset"))
    return ranked_hashes(df, key, seed, boundary.select(*([by] if by else []), "_bucket", "_rest"), by)


def ranked_hashes(df: DataFrame, key: str, seed: int, places: DataFrame, by: str | None = None) -> DataFrame:
    """The hash (`_cut`) at place `_rest` (from 1) of a bucket, for one place per group.

    `places` (`by`, `_bucket`, `_rest`, and columns that stay) is small by construction and
    broadcast. Only the rows of one bucket per group are ranked, on two narrow columns.
    """
    group = [by] if by else []
    cell = [*group, "_bucket"]
    hashed = df.select(*group, order_key(seed, key).alias("_h"), _bucket(seed, key).alias("_bucket"))
    order = Window.partitionBy(*cell).orderBy("_h")
    # A key that two rows share would let more than k rows pass the cut.
    shared = F.raise_error(F.lit(f"{key} does not identify a row")).cast("string")
    cut = F.when(F.col("_next") == F.col("_h"), shared).otherwise(F.col("_h"))
    rest = [c for c in places.columns if c not in (*cell, "_rest")]
    return (
        hashed.join(F.broadcast(places), cell)
        .withColumn("_rank", F.row_number().over(order))
        .withColumn("_next", F.lead("_h").over(order))
        .filter(F.col("_rank") == F.col("_rest"))
        .select(*group, *rest, cut.alias("_cut"))
    )
