"""Sharding by rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a pseudo-random score; a record lies in the shard of the
highest score. Another shard can only win records over, so all others stay where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.ordering import dense_position

LAW = "key"
# Added to the bytes of a text, for the record around it.
RECORD_BYTES = 16


def shard_of(key: Column, shards: Sequence[int] | Mapping[int, float]) -> Column:
    """The shard of a record key, of shard ids (equal weights) or of id -> weight.

    The score is -weight / ln(u) with u in (0, 1) from the 64-bit hash of key and shard id,
    so a shard gets records in proportion to its weight. Of equal scores the smaller id
    wins. A NULL key is a key like any other. Weights must be positive.
    """
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1.0)
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards with positive weights are needed")
    equal = len(set(weights.values())) == 1

    def score(shard: int) -> Column:
        # 53 of the bits, in the middle of their step: never 0 or 1.
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(2.0**53)
        # Equal weights: u alone gives the same order.
        return u if equal else -F.lit(float(weights[shard])) / F.log(u)

    scored = [F.struct(score(s).alias("score"), F.lit(-s).alias("shard")) for s in weights]
    return (-F.array_max(F.array(*scored))["shard"]).cast("int")


def shard_records(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 0
) -> DataFrame:
    """Place every row in one of `shards` shards and number the rows of each shard.

    Returns the key, `size` (UTF-8 bytes and 16), `text_crc32`, `law`, `shard`, `slot` and
    `grown_shard`, the shard if there were one more. Slots are gapless from 0, in hash order
    of the key and the text. A NULL text has the
    size 16 and the checksum of no bytes; a NULL key is a key like any other; an empty
    table gives no rows; other columns are ignored. Only the narrow rows are shuffled, once
    per hash bucket of a shard, so no shard or source is gathered in one task.
    """
    payload = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    placed = df.select(
        F.col(key).alias("_id"),
        F.xxhash64(payload).alias("_hash"),
        (F.length(payload) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(payload).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        shard_of(F.col(key), range(shards)).alias("shard"),
        shard_of(F.col(key), range(shards + 1)).alias("grown_shard"),
    )
    # Rows that share a key, or have none, are dealt out by their texts too.
    numbered = dense_position(placed.withColumn("_row", F.concat_ws(":", "_id", "_hash")), "_row", seed, name="slot", by="shard")
    return numbered.select(
        F.col("_id").alias(key), "size", "text_crc32", "law", "shard",
        F.col("slot").cast("bigint").alias("slot"), "grown_shard",
    )
