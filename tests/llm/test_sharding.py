import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quillmesh.llm import sharding
from quillmesh.llm.queries import QUERIES


def score(key, shard):
    """Spark's hash of two columns: that of the first is the seed of the second."""
    seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed)
    return ((h >> 11) + 0.5) / 2**53


def brute(key, shards):
    return max(range(shards), key=lambda s: (score(key, s), -s))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_sharding"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "key")
        assert r.shard == brute(r.doc_id, 40) and r.grown_shard == brute(r.doc_id, 41)
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_growth_moves_few(spark):
    df = spark.range(20_000).select(*[sharding.shard_of(F.col("id"), range(n)).alias(f"s{n}") for n in (9, 10)])
    moved = df.filter("s9 <> s10")
    assert moved.filter("s10 <> 9").count() == 0
    assert abs(moved.count() - 2000) < 200


def test_weights(spark):
    weights = {3: 1.0, 5: 2.0, 7: 5.0}
    counts = spark.range(40_000).groupBy(sharding.shard_of(F.col("id"), weights).alias("s")).count()
    found = {r.s: r["count"] for r in counts.collect()}
    assert all(abs(found[s] - 5000 * w) < 500 for s, w in weights.items())
    # More weight for one shard moves rows into it only.
    more = spark.range(5000).select(
        sharding.shard_of(F.col("id"), weights).alias("a"), sharding.shard_of(F.col("id"), weights | {5: 3.0}).alias("b")
    )
    assert more.filter("a <> b AND b <> 5").count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), {1: 0.0})


def test_nulls_and_repeats(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (2, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS slot", "0 AS shard", "0 AS size")
    found = sharding.shard_records(df, shards=2).collect()
    assert sorted((r.doc_id or 0, r.size) for r in found) == [(0, 17), (0, 17), (1, 16), (1, 16), (2, 18)]
    for shard in (0, 1):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_records(df.limit(0)).count() == 0


def test_rows_without_key_are_dealt_out(spark):
    """Slots stay gapless where most rows have no key, and their buckets differ by text."""
    rows = [(None, f"text {i}") for i in range(400)] + [(i, "same") for i in range(50)] + [(7, "same")] * 5
    found = sharding.shard_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=4).collect()
    assert len(found) == len(rows)
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
