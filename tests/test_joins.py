from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import joins
from quillmesh.operators import logic, prompts, scores


@pytest.fixture()
def small_shares(monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 100)


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string"))
    return spark.range(3000).withColumn("k", key)


def test_hot_keys_are_cut_by_their_size(rows, small_shares):
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    (hot,) = joins._hot_keys(counts, ["k"]).collect()
    assert hot._parts == 10


@pytest.mark.parametrize("how, kept", [("inner", 2000), ("left", 3000)])
def test_same_rows_as_a_plain_join(spark, rows, small_shares, how, kept):
    named = rows.select("k").distinct().withColumn("v", F.length("k"))
    named = named.filter("k = 'hot' or k < '25'") if how == "left" else named.filter("k <> 'hot'")
    got = joins.salted_join(rows, named, "k", "id", how)
    plain = rows.join(named, "k", how)
    assert got.count() == kept
    assert Counter(map(str, got.select("k", "id", "v").collect())) == Counter(map(str, plain.select("k", "id", "v").collect()))


def test_many_hot_keys_stay_few(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(joins, "MOST_HOT_KEYS", 10)
    even = spark.range(1000).select((F.col("id") % 40).alias("k"))
    counts = even.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    assert joins._hot_keys(counts, ["k"]).count() <= 10


def test_operators_on_hot_keys(spark, rows, small_shares):
    states = rows.withColumn("s", F.when(F.col("id") % 5 != 0, F.col("id") % 2 == 0))
    closed = logic.always_and_eventually(states, "k", "id", "s").collect()
    assert len(closed) == 3000
    last_true = {}
    for r in states.collect():
        if r.s:
            last_true[r.k] = max(r.id, last_true.get(r.k, -1))
    assert all(r.eventually == (r.s is None or r.id <= last_true.get(r.k, -1)) for r in closed)
    table = rows.select(F.col("k").alias("prompt"), F.col("id").cast("string").alias("completion"), F.col("id").cast("double").alias("score"))
    maps = scores.score_maps(table, entries=50).collect()
    assert sum(len(r.scores) for r in maps) == 3000 and max(len(r.scores) for r in maps) < 120


def test_lookup_with_and_without_broadcast(spark, rows):
    shots = spark.range(6).select(F.lit("hot").alias("k"), "id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("text"))
    wide = prompts.with_few_shot(rows, shots, 3, "k", "id", shuffle=True)
    found = Counter(map(str, wide.select("id", "few_shot").collect()))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sorted_ = prompts.with_few_shot(rows, shots, 3, "k", "id", shuffle=True)
        assert found == Counter(map(str, sorted_.select("id", "few_shot").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_no_job_runs_while_a_plan_is_built(spark, rows):
    shots = spark.range(6).select(F.lit("hot").alias("k"), "id", F.lit("e").alias("text"))
    spark.sparkContext.setJobGroup("building", "")
    prompts.with_few_shot(rows, shots, 3, "k", "id", shuffle=True)
    prompts.with_few_shot(rows, shots, 3, "k", "id")
    tracker = spark.sparkContext.statusTracker()
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("", "")
