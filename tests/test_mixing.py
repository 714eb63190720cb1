from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import mixing
from quillmesh.plans.registry import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    source = F.when(F.col("id") < 700, "big").when(F.col("id") < 900, "mid").otherwise("small")
    return spark.range(1000).withColumn("source", source).cache()


def sizes(df):
    return Counter(r.source for r in df.collect())


def test_total_repeats_short_sources_and_samples_long_ones(rows):
    mixed = mixing.mix_total(rows, "source", "id", {"big": 0.5, "mid": 0.25, "small": 0.25}, 1000)
    got = mixed.collect()
    assert Counter(r.source for r in got) == {"big": 500, "mid": 250, "small": 250}
    copies = Counter(r.id for r in got if r.source == "small")
    assert set(copies.values()) == {2, 3} and sum(c == 3 for c in copies.values()) == 50
    assert max(Counter(r.id for r in got if r.source == "big").values()) == 1


def test_total_equal_to_and_twice_the_size(rows):
    mixed = mixing.mix_total(rows, "source", "id", {"big": 0.5, "mid": 0.25, "small": 0.25}, 800)
    assert Counter(Counter(r.id for r in mixed.collect() if r.source != "big").values()) == {1: 200, 2: 100}


def test_smallest_source_sets_the_size(rows):
    weights = {"big": 0.5, "mid": 0.25, "small": 0.25}
    assert sizes(mixing.mix_by_smallest(rows, "source", "id", weights)) == {"big": 200, "mid": 100, "small": 100}
    with pytest.raises(Exception, match="too few rows of source mid"):
        mixing.mix_by_smallest(rows, "source", "id", {"big": 0.125, "mid": 0.75, "small": 0.125}).collect()


def test_head_of_each_source(rows):
    assert sizes(mixing.mix_head(rows, "source", "id", ["big", "mid", "small"], 100)) == {"big": 100, "mid": 100, "small": 100}
    with pytest.raises(Exception, match="too few rows"):
        mixing.mix_head(rows, "source", "id", ["big", "mid", "small"], 101).collect()


def test_weights_are_checked(rows):
    with pytest.raises(ValueError):
        mixing.mix_total(rows, "source", "id", {"big": 0.5, "mid": 0.499}, 10)
    with pytest.raises(Exception, match="no weight for source"):
        mixing.mix_total(rows, "source", "id", {"big": 0.5, "mid": 0.5}, 10).collect()
    with pytest.raises(Exception, match="no rows of source none"):
        mixing.mix_total(
            rows.filter("source <> 'small'"), "source", "id", {"big": 0.5, "mid": 0.25, "none": 0.25}, 10
        ).collect()
    with pytest.raises(ValueError):
        mixing.mix_total(rows, "source", "id", {"big": 0.5, "mid": 0.5})
    assert mixing.mix_total(rows, "source", "id", {"all": 1}).count() == 1000


def test_balance_picks_the_way(rows):
    names, weights = ["big", "mid", "small"], [0.5, 0.25, 0.25]
    given = lambda **options: sizes(mixing.balance(rows, "source", "id", names, **options))
    assert given() == {"big": 700, "mid": 200, "small": 100}
    assert given(total=50) == {"big": 50, "mid": 50, "small": 50}
    assert given(weights=weights) == {"big": 200, "mid": 100, "small": 100}
    assert given(weights=weights, total=800) == {"big": 400, "mid": 200, "small": 200}
    with pytest.raises(ValueError):
        given(weights=[1.0])


def test_samples_do_not_depend_on_partitions(rows):
    once = {r.id for r in mixing.sample_rows(rows, "id", 300).collect()}
    again = {r.id for r in mixing.sample_rows(rows.repartition(13), "id", 300).collect()}
    assert once == again and len(once) == 300
    assert mixing.sample_rows(rows, "id", 5000).count() == 1000
    assert mixing.sample_rows(rows, "id", 1000).count() == 1000
    with pytest.raises(ValueError):
        mixing.sample_rows(rows, "id", 0)
    first = [r.id for r in mixing.preview_sample(rows, "id", 3).collect()]
    assert set(first) <= once


def test_shuffle_and_resume(rows):
    order = [r.id for r in mixing.seeded_shuffle(rows, "id").collect()]
    places = {r.id: r.position for r in mixing.with_shuffled_position(rows, "id").collect()}
    assert [places[i] for i in order] == list(range(1000)) and order != sorted(order)
    rest = mixing.resume_from(rows, "id", step=3, batch_size=100)
    assert {r.id for r in rest.collect()} == set(order[300:])


def test_keys_that_rows_share(rows):
    copies = rows.withColumn("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    with pytest.raises(Exception, match="id does not identify a row"):
        for n in range(100, 900, 100):
            mixing.sample_rows(copies, "id", n).collect()
    assert sorted(r.position for r in mixing.with_shuffled_position(copies, "id").collect()) == list(range(1000))


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Exchange hashpartitioning")


def test_counts_are_read_once(spark, sf_dir):
    """A mix reads its table for the counts, the cut and the rows; a job with a shuffle behind it
    once more for the places. No other pass is in the plan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    weights = {"en": 0.25, "de": 0.25, "fr": 0.375, "es": 0.125}
    mixed = mixing.mix_total(docs, "lang", "doc_id", weights, 100)
    assert scans(mixed)[0] == 3
    assert scans(mixing.with_shuffled_position(docs, "doc_id"))[0] == 2
    read, moved = scans(QUERIES["training_corpus"](spark, sf_dir))
    assert read <= 12 and moved <= 18  # its rows are a join of two scans, so six passes


def test_shares_without_a_rest(spark):
    """Whole copies only: no row is taken as a sample; and a share of nothing."""
    rows = [(i, "a") for i in range(10)] + [(100 + i, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s string").repartition(4)
    found = mixing.mix_total(df, "s", "id", {"a": 0.5, "b": 0.5}, 80).collect()
    assert sorted((r.s, r.copy) for r in found) == sorted([("a", c) for c in range(1, 5)] * 10 + [("b", 1)] * 40)
    nothing = mixing.mix_total(df, "s", "id", {"a": 1.0, "b": 0.0}, 15).collect()
    assert len(nothing) == 15 and {r.s for r in nothing} == {"a"}
