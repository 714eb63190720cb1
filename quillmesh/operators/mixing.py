"""Seeded shuffles, samples and weighted mixes of sources.

Every choice of k rows of a source is a cut in that source's seeded hash order. The
cut-off hash is found from bucket counts (`hash_cutoffs`), after which taking the rows
is a plain filter: rows are never sorted per source and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.ordering import (
    bucket_offsets, bucket_sizes, dense_position, hash_cutoffs, order_key, ranked_hashes,
)

SHUFFLE_SEED = 3407
SAMPLE_SEED = 42


def seeded_shuffle(df: DataFrame, key: str, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Rows in a fixed random order (range partitioned, sorted inside partitions)."""
    return df.orderBy(order_key(seed, key))


def with_shuffled_position(df: DataFrame, key: str, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Rows with their 0-based place in that order."""
    return dense_position(df, key, seed)


def resume_from(
    df: DataFrame, key: str, step: int, batch_size: int, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """Leave out the rows that the first `step` batches of the shuffled order took."""
    placed = dense_position(df, key, seed)
    return placed.filter(F.col("position") >= step * batch_size)


def preview_sample(df: DataFrame, key: str, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """A few random rows to look at: top-n by hash, for small n."""
    return df.orderBy(order_key(seed, key)).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """A random n rows, or every row when there are no more than n.

    The n-th smallest hash is a scalar subquery, so n may be millions of rows.
    """
    if n < 1:
        raise ValueError("a sample needs at least one row")
    cut = hash_cutoffs(df, key, seed, n).agg(F.max("_cut")).scalar()
    # No cut-off means fewer than n rows. "~" sorts after every hex digit.
    return df.filter(order_key(seed, key) <= F.coalesce(cut, F.lit("~")))


def _weights(df: DataFrame, by: str, weights: dict[str, float]) -> DataFrame:
    """One row per named source, so small by construction."""
    if sum(weights.values()) != 1:
        raise ValueError("the weights must sum to 1")
    rows = [(source, place, float(w)) for place, (source, w) in enumerate(weights.items())]
    return df.sparkSession.createDataFrame(rows, f"`{by}` string, _place int, _weight double")


def _sized(df: DataFrame, by: str, key: str, seed: int, named: DataFrame) -> DataFrame:
    sizes = bucket_sizes(df, key, seed, by).groupBy(by).agg(F.sum("_n").alias("_n"))
    missing = F.concat(F.lit("no rows of source "), F.col(by))
    return named.join(sizes, by, "left").withColumn(
        "_n", F.coalesce("_n", F.raise_error(missing).cast("bigint"))
    )


def _known_only(df: DataFrame, by: str, sources: list[str]) -> DataFrame:
    """Fail on rows of a source that was not named instead of dropping them."""
    unknown = F.raise_error(F.concat(F.lit("no weight for source "), F.col(by)))
    return df.filter(F.when(F.col(by).isin(sources), True).otherwise(unknown.cast("boolean")))


def _take(df: DataFrame, by: str, key: str, seed: int, quotas: DataFrame) -> DataFrame:
    """Keep the first `_k` rows of each source in seeded order; too many is an error."""
    short = F.concat(F.lit("too few rows of source "), F.col(by))
    checked = quotas.withColumn(
        "_k", F.when(F.col("_k") > F.col("_n"), F.raise_error(short).cast("bigint")).otherwise(F.col("_k"))
    ).select(by, "_k")
    cuts = hash_cutoffs(df, key, seed, checked, by)
    return (
        df.join(F.broadcast(cuts), by).filter(order_key(seed, key) <= F.col("_cut")).drop("_cut")
    )


def mix_by_smallest(
    df: DataFrame, by: str, key: str, weights: dict[str, float], seed: int = SHUFFLE_SEED
) -> DataFrame:
    """Keep the smallest source whole and as much of the others as the weights allow."""
    sized = _sized(df, by, key, seed, _weights(df, by, weights))
    smallest = sized.agg(F.min(F.struct("_n", "_place", "_weight")).alias("_least"))
    total = smallest.select(F.col("_least._n") / F.col("_least._weight")).scalar()
    quotas = sized.withColumn("_k", F.floor(total * F.col("_weight")))
    return _take(_known_only(df, by, list(weights)), by, key, seed, quotas)


def mix_head(
    df: DataFrame, by: str, key: str, sources: list[str] | None, total: int, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """`total` rows of each of the given sources, or with None of each there is."""
    if sources is None:
        named = df.select(by).distinct()
    else:
        named = df.sparkSession.createDataFrame([(s,) for s in sources], f"`{by}` string")
        df = _known_only(df, by, sources)
    quotas = _sized(df, by, key, seed, named).withColumn("_k", F.lit(total).cast("bigint"))
    return _take(df, by, key, seed, quotas)


def mix_total(
    df: DataFrame, by: str, key: str, weights: dict[str, float], total: int | None = None,
    seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """`total` rows shared out by weight; short sources are repeated, long ones sampled.

    Adds `copy` (1-based). A source of n rows with a share of k gets k // n full copies
    and a sample of k mod n rows. A single weight of 1 without total keeps everything.
    """
    if total is None and list(weights.values()) == [1]:
        return df.withColumn("copy", F.lit(1))
    if total is None:
        raise ValueError("a total is needed; without one use mix_by_smallest")
    # One count per source and bucket gives sizes, copies and the place of the cut. A share
    # without a rest is cut in front of the first row.
    share = F.floor(F.lit(float(total)) * F.col("_weight"))
    named = _weights(df, by, weights)
    sized = (
        bucket_offsets(df, key, seed, by).join(F.broadcast(named.select(by, "_weight")), by)
        .withColumn("_copies", F.floor(share / F.col("_all")).cast("int"))
        .withColumn("_k", share - F.col("_copies") * F.col("_all"))
        .withColumn("_rest", F.greatest("_k", F.lit(1)) - F.col("_offset"))
        .filter((F.col("_rest") > 0) & (F.col("_rest") <= F.col("_n")))
    )
    missing = F.raise_error(F.concat(F.lit("no rows of source "), F.col(by))).cast("string")
    places = named.select(by).join(sized, by, "left").select(
        by, F.coalesce("_bucket", missing).alias("_bucket"), "_rest", "_copies", "_k"
    )
    plan = ranked_hashes(df, key, seed, places, by)
    sampled = F.when((F.col("_k") > 0) & (order_key(seed, key) <= F.col("_cut")), 1).otherwise(0)
    return (
        _known_only(df, by, list(weights))
        .join(F.broadcast(plan), by)
        .withColumn("_times", F.col("_copies") + sampled)
        .filter(F.col("_times") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .drop("_copies", "_k", "_cut", "_times")
    )


def balance(
    df: DataFrame, by: str, key: str, sources: list[str], weights: list[float] | None = None,
    total: int | None = None, seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """The four ways to balance sources, chosen by what is given.

    Neither weights nor total: everything. Only a total: that many rows of each source.
    Only weights: as much as the smallest source allows. Both: `total` rows by weight.
    """
    if weights is None:
        return df if total is None else mix_head(df, by, key, sources, total, seed)
    if len(weights) != len(sources):
        raise ValueError("one weight per source is needed")
    named = dict(zip(sources, weights))
    if total is None:
        return mix_by_smallest(df, by, key, named, seed)
    return mix_total(df, by, key, named, total, seed).drop("copy")
