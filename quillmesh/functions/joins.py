"""Joins from many rows to one row per key that hold up under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when one task should not take all its rows. The share keeps the number of
# hot keys at 100,000 at most, whatever the data: so many shares make up all rows.
ROWS_PER_TASK = 1_000_000
MOST_HOT_KEYS = 100_000


def _names(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else on


def _hot_keys(counts: DataFrame, on: list[str]) -> DataFrame:
    """`_key` (hash of the key) and the number of parts it is cut into."""
    total = counts.agg(F.sum("_rows")).scalar()
    limit = F.greatest(F.lit(ROWS_PER_TASK), F.ceil(total / MOST_HOT_KEYS))
    by_hash = counts.groupBy(F.xxhash64(*on).alias("_key")).agg(F.sum("_rows").alias("_rows"))
    parts = F.ceil(F.col("_rows") / limit).cast("int").alias("_parts")
    return by_hash.filter(F.col("_rows") > limit).select("_key", parts)


def salted_join(
    rows: DataFrame, per_key: DataFrame, on: str | list[str], spread: str | Column,
    how: str = "inner", counts: DataFrame | None = None,
) -> DataFrame:
    """Join `per_key` (one row per key) to `rows`, cutting hot keys into parts.

    `counts` has the key and `_rows`, the number of rows of each key; without it they are
    counted first. A hot key gets as many parts as it has shares of rows, and its row of
    `per_key` is repeated for each; all other keys are joined as they are. `spread` is a
    column that differs inside a key.
    """
    on = _names(on)
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    hot = F.broadcast(_hot_keys(counts, on))  # at most MOST_HOT_KEYS rows of two numbers
    parts = F.coalesce("_parts", F.lit(1))
    left = (
        rows.withColumn("_key", F.xxhash64(*on))
        .join(hot, "_key", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
        .drop("_key", "_parts")
    )
    right = (
        per_key.withColumn("_key", F.xxhash64(*on))
        .join(hot, "_key", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_key", "_parts")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def one_per_key(df: DataFrame, on: str | list[str], what: str) -> DataFrame:
    """The rows of a table that must have one row per key; a repeated key is an error."""
    on = _names(on)
    rest = [c for c in df.columns if c not in on]
    many = F.raise_error(F.concat(F.lit(f"{what} repeats a key: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on])))
    counted = df.groupBy(*on).agg(F.first(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_rows"))
    checked = F.when(F.col("_rows") == 1, F.col("_row")).otherwise(many.cast(counted.schema["_row"].dataType))
    return counted.select(*on, checked.alias("_row")).select(*on, *[F.col("_row")[c].alias(c) for c in rest])


def lookup_join(rows: DataFrame, per_key: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join a table that is usually small. No size is asked while the plan is built: adaptive
    execution broadcasts a side whose measured bytes allow it, and splits the partitions of
    hot keys otherwise."""
    return rows.join(per_key, _names(on), how)


def merge_join(rows: DataFrame, per_key: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the input. Never by broadcast: sizes in front of a
    join are estimated from files, and a few megabytes of Parquet may hold millions of rows that
    become long texts. Sorted partitions spill, and those of hot keys are split."""
    return rows.join(per_key.hint("merge"), _names(on), how)
