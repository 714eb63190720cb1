"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A store is a folder: `deltas/<batch>` has the totals of one batch of changes as signed
numbers, `snapshots/<n>` the sum of many batches and their names. Totals are additive, so
they are the sum of the last snapshot and the deltas after it. A batch is committed when
Spark's writer has put `_SUCCESS` into its folder; committing it again does nothing, and a
batch that broke off is written anew.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"


def signed(changes: DataFrame) -> DataFrame:
    """The totals that a batch of changes adds to each group.

    `changes`: op (insert, delete, revise), source, lang, tokenizer_version, old_tokens,
    new_tokens; more columns are ignored. An insert adds a document and its new tokens, a
    delete takes one and its old tokens away, a revision adds new minus old. NULL counts
    are 0; NULL keys are groups of their own; another op, or none, adds nothing. Repeated
    rows count each time: what is idempotent is the batch.
    """
    old, new = (F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("old_tokens", "new_tokens"))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = (
        F.when(F.col("op") == "insert", new)
        .when(F.col("op") == "delete", -old)
        .when(F.col("op") == "revise", new - old)
        .otherwise(0)
    )
    return (
        changes.select(
            *[F.col(k).cast("string").alias(k) for k in KEYS],
            docs.cast("bigint").alias("n_docs"), tokens.cast("bigint").alias("n_tokens"),
        )
        .groupBy(*KEYS)
        .agg(*[F.sum(s).alias(s) for s in SUMS])
        .filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
    )


class TokenTotals:
    """A store of totals in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _committed(self, kind: str) -> list[str]:
        fs, target = self._folder(f"{self.path}/{kind}")
        if not fs.exists(target):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if fs.exists(done(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _snapshot(self) -> tuple[DataFrame | None, set[str]]:
        numbers = [n for n in self._committed("snapshots") if n.startswith("totals-")]
        if not numbers:
            return None, set()
        last = max(numbers)
        members = self.spark.read.schema("batch string").parquet(
            f"{self.path}/snapshots/{last.replace('totals', 'batches')}"
        )
        # One short name per batch of the store, not per row.
        names = {r.batch for r in members.toLocalIterator()}
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/snapshots/{last}"), names

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if a batch of this name has been committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", batch):
            raise ValueError(f"batch name {batch!r}: letters, digits and - only")
        if batch in self._committed("deltas"):
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        return True

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """Documents and tokens per group; groups that are back at nothing have no row.

        `batches` are the committed ones to sum up, by default all there are now.
        """
        base, done = self._snapshot()
        listed = self._committed("deltas") if batches is None else batches
        paths = [f"{self.path}/deltas/{b}" for b in listed if b not in done]
        found = [base] if base is not None else []
        if paths:
            found.append(self.spark.read.schema(SCHEMA).parquet(*paths))
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        rows = reduce(DataFrame.unionByName, found)
        summed = rows.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])
        return summed.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Sum up all batches in a new snapshot, which later totals start from.

        The names are written first: a snapshot counts once its totals are committed. Exactly
        the batches named are summed; one committed meanwhile is left for later totals.
        """
        number = f"{len(self._committed('snapshots')):08d}"
        batches = self._committed("deltas")
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/batches-{number}")
        self.totals(batches).write.mode("overwrite").parquet(f"{self.path}/snapshots/totals-{number}")
