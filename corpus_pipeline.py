"""From raw documents to encoded training rows, in stages that are each stored.

Every stage takes (spark, docs, sf_dir), with the columns of `documents`, works on all that
the stage before it kept, and returns a DataFrame; all but the last return the columns of
`documents` again, and any more columns that the table has, whatever their names.

In every stage a NULL text is an empty one, and a NULL doc_id is an id of no other row that
comes after all ids. What happens to empty texts, ties and repeated rows is said at each
stage. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe, decontamination, jaccard_join, quality, suffix_dedup
from quillmesh.llm.common import ship, stored, table
from quillmesh.llm.queries import vocabulary


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_columns(stage: Stage) -> Stage:
    """The stage, with columns beyond those of `documents` under names that no operator uses."""

    @wraps(stage)
    def guarded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        more = [c for c in docs.columns if c not in COLUMNS]
        hidden = {c: f"__more_{i}__" for i, c in enumerate(more)}
        renamed = docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns])
        found = stage(spark, renamed, sf_dir)
        shown = {h: c for c, h in hidden.items()}
        return found.select(*[F.col(c).alias(shown.get(c, c)) for c in found.columns])

    return guarded


@keeping_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. The model is fitted to the documents given.

    Empty texts have too few words and go. Equal texts get equal verdicts, so repeated rows
    stay or go together.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).filter("kept").select(*docs.columns)


@keeping_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Empty texts are like no other and stay; of repeated rows and of ties one row stays.
    """
    return jaccard_join.keep_one(docs)


@keeping_columns
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has too.

    A character of which a byte goes, goes whole. A document of which nothing is left stays
    as an empty one. Rows that share an id take nothing from each other.
    """
    cut = suffix_dedup.remove_repeats(docs, characters=True).withColumnRenamed("kept", "text")
    left = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", left).select(*docs.columns)


@keeping_columns
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages. Empty texts stay; each of
    repeated rows is judged for itself, and alike."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, checked by decoding them. Empty texts have no ids; more
    columns than those of `documents` end here."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    back = bpe.round_trip(docs.withColumn("_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), *vocabulary())
    return back.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        (F.crc32(F.col("decoded").cast("binary")) == F.col("_crc32")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("byte-level bpe", encoded),
]

# Hashed n-grams, components and token merges are beyond SQL; tests compare every stage with
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
