"""Corpus preparation of files as they arrive.

Prompt building, encoding and cutting need one record at a time, so the batch operators
run unchanged on a file stream. What needs the whole corpus (shuffles, mixes, packing)
stays a batch job over the written rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillmesh.operators import prompts, tokens


def training_rows(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str, max_len: int,
    keep: tuple[str, ...] = (), files_per_batch: int = 1000,
) -> DataFrame:
    """Encoded training rows of all JSON lines files that are in, or come into, `path`."""
    records = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "*.jsonl")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    return tokens.truncate(tokens.encode_sft(prompts.build_sft(records, fmt, keep)), max_len)


def progress_folder(spark: SparkSession, name: str) -> str:
    """Folder for a query's progress below the shared folder that the cluster names."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir is not set: give a folder all machines share")
    return f"{shared.rstrip('/')}/{name}"


def write_arrived(
    rows: DataFrame, path: str, name: str, progress: str | None = None
) -> StreamingQuery:
    """Append what has arrived to Parquet and stop; each file is taken exactly once.

    Progress is kept in `progress`, or under `name` in the cluster's shared folder.
    """
    folder = progress or progress_folder(rows.sparkSession, name)
    return (
        rows.writeStream.format("parquet")
        .queryName(name)
        .option("path", path)
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .start()
    )
