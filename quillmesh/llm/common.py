"""Shared helpers: the shared folder, tables, bounded chunks of texts, packed arrays."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import hashing

# Bytes of text that one step of a task works on; numpy needs some ten to thirty times as much.
CHUNK = 2 << 20

# How to drop what a Python worker keeps from task to task, by the name of its owner.
held: dict[str, Callable[[], object]] = {"powers": hashing.forget}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, unless their path has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(context, "_quillmesh_sent", False):
        return
    package = os.path.join(root, "quillmesh")
    archive = os.path.join(tempfile.mkdtemp(), "quillmesh.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._quillmesh_sent = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share.

    It is the cluster's `spark.checkpoint.dir`; only where that is unset (as in tests) one
    in the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage.

    A lost executor costs only the tasks that ran on it, and what several later steps
    read is computed once.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """Partitions to deal the rows of a table scan to: they grow with the table."""
    spark = df.sparkSession
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(asked, df.rdd.getNumPartitions())


def content_key(key: Column, text: Column) -> list[Column]:
    """`hash0`, `hash1`: what stands for a text beside the id; NULL counts as empty.

    64 bits beside an id of 64 bits, 128 where there is no id (`hash1` is 0 otherwise).
    """
    content = F.coalesce(text.cast("binary"), F.lit(b""))
    more = F.when(key.cast("bigint").isNull(), F.xxhash64(F.lit(2), content)).otherwise(F.lit(0))
    return [F.xxhash64(F.lit(1), content).alias("hash0"), more.cast("bigint").alias("hash1")]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, one after the other, and the offsets.

    NULL is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_string() if pa.types.is_string(column.type) else column.type
    wide = pa.large_binary() if pa.types.is_binary(column.type) else wide
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8).copy() if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    return raw, at - at[0]


def chunks(
    batches: Iterable[pa.RecordBatch], column: str, size: int = CHUNK
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of `column` each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + size, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def lean(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, without what other operators left in the worker, and with what it freed given back
    to the system when its task ends.

    Spark uses a Python worker again for later stages. Tables that an earlier stage keeps there,
    and what allocators keep, would add to the memory of every stage to come. Only the table of
    the name `own` stays for the next task.
    """

    def emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release(own)
        try:
            yield from run(batches)
        finally:
            _release(own)

    return emptied


def _release(own: str | None) -> None:
    for name, drop in held.items():
        if name != own:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others need it less
    if trim is not None:
        trim(0)


def groups_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (two rounds of multiply and shift)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
