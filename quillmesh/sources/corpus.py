"""Corpus files: JSON lines, JSON, Parquet and CSV directories."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FORMATS = {"jsonl": "json", "json": "json", "parquet": "parquet", "csv": "csv"}


BROKEN = "broken_record"


def parse_records(
    lines: DataFrame, schema: StructType | str, value: str = "value", where: str | None = None, broken: str = "fail"
) -> DataFrame:
    """The fields of JSON records, given as texts (`value`); other columns stay, blank texts go.

    A text that is no record of the schema, also one with a value of another type, is an error
    that names the column `where` and the text (`broken="fail"`). With `broken="keep"` it is a
    row with the text in `broken_record` and NULL in every field; good records have NULL there.
    """
    if broken not in ("fail", "keep"):
        raise ValueError(f"unknown mode for broken records: {broken}")
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if BROKEN in wanted.names:
        raise ValueError(f"{BROKEN} is the name of the column for broken records")
    told = StructType([*wanted.fields, StructField(BROKEN, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    rest = [c for c in lines.columns if c != value]
    read = lines.filter(F.trim(F.translate(value, "\t\r\n", "   ")) != "").select(
        *rest, F.col(value).alias("_text"), F.from_json(value, told, options).alias("_record")
    )
    # Anything but an object leaves no record at all.
    text = F.when(F.col("_record").isNull(), F.col("_text")).otherwise(F.col(f"_record.{BROKEN}"))
    marked = read.withColumn("_broken", text)
    if broken == "fail":
        place = F.concat(F.lit(" in "), F.col(where)) if where else F.lit("")
        message = F.concat(F.lit("broken record"), place, F.lit(": "), F.substring("_broken", 1, 500))
        good = marked.filter(F.when(F.col("_broken").isNull(), True).otherwise(F.raise_error(message).cast("boolean")))
        return good.select(*[F.col(f"_record.`{c}`") for c in wanted.names], *rest)
    fields = [F.when(F.col("_broken").isNull(), F.col(f"_record.`{c}`")).alias(c) for c in wanted.names]
    return marked.select(*fields, F.col("_broken").alias(BROKEN), *rest)


def read_corpus(
    spark: SparkSession, paths: list[str], fmt: str | None, schema: StructType | str | None = None,
    sources: bool = True, one_document: bool = False, row_ids: bool = False, broken: str = "fail",
) -> DataFrame:
    """All data files of several directories.

    `fmt` is the file extension (`jsonl` means json lines); None takes the files of every
    known extension, each in its own format, and needs a schema. Markdown files and files
    with `description` before the first dot of their name are left out. `one_document` is
    for `json` files that hold one list instead of a record per line. `source_dir` and
    `source_file` tell where a row is from, `source_path` is the whole path. `row_ids` (Parquet
    only) adds `row_id`, file and place in the file, for rows that have no key of their own.

    A broken record is an error that names its file and shows the record (`broken="fail"`), or a
    row with its text in `broken_record` and NULL in all other fields (`broken="keep"`; JSON with
    a record per line only).
    """
    if row_ids and fmt != "parquet":
        raise ValueError("only Parquet files know the place of a row: store the corpus first")
    if fmt is None:
        if schema is None:
            raise ValueError("a schema is needed to read all formats together")
        parts = [
            read_corpus(spark, paths, f, schema, sources, one_document and f == "json", broken=broken)
            for f in FORMATS
        ]
        return reduce(DataFrame.unionByName, parts)
    if fmt not in FORMATS:
        raise ValueError(f"unknown corpus format: {fmt}")
    lines = FORMATS[fmt] == "json" and not one_document
    if broken == "keep" and not lines:
        raise ValueError("broken records are kept of JSON with a record per line only")
    reader = spark.read.option("pathGlobFilter", f"*.{fmt}")
    if lines and schema is None:
        found = reader.option("mode", "DROPMALFORMED").json(paths).schema
        schema = StructType([f for f in found.fields if f.name != "_corrupt_record"])
    if lines:
        texts = reader.text(paths).select("value", F.col("_metadata.file_path").alias("_path"))
        read = parse_records(texts, schema, where="_path", broken=broken)
        return _located(read, sources)
    reader = reader.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    if one_document:
        reader = reader.option("multiLine", "true")
    rows = reader.format(FORMATS[fmt]).load(paths)
    place = [F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("row_id")] if row_ids else []
    return _located(rows.select("*", *place, F.col("_metadata.file_path").alias("_path")), sources)


def _located(rows: DataFrame, sources: bool) -> DataFrame:
    """Rows of data files, with the directory and the file taken from `_path`."""
    path = F.split("_path", "/")
    file = F.element_at(path, -1)
    data_files = rows.filter(~F.contains(F.substring_index(file, ".", 1), F.lit("description")))
    named = [F.element_at(path, -2).alias("source_dir"), file.alias("source_file"), F.col("_path").alias("source_path")]
    return data_files.select("*", *(named if sources else [])).drop("_path")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a file scan out by `key` if it has fewer than two splits per core.

    For work that costs far more than reading, such as encoding. A large corpus has many
    splits per core and is left as it is, without a shuffle. Only for plain scans: the
    number of splits of a plan with shuffles is not known before it runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores, key)


def output_clashes(df: DataFrame, output: str, path: str) -> DataFrame:
    """Outputs that two inputs or more would be written to, with the least and the greatest
    of their paths. `path` must tell inputs apart: the whole path."""
    return (
        df.groupBy(output)
        .agg(F.min(path).alias("first_input"), F.max(path).alias("last_input"))
        .filter(F.col("first_input") != F.col("last_input"))
        .select(output, "first_input", "last_input")
    )


def write_corpus(
    df: DataFrame, path: str, partition_by: str | None = "source", expect_unique: str | None = None
) -> None:
    """Write Parquet, replacing what is there (with a warning).

    With `expect_unique`, two inputs (values of that column) that map to one partition
    are an error: the second would take the place of the first.
    """
    if expect_unique and partition_by:
        clash = output_clashes(df, partition_by, expect_unique).first()
        if clash is not None:
            raise ValueError(
                f"output {clash[partition_by]} is made from two inputs: {clash.first_input}, {clash.last_input}"
            )
    if _exists(df.sparkSession, path):
        warnings.warn(f"{path} already exists and is replaced", stacklevel=2)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
