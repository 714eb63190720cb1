"""Source lineage of corpus rows, shared keywords of inputs, aligned unions."""

from __future__ import annotations

from functools import reduce
from posixpath import splitext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The dataset classes, in the order they are looked for.
CLASSES = ("heat", "wave")


def stem_of(file_name: Column) -> Column:
    """A file name without its extension."""
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")


def source_keywords(parent: Column, file_name: Column) -> Column:
    """Words of directory and file name (without extension), each once, joined by `_`."""
    words = F.concat(F.split(parent, "_"), F.split(stem_of(file_name), "_"))
    return F.array_join(F.array_distinct(words), "_")


def dataset_class(
    keywords: Column, classes: tuple[str, ...] = CLASSES, strict: bool = True
) -> Column:
    """First of `classes` contained in the keywords; none is an error, or NULL if not strict."""
    missing = F.raise_error(F.concat(F.lit("no dataset class in "), keywords)).cast("string")
    found = F.lit(None).cast("string") if not strict else missing
    for name in reversed(classes):
        found = F.when(F.contains(keywords, F.lit(name)), name).otherwise(found)
    return found


def with_lineage(
    df: DataFrame, parent: str | Column = "_parent", file_name: str | Column = "_file",
    classes: tuple[str, ...] = CLASSES, strict: bool = True,
) -> DataFrame:
    """Add `keywords`, `dataset_class` and the output name `tokenized_<keywords>`."""
    parent = F.col(parent) if isinstance(parent, str) else parent
    file_name = F.col(file_name) if isinstance(file_name, str) else file_name
    return (
        df.withColumn("keywords", source_keywords(parent, file_name))
        .withColumn("dataset_class", dataset_class(F.col("keywords"), classes, strict))
        .withColumn("output_name", F.concat(F.lit("tokenized_"), "keywords"))
    )


def file_lineage(df: DataFrame, **options) -> DataFrame:
    """`with_lineage` from the path of the file each row was read from."""
    path = F.split(F.col("_metadata.file_path"), "/")
    located = df.withColumns(
        {"_parent": F.element_at(path, -2), "_file": F.element_at(path, -1)}
    )
    return with_lineage(located, **options).drop("_parent", "_file")


def common_keywords(
    df: DataFrame, name: str, out_file: str, ignore: tuple[str, ...] = ()
) -> DataFrame:
    """One row: the words every input name has, sorted, put behind the output name."""
    names = df.select(stem_of(F.substring_index(name, "/", -1)).alias("_name")).distinct()
    words = names.select(F.explode(F.array_distinct(F.split("_name", "_"))).alias("word"))
    if ignore:
        words = words.filter(~F.col("word").isin(*ignore))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("_in"))
    total = names.agg(F.count(F.lit(1))).scalar()
    shared = counted.filter(F.col("_in") == total).agg(
        F.array_join(F.sort_array(F.collect_list("word")), "_").alias("keywords")
    )  # at most the words of one name
    base, extension = splitext(out_file)
    renamed = F.concat(F.lit(base + "_"), "keywords", F.lit(extension))
    return shared.withColumn(
        "output_name", F.when(F.col("keywords") != "", renamed).otherwise(F.lit(out_file))
    )


def union_aligned(inputs: dict[str, DataFrame]) -> DataFrame:
    """Cast every input to the first one's column types and put them together.

    Column `input` names the part a row came from (`input_sizes` counts them).
    """
    first = next(iter(inputs.values())).schema
    aligned = [
        df.select(F.lit(name).alias("input"), *[F.col(f.name).cast(f.dataType) for f in first])
        for name, df in inputs.items()
    ]
    return reduce(DataFrame.unionByName, aligned)


def input_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("input").agg(F.count(F.lit(1)).alias("rows"))
