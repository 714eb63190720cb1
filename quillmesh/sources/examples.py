"""Evaluation examples as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmesh.functions.text import strip

KEYS = {"python": "python", "sstl": "sstl", "nl": "nl", "robustness": "robustness"}
REQUIRED = ("python", "sstl", "nl")
LAST = ("sstl", "python", "robustness", "time")


def read_examples(
    spark: SparkSession, path: str, schema: StructType | str | None = None,
    keys: dict[str, str] | None = None,
) -> DataFrame:
    """The examples of a file, see `standard_examples`."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return standard_examples(reader.json(path), keys)


def standard_examples(rows: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Rows with the standard names added from the configured keys; code is stripped.

    A key that some rows lack is NULL there; a required key that the schema lacks is an
    error.
    """
    names = {**KEYS, **(keys or {})}
    missing = [names[n] for n in REQUIRED if names[n] not in rows.columns]
    if missing:
        raise ValueError(f"examples lack the keys {missing}")
    renamed = {n: F.col(names[n]) for n in KEYS if names[n] in rows.columns}
    renamed["python"] = strip(names["python"])
    return rows.withColumns(renamed)


def ordered_examples(df: DataFrame) -> DataFrame:
    """Formula, code, robustness and time as the last keys."""
    tail = [c for c in LAST if c in df.columns]
    return df.select(*[c for c in df.columns if c not in tail], *tail)


def write_examples(df: DataFrame, path: str) -> None:
    """JSON lines with formula, code, robustness and time as the last keys."""
    ordered_examples(df).write.mode("overwrite").json(path)
