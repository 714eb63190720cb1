"""Run registered queries in Spark and their SQL in DuckDB and compare every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int",
    "float": "float", "double": "float", "string": "str", "boolean": "bool",
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int",
    "FLOAT": "float", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool",
}


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillmesh")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name: str, run, sql: str, sf_dir: str) -> tuple[str, float, float, int]:
    """Empty text when both sides agree, otherwise what differs."""
    t0 = time.time()
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    t1 = time.time()
    described = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    theirs = con.execute(
        f"SELECT {', '.join(chr(34) + n + chr(34) for n in sorted(described))} FROM ({sql})"
    ).fetchall()
    t2 = time.time()
    cost = (t1 - t0, t2 - t1, len(ours))
    if names != sorted(described):
        return (f"columns {names} / {sorted(described)}", *cost)
    for field in df.schema.fields:
        kinds = (
            KINDS.get(field.dataType.simpleString(), field.dataType.simpleString()),
            KINDS.get(described[field.name], described[field.name]),
        )
        if kinds[0] != kinds[1]:
            return (f"type of {field.name}: {kinds}", *cost)
    if len(ours) != len(theirs):
        return (f"{len(ours)} rows / {len(theirs)}", *cost)
    for a, b in zip(_sorted(ours), _sorted(theirs)):
        for n, x, y in zip(names, a, b):
            same = x == y or (
                isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)
            )
            if not same:
                return (f"{n}: {str(x)[:300]!r} / {str(y)[:300]!r} in {str(a)[:300]}", *cost)
    return ("", *cost)


def main() -> None:
    """python tests/oracle.py <sf dir> [query ...]"""
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    runs, sqls = queries(), oracle_sql()
    bad = 0
    for name in wanted or runs:
        try:
            if name in sqls:
                error, ours, theirs, n = compare(spark, con, name, runs[name], sqls[name], sf_dir)
            else:
                t0 = time.time()
                n = len(runs[name](spark, sf_dir).collect())
                error, ours, theirs = "", time.time() - t0, 0.0
        except Exception as e:  # noqa: BLE001
            error, ours, theirs, n = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0, 0
        bad += bool(error)
        mark = "FAIL" if error else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:24} {n:8} rows  spark {ours:6.2f}s  sql {theirs:6.2f}s  {error}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
