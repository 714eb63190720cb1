"""Metrics of evaluation runs, identified by their directory names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import number

# Evaluation methods, the directories below a run.
METHODS = (
    "to_python_direct_with_sstl_cot",
    "to_python_no_STL",
    "to_python_two_step",
    "to_STL",
)
# The metrics that a report shows unless others are asked for.
METRICS = (
    "robustness accuracy",
    "robustness mre",
    "robustness failure rate",
    "robustness timeout rate",
    "simulation time mre",
    "edit distance",
    "iou",
    "iou failures",
    "iou timeout rate",
    "perplexity",
    "perplexity timeout rate",
    "gt positive robustness rate",
    "gt negative robustness rate",
    "gt failed robustness rate",
    "adjusted_failure_rate",
)
RUN_PATH = r"([^/]+?)_shots=(\d+)[^/]*?seed=(-?\d+)[^/]*/([^/]+)/[^/]+$"


def read_run_metrics(
    spark: SparkSession, root: str, subset: int | None = None, seeds: list[int] | None = None,
    methods: tuple[str, ...] | None = None, metrics: tuple[str, ...] | None = None,
) -> DataFrame:
    """`dataset, shots, seed, method, metric, value`, one row per number in a metrics file
    (see `metrics_from_text`).

    Files are `<root>/<dataset>_shots=N_seed=M/<method>/metrics[.<subset>].json`; runs
    without a file and metrics without a number simply have no row. `seeds`, `methods`
    and `metrics` (for example METHODS and METRICS) keep only those.
    """
    name = "metrics.json" if subset is None or subset < 0 else f"metrics.{subset}.json"
    files = (
        spark.read.option("pathGlobFilter", name)
        .option("recursiveFileLookup", "true")
        .text(root, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return metrics_from_text(files, seeds, methods, metrics)


def metrics_from_text(
    files: DataFrame, seeds: list[int] | None = None, methods: tuple[str, ...] | None = None,
    metrics: tuple[str, ...] | None = None,
) -> DataFrame:
    """The numbers in metrics files, given as `path` and text (`value`, one JSON object).

    Finite ones only: a metric of `NaN`, `Infinity` or `5d` has no row.
    """
    part = lambda i: F.regexp_extract("path", RUN_PATH, i)
    runs = files.filter(F.regexp_like("path", F.lit(RUN_PATH))).select(
        part(1).alias("dataset"),
        part(2).cast("int").alias("shots"),
        part(3).cast("int").alias("seed"),
        part(4).alias("method"),
        F.from_json("value", "map<string,string>").alias("metrics"),
    )
    values = (
        runs.select("dataset", "shots", "seed", "method", F.explode("metrics").alias("metric", "text"))
        .withColumn("value", number(F.col("text")))
        .drop("text")
        .dropna(subset=["value"])
    )
    for column, kept in (("seed", seeds), ("method", methods), ("metric", metrics)):
        if kept is not None:
            values = values.filter(F.col(column).isin(list(kept)))
    return values


def write_run_metrics(metrics: DataFrame, root: str, subset: int | None = None) -> int:
    """Write `dataset, shots, seed, method, metric, value` as `read_run_metrics` reads it:
    one object per run. Returns the number of files, of which there is one per run."""
    name = "metrics.json" if subset is None or subset < 0 else f"metrics.{subset}.json"
    spark = metrics.sparkSession
    values = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    runs = metrics.groupBy("dataset", "shots", "seed", "method").agg(F.to_json(values).alias("text"))
    count = 0
    for run in runs.toLocalIterator():
        folder = f"{root.rstrip('/')}/{run.dataset}_shots={run.shots}_seed={run.seed}/{run.method}"
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(run.text.encode()))
        out.close()
        count += 1
    return count
