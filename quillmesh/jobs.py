"""Command line: `python -m quillmesh.jobs prepare|prefer|label|score|report ...`.

Each job reads files, runs the operators as one or two lazy plans and writes files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import mixing, scores
from quillmesh.operators.lineage import common_keywords, with_lineage
from quillmesh.operators.prompts import SFT_FORMATS
from quillmesh.plans import corpora
from quillmesh.sources.corpus import read_corpus, write_corpus
from quillmesh.sources.examples import read_examples, write_examples
from quillmesh.sources.runs import METHODS, METRICS, read_run_metrics, write_run_metrics

RECORD = "nl string, sstl string, python string, train_predicted_sstl string, stl string"
TEXT = "text string"
PRETRAINING = "pretraining"
PREFERENCE = (
    "anchor string, w_utility double, w_time double, w_sstl string, l_utility double, "
    "l_time double, l_sstl string, dataset_class string, pidx long, nc long"
)


def _stored(spark: SparkSession, args: argparse.Namespace, schema: str, strict: bool) -> DataFrame:
    """The input files as one Parquet table, one part per input, with row ids."""
    raw = read_corpus(spark, args.paths, args.input, schema)
    if "dataset_class" in raw.columns:
        raw = raw.drop("dataset_class")
    named = with_lineage(raw, "source_dir", "source_file", strict=strict)
    write_corpus(named, f"{args.out}/raw", "output_name", expect_unique="source_path")
    stored = spark.read.parquet(f"{args.out}/raw").schema
    return read_corpus(spark, [f"{args.out}/raw"], "parquet", stored, sources=False, row_ids=True)


def _mixed(rows: DataFrame, args: argparse.Namespace) -> tuple[DataFrame, dict[str, float], int | None]:
    """The rows to choose from, and the shares and total that are still to be taken."""
    weights = dict(part.rsplit("=", 1) for part in args.balance)
    shares = {f"tokenized_{name}": float(weight) for name, weight in weights.items()}
    if shares and args.total is not None:
        return rows, shares, args.total
    if shares:
        rows = mixing.mix_by_smallest(rows, "output_name", "row_id", shares)
    elif args.total is not None:
        rows = mixing.mix_head(rows, "output_name", "row_id", None, args.total)
    return rows, {"all": 1}, None


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Record files to a mixed, shuffled and cut training corpus."""
    plain = args.format == PRETRAINING
    rows, shares, total = _mixed(_stored(spark, args, TEXT if plain else RECORD, strict=not plain), args)
    mix = ("row_id", "output_name", shares, total, args.max_len, args.shape)
    if plain:
        corpus = corpora.pretraining_corpus(rows, *mix)
    else:
        corpus = corpora.training_corpus(rows, args.format, *mix)
    name = common_keywords(rows.select("output_name"), "output_name", "corpus", ("tokenized",))
    write_corpus(corpus, f"{args.out}/{name.first().output_name}", None)


def prefer(spark: SparkSession, args: argparse.Namespace) -> None:
    """Preference files to prompt, chosen and rejected ids in shuffled order."""
    rows, shares, total = _mixed(_stored(spark, args, PREFERENCE, strict=False), args)
    mixed = mixing.mix_total(rows, "output_name", "row_id", shares, total)
    numbered = mixed.withColumn("row_id", F.concat_ws("/", "row_id", "copy"))
    rows = mixing.seeded_shuffle(numbered, "row_id")
    write_corpus(corpora.preference_corpus(rows, (), args.max_len), f"{args.out}/preferences", None)


def label(spark: SparkSession, args: argparse.Namespace) -> None:
    """Examples with labels filled in from a results table, and the rates of the labels.

    The results have the column `key`, the value and the time.
    """
    examples = read_examples(spark, args.examples)
    if args.most:
        examples = mixing.sample_rows(examples, args.key, args.most)
    if args.results:
        results = spark.read.json(args.results)
        if "robustness" not in examples.columns:
            examples = examples.withColumn("robustness", F.lit(None).cast("double"))
        examples = scores.backfill_labels(examples, results, args.key)
    write_examples(examples, f"{args.out}/examples")
    labelled = spark.read.json(f"{args.out}/examples")
    rates = scores.label_metrics(scores.label_rates(labelled, "robustness"))
    write_run_metrics(_of_run(rates, args), args.out)


def _of_run(metrics: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Metrics with the names of the run they belong to."""
    return metrics.select(
        F.lit(args.dataset).alias("dataset"), F.lit(args.shots).alias("shots"), F.lit(args.seed).alias("seed"),
        F.lit(args.method).alias("method"), "metric", "value",
    )


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    """Completions to scored rows and the metrics of the run."""
    rows = read_examples(spark, args.completions)
    scored = corpora.scored_examples(rows, args.key, args.completion, args.task)
    folder = f"{args.out}/{args.dataset}_shots={args.shots}_seed={args.seed}/{args.method}"
    scored.write.mode("overwrite").parquet(f"{folder}/scored")
    stored = spark.read.parquet(f"{folder}/scored")
    metrics = corpora.run_metrics(stored.withColumn("_run", F.lit(0)), ["_run"]).drop("_run")
    write_run_metrics(_of_run(metrics, args), args.out)


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    """Markdown tables of run metrics, one folder per method."""
    metrics = read_run_metrics(
        spark, args.runs, args.subset, args.seeds, tuple(args.methods), tuple(args.metrics)
    )
    lines = scores.report_lines(scores.metric_cells(metrics, args.shots))
    lines.select("method", F.col("text").alias("value")).write.mode("overwrite").partitionBy(
        "method"
    ).text(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmesh")
    jobs = top.add_subparsers(required=True)

    def job(run, *, corpus: bool) -> argparse.ArgumentParser:
        one = jobs.add_parser(run.__name__, help=run.__doc__.splitlines()[0])
        one.set_defaults(run=run)
        one.add_argument("--out", required=True)
        if corpus:
            one.add_argument("--paths", nargs="+", required=True, help="folders of record files")
            one.add_argument("--input", default="jsonl", help="extension of the record files")
            one.add_argument("--max-len", type=int, default=4096)
            one.add_argument("--balance", nargs="*", default=[], help="keywords=weight of each input")
            one.add_argument("--total", type=int)
        return one

    def run_names(one: argparse.ArgumentParser) -> None:
        one.add_argument("--dataset", default="test")
        one.add_argument("--shots", type=int, default=0)
        one.add_argument("--seed", type=int, default=-1)
        one.add_argument("--method", default="gt" if one.prog.endswith("label") else "to_python")

    one = job(prepare, corpus=True)
    one.add_argument("--format", choices=[*SFT_FORMATS, PRETRAINING], default="to_python_no_STL")
    one.add_argument("--shape", choices=corpora.SHAPES, default="truncate")
    job(prefer, corpus=True)
    one = job(label, corpus=False)
    one.add_argument("--examples", required=True)
    one.add_argument("--results")
    one.add_argument("--key", default="nl", help="a column that identifies a row; repeated keys are an error")
    one.add_argument("--most", type=int)
    run_names(one)
    one = job(score, corpus=False)
    one.add_argument("--completions", required=True, help="JSON lines with nl, sstl, python and the completion")
    one.add_argument("--completion", default="completion")
    one.add_argument("--key", required=True, help="a column that identifies a row")
    one.add_argument("--task", choices=("direct", "cot"), default="direct")
    run_names(one)
    one = job(report, corpus=False)
    one.add_argument("--runs", required=True)
    one.add_argument("--subset", type=int)
    one.add_argument("--seeds", type=int, nargs="+", default=[-1])
    one.add_argument("--shots", type=int, help="most shots; more are an error (default: the most there are)")
    one.add_argument("--methods", nargs="+", default=list(METHODS))
    one.add_argument("--metrics", nargs="+", default=list(METRICS))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(spark or SparkSession.builder.appName("quillmesh").getOrCreate(), args)


if __name__ == "__main__":
    main()
