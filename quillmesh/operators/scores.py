"""Scores of single rows and the aggregates reported over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.arrays import indexes, let
from quillmesh.functions.joins import one_per_key, salted_join
from quillmesh.functions.text import as_column

# Stop words of a completion, the failure mark, closeness of numbers.
STOP_WORDS = ("\n### Instruction:", "### Instruction:")
FAILED = -100
PRECISION = 1e-3
# The names that label rates have in a metrics file.
LABEL_METRICS = {
    "positive_rate": "gt positive robustness rate",
    "negative_rate": "gt negative robustness rate",
    "failed_rate": "gt failed robustness rate",
}


def edit_distance(df: DataFrame, truth: str, pred: str, name: str = "edit_distance") -> DataFrame:
    """Levenshtein distance of two text columns."""
    return df.withColumn(name, F.levenshtein(truth, pred))


def flat_logprobs(steps: Column | str) -> Column:
    """Log-probabilities of a list of steps, each a map of id to (token, logprob)."""
    per_step = F.transform(
        as_column(steps), lambda s: F.transform(F.map_values(s), lambda v: v["logprob"])
    )
    return F.flatten(per_step)


def perplexity(df: DataFrame, logprobs: str, name: str = "perplexity") -> DataFrame:
    """exp of minus the mean log-probability; no list is `failed`, an empty one `error`."""
    values = F.col(logprobs)

    def score(list_: Column) -> Column:
        total = F.aggregate(list_, F.lit(0.0), lambda a, v: a + v)
        return F.exp(-(F.lit(1.0) / F.size(list_)) * total)

    status = F.when(values.isNull(), "failed").when(F.size(values) == 0, "error").otherwise("ok")
    return df.withColumn(f"{name}_status", status).withColumn(
        name, F.when(F.size(values) > 0, score(values.cast("array<double>")))
    )


def close(pred: Column, answer: Column, precision: float = PRECISION) -> Column:
    """Equal up to a share of the larger of the two magnitudes.

    NaN is close to nothing, an infinity to itself only.
    """
    pred, answer = pred.cast("double"), answer.cast("double")
    most = F.greatest(F.abs(pred), F.abs(answer))
    near = F.abs(pred - answer) <= precision * most
    return F.when(F.isnan(most), False).when(most == float("inf"), pred == answer).otherwise((pred == answer) | near)


def is_correct(
    df: DataFrame, pred: str, answer: str, pred_status: str | None = None,
    answer_status: str | None = None, precision: float = PRECISION, name: str = "correct",
) -> DataFrame:
    """Two numbers must be close, an answer that timed out accepts anything, and all
    other values (statuses, texts) must be equal."""
    no_status = F.lit(None).cast("string")
    theirs = F.col(answer_status) if answer_status else no_status
    ours = F.col(pred_status) if pred_status else no_status
    numbers = F.col(pred).isNotNull() & F.col(answer).isNotNull()
    neither = F.col(pred).isNull() & F.col(answer).isNull()
    return df.withColumn(
        name,
        F.when(numbers, close(F.col(pred), F.col(answer), precision))
        .when(F.coalesce(theirs == "timeout", F.lit(False)), True)
        .otherwise(neither & ours.eqNullSafe(theirs)),
    )


def mean_std(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean and sample standard deviation (NULL for a single value)."""
    return df.groupBy(*(by or [])).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def label_rates(df: DataFrame, value: str, by: list[str] | None = None, strict: bool = True):
    """Shares of positive, negative and failed (-100) values.

    A value that is none of these (0, or no number) is an error, or with `strict=False`
    counted as `invalid_rate`.
    """
    v = F.col(value)
    classes = {
        "positive_rate": v > 0,
        "negative_rate": (v < 0) & (v != FAILED),
        "failed_rate": v == FAILED,
    }
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    invalid = v.isNull() | (v == 0) | F.isnan(v)
    if strict:
        message = F.concat(F.lit("not a label: "), F.coalesce(v.cast("string"), F.lit("NULL")))
        df = df.withColumn(
            value, F.when(invalid, F.raise_error(message).cast("double")).otherwise(v)
        )
    rates = [share(test).alias(name) for name, test in classes.items()]
    if not strict:
        rates.append(share(invalid).alias("invalid_rate"))
    return df.groupBy(*(by or [])).agg(*rates, F.count(F.lit(1)).alias("n_samples"))


def label_metrics(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Label rates as rows of a metrics file: `metric`, `value`."""
    named = rates.withColumn("n_samples", F.col("n_samples").cast("double"))
    named = named.withColumnsRenamed(LABEL_METRICS)
    values = ["n_samples", *[f"`{name}`" for name in LABEL_METRICS.values()]]
    return named.unpivot(by or [], values, "metric", "value")


def backfill_labels(
    df: DataFrame, results: DataFrame, key: str, value: str = "robustness", time: str = "time"
) -> DataFrame:
    """Take value and time from `results` for the rows that have no value yet.

    Two results for one key are an error.
    """
    found = results.select(key, F.col(value).alias("_value"), F.col(time).alias("_time"))
    joined = df.join(one_per_key(found, key, "results"), key, "left")
    own_time = F.col(time) if time in df.columns else F.lit(None)
    return (
        joined.withColumn(time, F.when(F.col(value).isNull(), F.col("_time")).otherwise(own_time))
        .withColumn(value, F.coalesce(value, "_value"))
        .drop("_value", "_time")
    )


def with_outcome(
    df: DataFrame, value: str, seconds: str, limit: float, failed: Column | None = None,
    timeout_value: float | None = None,
) -> DataFrame:
    """Add `outcome` (ok, timeout, failed) and the `label` that goes with it.

    A failure is labelled -100. A timeout is labelled `timeout_value` (0 where the short
    limit applies), or NULL where it is only named.
    """
    broken = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    outcome = F.when(F.col(seconds) > limit, "timeout").when(broken, "failed").otherwise("ok")
    label = (
        F.when(F.col("outcome") == "timeout", F.lit(timeout_value).cast("double"))
        .when(F.col("outcome") == "failed", float(FAILED))
        .otherwise(F.col(value).cast("double"))
    )
    return df.withColumn("outcome", outcome).withColumn("label", label)


def outcome_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def metric_cells(df: DataFrame, max_shots: int | None = None, strict: bool = True) -> DataFrame:
    """`method, metric, shots, dataset, n, cell`: `mean (std)` over the seeds of a run.

    There is a row for each number of shots from 0 to `max_shots`, or to the largest there
    is; a score beyond `max_shots`, or without a number of shots, is an error.
    A dataset without any score of a metric has no column; an empty cell is `n/a`.
    Datasets with unequal numbers of scores for one number of shots are an error.
    """
    names = ["method", "metric", "dataset"]
    given = F.col("shots")
    wrong = given.isNull() | (given < 0)
    if max_shots is not None:
        wrong = wrong | (given > max_shots)
    message = F.concat(F.lit("a score with unexpected shots: "), F.coalesce(given.cast("string"), F.lit("NULL")))
    counted = df.filter(F.col("value").isNotNull()).withColumn(
        "shots", F.when(wrong, F.raise_error(message).cast("int")).otherwise(given.cast("int"))
    )
    scored = (
        counted.groupBy(*names, "shots")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )
    most = F.lit(max_shots) if max_shots is not None else scored.agg(F.max("shots")).scalar()
    rows = scored.select(*names).distinct().withColumn("shots", F.explode(F.sequence(F.lit(0), most)))
    number = lambda c: F.when(c.isNull(), "nan").otherwise(F.format_string("%.4f", c))
    text = F.concat(number(F.col("mean")), F.lit(" ("), number(F.col("std")), F.lit(")"))
    cells = rows.join(scored, [*names, "shots"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cells = cells.withColumn("cell", F.when(F.col("n") > 0, text).otherwise("n/a"))
    if strict:
        # One row per dataset of a report, not per score.
        line = Window.partitionBy("method", "metric", "shots")
        unequal = F.raise_error(F.concat(F.lit("unequal numbers of scores for shots "), F.col("shots").cast("string")))
        cells = (
            cells.withColumn("_most", F.max("n").over(line))
            .withColumn("_least", F.min("n").over(line))
            .withColumn("cell", F.when(F.col("_most") != F.col("_least"), unequal.cast("string")).otherwise(F.col("cell")))
        )
    return cells.select("method", "metric", "shots", "dataset", "n", "cell")


def metric_report(
    df: DataFrame, datasets: list[str] | None = None, max_shots: int | None = None, strict: bool = True
) -> DataFrame:
    """The cells as a table: one row per method, metric and shots, one column per dataset.

    A dataset that a given list lacks is an error.
    """
    cells = metric_cells(df, max_shots, strict)
    if datasets is not None:
        unlisted = F.raise_error(F.concat(F.lit("a dataset that is not listed: "), F.coalesce("dataset", F.lit("NULL"))))
        listed = F.coalesce(F.col("dataset").isin(datasets), F.lit(False))
        cells = cells.withColumn("dataset", F.when(listed, F.col("dataset")).otherwise(unlisted.cast("string")))
    table = cells.groupBy("method", "metric", "shots").pivot("dataset", datasets).agg(F.first("cell"))
    return table.na.fill("n/a")


def report_lines(cells: DataFrame) -> DataFrame:
    """Markdown of each metric's table: `method, metric, text`."""
    row = F.array_sort(F.collect_list(F.struct("dataset", "cell")))
    shots = cells.groupBy("method", "metric", "shots").agg(row.alias("_row"))
    line = F.concat(F.lit("|   "), F.col("shots").cast("string"), F.lit("   | "), F.array_join("_row.cell", " | "), F.lit(" |\n"))
    tables = shots.withColumn("_line", line).groupBy("method", "metric").agg(
        F.array_sort(F.collect_list(F.struct("shots", "_line"))).alias("_lines"),
        F.first("_row.dataset").alias("_names"),
    )
    header = F.concat(
        F.lit("## Metric: "), "metric", F.lit("\n\n| shots | "), F.array_join("_names", " | "), F.lit(" |\n|-------|"),
        F.array_join(F.array_repeat(F.lit("------------|"), F.size("_names")), ""), F.lit("\n"),
    )
    return tables.select(
        "method", "metric", F.concat(header, F.array_join("_lines._line", ""), F.lit("\n\n")).alias("text")
    )


def flatten_metrics(
    df: DataFrame, metrics: list[str], prompt: str = "few_shot_prompt", shots: str = "few_shot_number"
) -> DataFrame:
    """One row per metric of a run: `validation_<prompt>_<shots>shots/<metric>`, value."""
    long = df.unpivot([prompt, shots], metrics, "metric", "value")
    named = F.concat(
        F.lit("validation_"), F.coalesce(F.col(prompt), F.lit("")), F.lit("_"),
        F.coalesce(F.col(shots).cast("string"), F.lit("None")), F.lit("shots/"), "metric",
    )
    return long.select(prompt, shots, named.alias("key"), "value").dropna(subset=["value"])


def score_table(
    df: DataFrame, order: str, prompt: str = "prompt", completions: str = "completions",
    scores: str = "scores",
) -> DataFrame:
    """`prompt, completion, score`: of equal completions of a prompt the last score counts.

    Long form, so a prompt with any number of completions stays spread over tasks.
    """
    pairs = F.arrays_zip(F.col(completions).alias("completion"), F.col(scores).alias("score"))
    single = df.select(prompt, order, F.posexplode(pairs).alias("_pos", "_pair"))
    return single.groupBy(prompt, F.col("_pair.completion").alias("completion")).agg(
        F.max_by("_pair.score", F.struct(order, "_pos")).alias("score")
    )


def score_maps(table: DataFrame, prompt: str = "prompt", entries: int = 1000) -> DataFrame:
    """Completion-to-score maps: `prompt, part, scores`.

    A prompt has one map per about `entries` completions, so that no map (and no task that
    makes one) grows with the number of completions of a prompt.
    """
    counts = table.groupBy(prompt).agg(F.count(F.lit(1)).alias("_rows"))
    maps = counts.select(prompt, F.ceil(F.col("_rows") / entries).alias("_maps"))
    sized = salted_join(table, maps, prompt, "completion", counts=counts)
    part = F.pmod(F.xxhash64("completion"), F.col("_maps")).alias("part")
    pairs = F.collect_list(F.struct("completion", "score"))
    return sized.groupBy(prompt, part).agg(F.map_from_entries(pairs).alias("scores"))


def next_token(
    df: DataFrame, logits: str, candidates: list[int] | None = None, tokens: list[str] | None = None
) -> DataFrame:
    """Add `probs` (softmax over the candidate ids) and `prediction` (its first maximum).

    The prediction is a place among the candidates, or with `tokens` that token.
    """
    picked = F.col(logits).cast("array<double>")
    if candidates is not None:
        ids = F.array(*[F.lit(i) for i in candidates])
        picked = let(picked, lambda all_: F.transform(ids, lambda i: F.get(all_, i)))

    def softmax(values: Column) -> Column:
        raised = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
        return let(
            raised,
            lambda r: let(
                F.aggregate(r, F.lit(0.0), lambda a, v: a + v),
                lambda total: F.transform(r, lambda v: v / total),
            ),
        )

    place = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    found = place if tokens is None else F.get(F.array(*[F.lit(t) for t in tokens]), place)
    return df.withColumn("probs", let(picked, softmax)).withColumn("prediction", found)


def cut_at_stop(
    df: DataFrame, text: str, stops: tuple[str, ...] = STOP_WORDS, end: str | None = None
) -> DataFrame:
    """Cut the text before the first stop word; `finished` when the end mark stands there."""
    value = F.col(text)
    places = [F.nullif(F.locate(stop, value), F.lit(0)) for stop in stops]
    at = F.least(*places) if len(places) > 1 else places[0]
    rest = F.substr(value, F.col("_at"))
    finished = F.lit(False) if end is None else F.coalesce(F.startswith(rest, F.lit(end)), F.lit(False))
    kept = F.when(F.col("_at").isNull(), value).otherwise(F.substr(value, F.lit(1), F.col("_at") - 1))
    return (
        df.withColumn("_at", at).withColumn("finished", finished).withColumn(text, kept).drop("_at")
    )


def cut_logprobs(
    df: DataFrame, steps: str, stops: tuple[str, ...] = STOP_WORDS, end: str | None = None,
    name: str = "logprobs",
) -> DataFrame:
    """Log-probabilities of the tokens before the one at which a stop word begins.

    `steps` is an array of (token, logprob). A stop word is looked for in as many tokens
    as it has characters, and three more.
    """
    marks = [*stops, *([end] if end is not None else [])]

    def begins(tokens: Column, i: Column) -> Column:
        found = F.lit(False)
        for mark in marks:
            # The first token alone rules most places out.
            token = F.get(tokens, i)
            fits = F.startswith(F.lit(mark), token) | F.startswith(token, F.lit(mark))
            ahead = F.array_join(F.slice(tokens, i + 1, len(mark) + 3), "")
            found = found | (fits & F.startswith(ahead, F.lit(mark)))
        return found

    def kept(tokens: Column) -> Column:
        starts = F.filter(indexes(F.size(tokens)), lambda i: begins(tokens, i))
        return F.coalesce(F.get(starts, F.lit(0)), F.size(tokens))

    count = let(F.transform(steps, lambda s: s["token"]), kept)
    return df.withColumn(
        name, let(count, lambda n: F.slice(F.transform(steps, lambda s: s["logprob"]), F.lit(1), n))
    )
