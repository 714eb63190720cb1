"""Whole jobs made of operators: training corpora, preference corpora, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.arrays import joined
from quillmesh.functions.ordering import dense_position
from quillmesh.operators import answers, logic, mixing, prompts, scores, tokens
from quillmesh.plans import sql as q
from quillmesh.plans.catalog import query, table
from quillmesh.plans.logic import SMALL, cells_sql, formula_pairs, iou_sql
from quillmesh.plans.tokens import PAIRS_SQL, PROMPT_SQL, LABEL_SQL, turn_pairs

SHAPES = ("truncate", "pad", "pack")


def training_corpus(
    df: DataFrame, fmt: str, key: str, by: str, weights: dict[str, float], total: int | None,
    max_len: int, shape: str = "truncate", seed: int = mixing.SHUFFLE_SEED,
) -> DataFrame:
    """Records to mixed, shuffled and cut training rows, in one lazy plan.

    Rows are chosen by their keys first and only then turned into prompts and ids, so
    what the mix leaves out is never encoded. `position` is the place after the shuffle.
    """
    if shape not in SHAPES:
        raise ValueError(f"unknown shape: {shape}")
    mixed = mixing.mix_total(df, by, key, weights, total, seed)
    built = prompts.build_sft(mixed, fmt, keep=(key, by, "copy"))
    numbered = built.withColumn("_row", F.concat_ws("/", F.col(key), F.col("copy")))
    encoded = tokens.encode_sft(dense_position(numbered, "_row", seed)).drop("_row")
    return _shaped(encoded, max_len, shape)


def _shaped(encoded: DataFrame, max_len: int, shape: str) -> DataFrame:
    if shape == "pack":
        return tokens.pack(encoded, max_len)
    cut = tokens.truncate if shape == "truncate" else tokens.truncate_and_pad
    return cut(encoded, max_len)


def pretraining_corpus(
    df: DataFrame, key: str, by: str, weights: dict[str, float], total: int | None, max_len: int,
    shape: str = "truncate", seed: int = mixing.SHUFFLE_SEED, text: str = "text",
) -> DataFrame:
    """Plain texts to mixed, shuffled and cut rows of `input_ids`, in one lazy plan."""
    if shape not in SHAPES:
        raise ValueError(f"unknown shape: {shape}")
    mixed = mixing.mix_total(df, by, key, weights, total, seed).select(key, by, "copy", text)
    numbered = mixed.withColumn("_row", F.concat_ws("/", F.col(key), F.col("copy")))
    placed = dense_position(numbered, "_row", seed).drop("_row")
    return _shaped(tokens.encode_pretraining(placed, text).drop(text), max_len, shape)


def preference_corpus(df: DataFrame, keep: tuple[str, ...], max_len: int) -> DataFrame:
    """Preference records to prompt, chosen and rejected ids."""
    built = prompts.build_preference(df, keep=keep)
    return tokens.truncate_preference(tokens.encode_preference(built), max_len)


def scored_examples(
    df: DataFrame, key: str, completion: str = "completion", task: str = "direct",
    align: str = "reference", grid: logic.ProfileGrid = logic.ProfileGrid(),
) -> DataFrame:
    """Completions beside their true code and formula, with every row score.

    `predicted_python` / `predicted_sstl` are taken out of the completion; edit distances,
    overlap of the formulas and, with a `logits` column, perplexity are added.
    """
    if task == "cot":
        read = answers.extract_code_and_formula(df, completion)
    else:
        read = answers.extract_code(
            answers.extract_code(df, completion, "python", task), completion, "latex", task,
            name="predicted_sstl",
        )
    scored = scores.edit_distance(read, "python", "predicted_python")
    scored = scores.edit_distance(scored, "sstl", "predicted_sstl", "edit_distance_sstl")
    if "logits" in df.columns:
        scored = scores.perplexity(scored, "logits")
    return logic.formula_iou(scored, "sstl", "predicted_sstl", align, grid)


def run_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Averages of the row scores of each run, in the long form that reports take."""
    names = {"edit_distance": "edit distance", "iou": "iou", "perplexity": "perplexity"}
    present = [c for c in names if c in df.columns]
    averages = df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n_samples"),
        *[F.avg(c).alias(names[c]) for c in present],
    )
    measured = [f"`{names[c]}`" for c in present]
    return averages.unpivot(by, ["n_samples", *measured], "metric", "value").dropna(subset=["value"])


WEIGHTS = {"even": 0.75, "odd": 0.25}
TOTAL, MAX_LEN = 400, 300


@query(
    "training_corpus",
    f"""WITH {PAIRS_SQL},
        ranked AS (
          SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS family FROM pairs),
        sized AS (
          SELECT *, row_number() OVER (PARTITION BY family ORDER BY {q.shuffled('row_id', 3407)}) AS r,
                 count(*) OVER (PARTITION BY family) AS n,
                 (CASE family WHEN 'even' THEN 300 ELSE 100 END) AS k FROM ranked),
        mixed AS (
          SELECT *, unnest(range(1, (k // n + CASE WHEN r <= k % n THEN 1 ELSE 0 END)::BIGINT + 1)) AS copy FROM sized),
        built AS (SELECT row_id, family, copy, {PROMPT_SQL} AS text, {LABEL_SQL} AS labels,
                  row_number() OVER (ORDER BY {q.shuffled("(row_id || '/' || copy)", 3407)}) - 1 AS position FROM mixed),
        encoded AS (
          SELECT row_id, family, copy, position, {q.specials(q.encode('text || labels'))} AS ids,
                 len({q.pieces('text')}) + 1 AS source FROM built)
        SELECT row_id, family, copy::BIGINT AS copy, position,
               {q.joined(f'ids[1:{MAX_LEN}]')} AS input_ids,
               {q.joined(f'(list_concat({q.repeat(-100, "least(source, len(ids))")}, ids[least(source, len(ids)) + 1:]))[1:{MAX_LEN}]')} AS labels
        FROM encoded""",
)
def training_corpus_query(spark, sf_dir):
    family = F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")
    rows = turn_pairs(spark, sf_dir).withColumn("family", family)
    corpus = training_corpus(
        rows, "to_python_no_STL", "row_id", "family", WEIGHTS, TOTAL, MAX_LEN
    )
    return corpus.select(
        "row_id", "family", F.col("copy").cast("bigint"), "position",
        joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"),
    )


@query(
    "run_metrics",
    f"""WITH scored AS ({iou_sql(cells_sql("reference"))}),
        rows AS (SELECT p_brand AS dataset, iou, levenshtein(p_name, p_type) AS d FROM part JOIN scored ON pair_id = p_partkey),
        runs AS (SELECT dataset, count(*)::DOUBLE AS n, avg(d) AS distance, avg(iou) AS iou FROM rows GROUP BY dataset)
        SELECT dataset, metric, round(value, 6) AS value FROM (
          SELECT dataset, unnest(['n_samples', 'edit distance', 'iou']) AS metric, unnest([n, distance, iou]) AS value FROM runs)""",
)
def run_metrics_query(spark, sf_dir):
    """Completions that explain, give the predicted formula and then the code.

    Formulas and codes come from one scan: a small file may hold millions of rows, and a join
    with it would be planned as a broadcast of all of them.
    """
    codes = {"p_brand": "dataset", "p_name": "python", "p_type": "guess"}
    pairs = formula_pairs(spark, sf_dir, keep=codes).withColumnRenamed("predicted_sstl", "guessed")
    completion = F.concat(
        F.lit("Formula:\n```latex\n"), "guessed", F.lit("\n```\nPython:\n```python\n"), "guess", F.lit("\n```\n")
    )
    rows = pairs.withColumn("completion", completion).drop("guess", "guessed")
    metrics = run_metrics(scored_examples(rows, "pair_id", task="cot", grid=SMALL), ["dataset"])
    return metrics.withColumn("value", F.round("value", 6))
