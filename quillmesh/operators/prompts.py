"""Prompt texts and prompt/label records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.joins import lookup_join
from quillmesh.functions.ordering import dense_position, order_key
from quillmesh.functions.text import strip

# The instruction that opens a prompt of each format.
INSTRUCTIONS = {
    "nl_to_python": "Below is a natural language description of partial differential equation optimization problem. Translate the problem into Python code following spatial-signal temporal logic.",
    "nl_to_sstl": "Below is a natural language description of partial differential equation optimization problem. Translate the problem into Latex code following spatial-signal temporal logic.",
    "train_nl_and_sstl_to_python": "Below is a natural language description of partial differential equation optimization problem, paired with a spatial-signal temporal logic description of the same problem. Translate the problem into Python code following spatial-signal temporal logic.",
    "test_nl_to_python_with_sstl_cot": "Below is a natural language description of partial differential equation optimization problem. Translate the problem into Python code following spatial-signal temporal logic. Explain your reasoning by first providing spatial signal temporal logic statement in Latex. Let's think step by step.",
    "test_nl_with_given_sstl_to_python": "Below is a natural language description of partial differential equation optimization problem, paired with your spatial-signal temporal logic description of the same problem provided earlier. Note that there may be mistakes in the spatial-signal temporal logic statement but the natural language description is accurate. Translate the problem into Python code following spatial-signal temporal logic.",
    "train_nl_with_given_sstl_to_python": "Below is a natural language description of partial differential equation optimization problem, paired with your spatial-signal temporal logic description of the same problem provided earlier. Note that there may be mistakes in the spatial-signal temporal logic statement but the natural language description is accurate. Translate the problem into Python code following spatial-signal temporal logic.",
    "dpo_train_nl_to_sstl": "Below is a natural language description of partial differential equation optimization problem. Instead of optimizing the provided problem directly, we want to optimize an intermediate problem to produce a state that will better serve to achieve the final conditions outlined in the natural language problem. Generate a spatial-signal temporal logic description in Latex code for such an intermediate problem.",
    "dpo_test_sstl_to_python": "Below is a natural language description of partial differential equation optimization problem, paired with your spatial-signal temporal logic description of an intermediate problem provided earlier. Instead of optimizing the natural language problem directly, we want to optimize the intermediate problem to produce a state that will better serve to achieve the final conditions outlined in the natural language problem. Your spatial-signal temporal logic description in latex paired to the original problem describes this intermediate problem. Translate the intermediate problem into Python code following spatial-signal temporal logic.",
}
# The headings and fences of a prompt.
HEAD = "### Instruction:\n"
INPUT = "\n\n### Input:\n"
RESPONSE = "\n\n### Response:\n"
SECTION = "Spatial Signal Temporal Logic:\n```latex\n"
CODE_SECTION = "\n```\n\nPython:\n```python\n"
CLOSE = "\n```"

# Per prompt used in training: whether a formula is given, and what is asked for.
TRAIN_PROMPTS = {
    "nl_to_python": (False, "python"),
    "nl_to_sstl": (False, "sstl"),
    "train_nl_and_sstl_to_python": (True, "python"),
    "train_nl_with_given_sstl_to_python": (True, "python"),
    "dpo_train_nl_to_sstl": (False, "sstl"),
    "dpo_test_sstl_to_python": (True, "python"),
}
# Per training format: prompt, column holding the given formula, target column.
SFT_FORMATS = {
    "to_python_no_STL": ("nl_to_python", None, "python"),
    "to_STL": ("nl_to_sstl", None, "sstl"),
    "to_python_GT_STL": ("train_nl_and_sstl_to_python", "sstl", "python"),
    "to_python_given_STL": ("train_nl_with_given_sstl_to_python", "train_predicted_sstl", "python"),
    "to_python_misaligned": ("dpo_test_sstl_to_python", "stl", "python"),
}
MAX_SHOTS = 3


def instruction(fmt: Column | str) -> Column:
    """Instruction text of a format name (a string) or of a column of format names."""
    if isinstance(fmt, str):
        if fmt not in INSTRUCTIONS:
            raise ValueError(f"unknown prompt format: {fmt}")
        return F.lit(INSTRUCTIONS[fmt])
    known = F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown prompt format: "), fmt))
    return F.coalesce(F.try_element_at(known, fmt), unknown)


def alpaca(head: Column, task_input: Column, output: Column, fence: str | None = None) -> Column:
    """Instruction / input / response text.

    With a fence the response opens a code block, closed only behind a non-empty output.
    """
    opening = F.concat(
        F.lit(HEAD), head, F.lit(INPUT), task_input,
        F.lit(RESPONSE + (f"```{fence}\n" if fence else "")),
    )
    closing = (CLOSE if fence else "") + "\n\n"
    return F.concat(
        opening, output, F.when(output != "", F.lit(closing)).otherwise(F.lit(""))
    )


def render_prompt(
    df: DataFrame, fmt: Column | str, task_input: str, output: str | None = None,
    fence: str | None = None, name: str = "prompt",
) -> DataFrame:
    """Add the prompt text; `fmt` is a format name or a column of names."""
    answer = F.lit("") if output is None else F.col(output)
    return df.withColumn(name, alpaca(instruction(fmt), F.col(task_input), answer, fence))


def _with_formula(nl: Column, formula: Column) -> Column:
    return F.concat(nl, F.lit("\n\n" + SECTION), formula, F.lit(CLOSE))


def _text(value: Column | str | None) -> Column:
    return F.lit("") if value is None else strip(value)


def train_prompt(
    fmt: str, nl: Column | str, sstl: Column | str | None = None,
    python: Column | str | None = None,
) -> Column:
    """Prompt of a training format; with what it asks for given it is a worked example."""
    if fmt not in TRAIN_PROMPTS:
        raise ValueError(f"not a training format: {fmt}")
    given, target = TRAIN_PROMPTS[fmt]
    task = _with_formula(strip(nl), _text(sstl)) if given else strip(nl)
    output = _text(sstl if target == "sstl" else python)
    return alpaca(instruction(fmt), task, output, "latex" if target == "sstl" else "python")


def build_sft(df: DataFrame, fmt: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """`text` and `labels` of a training format; other columns go, except those in `keep`."""
    if fmt not in SFT_FORMATS:
        raise ValueError(f"unknown prompt format: {fmt}")
    name, given, target = SFT_FORMATS[fmt]
    answer = strip(target) if target == "python" else F.col(target)
    return df.select(
        *keep,
        train_prompt(name, "nl", given).alias("text"),
        F.concat(answer, F.lit(CLOSE)).alias("labels"),
    )


def build_preference(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`prompt`, `chosen`, `rejected` from anchor, better and worse formula."""
    return df.select(
        *keep,
        train_prompt("dpo_train_nl_to_sstl", "anchor").alias("prompt"),
        F.concat(strip("w_sstl"), F.lit(CLOSE)).alias("chosen"),
        F.concat(strip("l_sstl"), F.lit(CLOSE)).alias("rejected"),
    )


def eval_prompt(
    fmt: str, nl: Column | str, sstl: Column | str | None = None,
    python: Column | str | None = None,
) -> Column:
    """Prompt of a test format; with formula and code given it is a worked example."""
    nl, sstl, python = strip(nl), _text(sstl), _text(python)
    head = instruction(fmt)
    if fmt == "nl_to_python":
        return alpaca(head, nl, python, "python")
    if fmt == "test_nl_to_python_with_sstl_cot":
        steps = F.concat(
            F.lit(SECTION), sstl, F.lit(CODE_SECTION), python, F.lit(CLOSE)
        )
        return alpaca(head, nl, F.when((sstl != "") & (python != ""), steps).otherwise(F.lit("")))
    if fmt == "nl_to_sstl":
        closing = F.when(sstl != "", F.lit(CLOSE)).otherwise(F.lit(""))
        return alpaca(head, nl, F.concat(F.lit(SECTION), sstl, closing))
    if fmt == "test_nl_with_given_sstl_to_python":
        return alpaca(head, _with_formula(nl, sstl), python, "python")
    raise ValueError(f"not a test format: {fmt}")


def build_eval_prompt(
    df: DataFrame, fmt: str, nl: str = "nl", sstl: str | None = None, python: str | None = None,
    name: str = "prompt",
) -> DataFrame:
    return df.withColumn(name, eval_prompt(fmt, nl, sstl, python))


def few_shot_examples(
    df: DataFrame, fmt: str, by: str, key: str, training: bool = False
) -> DataFrame:
    """Worked examples (`by`, `id`, `text`) from rows with nl, sstl and python."""
    prompt = train_prompt if training else eval_prompt
    return df.select(by, F.col(key).alias("id"), prompt(fmt, "nl", "sstl", "python").alias("text"))


def with_few_shot(
    df: DataFrame, examples: DataFrame, k: int, by: str, key: str, shuffle: bool = False,
    seed: int = 42, dataset: str | None = None, name: str = "few_shot",
) -> DataFrame:
    """Add the text of up to `k` examples of the row's class `by`.

    `examples` holds `by`, `id` and `text`. Without `shuffle` these are the class's first
    examples by id; that is a single join with one text per class. With it they are a random
    choice per key: the i-th draw takes one of the examples that the earlier draws left over.
    All draws of a key are one array; its places meet the examples in one join, and only keys
    and texts move until the rows meet their prefix.
    """
    if not 0 <= k <= MAX_SHOTS:
        raise ValueError(f"only 0 to {MAX_SHOTS} shots")
    if dataset == "combined" and k not in (0, 2):
        raise ValueError("the combined set has 0 or 2 shots")
    if k == 0:
        return df.withColumn(name, F.lit(""))
    if not shuffle:
        # The limit on the rank is applied before and after the shuffle.
        rank = F.row_number().over(Window.partitionBy(by).orderBy("id"))
        first = examples.withColumn("_rank", rank).filter(F.col("_rank") <= k)
        shots = F.sort_array(F.collect_list(F.struct("_rank", "text")))
        per_class = first.groupBy(by).agg(shots.alias("_shots")).select(by, F.array_join("_shots.text", "").alias("_prefix"))
        joined = lookup_join(df, per_class, by, "left")
        return joined.withColumn(name, F.coalesce("_prefix", F.lit(""))).drop("_prefix")
    placed = dense_position(examples, "id", seed, "_at", by)
    sizes = examples.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    keys = lookup_join(df.select(by, key).distinct(), sizes, by)
    draws = F.explode(F.slice(F.col("_places"), 1, F.least(F.col("_size"), F.lit(k)).cast("int")))
    drawn = keys.withColumn("_places", _places(k, seed, key)).select(by, key, draws.alias("_draw"))
    asked = drawn.select(by, key, F.col("_draw.nth").alias("_nth"), F.col("_draw.place").alias("_at"))
    shots = lookup_join(asked, placed.select(by, F.col("_at").cast("bigint").alias("_at"), "text"), [by, "_at"])
    gathered = F.sort_array(F.collect_list(F.struct("_nth", "text")))
    per_key = shots.groupBy(by, key).agg(F.array_join(gathered["text"], "").alias("_prefix"))
    joined = df.join(per_key, [by, key], "left")
    return joined.withColumn(name, F.coalesce("_prefix", F.lit(""))).drop("_prefix")


def _places(k: int, seed: int, key: str) -> Column:
    """`nth` and `place` of k draws without repeats from `_size` examples.

    A draw counts among the examples left over: it steps over those already drawn, in order.
    Draws beyond the size mean nothing.
    """

    def step(drawn: Column, nth: Column) -> Column:
        left_over = F.greatest(F.col("_size") - nth, F.lit(1))
        number = F.conv(F.substring(order_key(seed, key, nth), 1, 8), 16, 10).cast("bigint")
        free = F.aggregate(
            F.sort_array(drawn), number % left_over, lambda at, taken: F.when(at >= taken, at + 1).otherwise(at)
        )
        return F.concat(drawn, F.array(free))

    places = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), step)
    return F.transform(places, lambda place, nth: F.struct(nth.alias("nth"), place.alias("place")))
