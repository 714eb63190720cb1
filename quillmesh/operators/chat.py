"""Benchmark items as chat records: dataset, id, messages (role, content), answer list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.arrays import let
from quillmesh.functions.text import strip, strip_right, swap
from quillmesh.operators.answers import answers, listed_answers, normalized

# Texts of the records.
CHOICE = "\nWhat of the following is the right choice? Explain your answer.\n"
CHOICE_ZH = "\n从以下选项中选择:    "
BOXED, BOXED_END = "\nSo the answer is $\\boxed{", "}$."
INFORMAL, PROOF, FORMAL = "(*### Problem\n\n", "\n\n### Solution\n\n", " *)\n\nFormal:\n"


def messages(user: Column, assistant: Column) -> Column:
    said = lambda role, content: F.struct(
        F.lit(role).alias("role"), content.alias("content")
    )
    return F.array(said("user", user), said("assistant", assistant))


def _require(test: Column, value: Column, message: str) -> Column:
    return F.when(test, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def bracketed_options(options: Column) -> Column:
    """`A) x B) y` as `(A) x (B) y`; the text must begin with A."""

    def mark(text: Column) -> Column:
        result = F.concat(F.lit("("), text)
        for letter in "BCDEFG":
            result = swap(result, f" {letter}) ", f" ({letter}) ")
        return strip(result)

    return let(
        strip(options),
        lambda text: _require(F.startswith(text, F.lit("A")), mark(text), "options must begin with A"),
    )


def lettered_options(options: Column) -> Column:
    """A list of options as `(A) x, (B) y`; those behind the fourth keep no letter."""
    letters = F.array(*[F.lit(c) for c in "ABCD"])

    def mark(option: Column, i: Column) -> Column:
        return F.when(
            i < 4, F.concat(F.lit("("), F.get(letters, i), F.lit(") "), strip(option))
        ).otherwise(option)

    return F.array_join(F.transform(options, mark), ", ")


def quoted(text: Column) -> Column:
    """A text in quotes with escapes, as lists of texts are printed."""
    escaped = text
    for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = swap(escaped, plain, code)

    def pick(value: Column) -> Column:
        single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
        in_double = F.concat(F.lit('"'), value, F.lit('"'))
        in_single = F.concat(F.lit("'"), swap(value, "'", "\\'"), F.lit("'"))
        return F.when(single & ~double, in_double).otherwise(in_single)

    return let(escaped, pick)


def colon_options(options: Column) -> Column:
    """`(A) x` as `A: x`, printed as a list; anything else is an error."""

    def mark(option: Column) -> Column:
        def rewrite(text: Column) -> Column:
            line = F.concat(
                F.substring(text, 2, 1), F.lit(": "), strip(F.substr(text, F.lit(4)))
            )
            return _require(
                F.regexp_like(text, F.lit(r"^\([ABCD]\)")), strip(line), "option without a letter"
            )

        return quoted(let(strip(option), rewrite))

    return F.concat(F.lit("["), F.array_join(F.transform(options, mark), ", "), F.lit("]"))


def _one(text: Column) -> Column:
    return F.array(text)


def _math_lines(solution: Column) -> Column:
    """A line per sentence: break at a blank between a full stop and a capital."""
    return F.regexp_replace(solution, r"(?<=\.) (?=[A-Z])", "\n")


@dataclass(frozen=True)
class Recipe:
    """How one benchmark's columns become a chat record."""

    dataset: str
    user: Callable[[], Column]
    assistant: Callable[[], Column]
    answer: Callable[[], Column]
    keep: tuple[str, ...] = ()
    language: str | None = None


_empty = lambda: F.lit("")
_question = lambda: strip("question")

RECIPES: dict[str, Recipe] = {
    "gsm8k": Recipe(
        "gsm8k-cot",
        lambda: F.col("question"),
        lambda: F.concat(
            F.regexp_replace("cot", "<<[^<>]*>>", ""), F.lit(BOXED), strip("answer"), F.lit(BOXED_END)
        ),
        lambda: _one(swap(F.col("answer"), ",")),
    ),
    "math": Recipe(
        "math-cot",
        lambda: F.col("problem"),
        lambda: _math_lines(F.col("solution")),
        lambda: listed_answers(F.col("problem"), answers("solution")),
        keep=("level", "type", "category"),
    ),
    "sat": Recipe(
        "math_sat",
        lambda: F.concat(_question(), F.lit(CHOICE), bracketed_options(F.col("options"))),
        lambda: F.col("Answer"),
        lambda: _one(F.col("Answer")),
        language="en",
    ),
    "ocw": Recipe(
        "OCWCourses",
        lambda: strip("problem"),
        lambda: strip("solution"),
        lambda: _one(F.col("answer")),
        language="en",
    ),
    "mmlu": Recipe(
        "MMLU-STEM",
        lambda: F.concat(_question(), F.lit(CHOICE), lettered_options(F.col("options"))),
        lambda: F.col("answer"),
        lambda: _one(F.col("answer")),
        language="en",
    ),
    "cmath": Recipe(
        "cmath",
        _question,
        _empty,
        lambda: _one(swap(strip("golden"), ",")),
        keep=("grade", "reasoning_step"),
    ),
    "gaokao_cloze": Recipe(
        "agieval-gaokao-math-cloze",
        _question,
        _empty,
        lambda: F.transform(F.split(strip("answer"), ";", -1), normalized),
    ),
    "gaokao_qa": Recipe(
        "agieval-gaokao-mathqa",
        lambda: F.concat(_question(), F.lit("\n"), colon_options(F.col("options"))),
        _empty,
        lambda: _one(F.col("label")),
    ),
    "gaokao_qa_few_shot": Recipe(
        "agieval-gaokao-mathqa",
        lambda: F.concat(
            strip_right(_question(), "\\"), F.lit(CHOICE_ZH),
            F.array_join(F.transform("options", lambda o: strip(o)), " "),
        ),
        _empty,
        lambda: _one(F.col("label")),
    ),
    "minif2f": Recipe(
        "minif2f-isabelle",
        lambda: F.concat(
            F.lit(INFORMAL), strip("informal_statement"), F.lit(PROOF), strip("informal_proof"),
            F.lit(FORMAL), strip("formal_statement"),
        ),
        _empty,
        lambda: _one(F.lit("placeholder")),
    ),
}


def to_chat(df: DataFrame, benchmark: str) -> DataFrame:
    """Items of one benchmark as chat records; `answer` is always a list.

    `mgsm` items are records already and only lose the commas of their answer. A `math`
    item without problem or solution has no answer to extract and is left out.
    """
    if benchmark == "mgsm":
        return df.withColumn("answer", swap(F.col("answer"), ","))
    if benchmark not in RECIPES:
        raise ValueError(f"unknown benchmark: {benchmark}")
    recipe = RECIPES[benchmark]
    if benchmark == "math":
        df = df.dropna(subset=["problem", "solution"])
    language = [F.lit(recipe.language).alias("language")] if recipe.language else []
    return df.select(
        F.lit(recipe.dataset).alias("dataset"),
        "id",
        *recipe.keep,
        *language,
        messages(recipe.user(), recipe.assistant()).alias("messages"),
        recipe.answer().alias("answer"),
    )


def pairs_to_chat(df: DataFrame, dataset: str, key: str, user: str, assistant: str) -> DataFrame:
    """Chat records of question and answer columns."""
    return df.select(
        F.lit(dataset).alias("dataset"),
        F.col(key).alias("id"),
        messages(strip(user), strip(assistant)).alias("messages"),
        _one(strip(assistant)).alias("answer"),
    )
