"""Code blocks and answers in completions: extraction, normalisation, grading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.arrays import indexes, last, let
from quillmesh.functions.joins import lookup_join, one_per_key
from quillmesh.functions.text import (
    SPACE,
    after_first,
    after_last,
    as_column,
    before,
    has,
    number,
    occurrences,
    strip,
    strip_left,
    strip_right,
    swap,
)
from quillmesh.operators.scores import close

# Results without an answer, fences, and the texts around an answer.
INVALID, PLACEHOLDER = "[invalid]", "placeholder"
FENCE = "```"
BLOCK_SEPARATOR = "\n# ========\n"
PHRASE, PHRASE_END = "final answer is $", "$. I hope"
SAID = "he answer is"
NEXT_PROBLEM, NEXT_QUESTION, NEXT_INFORMAL = "Problem:", "Q: ", "Informal:"
ANSWER_ZH, NEXT_ZH, NEXT_CMATH = "答案是", "问题 ", "问题："
CHOICE = r"the final answer is \(?([abcd])\)?"
HOPE = r"(?d)final answer is (.*)\. I hope it is correct."
COMMA_LIST = "separated by commas"
JOINT = rf"\\text\{{{SPACE}*and{SPACE}*\}}"

# --- Code blocks -----------------------------------------------------------------------


def _fenced(lines: Column, i: Column, mark: str) -> Column:
    return F.startswith(F.get(lines, i), F.lit(mark))


def code_block(text: Column | str, language: str, task: str = "direct") -> Column:
    """First fenced block of `python` or `latex`; an unfinished one runs to the end.

    Unless the task is `cot` the prompt has opened the block already. A repeated opening
    line starts the block anew; inside python a latex fence does not close it.
    """
    if language not in ("python", "latex"):
        raise ValueError(f"unknown language: {language}")
    text = as_column(text)
    opening = FENCE + language
    if task != "cot":
        text = F.concat(F.lit(opening + "\n"), text)
    kept_open = ("python", "latex") if language == "python" else ("latex",)

    def in_lines(lines: Column) -> Column:
        every = indexes(F.size(lines))
        opens = F.filter(every, lambda i: _fenced(lines, i, opening))

        def closes(i: Column) -> Column:
            other = F.lit(True)
            for name in kept_open:
                other = other & ~_fenced(lines, i, FENCE + name)
            return _fenced(lines, i, FENCE) & other

        def between(starts: Column) -> Column:
            first = F.get(starts, F.lit(0))
            ends = F.filter(every, lambda i: (i > first) & closes(i))
            end = F.coalesce(F.get(ends, F.lit(0)), F.size(lines))
            return let(
                end,
                lambda e: let(
                    F.array_max(F.filter(starts, lambda s: s < e)),
                    lambda s: strip(F.array_join(F.slice(lines, s + 2, e - s - 1), "\n")),
                ),
            )

        return let(
            opens, lambda starts: F.when(F.size(starts) > 0, between(starts)).otherwise(INVALID)
        )

    return let(F.split(text, "\n"), in_lines)


def extract_code(
    df: DataFrame, completion: str, language: str, task: str = "direct", name: str | None = None
) -> DataFrame:
    return df.withColumn(name or f"predicted_{language}", code_block(completion, language, task))


def extract_code_and_formula(df: DataFrame, completion: str) -> DataFrame:
    """Both blocks of a step-by-step completion."""
    python = code_block(completion, "python", "cot")
    latex = code_block(completion, "latex", "cot")
    return df.withColumn("predicted_python", python).withColumn("predicted_sstl", latex)


def program(text: Column | str, last_only: bool = True) -> Column:
    """Lines of the last python block, or of all of them behind a separator line."""

    def in_lines(lines: Column) -> Column:
        fences = F.filter(indexes(F.size(lines)), lambda i: _fenced(lines, i, FENCE))

        def blocks(at: Column) -> Column:
            starts = F.filter(
                indexes(F.size(at)), lambda k: _fenced(lines, F.get(at, k), FENCE + "python")
            )
            if last_only:
                starts = F.when(F.size(starts) > 0, F.slice(starts, -1, 1)).otherwise(starts)

            def body(k: Column) -> Column:
                end = F.coalesce(F.get(at, k + 1), F.size(lines))
                inner = F.slice(lines, F.get(at, k) + 2, end - F.get(at, k) - 1)
                text = F.array_join(F.transform(inner, lambda line: F.concat(line, F.lit("\n"))), "")
                return text if last_only else F.concat(F.lit(BLOCK_SEPARATOR), text)

            return F.array_join(F.transform(starts, body), "")

        return let(fences, blocks)

    return let(F.split(as_column(text), "\n"), in_lines)


def program_output(text: Column | str) -> Column:
    """Content of the last ```output block, empty when there is none."""
    text = as_column(text)
    mark = FENCE + "output"
    return F.when(has(text, mark), strip(before(after_last(text, mark), FENCE))).otherwise("")


# --- Normalisation ---------------------------------------------------------------------

Rule = Callable[[Column], Column]


def _replace(old: str, new: str = "") -> Rule:
    return lambda s: swap(s, old, new)


def _sub(pattern: str, new: str = "") -> Rule:
    return lambda s: F.regexp_replace(s, pattern, new)


def _if(test: Rule, rule: Rule) -> Rule:
    return lambda s: let(s, lambda v: F.when(test(v), rule(v)).otherwise(v))


def _without_unit(s: Column) -> Column:
    """Drop a closing text such as a unit, unless nothing else would be left."""
    unit = r"(?s)\\text\{.*?\}\z"
    return let(
        s,
        lambda v: let(
            strip(F.regexp_replace(v, unit, "")),
            lambda short: F.when(short == "", v).otherwise(short),
        ),
    )


def _braced_fractions(s: Column) -> Column:
    """Braces around one-character parts; a fraction with too little behind it stops all."""
    short = lambda v: F.regexp_like(v, F.lit(r"\\frac[^{]?(?=\\frac|\z)"))
    whole = r"\\frac([^{])([^{])"
    half = r"\\frac([^{])\{"
    braced = lambda v: F.regexp_replace(
        F.regexp_replace(v, half, r"\\frac{$1}{"), whole, r"\\frac{$1}{$2}"
    )
    return let(s, lambda v: F.when(short(v), v).otherwise(braced(v)))


_PART = r"(?:0|-?[1-9][0-9]*|[^/]*sqrt[^/]*)"
_DIGIT = r"\p{Nd}"
_WORD = r"[\p{L}\p{N}_]+"

# The order of the rules matters. Texts and patterns are fixed values.
RULES: list[Rule] = [
    strip,
    _replace("\n"),
    lambda s: strip_right(s, "."),
    _replace("\\!"),
    _if(
        lambda s: F.startswith(s, F.lit("\\text{")) & F.endswith(s, F.lit("}")),
        lambda s: F.substr(s, F.lit(7), F.length(s) - 7),
    ),
    _replace("tfrac", "frac"),
    _replace("dfrac", "frac"),
    _replace("cfrac", "frac"),
    _replace("\\left"),
    _replace("\\right"),
    _without_unit,
    _replace("^{\\circ}"),
    strip,
    _replace("^\\circ"),
    strip,
    _sub(r"\{(c|m)?m\}(\^(2|3))?"),
    strip,
    _sub(r"p\.m\.\z"),
    strip,
    _sub(rf"({_DIGIT}){SPACE}*t\z", "$1"),
    strip,
    _replace("\\$"),
    _replace("$"),
    _replace("x\\in"),
    _replace("\\%", "%"),
    _replace(" .", " 0."),
    _replace("{.", "{0."),
    _replace("\\cdot"),
    _replace("infinity", "\\infty"),
    _if(lambda s: ~has(s, "\\infty"), _replace("inf", "\\infty")),
    _replace("+\\inity", "\\infty"),
    _replace("\\mathbf"),
    _replace("\\mathrm"),
    _sub(r"(?s)\\mbox\{.*?\}"),
    _if(lambda s: has(s, "j") & ~has(s, "i"), _replace("j", "i")),
    _sub(rf"({_DIGIT}+)\.0+([^{_DIGIT}])", "$1$2"),
    _sub(rf"({_DIGIT}+)\.0+\z", "$1"),
    _if(lambda s: F.startswith(s, F.lit(".")), lambda s: F.concat(F.lit("0"), s)),
    _sub(r"\\sqrt(-?[0-9.a-zA-Z]+)", r"\\sqrt{$1}"),
    _sub(rf"\\sqrt{SPACE}+({_WORD})\z", r"\\sqrt{$1}"),
    _sub(r"\\tan(-?[0-9.a-zA-Z]+)", r"\\tan{$1}"),
    _sub(rf"\\tan{SPACE}+({_WORD})\z", r"\\tan{$1}"),
    _replace(" "),
    _braced_fractions,
    _sub(rf"(?s)\A({_PART})/({_PART})\z", r"\\frac{$1}{$2}"),
    _sub(r"(\\|,|\.)+\z"),
]


def normalized(answer: Column | str) -> Column:
    """One answer text after all rules."""
    result = as_column(answer)
    for rule in RULES:
        result = rule(result)
    return result


def normalize_answer(df: DataFrame, answer: str, name: str = "normalized") -> DataFrame:
    return df.withColumn(name, normalized(answer))


# --- Answers ---------------------------------------------------------------------------


def boxed_answers(text: Column | str) -> Column:
    """Contents of every `boxed{...}` with balanced braces, in order.

    Each piece behind `boxed{` is read up to its surplus closing brace: the k-th `}` (from
    0) with just k opening braces before it. A `%` right behind keeps that brace.
    """

    def content(piece: Column) -> Column:
        def found(parts: Column) -> Column:
            start = F.struct(F.lit(0).alias("opened"), F.lit(0).alias("k"), F.lit(-1).alias("hit"))

            def step(state: Column, part: Column) -> Column:
                opened = state["opened"] + occurrences(part, "{")
                closed = (state["hit"] < 0) & (opened == state["k"]) & (state["k"] < F.size(parts) - 1)
                return F.struct(
                    opened.alias("opened"),
                    (state["k"] + 1).alias("k"),
                    F.when(closed, state["k"]).otherwise(state["hit"]).alias("hit"),
                )

            def cut(hit: Column) -> Column:
                inner = F.array_join(F.slice(parts, F.lit(1), hit + 1), "}")
                percent = F.startswith(F.get(parts, hit + 1), F.lit("%"))
                return F.when(hit >= 0, F.concat(inner, F.when(percent, "}").otherwise("")))

            return let(F.aggregate(parts, start, step, lambda s: s["hit"]), cut)

        return let(F.split(piece, r"\}", -1), found)

    pieces = let(
        F.split(as_column(text), r"boxed\{", -1), lambda p: F.slice(p, F.lit(2), F.size(p))
    )
    return F.filter(F.transform(pieces, content), lambda a: a.isNotNull())


def extract_boxed(df: DataFrame, text: str) -> DataFrame:
    """One row per boxed answer: `answer_index`, `answer`."""
    return df.select("*", F.posexplode(boxed_answers(text)).alias("answer_index", "answer"))


def _tidy(answer: Column) -> Column:
    line = before(strip(answer), "\n")
    return normalized(strip_right(strip_right(strip_left(line, ":"), "."), "/"))


def answers(text: Column | str) -> Column:
    """All answers of a completion, normalised, by the first marker that it has."""

    def read(s: Column) -> Column:
        phrase = strip(before(after_first(s, PHRASE), PHRASE_END))
        said = strip(after_last(s, SAID))
        numbers = F.regexp_extract_all(
            swap(s, ","), F.lit(rf"-?{_DIGIT}*\.?{_DIGIT}+"), F.lit(0)
        )
        printed = let(
            program_output(s),
            lambda out: F.when(out != "", F.array(out)).otherwise(
                let(numbers, lambda n: F.when(F.size(n) > 0, F.array(last(n))).otherwise(
                    F.array().cast("array<string>")))
            ),
        )
        return (
            F.when(has(s, PHRASE) & has(s, PHRASE_END), F.array(phrase))
            .when(has(s, "boxed"), boxed_answers(s))
            .when(has(s, SAID), F.array(said))
            .otherwise(printed)
        )

    return F.transform(let(as_column(text), read), _tidy)


def last_answer(text: Column | str) -> Column:
    return let(answers(text), lambda a: F.coalesce(last(a), F.lit("")))


def extract_answer(df: DataFrame, text: str, name: str = "answer") -> DataFrame:
    """The last answer of a completion, empty when it has none."""
    return df.withColumn(name, last_answer(text))


def listed_answers(question: Column, found: Column) -> Column:
    """Split answers that are lists: by commas if the question says so, or by `and`."""
    by_comma = has(question, COMMA_LIST)

    def split(answer: Column) -> Column:
        plain = ~F.regexp_like(answer, F.lit(r"[()\[\]]"))
        return (
            F.when(by_comma & plain, F.split(answer, ",", -1))
            .when(F.regexp_like(answer, F.lit(JOINT)), F.split(answer, JOINT, -1))
            .otherwise(F.array(answer))
        )

    return F.transform(F.flatten(F.transform(found, split)), lambda a: strip(a))


def split_answers(
    df: DataFrame, question: str, text: str, few_shot: bool = False, name: str = "answers"
) -> DataFrame:
    """The list of answers; with `few_shot` the text ends at the next `Problem:`."""
    whole = before(F.col(text), NEXT_PROBLEM) if few_shot else F.col(text)
    return df.withColumn(name, listed_answers(F.col(question), answers(whole)))


# --- Tasks -----------------------------------------------------------------------------


def _last_number(text: Column) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(rf"-?{_DIGIT}+\.?{_DIGIT}*"), F.lit(0))
    return let(numbers, lambda n: F.coalesce(last(n), F.lit(INVALID)))


def _marked(text: Column) -> Column:
    """First line behind the Chinese answer mark, NULL without the mark."""
    return before(strip(after_first(before(text, NEXT_ZH), ANSWER_ZH)), "\n")


def _choice(text: Column) -> Column:
    letter = F.regexp_extract(F.lower(before(text, NEXT_PROBLEM)), CHOICE, 1)
    return F.when(letter == "", PLACEHOLDER).otherwise(F.upper(letter))


def _ocw(text: Column) -> Column:
    cut = before(text, NEXT_PROBLEM)
    return F.when(F.regexp_like(cut, F.lit(HOPE)), F.regexp_extract(cut, HOPE, 1)).otherwise(INVALID)


def _cmath(text: Column) -> Column:
    cut = before(text, NEXT_CMATH)
    line = before(strip(after_first(cut, ANSWER_ZH)), "\n")
    number = _last_number(strip(strip(line, "："), "。"))
    return F.when(has(cut, ANSWER_ZH), number).otherwise(last_answer(cut))


def _one(rule: Rule) -> Callable[[Column, Column], Column]:
    return lambda question, text: F.array(let(text, rule))


# Answers of a completion by task, always as a list.
TASKS: dict[str, Callable[[Column, Column], Column]] = {
    "gsm": _one(lambda t: _last_number(before(t, NEXT_QUESTION))),
    "gaokao_cloze": _one(lambda t: F.coalesce(strip(strip(_marked(t)), "$"), F.lit(PLACEHOLDER))),
    "gaokao_qa": _one(lambda t: F.coalesce(strip(_marked(t)), F.lit(PLACEHOLDER))),
    "sat": _one(_choice),
    "mmlu": _one(_choice),
    "ocw": _one(_ocw),
    "minif2f": _one(lambda t: strip(before(t, NEXT_INFORMAL))),
    "cmath": _one(_cmath),
    "math": lambda q, t: listed_answers(q, answers(t)),
    "math_few_shot": lambda q, t: listed_answers(q, answers(before(t, NEXT_PROBLEM))),
    "last_answer": _one(last_answer),
    "pde": _one(lambda t: strip(t)),
}


def task_answers(task: Column, question: Column, text: Column) -> Column:
    """Answers by the rule of the row's task; an unknown task is an error."""
    result = F.raise_error(F.concat(F.lit("unknown task: "), task)).cast("array<string>")
    for name, rule in TASKS.items():
        result = F.when(task == name, rule(question, text)).otherwise(result)
    return result


def extract_by_task(
    df: DataFrame, task: str, question: str, text: str, name: str = "answers"
) -> DataFrame:
    return df.withColumn(name, task_answers(F.col(task), F.col(question), F.col(text)))


def grade(
    preds: DataFrame, expected: DataFrame, key: str, task: str = "task",
    question: str = "question", completion: str = "completion", answer: str = "answer",
) -> DataFrame:
    """Accuracy and rate of invalid extractions per task.

    The last extracted answer counts; two numbers must be close, other texts equal. A number
    is a finite one of digits with a point and exponent at most: `NaN` and `5d` are texts. Two
    expected answers for one key are an error. The rates are sums of flags, so a task with
    most of the rows is combined before it moves.
    """
    read = extract_by_task(preds, task, question, completion, "_answers")
    joined = lookup_join(
        read.select(key, task, last(F.col("_answers")).alias("_pred")),
        one_per_key(expected.select(key, F.col(answer).alias("_answer")), key, "expected"),
        key,
    )
    pred, wanted = F.col("_pred"), F.col("_answer")
    numbers = close(number(pred), number(wanted))
    right = F.coalesce(numbers, pred == wanted, F.lit(False))
    return joined.groupBy(task).agg(
        F.avg(right.cast("double")).alias("accuracy"),
        F.avg(F.coalesce(pred.isin(INVALID, PLACEHOLDER, ""), F.lit(True)).cast("double")).alias("invalid_rate"),
        F.count(F.lit(1)).alias("n"),
    )
