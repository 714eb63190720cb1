"""Reading temporal-logic formulas: clauses, grouping and clause contents.

A formula such as
`G_[[0.8, 1.3]] (\\forall x \\in [14, 25] (u(x) - (0.3 \\cdot x + 307.8) < 0)) \\land F_[[..]] (..)`
is text. Clause expressions are linear in x and become numbers; no text is executed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.arrays import let
from quillmesh.functions.text import WHITESPACE, strip, swap

# What a clause looks like. The five expression patterns are tried in order.
TIME_INTERVAL = r"([FG])_\[\[([\d.]+),\s*([\d.]+)\]\]"
POSITION_INTERVAL = r"\\forall x \\in \[([\d.]+),\s*([\d.]+)\]"
EXPRESSIONS = (
    r"u\(x\)\s*(-\s*\(([-+]?\d*\.?\d+(?:e[-+]?\d+)?\s*\\cdot\s*x\s*\+\s*[-+]?\d*\.?\d+(?:e[-+]?\d+)?)\))?\s*(<=|>=|<|>|=|!=|=|\\leq|\\geq)\s*(-?\d+(\.\d+)?)",
    r"u\(x\)\s*(-\s*\(\s*([-+]?\s*x\s*/\(?\d+(?:e[-+]?\d+)?\)?\s*[-+]?\s*\d*\.?\d*(?:e[-+]?\d+)?\s*)\))?\s*(<=|>=|<|>|=|!=|\\leq|\\geq)\s*(-?\d+(\.\d+)?)",
    r"u\(x\)\s*(-\s*\(\s*([-+]?\s*x\s*\\cdot\s*[-+]?\s*\d*\.?\d+(?:e[-+]?\d+)?\s*[-+]?\s*[-+]?\d*\.?\d+(?:e[-+]?\d+)?\s*)\))?\s*(<=|>=|<|>|!=|\\leq|\\geq)\s*(-?\d+(\.\d+)?)",
    r"u\(x\)\s*(-\s*\(\s*([-+]?\s*x\s*\\cdot\s*\(?[-+]?\s*\d*\.?\d+(?:e[-+]?\d+)?\)?\s*[-+]?\s*\d*\.?\d*(?:e[-+]?\d+)?\s*)\)\s*)?\s*(<=|>=|<|>|!=|\\leq|\\geq)\s*(-?\d+(\.\d+)?)",
    r"u\(x\)\s*-\s*\(\s*([-+]?\d*\.?\d+(?:e[-+]?\d+)?x\s*[-+]\s*[-+]?\d*\.?\d+(?:e[-+]?\d+)?)\s*\)\s*(<=|>=|<|>|=|!=|\\leq|\\geq)\s*(-?\d+(\.\d+)?)",
)

# Everything a clause is made of in one pass over its text: operator and time interval, position
# interval, and of the first pattern that is found anywhere the expression, comparison and
# threshold. What is not there is empty; no part can hold the comma between them.
_CLAUSE = rf"(?s)^(?=.*?{TIME_INTERVAL}|)(?=.*?{POSITION_INTERVAL}|)(?={'|'.join(f'.*?{e}' for e in EXPRESSIONS)}|).*\z"
_CLAUSE_PARTS = "$1,$2,$3,$4,$5,$7$12$17$22$26,$8$13$18$23$27,$9$14$19$24$28"
# Whole numbers do not begin with zeros.
_NUMBER = r"(?:(?:\d+\.\d*|\.\d+)(?:e[-+]?\d+)?|\d+e[-+]?\d+|0+|[1-9]\d*)"
_LINEAR = (
    rf"^(?:(?:([-+]?)({_NUMBER})\*?x|([-+]?)x\*(?:\(([-+]?)({_NUMBER})\)|([-+]?)({_NUMBER}))"
    rf"|([-+]?)x/(?:\(({_NUMBER})\)|({_NUMBER})))(?:([-+]{{1,2}})({_NUMBER}))?|.*)$"
)
# Signs and digits of the slope, of the divisor and of the intercept.
_LINEAR_PARTS = "$1$3$4$6,$2$5$7,$8,$9$10,$11,$12"

AND, OR = -1, -2


def split_formula(df: DataFrame, formula: str, prefix: str = "") -> DataFrame:
    """Add `clauses` (stripped texts) and `junctions` ('and' / 'or') of a formula."""
    # Cut in front of each junction, so that one pass finds both; the blank keeps the first clause.
    parts = F.split(F.concat(F.lit(" "), F.col(formula)), r"(?=\\l(?:and|or))")
    is_and = lambda part: F.startswith(part, F.lit("\\land"))

    def clause(part: Column, i: Column) -> Column:
        behind = F.when(i == 0, 1).when(is_and(part), 6).otherwise(5)
        return strip(F.substr(part, behind))

    marks = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return df.withColumn(f"{prefix}clauses", F.transform(parts, clause)).withColumn(
        f"{prefix}junctions", F.transform(marks, lambda m: F.when(is_and(m), "and").otherwise("or"))
    )


def bracket_steps(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add `steps`: the grouping of the clauses as postfix (clause index, AND, OR).

    A clause starting with G, F or U joins the open group, one starting with a bracket
    opens a group; its surplus of closing brackets ends groups. Other clauses are not
    part of the grouping. Members of a group are joined from left to right.
    """
    grouped = let(
        F.struct(F.col(f"{prefix}clauses").alias("clauses"), F.col(f"{prefix}junctions").alias("junctions")),
        lambda text: _grouping(text["clauses"], text["junctions"]),
    )
    return df.withColumn(f"{prefix}steps", grouped)


def _grouping(clauses: Column, junctions: Column) -> Column:
    """Fold over the clauses, holding the open groups and the steps so far."""

    def join_code(at: Column) -> Column:
        return F.when(F.get(junctions, at) == "and", AND).otherwise(OR)

    def codes(ends: Column) -> Column:
        # An ended group is joined to what stands before it, unless it came first (-1).
        return F.transform(F.filter(F.reverse(ends), lambda at: at >= 0), join_code)

    nothing = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).alias("clause"), F.lit(0).alias("placed"),
        nothing.alias("groups"), nothing.alias("steps"),
    )

    def seen(text: Column) -> Column:
        # Brackets are single bytes, so removing them leaves that many bytes fewer.
        without = lambda c: F.octet_length(swap(text, c))
        return let(
            F.substring(text, 1, 1),
            lambda first: F.struct(
                first.isin("G", "F", "U").alias("joins"), (first == "(").alias("opens"),
                (without("(") - without(")")).alias("surplus"),
            ),
        )

    def step(state: Column, clause: Column) -> Column:
        joins, opens, placed = clause["joins"], clause["opens"], state["placed"]
        before = placed - 1
        groups = F.when(opens, F.concat(state["groups"], F.array(before))).otherwise(state["groups"])
        added = F.when(
            joins & (placed > 0), F.array(state["clause"], join_code(before))
        ).otherwise(F.when(joins | opens, F.array(state["clause"])).otherwise(nothing))

        def moved(groups: Column, ended: Column) -> Column:
            kept = F.size(groups) - ended
            ends = F.when(ended > 0, codes(F.slice(groups, kept + 1, ended))).otherwise(nothing)
            return F.struct(
                (state["clause"] + 1).alias("clause"),
                (placed + (joins | opens).cast("int")).alias("placed"),
                F.when(ended > 0, F.slice(groups, 1, kept)).otherwise(groups).alias("groups"),
                F.concat(state["steps"], added, ends).alias("steps"),
            )

        def ended(groups: Column) -> Column:
            return F.struct(groups.alias("groups"), F.greatest(F.least(clause["surplus"], F.size(groups)), F.lit(0)).alias("ended"))

        return let(let(groups, ended), lambda x: moved(x["groups"], x["ended"]))

    return F.aggregate(
        F.transform(clauses, seen), start, step,
        lambda s: F.when(F.size(s["groups"]) > 0, F.concat(s["steps"], codes(s["groups"]))).otherwise(s["steps"]),
    )


def _signed(signs: Column, digits: Column) -> Column:
    """A number behind up to two signs; NULL without digits."""
    size = F.when(digits != "", digits.try_cast("double"))
    return F.when(signs.isin("-", "+-", "-+"), -size).otherwise(size)


def _linear(text: Column) -> Column:
    """Slope, divisor, intercept of `a*x + b`, `x*a + b` or `x/a + b`; NULL if neither.

    No text at all stands for the expression 0.
    """

    def numbers(slope: Column, divisor: Column, intercept: Column) -> Column:
        return F.struct(slope.alias("slope"), divisor.alias("divisor"), intercept.alias("intercept"))

    def from_parts(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        given = F.when(part(5) == "", 0.0).otherwise(_signed(part(4), part(5)))
        known = (part(1) != "") | (part(3) != "")
        return F.when(known, numbers(_signed(part(0), part(1)), _signed(part(2), part(3)), given))

    compact = F.regexp_replace(swap(text, "\\cdot", "*"), r"\s+", "")
    parted = F.regexp_like(text, F.lit(r"[\d.]\s+[\d.]"))
    none = numbers(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0))
    read = let(F.split(F.regexp_replace(compact, _LINEAR, _LINEAR_PARTS), ","), from_parts)
    return F.when(text == "", none).when(~parted, read)


def parse_clause(text: Column, index: Column) -> Column:
    """One clause as a struct.

    `status` is `failed` when a part is missing or malformed, `error` when the
    expression has none of the linear forms, else `ok`.
    """

    def read(parts: Column) -> Column:
        expression = parts["expression"]
        missing = parts["t_lo"].isNull() | parts["t_hi"].isNull() | parts["x_lo"].isNull() | parts["x_hi"].isNull()
        sign = parts["sign"]
        return F.struct(
            F.nullif(parts["operator"], F.lit("")).alias("operator"),
            parts["t_lo"].alias("t_lo"),
            parts["t_hi"].alias("t_hi"),
            parts["x_lo"].cast("bigint").alias("x_lo"),
            parts["x_hi"].cast("bigint").alias("x_hi"),
            expression["slope"].alias("slope"),
            expression["divisor"].alias("divisor"),
            expression["intercept"].alias("intercept"),
            F.when(sign == "\\leq", "<=").when(sign == "\\geq", ">=").otherwise(sign).alias("comparison"),
            parts["threshold"].alias("threshold"),
            index.cast("int").alias("index"),
            F.when(missing | sign.isNull(), "failed")
            .when(expression.isNull() | (expression["divisor"] == 0), "error")
            .otherwise("ok")
            .alias("status"),
        )

    def located(found: Column) -> Column:
        part = lambda i: F.get(found, F.lit(i))
        number = lambda i: F.when(part(i) != "", part(i).try_cast("double"))
        return let(
            F.struct(
                part(0).alias("operator"),
                number(1).alias("t_lo"),
                number(2).alias("t_hi"),
                number(3).alias("x_lo"),
                number(4).alias("x_hi"),
                F.when(part(6) != "", let(part(5), _linear)).alias("expression"),
                F.nullif(part(6), F.lit("")).alias("sign"),
                number(7).alias("threshold"),
            ),
            read,
        )

    return let(F.split(F.regexp_replace(text, _CLAUSE, _CLAUSE_PARTS), ","), located)


def parse_clauses(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add `parsed` (array of clause structs) and `status` of the whole formula.

    One failed or empty clause, or no formula at all, makes the formula `failed`; a
    formula whose grouping is empty is an `error`.
    """
    clauses, parsed = F.col(f"{prefix}clauses"), F.col(f"{prefix}parsed")
    failed = clauses.isNull() | F.exists(parsed, lambda c: c["status"] == "failed")
    wrong = F.exists(parsed, lambda c: c["status"] == "error")
    if f"{prefix}steps" in df.columns:
        wrong = wrong | (F.size(f"{prefix}steps") <= 0)
    # Blanks that Java patterns do not know as such become tabs. Long runs of blanks, as
    # broken completions have, only cost time: eight match all that more of them do.
    rare = "".join(c for c in WHITESPACE if c not in "\t\n\x0b\x0c\r ")
    plain = lambda c: F.regexp_replace(F.translate(c, rare, "\t" * len(rare)), r"\s{9,}", "\t" * 8)
    unusual = lambda c: F.contains(c, F.lit("  ")) | F.regexp_like(c, F.lit("[^ -~]"))
    shortened = F.transform(clauses, lambda c: F.when(unusual(c), plain(c)).otherwise(c))
    return df.withColumn(f"{prefix}parsed", F.transform(shortened, parse_clause)).withColumn(
        f"{prefix}status", F.when(failed, "failed").when(wrong, "error").otherwise("ok")
    )


def read_formula(df: DataFrame, formula: str, prefix: str = "") -> DataFrame:
    """Clauses, grouping and contents of one formula column."""
    return parse_clauses(bracket_steps(split_formula(df, formula, prefix), prefix), prefix)


def formula_domain(clauses: Column) -> Column:
    """`t_min, t_max, x_min, x_max` over parsed clauses, of one formula or of several."""
    picks = {
        "t_min": ("t_lo", F.array_min),
        "t_max": ("t_hi", F.array_max),
        "x_min": ("x_lo", F.array_min),
        "x_max": ("x_hi", F.array_max),
    }
    return let(clauses, lambda all_: F.struct(*[pick(all_[f]).alias(n) for n, (f, pick) in picks.items()]))
