"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document is a set of failed filters (bits of `mask`), so all a chain of n filters can do is
told by 2^n counts: how many documents a coalition of filters removes. Steps of an order are
differences of coalitions. A filter's share over all orders, its Shapley value, is the solution
of a least squares problem over the coalitions: kernel weights, and the shares add up to what
all filters remove together. The normal equations do not depend on the counts; they are solved
once, in rationals, for each coalition's unit, and the counts enter as whole numbers.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.joins import salted_join
from quillmesh.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n", "good", "toxic")


def text_rules(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: A few words, B repeated words, C capitals, D signs.

    Words are runs of anything but blanks; NULL is empty.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang", rules=text_rules, copies: str = "E") -> DataFrame:
    """Documents per (part, mask): `n`, and of these `good` and `toxic` by the labels.

    The bits of `mask` are the rules in order; the last one (`copies`) is failed by documents
    whose whole text is that of one with a smaller doc_id, in any part. Texts are compared by
    SHA-256; beyond the scan only that moves.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(rules(F.col("text")).values())]
    copy = 1 << len(bits)
    narrow = stored(
        docs.select(
            "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("_text"), sum(bits[1:], bits[0]).alias("mask"),
        ),
        "audit",
    )
    flags = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    no = F.lit(False)
    labelled = salted_join(narrow, flags, "doc_id", "_text", "left").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}
    )
    # Rows repeated in full meet first, then the copies of one text per part and label: what is
    # left of a text are a few rows, whatever the number of its copies.
    kind = ["_text", "part", "good", "toxic"]
    rows = labelled.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"), F.first("mask").alias("mask"))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")  # a row without id is never smaller
    kinds = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.first("mask").alias("mask"), F.min(F.struct(at.alias("at"), "n")).alias("_least")
    )
    first = F.min("_least.at").over(Window.partitionBy("_text"))
    originals = F.when(F.col("_least.at") == F.col("_first"), F.col("_least.n")).otherwise(0)
    split = F.array(
        F.struct(F.col("mask").alias("mask"), originals.alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - originals).alias("n")),
    )
    cells = kinds.withColumn("_first", first).select("part", "good", "toxic", F.inline(split))
    marked = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return cells.filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def _solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solutions of a regular system for several right-hand sides, by elimination."""
    size = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    for i in range(size):
        pivot = next(r for r in range(i, size) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for r in range(size):
            if r != i and rows[r][i]:
                factor = rows[r][i]
                rows[r] = [a - factor * b for a, b in zip(rows[r], rows[i])]
    return [row[size:] for row in rows]


def shares(n: int) -> list[list[Fraction]]:
    """`shares(n)[i][S]`: what one unit of the value of coalition S (a bit mask) gives filter i.

    The least squares fit of sum over i in S of x_i to the value of S, over all coalitions but
    the empty and the full one, weighted by (n - 1) / (C(n, s) s (n - s)), under the condition
    that all x_i add up to the value of the full one (the value of the empty one is 0).
    """
    coalitions = range(1 << n)
    weight = {
        s: Fraction(n - 1, comb(n, size) * size * (n - size)) for s in coalitions if 0 < (size := s.bit_count()) < n
    }
    inside = lambda s, i: s >> i & 1
    matrix = [
        [sum((w for s, w in weight.items() if inside(s, i) and inside(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)]
        for i in range(n)
    ] + [[Fraction(1)] * n + [Fraction(0)]]
    # One right-hand side per coalition: that it alone has the value 1.
    right = [[weight.get(s, Fraction(0)) * inside(s, i) for s in coalitions] for i in range(n)]
    right.append([Fraction(int(s == (1 << n) - 1)) for s in coalitions])
    return _solve(matrix, right)[:n]


def _whole(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def audit(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step of that order.

    `counts` has part, mask, n, good, toxic (as `failures` gives them; bit i of mask is the i-th
    letter of `filters`). `shapley` is summed over all orders, so it is a whole number.
    """
    n = len(filters)
    everything = (1 << n) - 1
    # What each coalition removes, of all, of good and of toxic documents.
    removed = lambda c, s: F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0))
    tabulated = counts.groupBy("part").agg(
        F.sum("n").alias("_rows"), *[F.array(*[removed(c, s) for s in range(1 << n)]).alias(f"_{c}") for c in COUNTS]
    )
    # All shares of one filter over a common denominator.
    values = []
    for row in [[v * factorial(n) for v in share] for share in shares(n)]:
        below = lcm(*[v.denominator for v in row])
        whole = F.zip_with(_whole([int(v * below) for v in row]), "_n", lambda a, b: a * b)
        total = F.aggregate(whole, F.lit(0).cast("bigint"), lambda a, b: a + b)
        values.append((total / below).cast("bigint") if below > 1 else total)
    steps = ", ".join(
        f"struct('{''.join(order)}' AS filter_order, {i + 1}L AS step, {sum(1 << filters.index(f) for f in order[:i])} AS _before, {filters.index(f)} AS _filter, {1 << filters.index(f)} AS _own)"
        for order in permutations(filters) for i, f in enumerate(order)
    )
    rows = tabulated.withColumn("_shares", F.array(*values)).select("*", F.inline(F.expr(f"array({steps})")))
    own = F.col("_own")
    after = F.col("_before") + own
    with_, without = lambda c: F.get(f"_{c}", after), lambda c: F.get(f"_{c}", F.col("_before"))
    lost = lambda c: with_(c) - without(c)
    return rows.select(
        "part", "filter_order", "step", (F.col("_rows") - with_("n")).alias("kept"), lost("n").alias("removed"),
        (F.get("_n", own) - lost("n")).alias("redundant"),
        (F.get("_n", F.lit(everything)) - F.get("_n", F.lit(everything) - own)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("_shares", F.col("_filter")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Audit the five filters A to E on documents (doc_id, text and `part`; more columns are
    ignored) and labels (doc_id, quality, toxic).

    NULL texts are empty, NULL parts the empty string. Of equal texts those without doc_id count
    as the last ones; rows that share a doc_id are not copies of each other. A document that any
    of its label rows calls good (toxic) is good (toxic); one without labels is neither. An
    empty table gives no rows.
    """
    return audit(failures(docs, labels, part))
