"""Truth of formulas on a grid of linear profiles u(t) = m t + b, and their overlap.

Cells are (profile, time). The offsets b of one slope are the bits of BIGINT words, 62 in
each, so a clause is one number per (slope, word, time), `and` / `or` are single bit
operations and a count is `bit_count`. A (slope, word) is called a plane; planes have nothing
to do with each other, so a grid may have any number of offsets.

Formulas are looked up, not pairs: each distinct text is read once, each distinct (formula,
domain) turned into masks once, and pairs only meet their masks. What moves are hashes of
texts and masks; the rows of a table move once, when they meet their scores.

Two facts keep the numbers exact and few. For `<, <=, >, >=` the hardest grid point x is
one of the two ends, because the expression is linear. And for a fixed slope and time the
comparison can only change once as b grows, so one place of change stands for all
offsets; it is confirmed by the floating-point comparison a cell-by-cell test would make.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.arrays import indexes, last, let
from quillmesh.functions.joins import merge_join, salted_join
from quillmesh.functions.text import as_column
from quillmesh.operators.formulas import AND, formula_domain, read_formula

# Fixed value: steps per axis of the time and position grids.
AXIS_STEPS = 50
_EDGE = 1e-7
# Bits of a word: sums of two words stay below the sign of a BIGINT.
WORD = 62
DOMAIN = ["t_min", "t_max", "x_min", "x_max"]


@dataclass(frozen=True)
class ProfileGrid:
    """Slopes and offsets of the profiles; 62 offsets of a slope share one BIGINT."""

    # The ranges that slopes and offsets are taken from.
    m_min: float = -7.0
    m_max: float = 7.0
    m_steps: int = 50
    b_min: float = -500.0
    b_max: float = 500.0
    b_steps: int = 50

    def __post_init__(self) -> None:
        if self.b_steps < 1 or self.m_steps < 1:
            raise ValueError("at least one offset and one slope")

    @staticmethod
    def _points(low: float, high: float, steps: int) -> list[float]:
        width = (high - low) / steps
        gap = (low + width) - low
        return [low + i * gap for i in range(steps)]

    @property
    def slopes(self) -> list[float]:
        return self._points(self.m_min, self.m_max, self.m_steps)

    @property
    def offsets(self) -> list[float]:
        return self._points(self.b_min, self.b_max, self.b_steps)

    @property
    def words(self) -> list[int]:
        """Offsets in each word of a slope."""
        return [min(WORD, self.b_steps - at) for at in range(0, self.b_steps, WORD)]

    @property
    def planes(self) -> int:
        return self.m_steps * len(self.words)

    def slope_of(self, plane: Column) -> Column:
        many = len(self.words)
        return plane if many == 1 else F.floor(plane / many).cast("int")

    def word_of(self, plane: Column) -> Column:
        return F.lit(0) if len(self.words) == 1 else plane % len(self.words)

    def full(self, plane: Column) -> Column:
        """The mask of all offsets of a plane."""
        return F.get(_whole([(1 << n) - 1 for n in self.words]), self.word_of(plane))


def profile_grid(spark: SparkSession, grid: ProfileGrid = ProfileGrid()) -> DataFrame:
    """The profiles as rows: `profile`, `m`, `b`, slopes outermost."""
    slope = F.floor(F.col("id") / grid.b_steps).cast("int")
    offset = (F.col("id") % grid.b_steps).cast("int")
    return spark.range(grid.m_steps * grid.b_steps).select(
        F.col("id").alias("profile"),
        F.get(_numbers(grid.slopes), slope).alias("m"),
        F.get(_numbers(grid.offsets), offset).alias("b"),
    )


def _numbers(values: list[float]) -> Column:
    """A constant array of doubles (as SQL text, which takes one call instead of one each)."""
    texts = [f"double('{v}')" if math.isinf(v) else f"{v!r}D" for v in values]
    return F.expr(f"array({', '.join(texts)})")


def _whole(values: list[int], kind: str = "bigint") -> Column:
    return F.expr(f"cast(array({', '.join(f'{v}L' for v in values)}) as array<{kind}>)")


def _axis(low: Column, high: Column, backwards: Column) -> Column:
    """Grid points from `low` to `high` and one step beyond, in rising order.

    Walking backwards starts at `high` and passes `low` by a step instead.
    """
    step = (high - low) / F.lit(AXIS_STEPS)

    def points(start: Column, width: Column, stop: Column) -> Column:
        count = F.ceil((stop - start) / width).cast("int")
        gap = (start + width) - start
        return F.transform(
            indexes(count), lambda i: F.when(i == 1, start + width).otherwise(start + i * gap)
        )

    edge = F.lit(_EDGE)
    return F.when(backwards, F.reverse(points(high, -step, low - step - edge))).otherwise(
        points(low, step, high + step + edge)
    )


def _gap(grid: ProfileGrid) -> float:
    return grid.offsets[1] - grid.offsets[0] if grid.b_steps > 1 else 1.0


def _prepare(clause: Column, domain: Column, align: str, grid: ProfileGrid) -> Column:
    """What a clause needs on the grid, worked out once per clause.

    `times` are the grid times inside its interval, with `lead` vacuous ones before and
    `tail` after; without a grid position inside its interval all times are vacuous.
    """
    backwards = (clause["operator"] == "F") & F.lit(align == "reference")
    low, high = domain["x_min"].cast("double"), domain["x_max"].cast("double")

    def expression(x: Column) -> Column:
        scaled = F.when(clause["divisor"].isNotNull(), x / clause["divisor"]).otherwise(
            clause["slope"] * x
        )
        return scaled + clause["intercept"]

    def inside(axes: Column) -> Column:
        # Grid points of the clause; no position means no time either.
        here = F.filter(axes["places"], lambda x: (x >= clause["x_lo"]) & (x <= clause["x_hi"]))
        now = F.filter(axes["times"], lambda t: (t >= clause["t_lo"]) & (t <= clause["t_hi"]))
        early = F.filter(axes["times"], lambda t: t < clause["t_lo"])
        found = let(
            here,
            lambda xs: F.struct(
                F.size(axes["times"]).alias("all"),
                F.when(F.size(xs) > 0, now).otherwise(F.array().cast("array<double>")).alias("times"),
                F.when(F.size(xs) > 0, F.size(early)).otherwise(0).alias("lead"),
                F.array(expression(F.get(xs, F.lit(0))), expression(last(xs))).alias("ends"),
                xs.alias("places"),
            ),
        )
        return let(found, described)

    def described(found: Column) -> Column:
        ends, times = found["ends"], found["times"]
        lead = F.when(F.size(times) > 0, found["lead"]).otherwise(found["all"])
        below = clause["comparison"].isin("<", "<=")
        ordered = clause["comparison"].isin("<", "<=", ">", ">=")
        # With mirrored profiles the offsets fall. Changing every sign lets them rise, and
        # then each comparison reads "value < limit" (or <=) for a first run of offsets:
        # the true ones, or for the opposite comparisons the false ones.
        sign = F.when(backwards, -1.0).otherwise(1.0)
        true_first = below != backwards
        first = F.when(backwards, grid.offsets[-1]).otherwise(grid.offsets[0])

        def target(level: Column) -> Column:
            place = sign * (clause["threshold"] + level - first) / _gap(grid)
            return F.struct(level.alias("level"), place.alias("target"))

        return F.struct(
            clause["operator"].alias("operator"),
            clause["comparison"].alias("comparison"),
            clause["threshold"].alias("threshold"),
            ordered.alias("ordered"),
            backwards.alias("mirrored"),
            true_first.alias("true_first"),
            (clause["comparison"].isin("<=", ">=") == true_first).alias("closed_run"),
            (sign * clause["threshold"]).alias("limit"),
            (sign * F.when(below, F.array_min(ends)).otherwise(F.array_max(ends))).alias("level"),
            F.when(ordered, F.array().cast("array<struct<level:double,target:double>>"))
            .otherwise(F.transform(F.array_distinct(F.transform(found["places"], expression)), target))
            .alias("levels"),
            (F.abs(clause["threshold"]) + F.greatest(F.abs(F.get(ends, F.lit(0))), F.abs(F.get(ends, F.lit(1)))) + F.abs(first))
            .alias("largest"),
            times.alias("times"),
            lead.alias("lead"),
            (found["all"] - lead - F.size(times)).alias("tail"),
        )

    axes = F.struct(
        _axis(domain["t_min"], domain["t_max"], backwards).alias("times"),
        _axis(low, high, backwards).alias("places"),
    )
    return let(axes, inside)


def _run_length(clause: Column, base: Column, grid: ProfileGrid) -> Column:
    """How many offsets, from the first, give values on the low side of the limit.

    The place is estimated and then confirmed by the exact comparison at its two sides;
    where rounding puts the estimate off, halving finds it with the same comparison.
    """
    infinity = float("inf")
    count, gap = grid.b_steps, _gap(grid)
    rising, turned = grid.offsets, [-b for b in reversed(grid.offsets)]
    # Offset i (from 1) at place i, with an always low one before and never low ones behind.
    tail = [infinity] * (2 ** count.bit_length() - count)
    fenced = F.when(clause["mirrored"], _numbers([-infinity, *turned, *tail])).otherwise(
        _numbers([-infinity, *rising, *tail])
    )
    first = F.when(clause["mirrored"], F.lit(turned[0])).otherwise(F.lit(rising[0]))

    def low(place: Column) -> Column:
        value = base + F.get(fenced, place) - clause["level"]
        return F.when(clause["closed_run"], value <= clause["limit"]).otherwise(
            value < clause["limit"]
        )

    halves = _whole([1 << i for i in reversed(range(count.bit_length()))], "int")
    searched = F.aggregate(
        halves, F.lit(0), lambda n, half: F.when(low(n + half), n + half).otherwise(n)
    )
    estimate = (clause["limit"] + clause["level"] - base - first) / gap
    bounded = F.least(F.greatest(estimate, F.lit(0.0)), F.lit(float(count)))
    return let(
        F.ceil(bounded).cast("int"),
        lambda n: F.when(low(n) & ~low(n + 1), n).otherwise(searched),
    )


def _ordered_truth(clause: Column, plane: Column, slope: Column, time: Column, grid: ProfileGrid) -> Column:
    """Bits of the offsets whose profile meets a `<, <=, >, >=` clause at `time`."""
    lower = _whole([(1 << n) - 1 for n in range(max(grid.words) + 1)])
    sign = F.when(clause["mirrored"], -1.0).otherwise(1.0)

    def inside(run: Column) -> Column:
        # How much of the run lies in the word of the plane.
        if len(grid.words) == 1:
            return run
        size = F.get(_whole(grid.words, "int"), grid.word_of(plane))
        return F.least(F.greatest(run - grid.word_of(plane) * WORD, F.lit(0)), size)

    def bits(base: Column) -> Column:
        run = F.get(lower, inside(_run_length(clause, base, grid)))
        return F.when(clause["true_first"], run).otherwise(run.bitwiseXOR(grid.full(plane)))

    return let(sign * (slope * time), bits)


def _scale(clause: Column, grid: ProfileGrid) -> Column:
    """Steps of the grid per unit of value."""
    return F.when(clause["mirrored"], F.lit(-1 / _gap(grid))).otherwise(F.lit(1 / _gap(grid)))


def _near_levels(clause: Column, slope: Column, grid: ProfileGrid) -> Column:
    """The levels of an equation that an offset may meet at some time of the clause.

    The place of a level moves one way as time goes by, so its places at the first and the last
    time show whether it comes near a whole number. Where numbers are large, all levels.
    """
    times, scale = clause["times"], _scale(clause, grid)

    def near(bases: Column) -> Column:
        largest = clause["largest"] + F.greatest(F.abs(bases["first"]), F.abs(bases["last"]))

        def comes_near(ends: Column) -> Column:
            low, high = ends["low"] - 2e-3, ends["high"] + 2e-3
            return (F.floor(high) >= F.ceil(low)) & (high > -1) & (low < grid.b_steps)

        def passes(level: Column) -> Column:
            at_first = level["target"] - bases["first"] * scale
            at_last = level["target"] - bases["last"] * scale
            return let(F.struct(F.least(at_first, at_last).alias("low"), F.greatest(at_first, at_last).alias("high")), comes_near)

        return F.when(largest < 1e9 * _gap(grid), F.filter(clause["levels"], passes)).otherwise(clause["levels"])

    ends = F.struct((slope * F.get(times, F.lit(0))).alias("first"), (slope * last(times)).alias("last"))
    return let(ends, near)


def _never_met(clause: Column, levels: Column) -> Column:
    """Whether an equation has the same truth for all offsets and times of a plane."""
    return F.when(clause["comparison"] == "=", F.size(levels) < F.size(clause["levels"])).otherwise(F.size(levels) == 0)


def _equal_truth(clause: Column, levels: Column, plane: Column, slope: Column, time: Column, grid: ProfileGrid) -> Column:
    """The same for `=` and `!=`, which are tested at every position of `levels` (see `_near_levels`).

    A position is met by one offset at most, whose place is its `target` less the value at
    offset 0 in steps of the grid. Only positions whose place is nearly whole are compared
    exactly; where numbers are so large that rounding could reach another offset, every offset
    is tested at every position.
    """
    single = _whole([1 << n for n in range(max(grid.words))])
    full, none = grid.full(plane), F.lit(0).cast("bigint")
    size, start = F.get(_whole(grid.words, "int"), grid.word_of(plane)), grid.word_of(plane) * WORD
    offsets = F.when(clause["mirrored"], _numbers(grid.offsets[::-1])).otherwise(_numbers(grid.offsets))
    scale = _scale(clause, grid)
    equal = clause["comparison"] == "="

    def bits(base: Column) -> Column:
        def meets(level: Column, j: Column) -> Column:
            # The bit of offset j of the word where its profile meets the level.
            here = (j >= 0) & (j < size) & (base + F.get(offsets, start + j) - level == clause["threshold"])
            return F.when(here, F.get(single, j)).otherwise(none)

        def by_place(shift: Column) -> Column:
            place = lambda x: x["target"] - shift
            near = F.filter(levels, lambda x: F.abs(place(x) - F.rint(place(x))) < 1e-3)
            within = F.filter(near, lambda x: (place(x) > -1) & (place(x) < grid.b_steps))
            return F.transform(within, lambda x: meets(x["level"], F.rint(place(x)).cast("int") - start))

        def everywhere(x: Column) -> Column:
            return F.aggregate(indexes(size), none, lambda mask, j: mask.bitwiseOR(meets(x["level"], j)))

        def read(found: Column) -> Column:
            # `=` needs every position, and those that are no candidates meet nothing.
            all_ = F.aggregate(found, full, lambda a, b: a.bitwiseAND(b))
            any_ = F.aggregate(found, none, lambda a, b: a.bitwiseOR(b))
            whole = F.size(found) == F.size(clause["levels"])
            return F.when(equal, F.when(whole, all_).otherwise(none)).otherwise(any_.bitwiseXOR(full))

        small = clause["largest"] + F.abs(base) < 1e9 * _gap(grid)
        places = F.when(small, let(base * scale, by_place)).otherwise(F.transform(levels, everywhere))
        return let(places, read)

    return let(slope * time, bits)


def _slope(clause: Column, plane: Column, grid: ProfileGrid) -> Column:
    place = grid.slope_of(plane)
    mirrored = F.get(_numbers(grid.slopes[::-1]), place)
    return F.when(clause["mirrored"], mirrored).otherwise(F.get(_numbers(grid.slopes), place))


def truth_masks(clause: Column, plane: Column, grid: ProfileGrid) -> Column:
    """One mask per non-vacuous time for one plane."""

    times = clause["times"]
    constant = F.when(clause["comparison"] == "=", F.lit(0).cast("bigint")).otherwise(grid.full(plane))

    def masks(m: Column) -> Column:
        def equations(levels: Column) -> Column:
            each = F.transform(times, lambda t: _equal_truth(clause, levels, plane, m, t, grid))
            return F.when(_never_met(clause, levels), F.array_repeat(constant, F.size(times))).otherwise(each)

        return F.when(clause["ordered"], by_ends(m)).otherwise(let(_near_levels(clause, m, grid), equations))

    def by_ends(m: Column) -> Column:
        # The masks move one way as time goes by: two equal ends are what all times have.
        at = lambda t: _ordered_truth(clause, plane, m, t, grid)
        same = lambda ends: F.get(ends, F.lit(0)) == F.get(ends, F.lit(1))
        repeated = lambda ends: F.array_repeat(F.get(ends, F.lit(0)), F.size(times))
        ends = F.transform(F.array(F.get(times, F.lit(0)), last(times)), at)
        return let(ends, lambda found: F.when(same(found), repeated(found)).otherwise(F.transform(times, at)))

    return let(_slope(clause, plane, grid), masks)


def closed_masks(clause: Column, plane: Column, grid: ProfileGrid) -> Column:
    """One mask per grid time after `always` (G) or `eventually` (F) along each profile.

    always: false wherever the profile fails once, except at vacuous times behind the
    failure. eventually: true while a true time is still to come, and at vacuous times.
    For the four order comparisons u moves one way in time, so the first and the last
    time decide, unless an `eventually` grows harder with time.
    """
    full, none = grid.full(plane), F.lit(0).cast("bigint")
    times, lead = clause["times"], clause["lead"]
    count = F.size(times)
    tail = F.array_repeat(full, clause["tail"])
    every = lambda masks: F.aggregate(masks, full, lambda a, b: a.bitwiseAND(b))

    def closed(masks: Column, to_come: Column) -> Column:
        always = let(every(masks), lambda a: F.concat(F.array_repeat(a, lead + count), tail))
        eventually = F.concat(F.array_repeat(full, lead), to_come, tail)
        return F.when(clause["operator"] == "G", always).otherwise(eventually)

    # A walk has two points more than steps at most.
    halves = _whole([1 << i for i in reversed(range((AXIS_STEPS + 2).bit_length()))], "int")

    def by_ends(m: Column) -> Column:
        at = lambda t: _ordered_truth(clause, plane, m, t, grid)
        ends = F.transform(F.array(F.get(times, F.lit(0)), last(times)), at)

        def read(first_last: Column) -> Column:
            latest = F.get(first_last, F.lit(1))
            first = F.get(first_last, F.lit(0))
            easier = first.bitwiseOR(latest) == latest
            # The masks shrink as time goes by; with one bit to lose, halving finds when.
            still = F.aggregate(
                halves, F.lit(0),
                lambda n, half: F.when((n + half < count) & (at(F.get(times, n + half)) == first), n + half).otherwise(n),
            )
            two = let(still + 1, lambda n: F.concat(F.array_repeat(first, n), F.array_repeat(latest, count - n)))
            to_come = (
                F.when(easier, F.array_repeat(latest, count))
                .when(F.bit_count(first.bitwiseXOR(latest)) == 1, two)
                .otherwise(F.transform(times, lambda t: at(t).bitwiseOR(latest)))
            )
            return closed(first_last, to_come)

        return let(ends, read)

    def by_all(m: Column) -> Column:
        nothing = F.array().cast("array<bigint>")
        constant = F.when(clause["comparison"] == "=", none).otherwise(full)
        add = lambda done, mask: F.concat(done, F.array(F.coalesce(last(done), none).bitwiseOR(mask)))

        def read(all_: Column) -> Column:
            # What the last time has is still to come at all times.
            every_one = F.aggregate(all_, none, lambda a, b: a.bitwiseOR(b)) == last(all_)
            folded = F.reverse(F.aggregate(F.reverse(all_), nothing, add))
            return closed(all_, F.when(every_one, F.array_repeat(last(all_), count)).otherwise(folded))

        def equations(levels: Column) -> Column:
            masks = F.transform(times, lambda t: _equal_truth(clause, levels, plane, m, t, grid))
            same = closed(F.array(constant), F.array_repeat(constant, count))
            return F.when(_never_met(clause, levels), same).otherwise(let(masks, read))

        return let(_near_levels(clause, m, grid), equations)

    return F.when(count == 0, F.concat(F.array_repeat(full, lead), tail)).otherwise(
        let(
            _slope(clause, plane, grid),
            lambda m: F.when(clause["ordered"], by_ends(m)).otherwise(by_all(m)),
        )
    )


def combine_masks(masks: Column, steps: Column) -> Column:
    """Clause masks joined by the postfix steps of the formula (no precedence)."""

    def step(stack: Column, code: Column) -> Column:
        depth = F.size(stack)
        left, right = F.get(stack, depth - 2), F.get(stack, depth - 1)
        both = F.zip_with(left, right, lambda a, b: a.bitwiseAND(b))
        either = F.zip_with(left, right, lambda a, b: a.bitwiseOR(b))
        merged = F.when(code == AND, both).otherwise(either)
        return F.when(code >= 0, F.concat(stack, F.array(F.get(masks, code)))).otherwise(
            F.concat(F.slice(stack, 1, depth - 2), F.array(merged))
        )

    empty = F.array().cast("array<array<bigint>>")
    return F.aggregate(steps, empty, step, lambda stack: F.get(stack, F.lit(0)))


def formula_masks(read: Column, grid: ProfileGrid) -> Column:
    """The masks of a whole formula, all times of one plane after the other.

    `read` has `clauses` (prepared ones) and `steps`.
    """
    planes = indexes(F.lit(grid.planes))
    # The steps are taken once, over all planes of the clauses, and not again for each plane.
    of_clause = lambda c: F.flatten(F.transform(planes, lambda plane: closed_masks(c, plane, grid)))
    return let(F.transform(read["clauses"], of_clause), lambda masks: combine_masks(masks, read["steps"]))


def formula_key(text: Column | str) -> Column:
    """128 bits that stand for a formula; NULL is the empty text."""
    return F.md5(F.coalesce(as_column(text), F.lit("")).cast("binary"))


def _dealt(df: DataFrame, *key: str) -> DataFrame:
    """Deal narrow rows of heavy work (milliseconds for some hundred bytes) out by key.

    Adaptive execution would join their partitions by bytes, so the number is given: as many as
    the session's shuffles have, and four for each core at least. The rows are distinct and lie
    by a hash of the key, which no later join takes for its own exchange; that one stays free to
    be split where a key is hot.
    """
    spark = df.sparkSession
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    least = 4 * spark.sparkContext.defaultParallelism
    return df.repartition(max(least, int(usual) if usual.isdigit() else 0), F.xxhash64(*key))


def formula_dictionary(df: DataFrame, *columns: str) -> DataFrame:
    """Every distinct formula of the given columns, read once: `formula` (its key) and `read`
    (`status`, `parsed`, `steps`)."""
    each = [F.struct(formula_key(c).alias("formula"), F.coalesce(c, F.lit("")).alias("text")) for c in columns]
    texts = df.select(F.inline(F.array(*each))).distinct()
    return read_formula(_dealt(texts, "formula"), "text").select("formula", F.struct("status", "parsed", "steps").alias("read"))


def read_pairs(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """The distinct pairs of formulas: `_truth`, `_pred` (see `formula_key`), what was read of
    both (`truth`, `pred`), their common domain and one `status`.

    `failed`: a formula cannot be read. `error`: it can, but has no value on the grid (an
    axis of width zero, an empty grouping, an expression that is not linear).

    A pair is two lines that look their formula up and meet again, so the dictionary is in the
    plan once. Reads are bound as whole values: every use of the pairs then has the same
    exchange below it, and a plan that needs them twice computes them once.
    """
    key = ["_truth", "_pred"]
    pairs = df.select(formula_key(truth).alias("_truth"), formula_key(pred).alias("_pred")).distinct()
    sides = [F.struct(F.lit(i).alias("_side"), F.col(c).alias("formula")) for i, c in enumerate(key)]
    looked_up = merge_join(pairs.select(*key, F.inline(F.array(*sides))), formula_dictionary(df, truth, pred), "formula")
    of_side = lambda i: F.first(F.when(F.col("_side") == i, F.col("read")), ignorenulls=True)
    described = let(
        F.array(of_side(0), of_side(1)),
        lambda reads: F.struct(
            F.transform(reads, lambda f: f["status"]).alias("states"),
            formula_domain(F.flatten(F.transform(reads, lambda f: f["parsed"]))).alias("domain"),
        ),
    )
    # Made by the aggregate: a filter of the pairs stays above it and does not make it again.
    found = looked_up.groupBy(*key).agg(of_side(0).alias("truth"), of_side(1).alias("pred"), described.alias("_found"))
    named = found.select(*key, "truth", "pred", "_found.states", *[F.col("_found.domain")[c].alias(c) for c in DOMAIN])
    flat = (F.col("t_min") == F.col("t_max")) | (F.col("x_min") == F.col("x_max"))
    status = (
        F.when(F.array_contains("states", "failed"), "failed")
        .when(F.array_contains("states", "error") | F.coalesce(flat, F.lit(True)), "error")
        .otherwise("ok")
    )
    return named.withColumn("status", status).drop("states")


def _prepared(read: str, align: str, grid: ProfileGrid) -> Column:
    """What the masks of a formula on the domain of its row are made of: `clauses`, `steps`."""
    if align not in ("reference", "time"):
        raise ValueError(f"unknown alignment: {align}")
    return let(
        F.struct(F.col(read).alias("read"), F.struct(*DOMAIN).alias("domain")),
        lambda f: F.struct(
            F.transform(f["read"]["parsed"], lambda c: _prepare(c, f["domain"], align, grid)).alias("clauses"),
            f["read"]["steps"].alias("steps"),
        ),
    )


def pair_masks(
    df: DataFrame, truth: str = "sstl", pred: str = "predicted_sstl", align: str = "reference",
    grid: ProfileGrid = ProfileGrid(),
) -> DataFrame:
    """The distinct pairs of formulas with the masks of both on their common domain: `_truth`,
    `_pred` (see `formula_key`), `status`, the domain, `truth`, `pred` (NULL unless `ok`).

    Many predictions share a true formula: its masks are made once per domain and joined. A
    prediction has its masks made in its own row, once per distinct pair.
    """
    pairs = read_pairs(df, truth, pred)
    masks = let(_prepared("_read", align, grid), lambda f: formula_masks(f, grid))  # built once for both sides
    true = pairs.filter("status = 'ok'").groupBy("_truth", *DOMAIN).agg(F.first("truth").alias("_read"))
    shared = _dealt(true, "_truth", *DOMAIN).select("_truth", *DOMAIN, masks.alias("truth"))
    seen = merge_join(pairs.drop("truth").withColumnRenamed("pred", "_read"), shared, ["_truth", *DOMAIN], "left")
    return seen.withColumn("pred", F.when(F.col("status") == "ok", masks)).drop("_read")


def formula_iou(
    df: DataFrame, truth: str = "sstl", pred: str = "predicted_sstl",
    align: str = "reference", grid: ProfileGrid = ProfileGrid(),
) -> DataFrame:
    """Add `both`, `either`, `iou` and `status`: overlap of two formulas over all cells.

    `align='reference'` stores `eventually` clauses with the profiles in reverse and one
    time step earlier, as published scores do; `align='time'` compares equal cells.
    An empty union scores 1; a pair without `ok` status has NULL.
    """
    high = 1 << 32  # both counts of a pair in one BIGINT: shared cells above, all cells below
    cells = F.zip_with(
        "truth", "pred",
        lambda a, b: F.bit_count(a.bitwiseAND(b)) * F.lit(high) + F.bit_count(a.bitwiseOR(b)),
    )
    counts = F.aggregate(cells, F.lit(0).cast("bigint"), lambda n, c: n + c)
    scores = pair_masks(df, truth, pred, align, grid).select(
        "_truth", "_pred", F.when(F.col("status") == "ok", counts).alias("_cells"), "status"
    )
    keyed = df.withColumns({"_truth": formula_key(truth), "_pred": formula_key(pred)})
    score = F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either"))
    return (
        merge_join(keyed, scores, ["_truth", "_pred"])
        .withColumn("both", F.shiftright("_cells", 32))
        .withColumn("either", F.col("_cells").bitwiseAND(F.lit(high - 1)))
        .withColumn("iou", F.when(F.col("status") == "ok", score))
        .select(*df.columns, "both", "either", "iou", "status")
    )


def clause_truth(
    df: DataFrame, key: str, truth: str, pred: str, align: str = "reference",
    grid: ProfileGrid = ProfileGrid(),
) -> DataFrame:
    """One row per (row of `df`, formula, clause) with the masks of every plane.

    `truth` holds per plane the masks of the non-vacuous times, `closed` those of all
    times after the temporal operator.
    """
    planes = indexes(F.lit(grid.planes))

    def described(clause: Column, i: Column) -> Column:
        return F.struct(
            i.alias("clause"),
            F.transform(planes, lambda p: truth_masks(clause, p, grid)).alias("truth"),
            F.transform(planes, lambda p: closed_masks(clause, p, grid)).alias("closed"),
            (clause["lead"] + clause["tail"]).alias("vacuous_times"),
        )

    pairs = read_pairs(df, truth, pred).filter("status = 'ok'")
    sides = [F.struct(F.lit(c).alias("side"), F.col(f"_{c}").alias("formula"), F.col(c).alias("read")) for c in ("truth", "pred")]
    each = pairs.select("_truth", "_pred", *DOMAIN, F.inline(F.array(*sides)))
    distinct = each.groupBy("formula", *DOMAIN).agg(F.first("read").alias("read"))
    clauses = _dealt(distinct, "formula", *DOMAIN).select(
        "formula", *DOMAIN, let(_prepared("read", align, grid), lambda f: F.transform(f["clauses"], described)).alias("_clauses")
    )
    keyed = df.select(key, formula_key(truth).alias("_truth"), formula_key(pred).alias("_pred"))
    wanted = merge_join(keyed, each.drop("read"), ["_truth", "_pred"])
    # A formula that is `ok` has clauses, so the outer form adds no row. The plain one filters by
    # the size of its array, which would make the masks two more times before they are dealt out.
    return merge_join(wanted, clauses, ["formula", *DOMAIN]).select(
        key, F.col("side").alias("formula"), F.inline_outer("_clauses")
    )


def count_bits(masks: Column) -> Column:
    """Set bits of an array of arrays of masks."""
    return F.aggregate(
        F.flatten(masks), F.lit(0).cast("bigint"), lambda n, mask: n + F.bit_count(mask)
    )


def _closed(
    df: DataFrame, key: str, time: str, state: str, names: dict[str, str]
) -> DataFrame:
    """Row forms of the temporal operators along `time` inside each `key`.

    All they need of the other rows is the last false and the last true time of the key:
    one aggregate, combined before its shuffle, and one join that cuts hot keys into parts. A
    key with a third of all rows is neither sorted nor held by one task.
    """
    held, at = F.col(state), F.col(time)
    ends = df.groupBy(key).agg(
        F.max(F.when(~held, at)).alias("_last_false"),
        F.max(F.when(held, at)).alias("_last_true"),
        F.count(F.lit(1)).alias("_rows"),
    )
    sizes = ends.select(key, "_rows")
    seen = salted_join(df, ends.drop("_rows"), key, time, "left", sizes)
    forms = {
        "always": F.col("_last_false").isNull()
        | F.coalesce(held.isNull() & (at > F.col("_last_false")), F.lit(False)),
        "eventually": held.isNull() | F.coalesce(at <= F.col("_last_true"), F.lit(False)),
    }
    added = {name: forms[form] for form, name in names.items()}
    return seen.withColumns(added).drop("_last_false", "_last_true")


def always(df: DataFrame, key: str, time: str, state: str, name: str = "always") -> DataFrame:
    """G: nothing in the key is false, or the time is vacuous (NULL) and behind the last false."""
    return _closed(df, key, time, state, {"always": name})


def eventually(df: DataFrame, key: str, time: str, state: str, name: str = "eventually") -> DataFrame:
    """F: the time is vacuous (NULL), or a true one stands at it or after it."""
    return _closed(df, key, time, state, {"eventually": name})


def always_and_eventually(df: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """Both at the price of one, as columns `always` and `eventually`."""
    return _closed(df, key, time, state, {"always": "always", "eventually": "eventually"})
