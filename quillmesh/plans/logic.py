"""Queries over temporal-logic formulas, whose texts are built from whole numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.arrays import joined
from quillmesh.functions.joins import merge_join
from quillmesh.operators import formulas, logic
from quillmesh.plans.catalog import query, table

SMALL = logic.ProfileGrid(m_steps=4, b_steps=4)
WIDE = logic.ProfileGrid(m_steps=3, b_steps=100)
# Key and size column of the tables that formula pairs are built from.
PAIR_COLUMNS = {"part": ("p_partkey", "p_size"), "supplier": ("s_suppkey", "s_nationkey")}


def tenths(value: Column) -> Column:
    """A whole number of tenths as decimal text."""
    whole = F.floor(value / 10).cast("bigint").cast("string")
    return F.concat(whole, F.lit("."), (value % 10).cast("bigint").cast("string"))


def hundredths(value: Column) -> Column:
    size = F.abs(value)
    whole = F.floor(size / 100).cast("bigint").cast("string")
    part = F.lpad((size % 100).cast("bigint").cast("string"), 2, "0")
    return F.concat(F.when(value < 0, "-").otherwise(""), whole, F.lit("."), part)


SIGNS = ["<", ">", "\\leq", "\\geq", "=", "!="]
# Sums of the right-hand side of equations, so that some hold on the grids.
LEVELS = [0, -500, 100]


def clause_text(id_: Column, size: Column, k: Column | int) -> Column:
    """The k-th clause, with any of the six comparisons; most equations have no slope."""
    start = 10 + (id_ * 7 + k * 3) % 20
    low = (id_ * 3 + k) % 40
    sign = (id_ + 5 * k) % 6
    threshold = (size + k) % 7 - 3
    flat = (sign >= 4) & (id_ % 50 > 0)
    slope = F.when(flat, 0).otherwise((id_ * 11 + k * 13) % 61 - 30)
    level = F.get(F.array(*map(F.lit, LEVELS)), ((id_ + k) % 3).cast("int")) - threshold
    intercept = F.when(sign >= 4, level).otherwise((id_ * 17 + k * 29) % 400 - 100)
    return F.concat(
        F.when((id_ + k) % 3 == 0, "F").otherwise("G"),
        F.lit("_[["), tenths(start), F.lit(", "), tenths(start + 5 + (size + k * 5) % 40),
        F.lit("]] (\\forall x \\in ["), low.cast("string"), F.lit(", "),
        (low + 20 + (size * 2 + k * 7) % 50).cast("string"),
        F.lit("] (u(x) - ("), hundredths(slope), F.lit(" \\cdot x + "), intercept.cast("string"), F.lit(") "),
        F.get(F.array(*map(F.lit, SIGNS)), sign.cast("int")), F.lit(" "), threshold.cast("string"), F.lit("))"),
    )


# Groupings of up to four clauses, and the postfix steps each must give.
PAIR_SHAPES = [
    ("{0} \\land {1}", [0, 1, -1]),
    ("{0} \\lor {1} \\land {2}", [0, 1, -2, 2, -1]),
    ("({0} \\land {1}) \\lor {2}", [0, 1, -1, 2, -2]),
    ("{0} \\land ({1} \\lor {2})", [0, 1, 2, -2, -1]),
    ("{0} \\lor ({1} \\land ({2} \\lor {3}))", [0, 1, 2, 3, -2, -1, -2]),
    ("({0} \\lor {1}) \\land ({2} \\lor {3})", [0, 1, -2, 2, 3, -2, -1]),
]
MOST = 4


def chosen(which: Column, values: list[Column]) -> Column:
    """The value of that number (from 0); the others are not made."""
    cases = F.when(which == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        cases = cases.when(which == i, value)
    return cases


def shaped(shapes: list[str], clauses: str, which: Column, start: int = 0) -> Column:
    """The clauses of an array column, from `start` on, put into the shape of that number."""
    texts = []
    for shape in shapes:
        parts = re.split(r"\{(\d)\}", shape)
        texts.append(F.concat(*[F.get(clauses, F.lit(start + int(x))) if i % 2 else F.lit(x) for i, x in enumerate(parts)]))
    return chosen(which, texts)


def formula_pairs(spark, sf_dir, name: str = "part", keep: dict[str, str] | None = None) -> DataFrame:
    """A true and a predicted formula per row, of two to four clauses with nested groups.

    Every 13th cannot be read; two in 17 have an axis of width zero. `keep`: further columns of
    the table and their new names.
    """
    parts = table(spark, sf_dir, name)
    key, number = PAIR_COLUMNS[name]
    id_, size = F.col(key), F.col(number).cast("bigint")
    shapes = [shape for shape, _ in PAIR_SHAPES]
    numbers = F.sequence(F.lit(0), F.lit(2 * MOST - 1))
    kept = [F.col(column).alias(new) for column, new in (keep or {}).items()]
    texts = parts.select(
        id_.alias("pair_id"), size.alias("size"), F.transform(numbers, lambda k: clause_text(id_, size, k)).alias("texts"), *kept
    )
    id_ = F.col("pair_id")
    pairs = texts.select(
        "pair_id", shaped(shapes, "texts", id_ % len(shapes)).alias("sstl"),
        shaped(shapes, "texts", (id_ + F.col("size")) % len(shapes), MOST).alias("predicted_sstl"),
        *(keep or {}).values(),
    )

    def written(text: Column) -> Column:
        no_time = F.regexp_replace(text, r"\[\[[^\]]*\]\]", "[[1.5, 1.5]]")
        no_place = F.regexp_replace(text, r"\\in \[[^\]]*\]", r"\\in [7, 7]")
        return F.when(F.col("pair_id") % 17 == 5, no_time).when(F.col("pair_id") % 17 == 11, no_place).otherwise(text)

    unreadable = F.regexp_replace("predicted_sstl", r"^(\(*)[GF]", "$1U")
    return pairs.select(
        "pair_id", written(F.col("sstl")).alias("sstl"),
        written(F.when(F.col("pair_id") % 13 == 0, unreadable).otherwise(F.col("predicted_sstl"))).alias("predicted_sstl"),
        *(keep or {}).values(),
    )


def pairs_sql(name: str = "part") -> str:
    """The clauses (`c`) of all pairs, from the numbers that the texts are written from, the
    shapes, the `status` of the pairs and the domain (`dom`) of those that have a score."""
    key, number = PAIR_COLUMNS[name]
    shapes = ", ".join(f"({i}, {max(steps) + 1}, {steps}::INTEGER[])" for i, (_, steps) in enumerate(PAIR_SHAPES))
    return f"""
shapes(shape, n, steps) AS (VALUES {shapes}),
states AS (
  SELECT {key} AS pair_id, {number}::BIGINT AS s,
         CASE WHEN {key} % 13 = 0 THEN 'failed' WHEN {key} % 17 IN (5, 11) THEN 'error' ELSE 'ok' END AS status FROM {name}),
c AS (
  SELECT pair_id, status, side, i, steps, CASE WHEN (pair_id + k) % 3 = 0 THEN 'F' ELSE 'G' END AS op,
         t10 / 10.0::DOUBLE AS tl, (t10 + 5 + (s + k * 5) % 40) / 10.0::DOUBLE AS th,
         x0::DOUBLE AS xl, (x0 + 20 + (s * 2 + k * 7) % 50)::DOUBLE AS xh, sign, thr::DOUBLE AS thr,
         CASE WHEN sign >= 4 AND pair_id % 50 > 0 THEN 0 ELSE ((pair_id * 11 + k * 13) % 61 - 30) END / 100.0::DOUBLE AS slope,
         CASE WHEN sign >= 4 THEN ({LEVELS})[((pair_id + k) % 3 + 1)::INTEGER] - thr ELSE (pair_id * 17 + k * 29) % 400 - 100 END::DOUBLE AS icpt
  FROM (SELECT *, k // {MOST} AS side, k % {MOST} AS i, 10 + (pair_id * 7 + k * 3) % 20 AS t10, (pair_id * 3 + k) % 40 AS x0,
               (pair_id + 5 * k) % 6 AS sign, (s + k) % 7 - 3 AS thr,
               CASE WHEN k < {MOST} THEN pair_id % {len(PAIR_SHAPES)} ELSE (pair_id + s) % {len(PAIR_SHAPES)} END AS shape
        FROM states, range({2 * MOST}) r(k)) JOIN shapes USING (shape) WHERE i < n),
dom AS (
  SELECT pair_id, min(tl) AS t_min, max(th) AS t_max, min(xl) AS x_min, max(xh) AS x_max
  FROM c WHERE status = 'ok' GROUP BY pair_id)"""


def point(i: str, low: str, high: str, back: str) -> str:
    """The i-th point of a grid axis, or of the backwards walk where `back` holds."""
    w = f"(({high} - {low}) / 50)"
    forward = f"CASE WHEN {i} = 1 THEN {low} + {w} ELSE {low} + {i} * (({low} + {w}) - {low}) END"
    backward = (
        f"CASE WHEN 51 - {i} = 1 THEN {high} + -{w} ELSE {high} + (51 - {i}) * (({high} + -{w}) - {high}) END"
    )
    return f"(CASE WHEN {back} THEN {backward} ELSE {forward} END)"


def _holds(u: str) -> str:
    """Whether a clause holds for a value of u: the ends of the positions decide for an order
    comparison, every position for an equation."""
    order = {0: "<", 1: ">", 2: "<=", 3: ">="}
    cases = " ".join(f"WHEN {sign} THEN {u} - e1 {op} thr AND {u} - e2 {op} thr" for sign, op in order.items())
    other = f"len(list_filter(es, lambda e: {u} - e {{op}} thr)) = 0"
    return f"CASE sign {cases} WHEN 4 THEN {other.format(op='<>')} ELSE {other.format(op='=')} END"


def times_sql(align: str, name: str) -> str:
    """All (clause, time), with the slots at which the clause's interval begins and ends."""
    back = "op = 'F'" if align == "reference" else "false"
    return f"""{pairs_sql(name)},
prep AS (
  SELECT *, es[1] AS e1, es[-1] AS e2 FROM (
    SELECT *, {back} AS back, len(xs) AS nx, list_distinct(list_transform(xs, lambda x: slope * x + icpt)) AS d,
           list_transform(xs, lambda x: slope * x + icpt) AS es
    FROM (SELECT *, list_filter(list_transform(range(52), lambda i: {point('i', 'x_min', 'x_max', back)}),
                                lambda v: v >= xl AND v <= xh) AS xs FROM c JOIN dom USING (pair_id)))),
raw AS (
  SELECT pair_id, side, i, steps, op, back, thr, sign, e1, e2, d AS es, slot, t, nx > 0 AND t >= tl AND t <= th AS inside
  FROM (SELECT *, {point('slot', 't_min', 't_max', back)} AS t FROM prep, range(52) g(slot)))"""


def _constants(grid: logic.ProfileGrid) -> tuple[str, str]:
    return tuple(f"(CAST({v} AS DOUBLE[]))" for v in (grid.slopes, grid.offsets))


def cells_sql(align: str, grid: logic.ProfileGrid = SMALL, name: str = "part") -> str:
    """Every (clause, profile, time) with its state and the closed truth, and `closed`: per
    slope and time the profiles for which the clause holds, as bits."""
    slopes, offsets = _constants(grid)
    m, b = grid.m_steps, grid.b_steps
    return f"""{times_sql(align, name)},
cells AS (
  SELECT pair_id, side, i, steps, op, slot, p, CASE WHEN inside THEN {_holds('u')} END AS state
  FROM (SELECT *, CASE WHEN back THEN {slopes}[{m} - p // {b}] ELSE {slopes}[p // {b} + 1] END * t
           + CASE WHEN back THEN {offsets}[{b} - p % {b}] ELSE {offsets}[p % {b} + 1] END AS u FROM raw, range({m * b}) h(p))),
seen AS (
  SELECT *, max(CASE WHEN NOT state THEN slot END) OVER w AS last_false,
            max(CASE WHEN state THEN slot END) OVER w AS last_true
  FROM cells WINDOW w AS (PARTITION BY pair_id, side, i, p)),
shut AS (
  SELECT *, CASE WHEN op = 'G' THEN last_false IS NULL OR (state IS NULL AND slot > last_false)
                 ELSE state IS NULL OR coalesce(slot <= last_true, false) END AS v FROM seen),
closed AS (
  SELECT pair_id, side, i, steps, p // {b} AS m, slot, bit_or(CASE WHEN v THEN 1::HUGEINT << (p % {b})::INTEGER ELSE 0::HUGEINT END) AS mask
  FROM shut GROUP BY ALL)"""


def masks_sql(align: str, grid: logic.ProfileGrid, name: str) -> str:
    """`closed` without a row per cell: the offsets of a slope are bits from the start.

    One comparison per offset is written out; only an equation over several different values
    tests a list of them.
    """
    slopes, offsets = _constants(grid)
    m, b = grid.m_steps, grid.b_steps
    full = f"{(1 << b) - 1}::BIGINT"

    def bits(offs: list[float], op: str, ends: tuple[str, ...]) -> str:
        terms = (" AND ".join(f"base + {o!r}::DOUBLE - {e} {op} thr" for e in ends) for o in offs)
        return " + ".join(f"(({term})::BIGINT << {j})" for j, term in enumerate(terms))

    def by_sign(offs: list[float]) -> str:
        order = [("<", 0), (">", 1), ("<=", 2), (">=", 3)]
        cases = [f"WHEN sign = {sign} THEN {bits(offs, op, ('e1', 'e2'))}" for op, sign in order]
        cases += [f"WHEN sign = {sign} AND len(es) = 1 THEN {bits(offs, op, ('e1',))}" for op, sign in (("=", 4), ("<>", 5))]
        several = f"list_sum(list_transform(range({b}), lambda j: ({_holds(f'(base + (CAST({offs} AS DOUBLE[]))[j + 1])')})::BIGINT << j))"
        return f"CASE {' '.join(cases)} ELSE {several}::BIGINT END"

    return f"""{times_sql(align, name)},
spread AS MATERIALIZED (
  SELECT *, CASE WHEN back THEN {slopes}[{m} - m] ELSE {slopes}[m + 1] END * t AS base FROM raw, range({m}) h(m)),
planes AS (
  SELECT pair_id, side, i, steps, op, m, slot, inside,
         CASE WHEN NOT inside THEN NULL WHEN back THEN {by_sign(grid.offsets[::-1])} ELSE {by_sign(grid.offsets)} END AS mask
  FROM spread),
closed AS (
  SELECT pair_id, side, i, steps, m, slot,
         CASE WHEN op = 'F' THEN CASE WHEN inside THEN bit_or(mask) OVER later ELSE {full} END
              WHEN slot > max(CASE WHEN inside THEN slot END) OVER whole THEN {full}
              ELSE coalesce(bit_and(mask) OVER whole, {full}) END AS mask
  FROM planes
  WINDOW whole AS (PARTITION BY pair_id, side, i, m),
         later AS (PARTITION BY pair_id, side, i, m ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


# The postfix steps of a formula, one at a time, over a stack of masks.
FOLD_SQL = """
fold AS (
  SELECT pair_id, side, m, slot, any_value(steps) AS steps, list(mask::HUGEINT ORDER BY i) AS masks, 1 AS step, []::HUGEINT[] AS stack
  FROM closed GROUP BY pair_id, side, m, slot
  UNION ALL
  SELECT pair_id, side, m, slot, steps, masks, step + 1,
         CASE WHEN steps[step] >= 0 THEN list_append(stack, masks[steps[step] + 1])
              WHEN steps[step] = -1 THEN list_append(stack[:-3], stack[-2] & stack[-1])
              ELSE list_append(stack[:-3], stack[-2] | stack[-1]) END
  FROM fold WHERE step <= len(steps)),
formula AS (SELECT pair_id, side, m, slot, stack[1] AS mask FROM fold WHERE step = len(steps) + 1)"""


def iou_sql(closed: str) -> str:
    return f"""WITH RECURSIVE {closed},{FOLD_SQL},
overlap AS (
  SELECT pair_id, sum(bit_count(a.mask & b.mask))::BIGINT AS "both", sum(bit_count(a.mask | b.mask))::BIGINT AS either
  FROM formula a JOIN formula b USING (pair_id, m, slot) WHERE a.side = 0 AND b.side = 1 GROUP BY pair_id)
SELECT states.pair_id, "both", either,
       round(CASE WHEN either = 0 THEN 1.0::DOUBLE ELSE "both"::DOUBLE / either END, 9) AS iou, status
FROM states LEFT JOIN overlap USING (pair_id)"""


def _scores(df: DataFrame, **options) -> DataFrame:
    scored = logic.formula_iou(df, **options)
    return scored.select(
        "pair_id",
        F.col("both").cast("bigint"),
        F.col("either").cast("bigint"),
        F.round("iou", 9).alias("iou"),
        "status",
    )


@query("formula_iou", iou_sql(cells_sql("reference")))
def formula_iou(spark, sf_dir):
    return _scores(formula_pairs(spark, sf_dir), grid=SMALL)


@query("formula_iou_time", iou_sql(cells_sql("time")))
def formula_iou_time(spark, sf_dir):
    return _scores(formula_pairs(spark, sf_dir), grid=SMALL, align="time")


@query("formula_iou_full", iou_sql(masks_sql("reference", logic.ProfileGrid(), "part")))
def formula_iou_full(spark, sf_dir):
    """The full grid of 2,500 profiles; the SQL holds the offsets of a slope as bits."""
    return _scores(formula_pairs(spark, sf_dir))


@query("formula_iou_suppliers", iou_sql(cells_sql("reference", logic.ProfileGrid(), "supplier")))
def formula_iou_suppliers(spark, sf_dir):
    """The full grid on a table small enough for the SQL to visit every cell."""
    return _scores(formula_pairs(spark, sf_dir, "supplier"))


@query("formula_iou_wide", iou_sql(cells_sql("reference", WIDE, "supplier")))
def formula_iou_wide(spark, sf_dir):
    """More offsets than a word has bits."""
    return _scores(formula_pairs(spark, sf_dir, "supplier"), grid=WIDE)


@query(
    "clause_truth",
    f"""WITH {cells_sql("reference")}
        SELECT pair_id, CASE WHEN side = 0 THEN 'truth' ELSE 'pred' END AS formula, i::BIGINT AS clause,
               sum(coalesce(state, false)::INT)::BIGINT AS n_true,
               sum((NOT coalesce(state, true))::INT)::BIGINT AS n_false,
               sum((state IS NULL)::INT)::BIGINT AS n_vacuous, sum(v::INT)::BIGINT AS n_closed
        FROM shut GROUP BY pair_id, side, i""",
)
def clause_truth(spark, sf_dir):
    masks = logic.clause_truth(
        formula_pairs(spark, sf_dir), "pair_id", "sstl", "predicted_sstl", grid=SMALL
    )
    held = logic.count_bits(F.col("truth"))
    profiles = SMALL.m_steps * SMALL.b_steps
    tested = F.size(F.get("truth", F.lit(0))) * profiles
    return masks.select(
        "pair_id", "formula", F.col("clause").cast("bigint"),
        held.alias("n_true"),
        (tested - held).cast("bigint").alias("n_false"),
        (F.col("vacuous_times") * profiles).cast("bigint").alias("n_vacuous"),
        logic.count_bits(F.col("closed")).alias("n_closed"),
    )


@query(
    "combine_clauses",
    f"""WITH RECURSIVE {cells_sql("reference")},{FOLD_SQL}
        SELECT states.pair_id, sum(CASE WHEN side = 0 THEN bit_count(mask) WHEN side = 1 THEN 0 END)::BIGINT AS truth_cells,
               sum(CASE WHEN side = 1 THEN bit_count(mask) WHEN side = 0 THEN 0 END)::BIGINT AS pred_cells, any_value(status) AS status
        FROM states LEFT JOIN formula USING (pair_id) GROUP BY states.pair_id""",
)
def combine_clauses(spark, sf_dir):
    """Cells in which each formula of a pair holds, NULL for pairs without a domain."""
    pairs = formula_pairs(spark, sf_dir)
    count = lambda side: logic.count_bits(F.array(side)).alias(f"{side}_cells")
    masks = logic.pair_masks(pairs, grid=SMALL).select("_truth", "_pred", count("truth"), count("pred"), "status")
    keyed = pairs.select("pair_id", logic.formula_key("sstl").alias("_truth"), logic.formula_key("predicted_sstl").alias("_pred"))
    return merge_join(keyed, masks, ["_truth", "_pred"]).select(
        "pair_id",
        *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("truth_cells", "pred_cells")],
        "status",
    )


@query(
    "formula_domain",
    f"""WITH {pairs_sql()} SELECT states.pair_id, t_min, t_max, x_min::BIGINT AS x_min, x_max::BIGINT AS x_max
        FROM states LEFT JOIN dom USING (pair_id)""",
)
def formula_domain(spark, sf_dir):
    pairs = formula_pairs(spark, sf_dir)
    read = logic.read_pairs(pairs, "sstl", "predicted_sstl")
    known = F.col("status") == "ok"
    keyed = pairs.select("pair_id", logic.formula_key("sstl").alias("_truth"), logic.formula_key("predicted_sstl").alias("_pred"))
    return merge_join(keyed, read, ["_truth", "_pred"]).select(
        "pair_id", *[F.when(known, F.col(c)).alias(c) for c in logic.DOMAIN]
    )


@query(
    "bracket_steps",
    f"""WITH {pairs_sql()}
        SELECT states.pair_id, array_to_string(any_value(steps) FILTER (side = 0), ',') AS truth_steps,
               array_to_string(any_value(steps) FILTER (side = 1), ',') AS pred_steps
        FROM states JOIN c USING (pair_id) GROUP BY states.pair_id""",
)
def bracket_steps(spark, sf_dir):
    """The grouping of both formulas of each pair; a clause that begins with U is grouped too."""
    pairs = formula_pairs(spark, sf_dir)
    for side, text in (("truth", "sstl"), ("pred", "predicted_sstl")):
        pairs = formulas.bracket_steps(formulas.split_formula(pairs, text, f"{side}_"), f"{side}_")
    return pairs.select("pair_id", joined(F.col("truth_steps")).alias("truth_steps"), joined(F.col("pred_steps")).alias("pred_steps"))


# Three clauses A, B, C with different grouping, and the postfix steps each must give.
SHAPES = [
    ("{0} \\land {1} \\lor {2}", "0,1,-1,2,-2"),
    ("({0} \\land {1}) \\lor {2}", "0,1,-1,2,-2"),
    ("{0} \\land ({1} \\lor {2})", "0,1,2,-2,-1"),
    ("{0} \\lor note {1} \\land {2}", "0,2,-2"),
]


def line_formulas(spark, sf_dir) -> DataFrame:
    id_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem", "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", id_.alias("id")
    )
    texts = F.transform(F.array(*map(F.lit, range(3))), lambda k: clause_text(F.col("id"), F.col("l_suppkey"), k))
    shapes = [shape for shape, _ in SHAPES]
    return rows.withColumn("texts", texts).withColumn("sstl", shaped(shapes, "texts", F.col("id") % len(shapes))).drop("texts")


def _clause_sql(k: int) -> str:
    s = "l_suppkey"
    start, low = f"(10 + (id * 7 + {k * 3}) % 20)", f"((id * 3 + {k}) % 40)"
    stop = f"({start} + 5 + ({s} + {k * 5}) % 40)"
    tenth = lambda v: f"({v} // 10)::VARCHAR || '.' || ({v} % 10)::VARCHAR"
    sign, threshold = f"((id + {5 * k}) % 6)", f"(({s} + {k}) % 7 - 3)"
    slope = f"(CASE WHEN {sign} >= 4 AND id % 50 > 0 THEN 0 ELSE (id * 11 + {k * 13}) % 61 - 30 END)"
    level = f"({LEVELS})[((id + {k}) % 3 + 1)::INT] - {threshold}"
    intercept = f"(CASE WHEN {sign} >= 4 THEN {level} ELSE (id * 17 + {k * 29}) % 400 - 100 END)"
    return (
        f"CASE WHEN (id + {k}) % 3 = 0 THEN 'F' ELSE 'G' END || '_[[' || {tenth(start)} || ', ' || {tenth(stop)} || "
        f"']] (\\forall x \\in [' || {low}::VARCHAR || ', ' || ({low} + 20 + ({s} * 2 + {k * 7}) % 50)::VARCHAR || "
        f"'] (u(x) - (' || CASE WHEN {slope} < 0 THEN '-' ELSE '' END || (abs({slope}) // 100)::VARCHAR || '.' || "
        f"lpad((abs({slope}) % 100)::VARCHAR, 2, '0') || ' \\cdot x + ' || {intercept}::VARCHAR || ') ' || "
        f"([{', '.join(f"'{x}'" for x in SIGNS)}])[{sign}::INT + 1] || ' ' || {threshold}::VARCHAR || '))'"
    )


def _split_sql() -> str:
    a, b, c = (f"({_clause_sql(k)})" for k in range(3))
    cases = [
        (f"{a} || '|' || {b} || '|' || {c}", "and,or"),
        (f"'(' || {a} || '|' || {b} || ')|' || {c}", "and,or"),
        (f"{a} || '|(' || {b} || '|' || {c} || ')'", "and,or"),
        (f"{a} || '|note ' || {b} || '|' || {c}", "or,and"),
    ]
    when = lambda i: f"WHEN {i} THEN"
    clauses = " ".join(f"{when(i)} {text}" for i, (text, _) in enumerate(cases))
    marks = " ".join(f"{when(i)} '{m}'" for i, (_, m) in enumerate(cases))
    steps = " ".join(f"{when(i)} '{s}'" for i, (_, s) in enumerate(SHAPES))
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE id % 4 {clauses} END AS clauses, CASE id % 4 {marks} END AS junctions, CASE id % 4 {steps} END AS steps
      FROM (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"""


@query("split_formula", _split_sql())
def split_formula(spark, sf_dir):
    split = formulas.bracket_steps(formulas.split_formula(line_formulas(spark, sf_dir), "sstl"))
    return split.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array_join("clauses", "|").alias("clauses"),
        F.array_join("junctions", ",").alias("junctions"),
        joined(F.col("steps")).alias("steps"),
    )


def clause_variants(spark, sf_dir) -> DataFrame:
    """One clause per line item, in each way an expression may be written, or broken."""
    n, s = F.col("l_linenumber").cast("bigint"), F.col("l_suppkey")
    a = F.col("l_partkey") % 90 + 1
    text = lambda c: c.cast("string")
    expressions = F.array(
        F.concat(F.lit("- ("), hundredths(a), F.lit(" \\cdot x + -"), text(s), F.lit(") <")),
        F.concat(F.lit("- (x/("), text(a), F.lit(") - "), text(s), F.lit(") >=")),
        F.concat(F.lit("- (-x \\cdot "), hundredths(a), F.lit(" + "), text(s), F.lit(") \\leq")),
        F.concat(F.lit("- ( x \\cdot (-"), tenths(a), F.lit(") + "), text(s), F.lit(" ) >")),
        F.concat(F.lit("-("), tenths(a), F.lit("x - -"), text(s), F.lit(") !=")),
        F.lit("="),
        F.concat(F.lit("- ("), text(a), F.lit(" \\times x) <")),
    )
    return table(spark, sf_dir, "lineitem", "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(
            F.when(n % 2 == 0, "F").otherwise("G"), F.lit("_[["), tenths(a), F.lit(", "),
            text(a + 3), F.lit("]] (\\forall x \\in ["), text(n), F.lit(", "),
            tenths(a * 10 + 309), F.lit("] (u(x) "), F.get(expressions, (s % 7).cast("int")),
            F.lit(" "), text(n - 3), F.lit("))"),
        ).alias("sstl"),
    )


@query(
    "parse_clauses",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_linenumber % 2 = 0 THEN 'F' ELSE 'G' END AS operator,
         a / 10.0::DOUBLE AS t_lo, (a + 3)::DOUBLE AS t_hi, l_linenumber::BIGINT AS x_lo, a + 30 AS x_hi,
         CASE k WHEN 0 THEN a / 100.0::DOUBLE WHEN 2 THEN -(a / 100.0::DOUBLE) WHEN 3 THEN -(a / 10.0::DOUBLE)
                WHEN 4 THEN a / 10.0::DOUBLE WHEN 5 THEN 0.0::DOUBLE END AS slope,
         CASE k WHEN 1 THEN a::DOUBLE END AS divisor,
         CASE WHEN k = 0 THEN -s WHEN k = 1 THEN -s WHEN k = 2 THEN s WHEN k = 3 THEN s WHEN k = 4 THEN s
              WHEN k = 5 THEN 0.0::DOUBLE END AS intercept,
         CASE k WHEN 0 THEN '<' WHEN 1 THEN '>=' WHEN 2 THEN '<=' WHEN 3 THEN '>' WHEN 4 THEN '!=' WHEN 5 THEN '=' END AS comparison,
         CASE WHEN k < 6 THEN (l_linenumber - 3)::DOUBLE END AS threshold,
         CASE WHEN k = 6 THEN 'failed' ELSE 'ok' END AS status
       FROM (SELECT *, l_partkey % 90 + 1 AS a, l_suppkey % 7 AS k, l_suppkey::DOUBLE AS s FROM lineitem)""",
)
def parse_clauses(spark, sf_dir):
    read = formulas.read_formula(clause_variants(spark, sf_dir), "sstl")
    c = F.get("parsed", F.lit(0))
    known = c["status"] == "ok"
    fields = ("slope", "divisor", "intercept", "comparison", "threshold")
    return read.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[c[f].alias(f) for f in ("operator", "t_lo", "t_hi", "x_lo", "x_hi")],
        *[F.when(known, c[f]).alias(f) for f in fields],
        "status",
    )


@query(
    "profile_grid",
    f"""WITH grid AS (
          SELECT p AS profile, (CAST({logic.ProfileGrid().slopes} AS DOUBLE[]))[p // 50 + 1] AS m,
                 (CAST({logic.ProfileGrid().offsets} AS DOUBLE[]))[p % 50 + 1] AS b FROM range(2500) r(p))
        SELECT l_orderkey, l_linenumber, l_partkey, profile, m * l_quantity + b AS u
        FROM lineitem JOIN grid ON profile = (l_orderkey * 7 + l_linenumber) % 2500""",
)
def profile_grid(spark, sf_dir):
    """The value of one profile per line item, at the time given by the quantity."""
    grid = logic.profile_grid(spark)
    items = table(spark, sf_dir, "lineitem").withColumn(
        "profile", (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 2500
    )
    value = F.col("m") * F.col("l_quantity") + F.col("b")
    return items.join(F.broadcast(grid), "profile").select(  # 2,500 rows by construction
        "l_orderkey", "l_linenumber", "l_partkey", "profile", value.alias("u")
    )


@query(
    "always_eventually",
    """WITH states AS (
         SELECT user_id, event_id, CASE WHEN event_type <> 'signup' THEN value < 90 END AS state FROM events),
       seen AS (
         SELECT *, max(CASE WHEN NOT state THEN event_id END) OVER (PARTITION BY user_id) AS last_false,
                   count(CASE WHEN state THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS to_come FROM states)
       SELECT user_id, event_id, last_false IS NULL OR (state IS NULL AND event_id > last_false) AS always,
              state IS NULL OR to_come > 0 AS eventually FROM seen""",
)
def always_eventually(spark, sf_dir):
    state = F.when(F.col("event_type") != "signup", F.col("value") < 90)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"))
    return logic.always_and_eventually(events, "user_id", "event_id", "state").drop("state")
