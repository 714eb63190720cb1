"""Formula reading on edge rows, and scores against a cell-by-cell evaluation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import formulas, logic

BOX = r"\forall x \in [2, 9]"


def clause(body, op="G", time="0.5, 1.5", place=BOX):
    return f"{op}_[[{time}]] ({place} ({body}))"


def read(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, sstl string")
    return [r for r in formulas.read_formula(df, "sstl").orderBy("id").collect()]


@pytest.mark.parametrize(
    "body, slope, divisor, intercept, comparison, threshold",
    [
        (r"u(x) - (0.3 \cdot x + 307.8) < 0", 0.3, None, 307.8, "<", 0),
        (r"u(x) - (-2e-05 \cdot x + -1.1) > 0", -2e-05, None, -1.1, ">", 0),
        (r"u(x) -  (+.5 \cdot x + 3) \leq -2.5", 0.5, None, 3, "<=", -2.5),
        ("u(x) > 3", 0, None, 0, ">", 3),
        ("u(x) = 4.25", 0, None, 0, "=", 4.25),
        ("u(x) - (x/5 + 3) >= 1", None, 5, 3, ">=", 1),
        ("u(x) - (- x/(4)) != 1", None, -4, 0, "!=", 1),
        (r"u(x) - (x \cdot 0.5 - -2) < 1", 0.5, None, 2, "<", 1),
        (r"u(x) - (x \cdot 12) < 1", 12, None, 0, "<", 1),
        (r"u(x) - (-x \cdot (-0.25) + 7 ) \geq 1", 0.25, None, 7, ">=", 1),
        ("u(x) - (0.3x - -5) = 1", 0.3, None, 5, "=", 1),
    ],
)
def test_clause_contents(spark, body, slope, divisor, intercept, comparison, threshold):
    (row,) = read(spark, clause(body))
    c = row.parsed[0]
    assert row.status == "ok" and c.operator == "G" and (c.t_lo, c.t_hi, c.x_lo, c.x_hi) == (0.5, 1.5, 2, 9)
    assert (c.slope, c.divisor, c.intercept, c.comparison, c.threshold) == (slope, divisor, intercept, comparison, threshold)


def test_clauses_that_cannot_be_read(spark):
    good = "u(x) > 3"
    rows = read(
        spark,
        clause(good, op="U"),
        clause(good, time="-1, 2"),
        clause(good, time="1.2.3, 2"),
        clause(good, place=r"\forall x \in [-1, 2]"),
        clause("u(x) ~ 3"),
        "",
        clause(good) + r" \land ",
        None,
        clause("u(x) - (x/(5 + 3) < 0"),
        clause(r"u(x) - (x \cdot 0.3 5) < 0"),
        clause(r"u(x) - (007 \cdot x + 1) < 0"),
        "note " + clause(good),
        clause(good, place=r"\forall x \in [2.9, 9.9]"),
    )
    assert [r.status for r in rows] == ["failed"] * 8 + ["error"] * 4 + ["ok"]
    assert (rows[-1].parsed[0].x_lo, rows[-1].parsed[0].x_hi) == (2, 9)


def test_runs_of_blanks_cost_nothing(spark):
    blank = " " * 20_000
    rows = read(
        spark,
        clause(f"u(x) -{blank}({blank}x{blank}/5{blank}+ 3{blank}){blank}<{blank}1"),
        clause(f"u(x) - ( x /5 {blank} oops"),
        clause("u(x) > 3").replace(r"\forall x", rf"\forall{blank}x"),
        clause("u(x)\u00a0>\x1c\u30003"),
        clause("u(x) > 3").replace(r"\forall x", "\\forall\u00a0x"),
    )
    assert [r.status for r in rows] == ["ok", "failed", "failed", "ok", "failed"]
    assert (rows[0].parsed[0].divisor, rows[0].parsed[0].intercept) == (5, 3)


def test_grouping(spark):
    a = clause("u(x) > 3")
    joined = lambda text: text.replace("A", a)
    rows = read(
        spark,
        joined(r"A \land A \lor A"),
        joined(r"A \lor (A \land A)"),
        joined(r"(A \lor A) \land (A \lor A)"),
        joined(r"(A \lor (A \land A)) \lor A"),
        joined(r"(A \lor A \land A"),
        joined(r"A \land note A \lor A"),
    )
    assert [list(r.steps) for r in rows] == [
        [0, 1, -1, 2, -2],
        [0, 1, 2, -1, -2],
        [0, 1, -2, 2, 3, -2, -1],
        [0, 1, 2, -1, -2, 3, -2],
        [0, 1, -2, 2, -1],
        [0, 2, -1],
    ]


def points(low, high, back):
    step = (high - low) / 50
    if back:
        return np.arange(high, low - step - 1e-7, -step)[::-1]
    return np.arange(low, high + step + 1e-7, step)


COMPARE = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "=": np.equal, "!=": np.not_equal}


def cells_of(c, domain, grid, align):
    """Truth of one clause for all (profile, time), every position tested."""
    back = c["op"] == "F" and align == "reference"
    t, x = points(*domain[:2], back), points(*domain[2:], back)
    m, b = (a.ravel() for a in np.meshgrid(np.arange(grid.m_min, grid.m_max, (grid.m_max - grid.m_min) / grid.m_steps),
                                           np.arange(grid.b_min, grid.b_max, (grid.b_max - grid.b_min) / grid.b_steps), indexing="ij"))
    if back:
        m, b = m[::-1], b[::-1]
    u = m[:, None] * t[None, :] + b[:, None]
    expr = (x / c["div"] if c["div"] else c["slope"] * x) + c["icpt"]
    here = (x >= c["x"][0]) & (x <= c["x"][1])
    now = (t >= c["t"][0]) & (t <= c["t"][1])
    vacuous = np.broadcast_to(~now[None, :] if here.any() else np.ones(len(t), bool)[None, :], u.shape)
    held = np.ones(u.shape, bool)
    for e in expr[here]:
        held &= COMPARE[c["cmp"]](u - e, c["thr"])
    out = np.ones(u.shape, bool)
    places = np.arange(len(t))[None, :]
    if c["op"] == "G":
        last_false = np.where(~vacuous & ~held, places, -1).max(axis=1, keepdims=True)
        out = (last_false < 0) | (vacuous & (places > last_false))
    else:
        last_true = np.where(~vacuous & held, places, -1).max(axis=1, keepdims=True)
        out = vacuous | (places <= last_true)
    return out


def random_clause(rng):
    kind = rng.randrange(4)
    slope, icpt = round(rng.uniform(-3, 3), 2), rng.randrange(-60, 60)
    number = rng.choice([2, 4, 5, 8])
    body, div = [
        (rf"- ({slope} \cdot x + {icpt}) ", None),
        (f"- (x/{number} + {abs(icpt)}) ", number),
        ("", None),
        (f"- ({abs(slope)}x - -{abs(icpt)}) ", None),
    ][kind]
    if kind in (1, 3):
        icpt = abs(icpt)
    slope = [slope, None, 0.0, abs(slope)][kind]
    if kind == 2:
        icpt = 0
    cmp_ = rng.choice(["<", "<=", ">", ">=", "=", "!="])
    if kind == 3 and cmp_ in ("=",):
        cmp_ = "<"
    thr = rng.choice([0, 20, -20, 3])
    if cmp_ in ("=", "!="):  # equalities that really occur on the grid
        slope, icpt, body, div = 0.0, 0, "", None
        if rng.random() < 0.4:  # a value of its own at every position
            slope, body = 1.0, rf"- (1.0 \cdot x + 0) "
    lo = round(rng.uniform(0, 4), 1)
    hi = round(lo + rng.choice([0.05, 1.0, 2.5, 6.0]), 2)
    x = rng.randrange(0, 40)
    y = x + rng.choice([0, 1, 10, 50])
    op = rng.choice("GF")
    written = {"<=": rng.choice(["<=", r"\leq"]), ">=": rng.choice([">=", r"\geq"])}.get(cmp_, cmp_)
    text = f"{op}_[[{lo}, {hi}]] (\\forall x \\in [{x}, {y}] (u(x) {body}{written} {thr}))"
    return dict(op=op, t=(lo, hi), x=(x, y), slope=slope, icpt=icpt, div=div, cmp=cmp_, thr=thr), text


def random_formula(rng):
    """Clauses, text, and a function from clause cells to formula cells."""
    n = rng.choice([1, 2, 3, 4])
    cs = [random_clause(rng) for _ in range(n)]
    j = [rng.choice(["land", "lor"]) for _ in range(n)]
    f = {"land": np.logical_and, "lor": np.logical_or}
    t = [text for _, text in cs]
    if n == 1:
        return cs, t[0], lambda v: v[0]
    if n == 2:
        return cs, f"{t[0]} \\{j[0]} {t[1]}", lambda v: f[j[0]](v[0], v[1])
    if n == 3 and rng.random() < 0.5:
        text = f"{t[0]} \\{j[0]} ({t[1]} \\{j[1]} {t[2]})"
        return cs, text, lambda v: f[j[0]](v[0], f[j[1]](v[1], v[2]))
    if n == 3:
        text = f"{t[0]} \\{j[0]} {t[1]} \\{j[1]} {t[2]}"
        return cs, text, lambda v: f[j[1]](f[j[0]](v[0], v[1]), v[2])
    text = f"({t[0]} \\{j[0]} {t[1]}) \\{j[1]} ({t[2]} \\{j[2]} {t[3]})"
    return cs, text, lambda v: f[j[1]](f[j[0]](v[0], v[1]), f[j[2]](v[2], v[3]))


def expected_counts(truth, pred, grid, align):
    clauses = [c for c, _ in truth[0] + pred[0]]
    domain = (min(c["t"][0] for c in clauses), max(c["t"][1] for c in clauses),
              min(c["x"][0] for c in clauses), max(c["x"][1] for c in clauses))
    if domain[0] == domain[1] or domain[2] == domain[3]:
        return None
    values = [side[2]([cells_of(c, domain, grid, align) for c, _ in side[0]]) for side in (truth, pred)]
    return int((values[0] & values[1]).sum()), int((values[0] | values[1]).sum())


@pytest.mark.parametrize(
    "seed, pairs, grid, align",
    [
        (1, 120, logic.ProfileGrid(m_steps=5, b_steps=7, b_min=-70, b_max=70), "reference"),
        (2, 120, logic.ProfileGrid(m_steps=5, b_steps=7, b_min=-70, b_max=70), "time"),
        (3, 60, logic.ProfileGrid(m_steps=4, b_steps=50), "reference"),
        (4, 12, logic.ProfileGrid(), "reference"),
        (5, 20, logic.ProfileGrid(m_steps=3, b_steps=62, b_min=-31, b_max=31), "reference"),
        (6, 20, logic.ProfileGrid(m_steps=6, b_steps=1), "time"),
        (7, 30, logic.ProfileGrid(m_steps=3, b_steps=100, b_min=-50, b_max=50), "reference"),
        (8, 30, logic.ProfileGrid(m_steps=4, b_steps=130, b_min=-65, b_max=65), "time"),
        (9, 20, logic.ProfileGrid(m_steps=2, b_steps=124, b_min=-2e11, b_max=2e11), "reference"),
    ],
)
def test_overlap_cell_by_cell(spark, seed, pairs, grid, align):
    rng = random.Random(seed)
    made = [(random_formula(rng), random_formula(rng)) for _ in range(pairs)]
    rows = [(i, a[1], b[1]) for i, (a, b) in enumerate(made)]
    df = spark.createDataFrame(rows, "id long, sstl string, predicted_sstl string")
    got = {r.id: r for r in logic.formula_iou(df, grid=grid, align=align).collect()}
    overlaps = 0
    for i, (a, b) in enumerate(made):
        want = expected_counts(a, b, grid, align)
        if want is None:
            assert got[i].status == "error" and got[i].iou is None
            continue
        assert (got[i].both, got[i].either) == want, rows[i]
        assert got[i].iou == (want[0] / want[1] if want[1] else 1)
        overlaps += 0 < want[0] < want[1]
    assert overlaps > pairs // 4


def test_formulas_are_read_once(spark):
    """However many completions share a formula, and however often the plan needs it."""
    good, other = clause("u(x) > 0"), clause("u(x) > 5")
    rows = [(i, good, other if i % 3 else good) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, sstl string, predicted_sstl string").repartition(6)
    scored = logic.formula_iou(df, grid=logic.ProfileGrid(m_steps=2, b_steps=50, b_min=-10, b_max=10))
    assert {(r.id % 3 > 0, r.iou == 1) for r in scored.collect()} == {(True, False), (False, True)}
    plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("forall x") > 0 and "ReusedExchange" in plan
    reading = [line for line in plan.splitlines() if r"u\(x\)" in line]
    assert len(reading) == 1
    masks = logic.pair_masks(df, grid=logic.ProfileGrid(m_steps=2, b_steps=3))
    assert masks.count() == 2


def test_a_formula_that_most_rows_share(spark):
    """Rows without formulas and rows with one formula: every row keeps its place."""
    rows = [(i, None if i % 2 else clause("u(x) > 0"), None) for i in range(200)] + [(200, None, clause("u(x) > 0"))]
    df = spark.createDataFrame(rows, "id long, sstl string, predicted_sstl string").withColumn("status", F.lit("old"))
    found = logic.formula_iou(df.drop("status"), grid=logic.ProfileGrid(m_steps=2, b_steps=3)).collect()
    assert len(found) == 201 and {r.status for r in found} == {"failed"}


def test_states_of_pairs(spark):
    good = clause("u(x) > 0")
    rows = [
        (0, good, good),
        (1, good, None),
        (2, clause("u(x) > 0", op="U"), good),
        (3, clause("u(x) > 0", time="1, 1"), clause("u(x) > 0", time="1, 1")),
        (4, clause("u(x) > 90000"), clause("u(x) > 80000", time="0.5, 1.5")),
        (5, clause("u(x) > 0", place=r"\forall x \in [12, 12]"), clause("u(x) > 0", place=r"\forall x \in [2, 40]")),
        (6, clause("u(x) > 0", time="1.5, 0.5"), clause("u(x) < 0", op="F", time="1.5, 0.5")),
    ]
    df = spark.createDataFrame(rows, "id long, sstl string, predicted_sstl string")
    got = {r.id: r for r in logic.formula_iou(df).collect()}
    assert [got[i].status for i in range(7)] == ["ok", "failed", "failed", "error", "ok", "ok", "ok"]
    # An interval that ends before it begins: 51 times, all of them vacuous.
    assert (got[6].iou, got[6].either) == (1, 2500 * 51)
    assert got[0].iou == 1 and got[1].iou is None
    # Nothing true inside, but the vacuous step behind the interval is true in both.
    assert 0 < got[4].either and got[4].iou == 1
    assert math.isclose(got[5].iou, got[5].both / got[5].either)


def test_row_forms_of_always_and_eventually(spark):
    rng = random.Random(3)
    rows = [(k, t, rng.choice([True, False, None])) for k in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, None) for t in range(3)]
    df = spark.createDataFrame(rows, "k long, t long, s boolean")
    both = logic.eventually(logic.always(df, "k", "t", "s"), "k", "t", "s").collect()
    assert len(both) == len(rows)
    at_once = logic.always_and_eventually(df, "k", "t", "s").collect()
    assert sorted(map(str, at_once)) == sorted(map(str, both))
    for r in both:
        mine = [(t, s) for k, t, s in rows if k == r.k]
        false_at = [t for t, s in mine if s is False]
        assert r.always == (not false_at or (r.s is None and r.t > max(false_at)))
        assert r.eventually == (r.s is None or any(s and t >= r.t for t, s in mine))


def test_profiles(spark):
    rows = logic.profile_grid(spark).orderBy("profile").collect()
    m, b = np.arange(-7, 7, 14 / 50), np.arange(-500, 500, 1000 / 50)
    assert [(r.m, r.b) for r in rows] == [(x, y) for x in m for y in b]
    with pytest.raises(ValueError):
        logic.ProfileGrid(b_steps=0)


def test_clause_masks_cover_all_times(spark):
    df = spark.createDataFrame([(1, clause("u(x) > 0", op="F"), clause("u(x) > 5"))], "id long, a string, b string")
    rows = logic.clause_truth(df, "id", "a", "b").collect()
    assert {r.formula for r in rows} == {"truth", "pred"}
    assert all(len(r.closed) == 50 and {len(m) for m in r.closed} == {52} for r in rows)
    counted = spark.createDataFrame(rows).select(logic.count_bits(F.col("closed")).alias("n")).collect()
    assert all(0 < r.n <= 2500 * 52 for r in counted)
