import random
import re
from itertools import permutations

from quillmesh.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, mask int, n long, good boolean"
LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    """(part, letters a row fails, id) of each row (id, text, lang)."""
    out = []
    for d, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((x or "") == t and e is not None and (d is None or e < d) for e, x, _ in rows),
        }
        out.append((lang or "", {k for k, v in bad.items() if v}, d))
    return out


def brute(rows, labels):
    docs = failing(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, x in labels if x == 1 and d is not None}
    out = []
    for part in {p for p, _, _ in docs}:
        mine = [(f, d) for p, f, d in docs if p == part]
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            for i, x in enumerate(order):
                here = [d for f, d in mine if x in f and not f & set(order[:i])]
                total[x] += len(here)
                steps.append((
                    part, "".join(order), i + 1, sum(not f & set(order[: i + 1]) for f, _ in mine), len(here),
                    sum(x in f for f, _ in mine) - len(here), sum(f == {x} for f, _ in mine),
                    sum(d in good for d in here), sum(d in bad for d in here),
                ))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit(spark):
    """With NULLs in every column, shared ids and texts, and columns of the operator's names."""
    rng = random.Random(2)
    texts = [None, "", "  ", "one two", "a b " * 150, " ".join(str(i) for i in range(300)), "A#B " * 40, "Up " + "x " * 250,
             " ".join(f"w{i}" for i in range(220)) + " |", "\t".join(f"é{i}" for i in range(400))]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame([(*r, "s", 5, 6, True) for r in rows], DOCS).repartition(3)
    found = filter_audit.audit_filters(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, found)) == brute(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_shares_are_those_of_all_orders():
    """The solved equations give what averaging over all orders gives, for other sizes too."""
    rng = random.Random(5)
    for n in (2, 3, 5, 6):
        value = [0] + [rng.randrange(1000) for _ in range((1 << n) - 1)]
        solved = [sum(a * b for a, b in zip(row, value)) for row in filter_audit.shares(n)]
        orders = list(permutations(range(n)))
        for i in range(n):
            total = 0
            for order in orders:
                before = sum(1 << j for j in order[: order.index(i)])
                total += value[before | 1 << i] - value[before]
            assert solved[i] * len(orders) == total
        assert sum(solved) == value[-1]
