import random
import re

import pytest
from brute import collapsed, ordered

from quillmesh.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def logged(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        base = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é"])) for _ in range(rng.randrange(1, 12))]
        for copy in range(rng.randrange(1, 4)):
            cut = rng.randrange(1, len(base) + 1)
            for i, (role, text) in enumerate(base[:cut]):
                rows.append((100 * copy + c, 2 * i + 1, role, text))
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_logged(spark, block):
    """Also with blocks so small that conversations span several."""
    rows = logged()
    found = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4), block=block).collect()
    texts = {}
    for r in sorted(found, key=lambda r: (r.conv_id, r.segment)):
        key = (r.conv_id, r.n_turns, r.copies)
        assert texts.setdefault(key, [0, ""])[0] == r.segment
        texts[key] = [r.segment + 1, texts[key][1] + r.text]
    assert ordered((*k, t) for k, (_, t) in texts.items()) == collapsed(rows)


def test_gaps(spark):
    rows = [
        (1, 0, "user", "x"), (1, None, "assistant", "late"), (2, 5, "user", "x"), (None, 0, "user", "no id"),
        (3, 0, "user", "y"), (3, 0, "user", "y"), (4, 7, "user", "y"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS segment", "2 AS n_turns")
    found = {(r.conv_id, r.n_turns, r.copies) for r in chat.format_chats(df).collect()}
    # 2 begins 1, and 4 begins 3, whose repeated turn counts twice.
    assert found == {(1, 2, 1), (None, 1, 1), (3, 2, 1)}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_blocks_of_equal_turn_numbers(spark):
    """No segment has more turns than a block, also where all have one number or none."""
    rows = [(None, i % 3 if i % 4 else None, "user", f"{i % 70};") for i in range(700)] + [(None, 1, "user", "same;")] * 90
    rows += [(5, 1000 * i, "user", f"{i};") for i in range(10)]
    found = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4), block=8).collect()
    for c, count in ((None, 790), (5, 10)):
        mine = sorted((r for r in found if r.conv_id == c), key=lambda r: r.segment)
        sizes = [r.text.count("<|im_start|>") for r in mine]
        assert [r.segment for r in mine] == list(range(len(mine))) and sum(sizes) == count == mine[0].n_turns
        assert all(n == 8 for n in sizes[:-1]) and sizes[-1] <= 8
        texts = re.findall(r"user\n([^;]*;)", "".join(r.text for r in mine))
        at = 0
        for turn in sorted({t for x, t, _, _ in rows if x == c}, key=lambda t: (t is None, t or 0)):
            expected = sorted(text for x, t, _, text in rows if x == c and t == turn)
            assert sorted(texts[at : at + len(expected)]) == expected
            at += len(expected)


def test_no_python_in_the_plan(spark, sf_dir):
    df = chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
