"""Every registered query: same values as its SQL, and a plan that scales."""

import re

import pytest
from oracle import compare, connect

from __spark_entry__ import entry
from quillmesh.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, sf_dir, name):
    error, *_ = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    assert error == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def windows_on_one_partition(plan: str) -> list[str]:
    """Window lines of a physical plan whose nearest exchange gathers all rows."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if re.search(r"[-+: ]Window\b|WindowGroupLimit", line):
            below = next((x for x in lines[i + 1 :] if "Exchange" in x), "")
            if "SinglePartition" in below:
                found.append(line.strip()[:120])
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert bad not in plan
    assert windows_on_one_partition(plan) == []


@pytest.mark.parametrize(
    "name, columns",
    [
        ("seeded_shuffle", {"doc_id", "lang"}),
        ("mix_total", {"doc_id", "lang", "n_chars"}),
        ("corpus_scan", {"doc_id", "lang", "source", "n_chars"}),
        ("label_rates", {"c_custkey", "c_acctbal", "c_mktsegment"}),
        ("mean_std", {"event_type", "value"}),
        ("formula_iou", {"p_partkey", "p_size"}),
        ("outcome_counts", {"event_type", "value"}),
    ],
)
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and {c.split(":")[0] for r in read for c in r.split(",")} <= columns


def test_filters_reach_the_scan(spark, sf_dir):
    plan = QUERIES["sft_mask"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in plan and "EqualTo(role,assistant)" in plan


def above(plan: str, scan: str) -> list[str]:
    """The operators between the output and the scan that reads a column."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and scan in line)
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            found, level = [*found, line.strip(" :+-")], depth(line)
    return found


@pytest.mark.parametrize(
    "name, column",
    [
        ("mix_total", "n_chars"),
        ("mix_smallest", "n_chars"),
        ("sample_rows", "value"),
        ("render_prompt", "text"),
        ("is_correct", "l_extendedprice"),
        ("perplexity", "embedding"),
        ("cut_at_stop", "text"),
        ("to_chat", "text"),
    ],
)
def test_payload_is_not_shuffled(spark, sf_dir, name, column):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    operators = above(plan, column)
    assert operators and not [line for line in operators if "Exchange" in line]


@pytest.mark.parametrize(
    "name, column, shuffles", [("pack_tokens", "text", 2), ("seeded_shuffle", "lang", 1), ("formula_iou", "p_size", 1)]
)
def test_payload_is_shuffled_only_so_often(spark, sf_dir, name, column, shuffles):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in above(plan, column) if "Exchange hashpartitioning" in line]
    # The entry that deals out small scans (`spread`) does not count: large ones have none.
    asked = [line for line in moved if "REPARTITION_BY_NUM" in line and name != "formula_iou"]
    assert 0 < len(moved) - len(asked) <= shuffles
