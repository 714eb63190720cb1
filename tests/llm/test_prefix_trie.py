import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillmesh.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    """Conversations by id, as lists of (role, text); no two turns of one number here."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def trie(convs):
    """The nodes, by walking every prefix of every conversation."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        bytes_ = len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * bytes_
    listed = lambda node: ",".join(map(str, sorted(ends[node]))) if node in ends else ""
    return sorted(
        (
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children[node]),
            leaves[node], saved[node], hashlib.sha256(listed(node).encode()).hexdigest(),
        )
        for node, inside in members.items()
    )


def random_rows(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 200), convs):
        for i in range(rng.choice([1, 1, 2, 5, 14])):
            rows.append((c, None if i == 0 and c % 3 == 0 else 3 * i, rng.choice(["user", None]), rng.choice(["a", "é", "", None, "bb"])))
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_trie(spark, block):
    """Also with negative ids, missing bases, turns without a number, and tiny blocks."""
    rows = random_rows(block)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS bytes", "'x' AS depth").repartition(5)
    # Families of negative ids: the remainder keeps the sign.
    convs = rebuilt([r for r in rows if r[0] is None or r[0] >= 0])
    found = prefix_trie.shared_prefixes(df.filter("conv_id >= 0"), block).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(trie(convs), key=str)


def test_gaps(spark):
    rows = [(None, 1, "user", "no id")] * 3 + [(7, 1, "user", "x"), (7, 1, "user", "x"), (8, None, None, None)]
    found = prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.n_convs for r in found if r.depth == 0} == {2}
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.shared_prefixes(none).count() == 0
    only = prefix_trie.shared_prefixes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))
    assert only.count() == 0


def test_long_end_lists(spark):
    """A list of ends is the same whether its ids come in one piece or in many."""
    rows = [(20_000 * i, 1, "user", "same") for i in range(300)] + [(i * 5, 1, "user", "same") for i in range(1, 900)]
    convs = rebuilt(rows)
    found = prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA).repartition(4)).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(trie(convs), key=str)


def test_turns_of_nodes(spark):
    df = spark.createDataFrame([(5, 1, "user", "x"), (5, 2, None, "y"), (10, 1, "user", "x")], SCHEMA)
    turns = prefix_trie.numbered(df)
    nodes = prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct())
    found = prefix_trie.with_turns(nodes, df).collect()
    assert sorted((r.depth, r.role or "", r.text or "", r.n_convs) for r in found) == [(0, "", "", 2), (1, "user", "x", 2), (2, "", "y", 1)]


def test_numbers(spark):
    """A conversation over many partitions, and one row repeated often."""
    rows = [(1, i, "user", str(i)) for i in range(500)] + [(2, 1, "user", "again")] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = prefix_trie.numbered(df).collect()
    for c, n in ((1, 500), (2, 300)):
        assert sorted(r.place for r in found if r.conv_id == c) == list(range(n))
        assert {r.n_turns for r in found if r.conv_id == c} == {n}
