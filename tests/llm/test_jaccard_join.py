import random
import zlib

import numpy as np
import pytest
from brute import linked, ordered

from quillmesh.llm import jaccard_join
from quillmesh.llm.components import components
from quillmesh.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_shingles", "component_id"]


def made(seed=5):
    rng = random.Random(seed)
    known = [f"w{i}" for i in range(400)]
    rows = [
        (1, None), (2, " \n"), (3, ""), (None, "a b c"), (None, "a b C"), (9, "A b c"), (4, "x"), (5, "X"),
        (None, "only null"), (7, "p q r s t u v"), (7, "completely other text here now and then"), (8, "p q r s t u v"),
    ]
    for _ in range(25):
        base = [rng.choice(known) for _ in range(rng.choice([3, 6, 9, 14, 30, 60, 150]))]
        for _ in range(rng.choice([1, 2, 3, 10, 40])):
            copy = list(base)
            for _ in range(rng.randrange(len(base) // 20 + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(known)
            if rng.random() < 0.3:
                copy += [rng.choice(known) for _ in range(rng.randrange(len(copy) // 6 + 1))]
            rows.append((rng.randrange(10**6), " ".join(copy)))
    # A passage that many share, without being near-duplicates.
    for i in range(120):
        rows.append((10**7 + i, " ".join(known[:60] + [rng.choice(known) for _ in range(8 + i % 8)])))
    return rows


@pytest.mark.parametrize("cold, rare, block", [(16, 64, 1024), (3, 4, 8)])
def test_made_texts(spark, monkeypatch, cold, rare, block):
    """Also where nearly all groups count as hot, and families have many blocks."""
    rows = made()
    real = jaccard_join._group
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)

    def group(batches):
        jaccard_join.COLD = cold
        return real(batches)

    monkeypatch.setattr(jaccard_join, "_group", group)
    found = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert ordered(found.select(COLUMNS).collect()) == linked(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(QUERIES["op7_jaccard_join"](spark, sf_dir).select(COLUMNS).collect()) == linked(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.link_documents(df).count() == 0


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, 1), (2, text + " more", 2), (9, text, 3), (2, text + " more", 4), (5, None, 5), (6, "", 6), (None, text, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6]


def test_keep_one_of_each_component(spark):
    """Unrelated texts stay, whether they share an id or have none."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [
        (None, a), (None, a), (None, a + " more"), (None, b), (7, c), (7, d), (7, d), (7, c + " more"), (9, d), (None, e),
        (8, e), (None, None), (None, ""), (None, " "),
    ]
    kept = ordered(jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    texts = {t for i, t in kept if i is None and t and t != " "}
    assert b in texts and len(texts & {a, a + " more"}) == 1 and e not in texts and len(texts) == 2
    sevens = [t for i, t in kept if i == 7]
    assert d in sevens and len(sevens) == 2 and (8, e) in kept and not any(i == 9 for i, _ in kept)
    assert sum(i is None and not (t or "").strip() for i, t in kept) == 2


def test_texts_of_equal_crc32(spark):
    """Rows without id, or of one id, are told apart by more than 32 bits."""
    one, two = "plumless now and then", "buckeroo now and then"
    assert zlib.crc32(one.encode()) == zlib.crc32(two.encode())
    df = spark.createDataFrame([(None, one), (None, two), (7, two), (7, one), (None, one)], "doc_id long, text string")
    assert ordered(jaccard_join.keep_one(df).collect()) == ordered([(7, one), (7, two)])
    alone = df.filter("doc_id IS NULL")
    assert ordered(jaccard_join.keep_one(alone).collect()) == ordered([(None, one), (None, two)])


def test_pieces_allow_for_the_difference():
    """A set has more pieces of its own than two linked sets of its bands can differ in."""
    rng = np.random.default_rng(1)
    short = 0
    for n in (1, 2, 3, 7, 20, 60, 150, 500, 3000):
        for side in (0, 1):
            h = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
            _, _, slack = jaccard_join.sketch(h, np.array([n]), side)
            short += int(slack[0] <= 0)
    assert short <= 2


def test_bands_hold_linked_sizes():
    edges = jaccard_join.bands(100_000)
    for n in [*range(1, 3000), 50_000, 99_999]:
        low, high = (np.searchsorted(edges, x, "right") for x in (n, 4 * n // 3))
        assert high - low <= 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, found.collect())) == {x: find(x) for x in list(parent)}


def test_folded_sketch_is_that_of_the_smaller_size():
    rng = np.random.default_rng(3)
    small, large = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (200, 900))
    both = jaccard_join._bits([small, large])
    alone = jaccard_join._bits([small])[0].view(np.uint8)
    assert len(alone) < both.shape[1] * 8
    assert np.array_equal(jaccard_join._folded(both[0].view(np.uint8), len(alone)), alone)
