import random

import numpy as np
import pyarrow as pa
import pytest
from brute import hits, ordered, sha
from pyspark.sql import functions as F

from quillmesh.llm import decontamination
from quillmesh.llm.common import text_bytes
from quillmesh.llm.queries import QUERIES
from quillmesh.llm.shingles import LOWER, word_hashes


def made(seed=4):
    rng = random.Random(seed)
    known = ["a", "b", "C", "dé", "9", "x1"] + [f"w{i}" for i in range(40)]
    items = [(1, "a"), (2, None), (3, ""), (4, "b C"), (None, "w1 w2 w3"), (5, "!!"), (77, "a")]
    items.append((6, " ".join(rng.choice(known[:3]) for _ in range(13))))
    items += [(10 + i, " ".join(rng.choice(known) for _ in range(rng.randrange(1, 40)))) for i in range(30)]
    docs = [(None, None), (1, ""), (2, "..."), (3, "A a,b;c"), (3, "A a,b;c")]
    for i in range(120):
        w = [rng.choice(known) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            t = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(t) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[a : a + rng.randrange(20)]
        docs.append((i, rng.choice([" ", "-", "\n"]).join(w)))
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_made_texts(spark, block):
    docs, items = made()
    found = decontamination.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), block=block,
    )
    rows = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect()]
    assert ordered(rows) == hits(docs, items)


def test_query(spark, sf_dir):
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()]
        for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    expected = [(d, w, h, len(i), sha(",".join(i)), c) for d, w, h, i, c in hits(docs, items)]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert ordered(QUERIES["op4_decontamination"](spark, sf_dir).select(columns).collect()) == ordered(expected)


def test_longest_matches_and_places(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z " + " ".join(f"w{i}" for i in range(13))
    df = spark.createDataFrame([(1, text, "kept")], "doc_id long, text string, items string")
    row = decontamination.find_contamination(df, spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert [(m.item_id, m.start, m.length) for m in row.matches] == [("9", 2, 20), ("9", 23, 13)]
    clean = decontamination.decontaminate(df, spark.createDataFrame([(9, "other")], "item_id long, text string"))
    assert [tuple(r) for r in clean.collect()] == [(1, text, "kept")]


def test_empty_tables(spark):
    docs, items = made()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.decontaminate(df.limit(0), benchmark).count() == 0
    found = decontamination.find_contamination(df, benchmark.limit(0))
    assert found.filter(F.col("n_hit") > 0).count() == 0 and found.count() == len(docs)


def test_slices_of_many_words(monkeypatch):
    docs, items = made()
    known = decontamination.Benchmark([(str(i), t) for i, t in items])
    raw, at = text_bytes(pa.array([t or "" for _, t in docs], pa.string()))
    words = word_hashes(raw, at, decontamination.OTHER, LOWER)
    whole = known.matches(*words)
    monkeypatch.setattr(decontamination, "SLICE", 50)
    assert all(np.array_equal(a, b) for a, b in zip(whole, known.matches(*words)))
