import numpy as np
import pytest
from brute import ordered, statistics

from quillmesh.llm import quality
from quillmesh.llm.queries import QUERIES

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op10_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == statistics(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    told = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    good = [kept for label, kept in told if label.quality == 1]
    poor = [kept for label, kept in told if label.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.1 * len(poor)


def test_held_out_labels(spark):
    """Fitted to the labels of half of the documents, it tells the other half apart."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.judge(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0 and not r.base_failed]
    poor = [r.kept for r in rows if r.quality == 0]
    assert all(clean) and sum(poor) <= 0.05 * len(poor)


EDGES = [
    (1, None), (2, ""), (3, " \n \n"), (4, "a b a b a b"), (5, "x\nx\n \n \nx #|<"), (6, "é ü ß"), (None, "w " * 100),
    (8, "same line here\nsame line here\n" * 3), (8, "same line here\nsame line here\n" * 3), (9, "a\x0bb c\r\nd c\r\nd"),
]


def test_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS score")
    model = quality.Model(np.zeros(quality.BUCKETS), -0.5)
    rows = quality.judge(df, model).collect()
    assert ordered((r.text, *(r[c] for c in COLUMNS)) for r in rows) == ordered((t, *statistics(t)) for _, t in EDGES)
    assert quality.judge(df.limit(0), model).count() == 0


def test_fit_without_labels(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    none = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, none)
    assert model.threshold == quality.DEFAULT_THRESHOLD and not model.weights.any()


def test_counts_cover_all_documents(spark):
    df = spark.createDataFrame([(i, f"alpha beta {i % 3}") for i in range(50)], "doc_id long, text string")
    every, good = quality._counts(df.repartition(7), "doc_id", "text", np.array([3, 4]))
    assert every.sum() == 50 * 5 and good.sum() == 2 * 5


def test_all_trusted_documents_are_counted(spark):
    """Also beyond the bound of the labels that the threshold is fitted to."""
    docs = [(i % 60, f"alpha beta gamma{i % 60}") for i in range(120)] + [(None, "alpha beta"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    told = [(i, int(i < 40), int(i < 5)) for i in range(60)] + [(39, 0, 0), (None, 1, 0), (7, 1, 0)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    trusted = [t for i, t in docs if i is not None and 5 <= i < 39]

    def counted(texts):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        found, _ = quality.ngrams(raw, np.cumsum([0, *[len(t) for t in texts]]))
        return np.bincount(found, minlength=quality.BUCKETS)

    model = quality.fit(df, labels, most=6)
    expected = quality.weights(counted([t or "" for _, t in docs]), counted(trusted))
    assert len(trusted) == 68 and np.allclose(model.weights, expected)


@pytest.mark.parametrize("good, poor, low, high", [([1, 2, 3], [-3, -2], -2, 1), ([0, 1], [], None, None), ([1, 2], [3, 4], None, 1)])
def test_threshold(good, poor, low, high):
    cut = quality.fit_threshold(np.array(good, float), np.array(poor, float))
    if not poor:
        assert cut == quality.DEFAULT_THRESHOLD
    else:
        assert cut < high and (low is None or cut == (low + high) / 2)


def test_ngrams_are_those_of_the_text():
    raw = np.frombuffer("Of%%% the 12ab".encode(), np.uint8)
    found, n = quality.ngrams(raw, np.array([0, len(raw)]))
    # of, %%%, the, 12, ab and four pairs.
    assert n.tolist() == [9] and len(found) == 9
    two = np.frombuffer("Of%%% the 12abOf%%% the 12ab".encode(), np.uint8)
    both, n = quality.ngrams(two, np.array([0, len(raw), 2 * len(raw)]))
    assert n.tolist() == [9, 9] and both.tolist() == [*found, *found]


def test_scores_do_not_depend_on_other_texts():
    """A text scores the same alone, in a chunk, and last of a long chunk; also a run without blanks."""
    from quillmesh.llm.common import CHUNK

    rng = np.random.default_rng(2)
    model = rng.normal(size=quality.BUCKETS) * 3
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, size=rng.integers(0, 300))).encode() for _ in range(300)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    together = quality._score(raw, at, model)
    alone = [quality._score(np.frombuffer(t, np.uint8), np.array([0, len(t)]), model)[0] for t in texts]
    assert list(together) == alone
    # One token of more than a slice has one hash, whatever stands around it.
    token = b"x" * (CHUNK + 1000)
    for text in (token + b" y" * 3, b"y " * (CHUNK // 2 + 77) + token + b" y" * CHUNK):
        one = np.frombuffer(text, np.uint8)
        whole = quality._tokens(one, np.array([0, len(one)]))[0]
        expected = quality._piece(np.frombuffer(token, np.uint8), np.array([0, len(token)]))[0][0]
        assert (whole == expected).sum() == 1 and len(set(whole.tolist())) == 2
