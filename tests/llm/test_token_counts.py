import pytest

from quillmesh.llm import token_counts

SCHEMA = "op string, doc_id long, source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"


def totals(store):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


@pytest.fixture
def store(spark, tmp_path):
    return token_counts.TokenTotals(spark, f"file://{tmp_path}/totals")


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_batches(spark, store):
    assert totals(store) == {}
    first = changes(spark, ("insert", 1, "s", "en", "v1", None, 10), ("insert", 2, "s", "en", "v1", None, 5), ("insert", 3, None, "de", "v1", 99, 7))
    assert store.commit("a", first) and not store.commit("a", first)
    assert totals(store) == {("s", "en", "v1"): (2, 15), (None, "de", "v1"): (1, 7)}
    store.commit("b", changes(spark, ("revise", 1, "s", "en", "v1", 10, 12), ("delete", 3, None, "de", "v1", 7, None)))
    assert totals(store) == {("s", "en", "v1"): (2, 17)}
    store.compact()
    assert totals(store) == {("s", "en", "v1"): (2, 17)} and not store.commit("b", first)
    store.commit("c", changes(spark, ("delete", 1, "s", "en", "v1", 12, 0), (None, 5, "s", "en", "v1", 1, 2), ("strange", 5, "s", "en", "v1", 1, 2)))
    store.compact()
    assert totals(store) == {("s", "en", "v1"): (1, 5)}


def test_broken_batch_is_written_anew(spark, store):
    rows = changes(spark, ("insert", 1, "s", "en", "v1", None, 10))
    store.commit("a", rows)
    fs, path = store._folder(f"{store.path}/deltas/a/_SUCCESS")
    fs.delete(path, False)
    assert totals(store) == {}
    assert store.commit("a", rows) and totals(store) == {("s", "en", "v1"): (1, 10)}


def test_empty_batch_and_names(spark, store):
    assert store.commit("empty", spark.createDataFrame([], SCHEMA))
    assert totals(store) == {}
    with pytest.raises(ValueError):
        store.commit("../x", spark.createDataFrame([], SCHEMA))


def test_batch_committed_during_compaction(spark, tmp_path, monkeypatch):
    """A batch that is committed while a snapshot is written counts once."""
    schema = "op string, doc_id long, source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"
    batch = lambda i, n: spark.createDataFrame([("insert", i, "s", "en", "v1", None, n)], schema)
    store = token_counts.TokenTotals(spark, str(tmp_path / "totals"))
    store.commit("a", batch(1, 1))
    listed = store._committed

    def late(kind):
        names = listed(kind)
        if kind == "deltas" and "b" not in names:
            monkeypatch.setattr(store, "_committed", listed)
            store.commit("b", batch(2, 10))
        return names

    monkeypatch.setattr(store, "_committed", late)
    store.compact()
    assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [(2, 11)]
