import corpus_pipeline
from brute import hits, linked, repeats
from quillmesh.llm.queries import vocabulary

from quillmesh.llm import bpe

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage against brute force on what it was given."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    names = ["quality rules", "n-gram jaccard join", "suffix-array dedup", "benchmark decontamination", "byte-level bpe"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test")
        kept = {r.doc_id: r for r in out.collect()}
        rows = [(d, r.text) for d, r in given.items()]
        if name == names[0]:
            clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0 and d in given and len(given[d].text.split()) >= 50]
            assert sum(d in kept for d in clean) >= 0.98 * len(clean)
            assert not any(labels[d].quality == 0 for d in kept if d in labels)
        elif name == names[1]:
            assert set(kept) == {d for d, n, c in linked(rows) if n == 0 or c == d}
        elif name == names[2]:
            assert set(kept) == set(given)
            for d, n_bytes, removed, *_ in repeats(rows):
                lost = n_bytes - len(kept[d].text.encode())
                # Characters that lost a byte go whole.
                assert removed <= lost <= removed + 3 * 2 * 50 and (removed or kept[d].text == given[d].text)
                assert not removed or kept[d].n_chars == len(kept[d].text)
        elif name == names[3]:
            assert set(kept) == {d for d, *_, bad in hits(rows, items) if not bad}
        else:
            tokens = bpe.Tokenizer(*vocabulary())
            assert set(kept) == set(given)
            for d, r in kept.items():
                assert r.round_trip and list(r.ids) == tokens.encode(given[d].text)
        if name != names[-1]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in names[:2] + names[3:4]:
            assert all(kept[d] == given[d] for d in kept)
        docs, given = out, kept
    assert corpus_pipeline.ORACLE_SQL is None


def test_without_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test")
    assert docs.count() == 0


def test_columns_of_any_name(spark, sf_dir):
    """Columns that the operators use themselves come out as they went in; NULLs, empty and
    repeated rows are dealt with as the stages say."""
    more = {"score": "s", "kept": "k", "n_removed": "r", "_id": "i", "_k": "j", "label": "l", "base_failed": "b", "_text": "t"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", "s", 0), (5, "", None, None, None), (5, "", None, None, None)], docs.schema
    )
    docs = docs.unionByName(odd).selectExpr("*", *[f"concat('{v}', cast(doc_id AS string)) AS {c}" for c, v in more.items()])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        assert out.columns == columns
        rows = out.collect()
        assert rows
        for r in rows:
            for c, v in more.items():
                assert r[c] == (None if r.doc_id is None else f"{v}{r.doc_id}")
        empty = [r for r in rows if r.doc_id is None or r.doc_id == 5 and not r.text]
        assert len(empty) == {"quality rules": 0, "n-gram jaccard join": 2}.get(name, 4)
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, sf_dir).count() == docs.count()
