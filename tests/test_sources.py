import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import chat, lineage
from quillmesh.operators.scores import metric_report
from quillmesh.plans import corpora
from quillmesh.sources.corpus import read_corpus, spread, write_corpus
from quillmesh.sources.examples import read_examples, write_examples
from quillmesh.sources.runs import METHODS, METRICS, metrics_from_text, read_run_metrics
from quillmesh.streaming.corpora import progress_folder, training_rows, write_arrived

RECORD = "nl string, sstl string, python string"


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture()
def corpus(tmp_path):
    for family in ("heat", "wave"):
        folder = tmp_path / f"{family}_nc1_train"
        lines(folder / f"{family}_part.v2.jsonl", [{"nl": f"{family} {i}", "sstl": "f", "python": f"\nx = {i}\n"} for i in range(6)])
        lines(folder / "dataset_description.jsonl", [{"nl": "no"}])
        (folder / "README.md").write_text("no")
    return tmp_path


def test_corpus_files_and_their_lineage(spark, corpus):
    paths = [str(corpus / f"{f}_nc1_train") for f in ("heat", "wave")]
    rows = read_corpus(spark, paths, "jsonl", RECORD)
    assert rows.count() == 12 and {r.source_file for r in rows.collect()} == {"heat_part.v2.jsonl", "wave_part.v2.jsonl"}
    named = lineage.with_lineage(rows, "source_dir", "source_file")
    got = {r.source_dir: (r.keywords, r.dataset_class) for r in named.collect()}
    assert got["heat_nc1_train"] == ("heat_nc1_train_part.v2", "heat")
    assert got["wave_nc1_train"] == ("wave_nc1_train_part.v2", "wave")
    with pytest.raises(ValueError):
        read_corpus(spark, paths, "xml")


def test_other_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb'), (2, "c")], "id long, t string")
    df.write.parquet(str(tmp_path / "p"))
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    for fmt in ("parquet", "csv"):
        back = read_corpus(spark, [str(tmp_path / fmt[0])], fmt, "id long, t string", sources=False)
        assert sorted((r.id, r.t) for r in back.collect()) == [(1, 'a "q"\nb'), (2, "c")]


def test_all_formats_together(spark, corpus):
    folder = corpus / "heat_nc1_train"
    (folder / "more.json").write_text(json.dumps([{"nl": "a"}, {"nl": "b"}], indent=1))
    (folder / "last.csv").write_text("nl,sstl,python\nc,f,x\n")
    rows = read_corpus(spark, [str(folder)], None, RECORD, one_document=True).collect()
    assert sorted(r.nl for r in rows) == ["a", "b", "c"] + [f"heat {i}" for i in range(6)]
    with pytest.raises(ValueError):
        read_corpus(spark, [str(folder)], None)


def test_row_ids(spark, tmp_path):
    spark.range(0, 1000, 1, 4).withColumn("t", F.lit("same")).write.parquet(str(tmp_path / "p"))
    rows = read_corpus(spark, [str(tmp_path / "p")], "parquet", "id long, t string", row_ids=True)
    assert rows.select("row_id").distinct().count() == 1000
    again = read_corpus(spark, [str(tmp_path / "p")], "parquet", "id long, t string", row_ids=True)
    assert rows.join(again, ["row_id", "id"]).count() == 1000
    with pytest.raises(ValueError):
        read_corpus(spark, [str(tmp_path / "p")], "jsonl", "t string", row_ids=True)


def test_lineage_without_class(spark):
    df = spark.createDataFrame([("dpo_d0", "part_a.jsonl"), ("wave_heat", "x")], "p string, f string")
    loose = lineage.with_lineage(df, "p", "f", strict=False).collect()
    assert [r.dataset_class for r in loose] == [None, "heat"] and loose[0].output_name == "tokenized_dpo_d0_part_a"
    with pytest.raises(Exception, match="no dataset class"):
        lineage.with_lineage(df, "p", "f").collect()


def test_common_keywords(spark):
    df = spark.createDataFrame([("x/a_b_x.parquet",), ("b_a_y.parquet",), ("b_a_y.parquet",)], "name string")
    row = lineage.common_keywords(df, "name", "out.v1/all").first()
    assert (row.keywords, row.output_name) == ("a_b", "out.v1/all_a_b")
    assert lineage.common_keywords(df, "name", "all.parquet", ("a", "b")).first().output_name == "all.parquet"


def test_union_takes_the_first_types(spark):
    a = spark.createDataFrame([(1, "x")], "id long, t string")
    b = spark.createDataFrame([("y", 2, 5)], "t string, id int, more int")
    both = lineage.union_aligned({"a": a, "b": b})
    assert dict(both.dtypes) == {"input": "string", "id": "bigint", "t": "string"}
    assert {r.input: r.rows for r in lineage.input_sizes(both).collect()} == {"a": 1, "b": 1}


def test_written_corpus(spark, tmp_path):
    df = spark.createDataFrame([(1, "s1", "in1"), (2, "s2", "in2")], "id long, source string, origin string")
    path = str(tmp_path / "out")
    write_corpus(df, path, expect_unique="origin")
    with pytest.warns(UserWarning, match="already exists"):
        write_corpus(df.filter("id = 2"), path, expect_unique="origin")
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]
    clash = df.withColumn("source", F.lit("s"))
    with pytest.raises(ValueError, match="two inputs"):
        write_corpus(clash, path, expect_unique="origin")


def test_examples_round_trip(spark, tmp_path):
    lines(tmp_path / "test.jsonl", [
        {"task": "n", "code": "\u00a0x = 1\n\t", "sstl": "f", "score": 2.5, "time": 1.0},
        {"task": "m", "code": "y", "sstl": "g"},
    ])
    rows = read_examples(spark, str(tmp_path / "test.jsonl"), keys={"nl": "task", "python": "code", "robustness": "score"})
    got = {r.nl: r for r in rows.collect()}
    assert got["n"].python == "x = 1" and got["n"].robustness == 2.5 and got["m"].robustness is None
    write_examples(rows, str(tmp_path / "back"))
    first = json.loads(next(iter((tmp_path / "back").glob("*.json"))).read_text().splitlines()[0])
    assert list(first)[-4:] == ["sstl", "python", "robustness", "time"]
    with pytest.raises(ValueError, match="lack the keys"):
        read_examples(spark, str(tmp_path / "test.jsonl"))


def test_run_metrics(spark, tmp_path):
    def run(name, method, metrics, file="metrics.json"):
        folder = tmp_path / name / method
        folder.mkdir(parents=True, exist_ok=True)
        (folder / file).write_text(json.dumps(metrics, indent=4))

    run("heat_nc1_shots=2_seed=-1", "to_STL", {"iou": 0.5, "n_samples": 512, "few_shot_prompt": "x"})
    run("heat_nc1_shots=0_seed=3", "to_STL", {"iou": 0.25})
    run("wave_shots=2_seed=-1_v2", "to_python_no_STL", {"perplexity": 1.5})
    run("wave_shots=2_seed=-1_v2", "to_python_no_STL", {"perplexity": 9}, "metrics.8.json")
    (tmp_path / "notes").mkdir()
    rows = read_run_metrics(spark, str(tmp_path)).collect()
    got = {(r.dataset, r.shots, r.seed, r.method, r.metric): r.value for r in rows}
    assert got == {
        ("heat_nc1", 2, -1, "to_STL", "iou"): 0.5,
        ("heat_nc1", 2, -1, "to_STL", "n_samples"): 512.0,
        ("heat_nc1", 0, 3, "to_STL", "iou"): 0.25,
        ("wave", 2, -1, "to_python_no_STL", "perplexity"): 1.5,
    }
    assert {r.dataset for r in read_run_metrics(spark, str(tmp_path), seeds=[3]).collect()} == {"heat_nc1"}
    assert [r.value for r in read_run_metrics(spark, str(tmp_path), subset=8).collect()] == [9.0]
    reported = read_run_metrics(spark, str(tmp_path), methods=METHODS[3:], metrics=METRICS).collect()
    assert sorted(r.value for r in reported) == [0.25, 0.5]


def test_run_files_to_report(spark, tmp_path):
    for seed, value in ((0, 0.5), (1, 0.7)):
        for data in ("heat", "wave"):
            folder = tmp_path / f"{data}_shots=2_seed={seed}" / "to_STL"
            folder.mkdir(parents=True)
            (folder / "metrics.json").write_text(json.dumps({"iou": value, "other": "text"}))
    report = metric_report(read_run_metrics(spark, str(tmp_path), seeds=[0, 1])).collect()
    assert {r.shots: r.heat for r in report} == {0: "n/a", 1: "n/a", 2: "0.6000 (0.1414)"}


def test_training_corpus_shapes(spark, corpus):
    paths = [str(corpus / f"{f}_nc1_train") for f in ("heat", "wave")]
    rows = lineage.with_lineage(read_corpus(spark, paths, "jsonl", RECORD), "source_dir", "source_file")
    args = ("to_python_no_STL", "nl", "dataset_class", {"heat": 0.75, "wave": 0.25}, 16, 40)
    cut = corpora.training_corpus(rows, *args).collect()
    assert len(cut) == 16 and sorted(r.position for r in cut) == list(range(16))
    assert all(len(r.input_ids) == len(r.labels) <= 40 for r in cut)
    padded = corpora.training_corpus(rows, *args, shape="pad").collect()
    assert {len(r.input_ids) for r in padded} == {40}
    packed = corpora.training_corpus(rows, *args, shape="pack").collect()
    assert {len(r.input_ids) for r in packed} == {40} and len(packed) >= 16
    with pytest.raises(ValueError):
        corpora.training_corpus(rows, *args, shape="heap")


def test_from_files_to_a_stored_corpus(spark, corpus):
    paths = [str(corpus / f"{f}_nc1_train") for f in ("heat", "wave")]
    raw = lineage.with_lineage(read_corpus(spark, paths, "jsonl", RECORD), "source_dir", "source_file")
    write_corpus(raw, str(corpus / "raw"), "dataset_class", expect_unique="source_file")
    rows = read_corpus(spark, [str(corpus / "raw")], "parquet", row_ids=True, sources=False)
    mixed = corpora.training_corpus(
        rows, "to_python_no_STL", "row_id", "dataset_class", {"heat": 0.75, "wave": 0.25}, 16, 64
    )
    write_corpus(mixed, str(corpus / "tokenized"), "dataset_class")
    stored = spark.read.parquet(str(corpus / "tokenized"))
    assert {r["dataset_class"]: r["count"] for r in stored.groupBy("dataset_class").count().collect()} == {"heat": 12, "wave": 4}
    assert stored.filter("size(input_ids) <> size(labels)").count() == 0


def test_preference_corpus(spark):
    df = spark.createDataFrame([("a task", " good ", "bad")], "anchor string, w_sstl string, l_sstl string")
    row = corpora.preference_corpus(df, (), 5).first()
    assert len(row.prompt_input_ids) == 5 and row.chosen_input_ids[-1] == row.rejected_input_ids[-1] == 2


def test_scored_examples_to_report(spark):
    formula = r"G_[[0.5, 1.5]] (\forall x \in [2, 9] (u(x) - (0.5 \cdot x + 3) > 0))"
    good = f"Formula:\n```latex\n{formula}\n```\n```python\nx = 1\n```"
    rows = [(1, "heat", "x = 1", formula, good, [-1.0]), (2, "heat", "x = 1", formula, "nothing", [-2.0])]
    df = spark.createDataFrame(rows, "id long, dataset string, python string, sstl string, completion string, logits array<double>")
    scored = {r.id: r for r in corpora.scored_examples(df, "id", task="cot").collect()}
    assert (scored[1].iou, scored[1].edit_distance, scored[1].status) == (1.0, 0, "ok")
    assert (scored[2].iou, scored[2].status, scored[2].predicted_python) == (None, "failed", "[invalid]")
    metrics = {r.metric: r.value for r in corpora.run_metrics(corpora.scored_examples(df, "id", task="cot"), ["dataset"]).collect()}
    assert metrics["n_samples"] == 2 and metrics["iou"] == 1 and set(metrics) == {"n_samples", "iou", "edit distance", "perplexity"}


def test_files_that_arrive_are_taken_once(spark, tmp_path):
    folder = tmp_path / "in"
    lines(folder / "a.jsonl", [{"nl": "one", "sstl": "f", "python": "x"}])
    rows = training_rows(spark, str(folder), RECORD, "to_STL", 64, keep=("nl",))
    for new, total in ((None, 1), ("b.jsonl", 2), (None, 2)):
        if new:
            lines(folder / new, [{"nl": "two", "sstl": "g", "python": "y"}])
        query = write_arrived(rows, str(tmp_path / "out"), "rows", str(tmp_path / "progress"))
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == total
    batch = spark.read.schema(RECORD).json(str(folder))
    from quillmesh.operators import prompts, tokens

    same = tokens.truncate(tokens.encode_sft(prompts.build_sft(batch, "to_STL", ("nl",))), 64)
    assert sorted(map(str, same.collect())) == sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*same.columns).collect()))


def test_progress_is_kept_in_the_shared_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            progress_folder(spark, "rows")
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "/shared/"))
    assert progress_folder(cluster, "rows") == "/shared/rows"


def test_spread_leaves_large_scans_alone(spark):
    assert spread(spark.range(0, 100, 1, 16), "id").rdd.getNumPartitions() == 16
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == 32


def test_chat_edges(spark):
    sat = spark.createDataFrame([(1, "q", "A) 1 B) 2 D) 4", "D"), (2, "q", "x) 1", "D")], "id long, question string, options string, Answer string")
    first = chat.to_chat(sat.filter("id = 1"), "sat").first()
    assert first.messages[0].content.endswith("\n(A) 1 (B) 2 (D) 4") and first.answer == ["D"]
    with pytest.raises(Exception, match="options must begin with A"):
        chat.to_chat(sat, "sat").collect()
    math_items = spark.createDataFrame([(1, "p", None, "1", "t", "c"), (2, "p", r"So. Then. it. \boxed{1/2}", "1", "t", "c")],
                                       "id long, problem string, solution string, level string, type string, category string")
    (row,) = chat.to_chat(math_items, "math").collect()
    assert row.messages[1].content == "So.\nThen. it. \\boxed{1/2}" and row.answer == [r"\frac{1}{2}"] and row.level == "1"
    qa = spark.createDataFrame([(1, " q ", ["(A) it's", '(B)"x" it\'s', "(C)a\\b"], "A")], "id long, question string, options array<string>, label string")
    assert chat.to_chat(qa, "gaokao_qa").first().messages[0].content == "q\n" + str(["A: it's", 'B: "x" it\'s', "C: a\\b"])
    with pytest.raises(Exception, match="option without a letter"):
        chat.to_chat(qa.withColumn("options", F.array(F.lit("(E) x"))), "gaokao_qa").collect()
    with pytest.raises(ValueError):
        chat.to_chat(qa, "none")


BROKEN_LINES = ['{"a": 1, "b": "x"}', '{"a": 2, "b": ', "", "[1", '{"a": "text", "b": "y"}', '  {"a": 3, "b": null}  ', '{"a": 4, "b": "z", "c": 1}']


def test_broken_records_are_errors_that_name_the_file(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text("\n".join([BROKEN_LINES[0], BROKEN_LINES[-1]]))
    rows = read_corpus(spark, [str(tmp_path)], "jsonl", "a long, b string")
    assert sorted((r.a, r.b, r.source_file) for r in rows.collect()) == [(1, "x", "good.jsonl"), (4, "z", "good.jsonl")]
    (tmp_path / "bad.jsonl").write_text("\n".join(BROKEN_LINES[:2]))
    with pytest.raises(Exception, match=r"broken record in .*bad\.jsonl: \{\"a\": 2"):
        read_corpus(spark, [str(tmp_path)], "jsonl", "a long, b string").collect()
    # Also where no field is asked for.
    with pytest.raises(Exception, match="broken record"):
        read_corpus(spark, [str(tmp_path)], "jsonl", "a long, b string").count()
    # And where the schema is taken from the data.
    with pytest.raises(Exception, match="broken record"):
        read_corpus(spark, [str(tmp_path)], "jsonl").collect()


def test_broken_records_set_aside(spark, tmp_path):
    (tmp_path / "all.jsonl").write_text("\n".join(BROKEN_LINES))
    rows = read_corpus(spark, [str(tmp_path)], "jsonl", "a long, b string", broken="keep")
    found = rows.collect()
    good = sorted((r.a, r.b or "") for r in found if r.broken_record is None)
    assert good == [(1, "x"), (3, ""), (4, "z")]
    broken = [r for r in found if r.broken_record is not None]
    assert sorted(r.broken_record for r in broken) == sorted(BROKEN_LINES[i] for i in (1, 3, 4))
    assert all(r.a is None and r.b is None and r.source_file == "all.jsonl" for r in broken)
    # Counting the broken ones alone works too.
    assert rows.filter("broken_record IS NOT NULL").count() == 3
    with pytest.raises(ValueError):
        read_corpus(spark, [str(tmp_path)], "csv", "a long", broken="keep")
    with pytest.raises(ValueError):
        read_corpus(spark, [str(tmp_path)], "jsonl", "a long, broken_record string")


def test_metrics_that_are_no_numbers(spark):
    texts = {"a": "5d", "b": "NaN", "c": "Infinity", "d": "1e999", "e": " -1.5e3 ", "f": "0x10", "g": "7", "h": "1_0", "i": ""}
    files = spark.createDataFrame([("/runs/x_shots=1_seed=2/to_STL/metrics.json", json.dumps(texts))], "path string, value string")
    found = {r.metric: r.value for r in metrics_from_text(files).collect()}
    assert found == {"e": -1500.0, "g": 7.0}
