import json

import pytest

from quillmesh.jobs import main


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture()
def records(tmp_path):
    for family, n in (("heat", 9), ("wave", 4)):
        rows = [{"nl": f"{family} {i}", "sstl": f"f {i}", "python": f"x = {i}"} for i in range(n)]
        lines(tmp_path / f"{family}_train" / "part.jsonl", rows)
        (tmp_path / f"{family}_train" / "part_description.jsonl").write_text('{"nl": "no"}\n')
    return [str(tmp_path / f"{f}_train") for f in ("heat", "wave")]


@pytest.mark.parametrize(
    "options, rows",
    [
        ([], 13),
        (["--total", "3"], 6),
        (["--balance", "heat_train_part=0.5", "wave_train_part=0.5"], 8),
        (["--balance", "heat_train_part=0.25", "wave_train_part=0.75", "--total", "12", "--shape", "pad"], 12),
    ],
)
def test_prepare(spark, tmp_path, records, options, rows):
    out = tmp_path / "out"
    main(["prepare", "--paths", *records, "--out", str(out), "--format", "to_STL", "--max-len", "50", *options], spark)
    corpus = spark.read.parquet(str(out / "corpus_part_train"))
    assert corpus.count() == rows
    assert corpus.filter("size(input_ids) > 50 or size(input_ids) <> size(labels)").count() == 0


def test_prefer(spark, tmp_path):
    lines(tmp_path / "dpo_d0" / "a.jsonl", [{"anchor": "task", "w_sstl": f"good {i}", "l_sstl": "bad"} for i in range(5)])
    main(["prefer", "--paths", str(tmp_path / "dpo_d0"), "--out", str(tmp_path / "out"), "--max-len", "7"], spark)
    rows = spark.read.parquet(str(tmp_path / "out" / "preferences")).collect()
    assert len(rows) == 5 and {len(r.prompt_input_ids) for r in rows} == {7}


def test_label(spark, tmp_path):
    lines(tmp_path / "test.jsonl", [{"nl": "a", "sstl": "f", "python": " x\n", "robustness": 2.0}, {"nl": "b", "sstl": "g", "python": "y"}])
    lines(tmp_path / "results.jsonl", [{"nl": "b", "robustness": -1.0, "time": 3.5}, {"nl": "a", "robustness": 9.0, "time": 1.0}])
    main(["label", "--examples", str(tmp_path / "test.jsonl"), "--results", str(tmp_path / "results.jsonl"), "--out", str(tmp_path / "out")], spark)
    got = {r.nl: (r.robustness, r.time) for r in spark.read.json(str(tmp_path / "out" / "examples")).collect()}
    assert got == {"a": (2.0, None), "b": (-1.0, 3.5)}
    metrics = json.loads((tmp_path / "out" / "test_shots=0_seed=-1" / "gt" / "metrics.json").read_text())
    assert metrics == {"n_samples": 2, "gt positive robustness rate": 0.5, "gt negative robustness rate": 0.5, "gt failed robustness rate": 0}


def test_report(spark, tmp_path):
    for seed, value in ((0, 0.5), (1, 0.7)):
        folder = tmp_path / "runs" / f"heat_shots=2_seed={seed}" / "to_STL"
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text(json.dumps({"iou": value}))
    main(["report", "--runs", str(tmp_path / "runs"), "--seeds", "0", "1", "--out", str(tmp_path / "out")], spark)
    text = "".join(p.read_text() for p in (tmp_path / "out" / "method=to_STL").glob("*.txt"))
    assert text.startswith("## Metric: iou\n\n| shots | heat |\n") and "|   2   | 0.6000 (0.1414) |" in text


FORMULA = r"G_[[0.2, 0.6]] (\forall x \in [10, 30] (u(x) - (1 \cdot x + 2) < 0))"


def test_from_completions_to_a_report(spark, tmp_path):
    rows = [
        {"id": i, "nl": "t", "sstl": FORMULA, "python": "x = 1", "completion": f"Formula:\n```latex\n{FORMULA}\n```\nPython:\n```python\nx = {i}\n```\n"}
        for i in (1, 2)
    ]
    for seed in (0, 1):
        lines(tmp_path / f"completions{seed}.jsonl", rows)
        main(["score", "--completions", str(tmp_path / f"completions{seed}.jsonl"), "--key", "id", "--task", "cot", "--dataset", "heat",
              "--shots", "2", "--seed", str(seed), "--method", "to_python", "--out", str(tmp_path / "runs")], spark)
    metrics = json.loads((tmp_path / "runs" / "heat_shots=2_seed=1" / "to_python" / "metrics.json").read_text())
    assert metrics["n_samples"] == 2 and metrics["edit distance"] == 0.5 and metrics["iou"] == 1
    main(["report", "--runs", str(tmp_path / "runs"), "--seeds", "0", "1", "--methods", "to_python", "--out", str(tmp_path / "out")], spark)
    text = "".join(p.read_text() for p in (tmp_path / "out" / "method=to_python").glob("*.txt"))
    assert "## Metric: edit distance" in text and "|   2   | 0.5000 (0.0000) |" in text


def test_two_folders_of_one_name(spark, tmp_path):
    for parent in ("a", "b"):
        lines(tmp_path / parent / "heat_train" / "d.jsonl", [{"nl": parent, "sstl": "f", "python": "x"}])
    folders = [str(tmp_path / p / "heat_train") for p in ("a", "b")]
    with pytest.raises(ValueError, match="made from two inputs"):
        main(["prepare", "--paths", *folders, "--out", str(tmp_path / "out"), "--format", "to_STL"], spark)


@pytest.mark.parametrize("options, rows", [([], 9), (["--total", "3"], 6), (["--balance", "dpo_d0_a=0.25", "dpo_d1_a=0.75", "--total", "12"], 12)])
def test_prefer_balanced(spark, tmp_path, options, rows):
    for name, n in (("dpo_d0", 5), ("dpo_d1", 4)):
        lines(tmp_path / name / "a.jsonl", [{"anchor": f"{name} {i}", "w_sstl": "good", "l_sstl": "bad"} for i in range(n)])
    folders = [str(tmp_path / f"dpo_d{i}") for i in (0, 1)]
    main(["prefer", "--paths", *folders, "--out", str(tmp_path / "out"), *options], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "preferences")).count() == rows


def test_pretraining(spark, tmp_path):
    lines(tmp_path / "web" / "part.jsonl", [{"text": f"plain text {i}"} for i in range(7)])
    main(["prepare", "--paths", str(tmp_path / "web"), "--out", str(tmp_path / "out"), "--format", "pretraining", "--max-len", "4"], spark)
    (folder,) = [p for p in (tmp_path / "out").iterdir() if p.name != "raw"]
    rows = spark.read.parquet(str(folder)).collect()
    assert len(rows) == 7 and all(len(r.input_ids) == 4 and r.input_ids[0] == 1 for r in rows)
