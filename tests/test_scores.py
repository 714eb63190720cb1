import math
import statistics

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import scores


def test_perplexity_states(spark):
    df = spark.createDataFrame([(1, [-1.0, -3.0]), (2, None), (3, [])], "id long, logits array<double>")
    got = {r.id: r for r in scores.perplexity(df, "logits").collect()}
    assert math.isclose(got[1].perplexity, math.exp(2)) and got[1].perplexity_status == "ok"
    assert (got[2].perplexity, got[2].perplexity_status) == (None, "failed")
    assert (got[3].perplexity, got[3].perplexity_status) == (None, "error")


def test_nested_logprobs(spark):
    schema = "s array<map<long,struct<token:string,logprob:double>>>"
    df = spark.createDataFrame([([{7: ("a", -1.0)}, {8: ("b", -2.0), 9: ("c", -3.0)}],)], schema)
    assert sorted(df.select(scores.flat_logprobs("s").alias("l")).first().l) == [-3.0, -2.0, -1.0]


def test_correctness(spark):
    rows = [
        (0, 100.0, 100.09, None, None, True),
        (1, 100.0, 100.2, None, None, False),
        (2, 0.0, 0.0, None, None, True),
        (3, 1e-9, 0.0, None, None, False),
        (4, None, None, "failed", "timeout", True),
        (5, 3.0, None, None, "timeout", True),
        (6, None, None, "failed", "failed", True),
        (7, None, 3.0, "timeout", None, False),
        (8, -100.0, -100.05, None, None, True),
    ]
    df = spark.createDataFrame(rows, "id long, p double, a double, ps string, as_ string, want boolean")
    got = scores.is_correct(df, "p", "a", "ps", "as_").collect()
    assert [r.correct for r in got] == [r.want for r in got]


def test_label_rates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (-1.0,), (-100.0,)], "r double")
    row = scores.label_rates(df, "r").first()
    assert (row.positive_rate, row.negative_rate, row.failed_rate, row.n_samples) == (0.5, 0.25, 0.25, 4)
    broken = df.union(spark.createDataFrame([(0.0,), (None,)], "r double"))
    with pytest.raises(Exception, match="not a label"):
        scores.label_rates(broken, "r").collect()
    assert math.isclose(scores.label_rates(broken, "r", strict=False).first().invalid_rate, 2 / 6)


def test_backfill_keeps_what_is_there(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5.0, 1.0), (3, 6.0, None), (4, None, None)], "id long, robustness double, time double")
    results = spark.createDataFrame([(1, 7.0, 9.0), (2, 8.0, 9.0), (3, 8.0, 9.0)], "id long, robustness double, time double")
    got = {r.id: (r.robustness, r.time) for r in scores.backfill_labels(df, results, "id").collect()}
    assert got == {1: (7.0, 9.0), 2: (5.0, 1.0), 3: (6.0, None), 4: (None, None)}
    assert scores.backfill_labels(df.drop("time"), results, "id").filter("id = 1").first().time == 9.0


def test_outcomes(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, False), (2, 2.0, 20.0, False), (3, None, 1.0, True)], "id long, v double, s double, broken boolean")
    short = scores.with_outcome(df, "v", "s", 15.0, F.col("broken"), timeout_value=0.0)
    assert [(r.outcome, r.label) for r in short.collect()] == [("ok", 2.0), ("timeout", 0.0), ("failed", -100.0)]
    named = scores.with_outcome(df, "v", "s", 15.0).filter("id = 2").first()
    assert (named.outcome, named.label) == ("timeout", None)
    assert {r.outcome: r.n for r in scores.outcome_counts(short).collect()} == {"ok": 1, "timeout": 1, "failed": 1}


def runs(spark, rows):
    return spark.createDataFrame([("m", "iou", *r) for r in rows], "method string, metric string, dataset string, shots int, value double")


def test_report(spark):
    rows = [("heat", 0, 0.5), ("heat", 0, 0.7), ("wave", 0, 0.1), ("wave", 0, 0.2), ("heat", 2, 0.25), ("wave", 2, 1.0), ("none", 1, None)]
    report = {r.shots: r for r in scores.metric_report(runs(spark, rows)).collect()}
    assert sorted(report) == [0, 1, 2] and not hasattr(report[0], "none")
    assert report[0].heat == f"0.6000 ({statistics.stdev([0.5, 0.7]):.4f})"
    assert report[2].heat == "0.2500 (nan)" and report[1].heat == "n/a"
    wide = scores.metric_report(runs(spark, rows), ["heat", "wave"], max_shots=3)
    assert wide.filter("shots = 3").first().wave == "n/a"
    text = scores.report_lines(scores.metric_cells(runs(spark, rows[:4]))).first().text
    assert text == (
        "## Metric: iou\n\n| shots | heat | wave |\n|-------|------------|------------|\n"
        f"|   0   | {report[0].heat} | {report[0].wave} |\n\n\n"
    )


def test_unequal_numbers_of_scores(spark):
    rows = [("heat", 0, 0.5), ("heat", 0, 0.7), ("wave", 0, 0.1)]
    with pytest.raises(Exception, match="unequal numbers of scores"):
        scores.metric_report(runs(spark, rows)).collect()
    assert scores.metric_report(runs(spark, rows), strict=False).count() == 1


def test_nothing_is_left_out_of_a_report(spark):
    rows = [("heat", s, float(s)) for s in range(6)]
    assert {r.shots for r in scores.metric_report(runs(spark, rows)).collect()} == set(range(6))
    with pytest.raises(Exception, match="unexpected shots: 4"):
        scores.metric_cells(runs(spark, rows[:5]), max_shots=3).collect()
    with pytest.raises(Exception, match="unexpected shots: NULL"):
        scores.metric_cells(runs(spark, [("heat", None, 1.0)])).collect()
    with pytest.raises(Exception, match="not listed: heat"):
        scores.metric_report(runs(spark, rows), ["wave"]).collect()


def test_marks_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, 1.0), (1.0, nan), (nan, nan), (inf, 1.0), (1.0, -inf), (inf, inf), (-inf, inf), (0.0, 0.0), (1.0, 1.0005), (1.0, 1.01)]
    df = spark.createDataFrame(rows, "p double, a double")
    got = [r.correct for r in scores.is_correct(df, "p", "a").collect()]
    assert got == [False, False, False, False, False, True, False, True, True, False]


def test_repeated_results_are_an_error(spark):
    df = spark.createDataFrame([(1, None)], "id long, robustness double")
    results = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0)], "id long, robustness double, time double")
    with pytest.raises(Exception, match="results repeats a key: 1"):
        scores.backfill_labels(df, results, "id").collect()


def test_flat_metrics(spark):
    df = spark.createDataFrame([("p", 2, 1.0, None), (None, None, 3.0, 4.0)], "few_shot_prompt string, few_shot_number int, iou double, n double")
    got = {r.key: r.value for r in scores.flatten_metrics(df, ["iou", "n"]).collect()}
    assert got == {"validation_p_2shots/iou": 1.0, "validation__Noneshots/iou": 3.0, "validation__Noneshots/n": 4.0}


def test_last_score_of_equal_completions(spark):
    df = spark.createDataFrame(
        [(1, "p", ["a", "b", "a"], [1.0, 2.0, 3.0]), (2, "p", ["b"], [9.0]), (3, "q", ["a"], [4.0])],
        "id long, prompt string, completions array<string>, scores array<double>",
    )
    table = scores.score_table(df, "id")
    assert {(r.prompt, r.completion): r.score for r in table.collect()} == {("p", "a"): 3.0, ("p", "b"): 9.0, ("q", "a"): 4.0}
    maps = scores.score_maps(table).collect()
    assert {r.prompt: r.scores for r in maps} == {"p": {"a": 3.0, "b": 9.0}, "q": {"a": 4.0}}
    assert len(scores.score_maps(table, entries=1).filter("prompt = 'p'").collect()) <= 2


def test_next_token(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0, 900.0],)], "logits array<float>")
    row = scores.next_token(df, "logits", [2, 1, 0]).first()
    assert row.prediction == 0 and math.isclose(sum(row.probs), 1) and row.probs[0] == row.probs[1]
    assert scores.next_token(df, "logits", [0, 1], ["x", "y"]).first().prediction == "y"
    assert scores.next_token(df, "logits").first().prediction == 3


def test_text_is_cut_at_the_first_stop_word(spark):
    df = spark.createDataFrame([("ab\n### Instruction: c ### Instruction:",), ("### Instruction:x",), ("clean",)], "t string")
    got = scores.cut_at_stop(df, "t", end="\n###").collect()
    assert [(r.t, r.finished) for r in got] == [("ab", True), ("", False), ("clean", False)]


def test_logprobs_stop_where_a_stop_word_begins(spark):
    steps = [("a", -1.0), ("##", -2.0), ("# In", -3.0), ("struction:", -4.0), ("b", -5.0)]
    df = spark.createDataFrame([(1, steps), (2, steps[:2]), (3, [])], "id long, s array<struct<token:string,logprob:double>>")
    got = {r.id: r.logprobs for r in scores.cut_logprobs(df, "s").collect()}
    assert got == {1: [-1.0], 2: [-1.0, -2.0], 3: []}
    ended = scores.cut_logprobs(df, "s", stops=("zz",), end="struction")
    assert ended.filter("id = 1").first().logprobs == [-1.0, -2.0, -3.0]


def test_edit_distance_of_long_texts(spark):
    df = spark.createDataFrame([("kitten" * 100, "sitting" * 100), ("é", "e")], "a string, b string")
    assert [r.edit_distance for r in scores.edit_distance(df, "a", "b").collect()] == [300, 1]
