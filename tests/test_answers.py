import random

import pytest
import regex
from pyspark.sql import functions as F

from quillmesh.operators import answers


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    return [r.out for r in df.select("id", column.alias("out")).orderBy("id").collect()]


def test_python_blocks(spark):
    texts = [
        "x = 1\n```\nrest",
        "x = 1",
        "say\n```python\nx\n```\n```python\ny\n```",
        "a\n```python foo\nb\n  \n",
        "a\n```latex\nb\n```",
        "",
    ]
    assert one(spark, answers.code_block("t", "python"), *texts) == [
        "x = 1", "x = 1", "x", "b", "a\n```latex\nb", "",
    ]
    assert one(spark, answers.code_block("t", "python", "cot"), *texts) == [
        "[invalid]", "[invalid]", "x", "b", "[invalid]", "[invalid]",
    ]


def test_latex_blocks(spark):
    texts = ["f\n```python\nx", "```latex\nf\n```latex\ng", "```python\nx\n```\n```latex\ng\n```\n```latex\nh"]
    assert one(spark, answers.code_block("t", "latex"), *texts) == ["f", "g", ""]
    assert one(spark, answers.code_block("t", "latex", "cot"), *texts) == ["[invalid]", "g", "g"]
    with pytest.raises(ValueError):
        answers.code_block("t", "rust")


def test_programs_and_output(spark):
    texts = [
        "```python\na\n```\n```output\n1\n```\n```python\nb\n\n```",
        "none",
        "```python\na\n```python\nb",
        "```output\n 1 ``` x ```output\n2",
    ]
    assert one(spark, answers.program("t"), *texts) == ["b\n\n", "", "b\n", ""]
    assert one(spark, answers.program("t", last_only=False), *texts) == [
        "\n# ========\na\n\n# ========\nb\n\n", "", "\n# ========\na\n\n# ========\nb\n", "",
    ]
    assert one(spark, answers.program_output("t"), *texts) == ["1", "", "", "2"]


def test_boxed(spark):
    texts = [
        r"\boxed{a{b}c}% and \boxed{2}.",
        r"\boxed{never closed {x}",
        r"boxed{}boxed{{}}boxed{{{a}}b}}",
        "none",
        r"\boxed{1\boxed{2}}",
    ]
    assert one(spark, answers.boxed_answers("t"), *texts) == [
        ["a{b}c}", "2"], [], ["", "{}", "{{a}}b"], [], ["2"],
    ]


@pytest.mark.parametrize(
    "raw, normal",
    [
        (r" \dfrac12. ", r"\frac{1}{2}"),
        (r"\frac1{72}", r"\frac{1}{72}"),
        (r"\frac{72}1", r"\frac{72}1"),
        (r"\frac1\frac23", r"\frac1\frac23"),
        (r"\frac12+\frac34", r"\frac{1}{2}+\frac{3}{4}"),
        (r"\frac", r"\frac"),
        ("3/4", r"\frac{3}{4}"),
        ("-3/4", r"\frac{-3}{4}"),
        ("03/4", "03/4"),
        ("a/b", "a/b"),
        ("1/2/3", "1/2/3"),
        (r"\sqrt{3}/x", r"\sqrt{3}/x"),
        (r"\sqrt3/2", r"\frac{\sqrt{3}}{2}"),
        (r"2\sqrt 5", r"2\sqrt{5}"),
        (r"\tan x", r"\tan{x}"),
        (r"\text{yes}", "yes"),
        (r"5 \text{ miles}", "5"),
        (r"\text{a}\text{b}", r"a}\text{b"),
        (r"90^{\circ}", "90"),
        (r"45^\circ", "45"),
        ("7 {cm}^2", "7"),
        ("5 p.m.", "5p.m"),
        ("12 t", "12"),
        (r"\$4.50", "4.50"),
        (r"50\%", "50%"),
        ("x = .5", "x=0.5"),
        (".5", "0.5"),
        ("{.5}", "{0.5}"),
        (r"2\cdot3", "23"),
        ("inf", r"\infty"),
        ("(-infinity, inf)", r"(-\infty,inf)"),
        (r"\mathbf{v}", "{v}"),
        (r"\mbox{about }3", "3"),
        ("3+4j", "3+4i"),
        ("ij", "ij"),
        ("3.000", "3"),
        ("3.00cd", "3cd"),
        ("10.05", "10.05"),
        (r"x\in[0,1]", "[0,1]"),
        (r"\left(1,\right)", "(1,)"),
        ("a\nb", "ab"),
        ("12,", "12"),
        ("7\\", "7"),
        ("", ""),
        ("...", ""),
    ],
)
def test_normal_forms(spark, raw, normal):
    assert one(spark, answers.normalized("t"), raw) == [normal]


def test_answer_cascade(spark):
    texts = [
        r"So the final answer is $\frac12$. I hope it is correct.",
        r"$. I hope final answer is $7 cm",
        r"we get \boxed{1} then \boxed{2/3}",
        r"boxed but not really",
        "The answer is: 42.\nBecause",
        "```output\n3.0\n```",
        "first 1,000 then -2.5.",
        "no numbers",
        "",
    ]
    assert one(spark, answers.last_answer("t"), *texts) == [
        r"\frac{1}{2}", "7cm", r"\frac{2}{3}", "", "42", "3", "-2.5", "", "",
    ]


def test_answer_lists(spark):
    rows = [
        ("roots separated by commas", r"\boxed{1, 2,3}", ["1", "2", "3"]),
        ("roots separated by commas", r"\boxed{(1,2)}", ["(1,2)"]),
        ("roots", r"\boxed{1,2}", ["1,2"]),
        ("roots", r"\boxed{1 \text{ and } 2}", ["1", "2"]),
        ("roots", r"\boxed{1}\boxed{2} Problem: \boxed{3}", ["1", "2"]),
        ("roots", "nothing", []),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "id long, q string, t string")
    got = answers.split_answers(df, "q", "t", few_shot=True).orderBy("id").collect()
    assert [r.answers for r in got] == [r[2] for r in rows]


@pytest.mark.parametrize(
    "task, text, found",
    [
        ("gsm", "1 and 2.5 Q: 9", ["2.5"]),
        ("gsm", "none", ["[invalid]"]),
        ("gaokao_cloze", "所以答案是 $3$ \n问题 x", ["3"]),
        ("gaokao_cloze", "没有", ["placeholder"]),
        ("gaokao_qa", "答案是 A \nB", ["A"]),
        ("sat", "The final answer is (B).", ["B"]),
        ("mmlu", "Problem: the final answer is A", ["placeholder"]),
        ("ocw", "final answer is 5 m. I hope it is correct.", ["5 m"]),
        ("ocw", "final answer is 5\n. I hope it is correct.", ["[invalid]"]),
        ("minif2f", " proof Informal: no", ["proof"]),
        ("cmath", "答案是：12。", ["12"]),
        ("cmath", "答案是：无。", ["[invalid]"]),
        ("cmath", "is 12 so", ["12"]),
        ("math", r"\boxed{1} Problem: \boxed{2}", ["1", "2"]),
        ("last_answer", r"\boxed{1}\boxed{2}", ["2"]),
        ("pde", " code\n", ["code"]),
    ],
)
def test_tasks(spark, task, text, found):
    df = spark.createDataFrame([(task, "?", text)], "task string, q string, t string")
    assert answers.extract_by_task(df, "task", "q", "t").first().answers == found


def test_unknown_task_is_an_error(spark):
    df = spark.createDataFrame([("x", "?", "t")], "task string, q string, t string")
    with pytest.raises(Exception, match="unknown task"):
        answers.extract_by_task(df, "task", "q", "t").collect()


def test_grade(spark):
    preds = spark.createDataFrame(
        [(1, "gsm", "?", "is 100"), (2, "gsm", "?", "none"), (1, "sat", "?", "the final answer is a"), (9, "sat", "?", "x")],
        "id long, task string, question string, completion string",
    )
    wanted = spark.createDataFrame([(1, "100.05"), (2, "3")], "id long, answer string")
    got = {r.task: r for r in answers.grade(preds, wanted, "id").collect()}
    assert (got["gsm"].accuracy, got["gsm"].invalid_rate, got["gsm"].n) == (0.5, 0.5, 2)
    assert (got["sat"].accuracy, got["sat"].n) == (0.0, 1)


def test_whole_texts_are_read(spark):
    long_text = "word " * 50_000 + r"\boxed{" + "{}" * 2000 + "7}"
    assert one(spark, F.element_at(answers.boxed_answers("t"), 1), long_text) == ["{}" * 2000 + "7"]


def test_random_boxes_against_a_recursive_pattern(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["boxed{", "{", "}", "}", "%", "a", "b\n"], k=rng.randrange(25))) for _ in range(400)]
    balanced = regex.compile(r"((?:[^{}]|\{(?1)\})*)\}(%?)")

    def expected(text):
        found = (balanced.match(piece) for piece in text.split("boxed{")[1:])
        return [m[1] + "}" * len(m[2]) for m in found if m]

    assert one(spark, answers.boxed_answers("t"), *texts) == [expected(t) for t in texts]


def test_random_fences_line_by_line(spark):
    rng = random.Random(9)
    kinds = ["```python", "```latex", "```", "```output", "x", "y z", ""]
    texts = ["\n".join(rng.choices(kinds, k=rng.randrange(9))) for _ in range(300)]

    def expected(text, opening, inner):
        """Split at the opening lines; the block is the first part that a fence ends, or the last."""
        parts, open_ = [], False
        for line in text.split("\n"):
            if line.startswith(opening):
                parts, open_ = [], True
            elif open_ and line.startswith("```") and not line.startswith(inner):
                return "\n".join(parts).strip()
            elif open_:
                parts.append(line)
        return "\n".join(parts).strip() if open_ else "[invalid]"

    python = [expected(t, "```python", ("```latex",)) for t in texts]
    latex = [expected(t, "```latex", ("~",)) for t in texts]
    assert one(spark, answers.code_block("t", "python", "cot"), *texts) == python
    assert one(spark, answers.code_block("t", "latex", "cot"), *texts) == latex
