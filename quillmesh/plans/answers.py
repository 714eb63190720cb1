"""Queries over completions: code blocks, answers, grading, chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import answers, chat
from quillmesh.plans import sql as q
from quillmesh.plans.catalog import query, table
from quillmesh.plans.tokens import PAIRS_SQL, turn_pairs


def text_column(parts: str, **columns: Column) -> Column:
    """`{name}` in `parts` replaced by a column, the rest taken as text."""
    pieces, rest = [], parts
    while "{" in rest and "}" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), columns[name]]
    return F.concat(*pieces, F.lit(rest))


def text_sql(parts: str, **columns: str) -> str:
    pieces, rest = [], parts
    while "{" in rest and "}" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [q.text(head), f"({columns[name]})"]
    return " || ".join([*pieces, q.text(rest)])


def pick_column(place: Column, options: list[str], **columns: Column) -> Column:
    chosen = F.lit(None)
    for i, option in enumerate(options):
        chosen = F.when(place == i, text_column(option, **columns)).otherwise(chosen)
    return chosen


def pick_sql(place: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {option}" for i, option in enumerate(options))
    return f"CASE {place} {cases} END"


# --- Code blocks -----------------------------------------------------------------------

# Completions, and for (python, latex, python by cot, latex by cot) what is taken out.
BLOCKS = [
    ("{t}\n```\nmore", ("{t}", "{t}", "[invalid]", "[invalid]")),
    ("{t}", ("{t}", "{t}", "[invalid]", "[invalid]")),
    ("say\n```python\n{t}\n```\n```python\nlate\n```", ("{t}", "say", "{t}", "[invalid]")),
    ("```latex\n{r}\n```\n```python\n{t}\n```", ("```latex\n{r}", "{r}", "{t}", "{r}")),
    ("```python\n```latex\n{r}\n```\n{t}", ("```latex\n{r}", "", "```latex\n{r}", "{r}")),
    ("a\n```latex x\n{t}\n```python\n{r}", ("{r}", "{t}", "{r}", "{t}")),
]


def fenced_turns(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn(
        "place", (F.col("conv_id") * 3 + F.col("turn")) % len(BLOCKS)
    )
    completion = pick_column(
        F.col("place"), [b for b, _ in BLOCKS], t=F.col("text"), r=F.col("role")
    )
    return turns.withColumn("completion", completion)


def _block_sql(i: int) -> str:
    return pick_sql(
        "place",
        [
            text_sql(found[i], t=q.strip("text"), r="role")
            for _, found in BLOCKS
        ],
    )


@query(
    "extract_code",
    f"""SELECT conv_id, turn, {_block_sql(0)} AS python, {_block_sql(1)} AS latex,
               {_block_sql(2)} AS cot_python, {_block_sql(3)} AS cot_latex
        FROM (SELECT *, (conv_id * 3 + turn) % {len(BLOCKS)} AS place FROM conversations)""",
)
def extract_code(spark, sf_dir):
    turns = fenced_turns(spark, sf_dir)
    direct = answers.extract_code(turns, "completion", "python", name="python")
    direct = answers.extract_code(direct, "completion", "latex", name="latex")
    both = answers.extract_code_and_formula(direct, "completion")
    return both.select(
        "conv_id", "turn", "python", "latex",
        F.col("predicted_python").alias("cot_python"), F.col("predicted_sstl").alias("cot_latex"),
    )


PROGRAMS = [
    ("{t}", ("", "", "")),
    ("```python\n{t}\n```\n```output\n {r} \n```", ("{t}\n", "\n# ========\n{t}\n", "{r}")),
    ("```python\na\n```\nx\n```python\n{t}", ("{t}\n", "\n# ========\na\n\n# ========\n{t}\n", "")),
    ("```output\nold```\n```python\nb\n```python\n{r}\n```\n```output\n{r}", ("{r}\n", "\n# ========\nb\n\n# ========\n{r}\n", "{r}")),
]


@query(
    "extract_program",
    f"""SELECT conv_id, turn,
          {', '.join(f"{pick_sql('place', [text_sql(f[i], t='text', r='role') for _, f in PROGRAMS])} AS {n}"
                     for i, n in enumerate(('program', 'programs', 'output')))}
        FROM (SELECT *, (conv_id + turn) % {len(PROGRAMS)} AS place FROM conversations)""",
)
def extract_program(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    completion = pick_column(
        (F.col("conv_id") + F.col("turn")) % len(PROGRAMS), [p for p, _ in PROGRAMS],
        t=F.col("text"), r=F.col("role"),
    )
    return turns.withColumn("completion", completion).select(
        "conv_id", "turn",
        answers.program("completion").alias("program"),
        answers.program("completion", last_only=False).alias("programs"),
        answers.program_output("completion").alias("output"),
    )


# --- Answers ---------------------------------------------------------------------------

_BOXED_SHAPE = "{t} \\boxed<{id}> then \\boxed<a<{lang}>b>%, \\boxed<open <> and \\boxed<{t}>"


def boxed_documents(spark, sf_dir) -> DataFrame:
    """Documents with four boxes: plain, nested before a percent sign, never closed, whole text."""
    # Angle brackets stand for the braces while the text is put together.
    marked = F.translate("text", "<>{}", "[]()")
    shape = text_column(_BOXED_SHAPE, t=marked, id=F.col("doc_id").cast("string"), lang=F.col("lang"))
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", "lang", F.translate(shape, "<>", "{}").alias("text"))


@query(
    "extract_boxed",
    """SELECT doc_id, 0::BIGINT AS answer_index, doc_id::VARCHAR AS answer FROM documents
       UNION ALL SELECT doc_id, 1, 'a{' || lang || '}b}' FROM documents
       UNION ALL SELECT doc_id, 2, translate(text, '<>{}', '[]()') FROM documents""",
)
def extract_boxed(spark, sf_dir):
    boxed = answers.extract_boxed(boxed_documents(spark, sf_dir), "text")
    return boxed.select("doc_id", F.col("answer_index").cast("bigint"), "answer")


# Answer texts and their normal form, with < > for braces; {a} and {b} are numbers from 1.
SHAPES = [
    ("\\dfrac<{a}><{b}>", "\\frac<{a}><{b}>"),
    ("{a}/{b}.", "\\frac<{a}><{b}>"),
    ("\\text<{a}>", "{a}"),
    ("$ {a} \\text< miles>$", "{a}\\text<miles>"),
    ("{a}.00 \\text< cm>", "{a}"),
    ("{a}^<\\circ>", "{a}"),
    ("\\sqrt{a}+\\sqrt {b}", "\\sqrt<{a}>+\\sqrt<{b}>"),
    ("\\left( .{a}, {b}j \\right)", "(0.{a},{b}i)"),
    ("{a}\\% \\!of inf", "{a}%of\\infty"),
    ("x\\in[{a}.0,infinity)", "[{a},\\infty)"),
    ("\\mbox<about> {a}<cm>^2\\\\", "{a}"),
    ("\\tan{a}\\cdot\\mathrm<k>,", "\\tan<{a}><k>"),
    ("\\tfrac1x\n+ {b} t", "\\frac<1><x>+{b}"),
    ("-\\sqrt<{a}>/{b}", "\\frac<-\\sqrt<{a}>><{b}>"),
]


def latex_answers(spark, sf_dir) -> DataFrame:
    place = (F.col("l_orderkey") + F.col("l_linenumber")) % len(SHAPES)
    shape = pick_column(
        place, [s for s, _ in SHAPES],
        a=(F.col("l_partkey") % 90 + 1).cast("string"), b=(F.col("l_suppkey") % 70 + 1).cast("string"),
    )
    return table(spark, sf_dir, "lineitem", "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.translate(shape, "<>", "{}").alias("raw")
    )


def _shape_sql() -> str:
    numbers = {"a": "(l_partkey % 90 + 1)::VARCHAR", "b": "(l_suppkey % 70 + 1)::VARCHAR"}
    options = [text_sql(form, **numbers) for _, form in SHAPES]
    return f"translate({pick_sql(f'(l_orderkey + l_linenumber) % {len(SHAPES)}', options)}, '<>', '{{}}')"


@query(
    "normalize_answer",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_shape_sql()} AS normalized FROM lineitem",
)
def normalize_answer(spark, sf_dir):
    return answers.normalize_answer(latex_answers(spark, sf_dir), "raw").drop("raw")


# Completions by the marker they carry, with the answer that each must give.
MARKED = [
    ("{t}. The final answer is ${id}.0$. I hope it is right. {t}", "{id}"),
    ("{t} so \\boxed<{id}> and \\boxed<\\dfrac<{id}><7>>.", "\\frac<{id}><7>"),
    ("{t}. So the answer is the answer is : {id} \\$.\nThanks", "{id}"),
    ("{t}\n```output\n{id}.00\n```\nDone 5", "{id}"),
    ("A. 1,{pad} or {pad}2{id}", None),
]


def marked_documents(spark, sf_dir) -> DataFrame:
    clean = F.regexp_replace(F.translate("text", "<>{}$", "[]()S"), "boxed|he answer is|```", "")
    numbered = F.col("doc_id").cast("string")
    completion = pick_column(
        F.col("doc_id") % 5,
        [s for s, _ in MARKED],
        t=clean, id=numbered, pad=F.lpad(numbered, 7, "0"),
    )
    return table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", "lang", F.translate(completion, "<>", "{}").alias("completion")
    )


@query(
    "extract_answer",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN '\\frac{' || doc_id || '}{7}'
                WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN doc_id::VARCHAR
                ELSE lpad(doc_id::VARCHAR, 7, '0') || '2' || doc_id END AS answer FROM documents""",
)
def extract_answer(spark, sf_dir):
    return answers.extract_answer(marked_documents(spark, sf_dir), "completion").select("doc_id", "answer")


@query(
    "extract_last_number",
    r"""WITH found AS (
          SELECT doc_id, coalesce(regexp_extract_all(replace(text, ',', ''), '-?[0-9]*[.]?[0-9]+')[-1], '') AS a FROM documents)
        SELECT doc_id, CASE WHEN starts_with(a, '.') THEN '0' ELSE '' END || regexp_replace(a, '([0-9]+)[.]0+$', '\1') AS answer
        FROM found""",
)
def extract_last_number(spark, sf_dir):
    """The documents as they are: none has a marker, so the last number is the answer."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    return answers.extract_answer(docs, "text").select("doc_id", "answer")


# Questions and completions whose answers are lists.
LISTS = [
    ("Roots separated by commas?", "{t} \\boxed<{id}, 2 , 3> Problem: \\boxed<9>", "{id}|2|3", "{id}|2|3|9"),
    ("Roots separated by commas?", "{t} \\boxed<({id},2)>", "({id},2)", "({id},2)"),
    ("Roots?", "{t} \\boxed<{id} \\text<and> 5>", "{id}|5", "{id}|5"),
    ("Roots?", "{t} \\boxed<1> \\boxed<{id}>", "1|{id}", "1|{id}"),
]


@query(
    "split_answers",
    f"""SELECT doc_id, {pick_sql('doc_id % 4', [text_sql(f, id='doc_id::VARCHAR') for _, _, f, _ in LISTS])} AS few_shot,
               {pick_sql('doc_id % 4', [text_sql(f, id='doc_id::VARCHAR') for _, _, _, f in LISTS])} AS whole
        FROM documents""",
)
def split_answers(spark, sf_dir):
    clean = F.regexp_replace(F.translate("text", "<>{}$", "[]()S"), "boxed|Problem:", "")
    place, numbered = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        pick_column(place, [s[0] for s in LISTS]).alias("question"),
        F.translate(pick_column(place, [s[1] for s in LISTS], t=clean, id=numbered), "<>", "{}").alias("completion"),
    )
    cut = answers.split_answers(rows, "question", "completion", few_shot=True, name="few_shot")
    both = answers.split_answers(cut, "question", "completion", name="whole")
    return both.select(
        "doc_id", F.array_join("few_shot", "|").alias("few_shot"), F.array_join("whole", "|").alias("whole")
    )


# Per task two completions and their answers; {t} is text without digits, {n} a number.
TASK_CASES = [
    ("gsm", "{t} {n}.5 is -{n}. Q: 77", "-{n}."),
    ("gsm", "{t}", "[invalid]"),
    ("gaokao_cloze", "{t}答案是 ${n}$\n问题 答案是 3", "{n}"),
    ("gaokao_cloze", "{t} {n}", "placeholder"),
    ("gaokao_qa", "{t}答案是 A{n} \nB", "A{n}"),
    ("gaokao_qa", "问题 {t}答案是", "placeholder"),
    ("sat", "{t}The Final answer is (C). Problem: the final answer is (D)", "C"),
    ("sat", "the final answer is e {n}", "placeholder"),
    ("mmlu", "THE FINAL ANSWER IS b{n}", "B"),
    ("ocw", "{t} final answer is {n} m/s. I hope it is correct. I hope it is correct.", "{n} m/s. I hope it is correct"),
    ("ocw", "final answer is {n}", "[invalid]"),
    ("minif2f", " {t}{n} Informal: more", "{t}{n}"),
    ("cmath", "{t}答案是：{n}个。\n9 问题：答案是1", "{n}"),
    ("cmath", "答案是无 {t}", "[invalid]"),
    ("cmath", "{t} is {n}", "{n}"),
    ("math", "{t} \\boxed<{n}> \\boxed<x>", "{n}|x"),
    ("math_few_shot", "\\boxed<{n}> Problem: {t} \\boxed<x>", "{n}"),
    ("last_answer", "\\boxed<{n}> {t} \\boxed<x>", "x"),
    ("pde", "\n{t} {n}\n", "{t} {n}"),
]


def task_completions(spark, sf_dir) -> DataFrame:
    """Completions of every task over the answered turns of the conversations."""
    plain = F.concat(F.lit("w"), F.regexp_replace("text", r"[0-9<>{}$`\\]|boxed|[Ff]inal|nswer", ""), F.lit("w"))
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        plain.alias("plain"),
        (F.col("conv_id") * 10 + F.col("turn") + 11).cast("string").alias("n"),
        ((F.col("conv_id") * 7 + F.col("turn")) % len(TASK_CASES)).alias("place"),
    )
    return turns.withColumns(
        {
            "task": F.get(F.array(*[F.lit(t) for t, _, _ in TASK_CASES]), F.col("place").cast("int")),
            "completion": F.translate(
                pick_column(F.col("place"), [c for _, c, _ in TASK_CASES], t=F.col("plain"), n=F.col("n")),
                "<>", "{}",
            ),
            "question": F.lit("?"),
        }
    )


PLAIN_SQL = r"'w' || regexp_replace(text, '[0-9<>{}$`\\]|boxed|[Ff]inal|nswer', '', 'g') || 'w'"
TASK_SQL = f"""
cases AS (SELECT *, (conv_id * 7 + turn) % {len(TASK_CASES)} AS place, (conv_id * 10 + turn + 11)::VARCHAR AS n,
                 {PLAIN_SQL} AS plain FROM conversations),
expected AS (
  SELECT conv_id, turn, place, n, {pick_sql('place', [q.text(t) for t, _, _ in TASK_CASES])} AS task,
         {pick_sql('place', [text_sql(a, t='plain', n='n') for _, _, a in TASK_CASES])} AS answers FROM cases)"""


@query("extract_by_task", f"WITH {TASK_SQL} SELECT conv_id, turn, task, answers FROM expected")
def extract_by_task(spark, sf_dir):
    found = answers.extract_by_task(task_completions(spark, sf_dir), "task", "question", "completion")
    return found.select("conv_id", "turn", "task", F.array_join("answers", "|").alias("answers"))


@query(
    "grade",
    f"""WITH {TASK_SQL}, wanted AS (
          SELECT conv_id, turn, task, string_split(answers, '|')[-1] AS pred, n || CASE WHEN place % 2 = 0 THEN '.0001' ELSE '' END AS answer FROM expected),
        marked AS (SELECT *, coalesce(try_cast(pred AS DOUBLE) IS NOT NULL AND abs(try_cast(pred AS DOUBLE) - answer::DOUBLE)
                             <= 0.001 * greatest(abs(try_cast(pred AS DOUBLE)), answer::DOUBLE), false) OR pred = answer AS ok FROM wanted)
        SELECT task, round(avg(ok::INT), 9) AS accuracy,
               round(avg((pred IN ('[invalid]', 'placeholder', ''))::INT), 9) AS invalid_rate, count(*) AS n
        FROM marked GROUP BY task""",
)
def grade(spark, sf_dir):
    preds = task_completions(spark, sf_dir).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    wanted = preds.select(
        "id", F.concat("n", F.when(F.col("place") % 2 == 0, ".0001").otherwise("")).alias("answer")
    )
    graded = answers.grade(preds, wanted, "id")
    return graded.select(
        "task", F.round("accuracy", 9).alias("accuracy"), F.round("invalid_rate", 9).alias("invalid_rate"), "n"
    )


# --- Chat records ----------------------------------------------------------------------


def _flat(df: DataFrame, *kept: str) -> DataFrame:
    """Records with user and assistant text apart and the answers joined."""
    content = lambda i: F.get("messages", F.lit(i))["content"]
    return df.select(
        "dataset", F.col("id").cast("string").alias("id"), content(0).alias("user"),
        content(1).alias("assistant"), F.array_join("answer", "|").alias("answer"), *kept,
    )


_ITEM = {"t": "text", "id": "item_id::VARCHAR", "s": q.strip("text")}


def _record(dataset: str, user: str, assistant: str, answer: str) -> str:
    return (
        f"SELECT {q.text(dataset)} AS dataset, item_id::VARCHAR AS id, {text_sql(user, **_ITEM)} AS user, "
        f"{text_sql(assistant, **_ITEM)} AS assistant, {text_sql(answer, **_ITEM)} AS answer FROM benchmark"
    )


_LINES = r"regexp_replace(text, '[.] ([A-Z])', '.' || chr(10) || '\1', 'g')"


@query(
    "to_chat",
    " UNION ALL ".join(
        [
            f"""SELECT 'gsm8k-cot' AS dataset, item_id::VARCHAR AS id, text AS user,
                text || ' 6' || chr(10) || 'So the answer is $\\boxed{{1,' || item_id || '}}$.' AS assistant,
                ' 1' || item_id || ' ' AS answer FROM benchmark""",
            f"""SELECT 'math-cot', item_id::VARCHAR, 'Which? ' || text,
                {_LINES.replace('text', "(text || ' So \\boxed{' || item_id || '}')")}, item_id::VARCHAR FROM benchmark""",
            _record("math_sat", "{s}" + chat.CHOICE + "(A) {id} (B) two (D) x C)y", "B", "B"),
            _record("OCWCourses", "{s}", "{s}", "{id}"),
            _record("MMLU-STEM", "{s}" + chat.CHOICE + "(A) {id}, (B) two, (C) 3, (D) 4,  5", "C", "C"),
            _record("mgsm", "{t}", "", "1{id}"),
            _record("cmath", "{s}", "", "1{id}"),
            _record("agieval-gaokao-math-cloze", "{s}", "", "{id}|\\frac(1)(2)").replace("\\frac(1)(2)", "\\frac{1}{2}"),
            _record("agieval-gaokao-mathqa", "{s}\n['A: {id}', \"B: it's\", 'C: \\\\pi']", "", "A"),
            _record("agieval-gaokao-mathqa", "{s}\n" + chat.CHOICE_ZH + "(A) {id} (B) it's (C)\\pi", "", "A"),
            _record("minif2f-isabelle", "(*### Problem\n\n{s}\n\n### Solution\n\n{s} *)\n\nFormal:\n{id}", "", "placeholder"),
        ]
    ),
)
def to_chat(spark, sf_dir):
    id_, text = F.col("item_id").cast("string"), F.col("text")
    items = table(spark, sf_dir, "benchmark").withColumn("id", F.col("item_id"))
    padded = F.concat(F.lit(" "), text, F.lit("\n"))
    options = F.array(F.concat(F.lit("(A) "), id_), F.lit(" (B) it's"), F.lit("(C)\\pi"))
    sources = {
        "gsm8k": dict(
            question=text, cot=F.concat(text, F.lit("<<3*2=6>> 6")),
            answer=F.concat(F.lit(" 1,"), id_, F.lit(" ")),
        ),
        "math": dict(
            problem=F.concat(F.lit("Which? "), text),
            solution=F.concat(text, F.lit(" So \\boxed{"), id_, F.lit("}")),
            level=F.lit("1"), type=F.lit("a"), category=F.lit("b"),
        ),
        "sat": dict(
            question=padded, options=F.concat(F.lit("A) "), id_, F.lit(" B) two D) x C)y ")), Answer=F.lit("B")
        ),
        "ocw": dict(problem=padded, solution=padded, answer=id_),
        "mmlu": dict(
            question=padded, options=F.array(id_, *[F.lit(o) for o in (" two", "3 ", "4", " 5")]), answer=F.lit("C")
        ),
        "cmath": dict(
            question=padded, golden=F.concat(F.lit(" 1,"), id_), grade=F.lit(1), reasoning_step=F.lit(2)
        ),
        "gaokao_cloze": dict(question=padded, answer=F.concat(id_, F.lit(";\\frac12 "))),
        "gaokao_qa": dict(question=padded, options=options, label=F.lit("A")),
        "gaokao_qa_few_shot": dict(
            question=F.concat(padded, F.lit("\\\\")), options=options, label=F.lit("A")
        ),
        "minif2f": dict(informal_statement=padded, informal_proof=padded, formal_statement=id_),
    }
    records = []
    for benchmark, columns in sources.items():
        records.append(_flat(chat.to_chat(items.withColumns(columns), benchmark)))
    mgsm = items.select(
        F.lit("mgsm").alias("dataset"), "id", chat.messages(text, F.lit("")).alias("messages"),
        F.concat(F.lit("1,"), id_).alias("answer"),
    )
    records.append(
        _flat(chat.to_chat(mgsm, "mgsm").withColumn("answer", F.array("answer")))
    )
    result = records[0]
    for more in records[1:]:
        result = result.unionByName(more)
    return result


@query(
    "chat_from_turns",
    f"""WITH {PAIRS_SQL} SELECT 'turns' AS dataset, row_id AS id, {q.strip('nl')} AS user,
        {q.strip('python')} AS assistant, {q.strip('python')} AS answer FROM pairs""",
)
def chat_from_turns(spark, sf_dir):
    return _flat(chat.pairs_to_chat(turn_pairs(spark, sf_dir), "turns", "row_id", "nl", "python"))
