"""Queries over sources, lineage and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import lineage, prompts
from quillmesh.plans import sql as q
from quillmesh.plans.catalog import query, table
from quillmesh.plans.tokens import (
    DPO_PROMPT_SQL,
    PAIRS_SQL,
    PREFERENCES_SQL,
    TURNS_SQL,
    preference_rows,
    turn_pairs,
    user_turns,
)
from quillmesh.sources.corpus import parse_records, read_corpus

LINE = chr(10)


def alpaca_sql(head: str, task_input: str, output: str, fence: str | None = None) -> str:
    """SQL for the prompt text; `head`, `task_input` and `output` are SQL expressions."""
    opening = q.text(LINE * 2 + "### Response:" + LINE + (f"```{fence}{LINE}" if fence else ""))
    closing = q.text(LINE + "```" + LINE * 2 if fence else LINE * 2)
    return (
        f"{q.text('### Instruction:' + LINE)} || {head} || {q.text(LINE * 2 + '### Input:' + LINE)} || "
        f"{task_input} || {opening} || {output} || CASE WHEN {output} <> '' THEN {closing} ELSE '' END"
    )


def head_sql(fmt: str) -> str:
    return q.text(prompts.INSTRUCTIONS[fmt])


@query(
    "broken_records",
    """WITH lines AS (
         SELECT o_orderkey, o_custkey, o_orderstatus, '{"o_orderkey": ' || o_orderkey || ', "o_custkey": ' || o_custkey || ', "o_orderstatus": "' || o_orderstatus || '"}' AS line FROM orders),
       read AS (
         SELECT *, CASE o_orderkey % 11 WHEN 3 THEN left(line, length(line) - 2) WHEN 5 THEN replace(line, o_custkey || ',', '"x",') WHEN 7 THEN '[]x' END AS broken
         FROM lines WHERE o_orderkey % 11 <> 8)
       SELECT o_orderkey AS place, broken AS broken_record, CASE WHEN broken IS NULL THEN o_orderkey END AS o_orderkey,
              CASE WHEN broken IS NULL THEN o_custkey END AS o_custkey, CASE WHEN broken IS NULL THEN o_orderstatus END AS o_orderstatus FROM read""",
)
def broken_records(spark, sf_dir):
    """Orders as lines of JSON; some are cut off, hold a text for a number, are no object, or blank."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    line, kind = F.to_json(F.struct("*")), F.col("o_orderkey") % 11
    spaced = F.regexp_replace(F.regexp_replace(line, '":', '": '), ',"', ', "')
    written = (
        F.when(kind == 3, F.expr("left(line, length(line) - 2)")).when(kind == 7, "[]x").when(kind == 8, " \t")
        .when(kind == 5, F.replace("line", F.concat("o_custkey", F.lit(",")), F.lit('"x",'))).otherwise(F.col("line"))
    )
    lines = orders.withColumn("line", spaced).select(F.col("o_orderkey").alias("place"), written.alias("value"))
    return parse_records(lines, "o_orderkey long, o_custkey long, o_orderstatus string", broken="keep")


@query("corpus_scan", "SELECT doc_id, lang, source, n_chars, 'documents.parquet' AS source_file FROM documents")
def corpus_scan(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = read_corpus(spark, [f"{sf_dir}/documents.parquet"], "parquet", schema)
    return docs.select("doc_id", "lang", "source", "n_chars", "source_file")


@query(
    "source_lineage",
    """WITH named AS (
         SELECT doc_id, source || '_' || (CASE WHEN doc_id % 2 = 0 THEN 'heat' ELSE 'wave' END) || '_train' AS parent,
                (CASE WHEN doc_id % 2 = 0 THEN 'heat' ELSE 'wave' END) || '_' || lang || '.v1.jsonl' AS file FROM documents),
       words AS (
         SELECT doc_id, list_concat(string_split(parent, '_'),
                string_split(regexp_replace(file, '[.][^.]*$', ''), '_')) AS w FROM named),
       kept AS (
         SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '_') AS keywords FROM words)
       SELECT doc_id, keywords,
              CASE WHEN contains(keywords, 'heat') THEN 'heat' WHEN contains(keywords, 'wave') THEN 'wave' END AS dataset_class,
              'tokenized_' || keywords AS output_name FROM kept""",
)
def source_lineage(spark, sf_dir):
    family = F.when(F.col("doc_id") % 2 == 0, "heat").otherwise("wave")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("_", "source", family, F.lit("train")).alias("parent"),
        F.concat(family, F.lit("_"), "lang", F.lit(".v1.jsonl")).alias("file"),
    )
    return lineage.with_lineage(docs, "parent", "file").drop("parent", "file")


@query(
    "common_keywords",
    """WITH names AS (SELECT DISTINCT 'tokenized_' || lang || '_nc1_' || source || '_train' AS name FROM documents),
       words AS (SELECT DISTINCT name, unnest(string_split(name, '_')) AS word FROM names),
       shared AS (SELECT word FROM words WHERE word <> 'tokenized' GROUP BY word
                  HAVING count(*) = (SELECT count(*) FROM names)),
       line AS (SELECT coalesce(string_agg(word, '_' ORDER BY word), '') AS keywords FROM shared)
       SELECT keywords, CASE WHEN keywords = '' THEN 'grouped.parquet'
                             ELSE 'grouped_' || keywords || '.parquet' END AS output_name FROM line""",
)
def common_keywords(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("tokenized_"), "lang", F.lit("_nc1_"), "source", F.lit("_train.parquet")).alias("name")
    )
    return lineage.common_keywords(names, "name", "grouped.parquet", ignore=("tokenized",))


@query(
    "union_aligned",
    """SELECT 'orders' AS input, o_orderkey AS key, o_totalprice AS amount, o_orderstatus AS flag FROM orders
       UNION ALL
       SELECT 'lineitem', l_orderkey, l_linenumber::DOUBLE, l_suppkey::VARCHAR FROM lineitem""",
)
def union_aligned(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("flag")
    )
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"),
        F.col("l_linenumber").alias("amount"),
        F.col("l_suppkey").alias("flag"),
    )
    return lineage.union_aligned({"orders": orders, "lineitem": items})


@query(
    "union_sizes",
    """SELECT 'orders' AS input, count(*) AS "rows" FROM orders
       UNION ALL SELECT 'lineitem', count(*) FROM lineitem""",
)
def union_sizes(spark, sf_dir):
    return lineage.input_sizes(union_aligned(spark, sf_dir))


FORMAT_NAMES = list(prompts.INSTRUCTIONS)


@query(
    "render_prompt",
    f"""WITH numbered AS (SELECT *,
          list_value({', '.join(q.text(n) for n in FORMAT_NAMES)})[((conv_id + turn) % {len(FORMAT_NAMES)} + 1)::INT] AS fmt,
          list_value({', '.join(q.text(t) for t in prompts.INSTRUCTIONS.values())})[((conv_id + turn) % {len(FORMAT_NAMES)} + 1)::INT] AS head
          FROM conversations)
        SELECT conv_id, turn, fmt, {alpaca_sql('head', 'text', 'role')} AS plain,
               {alpaca_sql('head', 'text', 'role', 'python')} AS fenced,
               {alpaca_sql('head', 'text', "''", 'latex')} AS opened FROM numbered""",
)
def render_prompt(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in FORMAT_NAMES])
    place = ((F.col("conv_id") + F.col("turn")) % len(FORMAT_NAMES)).cast("int")
    turns = table(spark, sf_dir, "conversations").withColumn("fmt", F.get(names, place))
    plain = prompts.render_prompt(turns, F.col("fmt"), "text", "role", name="plain")
    fenced = prompts.render_prompt(plain, F.col("fmt"), "text", "role", "python", name="fenced")
    opened = prompts.render_prompt(fenced, F.col("fmt"), "text", None, "latex", name="opened")
    return opened.select("conv_id", "turn", "fmt", "plain", "fenced", "opened")


def _sft_sql(fmt: str) -> str:
    name, given, target = prompts.SFT_FORMATS[fmt]
    task = q.strip("nl")
    if given:
        task = f"{task} || {q.text(LINE * 2 + prompts.SECTION)} || {q.strip(given)} || {q.text(prompts.CLOSE)}"
    answer = q.strip("python") if target == "python" else "sstl"
    prompt = alpaca_sql(head_sql(name), task, "''", "latex" if target == "sstl" else "python")
    return f"SELECT {q.text(fmt)} AS fmt, row_id, {prompt} AS text, {answer} || {q.text(prompts.CLOSE)} AS labels FROM rows"


@query(
    "build_sft",
    f"""WITH {PAIRS_SQL}, rows AS (
          SELECT row_id, nl || chr(10) AS nl, python || ' ' AS python, 'G ' || nl || ' ' AS sstl,
                 ' F ' || nl AS train_predicted_sstl, nl || chr(9) AS stl FROM pairs)
        {' UNION ALL '.join(_sft_sql(f) for f in prompts.SFT_FORMATS)}""",
)
def build_sft(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).select(
        "row_id",
        F.concat("nl", F.lit("\n")).alias("nl"),
        F.concat("python", F.lit(" ")).alias("python"),
        F.concat(F.lit("G "), "nl", F.lit(" ")).alias("sstl"),
        F.concat(F.lit(" F "), "nl").alias("train_predicted_sstl"),
        F.concat("nl", F.lit("\t")).alias("stl"),
    )
    return lineage.union_aligned(
        {f: prompts.build_sft(rows, f, keep=("row_id",)) for f in prompts.SFT_FORMATS}
    ).withColumnRenamed("input", "fmt")


@query(
    "build_preference",
    f"""WITH {PREFERENCES_SQL}
        SELECT w_id, l_id, {DPO_PROMPT_SQL} AS prompt,
               {q.strip('w_sstl')} || {q.text(prompts.CLOSE)} AS chosen,
               {q.strip('l_sstl')} || {q.text(prompts.CLOSE)} AS rejected FROM preferences""",
)
def build_preference(spark, sf_dir):
    return prompts.build_preference(preference_rows(spark, sf_dir), keep=("w_id", "l_id"))


SHOT_PROMPT = alpaca_sql(head_sql("nl_to_python"), q.strip("text"), q.strip("'item ' || item_id::VARCHAR"), "python")


def _draw(i: int) -> str:
    number = f"('0x' || substr(md5('42:' || row_id || ':{i}'), 1, 8))::BIGINT"
    return f"{number} % (size - {i})"


@query(
    "few_shot_prefix",
    f"""WITH {TURNS_SQL},
        shots AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'heat' ELSE 'wave' END AS family, item_id AS id,
                         {SHOT_PROMPT} AS text FROM benchmark),
        placed AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY id) - 1 AS at,
                          row_number() OVER (PARTITION BY family ORDER BY {q.shuffled('id', 42)}) - 1 AS random_at,
                          count(*) OVER (PARTITION BY family) AS size FROM shots),
        sized AS (SELECT row_id, CASE WHEN conv_id % 2 = 0 THEN 'heat' ELSE 'wave' END AS family FROM pairs),
        first_draws AS (SELECT s.*, {_draw(0)} AS d0, {_draw(1)} AS e1, {_draw(2)} AS e2
                        FROM sized s JOIN (SELECT DISTINCT family, size FROM placed) USING (family)),
        second AS (SELECT *, e1 + (CASE WHEN e1 >= d0 THEN 1 ELSE 0 END) AS d1 FROM first_draws),
        third AS (SELECT *, e2 + (CASE WHEN e2 >= least(d0, d1) THEN 1 ELSE 0 END) AS f2 FROM second),
        drawn AS (SELECT *, f2 + (CASE WHEN f2 >= greatest(d0, d1) THEN 1 ELSE 0 END) AS d2 FROM third)
        SELECT d.row_id, a0.text || a1.text AS few_shot, b0.text || b1.text || b2.text AS random_shot
        FROM drawn d
        JOIN placed a0 ON a0.family = d.family AND a0.at = 0 JOIN placed a1 ON a1.family = d.family AND a1.at = 1
        JOIN placed b0 ON b0.family = d.family AND b0.random_at = d.d0
        JOIN placed b1 ON b1.family = d.family AND b1.random_at = d.d1
        JOIN placed b2 ON b2.family = d.family AND b2.random_at = d.d2""",
)
def few_shot_prefix(spark, sf_dir):
    family = lambda key: F.when(F.col(key) % 2 == 0, "heat").otherwise("wave")
    items = table(spark, sf_dir, "benchmark").select(
        "item_id",
        family("item_id").alias("family"),
        F.col("text").alias("nl"),
        F.lit("").alias("sstl"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("python"),
    )
    shots = prompts.few_shot_examples(items, "nl_to_python", "family", "item_id")
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("row_id"), family("conv_id").alias("family")
    )
    fixed = prompts.with_few_shot(rows, shots, 2, "family", "row_id", dataset="combined")
    drawn = prompts.with_few_shot(fixed, shots, 3, "family", "row_id", shuffle=True, name="random_shot")
    return drawn.select("row_id", "few_shot", "random_shot")


def _eval_sql(fmt: str, sstl: str, python: str) -> str:
    nl, section = q.strip("nl"), q.text(prompts.SECTION)
    close = q.text(prompts.CLOSE)
    if fmt == "nl_to_python":
        return alpaca_sql(head_sql(fmt), nl, python, "python")
    if fmt == "test_nl_to_python_with_sstl_cot":
        steps = f"{section} || {sstl} || {q.text(LINE + '```' + LINE * 2 + 'Python:' + LINE + '```python' + LINE)} || {python} || {close}"
        return alpaca_sql(head_sql(fmt), nl, f"(CASE WHEN {sstl} <> '' AND {python} <> '' THEN {steps} ELSE '' END)")
    if fmt == "nl_to_sstl":
        return alpaca_sql(head_sql(fmt), nl, f"({section} || {sstl} || CASE WHEN {sstl} <> '' THEN {close} ELSE '' END)")
    task = f"{nl} || {q.text(LINE * 2 + prompts.SECTION)} || {sstl} || {close}"
    return alpaca_sql(head_sql(fmt), task, python, "python")


EVAL_FORMATS = ("nl_to_python", "test_nl_to_python_with_sstl_cot", "nl_to_sstl", "test_nl_with_given_sstl_to_python")


@query(
    "eval_prompt",
    f"""WITH {TURNS_SQL}, rows AS (SELECT row_id, nl, nl || ' ' AS sstl, python FROM pairs)
        {' UNION ALL '.join(
            f"SELECT {q.text(f)} AS fmt, row_id, {_eval_sql(f, q.strip('sstl'), q.strip('python'))} AS example, "
            f"{_eval_sql(f, q.text(''), q.text(''))} AS prompt FROM rows" for f in EVAL_FORMATS)}""",
)
def eval_prompt(spark, sf_dir):
    rows = user_turns(spark, sf_dir).withColumn("sstl", F.concat("nl", F.lit(" ")))
    parts = {}
    for fmt in EVAL_FORMATS:
        asked = prompts.build_eval_prompt(rows, fmt, "nl")
        shown = prompts.build_eval_prompt(asked, fmt, "nl", "sstl", "python", name="example")
        parts[fmt] = shown.select("row_id", "prompt", "example")
    return lineage.union_aligned(parts).withColumnRenamed("input", "fmt")


def _train_sql(fmt: str) -> str:
    given, target = prompts.TRAIN_PROMPTS[fmt]
    task = q.strip("nl")
    if given:
        task += f" || {q.text(LINE * 2 + prompts.SECTION)} || {q.strip('sstl')} || {q.text(prompts.CLOSE)}"
    fence = "latex" if target == "sstl" else "python"
    return f"SELECT {q.text(fmt)} AS fmt, row_id, {alpaca_sql(head_sql(fmt), task, q.strip(target), fence)} AS example FROM rows"


@query(
    "train_examples",
    f"""WITH {PAIRS_SQL}, rows AS (SELECT row_id, nl, nl || ' ' AS sstl, python FROM pairs)
        {' UNION ALL '.join(_train_sql(f) for f in prompts.TRAIN_PROMPTS)}""",
)
def train_examples(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).withColumn("sstl", F.concat("nl", F.lit(" ")))
    parts = {
        fmt: prompts.few_shot_examples(rows, fmt, "conv_id", "row_id", training=True).select(
            F.col("id").alias("row_id"), F.col("text").alias("example")
        )
        for fmt in prompts.TRAIN_PROMPTS
    }
    return lineage.union_aligned(parts).withColumnRenamed("input", "fmt")
