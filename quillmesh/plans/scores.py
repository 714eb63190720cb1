"""Queries over row scores and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.arrays import joined
from quillmesh.operators import scores, tokens
from quillmesh.plans import sql as q
from quillmesh.plans.catalog import query, table
from quillmesh.plans.tokens import PAIRS_SQL, turn_pairs
from quillmesh.sources.examples import ordered_examples, standard_examples
from quillmesh.sources.runs import metrics_from_text


@query(
    "edit_distance",
    """SELECT p_partkey, levenshtein(p_name, p_type) AS edit_distance FROM part""",
)
def edit_distance(spark, sf_dir):
    scored = scores.edit_distance(table(spark, sf_dir, "part"), "p_name", "p_type")
    return scored.select("p_partkey", F.col("edit_distance").cast("bigint"))


@query(
    "edit_distance_mean",
    """SELECT p_brand, round(avg(levenshtein(p_name, p_type)), 6) AS mean, count(*) AS n
       FROM part GROUP BY p_brand""",
)
def edit_distance_mean(spark, sf_dir):
    scored = scores.edit_distance(table(spark, sf_dir, "part"), "p_name", "p_type")
    per_brand = scores.mean_std(scored, "edit_distance", ["p_brand"])
    return per_brand.select("p_brand", F.round("mean", 6).alias("mean"), "n")


def logprobs(spark, sf_dir) -> DataFrame:
    """Log-probabilities from embedding values, as maps per step; some rows lack them."""
    values = F.transform("embedding", lambda v: -F.abs(F.floor(v * 1000) / 1000))
    steps = F.transform(
        values,
        lambda v, i: F.create_map(
            i.cast("bigint"), F.struct(F.lit("t").alias("token"), v.alias("logprob"))
        ),
    )
    rows = table(spark, sf_dir, "embeddings").withColumn("steps", steps)
    flat = F.when(F.col("label") == 0, None).otherwise(scores.flat_logprobs("steps"))
    return rows.withColumn("logits", flat)


@query(
    "perplexity",
    """SELECT vec_id, CASE WHEN label = 0 THEN 'failed' ELSE 'ok' END AS perplexity_status,
              CASE WHEN label <> 0 THEN round(exp(-list_avg(
                list_transform(embedding, lambda v: -abs(floor(v::DOUBLE * 1000) / 1000)))), 9) END AS perplexity
       FROM embeddings""",
)
def perplexity(spark, sf_dir):
    scored = scores.perplexity(logprobs(spark, sf_dir), "logits")
    return scored.select("vec_id", "perplexity_status", F.round("perplexity", 9).alias("perplexity"))


@query(
    "is_correct",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_returnflag <> 'N' AND l_suppkey % 5 <> 0 THEN
                CASE WHEN l_linenumber = 6 THEN false WHEN l_linenumber = 7 THEN l_suppkey % 2 = 0
                     ELSE abs(p - a) <= 0.001 * greatest(abs(p), abs(a)) END
              WHEN l_suppkey % 5 = 0 THEN true ELSE false END AS correct
       FROM (SELECT *, l_extendedprice * (1 + l_tax / 100) AS p, l_extendedprice AS a FROM lineitem)""",
)
def is_correct(spark, sf_dir):
    """Prices with a small error; line 6 has NaN on one side or both, line 7 an infinity."""
    price, line, even = F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_suppkey") % 2 == 0
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    pred = F.when(line == 6, nan).when(line == 7, inf).otherwise(price * (1 + F.col("l_tax") / 100))
    answer = F.when((line == 6) & even, nan).when((line == 7) & even, inf).otherwise(price)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") != "N", pred).alias("pred"),
        F.when(F.col("l_suppkey") % 5 != 0, answer).alias("answer"),
        F.when(F.col("l_returnflag") == "N", "failed").alias("pred_status"),
        F.when(F.col("l_suppkey") % 5 == 0, "timeout").alias("answer_status"),
    )
    graded = scores.is_correct(rows, "pred", "answer", "pred_status", "answer_status")
    return graded.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "correct")


@query(
    "mean_std",
    """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n
       FROM events GROUP BY event_type""",
)
def mean_std(spark, sf_dir):
    stats = scores.mean_std(table(spark, sf_dir, "events"), "value", ["event_type"])
    return stats.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


ROBUSTNESS = "CASE WHEN c_custkey % 17 = 0 THEN -100 WHEN c_custkey % 19 = 0 THEN 0 ELSE c_acctbal END"


@query(
    "label_rates",
    f"""SELECT c_mktsegment, round(avg((r > 0)::INT), 9) AS positive_rate,
               round(avg((r < 0 AND r <> -100)::INT), 9) AS negative_rate,
               round(avg((r = -100)::INT), 9) AS failed_rate, round(avg((r = 0)::INT), 9) AS invalid_rate,
               count(*) AS n_samples
        FROM (SELECT c_mktsegment, {ROBUSTNESS} AS r FROM customer) GROUP BY c_mktsegment""",
)
def label_rates(spark, sf_dir):
    labelled = table(spark, sf_dir, "customer").withColumn("robustness", F.expr(ROBUSTNESS))
    rates = scores.label_rates(labelled, "robustness", ["c_mktsegment"], strict=False)
    names = [c for c in rates.columns if c.endswith("_rate")]
    return rates.select("c_mktsegment", "n_samples", *[F.round(n, 9).alias(n) for n in names])


@query(
    "label_metrics",
    f"""WITH rates AS (SELECT c_mktsegment, count(*)::DOUBLE AS n, round(avg((r > 0)::INT), 9) AS p,
                    round(avg((r < 0 AND r <> -100)::INT), 9) AS m, round(avg((r = -100)::INT), 9) AS f
             FROM (SELECT c_mktsegment, {ROBUSTNESS} AS r FROM customer) GROUP BY c_mktsegment)
        SELECT c_mktsegment, metric, value FROM (
          SELECT c_mktsegment, unnest([n, p, m, f]) AS value, unnest(['n_samples', 'gt positive robustness rate',
            'gt negative robustness rate', 'gt failed robustness rate']) AS metric FROM rates)""",
)
def label_metrics(spark, sf_dir):
    labelled = table(spark, sf_dir, "customer").withColumn("robustness", F.expr(ROBUSTNESS))
    rates = scores.label_rates(labelled, "robustness", ["c_mktsegment"], strict=False)
    metrics = scores.label_metrics(rates, ["c_mktsegment"])
    return metrics.withColumn("value", F.round("value", 9))


@query(
    "backfill_labels",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars / 10.0::DOUBLE ELSE quality::DOUBLE END AS robustness,
              CASE WHEN doc_id % 3 <> 0 THEN toxic::DOUBLE END AS time
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def backfill_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") / 10.0).alias("robustness")
    )
    results = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("robustness"), F.col("toxic").cast("double").alias("time")
    )
    filled = scores.backfill_labels(docs.withColumn("time", F.lit(None).cast("double")), results, "doc_id")
    return filled.select("doc_id", "robustness", "time")


@query(
    "outcome_counts",
    """SELECT outcome, count(*) AS n FROM (
         SELECT CASE WHEN value > 100 THEN 'timeout' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome
         FROM events) GROUP BY outcome""",
)
def outcome_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return scores.outcome_counts(scores.with_outcome(events, "value", "value", 100.0, failed))


@query(
    "outcome_labels",
    """SELECT event_id, CASE WHEN value > 15 THEN 'timeout' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome,
              CASE WHEN value > 15 THEN 0 WHEN event_type = 'error' THEN -100 ELSE value END::DOUBLE AS label FROM events""",
)
def outcome_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    labelled = scores.with_outcome(events, "value", "value", 15.0, failed, timeout_value=0.0)
    return labelled.select("event_id", "outcome", "label")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def run_scores(spark, sf_dir) -> DataFrame:
    """One score per run: event type = dataset, event id gives shots (0, 1 or 3) and seed."""
    events = table(spark, sf_dir, "events")
    runs = events.groupBy(
        F.col("event_type").alias("dataset"),
        F.greatest(F.col("event_id") % 4, F.when(F.col("event_id") % 4 > 1, 3)).cast("int").alias("shots"),
        (F.floor(F.col("event_id") / 4) % 5).cast("int").alias("seed"),
    ).agg(F.avg("value").alias("value"))
    return runs.select(
        F.lit("to_STL").alias("method"), F.lit("iou").alias("metric"), "dataset", "shots", "value"
    )


REPORT_SQL = """
runs AS (SELECT event_type AS dataset, CASE WHEN event_id % 4 > 1 THEN 3 ELSE event_id % 4 END AS shots,
                (event_id // 4) % 5 AS seed, avg(value) AS value FROM events GROUP BY 1, 2, 3),
scored AS (SELECT dataset, shots, count(*) AS n,
                  printf('%.4f (%.4f)', avg(value), stddev_samp(value)) AS cell FROM runs GROUP BY 1, 2),
cells AS (SELECT 'to_STL' AS method, 'iou' AS metric, s.shots, d.dataset, coalesce(n, 0) AS n, coalesce(cell, 'n/a') AS cell
          FROM range(4) s(shots) CROSS JOIN (SELECT DISTINCT dataset FROM runs) d
          LEFT JOIN scored USING (dataset, shots))"""


@query(
    "metrics_from_text",
    """SELECT event_type AS dataset, (event_id % 5)::INTEGER AS shots, (event_id % 3)::INTEGER AS seed, 'to_STL' AS method,
              m.metric AS metric, m.value AS value
       FROM events, LATERAL (SELECT unnest(['iou', 'edit distance']) AS metric, unnest([round(events.value, 3), event_id::DOUBLE]) AS value) m
       WHERE m.metric = 'iou' OR event_id % 6 < 3""",
)
def metrics_from_text_query(spark, sf_dir):
    """Each event as the metrics file of a run, with texts and numbers that are none in half of them."""
    event, number = F.col("event_id"), F.round("value", 3)
    broken = F.get(F.array(*map(F.lit, ("5d", "NaN", "Infinity"))), (event % 3).cast("int"))
    files = table(spark, sf_dir, "events").select(
        F.concat(
            F.lit("/runs/"), "event_type", F.lit("_shots="), (event % 5).cast("string"), F.lit("_seed="),
            (event % 3).cast("string"), F.lit("/to_STL/metrics.json"),
        ).alias("path"),
        F.to_json(F.create_map(
            F.lit("iou"), number.cast("string"), F.lit("edit distance"),
            F.when(event % 6 < 3, event.cast("string")).otherwise(broken), F.lit("note"), F.lit("timeout"),
        )).alias("value"),
    )
    return metrics_from_text(files)


@query(
    "standard_examples",
    f"""WITH {PAIRS_SQL} SELECT row_id, nl AS question, nl, {q.strip('python')} AS python, python AS answer, 'f ' || turn AS formula,
              'f ' || turn AS sstl FROM pairs""",
)
def standard_examples_query(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).select(
        "row_id", F.col("nl").alias("question"), F.col("python").alias("answer"),
        F.concat(F.lit("f "), F.col("turn").cast("string")).alias("formula"),
    )
    keys = {"nl": "question", "python": "answer", "sstl": "formula"}
    return ordered_examples(standard_examples(rows, keys))


@query(
    "metric_cells",
    f"WITH {REPORT_SQL} SELECT method, metric, shots::BIGINT AS shots, dataset, n, cell FROM cells",
)
def metric_cells(spark, sf_dir):
    cells = scores.metric_cells(run_scores(spark, sf_dir))
    return cells.withColumn("shots", F.col("shots").cast("bigint"))


@query(
    "metric_report",
    f"""WITH {REPORT_SQL} SELECT method, metric, shots::BIGINT AS shots,
        {', '.join(f"max(CASE WHEN dataset = '{t}' THEN cell END) AS {t}" for t in EVENT_TYPES)}
        FROM cells GROUP BY method, metric, shots""",
)
def metric_report(spark, sf_dir):
    report = scores.metric_report(run_scores(spark, sf_dir), EVENT_TYPES)
    return report.withColumn("shots", F.col("shots").cast("bigint"))


@query(
    "report_lines",
    f"""WITH {REPORT_SQL},
        lines AS (SELECT shots, '|   ' || shots || '   | ' || string_agg(cell, ' | ' ORDER BY dataset) || ' |' || chr(10) AS line,
                         string_agg(dataset, ' | ' ORDER BY dataset) AS names, count(*) AS n FROM cells GROUP BY shots)
        SELECT 'to_STL' AS method, 'iou' AS metric,
               '## Metric: iou' || chr(10) || chr(10) || '| shots | ' || max(names) || ' |' || chr(10) || '|-------|'
               || repeat('------------|', max(n)) || chr(10) || string_agg(line, '' ORDER BY shots) || chr(10) || chr(10) AS text
        FROM lines""",
)
def report_lines(spark, sf_dir):
    return scores.report_lines(scores.metric_cells(run_scores(spark, sf_dir)))


@query(
    "flatten_metrics",
    """WITH runs AS (SELECT o_orderpriority AS p, o_orderstatus AS s, round(avg(o_totalprice), 2) AS price,
                            count(*)::DOUBLE AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2)
       SELECT p AS few_shot_prompt, ascii(s)::BIGINT AS few_shot_number,
              'validation_' || p || '_' || ascii(s) || 'shots/' || m AS key, value
       FROM (SELECT p, s, unnest(['n samples', 'mean price', 'top price']) AS m, unnest([n, price, top]) AS value FROM runs)""",
)
def flatten_metrics(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("few_shot_prompt"),
        F.ascii("o_orderstatus").cast("bigint").alias("few_shot_number"),
    ).agg(
        F.count(F.lit(1)).cast("double").alias("n samples"),
        F.round(F.avg("o_totalprice"), 2).alias("mean price"),
        F.max("o_totalprice").alias("top price"),
    )
    return scores.flatten_metrics(runs, ["`n samples`", "`mean price`", "`top price`"])


def completions(spark, sf_dir) -> DataFrame:
    """Per answered user turn the words of the answer as completions, scored by place."""
    words = F.split("python", " ")
    return turn_pairs(spark, sf_dir).select(
        "row_id", "nl",
        words.alias("completions"),
        F.transform(words, lambda w, i: (F.length(w) * 100 + i).cast("double")).alias("scores"),
    )


COMPLETIONS_SQL = f"""{PAIRS_SQL},
unrolled AS (
  SELECT row_id, nl, unnest(string_split(python, ' ')) AS completion,
         generate_subscripts(string_split(python, ' '), 1) - 1 AS pos FROM pairs),
rolled AS (SELECT nl AS prompt, completion,
                  arg_max((length(completion) * 100 + pos)::DOUBLE, row_id || '/' || lpad(pos::VARCHAR, 9, '0')) AS score
           FROM unrolled GROUP BY nl, completion)"""


@query("score_rollup", f"WITH {COMPLETIONS_SQL} SELECT prompt, completion, score FROM rolled")
def score_rollup(spark, sf_dir):
    rows = completions(spark, sf_dir).withColumnRenamed("nl", "prompt")
    return scores.score_table(rows, order="row_id")


@query(
    "score_maps",
    f"""WITH {COMPLETIONS_SQL}
        SELECT prompt, count(*) AS n, round(sum(score), 3) AS total FROM rolled GROUP BY prompt""",
)
def score_maps(spark, sf_dir):
    rows = completions(spark, sf_dir).withColumnRenamed("nl", "prompt")
    maps = scores.score_maps(scores.score_table(rows, order="row_id"), entries=20)
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, v: a + v)
    parts = maps.select("prompt", F.size("scores").alias("n"), total.alias("total"))
    return parts.groupBy("prompt").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))


CANDIDATES = [3, 0, 7, 11, 5]


@query(
    "next_token",
    f"""WITH picked AS (SELECT vec_id, list_transform({CANDIDATES}, lambda i: embedding[i + 1]::DOUBLE) AS x FROM embeddings),
        raised AS (SELECT vec_id, x, list_transform(x, lambda v: exp(v - list_max(x))) AS r FROM picked),
        soft AS (SELECT vec_id, list_transform(r, lambda v: v / list_sum(r)) AS p FROM raised)
        SELECT vec_id, (['a', 'b', 'c', 'd', 'e'])[list_position(p, list_max(p))] AS prediction,
               round(list_max(p), 9) AS top, list_position(p, list_max(p))::BIGINT - 1 AS place FROM soft""",
)
def next_token(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    named = scores.next_token(rows, "embedding", CANDIDATES, list("abcde"))
    place = scores.next_token(rows, "embedding", CANDIDATES).select(
        "vec_id", F.col("prediction").cast("bigint").alias("place")
    )
    return named.select("vec_id", "prediction", F.round(F.array_max("probs"), 9).alias("top")).join(place, "vec_id")


STOPS = (" the ", " der ", "\nLa ", " de ")
END = " de "


def _first_stop() -> str:
    places = ", ".join(f"nullif(instr(text, {q.text(s)}), 0)" for s in STOPS)
    return f"least({places})"


@query(
    "cut_at_stop",
    f"""SELECT doc_id, CASE WHEN stop IS NULL THEN text ELSE substr(text, 1, stop - 1) END AS text,
               coalesce(starts_with(substr(text, stop), {q.text(END)}), false) AS finished
        FROM (SELECT *, {_first_stop()} AS stop FROM documents)""",
)
def cut_at_stop(spark, sf_dir):
    return scores.cut_at_stop(table(spark, sf_dir, "documents"), "text", STOPS, END).select(
        "doc_id", "text", "finished"
    )


MARKS = ("the", "de", "und")


def _ahead(mark: str) -> str:
    return (
        "starts_with(string_agg(token, '') OVER (PARTITION BY doc_id ORDER BY pos "
        f"ROWS BETWEEN CURRENT ROW AND {len(mark) + 2} FOLLOWING), '{mark}')"
    )


@query(
    "cut_logprobs",
    f"""WITH tokens AS (
          SELECT doc_id, unnest({q.pieces('text')}) AS token,
                 generate_subscripts({q.pieces('text')}, 1) AS pos FROM documents),
        marked AS (SELECT *, {' OR '.join(_ahead(m) for m in MARKS)} AS begins FROM tokens),
        first_stop AS (SELECT doc_id, min(CASE WHEN begins THEN pos END) AS stop FROM marked GROUP BY doc_id)
        SELECT doc_id, coalesce(string_agg(CASE WHEN pos < coalesce(stop, 1e9) THEN length(token)::VARCHAR END, ',' ORDER BY pos), '') AS logprobs
        FROM tokens JOIN first_stop USING (doc_id) GROUP BY doc_id""",
)
def cut_logprobs(spark, sf_dir):
    steps = F.transform(
        tokens.pieces("text"),
        lambda p: F.struct(p.alias("token"), F.length(p).alias("logprob")),
    )
    rows = table(spark, sf_dir, "documents", "doc_id").withColumn("steps", steps)
    cut = scores.cut_logprobs(rows, "steps", MARKS[:2], MARKS[2])
    return cut.select("doc_id", joined(F.col("logprobs")).alias("logprobs"))
