"""Queries over seeded shuffles, samples and mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import mixing
from quillmesh.operators.lineage import with_lineage
from quillmesh.plans import sql as q
from quillmesh.plans.catalog import query, table
from quillmesh.sources.corpus import output_clashes

SEED = mixing.SHUFFLE_SEED
WEIGHTS = {"en": 0.25, "de": 0.25, "fr": 0.375, "es": 0.125}
SMALLEST_WEIGHTS = {"en": 0.625, "de": 0.125, "fr": 0.125, "es": 0.125}
HEAD = 4
SOURCES = [f"src{i}" for i in range(20)]


def ranked(weights: dict[str, float]) -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {q.shuffled('doc_id', SEED)}) AS r,
         count(*) OVER (PARTITION BY lang) AS n FROM documents),
weights AS (
  SELECT unnest({list(weights)}) AS lang, unnest({list(weights.values())})::DOUBLE AS w,
         unnest(range({len(weights)})) AS place)"""


KEPT = "doc_id, lang, n_chars"


@query(
    "output_clashes",
    """SELECT 'tokenized_' || source || '_part' AS output_name, min('/' || lang || '/' || source || '/part.jsonl') AS first_input,
              max('/' || lang || '/' || source || '/part.jsonl') AS last_input
       FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""",
)
def output_clashes_query(spark, sf_dir):
    """Documents as rows of files `/<lang>/<source>/part.jsonl`: one output per source."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.lit(""), "lang", "source", F.lit("part.jsonl")).alias("path"), "source"
    )
    named = with_lineage(docs, "source", F.lit("part.jsonl"), strict=False)
    return output_clashes(named, "output_name", "path")


@query(
    "seeded_shuffle",
    f"""SELECT doc_id, lang, row_number() OVER (ORDER BY {q.shuffled('doc_id', SEED)}) - 1 AS position
        FROM documents""",
)
def seeded_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return mixing.with_shuffled_position(docs, "doc_id", SEED)


@query(
    "mix_smallest",
    f"""WITH {ranked(SMALLEST_WEIGHTS)},
        sized AS (SELECT DISTINCT lang, n, w, place FROM ranked JOIN weights USING (lang)),
        total AS (SELECT n / w AS t FROM sized ORDER BY n, place LIMIT 1)
        SELECT {KEPT} FROM ranked JOIN weights USING (lang), total
        WHERE r <= floor(t * w)""",
)
def mix_smallest(spark, sf_dir):
    return mixing.mix_by_smallest(
        table(spark, sf_dir, "documents"), "lang", "doc_id", SMALLEST_WEIGHTS, SEED
    ).select("doc_id", "lang", "n_chars")


@query(
    "mix_head",
    f"""SELECT doc_id, source FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY {q.shuffled('doc_id', SEED)}) AS r
          FROM documents) WHERE r <= {HEAD}""",
)
def mix_head(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_head(docs, "source", "doc_id", SOURCES, HEAD, SEED)
    return mixed.select("doc_id", "source")


TOTAL = 1280


@query(
    "mix_total",
    f"""WITH {ranked(WEIGHTS)},
        shares AS (SELECT *, floor({TOTAL} * w)::BIGINT AS k FROM ranked JOIN weights USING (lang)),
        repeated AS (
          SELECT *, unnest(range(1, (k // n + CASE WHEN r <= k % n THEN 1 ELSE 0 END)::BIGINT + 1)) AS c
          FROM shares)
        SELECT {KEPT}, c::BIGINT AS copy FROM repeated""",
)
def mix_total(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_total(docs, "lang", "doc_id", WEIGHTS, TOTAL, SEED)
    return mixed.select("doc_id", "lang", "n_chars", F.col("copy").cast("bigint"))


SAMPLE = 5000


@query(
    "sample_rows",
    f"""SELECT event_id, user_id, event_type, value FROM events
        ORDER BY {q.shuffled('event_id', mixing.SAMPLE_SEED)} LIMIT {SAMPLE}""",
)
def sample_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return mixing.sample_rows(events, "event_id", SAMPLE)


@query(
    "preview_sample",
    f"""SELECT doc_id, text FROM documents
        ORDER BY {q.shuffled('doc_id', mixing.SAMPLE_SEED)} LIMIT 3""",
)
def preview_sample(spark, sf_dir):
    return mixing.preview_sample(table(spark, sf_dir, "documents"), "doc_id", 3).select("doc_id", "text")


@query(
    "resume_from",
    f"""SELECT doc_id, position FROM (
          SELECT doc_id, row_number() OVER (ORDER BY {q.shuffled('doc_id', SEED)}) - 1 AS position
          FROM documents) WHERE position >= 10 * 16""",
)
def resume_from(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return mixing.resume_from(docs, "doc_id", step=10, batch_size=16, seed=SEED)
