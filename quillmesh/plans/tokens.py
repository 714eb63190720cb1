"""Queries over token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.arrays import joined
from quillmesh.functions.ordering import dense_position
from quillmesh.operators import prompts, tokens
from quillmesh.plans import sql as q
from quillmesh.plans.catalog import query, table

MAX_LEN = 256
PACK_LEN = 512
SEED = 3407
BATCH = 8
NL = prompts.INSTRUCTIONS["nl_to_python"]
DPO = prompts.INSTRUCTIONS["dpo_train_nl_to_sstl"]


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's answer, as nl / python rows."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("nl"))
    answer = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("python")
    )
    return user.join(answer, ["conv_id", "turn"]).withColumn(
        "row_id", F.concat_ws("-", "conv_id", "turn")
    )


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn, answered or not, as nl and the answer's text, which may be empty."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("nl"))
    answer = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("python")
    )
    return user.join(answer, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "nl", F.coalesce("python", F.lit("")).alias("python"), F.concat_ws("-", "conv_id", "turn").alias("row_id")
    )


TURNS_SQL = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS nl, coalesce(a.text, '') AS python,
         u.conv_id::VARCHAR || '-' || u.turn::VARCHAR AS row_id
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

PAIRS_SQL = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS nl, a.text AS python,
         u.conv_id::VARCHAR || '-' || u.turn::VARCHAR AS row_id
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

PROMPT_SQL = (
    f"{q.text('### Instruction:' + chr(10) + NL + chr(10) * 2 + '### Input:' + chr(10))} || "
    f"{q.strip('nl')} || {q.text(chr(10) * 2 + '### Response:' + chr(10) + '```python' + chr(10))}"
)
LABEL_SQL = f"{q.strip('python')} || {q.text(prompts.CLOSE)}"


def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a good and a bad document of one source.

    Every labelled document of a source that has both kinds is in a pair: those of the
    smaller kind, in seeded order, are handed out again and again to those of the larger.
    The anchor names language and source.
    """
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    kinds = docs.groupBy("source").agg(
        F.count(F.when(F.col("quality") == 1, 1)).alias("_good"), F.count(F.when(F.col("quality") == 0, 1)).alias("_bad")
    )
    fewer = kinds.select("source", F.least("_good", "_bad").alias("_fewer")).filter("_fewer > 0")

    def placed(quality: int) -> DataFrame:
        rows = dense_position(docs.filter(F.col("quality") == quality), "doc_id", SEED, "place", "source")
        return rows.join(fewer, "source").withColumn("place", F.col("place") % F.col("_fewer"))

    good = placed(1).select("source", "place", F.col("doc_id").alias("w_id"), F.col("text").alias("w_sstl"), "lang")
    bad = placed(0).select("source", "place", F.col("doc_id").alias("l_id"), F.col("text").alias("l_sstl"))
    return good.join(bad, ["source", "place"]).withColumns(
        {"anchor": F.concat_ws(" ", "lang", "source"), "pair_id": F.concat_ws("-", "w_id", "l_id")}
    )


PREFERENCES_SQL = f"""
labelled AS (
  SELECT d.*, l.quality,
         row_number() OVER (PARTITION BY quality, source ORDER BY {q.shuffled('doc_id', SEED)}) - 1 AS place
  FROM documents d JOIN labels l USING (doc_id)),
fewer AS (
  SELECT source, least(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) AS n FROM labelled GROUP BY source),
preferences AS (
  SELECT w.doc_id AS w_id, l.doc_id AS l_id, w.lang || ' ' || w.source AS anchor,
         w.text AS w_sstl, l.text AS l_sstl, w.doc_id::VARCHAR || '-' || l.doc_id::VARCHAR AS pair_id
  FROM labelled w JOIN fewer USING (source) JOIN labelled l USING (source)
  WHERE w.quality = 1 AND l.quality = 0 AND n > 0 AND w.place % n = l.place % n)"""

DPO_PROMPT_SQL = (
    f"{q.text('### Instruction:' + chr(10) + DPO + chr(10) * 2 + '### Input:' + chr(10))} || "
    f"{q.strip('anchor')} || {q.text(chr(10) * 2 + '### Response:' + chr(10) + '```latex' + chr(10))}"
)


@query(
    "encode_documents",
    f"""SELECT doc_id, len(ids)::BIGINT AS n_ids, {q.joined('ids')} AS input_ids
        FROM (SELECT doc_id, {q.encode('text')} AS ids FROM documents)""",
)
def encode_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id").withColumn("ids", tokens.encode("text"))
    return docs.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), joined(F.col("ids")).alias("input_ids")
    )


@query(
    "encode_with_vocab",
    f"""WITH vocab AS (
          SELECT piece, 9 + row_number() OVER (ORDER BY {q.shuffled('piece', SEED)}) AS id
          FROM (SELECT DISTINCT unnest({q.pieces('text')}) AS piece FROM benchmark)),
        located AS (
          SELECT doc_id, unnest({q.pieces('text')}) AS piece,
                 generate_subscripts({q.pieces('text')}, 1) AS pos FROM documents)
        SELECT doc_id, string_agg(coalesce(id, 3)::VARCHAR, ',' ORDER BY pos) AS input_ids
        FROM located LEFT JOIN vocab USING (piece) GROUP BY doc_id""",
)
def encode_with_vocab(spark, sf_dir):
    words = (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(tokens.pieces("text")).alias("piece"))
        .distinct()
    )
    placed = dense_position(words, "piece", SEED)
    vocab = placed.select("piece", (F.col("position") + tokens.FIRST_ID).alias("id"))
    docs = table(spark, sf_dir, "documents", "doc_id")
    encoded = tokens.encode_with_vocab(docs, "doc_id", "text", vocab)
    return encoded.select("doc_id", joined(F.col("input_ids")).alias("input_ids"))


@query(
    "add_specials",
    f"""SELECT doc_id, {q.joined(q.specials('ids'))} AS input_ids,
               {q.joined(q.with_eos(f"({q.with_bos('marked')})"))} AS marked_ids,
               {q.joined('list_concat([1::BIGINT], marked, [2::BIGINT])')} AS forced_ids
        FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN list_concat([1::BIGINT], ids)
                        WHEN 1 THEN list_concat(ids, [2::BIGINT]) ELSE ids END AS marked
              FROM (SELECT doc_id, {q.encode('text')} AS ids FROM documents))""",
)
def add_specials(spark, sf_dir):
    ids = F.col("ids")
    bos, eos = (F.array(F.lit(i).cast("bigint")) for i in (tokens.BOS, tokens.EOS))
    marked = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(bos, ids))
        .when(F.col("doc_id") % 3 == 1, F.concat(ids, eos))
        .otherwise(ids)
    )
    docs = table(spark, sf_dir, "documents", "doc_id").withColumn("ids", tokens.encode("text"))
    return docs.withColumn("marked", marked).select(
        "doc_id",
        joined(tokens.add_specials("ids")).alias("input_ids"),
        joined(tokens.add_specials("marked")).alias("marked_ids"),
        joined(tokens.add_specials("marked", force=True)).alias("forced_ids"),
    )


def sft_rows(spark, sf_dir) -> DataFrame:
    built = prompts.build_sft(turn_pairs(spark, sf_dir), "to_python_no_STL", keep=("row_id",))
    return tokens.encode_sft(built)


SFT_SQL = f"""
built AS (SELECT row_id, {PROMPT_SQL} AS text, {LABEL_SQL} AS labels FROM pairs),
encoded AS (
  SELECT row_id, {q.specials(q.encode('text || labels'))} AS input_ids,
         len({q.pieces('text')}) + 1 AS source FROM built),
sft AS (
  SELECT row_id, input_ids,
         list_concat({q.repeat(-100, 'least(source, len(input_ids))')},
                     input_ids[least(source, len(input_ids)) + 1:]) AS labels FROM encoded)"""


@query(
    "sft_mask",
    f"""WITH {PAIRS_SQL}, {SFT_SQL}
        SELECT row_id, {q.joined('input_ids')} AS input_ids, {q.joined('labels')} AS labels FROM sft""",
)
def sft_mask(spark, sf_dir):
    masked = sft_rows(spark, sf_dir)
    return masked.select("row_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"))


@query(
    "encode_pair",
    f"""WITH {PAIRS_SQL}
        SELECT row_id, {q.joined(q.specials(q.encode('nl')))} AS input_ids,
               {q.joined(q.specials(q.encode('python')))} AS labels FROM pairs""",
)
def encode_pair(spark, sf_dir):
    pairs = tokens.encode_pair(turn_pairs(spark, sf_dir), "nl", "python")
    return pairs.select("row_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"))


@query(
    "encode_preference",
    f"""WITH {PREFERENCES_SQL}
        SELECT w_id, l_id,
          {q.joined(f"({q.encode(DPO_PROMPT_SQL)})[1:64]")} AS prompt_input_ids,
          {q.joined(f"list_concat({q.encode(q.strip('w_sstl') + ' || ' + q.text(prompts.CLOSE))}, [2::BIGINT])")} AS chosen_input_ids,
          {q.joined(f"list_concat({q.encode(q.strip('l_sstl') + ' || ' + q.text(prompts.CLOSE))}, [2::BIGINT])")} AS rejected_input_ids
        FROM preferences""",
)
def encode_preference(spark, sf_dir):
    built = prompts.build_preference(preference_rows(spark, sf_dir), keep=("w_id", "l_id"))
    cut = tokens.truncate_preference(tokens.encode_preference(built), 64)
    return cut.select(
        "w_id", "l_id",
        *[joined(F.col(c)).alias(c) for c in cut.columns if c.endswith("input_ids")],
    )


@query(
    "truncate_tokens",
    f"""SELECT doc_id, {q.joined(f'({q.specials("ids")})[1:{MAX_LEN}]')} AS input_ids,
               {q.joined(f'ids[1:{MAX_LEN}]')} AS labels
        FROM (SELECT doc_id, {q.encode('text')} AS ids FROM documents)""",
)
def truncate_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id").withColumn("labels", tokens.encode("text"))
    cut = tokens.truncate(docs.withColumn("input_ids", tokens.add_specials("labels")), MAX_LEN)
    return cut.select("doc_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"))


@query(
    "pad_tokens",
    f"""SELECT doc_id, {q.joined(f"list_concat(a, {q.repeat(0, f'{MAX_LEN} - len(a)')})")} AS input_ids,
               {q.joined(f"list_concat(b, {q.repeat(-100, f'{MAX_LEN} - len(b)')})")} AS labels
        FROM (SELECT doc_id, ({q.specials("ids")})[1:{MAX_LEN}] AS a, ids[1:{MAX_LEN}] AS b
              FROM (SELECT doc_id, {q.encode('text')} AS ids FROM documents))""",
)
def pad_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id").withColumn("labels", tokens.encode("text"))
    padded = tokens.truncate_and_pad(
        docs.withColumn("input_ids", tokens.add_specials("labels")), MAX_LEN
    )
    return padded.select("doc_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"))


@query(
    "pack_tokens",
    f"""WITH RECURSIVE placed AS (
          SELECT {q.encode('text')} AS ids,
                 row_number() OVER (ORDER BY {q.shuffled('doc_id', SEED)}) - 1 AS position FROM documents),
        rows AS (SELECT position // 1000 AS batch, position % 1000 AS r, ids, len(ids) AS n FROM placed),
        short AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY r) AS s
                  FROM rows WHERE n <= {PACK_LEN}),
        fold AS (
          SELECT batch, s, r, n AS fill, r AS head FROM short WHERE s = 1
          UNION ALL
          SELECT x.batch, x.s, x.r,
                 CASE WHEN f.fill + x.n > {PACK_LEN} THEN x.n ELSE f.fill + x.n END,
                 CASE WHEN f.fill + x.n > {PACK_LEN} THEN x.r ELSE f.head END
          FROM fold f JOIN short x ON x.batch = f.batch AND x.s = f.s + 1),
        parts AS (
          SELECT f.batch, f.head, 0 AS piece, f.r, x.ids FROM fold f JOIN short x USING (batch, s)
          UNION ALL
          SELECT batch, r, i, r, ids[i * {PACK_LEN} + 1 : (i + 1) * {PACK_LEN}]
          FROM (SELECT *, unnest(range((n + {PACK_LEN} - 1) // {PACK_LEN})) AS i
                FROM rows WHERE n > {PACK_LEN})),
        packs AS (SELECT batch, head, piece, flatten(list(ids ORDER BY r)) AS packed
                  FROM parts GROUP BY batch, head, piece)
        SELECT batch, head, piece::BIGINT AS piece,
               {q.joined(f"list_concat(packed, {q.repeat(0, f'{PACK_LEN} - len(packed)')})")} AS input_ids,
               {q.joined(f"list_concat(packed, {q.repeat(-100, f'{PACK_LEN} - len(packed)')})")} AS labels
        FROM packs WHERE len(packed) > 0""",
)
def pack_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id").select("doc_id", tokens.encode("text").alias("input_ids"))
    packed = tokens.pack(dense_position(docs, "doc_id", SEED), PACK_LEN)
    return packed.select(
        "batch", F.col("head").cast("bigint"), F.col("piece").cast("bigint"),
        joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"),
    )


@query(
    "collate_batches",
    f"""WITH {PAIRS_SQL}, {SFT_SQL},
        batched AS (
          SELECT *, (row_number() OVER (ORDER BY {q.shuffled('row_id', SEED)}) - 1) // {BATCH} AS batch FROM sft),
        sized AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS longest FROM batched)
        SELECT batch, row_id,
               {q.joined(f"list_concat(input_ids, {q.repeat(0, 'longest - len(input_ids)')})")} AS input_ids,
               {q.joined(f"list_concat(labels, {q.repeat(-100, 'longest - len(labels)')})")} AS labels,
               len(input_ids)::BIGINT AS attended, longest::BIGINT AS width FROM sized""",
)
def collate_batches(spark, sf_dir):
    batches = tokens.collate(sft_rows(spark, sf_dir), "row_id", BATCH, SEED)
    return batches.select(
        "batch", "row_id",
        joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"),
        F.size(F.filter("attention_mask", lambda m: m)).cast("bigint").alias("attended"),
        F.size("attention_mask").cast("bigint").alias("width"),
    )


@query(
    "collate_preference",
    f"""WITH {PREFERENCES_SQL},
        encoded AS (SELECT w_id, l_id, pair_id,
          {q.encode(DPO_PROMPT_SQL)} AS prompt_input_ids,
          list_concat({q.encode(q.strip('w_sstl') + ' || ' + q.text(prompts.CLOSE))}, [2::BIGINT]) AS chosen_input_ids,
          list_concat({q.encode(q.strip('l_sstl') + ' || ' + q.text(prompts.CLOSE))}, [2::BIGINT]) AS rejected_input_ids
          FROM preferences),
        batched AS (SELECT *, (row_number() OVER (ORDER BY {q.shuffled('pair_id', SEED)}) - 1) // {BATCH} AS batch FROM encoded),
        sized AS (SELECT *, max(len(prompt_input_ids)) OVER (PARTITION BY batch) AS p,
                  max(len(chosen_input_ids)) OVER (PARTITION BY batch) AS c,
                  max(len(rejected_input_ids)) OVER (PARTITION BY batch) AS r FROM batched)
        SELECT batch, w_id, l_id,
          {q.joined(f"list_concat(prompt_input_ids, {q.repeat(0, 'p - len(prompt_input_ids)')})")} AS prompt_input_ids,
          {q.joined(f"list_concat(chosen_input_ids, {q.repeat(0, 'c - len(chosen_input_ids)')})")} AS chosen_input_ids,
          {q.joined(f"list_concat(rejected_input_ids, {q.repeat(0, 'r - len(rejected_input_ids)')})")} AS rejected_input_ids,
          len(prompt_input_ids)::BIGINT AS prompt_attended, len(chosen_input_ids)::BIGINT AS chosen_attended,
          len(rejected_input_ids)::BIGINT AS rejected_attended
        FROM sized""",
)
def collate_preference(spark, sf_dir):
    built = prompts.build_preference(preference_rows(spark, sf_dir), keep=("w_id", "l_id", "pair_id"))
    batches = tokens.collate_preference(tokens.encode_preference(built), "pair_id", BATCH, SEED)
    names = ("prompt", "chosen", "rejected")
    return batches.select(
        "batch", "w_id", "l_id",
        *[joined(F.col(f"{n}_input_ids")).alias(f"{n}_input_ids") for n in names],
        *[
            F.size(F.filter(f"{n}_attention_mask", lambda m: m)).cast("bigint").alias(f"{n}_attended")
            for n in names
        ],
    )
