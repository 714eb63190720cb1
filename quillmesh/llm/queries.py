"""One query per operator, over its whole table, with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import (
    bpe, chat, decontamination, filter_audit, html_text, jaccard_join, personal_data, prefix_trie, quality, sharding, suffix_dedup, token_counts, warc,
)
from quillmesh.llm.catalog import ORACLES, QUERIES, query
from quillmesh.llm.common import shared_folder, stored, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), "doc_id", "text", shards=40)


# Forty hex digits in eight groups of five, each of which is four letters of base 32.
_BASE32 = """
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
  ((('0x' || substr(digest, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31))::INTEGER, 1)), '')
"""
OP2_SQL = f"""
WITH paid AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM paid)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^ \t-\r]+')) AS words,
         len(regexp_extract_all(text, '\p{L}+')) AS letters,
         length(text) - length(replace(text, chr(10), '')) + 1 AS lines
  FROM documents),
final AS (
  SELECT c.*, coalesce(l.toxic = 1, false) AS gone, coalesce(l.quality = 0 AND l.toxic = 0, false) AS revised
  FROM counted c LEFT JOIN labels l USING (doc_id)),
rows AS (
  SELECT source, lang, 'words-1' AS tokenizer_version,
         CASE WHEN revised THEN words + lines ELSE words END AS n FROM final WHERE NOT gone
  UNION ALL
  SELECT source, lang, 'letters-1', letters FROM final WHERE NOT gone)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens
FROM rows GROUP BY ALL
"""


@query("op3_token_counts", OP3_SQL)
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts under two tokenizer versions, deletes of toxic documents, recounts with line
    ends of those of low quality; every batch is delivered twice."""
    docs = table(spark, sf_dir, "documents")
    counted = stored(
        docs.select(
            "doc_id", "source", "lang",
            F.regexp_count("text", F.lit(r"[^ \t-\r]+")).cast("bigint").alias("words"),
            F.regexp_count("text", F.lit(r"\p{L}+")).cast("bigint").alias("letters"),
            (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
            .cast("bigint").alias("lines"),
        ),
        "token-counts",
    )
    labels = table(spark, sf_dir, "labels")
    toxic = labels.filter("toxic = 1").select("doc_id")
    low = labels.filter("quality = 0 AND toxic = 0").select("doc_id")
    none = F.lit(None).cast("bigint")

    def changes(rows: DataFrame, op: str, version: str, old, new) -> DataFrame:
        return rows.select(
            F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"),
            old.alias("old_tokens"), new.alias("new_tokens"),
        )

    gone = counted.join(toxic, "doc_id", "left_semi")
    words, letters = F.col("words"), F.col("letters")
    batches = {
        "001-words": changes(counted, "insert", "words-1", none, words),
        "002-letters": changes(counted, "insert", "letters-1", none, letters),
        "003-toxic": changes(gone, "delete", "words-1", words, none).unionByName(
            changes(gone, "delete", "letters-1", letters, none)
        ),
        "004-recount": changes(
            counted.join(low, "doc_id", "left_semi"), "revise", "words-1", words, words + F.col("lines")
        ),
    }
    store = token_counts.TokenTotals(spark, shared_folder(spark, "token-totals"))
    for name, batch in batches.items():
        store.commit(name, batch)
        if name == "002-letters":
            store.compact()
        store.commit(name, batch)
    return store.totals()


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def vocabulary() -> tuple[str, str]:
    """The rank file of the queries and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, *vocabulary()))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.link_documents(docs).select("doc_id", "n_shingles", "component_id")


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


OP9_SQL = """
WITH whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(30) || text || chr(31), '' ORDER BY turn) AS seq,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id),
firsts AS (
  SELECT min(conv_id) AS conv_id, n_turns, seq, text, count(*)::BIGINT AS copies FROM whole GROUP BY ALL)
SELECT conv_id, 0::INTEGER AS segment, n_turns, copies, text FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM firsts g WHERE g.n_turns > f.n_turns AND starts_with(g.seq, f.seq))
"""


@query("op9_chat_formatting", OP9_SQL)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )

_CRC32 = """
xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::INTEGER, 1))::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))))
"""
OP11_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, {_CRC32} % 9 AS h FROM t GROUP BY c),
k AS (SELECT a.c, a.h, least(a.h, coalesce(b.n, 0)) AS given FROM n a LEFT JOIN n b ON b.c = a.c - a.c % 5),
r AS (
  SELECT k.c, place, role, text FROM k JOIN t ON t.c = k.c - k.c % 5 AND place < h
  UNION ALL SELECT k.c, given + place - h, role, text FROM k JOIN t ON t.c = k.c AND place >= h),
p AS (
  SELECT c, place + 1 AS d, strlen(text) AS b,
         string_agg(role || chr(30) || text || chr(31), '') OVER (PARTITION BY c ORDER BY place) AS seq FROM r
  UNION ALL SELECT c, 0, 0, '' FROM k),
ended AS (SELECT seq, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(seq, d) AS seq FROM p GROUP BY c) GROUP BY seq),
u AS (SELECT d, seq, min(c) AS c, count(*) AS members, any_value(b) AS b FROM p GROUP BY d, seq),
up AS (SELECT u.d, u.seq, p.seq AS above FROM u JOIN p ON p.c = u.c AND p.d = u.d - 1),
kids AS (SELECT above AS seq, d - 1 AS d, count(*) AS n FROM up GROUP BY ALL),
below AS (
  SELECT p.d, p.seq, sum((u.members - 1) * u.b) AS saved, count(CASE WHEN kids.n IS NULL THEN 1 END) AS leaves
  FROM u LEFT JOIN kids ON kids.d = u.d AND kids.seq = u.seq JOIN p ON p.c = u.c AND p.d <= u.d GROUP BY p.d, p.seq)
SELECT u.c AS conv_id, u.d::BIGINT AS depth, v.c AS parent_conv_id, u.members::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN below ON below.d = u.d AND below.seq = u.seq
LEFT JOIN kids ON kids.d = u.d AND kids.seq = u.seq
LEFT JOIN up ON up.d = u.d AND up.seq = u.seq LEFT JOIN u v ON v.d = up.d - 1 AND v.seq = up.above
LEFT JOIN ended ON ended.seq = u.seq
"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations")).drop("_l1", "_l2")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS bad FROM labels GROUP BY doc_id),
failing AS (
  SELECT doc_id, part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, list_concat(
    CASE WHEN len(w) < 200 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN ['B'] ELSE [] END,
    CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN ['C'] ELSE [] END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN ['D'] ELSE [] END,
    CASE WHEN coalesce(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY text) THEN ['E'] ELSE [] END) AS f
  FROM d LEFT JOIN l USING (doc_id)),
kinds AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failing GROUP BY part, f),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT part, f, n, good, bad, o, step, substr(o, step::INTEGER, 1) AS own,
                 list_min(list_transform(f, lambda y: strpos(o, y))) AS gone
          FROM kinds, orders, range(1, 6) s(step)),
rows AS (
  SELECT part, o AS filter_order, step, own, sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN list_contains(f, own) AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN f = [own] THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN gone = step THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, o, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM rows
"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return filter_audit.audit_filters(docs, table(spark, sf_dir, "labels"))


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(personal_data.KINDS)],
        F.sha2(personal_data.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        personal_data.listed(F.col("spans")).alias("spans"),
    )
