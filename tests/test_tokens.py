import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.ordering import dense_position
from quillmesh.operators import prompts, tokens
from quillmesh.plans.tokens import preference_rows
from quillmesh.operators.tokens import BOS, EOS, IGNORE, PAD


def arrays(spark, rows, names="id long, input_ids array<bigint>"):
    return spark.createDataFrame(rows, names)


def test_encode_is_stable_and_counts_pieces(spark):
    row = spark.createDataFrame([("Ab 12, é_x!",), ("",)], "text string").select(
        tokens.encode("text").alias("ids"), tokens.pieces("text").alias("p")
    ).collect()
    assert row[0].p == ["Ab", "12", ",", "é_x", "!"]
    assert len(row[0].ids) == 5 and min(row[0].ids) >= 10
    assert row[1].ids == []


def test_specials_only_where_missing(spark):
    rows = [(0, [BOS, 5]), (1, [5, EOS]), (2, [BOS, 5, EOS]), (3, []), (4, [EOS]), (5, [BOS])]
    df = arrays(spark, rows).select("id", tokens.add_specials("input_ids").alias("a"),
                                    tokens.add_specials("input_ids", force=True).alias("b"),
                                    tokens.add_specials("input_ids", force=True, has_bos=False).alias("c"))
    got = {r.id: r for r in df.collect()}
    assert got[0].a == [BOS, 5, EOS] == got[1].a == got[2].a
    assert got[3].a == [BOS, EOS] and got[4].a == [BOS, EOS] and got[5].a == [BOS, EOS]
    assert got[2].b == [BOS, BOS, 5, EOS, EOS] and got[0].c == [BOS, 5, EOS]


def test_sft_masks_the_prompt_and_never_outgrows_the_row(spark):
    df = spark.createDataFrame([(1, "a b c", " d e"), (2, "", "x"), (3, "a b", "")], "id long, text string, labels string")
    got = {r.id: r for r in tokens.encode_sft(df).collect()}
    assert got[1].labels[:4] == [IGNORE] * 4 and got[1].labels[4:] == got[1].input_ids[4:]
    assert got[2].labels == [IGNORE, got[2].input_ids[1], EOS]
    assert got[3].labels == [IGNORE] * 3 + [EOS]
    # Text and label grow into one piece: the mask is no longer than the row.
    joined = spark.createDataFrame([(1, "a. b. c.", "")], "id long, text string, labels string")
    row = tokens.encode_sft(joined).first()
    assert len(row.labels) == len(row.input_ids)


def test_cut_and_pad(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], [5, 6]), (2, [], [])], "id long, input_ids array<bigint>, labels array<bigint>")
    cut = {r.id: r for r in tokens.truncate(df, 3).collect()}
    assert cut[1].input_ids == [1, 2, 3] and cut[1].labels == [5, 6]
    padded = {r.id: r for r in tokens.truncate_and_pad(df, 3).collect()}
    assert padded[1].labels == [5, 6, IGNORE] and padded[2].input_ids == [PAD] * 3
    no_labels = tokens.truncate_and_pad(df.select("id", "input_ids"), 2).columns
    assert no_labels == ["id", "input_ids"]


def test_preference_cut_is_for_the_prompt_only(spark):
    df = spark.createDataFrame([("a b c d", "e f g", "h")], "prompt string, chosen string, rejected string")
    row = tokens.truncate_preference(tokens.encode_preference(df), 2).first()
    assert len(row.prompt_input_ids) == 2 and len(row.chosen_input_ids) == 4 and row.rejected_input_ids[-1] == EOS


def packed_by_hand(lengths, max_len):
    """Packs as lists of (row, start, stop)."""
    packs, open_ = [], []
    for row, n in enumerate(lengths):
        if n > max_len:
            packs += [[(row, i, min(i + max_len, n))] for i in range(0, n, max_len)]
        else:
            if sum(b - a for _, a, b in open_) + n > max_len:
                packs.append(open_)
                open_ = []
            open_ = open_ + [(row, 0, n)]
    return packs + [open_] if sum(b - a for _, a, b in open_) else packs


@pytest.mark.parametrize("batch_rows", [7, 1000])
def test_pack_against_a_direct_restatement(spark, batch_rows):
    rng = random.Random(5)
    lengths = [rng.choice([0, 1, 3, 8, 8, 9, 20, rng.randrange(1, 9)]) for _ in range(150)]
    rows = [(i, list(range(i * 100 + 1, i * 100 + 1 + n))) for i, n in enumerate(lengths)]
    df = arrays(spark, rows, "position long, input_ids array<bigint>")
    got = tokens.pack(df, 8, batch_rows=batch_rows).collect()
    expected = []
    for start in range(0, len(rows), batch_rows):
        part = rows[start : start + batch_rows]
        for pack in packed_by_hand([len(ids) for _, ids in part], 8):
            ids = [i for row, a, b in pack for i in part[row][1][a:b]]
            fill = 8 - len(ids)
            expected.append((ids + [PAD] * fill, ids + [IGNORE] * fill))
    assert sorted((r.input_ids, r.labels) for r in got) == sorted(expected)


def test_exact_fit_stays_and_long_rows_leave_the_open_pack_alone(spark):
    rows = [(0, [1] * 3), (1, [2] * 9), (2, [3] * 5), (3, [4])]
    got = tokens.pack(arrays(spark, rows, "position long, input_ids array<bigint>"), 8).collect()
    packs = {(r.head, r.piece): r.input_ids for r in got}
    assert packs[(0, 0)] == [1] * 3 + [3] * 5
    assert packs[(1, 0)] == [2] * 8 and packs[(1, 1)] == [2] + [PAD] * 7
    assert packs[(3, 0)] == [4] + [PAD] * 7


def test_pack_of_rows_that_do_not_start_a_batch(spark):
    rows = [(5, [1] * 3), (9, [2] * 3), (12, [3] * 3)]
    got = tokens.pack(arrays(spark, rows, "position long, input_ids array<bigint>"), 7).collect()
    assert sorted(r.input_ids for r in got) == [[1, 1, 1, 2, 2, 2, PAD], [3, 3, 3] + [PAD] * 4]


def test_collate_pads_to_the_longest_of_each_batch(spark):
    rows = [(i, [9] * (i % 5 + 1), [8] * (i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, input_ids array<bigint>, labels array<bigint>")
    got = tokens.collate(df, "id", 4).collect()
    assert sorted(sum(r.batch == b for r in got) for b in (0, 1, 2)) == [2, 4, 4]
    for b in (0, 1, 2):
        rows_ = [r for r in got if r.batch == b]
        longest = max(r.id % 5 + 1 for r in rows_)
        assert {len(r.input_ids) for r in rows_} == {longest}
        assert {len(r.labels) for r in rows_} == {max(r.id % 3 for r in rows_)}
        assert all(sum(r.attention_mask) == r.id % 5 + 1 for r in rows_)


def test_vocab_join(spark):
    docs = spark.createDataFrame([(1, "a b a zz"), (2, "")], "id long, text string")
    vocab = spark.createDataFrame([("a", 20), ("b", 21)], "piece string, id long")
    got = {r.id: r.input_ids for r in tokens.encode_with_vocab(docs, "id", "text", vocab).collect()}
    assert got == {1: [20, 21, 20, 3], 2: []}


def test_no_piece_of_a_text_is_moved_for_a_small_vocabulary(spark, sf_dir, monkeypatch):
    """Adaptive execution had moved a row per piece before it knew that the vocabulary is small."""
    plain = tokens.lookup_join

    def watched(rows, per_key, on, how):
        moved = F.raise_error(F.concat(F.lit("moved: "), on)).cast("string")
        return plain(rows.withColumn(on, moved), per_key, on, how)

    monkeypatch.setattr(tokens, "lookup_join", watched)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocab = spark.createDataFrame([("the", 20), ("and", 21), (".", 22)], "piece string, id long")
    encoded = tokens.encode_with_vocab(docs, "doc_id", "text", vocab)
    got = encoded.select("doc_id", "input_ids", F.size(tokens.pieces("text")).alias("n")).collect()
    assert len(got) == docs.count() and all(len(r.input_ids) == r.n for r in got)
    # The dictionary is read in place and is no column that each row would hold.
    assert "aggregate([], Subquery" in encoded._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("largest, buckets", [(1 << 20, 1 << 14), (1 << 20, 1), (-1, 64), (-1, 1)])
def test_vocabulary_in_place_and_joined(spark, sf_dir, monkeypatch, largest, buckets):
    monkeypatch.setattr(tokens, "VOCAB_BYTES", largest, raising=False)
    monkeypatch.setattr(tokens, "BUCKETS", buckets, raising=False)
    monkeypatch.setattr(tokens, "ROW_BUCKETS", buckets, raising=False)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 40").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\u00e9\u00e9n, x _ \U0001f600!")], "doc_id long, text string")
    every = docs.unionByName(odd)
    words = every.select(F.explode(tokens.pieces("text")).alias("piece")).distinct().filter("xxhash64(piece) % 2 = 0")
    vocab = words.withColumn("id", F.when(F.length("piece") != 3, F.xxhash64("piece"))).localCheckpoint()
    ids = {r.piece: r.id for r in vocab.collect()}
    assert None in ids.values()
    rows = every.select("doc_id", tokens.pieces("text").alias("p")).collect()
    wanted = {r.doc_id: [tokens.UNKNOWN if ids.get(p) is None else ids[p] for p in r.p or []] for r in rows}
    got = tokens.encode_with_vocab(every, "doc_id", "text", vocab).collect()
    assert len(got) == len(rows) and {r.doc_id: r.input_ids for r in got} == wanted


def test_a_large_vocabulary_meets_each_piece_of_a_text_once(spark, monkeypatch):
    plain, sought = tokens.lookup_join, []

    def watched(rows, per_key, on, how):
        sought.append(rows)
        return plain(rows, per_key, on, how)

    monkeypatch.setattr(tokens, "lookup_join", watched)
    monkeypatch.setattr(tokens, "VOCAB_BYTES", -1, raising=False)
    docs = spark.createDataFrame([(1, "a b a a . a b"), (2, "a a"), (3, ""), (4, None)], "id long, text string")
    vocab = spark.createDataFrame([("a", 20), (".", 21)], "piece string, id long")
    got = {r.id: r.input_ids for r in tokens.encode_with_vocab(docs, "id", "text", vocab).collect()}
    assert got == {1: [20, 3, 20, 20, 21, 20, 3], 2: [20, 20], 3: [], 4: []}
    assert sorted((r.id, r._piece) for r in sought[0].collect()) == [(1, "."), (1, "a"), (1, "b"), (2, "a")]


@pytest.mark.parametrize("largest", [1 << 20, -1])
def test_a_repeated_piece_is_an_error(spark, monkeypatch, largest):
    monkeypatch.setattr(tokens, "VOCAB_BYTES", largest, raising=False)
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    vocab = spark.createDataFrame([("a", 20), ("a", 21)], "piece string, id long")
    with pytest.raises(Exception, match="vocab repeats a key: a"):
        tokens.encode_with_vocab(docs, "id", "text", vocab).collect()


def test_every_labelled_document_is_in_a_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    kinds = {}
    for r in docs.collect():
        kinds.setdefault(r.source, {0: set(), 1: set()})[r.quality].add(r.doc_id)
    wanted = {d for k in kinds.values() if k[0] and k[1] for d in k[0] | k[1]}
    pairs = preference_rows(spark, sf_dir).collect()
    assert {r.w_id for r in pairs} | {r.l_id for r in pairs} == wanted
    assert len(pairs) == sum(max(len(k[0]), len(k[1])) for k in kinds.values() if k[0] and k[1])


def test_masks_of_long_rows_are_whole(spark):
    built = spark.createDataFrame([("a " * 5000, "b " * 500)], "text string, labels string")
    row = tokens.encode_sft(built).first()
    assert len(row.input_ids) == len(row.labels) == 5502 and row.labels.count(-100) == 5001


def test_dense_positions_are_a_permutation_also_per_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7))
    assert sorted(r.position for r in dense_position(df, "id", 1).collect()) == list(range(5000))
    per_group = dense_position(df, "id", 1, by="g").groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.max("position").alias("m"), F.min("position").alias("l")
    )
    assert all(r.n == r.d == r.m + 1 and r.l == 0 for r in per_group.collect())


def test_prompt_errors(spark):
    df = spark.createDataFrame([("x", "nl", "p", "s")], "fmt string, nl string, python string, sstl string")
    with pytest.raises(ValueError):
        prompts.render_prompt(df, "x", "nl")
    with pytest.raises(Exception, match="unknown prompt format"):
        prompts.render_prompt(df, F.col("fmt"), "nl").collect()
    with pytest.raises(ValueError):
        prompts.build_sft(df, "to_nowhere")
    with pytest.raises(ValueError):
        prompts.build_eval_prompt(df, "dpo_train_nl_to_sstl")


def test_prompt_shape(spark):
    df = spark.createDataFrame([(" task ", "code\n", "f ")], "nl string, python string, sstl string")
    row = prompts.build_sft(df, "to_python_GT_STL").first()
    assert row.text.endswith("### Input:\ntask\n\nSpatial Signal Temporal Logic:\n```latex\nf\n```\n\n### Response:\n```python\n")
    assert row.labels == "code\n```"
    assert prompts.build_sft(df, "to_STL").first().labels == "f \n```"


def test_few_shot_limits_and_small_classes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, family string")
    shots = spark.createDataFrame([("a", 1, "A1"), ("a", 2, "A2"), ("b", 7, "B7")], "family string, id long, text string")
    fixed = {r.id: r.few_shot for r in prompts.with_few_shot(rows, shots, 2, "family", "id").collect()}
    assert fixed == {1: "A1A2", 2: "B7", 3: ""}
    drawn = {r.id: r.few_shot for r in prompts.with_few_shot(rows, shots, 3, "family", "id", shuffle=True).collect()}
    assert drawn[1] in ("A1A2", "A2A1") and drawn[2] == "B7" and drawn[3] == ""
    with pytest.raises(ValueError):
        prompts.with_few_shot(rows, shots, 4, "family", "id")
    with pytest.raises(ValueError):
        prompts.with_few_shot(rows, shots, 1, "family", "id", dataset="combined")
