"""Token arrays: encoding, special ids, label masks, cutting, padding, packing, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.arrays import indexes, last, let
from quillmesh.functions.joins import lookup_join, one_per_key
from quillmesh.functions.ordering import dense_position
from quillmesh.functions.text import as_column

PAD, BOS, EOS, UNKNOWN = 0, 1, 2, 3
IGNORE = -100
FIRST_ID = 10
VOCAB_SIZE = 32000
PIECE = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"

# A vocabulary of so many bytes at most (an entry has its piece and ENTRY_BYTES) goes to every task.
VOCAB_BYTES = 16 << 20
ENTRY_BYTES = 40
BUCKETS, ROW_BUCKETS = 1 << 14, 64

_NO_IDS = "array<bigint>"


def pieces(text: Column | str) -> Column:
    """Words, and every other visible character by itself."""
    return F.regexp_extract_all(as_column(text), F.lit(PIECE), F.lit(0))


def encode(text: Column | str, vocab_size: int = VOCAB_SIZE) -> Column:
    """Text to ids: each piece becomes 10 + md5(piece) mod `vocab_size`."""

    def piece_id(piece: Column) -> Column:
        number = F.conv(F.substring(F.md5(piece.cast("binary")), 1, 8), 16, 10)
        return number.cast("bigint") % F.lit(vocab_size) + F.lit(FIRST_ID)

    return F.transform(pieces(text), piece_id)


def _bucket(piece: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(buckets)).cast("int")


def _ids_in(text: str, dictionary: Column, buckets: int) -> Column:
    """The ids of a text by an array with a map of the pieces of each bucket, NULL for an empty one.

    Spark looks a key up in a map by going through it; a bucket holds a few pieces only.
    """
    unknown = F.lit(UNKNOWN).cast("bigint")

    def looked_up(d: Column) -> Column:
        found = lambda p: F.get(d, _bucket(p, buckets))[p]
        return F.transform(pieces(text), lambda p: F.coalesce(found(p), unknown))

    ids = let(dictionary, looked_up)
    return F.coalesce(ids, F.array().cast(_NO_IDS))


def _dictionary(words: DataFrame) -> DataFrame:
    """All pieces and their ids as one dictionary of BUCKETS buckets, in one row."""
    entries = words.groupBy(_bucket("_piece", BUCKETS).alias("_bucket")).agg(
        F.collect_list(F.struct("_piece", "_id")).alias("_entries")
    )
    places = words.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("_bucket"))
    rows = places.join(entries, "_bucket", "left").select(F.struct("_bucket", "_entries").alias("_row"))
    ordered = F.sort_array(F.collect_list("_row"))
    return rows.agg(F.transform(ordered, lambda r: F.map_from_entries(r["_entries"])).alias("_dictionary"))


def _dictionaries(found: DataFrame, key: str) -> DataFrame:
    """The pieces found for each key as a dictionary of ROW_BUCKETS buckets."""
    entries = found.repartition(key).groupBy(key, _bucket("_piece", ROW_BUCKETS).alias("_bucket")).agg(
        F.map_from_entries(F.collect_set(F.struct("_piece", "_id"))).alias("_entries")
    )
    maps = entries.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("_bucket", "_entries"))).alias("_maps")
    )
    places = F.sequence(F.lit(0), F.lit(ROW_BUCKETS - 1))
    return maps.select(key, F.transform(places, lambda b: F.col("_maps")[b]).alias("_dictionary"))


def encode_with_vocab(
    df: DataFrame, key: str, text: str, vocab: DataFrame, name: str = "input_ids"
) -> DataFrame:
    """Ids from a (`piece`, `id`) table; pieces it lacks become UNKNOWN. A repeated piece is an error.

    A vocabulary of VOCAB_BYTES at most is handed to every task, as a broadcast table would
    be, and texts are encoded where they are read: no piece becomes a row. A larger one is
    joined to a row per text and distinct piece, and each text is encoded by what was found
    for it; the partitions of frequent pieces are split, because a word may be in nearly every
    text. The vocabulary's measured bytes decide when the plan runs; the other way then gets
    no rows.
    """
    given = vocab.select(F.col("piece").alias("_piece"), F.col("id").cast("bigint").alias("_id"))
    words = one_per_key(given.filter("_piece IS NOT NULL"), "_piece", "vocab")
    size = F.sum(F.octet_length("_piece") + F.lit(ENTRY_BYTES))
    small = words.agg(F.coalesce(size, F.lit(0)).alias("_bytes")).scalar() <= F.lit(VOCAB_BYTES)

    # Subqueries may not be written inside of lambdas, so the dictionary is a column first.
    whole = _dictionary(words.filter(small)).scalar()
    in_place = df.filter(small).withColumn("_dictionary", whole)
    in_place = in_place.withColumn(name, _ids_in(text, F.col("_dictionary"), BUCKETS))

    rest = df.filter(~small)
    sought = rest.select(key, F.explode(F.array_distinct(pieces(text))).alias("_piece"))
    own = _dictionaries(lookup_join(sought, words, "_piece", "inner"), key)
    by_row = rest.join(own, key, "left").withColumn(name, _ids_in(text, F.col("_dictionary"), ROW_BUCKETS))
    return in_place.drop("_dictionary").unionByName(by_row.drop("_dictionary"))


def with_bos(ids: Column) -> Column:
    starts = F.coalesce(F.get(ids, F.lit(0)) == BOS, F.lit(False))
    return F.when(starts, ids).otherwise(F.concat(F.array(F.lit(BOS).cast("bigint")), ids))


def with_eos(ids: Column) -> Column:
    ends = F.coalesce(last(ids) == EOS, F.lit(False))
    return F.when(ends, ids).otherwise(F.concat(ids, F.array(F.lit(EOS).cast("bigint"))))


def add_specials(ids: Column | str, force: bool = False, has_bos: bool = True) -> Column:
    """BOS in front and EOS behind where missing; `force` adds them even if present."""
    ids = as_column(ids)
    if force:
        bos = [F.array(F.lit(BOS).cast("bigint"))] if has_bos else []
        return F.concat(*bos, ids, F.array(F.lit(EOS).cast("bigint")))
    return let(ids, lambda raw: let(with_bos(raw), with_eos))


def encode_pretraining(df: DataFrame, text: str = "text", force: bool = False) -> DataFrame:
    """Text rows to `input_ids` with BOS and EOS."""
    return df.withColumn("input_ids", add_specials(encode(text), force))


def mask_source(ids: Column, source_length: Column) -> Column:
    """Labels: the ids with the source part and the BOS before it set to IGNORE."""
    masked = F.least(source_length + 1, F.size(ids))
    ignored = F.array_repeat(F.lit(IGNORE).cast("bigint"), masked)
    return F.concat(ignored, F.slice(ids, masked + 1, F.size(ids)))


def encode_sft(df: DataFrame, text: str = "text", labels: str = "labels") -> DataFrame:
    """`text` + `labels` to `input_ids`, and `labels` that ignore the prompt part."""
    # No piece is encoded as PAD, so the prompt is as long as it has pieces.
    encoded = df.select(
        *[c for c in df.columns if c not in (text, labels, "input_ids", "labels")],
        add_specials(encode(F.concat(text, labels))).alias("input_ids"),
        F.size(pieces(text)).alias("_source"),
    )
    return encoded.withColumn(
        "labels", mask_source(F.col("input_ids"), F.col("_source"))
    ).drop("_source")


def encode_pair(df: DataFrame, source: str = "text", target: str = "labels") -> DataFrame:
    """Source and target encoded apart, each with BOS and EOS."""
    kept = [c for c in df.columns if c not in (source, target, "input_ids", "labels")]
    return df.select(
        *kept,
        add_specials(encode(source)).alias("input_ids"),
        add_specials(encode(target)).alias("labels"),
    )


def encode_preference(df: DataFrame) -> DataFrame:
    """Prompt without special ids; chosen and rejected end in EOS."""
    kept = [c for c in df.columns if c not in ("prompt", "chosen", "rejected")]
    return df.select(
        *kept,
        encode("prompt").alias("prompt_input_ids"),
        let(encode("chosen"), with_eos).alias("chosen_input_ids"),
        let(encode("rejected"), with_eos).alias("rejected_input_ids"),
    )


def truncate(df: DataFrame, max_len: int, columns: tuple[str, ...] = ("input_ids", "labels")):
    """Cut each of the given columns that is present to `max_len`."""
    cut = {c: F.slice(c, 1, max_len) for c in columns if c in df.columns}
    return df.withColumns(cut)


def truncate_preference(df: DataFrame, max_len: int) -> DataFrame:
    """Cut the prompt ids; the two answers stay whole."""
    return truncate(df, max_len, ("prompt_input_ids",))


def pad_to(ids: Column, length: Column | int, fill: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("bigint"), length - F.size(ids)))


def truncate_and_pad(df: DataFrame, max_len: int) -> DataFrame:
    """Cut, then pad on the right to exactly `max_len`."""
    cut = truncate(df, max_len)
    fills = {"input_ids": PAD, "labels": IGNORE}
    return cut.withColumns(
        {c: pad_to(F.col(c), max_len, fill) for c, fill in fills.items() if c in cut.columns}
    )


def _pack_heads(lengths: Column, max_len: int) -> Column:
    """Greedy fold over the lengths of one batch: for each row the row its pack starts at."""
    start = F.struct(
        F.lit(0).alias("fill"),
        F.lit(0).alias("head"),
        F.lit(False).alias("open"),
        F.array().cast("array<int>").alias("heads"),
    )

    def step(state: Column, n: Column) -> Column:
        row = F.size(state["heads"])
        long = n > max_len
        fresh = ~state["open"] | (state["fill"] + n > max_len)
        head = F.when(~long & fresh, row).otherwise(state["head"])
        return F.struct(
            F.when(long, state["fill"])
            .otherwise(F.when(fresh, n).otherwise(state["fill"] + n))
            .alias("fill"),
            head.alias("head"),
            (state["open"] | ~long).alias("open"),
            F.concat(state["heads"], F.array(F.when(long, row).otherwise(head))).alias("heads"),
        )

    return F.aggregate(lengths, start, step, lambda s: s["heads"])


def pack(
    df: DataFrame, max_len: int, ids: str = "input_ids", position: str = "position",
    batch_rows: int = 1000,
) -> DataFrame:
    """Greedy sequence packing inside each run of `batch_rows` positions.

    A row longer than `max_len` is cut into pieces of its own and leaves the open pack
    alone. Rows otherwise join the open pack until one does not fit. Result: `batch`,
    `head` (place in the batch of the pack's first row), `piece`, `input_ids`, `labels`.

    One shuffle, by batch: lengths (at most `batch_rows` integers) are folded once per
    batch, and packs, which hold at most `max_len` ids, are put together in place.
    """
    batch = Window.partitionBy("batch").orderBy("_at")
    whole = batch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = (
        df.select(
            F.floor(F.col(position) / batch_rows).cast("bigint").alias("batch"),
            (F.col(position) % batch_rows).cast("int").alias("_at"),
            F.col(ids).alias("_ids"),
            F.size(ids).alias("_n"),
        )
        .withColumn("_row", F.row_number().over(batch) - 1)
        .withColumn("_lengths", F.collect_list("_n").over(whole))
        .withColumn("_heads", F.when(F.col("_row") == 0, _pack_heads(F.col("_lengths"), max_len)))
        .withColumn("_heads", F.first("_heads").over(whole))
        .withColumn("head", F.get("_heads", F.col("_row")))
    )
    cuts = F.transform(
        indexes(F.ceil(F.col("_n") / max_len).cast("int")),
        lambda i: F.slice("_ids", i * max_len + 1, max_len),
    )
    parts = placed.select("batch", "head", "_row", F.posexplode(cuts).alias("piece", "_ids"))
    packed = F.flatten(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_row", "_ids"))), lambda p: p["_ids"]
        )
    )
    return (
        parts.groupBy("batch", "head", "piece")
        .agg(packed.alias("_packed"))
        .select(
            "batch",
            "head",
            "piece",
            pad_to(F.col("_packed"), max_len, PAD).alias("input_ids"),
            pad_to(F.col("_packed"), max_len, IGNORE).alias("labels"),
        )
    )


def _batched(df: DataFrame, key: str, seed: int, batch_size: int) -> DataFrame:
    placed = dense_position(df, key, seed, "_position")
    return placed.withColumn("batch", F.floor(F.col("_position") / batch_size).cast("bigint"))


def _pad_to_longest(df: DataFrame, fills: dict[str, int]) -> DataFrame:
    """Pad each column to its longest row of the batch (a window of `batch_size` rows)."""
    rows = Window.partitionBy("batch")
    longest = df.withColumns({f"_max_{c}": F.max(F.size(c)).over(rows) for c in fills})
    padded = {c: pad_to(F.col(c), F.col(f"_max_{c}"), fill) for c, fill in fills.items()}
    return longest.withColumns(padded).drop(*(f"_max_{c}" for c in fills))


def attention_mask(ids: Column | str) -> Column:
    return F.transform(as_column(ids), lambda i: i != PAD)


def collate(df: DataFrame, key: str, batch_size: int, seed: int = 3407) -> DataFrame:
    """Batches in seeded order, padded to the longest row, with an attention mask."""
    batched = _batched(df, key, seed, batch_size)
    padded = _pad_to_longest(batched, {"input_ids": PAD, "labels": IGNORE})
    return padded.withColumn("attention_mask", attention_mask("input_ids")).drop("_position")


def collate_preference(df: DataFrame, key: str, batch_size: int, seed: int = 3407) -> DataFrame:
    """As `collate`, for prompt, chosen and rejected, each with its own longest row."""
    names = ("prompt", "chosen", "rejected")
    batched = _batched(df, key, seed, batch_size)
    padded = _pad_to_longest(batched, {f"{n}_input_ids": PAD for n in names})
    masks = {f"{n}_attention_mask": attention_mask(f"{n}_input_ids") for n in names}
    return padded.withColumns(masks).drop("_position")
