"""Quality rules: word statistics and a log-likelihood ratio of hashed n-grams.

Unigrams and bigrams of tokens (runs of letters, digits or other signs) are hashed into
buckets. Two multinomials are counted: that of all documents and that of trusted ones. The
score of a document is the mean, over its n-grams, of log p(trusted) - log p(all), so it
does not depend on the length. Junk has n-grams that trusted text lacks.

The threshold is fitted to labelled documents: of all cuts the one of least cost, where a
trusted document that goes costs a hundred times a poor one that stays, in the middle of the
gap between the scores on either side. It is fitted to the scores of all labelled documents:
they are counted in BINS ranges of scores, whose totals come to the driver, and ranges are
ordered by themselves. All documents are counted, all trusted ones as such, and all are scored
and judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmesh.llm.common import CHUNK, chunks, lean, mixed, ranges, stored, text_bytes
from quillmesh.llm.hashing import PrefixHash
from quillmesh.llm.shingles import BLANK, word_bounds, word_hashes

BUCKETS = 1 << 16
SLICES = 64
# Ranges of scores, and how many make up a score of 1.
BINS = 1 << 14
BINS_A_UNIT = 256
LOSS = 100
# Where labels of one kind are missing.
DEFAULT_THRESHOLD = -0.5
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50

SAME = np.arange(256, dtype=np.uint8)
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
# 0 blank, 1 letter (all of UTF-8 beyond ASCII too), 2 digit, 3 other sign.
KIND = np.full(256, 3, np.uint8)
KIND[BLANK] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
# Weights are whole numbers of this part when they are summed: 10^9 n-grams stay below 2^63.
STEP = 1 << 24
_BIGRAM = np.uint64(0xA24BAED4963EE407)


# --- n-grams ----------------------------------------------------------------------------


def _slices(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of some megabytes that begin at a blank; a run without any stays whole."""
    begin = 0
    while begin < len(raw):
        size = CHUNK
        while begin + size < len(raw):
            blank = np.flatnonzero(BLANK[raw[begin + 1 : begin + size]])
            if len(blank):
                size = 1 + int(blank[-1])
                break
            size *= 2
        yield raw[begin : begin + size]
        begin += size


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token and the number of tokens of each text."""
    if len(raw) > 2 * CHUNK and len(at) == 2:
        found = np.concatenate([_piece(part, np.array([0, len(part)]))[0] for part in _slices(raw)])
        return found, np.array([len(found)])
    return _piece(raw, at)


def _piece(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = KIND[raw]
    new = np.ones(len(raw) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[at] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[starts] > 0 if len(starts) else np.empty(0, bool)
    starts, ends = starts[solid], ends[solid]
    hashes = PrefixHash(raw)
    length = ends - starts
    return mixed(hashes.of(starts, length) + length.astype(np.uint64)), np.diff(np.searchsorted(starts, at))


def ngrams(raw: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the unigrams and bigrams of each text, text by text, and their number."""
    hashes, n = _tokens(raw, at)
    first = np.cumsum(n) - n
    pairs = np.maximum(n - 1, 0)
    left = ranges(first, pairs)
    both = mixed(hashes[left] * _BIGRAM + hashes[left + 1]) if len(left) else hashes[:0]
    total = n + pairs
    begin = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.int64)
    out[ranges(begin, n)] = (hashes % np.uint64(buckets)).astype(np.int64)
    out[ranges(begin + n, pairs)] = (both % np.uint64(buckets)).astype(np.int64)
    return out, total


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


# --- base statistics --------------------------------------------------------------------


def statistics(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Word statistics of each text; see `judge`."""
    words, n = word_hashes(raw, at, BLANK, SAME)
    texts = len(n)
    head = ~BLANK[raw] & ((raw & 0xC0) != 0x80)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][at])

    # Words in windows of three that the text has twice or more.
    windows = np.maximum(n - 2, 0)
    start = ranges(np.cumsum(n) - n, windows)
    owner = np.repeat(np.arange(texts), windows)
    three = words[start] if len(start) else words[:0]
    if len(start):
        three = mixed(mixed(mixed(three) + words[start + 1]) + words[start + 2])
    order = np.lexsort((three, owner))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        equal = (three[order][1:] == three[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        same[1:] |= equal
        same[:-1] |= equal
    repeated = start[order[same]]
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[repeated + i] = True
    # Lines with a word that equal an earlier one.
    begin, end = word_bounds(raw, at, NEWLINE)
    lines, line_count = word_hashes(raw, at, NEWLINE, SAME)
    solid = np.r_[0, np.cumsum(~BLANK[raw], dtype=np.int64)]
    has_word = solid[end] > solid[begin]
    line_of = np.repeat(np.arange(texts), line_count)
    lines, line_of = lines[has_word], line_of[has_word]
    order = np.lexsort((lines, line_of))
    again = np.zeros(len(order), bool)
    if len(order) > 1:
        again[1:] = (lines[order][1:] == lines[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    return {
        "n_words": n.astype(np.int64),
        "word_chars": per_text(head),
        "n_symbols": per_text(SYMBOL[raw]),
        "n_dup_lines": np.bincount(line_of[order][again], minlength=texts),
        "n_repeat_words": _sums(covered, n),
    }


# --- counting and fitting ---------------------------------------------------------------


class Model(NamedTuple):
    """What a document is judged by: the weight of each bucket and the threshold."""

    weights: np.ndarray
    threshold: float


def _counts(df: DataFrame, key: str, text: str, trusted: DataFrame | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams per bucket, in all documents and in trusted ones.

    `trusted`: a table with one row per `_id`, or an array of a few ids. Each task sends its
    sums, in slices; so many numbers come back as there are buckets.
    """
    width = BUCKETS // SLICES
    if isinstance(trusted, np.ndarray):
        trusted = df.sparkSession.createDataFrame([(int(x),) for x in np.unique(trusted)], "_id bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in chunks(batches, "text"):
            raw, at = text_bytes(part.column("text"))
            found, n = ngrams(raw, at)
            chosen = pc.fill_null(part.column("_trusted"), False).to_numpy(zero_copy_only=False)
            every += np.bincount(found, minlength=BUCKETS)
            good += np.bincount(found[np.repeat(chosen, n)], minlength=BUCKETS)
        slices = range(SLICES)
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(slices, pa.int32()),
            "every": pa.array([every[i * width : (i + 1) * width].tobytes() for i in slices], pa.binary()),
            "good": pa.array([good[i * width : (i + 1) * width].tobytes() for i in slices], pa.binary()),
        })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = sums.setdefault(row["slice"], [np.zeros(width, np.int64), np.zeros(width, np.int64)])
                own[0] += np.frombuffer(row["every"], np.int64)
                own[1] += np.frombuffer(row["good"], np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(list(sums), pa.int32()),
                "every": pa.array([x[0].tobytes() for x in sums.values()], pa.binary()),
                "good": pa.array([x[1].tobytes() for x in sums.values()], pa.binary()),
            })

    schema = "slice int, every binary, good binary"
    docs = df.select(F.col(key).cast("bigint").alias("_id"), F.col(text).cast("binary").alias("text"))
    # Rows without id meet no label; the second key spreads them.
    spread = F.when(F.col("_id").isNull(), F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(F.lit(0))
    told = trusted.select("_id", F.lit(0).cast("bigint").alias("_spread"), F.lit(True).alias("_trusted"))
    marked = (
        docs.withColumn("_spread", spread).withColumn("_id", F.coalesce("_id", F.lit(0)))
        .join(told.hint("shuffle_hash"), ["_id", "_spread"], "left").select("text", "_trusted")
    )
    summed = marked.mapInArrow(lean(count), schema).repartitionById(SLICES, "slice").mapInArrow(lean(add), schema)
    every, good = np.zeros((SLICES, width), np.int64), np.zeros((SLICES, width), np.int64)
    for row in summed.collect():  # SLICES rows
        every[row.slice], good[row.slice] = np.frombuffer(row.every, np.int64), np.frombuffer(row.good, np.int64)
    return every.ravel(), good.ravel()


def weights(every: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p(trusted) - log p(all) per bucket, each count raised by one."""
    if not good.sum():
        return np.zeros(len(every))
    trusted = np.log((good + 1) / (good.sum() + len(good)))
    return trusted - np.log((every + 1) / (every.sum() + len(every)))


def fit_threshold(good: np.ndarray, poor: np.ndarray) -> float:
    """The cut of least cost between scores of trusted and of poor documents."""
    if not len(good) or not len(poor):
        return DEFAULT_THRESHOLD
    values = np.unique(np.r_[good, poor])
    cuts = np.r_[values[0] - 1.0, (values[1:] + values[:-1]) / 2]
    good, poor = np.sort(good), np.sort(poor)
    cost = LOSS * np.searchsorted(good, cuts, "left") + len(poor) - np.searchsorted(poor, cuts, "left")
    return float(cuts[int(np.argmin(cost))])


def fit_threshold_to(scored: DataFrame) -> float:
    """`fit_threshold` for a table of any size: `score`, `good` (else poor).

    Rows are counted per range of scores; a range knows from the totals what lies in front of
    it, and its distinct scores are summed up in order by one task. One row comes back.
    """
    place = F.greatest(F.least(F.floor(F.col("score") * BINS_A_UNIT), F.lit(BINS // 2 - 1)), F.lit(-BINS // 2)).cast("int")
    values = scored.groupBy(place.alias("bin"), "score").agg(
        F.sum(F.col("good").cast("bigint")).alias("g"), F.sum((~F.col("good")).cast("bigint")).alias("p")
    )
    totals = values.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.max("score").alias("top"))
    found = sorted(totals.collect(), key=lambda r: r.bin)  # BINS rows at most
    if not sum(r.g for r in found) or not sum(r.p for r in found):
        return DEFAULT_THRESHOLD
    before, good, poor, top = [], 0, sum(r.p for r in found), None
    for r in found:
        before.append((r.bin, good, poor, top))
        good, poor, top = good + r.g, poor - r.p, r.top
    known = scored.sparkSession.createDataFrame(before, "bin int, in_front bigint, behind bigint, below double")
    earlier = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.join(F.broadcast(known), "bin").select(  # BINS rows at most
        "score",
        F.coalesce(F.lag("score").over(Window.partitionBy("bin").orderBy("score")), "below").alias("last"),
        (F.col("in_front") + F.coalesce(F.sum("g").over(earlier), F.lit(0))).alias("lost"),
        (F.col("behind") - F.coalesce(F.sum("p").over(earlier), F.lit(0))).alias("left"),
    )
    cut = F.when(F.col("last").isNull(), F.col("score") - 1.0).otherwise((F.col("score") + F.col("last")) / 2)
    return placed.agg(F.min(F.struct((LOSS * F.col("lost") + F.col("left")).alias("cost"), cut.alias("cut"))).alias("best")).first().best.cut


def _score(raw: np.ndarray, at: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The mean weight of each text's n-grams. Weights are summed as whole numbers of 2^-24, so
    a score does not depend on the texts beside it."""
    found, n = ngrams(raw, at)
    return _sums(np.rint(model * STEP).astype(np.int64)[found], n) / STEP / np.maximum(n, 1)


def _base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < FEWEST_WORDS) | (
        100 * found["n_repeat_words"] > MOST_REPEATED_PERCENT * found["n_words"]
    )


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None) -> Model:
    """Count the corpus and fit the threshold.

    `labels`: the key, quality, toxic. Documents of quality 1 that are not toxic are
    trusted, those of quality 0 poor. Of repeated labels the worst counts; NULL labels and
    ids count as none. N-grams are counted in all trusted documents; the threshold is fitted
    to the scores of all labelled documents that pass the base rules, of repeated ids to the
    least. `most` has no effect: no labelled document is left out.
    """
    told = (
        labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(key).cast("bigint").alias("_id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    every, trusted = _counts(df, key, text, told.filter("quality = 1 AND toxic = 0").select("_id"))
    model = weights(every, trusted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            raw, at = text_bytes(part.column("text"))
            passed = ~_base_failed(statistics(raw, at)) & part.column("_id").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({
                "_id": part.column("_id").filter(pa.array(passed)), "score": pa.array(_score(raw, at, model)[passed]),
            })

    # Texts stay where they are: all are scored, and ids and scores meet the labels.
    docs = df.select(F.col(key).cast("bigint").alias("_id"), F.col(text).cast("binary").alias("text"))
    scored = docs.mapInArrow(lean(score), "_id bigint, score double").groupBy("_id").agg(F.min("score").alias("score"))
    kinds = told.filter("quality = 0 OR (quality = 1 AND toxic = 0)").select("_id", (F.col("quality") == 1).alias("good"))
    fitted = scored.join(kinds.hint("shuffle_hash"), "_id").select("score", "good")
    return Model(model, fit_threshold_to(stored(fitted, "scores")))


STATISTICS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, score double, kept boolean"
)


def judge(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns and the statistics, score and verdict of each document.

    Words are separated by blanks. `word_chars`: code points in words; `n_symbols`:
    characters of #*$%&|<>; `n_dup_lines`: lines with a word that equal an earlier line;
    `n_repeat_words`: words in windows of three that the text has twice or more.
    `base_failed`: fewer than 50 words, or more than half of them repeated. `kept`: the base
    rules hold and the score reaches the threshold.

    A NULL or empty text has no words and fails. Repeated rows are judged alike. Columns
    that would clash with the new ones are replaced. An empty table gives no rows.
    """
    schema = StructType.fromDDL(STATISTICS)
    rest = [c for c in df.columns if c not in schema.names and c != "_text"]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            raw, at = text_bytes(part.column("_text"))
            found = statistics(raw, at)
            failed, score = _base_failed(found), _score(raw, at, model.weights)
            added = [*found.values(), failed, score, ~failed & (score >= model.threshold)]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in rest], *[pa.array(x) for x in added]], names=[*rest, *schema.names]
            )

    kept = [f for f in rows.schema.fields if f.name != "_text"]
    return rows.mapInArrow(lean(run), StructType([*kept, *schema.fields]))
