"""Benchmark decontamination with suffix arrays of the training texts.

Each task is a shard: it sorts the suffixes of its texts, as sequences of words, and looks
every suffix of the benchmark up by binary search. What a suffix of an item finds is a range
of the array; the places in it are occurrences. Neighbouring occurrences on one diagonal are
one longer match. Nothing of the texts is shuffled.

The order of suffixes needs no more words than a window has. Suffixes whose first words are
not those of any benchmark suffix cannot be found and are left out of the array.

The benchmark is looked up in blocks of at most BLOCK bytes of text, each sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmesh.llm.common import chunks, lean, mixed, ranges, text_bytes
from quillmesh.llm.shingles import LOWER, word_hashes

WINDOW = 13
# A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
# Bytes of benchmark text that are sent to the tasks at once.
BLOCK = 8 << 20
# Words of which the suffixes are sorted at once.
SLICE = 1 << 20

# Words are runs of digits, letters and everything beyond ASCII.
OTHER = np.ones(256, bool)
OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Suffixes:
    """Suffixes of word sequences, as rows of numbers that hold several words each."""

    def __init__(self, bits: int, window: int) -> None:
        self.bits, self.window = bits, window
        self.each = 63 // bits
        self.columns = -(-window // self.each)

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """The first words of the suffixes at `starts`; `ids` has zeros behind each text."""
        found = []
        for c in range(self.columns):
            key = np.zeros(len(starts), np.int64)
            for i in range(c * self.each, (c + 1) * self.each):
                word = ids[starts + i] if i < self.window else np.int64(0)
                key = key << self.bits | word
            found.append(key)
        return found

    def upper(self, keys: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
        """The greatest rows that begin with the same `words` words."""
        found = []
        for c, key in enumerate(keys):
            free = np.clip((c + 1) * self.each - words, 0, self.each) * self.bits
            found.append(key | ((np.int64(1) << free) - 1))
        return found


def _before(rows: list[np.ndarray], at: np.ndarray, keys: list[np.ndarray], equal: bool) -> np.ndarray:
    """Whether row `at` is less than the key, or, with `equal`, less or equal."""
    less = np.zeros(len(at), bool)
    same = np.ones(len(at), bool)
    for row, key in zip(rows, keys):
        value = row[at]
        less |= same & (value < key)
        same &= value == key
    return less | same if equal else less


def _search(rows: list[np.ndarray], keys: list[np.ndarray], equal: bool) -> np.ndarray:
    """Binary search of many keys at once: the number of rows before each."""
    low = np.zeros(len(keys[0]), np.int64)
    high = np.full(len(keys[0]), len(rows[0]), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        before = _before(rows, middle, [k[open_] for k in keys], equal)
        low[open_] = np.where(before, middle + 1, low[open_])
        high[open_] = np.where(before, high[open_], middle)


def _padded(words: np.ndarray, counts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with `gap` zeros behind each text, and where each text begins."""
    first = np.cumsum(counts) - counts + gap * np.arange(len(counts))
    ids = np.zeros(int(counts.sum()) + gap * len(counts), words.dtype)
    ids[ranges(first, counts)] = words
    return ids, first


class Benchmark:
    """The suffixes of some benchmark items that are windows."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.items = [i for i, _ in items]
        raw, at = text_bytes(pa.array([t or "" for _, t in items], pa.string()))
        words, counts = word_hashes(raw, at, OTHER, LOWER)
        self.vocabulary = np.unique(words)
        self.suffixes = Suffixes(max(int(len(self.vocabulary)).bit_length(), 1), window)
        numbers = np.searchsorted(self.vocabulary, words).astype(np.int64) + 1
        ids, first = _padded(numbers, counts, window)
        n = np.where(counts >= window, counts - window + 1, (counts > 0).astype(np.int64))
        self.start = ranges(first, n)
        self.item = np.repeat(np.arange(len(items)), n)
        self.offset = ranges(np.zeros_like(n), n)
        self.length = np.repeat(np.minimum(counts, window), n)
        self.keys = self.suffixes.keys(ids, self.start)
        # Equal windows are looked up once.
        order = np.lexsort((self.length, *reversed(self.keys)))
        new = np.ones(len(order), bool)
        for k in (*self.keys, self.length):
            new[1:] &= k[order][1:] == k[order][:-1]
        new[1:] = ~new[1:]
        self.at = order[new]  # one window of each class
        self.members = order  # the windows, class by class
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.first, len(order)])
        # What a suffix must begin with to be found: the words of the shortest window.
        self.prefix = int(min(self.length.min(), self.suffixes.each)) if len(self.length) else 0
        marks = np.zeros(1 << 20, bool)
        if self.prefix:
            marks[self._mark(self.keys[0])] = True
        self.marks = marks

    def _mark(self, key: np.ndarray) -> np.ndarray:
        head = key >> (self.suffixes.each - self.prefix) * self.suffixes.bits
        return (mixed(head.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for those that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def occurrences(self, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all windows that begin at a place below `limit`."""
        none = np.empty(0, np.int64)
        if not self.prefix:
            return none, none
        starts = np.flatnonzero(ids[:limit])
        head = np.zeros(len(starts), np.int64)
        for i in range(self.suffixes.each):
            head = head << self.suffixes.bits | (ids[starts + i] if i < self.prefix else 0)
        starts = starts[self.marks[self._mark(head)]]
        if not len(starts):
            return none, none
        keys = self.suffixes.keys(ids, starts)
        order = np.lexsort(tuple(reversed(keys)))
        array, rows = starts[order], [k[order] for k in keys]
        wanted = [k[self.at] for k in self.keys]
        low = _search(rows, wanted, equal=False)
        high = _search(rows, self.suffixes.upper(wanted, self.length[self.at]), equal=True)
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        place = array[ranges(low[found], count)]
        which = np.repeat(found, count)
        # To all windows of the class.
        return np.repeat(place, self.size[which]), self.members[ranges(self.first[which], self.size[which])]

    def matches(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Maximal matches of texts: text, item, first word, number of words."""
        gap = self.suffixes.columns * self.suffixes.each
        ids, first = _padded(self.numbers(words), counts, gap)
        ids = np.r_[ids, np.zeros(gap, np.int64)]
        places, windows = [], []
        for begin in range(0, len(ids), SLICE):
            place, window = self.occurrences(ids[begin : begin + SLICE + gap], min(SLICE, max(len(ids) - gap - begin, 0)))
            places.append(place + begin)
            windows.append(window)
        place, window = np.concatenate(places), np.concatenate(windows)
        text = np.searchsorted(first, place, "right") - 1
        place = place - first[text]
        item, length = self.item[window], self.length[window]
        # Windows one after the other, in the text and in the item, are one match.
        diagonal = place - self.offset[window]
        order = np.lexsort((place, diagonal, item, text))
        text, item, diagonal, place, length = (x[order] for x in (text, item, diagonal, place, length))
        new = np.ones(len(order), bool)
        if len(order) > 1:
            new[1:] = ~(
                (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (diagonal[1:] == diagonal[:-1])
                & (place[1:] == place[:-1] + 1)
            )
        begin = np.flatnonzero(new)
        last = np.r_[begin[1:], len(order)] - 1 if len(order) else begin
        return text[begin], item[begin], place[begin], place[last] + length[last] - place[begin]


ADDED = ["n_words", "matches", "n_hit", "items", "contaminated", "_text", "_n", "_m"]
MATCHES = "n_words bigint, matches array<struct<item_id:string,start:bigint,length:bigint>>"


def _look_up(df: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """The columns of `df` but `_text`, the number of words, and the matches with some items."""
    benchmark = df.sparkSession.sparkContext.broadcast(Benchmark(items, window))
    rest = [c for c in df.columns if c != "_text"]
    matched = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = benchmark.value
        names = pa.array(known.items, pa.string())
        for part in chunks(batches, "_text"):
            raw, at = text_bytes(part.column("_text"))
            words, counts = word_hashes(raw, at, OTHER, LOWER)
            text, item, start, length = known.matches(words, counts)
            ends = np.r_[0, np.cumsum(np.bincount(text, minlength=len(counts)))].astype(np.int32)
            found = pa.StructArray.from_arrays(
                [names.take(pa.array(item)), pa.array(start), pa.array(length)], fields=list(matched.value_type)
            )
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in rest], pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(ends, found)],
                names=[*rest, "n_words", "matches"],
            )

    kept = [f for f in df.schema.fields if f.name != "_text"]
    return df.mapInArrow(lean(run), StructType([*kept, *StructType.fromDDL(MATCHES).fields]))


def _merged(df: DataFrame, share: int) -> DataFrame:
    """Count the words that are hit by any match."""
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["length"]).alias("e"))))
    start = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))
    hit = F.aggregate(
        ordered, start,
        lambda a, m: F.struct(
            (a["hit"] + F.greatest(m["e"] - F.greatest(m["s"], a["end"]), F.lit(0))).alias("hit"),
            F.greatest(a["end"], m["e"]).alias("end"),
        ),
        lambda a: a["hit"],
    )
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    marked = df.withColumn("n_hit", hit).withColumn("items", items)
    return marked.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _blocks(benchmark: DataFrame, item: str, text: str, block: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about `block` bytes of text."""
    rows = benchmark.select(F.col(item).cast("string").alias("_i"), F.col(text).cast("string").alias("_t"))
    rows = rows.filter("_t IS NOT NULL AND _t <> ''")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_t") + 64), F.lit(0)).alias("n")).first().n
    number = max(1, -(-2 * total // block)) if total > block else 1
    for i in range(number):
        part = rows if number == 1 else rows.filter(F.pmod(F.xxhash64("_i", "_t"), F.lit(number)) == i)
        yield [(r._i, r._t) for r in part.collect()]


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = SHARE, block: int = BLOCK,
) -> DataFrame:
    """All columns of `df` and what of each text is in the benchmark.

    Adds n_words, matches (array of item_id, start, length: the maximal matches, in words),
    n_hit (words inside any match), items (ids with matches, sorted as strings) and
    contaminated (n_hit > 0 and share * n_hit >= n_words).

    A match is made of windows: `window` words of an item in a row; an item of fewer words
    is one window. Words are runs of digits, letters and characters beyond ASCII, with A-Z
    in lower case. NULL and empty texts have no words; such items match nothing; a NULL item
    id is the empty string; items that share an id count as one; repeated rows are judged
    alike. An empty benchmark contaminates nothing. Columns that would clash with the new
    ones are replaced.
    """
    rest = [c for c in df.columns if c not in ADDED]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("binary").alias("_text"))
    blocks = _blocks(benchmark, item, item_text, block)
    found = _look_up(rows, [(i or "", t) for i, t in next(blocks)], window)
    for more in blocks:
        # Matches with further blocks are gathered in the row: each pass reads it once more.
        again = found.withColumnsRenamed({"n_words": "_n", "matches": "_m"}).withColumn("_text", F.col(f"`{text}`").cast("binary"))
        found = _look_up(again, [(i or "", t) for i, t in more], window)
        found = found.withColumn("matches", F.concat("_m", "matches")).drop("_n", "_m")
    return _merged(found, share)


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `df` that are not contaminated, with their own columns."""
    clashing = {c: f"_own_{c}" for c in df.columns if c in ADDED}
    found = find_contamination(df.withColumnsRenamed(clashing), benchmark, **options)
    return found.filter(~F.col("contaminated")).select(
        *[F.col(f"`{clashing.get(c, c)}`").alias(c) for c in df.columns]
    )
