"""Removal of byte strings that a document with a smaller id has too, by sorted suffixes.

A suffix sort over all texts would move every position of the corpus. Instead suffixes are
dealt by content first: the least hash of the 24-byte strings inside a 50-byte window (its
anchor) is the same wherever the window occurs, so windows that are equal meet in one
bucket. Neighbouring windows with one anchor form a stretch of text.

1. The anchors of all stretches are counted: only those of two documents or more matter.
2. Stretches with such anchors travel to the bucket of their anchor, with their text.
   Stretches that are equal as a whole are settled at once, first in the task that sends
   them, so that a passage shared by very many documents comes once per task. The suffixes
   of the others are sorted by their bytes, in families with the anchor at one offset, eight
   bytes at a time as long as they are tied: the work per suffix does not depend on how many
   texts share the anchor, but for the sort of a number, and no hash decides about equality.
3. The spans found are gathered per document and cut.

What is sent names documents by their number in a flush, so it does not grow with the number
of buckets that a text meets.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmesh.llm.common import chunks, content_key, groups_of, lean, mixed, parts, ranges, text_bytes
from quillmesh.llm.hashing import PrefixHash, sliding_min

WINDOW = 50
GRAM = 24
# Windows in one stretch at most (repetitive texts have one anchor for very long).
STRETCH = 64
# Text that a task gathers before it sends stretches off, and windows sorted at once.
FLUSH = 16 << 20
SORTED_AT_ONCE = 1 << 20
# Bytes hashed at once: the numbers made of them stay in a core's cache.
BLOCK = 1 << 17
# Documents without id come after all others.
NO_ID = 2**63 - 1


# --- sorting suffixes -------------------------------------------------------------------


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros follow the end."""
    words = np.zeros(len(raw) + 8, np.uint64)
    words[: len(raw)] = raw
    for width in (1, 2, 4):
        words[:-width] = (words[:-width] << np.uint64(8 * width)) | words[width:]
    return words


def sort_suffixes(
    raw: np.ndarray, starts: np.ndarray, family: np.ndarray, length: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes inside their families, by their first `length` bytes.

    `family` is sorted. Returns the order and whether each suffix equals the one before it
    (of its family); of equal suffixes the first given comes first. All families are sorted
    at once, by eight bytes at a time: only suffixes that are still tied are read on, and
    only groups in which the next eight bytes differ are sorted by them.
    """
    words = _words(raw)
    order = np.arange(len(starts), dtype=np.int64)
    # Groups of tied suffixes, by their first place in the order.
    first, size = groups_of(family)
    first, size = first[size > 1], size[size > 1]
    for done in range(0, length, 8):
        if not len(first):
            break
        at = ranges(first, size)
        key = words[starts[order[at]] + done]
        if length - done < 8:
            key >>= np.uint64(8 * (8 - length + done))
        begin = np.cumsum(size) - size
        differ = np.logical_or.reduceat(key != np.repeat(key[begin], size), begin)
        here = np.repeat(differ, size)
        at, key = at[here], key[here]
        group = np.repeat(np.arange(int(differ.sum())), size[differ])
        by = np.lexsort((key, group))
        order[at], key = order[at[by]], key[by]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.r_[begin, len(at)])
        tied = count > 1
        first = np.r_[first[~differ], at[begin[tied]]]
        size = np.r_[size[~differ], count[tied]]
    equal = np.zeros(len(starts), bool)
    equal[ranges(first + 1, size - 1)] = True
    return order, equal


# --- stretches --------------------------------------------------------------------------


def _grams(raw: np.ndarray) -> np.ndarray:
    """The hash of each 24-byte string."""
    grams = np.empty(max(len(raw) - GRAM + 1, 0), np.uint64)
    for i in range(0, len(grams), BLOCK):
        part = mixed(PrefixHash(raw[i : i + BLOCK + GRAM - 1]).every(GRAM))
        grams[i : i + len(part)] = part
    return grams


def _anchors(raw: np.ndarray) -> np.ndarray:
    """The anchor of each window."""
    anchors = np.empty(max(len(raw) - WINDOW + 1, 0), np.uint64)
    for i in range(0, len(anchors), BLOCK):
        grams = mixed(PrefixHash(raw[i : i + BLOCK + WINDOW - 1]).every(GRAM))
        part = sliding_min(grams, WINDOW - GRAM + 1)
        anchors[i : i + len(part)] = part
    return anchors


def _wholes(raw: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The hash of each stretch; `start` is sorted."""
    wholes = np.empty(len(start), np.uint64)
    edge = np.searchsorted(start, np.arange(0, len(raw) + BLOCK, BLOCK))
    for i, j in zip(edge[:-1], edge[1:]):
        if i < j:
            first, n = start[i], count[i:j]
            hashes = PrefixHash(raw[first : start[j - 1] + STRETCH + WINDOW - 1])
            wholes[i:j] = mixed(hashes.of(start[i:j] - first, n + WINDOW - 1) + n.astype(np.uint64))
    return wholes


def _anchored(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of the texts between the offsets `at`: anchor, start, windows, text."""
    empty = np.empty(0, np.int64)
    if len(raw) < WINDOW:
        return empty.astype(np.uint64), empty, empty, empty
    anchors = _anchors(raw)
    # Windows that begin in the last 49 bytes of a text would cross its end.
    windows = np.maximum(np.diff(at) - WINDOW + 1, 0)
    begins = np.zeros(len(anchors) + 1, bool)
    has = windows > 0
    begins[at[:-1][has]] = True
    begins[1:-1] |= anchors[1:] != anchors[:-1]
    valid = np.zeros(len(anchors) + 1, np.int8)
    np.add.at(valid, at[:-1][has], 1)
    np.add.at(valid, (at[:-1] + windows)[has], -1)
    inside = np.cumsum(valid[:-1], dtype=np.int8) > 0
    begins = begins[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    start = np.flatnonzero(begins & inside)
    text = np.searchsorted(at, start, "right") - 1
    stop = np.minimum(np.r_[start[1:], len(anchors)], at[text] + windows[text])
    # Long ones are cut.
    cuts = -(-(stop - start) // STRETCH)
    if len(cuts) and cuts.max() > 1:
        offset = ranges(np.zeros_like(cuts), cuts) * STRETCH
        start, stop, text = np.repeat(start, cuts) + offset, np.repeat(stop, cuts), np.repeat(text, cuts)
        stop = np.minimum(stop, start + STRETCH)
    return anchors[start], start, stop - start, text


def _stretches(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of the texts between the offsets `at`: anchor, start, windows, text, hash."""
    anchor, start, count, text = _anchored(raw, at)
    return anchor, start, count, text, _wholes(raw, start, count)


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + length] equals raw[b : b + length]."""
    same = np.ones(len(a), bool)
    for i in range(0, len(a), 1 << 16):
        j = min(i + (1 << 16), len(a))
        n = length[i:j]
        if not len(n):
            continue
        differ = raw[ranges(a[i:j], n)] != raw[ranges(b[i:j], n)]
        same[i:j] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return same


def merged_spans(
    owner: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, per owner (a number from 0), in order; touching spans join."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    first, _ = groups_of(owner)
    shift = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.r_[True, start[1:] + shift[1:] > reach[:-1]]
    new[first] = True
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(owner)] - 1
    return owner[at], start[at], reach[last] - shift[last]


def _settle(raw, anchor, whole, start, count, doc):
    """Settle stretches that are equal as a whole.

    Returns the order (by anchor, content, document), the first of each class of equal
    stretches for every place in it, and whether the stretch has a smaller document in its
    class. Equality is checked by the bytes; where hashes lie, a stretch is its own class.
    """
    order = np.lexsort((doc, whole, anchor))
    a, w = anchor[order], whole[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])] if len(order) else np.empty(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.empty(0, np.int64)
    here = np.flatnonzero(first != np.arange(len(order)))
    x, y = order[here], order[first[here]]
    same = count[x] == count[y]
    same[same] = _same_bytes(raw, start[x[same]], start[y[same]], (count[x] + WINDOW - 1)[same])
    first[here[~same]] = here[~same]
    later = doc[order] > doc[order[first]]
    return order, first, later


# --- packing ----------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    columns = [np.r_[c["hash0"], c["hash1"]] if c.dtype == CHECK else c for c in columns]
    body = b"".join(c.tobytes() for c in columns)
    head = struct.pack(f"<{len(columns) + 1}q", len(columns), *[c.nbytes for c in columns])
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = len(kinds)
    sizes = struct.unpack_from(f"<{n + 1}q", data)[1:]
    found, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds):
        if np.dtype(kind) == CHECK:
            halves = np.frombuffer(data, np.int64, size // 8, at).reshape(2, -1)
            checks = np.empty(halves.shape[1], CHECK)
            checks["hash0"], checks["hash1"] = halves
            found.append(checks)
        else:
            found.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return found


def _steps(values: np.ndarray) -> np.ndarray:
    """The first value and the steps to each next one."""
    return np.diff(values, prepend=values.dtype.type(0))


# What tells apart the texts of one id, and those without; see `content_key`.
CHECK = np.dtype([("hash0", np.int64), ("hash1", np.int64)])
# Ids and their numbers in the flush; per stretch the place in the list of these, the place in the
# document, the windows; the bytes of all.
STRETCH_KINDS = (np.int64, np.int32, np.int32, np.int32, np.uint8, np.uint8)
SPAN_KINDS = (np.int32, np.int32, np.int32)
ANCHOR_KINDS = (np.int32, np.uint32)
DOCUMENT_KINDS = (np.int64, CHECK)
SENT = "bucket int, blob binary"
FOUND = "_id bigint, _hash0 bigint, _hash1 bigint, _values binary"


def _batch(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array(buckets, pa.int32()), "blob": pa.array(blobs, pa.binary())}
    )


# --- documents by their number in a flush -----------------------------------------------
#
# A document meets almost every bucket, so its id and hashes would be most of what is sent once
# there are many buckets. They go once per flush, to a bucket that all answers for the flush go to.
# Everything else has the number of the document in its flush, and the name of the flush.

NAME = struct.Struct("<i16s")


def _name(buckets: int, ids: np.ndarray, checks: np.ndarray) -> bytes:
    """The name of a flush: the bucket for answers, and a hash of its documents in order. Should
    a repeated task read in another order, its flushes have other names."""
    task = TaskContext.get()
    content = hashlib.blake2b(ids.tobytes(), digest_size=16)
    content.update(checks.tobytes())
    return NAME.pack(task.partitionId() % buckets if task else 0, content.digest())


def _home(name: bytes) -> int:
    return NAME.unpack(name)[0]


def _documents(name: bytes, ids: np.ndarray, checks: np.ndarray) -> bytes:
    return b"I" + name + _pack(ids, checks)


def _parted(blob: bytes) -> tuple[bytes, bytes, bytes]:
    """What the blob is, the flush and the rest."""
    return blob[:1], blob[1 : 1 + NAME.size], blob[1 + NAME.size :]


def _gathered(kinds: tuple):
    """Rows of documents with all values that came back for their flush: anchors, or spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, found = {}, {}
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                mark, name, rest = _parted(blob)
                if mark == b"I":
                    documents[name] = rest
                else:
                    found.setdefault(name, []).append(rest)
        if any(name not in documents for name in found):
            raise RuntimeError("Values of a flush whose documents did not come: a task read other rows when it was repeated")
        for name in list(found):
            ids, checks = _unpack(documents.pop(name), DOCUMENT_KINDS)
            owner, *values = (np.concatenate(x) for x in zip(*[_unpack_by_number(x, kinds) for x in found.pop(name)]))
            if len(values) == 2:
                start, length = (v.astype(np.int64) for v in values)
                owner, start, end = merged_spans(owner, start, start + length)
                packed = np.c_[start, end].astype("<i8")
            else:
                order = np.argsort(owner, kind="stable")
                owner, packed = owner[order], values[0][order].astype("<u4")
            first, size = groups_of(owner)
            for i in range(0, len(first), 4096):
                f, n = first[i : i + 4096], size[i : i + 4096]
                yield pa.RecordBatch.from_pydict({
                    "_id": pa.array(ids[owner[f]], pa.int64()),
                    **{f"_{half}": pa.array(checks[half][owner[f]], pa.int64()) for half in CHECK.names},
                    "_values": pa.array([packed[a : a + k].tobytes() for a, k in zip(f, n)], pa.binary()),
                })

    return run


def _unpack_by_number(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    steps, *values = _unpack(blob, kinds)
    return [np.cumsum(steps), *values]


def _one_per_document(ids, checks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct documents of several lists, and the number of each entry's."""
    order = np.lexsort((checks["hash1"], checks["hash0"], ids))
    i, c = ids[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = i[1:] != i[:-1]
    for half in CHECK.names:
        new[1:] |= c[half][1:] != c[half][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return i[new], c[new], number


# --- anchors ----------------------------------------------------------------------------

# Of an anchor 32 bits travel, next to its bucket. Where two are taken for one, some stretches
# travel that need not.
FOUR = np.uint64(0xFFFFFFFF)
# The number of a document, next to the 40 bits of an anchor that choose its bucket. A flush has
# about FLUSH bytes of text, and a document with an anchor has 50 or more of them.
NUMBER_BITS = np.uint64(24)


def _send_anchors(buckets: int, size: int):
    """Per bucket the anchors of some texts and the documents that have them.

    An anchor that two documents of one flush have is known to be shared: it goes once,
    without documents, and these are told by a row of their own.
    """

    def flush(found: list) -> Iterator[pa.RecordBatch]:
        ids, checks, anchor, text = (np.concatenate(x) for x in zip(*found))
        # Each anchor of a document once; slices of a long text are one document.
        ids, checks, number = _one_per_document(ids, checks)
        code = np.sort((anchor << NUMBER_BITS) | number[text].astype(np.uint64))
        if not len(code):
            return
        code = code[np.r_[True, code[1:] != code[:-1]]]
        anchor, text = code >> NUMBER_BITS, (code & np.uint64((1 << int(NUMBER_BITS)) - 1)).astype(np.int64)
        name = _name(buckets, ids, checks)
        yield _batch([_home(name)], [_documents(name, ids, checks)])
        first, n = groups_of(anchor)
        # Rows that share an id are one document.
        several = np.minimum.reduceat(ids[text], first) != np.maximum.reduceat(ids[text], first)
        here = np.repeat(several, n)
        if here.any():
            told, own = anchor[here], text[here]
            by = np.argsort(own, kind="stable")
            yield _batch([_home(name)], [b"D" + name + _pack(_steps(own[by].astype(np.int32)), (told[by] & FOUR).astype(np.uint32))])
        head = first[several]
        anchor = np.r_[anchor[~here], anchor[head]]
        text = np.r_[text[~here], np.full(len(head), -1)]
        bucket = (mixed(anchor) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort((bucket << NUMBER_BITS) | (text + 1).astype(np.uint64))
        four, text, bucket = (anchor[order] & FOUR).astype(np.uint32), text[order].astype(np.int32), bucket[order]
        numbers, blobs = [], []
        for at, n in zip(*groups_of(bucket)):
            part = slice(at, at + n)
            numbers.append(int(bucket[at]))
            blobs.append(b"A" + name + _pack(_steps(text[part]), four[part]))
            if len(blobs) >= 512:
                yield _batch(numbers, blobs)
                numbers, blobs = [], []
        if blobs:
            yield _batch(numbers, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, texts = [], 0, 0
        for ids, checks, raw, at, _, _ in _texts(batches, size):
            anchor, _, _, text = _anchored(raw, at)
            # Texts without a window have no number.
            used = np.zeros(len(ids), bool)
            used[text] = True
            text = (np.cumsum(used) - 1)[text]
            found.append((ids[used], checks[used], anchor & np.uint64((1 << 40) - 1), text + texts))
            seen += len(raw)
            texts += int(used.sum())
            if seen >= FLUSH:
                yield from flush(found)
                found, seen, texts = [], 0, 0
        if found:
            yield from flush(found)

    return run


def _shared_anchors(buckets: int):
    """Per flush the anchors of this bucket that other documents have too.

    A document in two flushes counts as two here, and rows that share an id too: ids are
    compared where the stretches meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = [], []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                mark, name, rest = _parted(blob)
                if mark == b"A":
                    names.append(name)
                    found.append(_unpack_by_number(rest, ANCHOR_KINDS))
                else:
                    yield _batch([bucket], [blob])
        if not found:
            return
        text, four = (np.concatenate(x) for x in zip(*found))
        flush = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        found.clear()
        code = np.sort((four.astype(np.uint64) << np.uint64(32)) | np.arange(len(four), dtype=np.uint64))
        at = (code & FOUR).astype(np.int64)
        _, n = groups_of(code >> np.uint64(32))
        use = np.zeros(len(text), bool)
        use[at[np.repeat(n > 1, n)]] = True
        use &= text >= 0
        flush, text, four = flush[use], text[use], four[use]
        numbers, blobs = [], []
        for i, n in zip(*groups_of(flush)):
            name, part = names[flush[i]], slice(i, i + n)
            numbers.append(_home(name))
            blobs.append(b"D" + name + _pack(_steps(text[part].astype(np.int32)), four[part]))
        if blobs:
            yield _batch(numbers, blobs)

    return run


# --- stretches on their way -------------------------------------------------------------


class _Sender:
    """Gathers the stretches of some texts and sends them to their buckets."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.raw: list[np.ndarray] = []
        self.size = 0
        self.ids: list[np.ndarray] = []
        self.checks: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, ...]] = []
        self.texts = 0

    def add(self, ids, checks, raw, at, offsets, lists: list[list[bytes]]) -> None:
        anchor, start, count, text, whole = _stretches(raw, at)
        # Only the stretches whose anchors another document has too.
        wanted = [np.frombuffer(b"".join(x), "<u4") for x in lists]
        owner = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]).astype(np.uint64)
        wanted = (owner << np.uint64(32)) | np.concatenate(wanted)
        use = np.isin((text.astype(np.uint64) << np.uint64(32)) | (anchor & FOUR), wanted)
        anchor, start, count, text, whole = (x[use] for x in (anchor, start, count, text, whole))
        self.found.append((anchor, whole, start + self.size, count, text + self.texts))
        self.raw.append(raw)
        self.ids.append(ids)
        self.checks.append(checks)
        # Where the text begins, here and in its document.
        self.offsets.append(at[:-1] + self.size - offsets)
        self.size += len(raw)
        self.texts += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        raw = np.concatenate(self.raw)
        ids, checks, base = (np.concatenate(x) for x in (self.ids, self.checks, self.offsets))
        anchor, whole, start, count, text = (np.concatenate(x) for x in zip(*self.found))
        self.clear()
        name = _name(self.buckets, ids, checks)
        yield _batch([_home(name)], [_documents(name, ids, checks)])
        order, first, later = _settle(raw, anchor, whole, start, count, ids[text])
        # What a smaller document here has as well need not travel: its spans do.
        gone = order[later]
        place = start - base[text]
        o, s, e = merged_spans(text[gone], place[gone], place[gone] + count[gone] + WINDOW - 1)
        if len(o):
            yield _batch([_home(name)], [_spans(name, o, s, e)])
        keep = np.ones(len(order), bool)
        keep[gone] = False
        left = np.flatnonzero(keep)
        bucket = (mixed(anchor[left]) >> np.uint64(20)) % np.uint64(self.buckets)
        by = np.argsort(bucket, kind="stable")
        left, bucket = left[by], bucket[by]
        buckets, blobs = [], []
        for b, n in zip(*groups_of(bucket)):
            at = left[b : b + n]
            own = text[at]
            new = np.r_[True, own[1:] != own[:-1]]
            used = own[new]
            content = raw[ranges(start[at], count[at] + WINDOW - 1)]
            buckets.append(int(bucket[b]))
            blobs.append(
                b"T" + name + _pack(
                    _steps(ids[used]), _steps(used.astype(np.int32)), new.astype(np.int32),
                    _steps(place[at].astype(np.int32)), count[at].astype(np.uint8), content,
                )
            )
            if len(blobs) >= 256:
                yield _batch(buckets, blobs)
                buckets, blobs = [], []
        if blobs:
            yield _batch(buckets, blobs)


def _spans(name: bytes, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return b"S" + name + _pack(_steps(owner.astype(np.int32)), start.astype(np.int32), (end - start).astype(np.int32))


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Texts in chunks: ids, checks, bytes, offsets, where each begins in its document, and
    the rows. A long text comes in slices that overlap by a window less a byte."""
    for part in chunks(batches, "text", size):
        raw, at = text_bytes(part.column("text"))
        ids = part.column("_id").to_numpy(zero_copy_only=False)
        checks = np.empty(len(ids), CHECK)
        for half in CHECK.names:
            checks[half] = part.column(f"_{half}").to_numpy(zero_copy_only=False)
        if len(raw) <= 2 * size:
            yield ids, checks, raw, at, np.zeros(len(ids), np.int64), part
            continue
        for begin in range(0, len(raw) - WINDOW + 1, size):
            piece = raw[begin : begin + size + WINDOW - 1]
            yield ids, checks, piece, np.array([0, len(piece)]), np.array([begin]), part


def _send(buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets)
        for ids, checks, raw, at, offsets, part in _texts(batches, size):
            sender.add(ids, checks, raw, at, offsets, part.column("_anchors").to_pylist())
            if sender.size >= FLUSH:
                yield from sender.flush()
        yield from sender.flush()

    return run


def _anchor_of(raw: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The anchor of each stretch; one follows the other in `raw`."""
    anchors = np.empty(len(start), np.uint64)
    edge = np.searchsorted(start, np.arange(0, len(raw) + BLOCK, BLOCK))
    for i, j in zip(edge[:-1], edge[1:]):
        if i < j:
            first = start[i]
            grams = mixed(PrefixHash(raw[first : start[j - 1] + count[j - 1] + WINDOW - 1]).every(GRAM))
            bounds = np.c_[start[i:j] - first, start[i:j] - first + WINDOW - GRAM + 1].ravel()
            anchors[i:j] = np.minimum.reduceat(np.r_[grams, grams[-1:]], bounds)[::2]
    return anchors


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per flush, the spans that the windows of this bucket show to be repeated."""
    names, texts = [], []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            mark, name, rest = _parted(blob)
            if mark == b"T":
                names.append(name)
                texts.append(_unpack(rest, STRETCH_KINDS))
            else:
                yield _batch([bucket], [blob])
    if not texts:
        return
    documents = [len(x[0]) for x in texts]
    flush = np.repeat(np.arange(len(texts)), documents)
    ids, number = (np.concatenate([np.cumsum(x[i]) for x in texts]) for i in (0, 1))
    # The first stretch of a flush begins with its first document.
    owner = np.cumsum(np.concatenate([x[2] for x in texts]), dtype=np.int64) - 1
    place = np.concatenate([np.cumsum(x[3].astype(np.int64)) for x in texts])
    count, raw = (np.concatenate([x[i] for x in texts]) for i in (4, 5))
    texts.clear()
    owner, start, end = _repeated(raw, ids, owner, place, count.astype(np.int64))
    owner, start, end = merged_spans(owner, start, end)
    numbers, blobs = [], []
    for at, n in zip(*groups_of(flush[owner])):
        name, part = names[flush[owner[at]]], slice(at, at + n)
        numbers.append(_home(name))
        blobs.append(_spans(name, number[owner[part]], start[part], end[part]))
    if blobs:
        yield _batch(numbers, blobs)


def _repeated(raw, ids, owner, place, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of the spans of repeated windows among the stretches of a bucket."""
    length = count + WINDOW - 1
    start = np.cumsum(length) - length
    anchor, whole = _anchor_of(raw, start, count), _wholes(raw, start, count)
    doc = ids[owner]
    order, first, later = _settle(raw, anchor, whole, start, count, doc)
    gone = order[later]
    found = [(owner[gone], place[gone], place[gone] + count[gone] + WINDOW - 1)]
    # Of each class the first stretch stands for those of its document; anchors with two
    # classes of different documents are sorted window by window.
    stands = np.flatnonzero(first == np.arange(len(order)))
    head = order[stands]
    begin, size = groups_of(anchor[head])
    many = size > 1
    if len(begin):
        least = np.minimum.reduceat(doc[head], begin)
        most = np.maximum.reduceat(doc[head], begin)
        many &= least != most
    picked = ranges(begin[many], size[many])
    head, family = head[picked], np.repeat(np.arange(int(many.sum())), size[many])
    lost_class, lost_start = [], []
    windows = np.cumsum(np.r_[0, count[head]])
    edges, at = [0], 0
    family_end = np.flatnonzero(np.r_[family[1:] != family[:-1], True]) + 1 if len(family) else []
    for end in family_end:
        if windows[end] - windows[at] >= SORTED_AT_ONCE:
            edges.append(int(end))
            at = end
    if len(head) and edges[-1] != len(head):
        edges.append(len(head))
    for i, j in zip(edges[:-1], edges[1:]):
        h = head[i:j]
        n = count[h]
        length = n + WINDOW - 1
        local = raw[ranges(start[h], length)]
        base = np.cumsum(length) - length
        which = np.repeat(np.arange(len(h)), n)
        offset = ranges(np.zeros_like(n), n)
        # Equal windows have the anchor at the same offset.
        grams = _grams(local)
        at_anchor = np.flatnonzero(grams == np.repeat(anchor[h], length)[: len(grams)])
        begin_ = base[which] + offset
        kin = np.repeat(family[i:j], n) * WINDOW + at_anchor[np.searchsorted(at_anchor, begin_)] - begin_
        by_kin = np.argsort(kin, kind="stable")
        sorted_, equal = sort_suffixes(local, begin_[by_kin], kin[by_kin])
        sorted_ = by_kin[sorted_]
        begins = np.flatnonzero(~equal)
        d = doc[h][which[sorted_]]
        least = np.minimum.reduceat(d, begins)
        smaller = np.repeat(least, np.diff(np.r_[begins, len(d)])) < d
        lost = sorted_[smaller]
        lost_class.append(i + which[lost])
        lost_start.append(offset[lost])
    if lost_class:
        which, offset = np.concatenate(lost_class), np.concatenate(lost_start)
        c, s, e = merged_spans(which, offset, offset + WINDOW)
        # To all stretches of the class that belong to the document of its first one.
        class_of = np.full(len(order), -1, np.int64)
        class_of[stands[picked]] = np.arange(len(head))
        member = class_of[first]
        alive = np.flatnonzero((member >= 0) & ~later)
        alive = alive[np.argsort(member[alive], kind="stable")]
        m_first, m_size = groups_of(member[alive])
        at_class = np.zeros(len(head), np.int64)
        in_class = np.zeros(len(head), np.int64)
        at_class[member[alive[m_first]]], in_class[member[alive[m_first]]] = m_first, m_size
        times = in_class[c]
        who = order[alive[ranges(at_class[c], times)]]
        found.append((owner[who], place[who] + np.repeat(s, times), place[who] + np.repeat(e, times)))
    return tuple(np.concatenate(x) for x in zip(*found))


# --- the operator -----------------------------------------------------------------------


def _whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Widen removed bytes to the characters they belong to."""
    character = np.cumsum((text & 0xC0) != 0x80) - 1
    lost = np.zeros(int(character[-1]) + 1, bool)
    lost[character[gone]] = True
    return lost[character]


def _cut(batches: Iterator[pa.RecordBatch], characters: bool) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text", 16 << 20):
        raw, at = text_bytes(part.column("text"))
        kept, removed, spans = [], [], []
        for i, found in enumerate(part.column("_spans").to_pylist()):
            text = raw[at[i] : at[i + 1]]
            if not found:
                kept.append(text.tobytes())
                removed.append(0)
                spans.append([])
                continue
            s, e = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2).T
            if len(found) > 1:
                _, s, e = merged_spans(np.zeros(len(s), np.int64), s, e)
            mark = np.zeros(len(text) + 1, np.int8)
            mark[s] += 1
            mark[e] -= 1
            gone = np.cumsum(mark[:-1]) > 0
            kept.append(text[~(_whole_characters(text, gone) if characters else gone)].tobytes())
            removed.append(int((e - s).sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e)])
        rest = {n: part.column(n) for n in part.schema.names if n not in ("text", "_spans")}
        yield pa.RecordBatch.from_pydict(
            {
                **rest,
                "n_bytes": pa.array(np.diff(at), pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string() if characters else pa.binary()),
                "n_removed": pa.array(removed, pa.int64()),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )


NAMES = ["_id", *[f"_{half}" for half in CHECK.names]]


def _keyed(df: DataFrame, key: str, text: str) -> list:
    return [
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("_id"),
        *[c.alias(f"_{half}") for half, c in zip(CHECK.names, content_key(F.col(key), F.col(text)))],
        F.col(text).cast("binary").alias("text"),
    ]


def _repeated_spans(rows: DataFrame, buckets: int) -> DataFrame:
    """The spans to remove, a row per document that has any: `_id`, `_hash0`, `_hash1` (of the
    text), `_spans` (lists of pairs of 64-bit numbers: first byte and the byte behind the last; a
    document in several flushes has several)."""
    anchors = (
        rows.select(*NAMES, "text").mapInArrow(lean(_send_anchors(buckets, 4 << 20)), SENT).repartitionById(buckets, "bucket")
        .mapInArrow(lean(_shared_anchors(buckets)), SENT).repartitionById(buckets, "bucket")
        .mapInArrow(lean(_gathered(ANCHOR_KINDS)), FOUND)
        .groupBy(*NAMES).agg(F.collect_list("_values").alias("_anchors"))
    )
    # All columns, so that this join and that with the spans share one shuffle of the texts.
    sharing = rows.join(anchors.hint("shuffle_hash"), NAMES)
    return (
        sharing.mapInArrow(lean(_send(buckets, 4 << 20)), SENT).repartitionById(buckets, "bucket")
        .mapInArrow(lean(_compare), SENT).repartitionById(buckets, "bucket")
        .mapInArrow(lean(_gathered(SPAN_KINDS)), FOUND)
        .groupBy(*NAMES).agg(F.collect_list("_values").alias("_spans"))
    )


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", characters: bool = False
) -> DataFrame:
    """Cut every byte that lies in a 50-byte string which a smaller document has too.

    Returns all columns but the text and instead `n_bytes`, `kept` (the bytes that stay),
    `n_removed` and `removed` (maximal spans of bytes). Strings are judged on the input;
    matches do not cross documents; repeats inside one document stay. With `characters` the
    kept part is text instead of bytes: a character of which a byte goes, goes whole.

    A NULL text is empty. Rows without id count as greater than all others and as one
    document among themselves, as do rows that share an id. Texts of fewer than 50 bytes
    stay whole. Repeated rows are cut alike. An empty table gives no rows. Columns that
    would clash with the new ones are replaced.
    """
    rest = [c for c in df.columns if c not in (text, "n_bytes", "kept", "n_removed", "removed", *NAMES, "_spans")]
    rows = df.select(*_keyed(df, key, text), *[F.col(f"`{c}`") for c in rest])
    spans = _repeated_spans(rows, parts(df))
    joined = rows.join(spans.hint("shuffle_hash"), NAMES, "left").drop(*NAMES)
    same = [f for f in joined.schema.fields if f.name not in ("text", "_spans")]
    added = StructType.fromDDL(
        f"n_bytes bigint, kept {'string' if characters else 'binary'}, n_removed bigint, "
        "removed array<struct<start:bigint,end:bigint>>"
    )
    schema = StructType([*same, *added.fields])
    return joined.mapInArrow(lean(lambda batches: _cut(batches, characters)), schema)

