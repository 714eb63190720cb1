"""Near-duplicates by the Jaccard similarity of word shingles, found by parity sketches.

The sketch of a set has one bit for each possible shingle, cut into p pieces; each shingle
flips its bit. The Hamming distance of two sketches is at most the size of the symmetric
difference D of the sets, and so is the number of pieces that differ. A piece is kept as the XOR of the hashes of its shingles. Sets
of similarity 3/4 or more have |D| <= (|A| + |B|) / 7 and sizes in one band or two
neighbouring ones, so with more pieces than that they agree in one of them.

Per pair of neighbouring bands, p is chosen such that a set has more non-empty pieces than
|D| can be: it has `slack` pieces to spare. Sets without slack send their empty pieces too.
A piece that many sets share is hot. A set whose slack exceeds the number of its hot pieces
need not use them, as one of its other pieces must agree. The others, sets made of common
material, are compared among each other by smaller pieces, of one shingle each: linked sets
agree in one of the n/4 + 1 rarest shingles of either. Where all of these are common, sets
form families (that share such shingles), which are compared in blocks, by the Hamming
distance of sketches of a few thousand bits.

Pairs of small groups are counted; those that share fewer pieces than the bound demands are
out. Of the others, each set is first compared with one other, the least of its partners,
and links are joined to components; then only pairs that lie in different components are
left. Every link is confirmed by the sets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import chunks, content_key, groups_of, lean, mixed, parts, ranges, stored, text_bytes
from quillmesh.llm.components import components
from quillmesh.llm.shingles import set_fingerprints, shingle_sets, word_hashes

# A group of more sets than this is hot.
COLD = 16
# Text that a task gathers before it sends pieces off.
FLUSH = 16 << 20
# A shingle that more sets of common material share is common; sets of a block of a family.
RARE = 64
BLOCK = 1024
# Partners of one set that are compared in one task.
PARTNERS = 512
_MIX = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))

FOUND = (
    "kind int, doc_id bigint, hash0 bigint, hash1 bigint, n bigint, node bigint, slack0 int, slack1 int, "
    "key bigint, members array<bigint>, times bigint"
)
ROW, LIST, HOT = 0, 1, 2
KEY = ("hash0", "hash1")


# --- bands and pieces -------------------------------------------------------------------


@cache
def bands(most: int) -> np.ndarray:
    """First size of each band: sets of similarity 3/4 lie in one or two neighbours."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * 4 // 3))
    edges += [max(edges[-1] + 1, edges[-1] * 4 // 3)]
    edges += [max(edges[-1] + 1, edges[-1] * 4 // 3)]
    return np.array(edges, np.int64)


@cache
def pieces(top: int) -> int:
    """Pieces for sets of up to `top` shingles: more non-empty ones than can differ, and
    some to spare for hot ones."""
    wanted = (2 / 7 + 0.05) * top + 0.6 * top**0.5 + 1
    p = top // 3 + 1
    while p * (1 - np.exp(-top / p)) < wanted and p < 4 * top + 8:
        p += max(1, p // 64)
    return p


def sketch(h: np.ndarray, n: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """The pieces of sets, for the pair of bands where a set is in the lower (side 0) or
    upper (1) one: owner, key of each piece, and the slack of each set."""
    edges = bands(int(n.max()) if len(n) else 1)
    band = np.searchsorted(edges, n, "right") - 1
    pair = band - side
    valid = (n > 0) & (pair >= 0)
    top = np.where(valid, edges[np.clip(pair + 2, 0, len(edges) - 1)] - 1, 1)
    values, back = np.unique(top, return_inverse=True)
    p = np.array([pieces(int(t)) for t in values], np.int64)[back]
    owner = np.repeat(np.arange(len(n)), n)
    piece = ((h >> np.uint64(32)) * p[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])
    starts = np.flatnonzero(new)
    parity = np.bitwise_xor.reduceat(mixed(h ^ _MIX[0]), starts) if len(starts) else h[:0]
    who, piece = owner[starts], piece[starts]
    q = np.bincount(who, minlength=len(n))
    differ = (n + np.minimum(4 * n // 3, top)) // 7
    slack = q - differ
    # Sets without slack send their empty pieces as well.
    bare = np.flatnonzero(valid & (slack <= 0))
    if len(bare):
        all_who, all_piece = np.repeat(bare, p[bare]), ranges(np.zeros(len(bare), np.int64), p[bare])
        width = int(p.max()) + 1
        empty = ~np.isin(all_who * width + all_piece, who * width + piece)
        who, piece = np.r_[who, all_who[empty]], np.r_[piece, all_piece[empty]]
        parity = np.r_[parity, np.zeros(int(empty.sum()), np.uint64)]
    use = valid[who]
    who, piece, parity = who[use], piece[use], parity[use]
    place = (pair[who].astype(np.uint64) + np.uint64(1)) * _MIX[0] + (piece.astype(np.uint64) + np.uint64(1)) * _MIX[1]
    return who, mixed(parity ^ mixed(place)), slack


# --- sending and grouping ---------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(columns)}q", *[c.nbytes for c in columns])
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.tobytes() for c in columns))


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, found = struct.unpack_from(f"<{len(kinds)}q", data), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        found.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return found


ROW_KINDS = (np.int64, np.uint8, np.int64, np.int64, np.int64, np.uint64, np.int32, np.int32)
PIECE_KINDS = (np.uint64, np.int32, np.uint8, np.uint8)
# Bytes of a piece's key that are sent; what falls together is told apart by the sets.
KEY_BYTES = 5


def _batch(buckets: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array(buckets, pa.int32()), "blob": pa.array(blobs, pa.binary())}
    )


def _send(buckets: int):
    """Per bucket the pieces of the sets of some texts; equal sets are sent once."""

    def flush(rows: list, sent: list) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*rows)]
        yield _batch([int(columns[5][0] % np.uint64(buckets))], [b"R" + _pack(*columns)])
        node = np.concatenate([x[0] for x in sent])
        shift = np.cumsum([0, *[len(x[0]) for x in sent]])
        who = np.concatenate([x[1] + s for x, s in zip(sent, shift)])
        side, key = (np.concatenate([x[i] for x in sent]) for i in (2, 3))
        bucket = (mixed(key) >> np.uint64(24)) % np.uint64(buckets)
        order = np.lexsort((who, bucket))
        who, side, key, bucket = who[order], side[order], key[order], bucket[order]
        numbers, blobs = [], []
        for at, n in zip(*groups_of(bucket)):
            part = slice(at, at + n)
            used, local = np.unique(who[part], return_inverse=True)
            low = np.ascontiguousarray(key[part].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            numbers.append(int(bucket[at]))
            blobs.append(
                b"P" + _pack(
                    node[used], np.diff(local, prepend=0).astype(np.int32), side[part],
                    np.ascontiguousarray(low).ravel(),
                )
            )
            if len(blobs) >= 512:
                yield _batch(numbers, blobs)
                numbers, blobs = [], []
        if blobs:
            yield _batch(numbers, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sent, size, seen = [], [], 0, np.empty(0, np.uint64)
        for part in chunks(batches, "text"):
            raw, at = text_bytes(part.column("text"))
            h, n = shingle_sets(*word_hashes(raw, at))
            node = set_fingerprints(h, n)
            # One of each set that this flush has not sent yet.
            _, first = np.unique(node, return_index=True)
            first = np.sort(first[(n[first] > 0) & ~np.isin(node[first], seen)])
            own = ranges((np.cumsum(n) - n)[first], n[first])
            who0, key0, slack0 = sketch(h[own], n[first], 0)
            who1, key1, slack1 = sketch(h[own], n[first], 1)
            sent.append((
                node[first], np.r_[who0, who1],
                np.r_[np.zeros(len(who0), np.uint8), np.ones(len(who1), np.uint8)], np.r_[key0, key1],
            ))
            seen = np.r_[seen, node[first]]
            slacks = np.zeros((2, len(n)), np.int32)
            place = {int(x): i for i, x in enumerate(node[first])}
            where = np.array([place.get(int(x), -1) for x in node], np.int64)
            has = where >= 0
            slacks[0, has], slacks[1, has] = slack0[where[has]], slack1[where[has]]
            ids = part.column("doc_id")
            rows.append((
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).view(np.uint8),
                *[part.column(c).to_numpy(zero_copy_only=False) for c in ("hash0", "hash1")], n.astype(np.int64), node,
                slacks[0], slacks[1],
            ))
            size += len(raw)
            if size >= FLUSH:
                yield from flush(rows, sent)
                rows, sent, size, seen = [], [], 0, np.empty(0, np.uint64)
        if rows:
            yield from flush(rows, sent)

    return run


def _found(kind: int, rows: int, **columns) -> pa.RecordBatch:
    def column(name: str, t: pa.DataType):
        return columns.get(name, pa.nulls(rows, t))

    types = {
        "doc_id": pa.int64(), "hash0": pa.int64(), "hash1": pa.int64(), "n": pa.int64(), "node": pa.int64(), "slack0": pa.int32(),
        "slack1": pa.int32(), "key": pa.int64(), "members": pa.list_(pa.int64()), "times": pa.int64(),
    }
    return pa.RecordBatch.from_pydict(
        {"kind": pa.array(np.full(rows, kind, np.int32)), **{k: column(k, t) for k, t in types.items()}}
    )


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that passed through, and the groups of sets with an equal piece.

    Small groups come as lists of members (equal lists once, with how often they were seen),
    hot ones as one row per member.
    """
    found = []
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            if blob[:1] == b"R":
                ids, null, hash0, hash1, n, node, slack0, slack1 = _unpack(blob[1:], ROW_KINDS)
                yield _found(
                    ROW, len(ids), doc_id=pa.array(ids, mask=null.astype(bool)), hash0=pa.array(hash0), hash1=pa.array(hash1),
                    n=pa.array(n), node=pa.array(node.view(np.int64)), slack0=pa.array(slack0), slack1=pa.array(slack1),
                )
                continue
            node, local, side, low = _unpack(blob[1:], PIECE_KINDS)
            wide = np.zeros((len(local), 8), np.uint8)
            wide[:, :KEY_BYTES] = low.reshape(-1, KEY_BYTES)
            found.append((node.view(np.int64)[np.cumsum(local)], wide.view("<i8").ravel(), side))
    if not found:
        return
    node, key, side = (np.concatenate(x) for x in zip(*found))
    found.clear()
    order = np.lexsort((node, key))
    node, key, side = node[order], key[order], side[order]
    # A set may be sent by several tasks.
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    node, key, side = node[new], key[new], side[new]
    bucket = TaskContext.get().partitionId()
    begin, size = groups_of(key)
    for at, n in zip(begin[size > COLD], size[size > COLD]):
        part = slice(at, at + n)
        yield _found(
            HOT, n, node=pa.array(node[part]), key=pa.array(key[part] + (bucket << 8 * KEY_BYTES)),
            n=pa.array(side[part].astype(np.int64)),
        )
    small = (size > 1) & (size <= COLD)
    begin, size = begin[small], size[small]
    if not len(begin):
        return
    members = node[ranges(begin, size)]
    starts = np.cumsum(size) - size
    prints = np.add.reduceat(mixed(members.view(np.uint64)), starts)
    order = np.lexsort((prints, size))
    first = np.ones(len(order), bool)
    first[1:] = (prints[order][1:] != prints[order][:-1]) | (size[order][1:] != size[order][:-1])
    one = np.flatnonzero(first)
    times = np.diff(np.r_[one, len(order)])
    pick = order[one]
    for i in range(0, len(pick), 8192):
        p = pick[i : i + 8192]
        lists = pa.ListArray.from_arrays(
            np.r_[0, np.cumsum(size[p])].astype(np.int32), pa.array(members[ranges(starts[p], size[p])])
        )
        yield _found(LIST, len(p), members=lists, times=pa.array(times[i : i + 8192]))


# --- comparing --------------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of some texts; rows repeated in full lie in one partition and come once."""
    seen: set[int] = set()
    for part in chunks(batches, "text"):
        nodes = part.column("node").to_pylist()
        new = [not (x in seen or seen.add(x)) for x in nodes]
        part = part.filter(pa.array(new, pa.bool_()))
        raw, at = text_bytes(part.column("text"))
        h, n = shingle_sets(*word_hashes(raw, at))
        ends = np.cumsum(n)
        yield pa.RecordBatch.from_pydict({
            "node": part.column("node"),
            "hashes": pa.array([h[e - k : e].tobytes() for e, k in zip(ends, n)], pa.binary()),
            "sketch": pa.array([_bits([h[e - k : e]])[0].tobytes() for e, k in zip(ends, n)], pa.binary()),
        })


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the linked pairs of this partition connect; their sets are in the partition too."""
    sets, pairs = {}, []
    for batch in batches:
        a, b, hashes = (batch.column(c).to_pylist() for c in ("a", "b", "hashes"))
        for x, y, z in zip(a, b, hashes):
            if z is None:
                pairs.append((x, y))
            else:
                sets[x] = np.frombuffer(z, np.uint64)
    linked = []
    for x, y in pairs:
        one, two = sets[x], sets[y]
        if 4 * min(len(one), len(two)) < 3 * max(len(one), len(two)):
            continue
        both = len(np.intersect1d(one, two, assume_unique=True))
        if 100 * both >= 75 * (len(one) + len(two) - both):
            linked.append((x, y))
    linked = _stars(linked)
    for i in range(0, len(linked), 65536):
        a, b = zip(*linked[i : i + 65536])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of this partition whose sketches allow a link: the Hamming distance is not
    above what linked sets can differ in. Sketches are given as size of the set and bits."""
    sketches, pairs = {}, []
    for batch in batches:
        a, b, bits = (batch.column(c).to_pylist() for c in ("a", "b", "hashes"))
        for x, y, z in zip(a, b, bits):
            if z is None:
                pairs.append((x, y))
            else:
                sketches[x] = (int.from_bytes(z[:8], "big"), np.frombuffer(z, np.uint8, offset=8))
    kept = []
    for x, y in pairs:
        (n, one), (m, two) = sketches[x], sketches[y]
        if len(one) != len(two):
            one, two = (_folded(s, min(len(one), len(two))) for s in (one, two))
        if 7 * int(np.bitwise_count(one ^ two).sum(dtype=np.int64)) <= n + m:
            kept.append((x, y))
    for i in range(0, len(kept), 65536):
        a, b = zip(*kept[i : i + 65536])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch of `size` bytes that the set of a longer sketch has: a bit of it stands
    for neighbouring bits of the longer one."""
    while len(bits) > size:
        pairs = np.unpackbits(bits).reshape(-1, 2)
        bits = np.packbits(pairs[:, 0] ^ pairs[:, 1])
    return bits


def _linked(pairs: DataFrame, sets: DataFrame, count: int) -> DataFrame:
    """Pairs (a, b) that connect what the linked ones of the given pairs do.

    Sketches, a sixteenth of the sets, are compared first; sets only where these allow it.
    """
    size = F.lpad(F.hex((F.length("hashes") / 8).cast("bigint")), 16, "0")
    sketches = sets.select("node", F.concat(F.unhex(size), "sketch").alias("hashes"))
    near = stored(_together(pairs, sketches, count, _near), "near")
    return _together(near, sets.select("node", "hashes"), count, _confirm)


def _together(pairs: DataFrame, sets: DataFrame, count: int, compare) -> DataFrame:
    """Compare pairs in tasks that have what is known of their sets. Each set goes once to
    each task that needs it; the partners of a set with very many are dealt to several
    tasks."""
    crowd = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).alias("_parts"))
    dealt = pairs.join(crowd, "a").select(
        "a", "b", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("_parts"))), F.lit(count)).cast("int").alias("_task")
    )
    dealt = stored(dealt, "pairs")
    needed = dealt.select("_task", F.col("a").alias("node")).unionByName(
        dealt.select("_task", F.col("b").alias("node"))
    ).distinct()
    carried = needed.join(sets, "node").select(
        "_task", F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "hashes"
    )
    rows = carried.unionByName(dealt.withColumn("hashes", F.lit(None).cast("binary")))
    return rows.repartitionById(count, "_task").select("a", "b", "hashes").mapInArrow(lean(compare), "a bigint, b bigint")


def _needs(by_node: DataFrame, hot: DataFrame) -> DataFrame:
    """Per set its size, the fewest cold pieces it shares with any linked set, and whether
    all the pieces that must agree may be hot."""
    counts = hot.groupBy("node").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("_hot0"), F.count(F.when(F.col("side") == 1, 1)).alias("_hot1")
    )
    left = [F.col(f"slack{i}") - F.coalesce(f"_hot{i}", F.lit(0)) for i in (0, 1)]
    return by_node.join(counts, "node", "left").select(
        "node", "n", F.greatest(F.lit(1), F.least(*left)).alias("_need"),
        F.greatest(*[(x <= 0) & F.col(f"_hot{i}").isNotNull() & (F.col(f"_hot{i}") > 0) for i, x in enumerate(left)]).alias("_unsafe"),
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _plausible(lists: DataFrame, needs: DataFrame) -> DataFrame:
    """Pairs of sets of one list whose sizes and shared pieces allow a link."""
    each = lists.select("times", "members", F.explode("members").alias("a"))
    pairs = each.select("times", "a", F.explode(F.filter("members", lambda m: m > F.col("a"))).alias("b"))
    seen = pairs.groupBy("a", "b").agg(F.sum("times").alias("seen"))

    def side(name: str) -> DataFrame:
        return needs.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("_need").alias(f"need_{name}"))

    return (
        seen.join(side("a"), "a").join(side("b"), "b")
        .filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b) AND seen >= greatest(need_a, need_b)")
        .select("a", "b")
    )


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components."""
    for name in ("a", "b"):
        told = labels.select(F.col("node").alias(name), F.col("label").alias(f"_{name}"))
        pairs = pairs.join(told, name, "left").withColumn(f"_{name}", F.coalesce(f"_{name}", name))
    return pairs.filter("_a <> _b").select("a", "b")


# --- sets made of common material -------------------------------------------------------


def _spread_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            raw, ends = text_bytes(part.column("hashes"))
            n = np.diff(ends) // 8
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(np.repeat(part.column("node").to_numpy(), n)),
                "shingle": pa.array(np.frombuffer(raw.tobytes(), np.int64)),
            })


def _rarest(sets: DataFrame) -> DataFrame:
    """(node, n, at, shared, shingle): the rarest n - ceil(3n/4) + 1 shingles of each set
    that other sets have too, with their place in the order of rarity."""
    each = sets.mapInArrow(lean(_spread_shingles), "node bigint, shingle bigint")
    counts = stored(
        each.groupBy("shingle").agg(F.count(F.lit(1)).alias("shared")).filter("shared > 1"), "shingles"
    )
    ranked = (
        each.join(counts, "shingle", "left")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("shared", F.lit(1)).alias("shared"), "shingle"))).alias("all"))
        .withColumn("n", F.size("all"))
    )
    first = F.slice("all", 1, F.col("n") - F.ceil(F.col("n") * 3 / 4).cast("int") + 1)
    return ranked.select("node", "n", F.posexplode(first).alias("at", "s")).select(
        "node", "n", "at", F.col("s")["shared"].alias("shared"), F.col("s")["shingle"].alias("shingle")
    ).filter("shared > 1")


def _rare_pairs(rarest: DataFrame) -> DataFrame:
    """Pairs that agree in a rare shingle, where sizes and what follows it allow a link."""
    member = F.struct("node", "n", "at")
    groups = (
        rarest.filter(F.col("shared") <= RARE).groupBy("shingle").agg(F.collect_list(member).alias("ms"))
    )

    def fit(m: Column) -> Column:
        x = F.col("x")
        # The first shingle in common is at most in these places if enough can follow it.
        rest = F.least(m["n"] - m["at"], x["n"] - x["at"])
        return (
            (m["node"] > x["node"]) & (4 * F.least(m["n"], x["n"]) >= 3 * F.greatest(m["n"], x["n"]))
            & (7 * rest >= 3 * (m["n"] + x["n"]))
        )

    pairs = groups.select("ms", F.explode("ms").alias("x")).select("x", F.explode(F.filter("ms", fit)).alias("y"))
    return pairs.select(F.col("x")["node"].alias("a"), F.col("y")["node"].alias("b")).distinct()


def _families(rarest: DataFrame) -> DataFrame:
    """(family, block, blocks, node) of the sets whose rarest shingles are common."""
    common = rarest.filter(F.col("shared") > RARE)
    edges = common.select(F.xxhash64(F.lit("shingle"), "shingle").alias("a"), F.col("node").alias("b"))
    labels = components(edges).withColumnRenamed("label", "family")
    found = stored(labels.join(common.select("node").distinct(), "node"), "families")
    sizes = stored(
        found.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")), "families"
    )
    return stored(
        found.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "families"
    )


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches of sets, of one size: each shingle flips one bit."""
    size = 1 << max(10, int(4 * max(map(len, sets))).bit_length())
    size = min(size, 1 << 16)
    shift = np.uint64(64 - (size.bit_length() - 1))
    rows = np.zeros((len(sets), size // 64), np.uint64)
    for row, h in zip(rows, sets):
        odd = np.bincount((mixed(h) >> shift).astype(np.int64), minlength=size).astype(np.uint8) & 1
        row[:] = np.packbits(odd).view(np.uint64)
    return rows


def _block_links(nodes: list[int], sets: list[np.ndarray], query: list[bool], labels: list[int]) -> list[tuple[int, int]]:
    """Links between sets of a block, as many as join what is linked (no more).

    Only sets marked as queries are compared, with sets whose label differs.
    """
    numbers: dict[int, int] = {}
    root = np.array([numbers.setdefault(x, len(numbers)) for x in labels], np.int64)
    n = np.array([len(x) for x in sets], np.int64)
    sketches, found = _bits(sets), []
    for i in np.flatnonzero(query):
        other = (root != root[i]) & (4 * np.minimum(n, n[i]) >= 3 * np.maximum(n, n[i]))
        near = np.flatnonzero(other)
        distance = np.bitwise_count(sketches[near] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        for j in near[7 * distance <= n[near] + n[i]]:
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                root[root == root[j]] = root[i]
                found.append((nodes[i], nodes[j]))
    return _stars(found)


def _stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that connect the same, each with the least of its component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return [(find(x), x) for x in list(parent) if find(x) != x]


def _confirm_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each block of the partition; the rows of a block come together."""

    def links() -> Iterator[tuple[int, int]]:
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("work", "node", "label", "query", "hashes")]
            for work, *row in zip(*columns):
                if work != now and rows:
                    yield from compare(rows)
                    rows = []
                now = work
                rows.append(row)
        if rows:
            yield from compare(rows)

    def compare(rows: list) -> list[tuple[int, int]]:
        known = {}
        for node, label, query, hashes in rows:
            known[node] = (label, query or (node in known and known[node][1]), hashes)
        sets = [np.frombuffer(h, np.uint64) for _, _, h in known.values()]
        return _block_links(list(known), sets, [q for _, q, _ in known.values()], [x for x, _, _ in known.values()])

    found = list(links())
    for i in range(0, len(found), 65536):
        a, b = zip(*found[i : i + 65536])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _work(rows: DataFrame, sets: DataFrame, count: int) -> DataFrame:
    """Compare the rows (work, node, label, query) of each piece of work."""
    carried = rows.join(sets.select("node", "hashes"), "node").withColumn("_task", F.pmod(F.xxhash64("work"), F.lit(count)).cast("int"))
    return (
        carried.repartitionById(count, "_task").sortWithinPartitions("work")
        .select("work", "node", "label", "query", "hashes").mapInArrow(lean(_confirm_blocks), "a bigint, b bigint")
    )


def _family_links(rarest: DataFrame, sets: DataFrame, count: int) -> DataFrame:
    """Links inside families, as many as join what is linked.

    First each block by itself and against the first one; then, of families that are not
    one component yet, the sets outside of the largest component against all other blocks.
    """
    families = _families(rarest)
    work = F.concat_ws(":", "family", "first", "block")
    own = families.select("family", "block", "node", F.col("block").alias("first"))
    with_first = families.filter("block = 0 AND blocks > 1").select(
        "family", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("block"), "node"
    ).select("family", "block", "node", F.col("block").alias("first"))
    rows = own.unionByName(with_first).select(work.alias("work"), "node", F.col("node").alias("label"), F.lit(True).alias("query"))
    links = stored(_work(rows, sets, count), "family-links")
    if families.filter("blocks > 2").isEmpty():
        return links
    told = stored(
        families.filter("blocks > 2").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")),
        "families",
    )
    main = stored(
        told.groupBy("family", "label").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("family").agg(F.max_by("label", "_n").alias("_main"), F.count(F.lit(1)).alias("_labels"))
        .filter("_labels > 1").select("family", "_main"),
        "families",
    )
    told = told.join(main, "family")
    others = F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))
    queries = told.filter("label <> _main AND block > 0").select(
        "family", F.col("block").alias("first"), others.alias("block"), "node", "label", F.lit(True).alias("query")
    )
    targets = told.filter("block > 0").select(
        "family", others.alias("first"), "block", "node", "label", F.lit(False).alias("query")
    )
    rows = queries.unionByName(targets).filter("first <> block").select(work.alias("work"), "node", "label", "query")
    return links.unionByName(stored(_work(rows, sets, count), "family-links"))


def link_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `hash0`, `hash1` (of the text), `n_shingles`, `component_id`.

    Documents link when their sets of five-word shingles have a Jaccard similarity of 0.75
    or more; `component_id` is the smallest id that a document reaches by links. Words are
    separated by blanks and compared with A-Z in lower case; a text of one to four words is
    one shingle.

    A NULL or blank text has no shingles and links with nothing: its component is itself.
    Rows without id link like others but lend no id; a component without any id has NULL.
    Rows that share an id are judged each by its text. Repeated rows are linked. Other
    columns are ignored. An empty table gives no rows.
    """
    return _labelled(df, key, text).drop("_label")


def _labelled(df: DataFrame, key: str, text: str) -> DataFrame:
    """`link_documents` with the `_label` of each component, also of those without ids; NULL
    for rows without shingles."""
    docs = df.select(
        F.col(key).cast("bigint").alias("doc_id"), *content_key(F.col(key), F.col(text)), F.col(text).cast("binary").alias("text")
    )
    count = parts(df)
    sent = docs.mapInArrow(lean(_send(count)), "bucket int, blob binary")
    found = stored(sent.repartitionById(count, "bucket").mapInArrow(lean(_group), FOUND), "pieces")
    rows = found.filter(F.col("kind") == ROW).select("doc_id", *KEY, "n", "node", "slack0", "slack1")
    full = rows.filter("n > 0")
    lists = found.filter(F.col("kind") == LIST).groupBy("members").agg(F.sum("times").alias("times"))
    hot = found.filter(F.col("kind") == HOT).select("node", "key", F.col("n").alias("side"))
    by_node = full.groupBy("node").agg(*[F.max(c).alias(c) for c in ("n", "slack0", "slack1")])
    needs = stored(_needs(by_node, hot), "needs")
    unsafe = needs.filter(F.coalesce("_unsafe", F.lit(False))).select("node")
    plausible = stored(_plausible(lists, needs), "plausible")
    nodes = (
        plausible.select(F.col("a").alias("node")).unionByName(plausible.select(F.col("b").alias("node")))
        .unionByName(unsafe).distinct()
    )
    none = F.lit(2**63 - 1)
    chosen = (
        full.groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", none).alias("_id"), *KEY)).alias("_d"))
        .join(nodes, "node", "left_semi")
        .select("node", *[F.col("_d")[c].alias(c) for c in ("_id", *KEY)])
    )
    texts = docs.select(F.coalesce("doc_id", none).alias("_id"), *KEY, "text").join(
        chosen.hint("shuffle_hash"), ["_id", *KEY]
    )
    sets = stored(texts.select("node", "text").mapInArrow(lean(_sets), "node bigint, hashes binary, sketch binary"), "sets")

    rarest = stored(_rarest(sets.select("node", "hashes").join(unsafe, "node", "left_semi")), "rarest")
    pairs = plausible.unionByName(stored(_rare_pairs(rarest), "pairs"))
    stars = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _linked(stars, sets, count).unionByName(_family_links(rarest, sets, count))
    labels = stored(components(links), "labels")
    rest = _crossing(pairs, labels)
    more = stored(_linked(_ordered(rest), sets, count), "links")
    if not more.isEmpty():
        known = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
        labels = stored(components(known.unionByName(more)), "labels")

    least = full.groupBy("node").agg(F.min("doc_id").alias("_least"))
    named = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "classes")
    component = named.groupBy("label").agg(F.min("_least").alias("component_id"))
    by_node = stored(named.join(component, "label").select("node", "component_id", "label"), "classes")
    linked = full.join(by_node, "node").select("doc_id", *KEY, F.col("n").alias("n_shingles"), "component_id", F.col("label").alias("_label"))
    alone = rows.filter("n = 0").select(
        "doc_id", *KEY, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(None).cast("bigint").alias("_label"),
    )
    return linked.unionByName(alone)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which no smaller one is in their component, with all their columns.

    Rows that agree in id and text count as one document. Components are told apart by their
    links, not by their ids: of unrelated texts that share an id, or have none, all stay. In a
    component without ids the rows of one text stay.
    """
    none = F.lit(2**63 - 1)
    names = ["_k", *[f"_{c}" for c in KEY]]
    linked = _labelled(df, key, text).withColumn("_k", F.coalesce("doc_id", none)).withColumnsRenamed({c: f"_{c}" for c in KEY})
    # Of the rows with the least id of a component, those of the least text.
    heads = (
        linked.filter("n_shingles > 0 AND doc_id <=> component_id").groupBy("_label")
        .agg(F.min(F.struct(*names)).alias("_d")).select("_d.*")
        .unionByName(linked.filter("n_shingles = 0").select(*names)).distinct()
    )
    marked = df.select("*", F.coalesce(F.col(key).cast("bigint"), none).alias("_k"), *[
        c.alias(f"_{n}") for n, c in zip(KEY, content_key(F.col(key), F.col(text)))
    ])
    return marked.dropDuplicates(names).join(heads, names, "left_semi").drop(*names)
