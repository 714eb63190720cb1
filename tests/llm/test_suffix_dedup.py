import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import ordered, repeats, sha
from pyspark.sql import functions as F

from quillmesh.llm import suffix_dedup
from quillmesh.llm.queries import QUERIES


def digests(df):
    cut = suffix_dedup.remove_repeats(df)
    return ordered(
        cut.select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).collect()
    )


def made(seed=1):
    rng = random.Random(seed)
    rows = [
        (3, None), (None, "a" * 300), (None, "a" * 200), (-5, "a" * 120), (7, ""), (7, "xyz" * 30), (7, "xyz" * 40),
        (8, "é" * 60), (9, "z" * 49), (10, "z" * 49), (11, "q" * 50), (12, "q" * 50), (12, "q" * 50),
    ]
    base = "".join(rng.choice("abc d") for _ in range(2000))
    for _ in range(60):
        a = rng.randrange(1900)
        b = a + rng.randrange(400)
        rows.append((rng.randrange(40), base[a:b] + "".join(rng.choice("abc d") for _ in range(rng.randrange(60)))))
    return rows


def test_made_texts(spark):
    rows = made()
    assert digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == repeats(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op6_suffix_dedup"](spark, sf_dir)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert ordered(found.select(columns).collect()) == repeats(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df).count() == 0
    df = spark.createDataFrame([(1, "x" * 60, 5, "k"), (2, "x" * 60, 6, "l")], "doc_id long, text string, kept int, other string")
    rows = suffix_dedup.remove_repeats(df).orderBy("doc_id").collect()
    assert [(r.other, bytes(r.kept)) for r in rows] == [("k", b"x" * 60), ("l", b"")]


def test_texts_of_equal_crc32(spark):
    """Spans of one text are not cut out of another."""
    rest = "".join(random.Random(4).choice("abc d") for _ in range(80))
    one, two = "plumless" + rest, "buckeroo" + rest
    assert zlib.crc32(one.encode()) == zlib.crc32(two.encode())
    rows = [(1, one), (None, one), (None, two), (5, two + " " + rest[::-1]), (5, one + " " + rest[::-1])]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == repeats(rows)


def test_whole_characters(spark):
    """A cut inside a character takes all of it, and only it."""
    shared = "é" * 25
    df = spark.createDataFrame([(1, "Ã" + shared), (2, "ü" + shared + "ß"), (3, "x")], "doc_id long, text string")
    plain = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    whole = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(df, characters=True).collect()}
    # The second byte of Ã differs from that of ü, so the shared bytes begin with the é.
    assert plain[2] == "üß".encode() and whole == {1: "Ã" + shared, 2: "üß", 3: "x"}
    text = np.frombuffer("aéb".encode(), np.uint8)
    gone = np.array([False, True, False, False])
    assert suffix_dedup._whole_characters(text, gone).tolist() == [False, True, True, False]


def test_long_text_in_slices():
    """Slices of a long text give the same stretches as the whole."""
    rng = random.Random(3)
    raw = np.frombuffer("".join(rng.choice("ab c") for _ in range(5000)).encode(), np.uint8)

    def windows(pieces):
        found = {}
        for begin, piece in pieces:
            anchor, start, count, _, _ = suffix_dedup._stretches(piece, np.array([0, len(piece)]))
            for a, s, n in zip(anchor, start, count):
                for i in range(n):
                    assert found.setdefault(int(begin + s + i), int(a)) == int(a)
        return found

    whole = windows([(0, raw)])
    sliced = windows([(b, raw[b : b + 700 + 49]) for b in range(0, len(raw) - 49, 700)])
    assert whole == sliced and len(whole) == len(raw) - 49


def texts_of(rows):
    return pa.RecordBatch.from_pydict({
        "_id": pa.array([suffix_dedup.NO_ID if d is None else d for d, _ in rows], pa.int64()),
        "_hash0": pa.array([zlib.crc32((t or "").encode()) for _, t in rows], pa.int64()),
        "_hash1": pa.array([0] * len(rows), pa.int64()),
        "text": pa.array([t and t.encode() for _, t in rows], pa.binary()),
    })


def dealt(batches, buckets):
    lying = {b: [] for b in range(buckets)}
    for batch in batches:
        for row in batch.to_pylist():
            lying[row["bucket"]].append(suffix_dedup._batch([row["bucket"]], [row["blob"]]))
    return lying


def after(lying, step):
    return [out for batches in lying.values() for out in step(iter(batches))]


def per_document(batches):
    found = {}
    for batch in batches:
        for r in batch.to_pylist():
            found.setdefault((r["_id"], r["_hash0"], r["_hash1"]), []).append(r["_values"])
    return found


def with_lists(batch, name, found):
    keys = zip(*(batch.column(c).to_pylist() for c in suffix_dedup.NAMES))
    return batch.append_column(name, pa.array([found.get(k) for k in keys], pa.list_(pa.binary())))


def test_documents_in_many_flushes(monkeypatch):
    """What comes back for several flushes of a document, or for slices of it, is put together."""
    monkeypatch.setattr(suffix_dedup, "FLUSH", 1500)
    rng = random.Random(8)
    words = "".join(rng.choice("abc d") for _ in range(3000))
    rows = [*made(), (20, words), (21, words[:1400]), (22, "x" * 60 + words[1300:2500]), (22, words[2000:]), (20, words)]
    buckets, tasks = 7, [rows[:30], rows[30:70], rows[70:]]
    texts = [texts_of(t) for t in tasks]
    anchors = dealt([out for t in texts for out in suffix_dedup._send_anchors(buckets, 700)(iter([t]))], buckets)
    lists = dealt(after(anchors, suffix_dedup._shared_anchors(buckets)), buckets)
    wanted = per_document(after(lists, suffix_dedup._gathered(suffix_dedup.ANCHOR_KINDS)))
    sharing = [with_lists(t, "_anchors", {k: wanted.get(k, []) for k in zip(*(t.column(c).to_pylist() for c in suffix_dedup.NAMES))}) for t in texts]
    stretches = dealt([out for t in sharing for out in suffix_dedup._send(buckets, 700)(iter([t]))], buckets)
    spans = dealt(after(stretches, suffix_dedup._compare), buckets)
    found = per_document(after(spans, suffix_dedup._gathered(suffix_dedup.SPAN_KINDS)))
    assert max(map(len, found.values())) > 1
    cut = [r for t in texts for out in suffix_dedup._cut(iter([with_lists(t, "_spans", found)]), False) for r in out.to_pylist()]
    assert ordered([
        (None if r["_id"] == suffix_dedup.NO_ID else r["_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), sha(r["kept"]))
        for r in cut
    ]) == repeats(rows)


def test_sent_bytes_by_number_of_buckets():
    """Documents that meet more buckets do not make more bytes to send."""
    rng = np.random.default_rng(6)
    texts = texts_of([(int(d), rng.integers(97, 123, 1500).astype(np.uint8).tobytes().decode()) for d in rng.integers(0, 2**60, 1500)])
    texts = texts.set_column(1, "_hash0", pa.array(rng.integers(0, 2**60, 1500)))

    def sent(buckets):
        return sum(len(b) for out in suffix_dedup._send_anchors(buckets, 4 << 20)(iter([texts])) for b in out.column("blob").to_pylist())

    assert sent(250) < 1.25 * sent(10)


def test_lost_documents_are_an_error():
    blob = b"S" + suffix_dedup.NAME.pack(0, b"x" * 16) + suffix_dedup._pack(*[np.zeros(1, np.int32)] * 3)
    with pytest.raises(RuntimeError, match="did not come"):
        list(suffix_dedup._gathered(suffix_dedup.SPAN_KINDS)(iter([suffix_dedup._batch([0], [blob])])))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_sort(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab") for _ in range(400)).encode()
    raw = np.frombuffer(text, np.uint8)
    starts = np.array([rng.randrange(len(text) - 20) for _ in range(150)])
    family = np.sort(np.array([rng.randrange(5) for _ in starts]))
    order, equal = suffix_dedup.sort_suffixes(raw, starts, family, length=20)
    keys = [(family[i], text[starts[i] : starts[i] + 20]) for i in order]
    assert keys == sorted(keys)
    assert equal.tolist() == [i > 0 and keys[i] == keys[i - 1] for i in range(len(keys))]


def test_large_family():
    """One family of very many suffixes costs about as much as sorting their bytes as numbers."""
    rng = np.random.default_rng(5)
    n, anchor = 60_000, np.frombuffer(b"the anchor of all texts.", np.uint8)
    text = np.c_[rng.integers(97, 101, (n, 13)), np.tile(anchor, (n, 1)), rng.integers(97, 99, (n, 13))].astype(np.uint8)
    raw, starts = text.ravel(), np.arange(n) * 50
    began = time.process_time()
    by = np.lexsort(np.pad(text, ((0, 0), (0, 6))).view(">u8").astype(np.uint64).T[::-1])
    plain, began = time.process_time() - began, time.process_time()
    order, equal = suffix_dedup.sort_suffixes(raw, starts, np.zeros(n, np.int64))
    took = time.process_time() - began
    assert (order == by).all()
    assert (equal[1:] == (text[by[1:]] == text[by[:-1]]).all(axis=1)).all() and not equal[0]
    assert took < 10 * plain + 0.05


def test_collisions_do_no_harm(monkeypatch):
    """Where all hashes are equal the order is found from the bytes."""
    monkeypatch.setattr(suffix_dedup.PrefixHash, "of", lambda self, a, n: np.zeros(len(a), np.uint64))
    raw = np.frombuffer(b"bcadbcabdabc", np.uint8)
    starts, family = np.array([0, 4, 1, 8, 2]), np.zeros(5, np.int64)
    order, equal = suffix_dedup.sort_suffixes(raw, starts, family, length=3)
    keys = [raw[s : s + 3].tobytes() for s in starts[order]]
    assert keys == sorted(keys) and equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_hash_of_kept():
    assert sha(b"") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
