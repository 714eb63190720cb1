import base64
import hashlib
import random

import pytest
import public_tokenizers
import tiktoken
from brute import ordered

from quillmesh.llm import bpe
from quillmesh.llm.queries import QUERIES, vocabulary

PATH, PATTERN = vocabulary()
RANKS = bpe.read_ranks(PATH)
BYTES = [0x20, 0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0, 0xF4, 0x90]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer(PATH, PATTERN)


def test_random_texts(library, ours):
    rng = random.Random(2)
    signs = "aeéßñ 日本語中文ไทย😀 \n\t'st0123!!-- \x00"
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert ours.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 500, "a" * 3000, "\n" * 777 + "x", "é" * 999, "ab" * 2000, "0" * 100, "日本" * 500, "", "<|endoftext|>"])
def test_long_pieces(library, ours, text):
    assert ours.encode(text) == library.encode_ordinary(text)


def test_pairs_that_fit(ours):
    rng = random.Random(3)
    tokens = sorted(RANKS)
    machine = ours.transducer
    for _ in range(5000):
        a = rng.choice(tokens)
        b = rng.choice([x for x in (a[:2], a[-2:], a[-1:], rng.choice(tokens)) if x in RANKS])
        assert machine.fits(RANKS[a], RANKS[b]) == (machine.merge(a + b) == [a, b])


def test_small_table_of_states(ours, monkeypatch):
    """Begun anew again and again, the transducer still gives the same tokens."""
    monkeypatch.setattr(bpe, "STATES", 20)
    fresh = bpe.Transducer(RANKS)
    text = "Étion dans çouelle un éonierç antidisestablishmentarianism".encode()
    assert list(fresh.stream(text)) == list(ours.transducer.stream(text))
    for _ in range(3):
        assert list(fresh.encode(text)) == list(ours.transducer.stream(text))


def test_read_ahead_and_determinised(library):
    """The first reading makes no states, later ones follow arcs, with the same tokens."""
    fresh = bpe.Transducer(RANKS)
    pieces = [w.encode() for w in " the internationalisation ouéaieuxlepa zuverberheit 12345 élèves".split(" ")]
    expected = [tuple(library.encode_ordinary(p.decode())) for p in pieces]
    rounds = [[fresh.encode(p) if p not in RANKS else tuple(fresh.stream(p)) for p in pieces] for _ in range(12)]
    assert all(r == expected for r in rounds) and len(fresh.arcs) > 20


def test_frequent_pieces_stay(ours, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 4)
    pieces = bpe._Pieces(ours.transducer)
    for word in "a b c d e a f g h a".split():
        assert pieces[word] == tuple(ours.encode(word))
    assert len(pieces) <= 4 and "a" in pieces


def test_tokens_come_early(ours):
    """A token is emitted before the text has ended: the lookahead is bounded."""
    longest = max(map(len, RANKS))
    read = 0

    def reading():
        nonlocal read
        for byte in b"the quick brown fox jumps over it " * 40:
            read += 1
            yield byte

    done = 0
    for token in ours.transducer.stream(reading()):
        assert read - done <= 2 * longest
        done += len(ours.transducer.tokens[token])


def test_streaming_decoder(ours):
    rng = random.Random(4)
    for _ in range(3000):
        data = bytes(rng.choice(BYTES) for _ in range(rng.randrange(14)))
        decoder = bpe.StreamingDecoder(ours.transducer.tokens)
        text = "".join(decoder.feed([RANKS[data[i : i + 1]]]) for i in range(len(data))) + decoder.finish()
        assert text == data.decode(errors="replace")


def test_rank_file(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    assert bpe.Tokenizer(str(path), r".+").encode("hé") == [104, 195, 169]


def test_query(spark, sf_dir, library):
    expected = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((r.doc_id, len(ids), digest, hashlib.sha256(r.text.encode()).hexdigest()))
    assert ordered(QUERIES["op5_byte_bpe"](spark, sf_dir).collect()) == ordered(expected)


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "hé", "c")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH).collect()
    assert [(r.doc_id, r.decoded, len(r.ids)) for r in rows][:2] == [(1, "", 0), (2, "", 0)]
    assert rows[2].decoded == "hé"
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


def test_reading_ahead_asks_little(library, monkeypatch):
    """A piece that is read ahead asks for its own pairs of tokens and few more, whatever its bytes."""
    fresh = bpe.Transducer(RANKS)
    pieces = [w.encode() for w in " internationalisation zuverberheit ouéaieuxlepa antidisestablishmentarianism".split(" ") if w]
    asked, fits = [], fresh.fits
    monkeypatch.setattr(fresh, "fits", lambda a, b: asked.append((a, b)) or fits(a, b))
    found = [fresh._ahead(0, p) for p in pieces]
    assert found == [tuple(library.encode_ordinary(p.decode())) for p in pieces]
    assert len(asked) <= 2 * sum(map(len, found))


def test_reading_ahead_goes_back(ours):
    """Also where the longest token leads nowhere, and from every state."""
    rng, machine = random.Random(5), ours.transducer
    for n, signs in ((400, "abcdeinrst"), (300, "aé日😀 '\n"), (20, "a")):
        for _ in range(n):
            text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))).encode()
            state, cut, before = 0, rng.randrange(len(text)), ()
            for byte in text[:cut]:
                arc = machine.arcs.get(state << 8 | byte) or machine._arc(state, byte)
                state, before = arc[0], before + arc[1]
            assert before + machine._ahead(state, text[cut:]) == tuple(machine.stream(text))


def test_no_search_for_cycles_while_texts_are_read():
    import gc

    seen = []
    list(bpe._uncollected(lambda batches: (seen.append(gc.isenabled()) or b for b in batches))(iter([1, 2])))
    assert seen == [False, False] and gc.isenabled()
