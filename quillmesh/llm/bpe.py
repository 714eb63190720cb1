"""Byte-level BPE as a transducer that is built while it is used.

The tokens of a BPE encoding have a property that lets text be read once from left to
right: a sequence of tokens is an encoding if and only if each two neighbours are the
encoding of their own bytes. So each prefix of a text has exactly one possible last token,
and the encodings of all prefixes form a tree. A state of the transducer is what the future
depends on: the last token that is certain and the bytes after it. Reading a byte extends
the tree; what all branches that can still go on have in common is certain and emitted. A
branch can go on as long as its bytes begin a token, so the lookahead is bounded by the
longest token.

States and arcs are made when they are needed for the second time and kept (determinised
lazily), so that rare pieces do not fill the table; what has no arc yet is read without
making states. A table of more than STATES states is begun anew.
"""

from __future__ import annotations

import base64
import codecs
import gc
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmesh.llm.common import chunks, held, lean

# States of the transducer, arcs asked for once, pairs of tokens looked at, and encoded
# pieces, that a worker keeps.
STATES = 50_000
ASKED = 200_000
PAIRS = 400_000
PIECES = 300_000
# Bytes of a piece that is read as a stream.
LONG = 1000


def _node(tree: dict) -> tuple[int, dict | None]:
    """A node of the tree of tokens; they are as deep as the longest token, which is short."""
    token = tree.pop(-1, -1)
    for byte in tree:
        tree[byte] = _node(tree[byte])
    return token, tree or None


class Transducer:
    """Encodes bytes with a table of token ranks; merges are in the order of the ranks.

    A state is a number; `states` has of each the last certain token (-1 at the beginning),
    the bytes after it, per prefix of these the last token of its encoding, and the starts
    of tokens that may still go on, each with the children of its node in the tree of tokens. An arc
    leads from 256 * state + byte to a state and the tokens it emits.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        # Every way to put two tokens together, and the two whose merge makes a token.
        self.joins: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # The next shorter token that each token begins with.
        self.prefixes: dict[int, int] = {}
        # The tree of all tokens. A node is the token that ends in it (or -1) and its
        # children by byte, None where no token goes on.
        tree: dict = {}
        for token, rank in ranks.items():
            node = tree
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = rank
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.joins[left << 32 | right] = rank
        self.first = [_node(tree[byte]) if byte in tree else None for byte in range(256)]
        self.roots = {byte: node for byte, node in enumerate(self.first) if node is not None}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.rests: dict[int, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.asked: set[int] = set()
        self.state(-1, b"", (), ())

    def state(self, last: int, pending: bytes, ids: tuple, alive: tuple) -> int:
        number = self.numbers.setdefault((last, pending), len(self.states))
        if number == len(self.states):
            self.states.append((last, pending, ids, alive))
        return number

    def merge(self, text: bytes) -> list[bytes]:
        """The encoding of a few bytes by its definition: the pair of least rank, the first
        of equal ones, is merged until there is none."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The pair that the last merge of a token joins; None for a single byte."""
        if token not in self.halves:
            text, ranks = self.tokens[token], self.ranks
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of two tokens is these two tokens.

        The merges inside a and b take place by rank. Undo them from the last on: if at any
        time the parts that then touch could have merged before the next merge took place,
        they would have, and a and b are encoded otherwise.
        """
        joins, split = self.joins, self._split
        # What touches must not be merged before this rank is reached.
        until = 1 << 60
        while True:
            joined = joins.get(a << 32 | b)
            if joined is not None and joined < until:
                return False
            left, right = split(a), split(b)
            if left is None and right is None:
                return True
            # Of two merges the one of greater rank is undone first; on the left side a
            # merge of equal rank comes earlier than one on the right, so it is undone later.
            if right is None or (left is not None and a > b):
                until, a = a, left[1]
            else:
                # A merge on the border comes before one of equal rank to the right of it.
                until, b = b + 1, right[0]

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the arc of a state for a byte."""
        last, pending, ids, alive = self.states[state]
        end, going = len(pending), []
        token = self._longest(alive, ids, end, last, byte, going)
        pending += bytes((byte,))
        ids += (token,)
        # The certain part is what the ends that can go on have in common.
        size, common = self.size, end + 1
        for begin, _ in going:
            at = begin
            while at != common:
                if at > common:
                    at -= size[ids[at - 1]]
                else:
                    common -= size[ids[common - 1]]
            if not common:
                break
        emitted: tuple[int, ...] = ()
        if common:
            emitted = self._path(ids, common)
            last, pending, ids = ids[common - 1], pending[common:], ids[common:]
            going = [(begin - common, children) for begin, children in going]
        arc = self.state(last, pending, ids, tuple(going)), emitted
        self.arcs[state << 8 | byte] = arc
        return arc

    def _longest(self, alive: Sequence[tuple], ids: Sequence[int], end: int, last: int, byte: int, going: list) -> int:
        """The longest token that ends with a byte and fits what the encoding of the bytes before
        it ends with; the starts that can go on are added to `going`."""
        token, pairs = -1, self.pairs
        for begin, children in alive:
            node = children.get(byte)
            if node is None:
                continue
            found, onward = node
            if token < 0 <= found:
                before = ids[begin - 1] if begin else last
                pair = before << 32 | found
                fits = before < 0 or pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.fits(before, found)
                if fits:
                    token = found
            if onward is not None:
                going.append((begin, onward))
        node = self.first[byte]
        if node is not None:
            found, onward = node
            if token < 0 <= found:
                before = ids[end - 1] if end else last
                pair = before << 32 | found
                fits = before < 0 or pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.fits(before, found)
                if fits:
                    token = found
            if onward is not None:
                going.append((end, onward))
        if token < 0:
            raise ValueError("a byte without a token")
        return token

    def _ahead(self, state: int, text: bytes) -> tuple[int, ...]:
        """The tokens of what is pending in a state and the rest of a piece, without making states.

        Nothing needs to be certain before the end, so the one row of tokens of which each two
        neighbours fit is looked for from the left: the longest token that fits comes first, the
        next shorter one if that leads nowhere. As each prefix has one last token only, a place
        that led nowhere is not tried again, and the work grows with the tokens, not the bytes.
        """
        before, pending, _, _ = self.states[state]
        text = pending + text
        end, at, found, dead = len(text), 0, [], set()
        pairs, size, roots = self.pairs, self.size, self.roots
        while at < end:
            # The longest token that begins here.
            token, children = -1, roots
            for byte in text[at:]:
                node = children.get(byte)
                if node is None:
                    break
                longer, children = node
                if longer >= 0:
                    token = longer
                if children is None:
                    break
            while True:
                while token < 0:
                    # No token fits here: the one before it must be a shorter one.
                    if not found:
                        raise ValueError("a byte without a token")
                    dead.add(at)
                    token = found.pop()
                    at -= size[token]
                    before = found[-1] if found else self.states[state][0]
                    token = self._shorter(token)
                if not dead or at + size[token] not in dead:
                    if before < 0:
                        break
                    pair = before << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.fits(before, token)
                    if fits:
                        break
                token = self._shorter(token)
            found.append(token)
            before = token
            at += size[token]
        return tuple(found)

    def _shorter(self, token: int) -> int:
        """The longest token that a token begins with and is longer than; -1 if there is none."""
        found = self.prefixes.get(token)
        if found is None:
            text, ranks = self.tokens[token], self.ranks
            found = next((ranks[text[:i]] for i in range(len(text) - 1, 0, -1) if text[:i] in ranks), -1)
            self.prefixes[token] = found
        return found

    def _path(self, ids: Sequence[int], end: int) -> tuple[int, ...]:
        """The tokens of the encoding that ends here."""
        found = []
        while end:
            token = ids[end - 1]
            found.append(token)
            end -= self.size[token]
        return tuple(found[::-1])

    def _rest(self, state: int) -> tuple[int, ...]:
        """The tokens if the text ends in a state."""
        found = self.rests.get(state)
        if found is None:
            ids = self.states[state][2]
            found = self.rests[state] = self._path(ids, len(ids))
        return found

    def stream(self, text: Iterable[int]) -> Iterator[int]:
        """The tokens of a stream of bytes, each as soon as it is certain."""
        state, arcs = 0, self.arcs
        for byte in text:
            state, emitted = arcs.get(state << 8 | byte) or self._arc(state, byte)
            if emitted:
                yield from emitted
            if len(self.states) > STATES:
                kept = self.states[state]
                self.reset()
                state, arcs = self.state(*kept), self.arcs
        yield from self._rest(state)

    def encode(self, text: bytes) -> tuple[int, ...]:
        """The tokens of one piece of text. A text that is a token is that token."""
        whole = self.ranks.get(text)
        if whole is not None:
            return (whole,)
        if len(text) > LONG:
            return tuple(self.stream(text))
        if len(self.states) > STATES:
            self.reset()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        state, arcs, found = 0, self.arcs, ()
        for i, byte in enumerate(text):
            key = state << 8 | byte
            arc = arcs.get(key)
            if arc is None:
                if key not in self.asked:
                    if len(self.asked) >= ASKED:
                        self.asked.clear()
                    self.asked.add(key)
                    return found + self._ahead(state, text[i:])
                arc = self._arc(state, byte)
            state, emitted = arc
            if emitted:
                found += emitted
        return found + self._rest(state)


# --- decoding ---------------------------------------------------------------------------


def _utf8_arcs() -> dict[int, list[int]]:
    """The states of a UTF-8 reader and where each byte leads: 0 between characters, -1
    where the byte cannot follow, else what must still come (fixed by the encoding)."""
    def row(*spans: tuple[int, int, int]) -> list[int]:
        line = [-1] * 256
        for first, last, to in spans:
            line[first : last + 1] = [to] * (last + 1 - first)
        return line

    any_byte = (0x80, 0xBF)
    return {
        0: row((0, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
               (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)),
        1: row((*any_byte, 0)),
        2: row((*any_byte, 1)),
        3: row((*any_byte, 2)),
        4: row((0xA0, 0xBF, 1)),
        5: row((0x80, 0x9F, 1)),
        6: row((0x90, 0xBF, 2)),
        7: row((0x80, 0x8F, 2)),
    }


class StreamingDecoder:
    """Text of a stream of tokens. Bytes of a character that is not whole yet wait; bytes
    that cannot be part of one become U+FFFD, as many as Python's decoder makes."""

    ARCS = _utf8_arcs()

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.state, self.waiting = 0, b""
        self.whole: dict[int, str | None] = {}

    def _bytes(self, data: bytes) -> str:
        pieces, state, begin = [], self.state, 0
        data = self.waiting + data
        at = len(self.waiting)
        while at < len(data):
            to = self.ARCS[state][data[at]]
            if to >= 0:
                at += 1
                state = to
                continue
            # The bytes since the last whole character are wrong; this one may begin another.
            good = at
            while good > begin and data[good - 1] & 0xC0 == 0x80 and state:
                good -= 1
            good = good - 1 if state else at
            pieces += [data[begin:good].decode(), "�"]
            begin = at if state else at + 1
            at, state = begin, 0
        cut = len(data)
        if state:
            cut -= 1
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
        pieces.append(data[begin:cut].decode())
        self.state, self.waiting = state, data[cut:]
        return "".join(pieces)

    def feed(self, ids: Iterable[int]) -> str:
        pieces = []
        for token in ids:
            if not self.state:
                # A token of whole characters leads from state 0 to state 0.
                text = self.whole.get(token, "")
                if text == "" and token not in self.whole:
                    try:
                        text = self.tokens[token].decode()
                    except UnicodeDecodeError:
                        text = None
                    self.whole[token] = text
                if text is not None:
                    pieces.append(text)
                    continue
            pieces.append(self._bytes(self.tokens[token]))
        return "".join(pieces)

    def finish(self) -> str:
        """What waits for bytes that do not come."""
        text = "�" if self.waiting else ""
        self.state, self.waiting = 0, b""
        return text


# --- vocabularies -----------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank in each line."""
    with codecs.open(path, "r", "ascii") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class _Pieces(dict):
    """Encodings of the pieces met last, but for very long ones. When it is full it begins
    anew, but what it had before is looked up once more, so that frequent pieces stay."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer
        self.before: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.before.get(piece)
        if found is None:
            found = self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found


class Tokenizer:
    """A vocabulary with the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str) -> None:
        self.transducer = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(self.transducer)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))


@cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per worker."""
    return Tokenizer(path, pattern)


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _forget() -> None:
    tokenizer.cache_clear()
    token_bytes.cache_clear()


held["tokens"] = _forget


def _uncollected(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` without searches for reference cycles: the tables have none, but each search would go
    through their many tuples. What is dropped is freed at once, as ever."""

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if used:
                gc.enable()

    return quiet


def _lists(found: list[array]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _with(df: DataFrame, added: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """All columns and the token ids of the whole text.

    `path` names a rank file that every executor has. Each match of `pattern` is encoded by
    itself; special tokens have no meaning. A NULL or empty text has no ids; texts of any
    length are read whole; a column of the same name is replaced; an empty table gives no
    rows.
    """
    rest = [c for c in df.columns if c != name]
    kept = df.select(*[f"`{c}`" for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path, pattern)
        for part in chunks(batches, text):
            found = [array("i", known.encode(t or "")) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], _lists(found)], names=[*rest, name])

    return kept.mapInArrow(lean(_uncollected(run), own="tokens"), _with(kept, f"`{name}` array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the text of the token ids, read as a stream.

    Bytes that are no UTF-8 become U+FFFD. NULL ids give an empty text; an id that the
    vocabulary lacks is an error; a column of the same name is replaced.
    """
    rest = [c for c in df.columns if c != name]
    kept = df.select(*[f"`{c}`" for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamingDecoder(token_bytes(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.r_[0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
                texts = [decoder.feed(flat[a:b].tolist()) + decoder.finish() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in rest], pa.array(texts, pa.string())], names=[*rest, name]
                )

    return kept.mapInArrow(lean(_uncollected(run), own="tokens"), _with(kept, f"`{name}` string"))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns but the text, and `ids` and `decoded`: `encode` and `decode` in one pass."""
    rest = [c for c in df.columns if c not in (text, "ids", "decoded")]
    kept = df.select(*[f"`{c}`" for c in rest], F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path, pattern)
        decoder = StreamingDecoder(known.transducer.tokens)
        for part in chunks(batches, "_text"):
            found, texts = [], []
            for t in part.column("_text").to_pylist():
                ids = known.encode(t or "")
                texts.append(decoder.feed(ids) + decoder.finish())
                found.append(array("i", ids))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in rest], _lists(found), pa.array(texts, pa.string())],
                names=[*rest, "ids", "decoded"],
            )

    schema = _with(kept.drop("_text"), "ids array<int>, decoded string")
    return kept.mapInArrow(lean(_uncollected(run), own="tokens"), schema)


def digests(df: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The key, the number of tokens and the hashes of ids and text."""
    return df.select(
        key, F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
