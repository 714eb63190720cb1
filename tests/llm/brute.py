"""Plain restatements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

NO_ID = 2**63 - 1
BLANKS = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def repeats(rows, window=50):
    """(id, bytes, removed, spans, hash of what is kept) of each (id, text)."""
    least: dict[bytes, int] = {}
    for d, t in rows:
        b, k = (t or "").encode(), NO_ID if d is None else d
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            least[w] = min(least.get(w, k), k)
    out = []
    for d, t in rows:
        b, k = (t or "").encode(), NO_ID if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < k:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return ordered(out)


def shingles(text):
    w = re.findall(BLANKS.encode(), (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def linked(rows):
    """(id, shingles, component) of each (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            having[g].append(i)
    both = Counter()
    for members in having.values():
        both.update((a, b) for n, b in enumerate(members) for a in members[:n])
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return ordered((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def hits(docs, items, window=13):
    """(id, words, hit words, item ids, contaminated) of each (id, text)."""
    windows = defaultdict(set)
    for i, t in items:
        w = WORDS.findall((t or "").encode().lower())
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = WORDS.findall((t or "").encode().lower())
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), tuple(sorted(found)), 0 < sum(hit) and 20 * sum(hit) >= len(w)))
    return ordered(out)


def statistics(text):
    """words, characters in words, symbols, repeated lines, repeated words, base failed."""
    text = text or ""
    w = re.findall(BLANKS, text)
    count = Counter(zip(w, w[1:], w[2:]))
    marked = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(BLANKS, x)]
    n, r = len(w), len(marked)
    return (
        n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r,
        n < 50 or 100 * r > 50 * n,
    )


def collapsed(rows):
    """(id, turns, copies, text) of the conversations that are no prefix of another.

    `rows`: (conv_id, turn, role, text) with distinct turn numbers.
    """
    turns = defaultdict(list)
    for c, n, role, text in rows:
        turns[c].append((n, role or "", text or ""))
    whole = defaultdict(list)
    for c, t in turns.items():
        whole[tuple(x[1:] for x in sorted(t, key=lambda x: x[0]))].append(c)
    out = []
    for seq, ids in whole.items():
        if not any(len(o) > len(seq) and o[: len(seq)] == seq for o in whole):
            text = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in seq)
            out.append((min(ids), len(seq), len(ids), text))
    return ordered(out)
