"""Personal data by weak supervision: strict patterns, and what labelers together make of the rest.

One scan of the texts finds spans. Those of the strict patterns (`base`) are results as they
are. Looser forms (an address written with "at" and "dot", a telephone number without its
country, a card number beside another number or with a wrong check digit, an address of eight
hexadecimal groups) are candidates. On all spans six labelers vote yes, no or nothing: the
pattern, a gazetteer, the words around, the characters beside the span, its grouping, and the
variety of its digits.

Nobody has labelled these spans, so expectation-maximisation estimates per kind how reliable
each labeler is when it votes, and how likely each pattern of votes is to be personal data. A
logistic classifier over features of the span is then trained on these likelihoods, and adds the
candidates of which it is certain enough.

Votes and features are small codes (2,916 patterns of votes, 10,368 of features), so the model
is fitted to counts of all spans of all documents, whose number does not grow with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import stored

# The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Characters of the strict patterns.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser forms. Runs are taken whole, so each pattern passes a text once.
HOST = re.compile(r"[A-Za-z0-9-]{2,63}")
SPELLED = re.compile(
    r"\s{0,2}(?:\[at\]|\(at\)|\{at\}|\bat\b)\s{0,2}([a-z0-9-]{1,63}(?:\s{0,2}(?:\[dot\]|\(dot\)|\{dot\}|\bdot\b)\s{0,2}[a-z0-9-]{1,63}){1,4})", re.I
)
HEXED = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4})?+(?::[0-9A-Fa-f]{0,4}){3,7}+(?![0-9A-Za-z:])")
RUN = re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")
GROUPED = re.compile(r"(?:\(?[0-9])(?:[ ()./-]{0,2}+[0-9])++")

# The gazetteers.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz io co us uk de fr es it pt nl be ch at pl cz se no fi dk ie gr ru ua tr cn jp kr in br mx ar cl au nz ca za eu".split()
)
CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
CONTEXT = {
    EMAIL: "email e-mail mail contact write correo courriel schreiben",
    IP: "ip host server address addr login gateway dirección adresse",
    CARD: "card visa mastercard amex credit debit pay payment tarjeta carte karte kreditkarte",
    PHONE: "phone tel telephone call mobile cell fax dial teléfono telefon téléphone anrufen",
}
AGAINST = "version release isbn issn order invoice token hash sha md5 section chapter figure page ref serial uuid"
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_TRIGGERS = {w: k for k, words in CONTEXT.items() for w in words.split()} | {w: -1 for w in AGAINST.split()}
AROUND = 48

# Values of each labeler (no, nothing, yes) and of each feature; the codes count through them.
LABELERS = ("pattern", "gazetteer", "context", "beside", "grouping", "variety")
VOTES = 3 ** len(LABELERS)
# Right and wrong votes that a labeler, and the pattern, are believed to begin with.
BELIEF = (1.5, 1.0)
STRICT = (60.0, 0.5)
FEATURES = {"size": 4, "left": 3, "right": 3, "gaps": 4, "context": 3, "valid": 2, "listed": 3}
SHAPES = int(np.prod(list(FEATURES.values())))


def luhn(digits: str) -> bool:
    """Whether the check digit at the end of a number is right."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(doubled[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def strict_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, holds) of all matches of the strict patterns, leftmost first per kind.

    A match that fails its check has `holds` False; its characters are not tried again. Each
    pattern reads every character a fixed number of times.
    """
    found, end, before = [], 0, 0
    at = text.find("@")
    while at >= 0:
        least = max(end, before)
        run = text[least:at]
        start = least + len(run.rstrip(LOCAL))
        rest = DOMAIN.match(text, at + 1) if start < at else None
        if rest:
            end = rest.end()
            found.append((EMAIL, start, end, True))
        before = at + 1
        at = text.find("@", max(before, end))
    if not re.search("[0-9]", text):
        return found
    for m in DOTTED.finditer(text):
        groups, at = m.group().split("."), m.start()
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            size = sum(map(len, four)) + 3
            found.append((IP, at, at + size, all(map(_small, four))))
            at += size + 1
    for m in SPACED.finditer(text):
        digits = _digits(m.group())
        if len(digits) >= 12:
            found.append((CARD, m.start(), m.end(), len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in DIALLED.finditer(text):
            found.append((PHONE, m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15))
    return found


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of forms that the strict patterns do not know."""
    found = []
    lowered = text.lower() if "dot" in text or "DOT" in text or "Dot" in text else ""
    if "dot" in lowered:
        before = 0
        for m in SPELLED.finditer(text):
            start = before + len(text[before : m.start()].rstrip(LOCAL))
            if start < m.start():
                found.append((EMAIL, start, m.end()))
            before = m.end()
    before, at = 0, text.find("@")
    while at >= 0:
        start = before + len(text[before:at].rstrip(LOCAL))
        host = HOST.match(text, at + 1)
        if start < at and host:
            found.append((EMAIL, start, host.end()))
        before = at + 1
        at = text.find("@", before)
    if "::" in text or text.count(":") > 2:
        found += [(IP, m.start(), m.end()) for m in HEXED.finditer(text) if any(c in "0123456789abcdefABCDEF" for c in m.group())]
    if re.search("[0-9]", text):
        for m in GROUPED.finditer(text):
            written, digits = m.group(), _digits(m.group())
            if 12 <= len(digits) <= 19:
                found.append((CARD, m.start(), m.end()))
            elif len(digits) > 19:
                found += [(CARD, m.start() + n.start(), m.start() + n.end()) for n in RUN.finditer(written)]
            elif 7 <= len(digits) <= 11 and (not written.isdigit() or written[0] == "0"):
                found.append((PHONE, m.start(), m.end()))
    return found


def _beside(char: str) -> int:
    """0 a blank or the border of the text, 1 a sign, 2 what belongs to a word or a code."""
    return 0 if not char or char.isspace() else 2 if char.isalnum() or char in "_=/\\#@\"'" else 1


def _context(text: str, kind: int, start: int, end: int) -> int:
    """Words around: 2 some of the kind, 0 some against it, 1 none of both."""
    near = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND // 2]
    triggers = [_TRIGGERS[w] for w in (x.lower() for x in _WORD.findall(near)) if w in _TRIGGERS]
    return 2 if kind in triggers else 0 if triggers else 1


def _listed(kind: int, written: str, digits: str) -> int:
    """The gazetteer: 2 known, 0 known to be none, 1 neither."""
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]+", written)[-1].lower()
        return 2 if last in TOP_LEVEL else 0
    if kind == IP:
        if ":" in written:
            return 1
        first, second = (int(p.lstrip("0")[:4] or "0") for p in written.split(".")[:2])
        private = first in (0, 10, 127) or (first, second) == (192, 168) or (first == 172 and 16 <= second <= 31)
        return 0 if private or first > 255 else 2
    if kind == CARD:
        two, four = int(digits[:2]), int(digits[:4])
        known = digits[0] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or two in (34, 37, 35, 36, 38, 65) or four == 6011
        return 2 if known else 0
    if not written.startswith("+"):
        return 1
    return 2 if any(digits[:n] in CALLING for n in (1, 2)) else 0


def _grouping(kind: int, written: str, digits: str) -> int:
    """2 the usual form, 0 one that nobody writes, 1 anything between."""
    sizes = [len(g) for g in re.split(r"[^0-9]+", written) if g]
    if kind == CARD:
        usual = sizes in ([16], [15], [4, 4, 4, 4], [4, 6, 5], [13], [19], [14])
        return 2 if usual else 0 if len(sizes) > 5 or min(sizes) == 1 else 1
    if kind == PHONE:
        balanced = written.count("(") == written.count(")") <= 1
        return 0 if not balanced or len(sizes) > 6 or max(sizes) > 12 else 2 if len(sizes) >= 3 else 1
    if kind == IP:
        return 1 if ":" in written else 0 if any(len(g) > 1 and g[0] == "0" for g in written.split(".")) else 2
    return 2 if any(c.isalpha() for c in written[:2]) else 1


def _variety(digits: str) -> int:
    """Digits that are all alike or count up or down are examples, not data."""
    if len(digits) < 7:
        return 1
    steps = {(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:])}
    return 0 if len(set(digits)) <= 2 or len(steps) == 1 else 1


def describe(text: str, kind: int, start: int, end: int, valid: bool, failed: bool) -> tuple[int, int]:
    """The code of the votes on a span and that of its features, each with the kind in front."""
    written = text[start:end]
    digits = _digits(written)
    left, right = _beside(text[start - 1 : start] if start else ""), _beside(text[end : end + 1])
    context, listed = _context(text, kind, start, end), _listed(kind, written, digits)
    pattern = 2 if valid else 0 if failed or kind == CARD else 1
    beside = 0 if 2 in (left, right) else 2 if left == 0 else 1
    code = kind
    for vote in (pattern, listed, context, beside, _grouping(kind, written, digits), _variety(digits)):
        code = code * 3 + vote
    size = sum(len(digits) >= n for n in (10, 12, 16)) if kind != EMAIL else sum(len(written) >= n for n in (8, 16, 32))
    signs = set(re.sub(r"[0-9A-Za-z]", "", written))
    gaps = 0 if not signs else 1 if signs == {" "} else 2 if signs == {"-"} else 3
    shape = kind
    for value, count in zip((size, left, right, gaps, context, int(valid), listed), FEATURES.values()):
        shape = shape * count + value
    return code, shape


def spans_of(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(start, kind, end, base, votes, features) of all spans, in order.

    A looser form that touches a strict span that holds, or an earlier looser one, is none.
    """
    strict = strict_spans(text)
    found = [(s, k, e, True) for k, s, e, holds in strict if holds]
    taken = sorted((s, e) for s, _, e, _ in found)
    # A chain of more digits than a card has may still hold one.
    failed = {(k, s, e) for k, s, e, holds in strict if not holds and (k != CARD or len(_digits(text[s:e])) <= 19)}
    others = sorted({(s, k, e) for k, s, e in failed} | {(s, k, e) for k, s, e in loose_spans(text)})
    at, end = 0, 0
    for s, k, e in others:
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= end and (at == len(taken) or taken[at][0] >= e):
            found.append((s, k, e, False))
            end = e
    rows = []
    for s, k, e, base in sorted(found):
        valid = base or k == CARD and luhn(_digits(text[s:e]))
        rows.append((s, k, e, base, *describe(text, k, s, e, valid, (k, s, e) in failed)))
    return rows


SPAN = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,votes:int,shape:int>>"
_SPAN = pa.list_(pa.struct([
    ("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("shape", pa.int32()),
]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("start", "kind", "end", "base", "votes", "shape")
    for batch in batches:
        ids = batch.column(0)
        for i in range(0, batch.num_rows, 256):
            texts = batch.column(1).slice(i, 256)
            spans = [[dict(zip(names, row)) for row in spans_of(t.as_py() or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([ids.slice(i, 256), pa.array(spans, _SPAN)], names=["doc_id", "spans"])


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and `spans` of every row: strict ones and candidates, with votes and features."""
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_scan, f"doc_id {kind}, spans {SPAN}")


@dataclass(frozen=True)
class Model:
    """Reliabilities per kind (labeler, truth, vote), the likelihood of each pattern of votes,
    and the classifier's probability for each pattern of features."""

    reliabilities: np.ndarray
    posterior: np.ndarray
    probability: np.ndarray


def estimate(counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over the counts of vote patterns (kinds x 3^6).

    Truth is hidden; labelers vote independently, given the truth. Before anything is seen a
    labeler is believed to be right rather more often than not (`BELIEF`, in counts of votes),
    and the pattern, which includes check digits and ranges, nearly always (`STRICT`). The first
    guess follows from that, and the counts of the spans are added to it: few spans of a kind do
    not turn a labeler round, many may. That a labeler does not vote says nothing.

    Spans that the pattern accepts are results as they are, so they count as data; they tell how
    labelers vote on data. How many of the others are data is estimated from the others alone,
    beginning with one in three. Returns reliabilities (kind, labeler, truth, vote) and the
    posterior per pattern of votes.
    """
    votes = np.array(list(product(range(3), repeat=len(LABELERS))))
    right = [STRICT if labeler == "pattern" else BELIEF for labeler in LABELERS]
    belief = np.array([((good, 0, bad), (bad, 0, good)) for good, bad in right])  # none or data; no to yes
    belief[:, :, 1] = belief[:, :, [0, 2]].sum(2)  # so that a vote of nothing is no evidence
    guess = 1 / (1 + np.exp(-np.log(belief[:, 1] / belief[:, 0])[np.arange(len(LABELERS)), votes].sum(1)))
    accepted = votes[:, LABELERS.index("pattern")] == 2
    posterior = np.tile(np.where(accepted, 1.0, guess), (len(KINDS), 1))
    seen = np.stack([votes == v for v in range(3)], 2).astype(float)  # pattern, labeler, vote
    reliabilities = np.empty((len(KINDS), len(LABELERS), 2, 3))
    for kind, n in enumerate(counts):
        for _ in range(rounds):
            weights = np.stack([n * (1 - posterior[kind]), n * posterior[kind]])
            tally = np.einsum("tp,plv->ltv", weights, seen) + belief
            tally[:, :, 1] = tally[:, :, [0, 2]].sum(2)
            reliabilities[kind] = tally / tally[:, :, 1:2]
            logs = np.einsum("plv,ltv->tp", seen, np.log(reliabilities[kind]))
            share = (weights[1][~accepted].sum() + 1) / (n[~accepted].sum() + 3)
            odds = logs[1] - logs[0] + np.log(share) - np.log(1 - share)
            posterior[kind] = np.where(accepted, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return reliabilities, posterior


def train(counts: np.ndarray, positive: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Probability per pattern of features (kinds x patterns), by one logistic regression a kind
    on the number of spans and how many of them are positive (a sum of likelihoods)."""
    values = np.array(list(product(*[range(n) for n in FEATURES.values()])))
    design = np.concatenate([np.ones((len(values), 1))] + [np.eye(n)[values[:, i]] for i, n in enumerate(FEATURES.values())], 1)
    out = np.zeros((len(KINDS), SHAPES))
    penalty = np.diag([1e-3] + [ridge] * (design.shape[1] - 1))
    for kind in range(len(KINDS)):
        used = counts[kind] > 0
        x, n, y = design[used], counts[kind][used].astype(float), positive[kind][used]
        w = np.zeros(design.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (y - n * p) - penalty @ w
            step = np.linalg.solve((x.T * (n * p * (1 - p) + 1e-9)) @ x + penalty, slope)
            w += step / max(1.0, np.abs(step).max() / 4)
        out[kind] = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
    return out


def fit(spans: DataFrame) -> Model:
    """The model of all spans of a table (as `find_spans` gives them)."""
    each = spans.select(F.inline("spans")).groupBy("votes", "shape").agg(F.count(F.lit(1)).alias("n"))
    cells = stored(each, "span-counts")
    counts = np.zeros(len(KINDS) * VOTES)
    for r in cells.groupBy("votes").agg(F.sum("n").alias("n")).collect():  # 2,916 rows at most
        counts[r.votes] = r.n
    reliabilities, posterior = estimate(counts.reshape(len(KINDS), VOTES))
    # Likelihoods as whole numbers, so that their sums do not depend on the order of tasks.
    scale = 1 << 20
    likely = F.get(_numbers(np.rint(posterior.ravel() * scale)), F.col("votes")).cast("bigint")
    seen, positive = np.zeros(len(KINDS) * SHAPES), np.zeros(len(KINDS) * SHAPES)
    sums = cells.groupBy("shape").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(38,0)") * likely).alias("positive"))
    for r in sums.collect():  # 10,368 rows at most
        seen[r.shape], positive[r.shape] = r.n, float(r.positive) / scale
    probability = train(seen.reshape(len(KINDS), SHAPES), positive.reshape(len(KINDS), SHAPES))
    return Model(reliabilities, posterior, probability)


def _numbers(values: np.ndarray):
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def label_spans(spans: DataFrame, model: Model, certain: float = 0.9) -> DataFrame:
    """Per row `doc_id`, `base` and `spans`: arrays of (start, kind, end, base, probability).

    `spans` are the strict ones and the candidates whose probability is `certain` or more.
    """
    scored = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"),
            F.get(_numbers(model.probability.ravel()), s["shape"]).alias("probability"),
        ),
    )
    every = spans.select("doc_id", scored.alias("_spans"))
    return every.select(
        "doc_id", F.filter("_spans", lambda s: s["base"]).alias("base"),
        F.filter("_spans", lambda s: s["base"] | (s["probability"] >= certain)).alias("spans"),
    )


def listed(spans):
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", certain: float = 0.9) -> DataFrame:
    """Find personal data in every text: one row per row, `doc_id`, `base`, `spans`.

    Positions are code points, the end not included; spans come by start, then kind. A NULL or
    empty text has no spans. Repeated rows each give theirs; a NULL id stays NULL. Other
    columns are ignored. An empty table gives no rows.
    """
    spans = stored(find_spans(docs, key, text), "spans")
    return label_spans(spans, fit(spans), certain)
