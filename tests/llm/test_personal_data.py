import hashlib
import random
import re
import time

import numpy as np
import pytest

from quillmesh.llm import personal_data as pii
from quillmesh.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, spans string, base int"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def strict(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            checks = 0
            for i, d in enumerate(map(int, reversed(digits))):
                checks += d if i % 2 == 0 else sum(divmod(2 * d, 10))
            holds = (
                True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and checks % 10 == 0, 9 <= len(digits) <= 15,
            )[kind]
            if holds:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def text_of(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_strict_spans_on_random_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.@@+12 -(3)4é%_:0") for _ in range(rng.randrange(50)))
        found = pii.spans_of(text)
        assert [(s, k, e) for s, k, e, base, *_ in found if base] == strict(text), text
        assert found == sorted(found)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = strict(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        found = r.spans.split(",") if r.spans else []
        assert set(filter(None, text_of(base).split(","))) <= set(found)
        # Numbers with a wrong check digit are no card.
        for span in found:
            kind, start, end = span.split(":")
            if kind == "card":
                assert pii.luhn(re.sub("[^0-9]", "", texts[r.doc_id][int(start) : int(end)]))


def corpus():
    """Texts with known spans: some that the strict patterns miss, and some that are no data."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
        wrong = card[:-1] + str((int(card[-1]) + 5) % 10)
        phone = f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows += [
            (f"please write an email to name{i}@mail.example.com today", f"name{i}@mail.example.com", 1),
            (f"you can contact me, mail name{i} [at] mail [dot] example [dot] com today", f"name{i} [at] mail [dot] example [dot] com", 1),
            (f"call me by phone +1 {phone} tonight", f"+1 {phone}", 1),
            (f"call me by phone {phone} tonight", phone, 1),
            (f"pay with card {card} now", card, 1), (f"the order {wrong} was sent", wrong, 0),
            (f'token = "{rng.randrange(10**9, 10**10)}ab"', None, 0),
        ]
    rng.shuffle(rows)
    return rows


def test_model_finds_what_patterns_miss(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (t, _, _) in enumerate(rows)], SCHEMA).repartition(4)
    hit = false = wanted = 0
    for r in pii.personal_data(docs).collect():
        text, span, is_data = rows[r.doc_id]
        found = {text[s.start : s.end] for s in r.spans}
        wanted += is_data
        hit += is_data and span in found
        false += len(found - ({span} if is_data else set()))
    assert hit >= 0.97 * wanted and false <= 0.01 * wanted


def test_reliabilities():
    """Estimates come near the truth that votes were drawn from; the pattern accepts a part of
    the data and nothing else."""
    rng = np.random.default_rng(1)
    truth = rng.random(50_000) < 0.4
    right = np.array([0.9, 0.8, 0.85, 0.7, 0.6])
    code = np.where(truth & (rng.random(len(truth)) < 0.3), 2, 1)
    for r in right:
        good = rng.random(len(truth)) < r
        vote = np.where(good == truth, 2, 0)
        code = code * 3 + np.where(rng.random(len(truth)) < 0.2, 1, vote)
    counts = np.zeros((4, pii.VOTES))
    counts[2] = np.bincount(code, minlength=pii.VOTES)
    reliabilities, posterior = pii.estimate(counts)
    assert np.abs(reliabilities[2][1:, 1, 2] - right).max() < 0.04
    assert np.abs(reliabilities[2][1:, 0, 0] - right).max() < 0.04
    assert ((posterior[2][code] > 0.5) == truth).mean() > 0.93


def test_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (t, _, _) in enumerate(corpus()[:700])], SCHEMA)
    models = [pii.fit(pii.find_spans(docs.repartition(n))) for n in (1, 5)]
    assert np.array_equal(models[0].probability, models[1].probability)


def test_gaps(spark):
    rows = [(None, "a@b.c", "x", 1), (1, None, "x", 1), (1, "", "x", 1), (2, "a@b.c", "x", 1), (2, "a@b.c", "x", 1)]
    found = pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), len(r.base)) for r in found) == [("1", 0), ("1", 0), ("2", 1), ("2", 1), ("None", 1)]
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("piece", ["a", "1", "1.", "a@", "+1 ", "(1", ":1", "at a dot ", "a@b.", "1 ", "[at]a dot"])
def test_long_texts_take_linear_time(piece):
    before = time.time()
    pii.spans_of(piece * (400_000 // len(piece)))
    assert time.time() - before < 10
