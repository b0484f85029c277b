from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import patterns, pii

from .conftest import ODD


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.examples())


def digits(text):
    return re.sub("[^0-9]", "", text)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and patterns.luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def slow(text):
    found = [(k, *m.span()) for k, rule, ok in RULES for m in re.finditer(rule, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[1], patterns.PERSONAL.index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aB.@+-1 ()234_%é٣²", max_size=60))
def test_patterns(text):
    assert patterns.personal(text) == slow(text)


def test_patterns_on_whole_table(real_docs):
    _, rows = real_docs
    assert all(patterns.personal(t) == slow(t) for _, t, _ in rows)
    assert sum(len(slow(t)) for _, t, _ in rows) > 50


def test_labels_of_unseen_examples(field):
    right = 0
    rows = pii.examples(300, seed=99)
    for text, spans in rows:
        symbols, places = pii.tokens(text, 0, len(text))
        found, last = [], ""
        for label, (start, end) in zip(field.viterbi([symbols])[0], places):
            name = pii.LABELS[label]
            if name[0] == "B":
                found.append((name[2:], start, end))
            elif name[0] == "I":
                found[-1] = (*found[-1][:2], end)
        right += found == spans
    assert right >= 0.93 * len(rows)


def test_viterbi_is_the_best_path(field):
    import itertools

    import numpy as np

    rng = random.Random(5)
    for _ in range(5):
        symbols = [rng.randrange(1, pii.SYMBOLS) for _ in range(4)]
        score = field.scores(np.array([symbols]))[0]

        def total(path):
            steps = field.step[0, path[0]] + sum(field.step[a + 1, b] for a, b in zip(path, path[1:]))
            return steps + sum(score[t, l] for t, l in enumerate(path))

        best = max(itertools.product(range(pii.N), repeat=4), key=total)
        assert total(tuple(field.viterbi([symbols])[0])) == pytest.approx(total(best))


def test_added_spans_leave_base_alone(field, real_docs):
    _, rows = real_docs
    texts = [t for _, t, _ in rows]
    for text, spans in zip(texts, pii.find_all(texts, field)):
        assert [s[:3] for s in spans if s[3]] == slow(text)
        base = [s for s in spans if s[3]]
        assert all(s[2] <= b[1] or b[2] <= s[1] for s in spans if not s[3] for b in base)


def test_found_beside_the_patterns(field):
    text = "reach (988) 555-2485 or bob at mail dot com today, not on 2024-01-31 at 12:30:45"
    found = {(k, text[a:b]) for k, a, b, base in pii.find_all([text], field)[0] if not base}
    assert found == {("phone", "(988) 555-2485"), ("email", "bob at mail dot com")}


def test_long_runs_are_linear(field):
    pii.find_all(["1" * 200_000, "a" * 100_000 + "@" * 1000, "1.2 " * 20_000, "1a" * 50_000], field)


def test_odd_rows(odd_docs, no_docs, field):
    found = pii.find(odd_docs, field).collect()
    assert len(found) == len(ODD) and all(r.spans == [] for r in found if r.doc_id in (3, 4, 5, None))
    assert pii.find(no_docs, field).count() == 0
    clean = pii.redact(odd_docs, field)
    assert clean.columns == odd_docs.columns
    assert {(r.doc_id, r.text) for r in clean.collect() if r.doc_id in (1, 3, 4)} == {(r[0], r[1]) for r in ODD if r[0] in (1, 3, 4)}


def test_redact(spark, field):
    docs = spark.createDataFrame([(1, "mail bob@x.org now, ip 10.0.0.1"), (2, None)], "id int, text string")
    assert [r.text for r in pii.redact(docs, field).orderBy("id").collect()] == ["mail <EMAIL> now, ip <IP>", None]


def test_training_table(spark):
    table = pii.labelled_table(spark)
    assert table.count() == len(pii.examples())
    with pytest.raises(ValueError):
        pii.train_on(table, limit=10)
