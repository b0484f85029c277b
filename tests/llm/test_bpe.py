from __future__ import annotations

import random

import public_tokenizers
import pytest
from tidemark.llm import bpe
from tokenizers import Tokenizer

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_table(real_docs, library):
    docs, rows = real_docs
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()}
    assert [ids[d] for d, _, _ in rows] == wanted(library, [t for _, t, _ in rows])


def test_round_trip(real_docs):
    docs, rows = real_docs
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert all(back[d] == t for d, t, _ in rows)


def test_odd_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 500)
    rng = random.Random(1)
    letters = "ab the's ll're  \n\t éüß中文😀0123456789!?.,'\"<|>-_= \x1c\x85́​"
    texts = ["", " ", "  ", "a  b", "a   b ", "\n\n a", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>"]
    texts += ["a" * 3000, "don't I'll we're  it's"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcth eing") for _ in range(rng.randint(1, 200))) for _ in range(500)]
    encoder = bpe.Encoder(PATH)
    for _ in range(2):
        found = encoder.encode(texts)
        assert [[int(i) for s, _ in r for i in s.split(",")] for r in found] == wanted(library, texts)
        assert [b"".join(x[1] for x in r).decode() for r in found] == texts


def test_long_words(library):
    """Words without a break: random letters, runs, and digits of a key."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzäöüß中文字"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (513, 3000, 120_000)]
    texts += ["a" * 5000, "ab" * 4001, "=" * 9000, "中" * 3000, "the" * 2000, "x" + "1" * 4000]
    assert [[int(i) for s, _ in r for i in s.split(",")] for r in bpe.Encoder(PATH).encode(texts)] == wanted(library, texts)


def test_memory_is_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1 << 20)
    encoder = bpe.Encoder(PATH)
    for start in range(0, 3000, 30):
        texts = ["".join(chr(0x4E00 + (i * 7 + start + k) % 9000) for i in range(300)) + f" w{start} ok" for k in range(30)]
        found = encoder.encode(texts)
        if not start % 900:
            assert [int(i) for s, _ in found[0] for i in s.split(",")] == wanted(library, texts[:1])[0]
    assert encoder.used <= 1 << 20 and max(map(len, encoder.seen)) <= bpe.LONGEST


def test_every_token_is_whole():
    own = bpe.vocabulary(PATH)
    assert sum(not own.whole[i] for i in range(own.size) if i not in own.special.values()) == 0


def test_odd_rows(odd_docs, no_docs, library):
    found = bpe.round_trip(odd_docs, PATH)
    by = sorted((r.doc_id or 0, r.n_tokens) for r in found.collect())
    ids = wanted(library, [r[1] for r in ODD])
    assert by == sorted((r[0] or 0, len(i)) for r, i in zip(ODD, ids))
    assert bpe.encode(no_docs, PATH).count() == 0


def test_decode_null_and_broken_bytes(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [120, 95])], "doc_id bigint, ids array<int>")
    texts = {r.doc_id: r.text for r in bpe.decode(rows, PATH).collect()}
    assert texts[1] is None and texts[2] == ""
    assert texts[3] == Tokenizer.from_file(PATH).decode([120, 95])
