from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tidemark.llm import packing
from tokenizers import Tokenizer

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(pieces, docs, library, window):
    """Every id of every document lies in one piece, sequences are gapless and full."""
    wanted = defaultdict(list)
    for doc, text in docs:
        wanted[doc].append([*library.encode(text or "", add_special_tokens=False).ids, packing.END])
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r.length == len(r.value) > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.value, r.doc_tokens))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= window
    sizes = [sum(n for _, n in places) for places in sequences.values()]
    assert sum(size < window for size in sizes) <= 1
    assert set(parts) == set(wanted)
    for doc, own in parts.items():
        if len(wanted[doc]) == 1:
            ids, end = wanted[doc][0], 0
            for start, value, total in sorted(own):
                assert start == end and value == ids[start : start + len(value)] and total == len(ids)
                end += len(value)
            assert end == len(ids)
        else:
            assert sum(len(v) for _, v, _ in own) == sum(map(len, wanted[doc]))


def test_whole_table(real_docs, library):
    docs, rows = real_docs
    found = packing.pack(docs.repartition(7), PATH).collect()
    check(found, [(d, t) for d, t, _ in rows], library, packing.WINDOW)


@pytest.mark.parametrize("window, n_open", [(64, 1), (128, 4)])
def test_many_tasks_merge_in_rounds(real_docs, library, monkeypatch, window, n_open):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    docs, rows = real_docs
    part = docs.filter("doc_id < 60").repartition(11)
    found = packing.pack(part, PATH, window=window, n_open=n_open).collect()
    check(found, [(d, t) for d, t, _ in rows if d < 60], library, window)


def test_odd_rows(odd_docs, no_docs, library):
    check(packing.pack(odd_docs, PATH).collect(), [(r[0], r[1]) for r in ODD], library, packing.WINDOW)
    assert packing.pack(no_docs, PATH).count() == 0


@pytest.mark.parametrize("remembered", [None, 0, 600])
def test_words_may_be_cut_at_spaces(library, remembered):
    rng = random.Random(4)
    letters = "ab the's ll're  \n\t éüß中文😀0123!?.,'\"<|>-_= \x1c\x85́​ΑΣ１"
    texts = ["a b", " a\n\nb ", "A\tB's  c", "é e ́x", "\x1cq\x85r s", "x<|endoftext|> y", "ΑΣ Σ", "１２ 3", "", " "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = packing.WordIds(PATH, remembered)
    for _ in range(2):
        found = [ids.tolist() for i in range(0, len(texts), 700) for ids in own.encode(texts[i : i + 700])]
        assert found == wanted
        assert remembered is None or own.held() <= remembered + 64


def test_long_words_are_not_remembered(library):
    """5,000 words of 4,000 letters: a corpus without spaces."""
    own = packing.WordIds(PATH, 1 << 20)
    for start in range(0, 5000, 50):
        texts = ["".join(chr(0x4E00 + (i * 7 + start + k) % 9000) for i in range(4000)) + " ok" for k in range(50)]
        found = own.encode(texts)
        if not start % 1000:
            assert found[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
    assert own.words.to_pylist() == ["ok"] and own.held() < 200


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 10)
    monkeypatch.setattr(packing, "SLICE_ROWS", 3)
    texts = ["x" * n for n in (4, 6, 1, 30, 0, 0, 0, 0, 11, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["doc_id", "text"])
    parts = [b.column(1).to_pylist() for b in packing._text_slices(iter([batch, batch.slice(0, 0)]))]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or (sum(map(len, p)) <= 10 and len(p) <= 3) for p in parts)


def test_best_fit_and_fullest():
    out = []
    windows = packing._Windows(10, 2, out.append)
    for doc, n in enumerate([6, 7, 3, 5, 9]):
        windows.add((doc, 0, np.arange(n), n))
    # 3 goes beside 7 and fills it; 5 opens a window; 9 fills the fullest (6), then opens one
    assert [[(p[0], len(p[2])) for p in pieces] for pieces in out] == [[(1, 7), (2, 3)], [(0, 6), (4, 4)], [(3, 5), (4, 5)]]
    assert windows.close() == []
