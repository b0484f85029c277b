from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import values
from pyspark.ml.feature import CountVectorizerModel
from tidemark.llm import divergence

from .conftest import ODD, SF_DIR

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def expected(rows, least_docs=3, top=200):
    """Dense counts and loops over all kept terms, in Python integers."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        found = Counter(t for *_, terms in mine for t in set(terms))
        kept = [t for t, n in found.items() if n >= least_docs]
        counts, whole = defaultdict(Counter), Counter()
        for _, source, terms in mine:
            counts[source].update(t for t in terms if found[t] >= least_docs)
            whole.update(t for t in terms if found[t] >= least_docs)

        def shares(own):
            return {t: 1 + 10**9 * (own[t] + 1) // (sum(own.values()) + len(kept)) for t in kept}

        p, q = {s: shares(own) for s, own in counts.items()}, shares(whole)

        def gap(a, b):
            return (a - b) ** 2 // b

        for s in counts:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n) for n, (v, i) in enumerate(items[:most], 1)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_terms():
    text = "The CAT's Straße_42 naïve-É \x00\x7f日本 İ"
    wanted = ["the", "cat", "s", "straße", "naïve", "É", "日本", "İ"]
    assert [t.decode() for t in divergence.terms_of(text)] == wanted
    assert divergence.terms_of(" 12 ") == []


@pytest.mark.parametrize("vocabulary", [150_000, 3_000])
def test_whole_table(spark, monkeypatch, vocabulary):
    """In one vocabulary, and in blocks of them."""
    monkeypatch.setattr(divergence, "VOCABULARY", vocabulary)
    monkeypatch.setattr(divergence, "COMPARED", vocabulary)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert values(divergence.diverge(docs), *COLUMNS) == expected(rows)


def test_small_groups(spark):
    rows = [
        ("a b c", "en", "x"), ("a b", "en", "y"), ("A, a; b d", "en", "z"), ("", "en", "w"), ("a", None, "x"),
        ("q", "de", "x"), ("q", "de", None), ("r", "de", "y"), (None, None, None), ("b a\0b", "en\0de", "x"),
        ("b a", "en\0de", "y"), ("b a" * 3, "en\0de", "y"), ("a b", "en", "x"), ("a b", "en", "x"),
    ]
    extra = "terms string, v int, term string, n int, p int, block int"
    df = spark.createDataFrame([(*r, "t", 1, "t", 2, 3, 4) for r in rows], f"text string, lang string, source string, {extra}")
    for least in (1, 2, 3, 50):
        assert values(divergence.diverge(df, least_docs=least, top=2), *COLUMNS) == expected(rows, least, 2)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r[1], r[2], r[3]) for r in ODD]
    assert values(divergence.diverge(odd_docs, least_docs=1), *COLUMNS) == expected(rows, 1)
    assert values(divergence.diverge(odd_docs), *COLUMNS) == expected(rows)
    assert values(divergence.diverge(no_docs), *COLUMNS) == []


def test_rows_grow_with_terms_and_not_with_documents_or_blocks():
    """Counts by binary digit, documents up to as many as are asked for, each term in one block."""
    rng = random.Random(2)
    docs = [(rng.choice(["en", "de"]), rng.choice(["x", "y", ""]), [b"t%d" % rng.randrange(40) ** 2 for _ in range(30)]) for _ in range(900)]
    for blocks in (1, 6):
        gathered = divergence._Gathered(blocks, 3)
        counts, found, block_of = Counter(), Counter(), defaultdict(set)
        for lang, source, terms in docs:
            gathered.add(lang, source, terms)
        rows = list(gathered.rows())
        for block, source, weight, words in rows:
            assert words and len(set(words.split(" "))) == len(words.split(" "))
            for word in words.split(" "):
                block_of[word.partition(".")[2]].add(block)
                if source is None:
                    found[word] += 1
                else:
                    counts[source, word] += weight
        wanted = Counter((s, f"{lang.encode().hex()}.{t.decode()}") for lang, s, terms in docs for t in terms)
        assert counts == wanted
        assert found == Counter({word: 3 for _, word in wanted})  # all are in more documents than that
        assert {len(b) for b in block_of.values()} == {1}
        assert len(rows) < len(docs) / 2


def test_many_small_gatherings(spark, monkeypatch):
    """A term that reaches its documents only over several tasks and gatherings."""
    monkeypatch.setattr(divergence, "GATHERED", 0)
    monkeypatch.setattr(divergence, "ROW_TERMS", 2)
    rows = [(f"all all part{i % 5} own{i} " + "often " * i, "en", f"s{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    for least in (1, 2, 3, 12, 13):
        assert values(divergence.diverge(df, least_docs=least), *COLUMNS) == expected(rows, least)


def test_terms_of_all_tasks_meet_before_they_are_counted(spark):
    """Each digit of a count once, in however many tasks a term is."""
    names = [f"{'often ' * (i % 4)}all part{'vwxyz'[i % 5]} own{chr(0x430 + i)}" for i in range(40)]
    rows = [(text, lang, f"s{i % 3}") for i, text in enumerate(names) for lang in ("en", "de")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    found, docs = Counter(), Counter()
    for r in divergence._terms(divergence._texts(df, "lang", "source", "text"), 3).collect():
        for word in r.words.split(" "):
            found[r.source, r.weight, word] += 1
            docs[word] += r.source is None
    assert {n for (source, *_), n in found.items() if source is not None} == {1}
    counts = Counter()
    for source, weight, word in found:
        if source is not None:
            counts[source, word] += weight
    heads = {lang: f"{lang.encode().hex()}." for lang in ("en", "de")}
    assert counts == Counter((s, heads[lang] + t) for text, lang, s in rows for t in text.split())
    whole = Counter(heads[lang] + t for text, lang, _ in rows for t in set(text.split()))
    assert docs == Counter({word: min(n, 3) for word, n in whole.items()})


def test_parts_hold_what_was_gathered():
    """Through parts and back, over blocks and rows of few terms."""
    rng = random.Random(3)
    first, again = divergence._Gathered(5, 3), divergence._Gathered(5, 3)
    for _ in range(60):
        terms = [b"t" * (rng.randrange(12) ** 2 + 1) for _ in range(40)] + [b"own" * rng.randrange(1, 400)]
        first.add(rng.choice(["en", ""]), rng.choice(["x", ""]), terms)
    for _ in range(2):
        for _, lang, source, words, n in first.parts():
            assert 1 not in n
            again.add_part(lang, source, words.split(b" "), n.tolist(), len(n))
    assert again.counts == {key: Counter({t: 2 * n for t, n in own.items()}) for key, own in first.counts.items()}
    assert again.docs == {key: Counter({t: 2 * n for t, n in own.items()}) for key, own in first.docs.items()}


@pytest.mark.parametrize("blocks", [1, 3])
def test_fits_of_shares_of_blocks(spark, monkeypatch, blocks):
    """Blocks that are too large for one vocabulary have several, smaller ones share one."""
    monkeypatch.setattr(divergence, "BLOCKS", blocks)
    monkeypatch.setattr(divergence, "VOCABULARY", 12)
    rows = [(f"a b c d e f g h i j k l m n o part{'vwxyz'[i % 5]} own{chr(0x430 + i)}", "en", f"s{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert values(divergence.diverge(df), *COLUMNS) == expected(rows)


def test_vocabularies_are_not_read_by_the_driver(spark, monkeypatch):
    """Tasks ask the model for the place of a term."""

    def refuse(model):
        raise AssertionError("a vocabulary was read")

    monkeypatch.setattr(CountVectorizerModel, "vocabulary", property(refuse))
    rows = [(f"all all part{'vwxyz'[i % 5]} own{chr(0x430 + i)}", "en", f"s{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert values(divergence.diverge(df, least_docs=2), *COLUMNS) == expected(rows, 2)


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(0, 1, 1), (7, 10, 3), (10**17, 4 * 10**18, 10**9), (9 * 10**18, 9 * 10**18, 1)]
    df = spark.createDataFrame(rows, "n bigint, total bigint, terms bigint")
    found = [r.p for r in df.select(divergence._share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()]
    assert found == [1 + 10**9 * (n + 1) // (total + terms) for n, total, terms in rows]
