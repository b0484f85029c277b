"""Language identification and quality ranking: what they learn from, and how well."""

from __future__ import annotations

import binascii

import numpy as np
import pytest
from conftest import values
from tidemark.llm import lang_id, quality, samples

from .conftest import ODD, SF_DIR


@pytest.fixture(scope="module")
def language(real_docs):
    return lang_id.train(real_docs[0])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="module")
def worth(real_docs, labels):
    return quality.train(real_docs[0], labels)


def fold(doc, n):
    return binascii.crc32(("" if doc is None else str(doc)).encode()) % n


def test_language_held_out(real_docs, language):
    docs, rows = real_docs
    truth = {d: l for d, _, l in rows}
    found = lang_id.identify(docs, language).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_reads_only_the_training_folds(spark, real_docs, language):
    """Labels of the held-out fold do not change the model."""
    docs, _ = real_docs
    other = docs.withColumn("lang", samples.F.when(samples.fold(samples.F.col("doc_id"), 5) == 0, "zz").otherwise(samples.F.col("lang")))
    again = lang_id.train(other)
    assert again.families.classes == language.families.classes
    assert np.array_equal(again.families.weights, language.families.weights)


def test_language_odd_rows(spark, odd_docs, no_docs, language):
    found = lang_id.identify(odd_docs, language)
    got = {(r.doc_id, r.lang_pred, r.score) for r in found.collect() if r.lang_pred == "und"}
    assert got == {(i, "und", 0.0) for i in (3, 4, 5, 7, None)}
    assert found.count() == len(ODD)
    assert lang_id.identify(no_docs, language).count() == 0
    nothing = lang_id.train(no_docs)
    assert {r.lang_pred for r in lang_id.identify(odd_docs, nothing).collect()} == {"und"}
    one = lang_id.train(odd_docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in lang_id.identify(odd_docs, one).collect()} <= {"und", "en"}


def test_known_only(odd_docs, language):
    kept = lang_id.known_only(odd_docs, language)
    assert kept.columns == odd_docs.columns
    assert values(kept, "doc_id") == values(odd_docs.filter("text rlike '[a-zé]'"), "doc_id")


def test_settle_fills_and_rejects(spark, odd_docs, no_docs, language):
    """The model decides: another one gives other languages, and other rows where they are named."""
    rows = [(1, "the quick brown fox", None, 1), (2, "der schnelle braune fuchs und", " ", 2), (3, "the fox", "xx", 3), (4, "12", None, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _row int")
    found = values(lang_id.settle(df, language), "doc_id", "lang", "_row")
    assert [(i, lang) for i, lang, _ in found] == [(1, language.predict([rows[0][1]])[0][0]), (2, language.predict([rows[1][1]])[0][0]), (3, "xx")]
    turned = lang_id.Model(lang_id.Votes(language.families.classes, -language.families.weights), language.within)
    assert values(lang_id.settle(df, turned), "doc_id", "lang") != values(lang_id.settle(df, language), "doc_id", "lang")
    only = values(lang_id.settle(df, language, languages=(found[0][1],)), "doc_id")
    other = values(lang_id.settle(df, turned, languages=(found[0][1],)), "doc_id")
    assert (1,) in only and only != other
    nothing = lang_id.train(no_docs)
    assert values(lang_id.settle(df, nothing), "doc_id", "lang") == [(1, None), (2, " "), (3, "xx")]
    kept = lang_id.settle(odd_docs, language)
    assert kept.columns == odd_docs.columns and values(kept, "doc_id") == values(lang_id.known_only(odd_docs, language), "doc_id")
    assert lang_id.settle(no_docs, language).count() == 0


def test_training_does_not_depend_on_partitions(spark, real_docs):
    """Also where ids repeat with other texts and labels."""
    docs, _ = real_docs
    some = docs.filter("doc_id < 400").select("doc_id", "text", "lang")
    moved = some.selectExpr("(doc_id * 7) % 400 AS doc_id", "text", "lang")
    both = some.unionByName(moved)
    one, two = (lang_id.train(both.repartition(n, "text")) for n in (3, 7))
    assert np.array_equal(one.families.weights, two.families.weights)
    assert all(np.array_equal(one.within[f].weights, two.within[f].weights) for f in one.within)


def plain_features(text):
    """Counts of letter groups by the letter, in a dictionary of places."""
    letters = [32]
    for c in text.lower():
        code = ord(c)
        code = 32 if code < 128 and not "a" <= c <= "z" else code
        if code != 32 or letters[-1] != 32:
            letters.append(code)
    if letters[-1] != 32:
        letters.append(32)
    mask, counts = 2**64 - 1, {}
    for i in range(len(letters)):
        group = 0
        for size, salt in ((1, 3), (2, 5), (3, 7)):
            if i + size <= len(letters):
                group = letters[i] if size == 1 else (group * 0x1F123BB5 + letters[i + size - 1]) & mask
                place = ((group + salt) * 0x9E3779B97F4A7C15 & mask) >> 53
                counts[place] = counts.get(place, 0) + 1
    norm = sum(counts.values()) ** 0.5
    return {k: n**0.5 / norm for k, n in counts.items()}


def plain_chances(votes, x):
    """Every pair of classes votes; softened, raised and scaled to one."""
    n, k = len(votes.classes), 0
    if n == 1:
        return [1.0]
    out = [0.0] * n
    for a in range(n):
        for b in range(a + 1, n):
            w = votes.weights[k]
            vote = 1 / (1 + np.exp(-4 * (sum(w[place] * v for place, v in x.items()) + w[-1])))
            out[a] += vote
            out[b] += 1 - vote
            k += 1
    out = [(v / (n - 1)) ** max(1, n - 1) for v in out]
    return [v / sum(out) for v in out]


def test_language_of_every_row_by_brute_force(real_docs, language):
    docs, rows = real_docs
    found = {r.doc_id: r for r in lang_id.identify(docs, language).collect()}
    for doc, text, _ in rows:
        text = text or ""
        if not any(c.isalpha() for c in text):
            assert (found[doc].lang_pred, found[doc].score) == ("und", 0.0)
            continue
        x = plain_features(text)
        family = plain_chances(language.families, x)
        f = max(range(len(family)), key=lambda i: family[i])
        own = language.within[language.families.classes[f]]
        chance = plain_chances(own, x)
        k = max(range(len(chance)), key=lambda i: chance[i])
        assert found[doc].lang_pred == own.classes[k]
        assert abs(found[doc].score - family[f] * chance[k]) < 1e-9


def plain_statistics(text):
    """The statistics one by one, by loops over letters, words and lines."""
    words = text.split()
    if not words:
        return [0.0] * 22
    n, chars = len(words), len(text)
    kinds = {w: words.count(w) if n < 200 else 0 for w in words}
    if n >= 200:
        for w in words:
            kinds[w] += 1
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    pairs = {}
    for pair in zip(words, words[1:]):
        pairs[pair] = pairs.get(pair, 0) + 1
    small = [c for c in text if ord(c) < 128]
    table = {c: 0 for c in small}
    for c in small:
        table[c] += 1
    upper, lower = sum("A" <= c <= "Z" for c in small), sum("a" <= c <= "z" for c in small)
    runs, i = 0, 0
    while i < chars:
        j = i
        while j < chars and text[j] == text[i]:
            j += 1
        if j - i >= 3 and not text[i].isspace():
            runs += j - i
        i = j
    mean = sum(map(len, words)) / n
    ends = sum(c in ".!?" for c in text)
    return [
        np.log(1 + n), upper / max(1, upper + lower), sum("0" <= c <= "9" for c in small) / chars,
        sum(c in "|#$%&*<>{}[]\\^~=_@" for c in text) / chars, sum(c in "!?" for c in text) / chars,
        sum(c == "|" for c in text) / n, (chars - len(small)) / chars, mean,
        (sum((len(w) - mean) ** 2 for w in words) / n) ** 0.5, len(kinds) / n, max(kinds.values()) / n,
        sum(c for c in pairs.values() if c > 1) / n, max(pairs.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), n / max(1, ends),
        sum(w[0].isupper() for w in kinds) / len(kinds), sum(not w[-1].isalnum() for w in kinds) / len(kinds),
        runs / chars, -sum(c / len(small) * np.log2(c / len(small)) for c in table.values()),
        sum(len(w) <= 3 for w in kinds) / len(kinds), sum(c == "," for c in text) / n,
    ]


def test_quality_of_every_row_by_brute_force(real_docs, worth):
    docs, rows = real_docs
    found = {r.doc_id: r for r in quality.score(docs, worth).collect()}
    for doc, text, _ in rows:
        x = plain_statistics(text or "")
        assert np.allclose(x, quality.statistics(text or ""))
        x = quality.statistics(text or "")  # ranges are cut at values that rows have
        total = 0.0
        for i, value in enumerate(x):
            total += worth.weights[i * quality.RANGES + sum(value > edge for edge in worth.edges[i])]
        score = 1 / (1 + np.exp(-min(30, max(-30, (total - worth.border) / worth.scale))))
        assert abs(found[doc].score - score) < 1e-9
        assert found[doc].predicted == int(found[doc].score >= 0.5)


def test_long_texts_are_read_whole():
    text = "abc " * 200_000
    assert np.allclose(lang_id.features(text), lang_id.features("abc " * 1000), atol=1e-2)
    assert not np.array_equal(lang_id.features(text + "zebra " * 2000), lang_id.features(text))


def test_families_come_first():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, lang_id.SIZE)) * 0.01 for _ in range(3)])
    for k in range(3):
        x[60 * k : 60 * k + 60, k] += 1
    model = lang_id.fit(x, ["en"] * 60 + ["de"] * 60 + ["fr"] * 60)
    assert model.families.classes == ["germanic", "romance"]
    assert model.within["germanic"].classes == ["de", "en"] and len(model.within["germanic"].weights) == 1


def test_quality_held_out(real_docs, labels, worth):
    docs, _ = real_docs
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = quality.score(docs, worth).collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    good = np.array([r.score for r in held if truth[r.doc_id] == 1])
    bad = np.array([r.score for r in held if truth[r.doc_id] == 0])
    assert (good[:, None] > bad[None]).mean() >= 0.97
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_quality_learns_only_from_its_folds(spark, real_docs, labels, worth):
    docs, _ = real_docs
    flipped = labels.withColumn(
        "quality",
        samples.F.when(samples.fold(samples.F.col("doc_id"), 3) == 1, 1 - samples.F.col("quality")).otherwise(samples.F.col("quality")),
    )
    again = quality.train(docs, flipped)
    assert np.array_equal(again.weights, worth.weights) and again.border == worth.border


def test_quality_border_and_ranges_are_those_of_all_labelled_rows(real_docs, labels):
    docs, rows = real_docs
    model = quality.train(docs, labels, limit=60)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    learned = [(t, truth[d]) for d, t, _ in rows if d in truth and fold(d, 3) != 1]
    x = np.array([quality.statistics(t or "") for t, _ in learned])
    cuts = np.linspace(0, 1, quality.RANGES + 1)[1:-1]
    assert np.array_equal(model.edges, np.quantile(x, cuts, axis=0, method="inverted_cdf").T)
    bad, worth = sum(q == 0 for _, q in learned), np.sort(model.worths(x))
    assert np.isclose(model.border, (worth[bad - 1] + worth[bad]) / 2)
    assert np.isclose(model.scale, worth.std() / 4)


def test_quality_odd_rows(spark, odd_docs, no_docs, labels, worth):
    found = quality.score(odd_docs, worth)
    assert found.count() == len(ODD) and found.filter("score IS NULL").count() == 0
    assert quality.score(no_docs, worth).count() == 0
    for docs, marks in ((no_docs, labels), (odd_docs, labels.limit(0)), (odd_docs, labels.filter("quality = 1"))):
        unlearned = quality.train(docs, marks)
        assert {r.score for r in quality.score(odd_docs, unlearned).collect()} == {0.5}


def test_ranking_recovers_an_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, quality.STATISTICS))
    good = x[:, 3] - x[:, 5] > -0.5
    model = quality.fit(x, good, float((~good).mean()))
    assert ((model.scores(x) >= 0.5) == good).mean() > 0.93


def test_samples_are_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 10 = 0, 'a', 'b') AS lang")
    sample, sizes = samples.by_label(rows, "doc_id", "lang", 400)
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert sizes == {"a": 500, "b": 4500} and all(140 < n < 260 for n in counts.values())
    repeated = spark.range(3000).selectExpr("5 AS doc_id", "'a' AS lang")
    assert samples.by_label(repeated, "doc_id", "lang", 5000)[0].count() == 1
    with pytest.raises(ValueError):
        samples.by_label(spark.range(1500).selectExpr("id AS doc_id", "string(id) AS lang"), "doc_id", "lang", 10)
