"""How the sources of a language differ in their words, term by term and pair by pair.

Texts are read once. Tasks gather their documents first and the gathered terms are gathered again
by hash, so that each term is handled once per source and not once per occurrence or task: the
count of a term in a source becomes rows of binary digits (a row per digit holds the terms whose
count has it), the number of its documents as many rows as there are, ``least_docs`` at most, which
leaves the same terms. ``CountVectorizer`` learns the terms in enough of these and turns each row
into an exact sparse vector (its limit on terms is the largest integer, so it never cuts). A term is
written behind its language, so one fit holds a vocabulary of its own for each. Fits are bounded
all the same, as ``CountVectorizer`` learns a vocabulary in the driver's JVM: terms are dealt by hash
into ``BLOCKS`` blocks, and a fit has as many blocks, or such a share of one, as cannot have more than
about ``VOCABULARY`` kept terms. Nothing else of it is in the driver: tasks get the place of a term from
the model. Results do not depend on either number, nor on when tasks give rows.

The vectors are summed by source without ever being dense: tasks add up the entries of a
batch, and Spark adds those. From these sums everything else follows. A term that neither of
two sources has contributes the same everywhere, and one that only one of them has contributes
by its count alone; so a pair is evaluated from two histograms of counts and the terms that
both have. All arithmetic is in integers and exact decimals.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import keep, remove, slices
from tidemark.session import run_dir

#: Kept terms of one vocabulary, at most, and blocks of terms that are dealt out.
VOCABULARY = 100_000
BLOCKS = 64
#: Rows of shares that one task compares, about, and pairs of them at a time.
COMPARED = 300_000
PAIRS = 1 << 20
#: The largest integer.
NO_LIMIT = (1 << 31) - 1
UNIT = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Counts that a task gathers before it gives rows, about, and terms of one row.
GATHERED = 800_000
ROW_TERMS = 500

#: Stands between a language (in hexadecimal digits) and a term; terms never hold it.
BREAK = "."
#: Everything that is no letter of a term becomes a space, A-Z become a-z.
LETTERS = bytes(
    b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order."""
    return text.encode("utf-8", "replace").translate(LETTERS).split()


def _head(lang: str) -> bytes:
    return lang.encode("utf-8", "replace").hex().encode() + BREAK.encode()


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _texts(df: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return df.select(
        _empty(lang_col).alias("lang"), _empty(source_col).alias("source"), _empty(text_col).alias("text")
    )


class _Gathered:
    """What a task has read since it last gave rows: per source the counts of its terms, and in
    how many documents a term is, up to ``least_docs``. Terms stand behind their language."""

    def __init__(self, blocks: int, least_docs: int):
        self.blocks, self.least_docs = blocks, least_docs
        self.counts: dict[tuple[str, str], Counter[bytes]] = {}
        self.docs: dict[str, Counter[bytes]] = {}
        self.enough: dict[str, set[bytes]] = {}

    def add(self, lang: str, source: str, terms: list[bytes]) -> None:
        self.counts.setdefault((lang, source), Counter()).update(terms)
        docs, enough = self.docs.setdefault(lang, Counter()), self.enough.setdefault(lang, set())
        few = set(terms) - enough
        docs.update(few)
        enough.update([t for t in few if docs[t] >= self.least_docs])

    def add_part(self, lang: str, source: str | None, terms: list[bytes], n: list[int], many: int) -> None:
        """Take what another task has given as one of its :meth:`parts`."""
        if source is None:
            found = self.docs.setdefault(lang, Counter())
        else:
            found = self.counts.setdefault((lang, source), Counter())
        before = found.get
        for term, more in zip(terms[:many], n):
            found[term] = before(term, 0) + more
        found.update(terms[many:])

    def size(self) -> int:
        return sum(map(len, self.counts.values())) + sum(map(len, self.docs.values()))

    def parts(self) -> Iterator[tuple[int, str, str | None, bytes, np.ndarray]]:
        """``block, lang, source, words, n``: terms, and the counts of the first of them or, without
        a source, the numbers of their documents; the other terms have 1."""
        every = [(*key, found) for key, found in self.counts.items()]
        for lang, source, found in every + [(lang, None, found) for lang, found in self.docs.items()]:
            names = np.fromiter(found, dtype=object, count=len(found))
            n = np.fromiter(found.values(), dtype=np.int64, count=len(found))
            block = np.fromiter(map(zlib.crc32, found), dtype=np.int64, count=len(found)) % self.blocks
            # small integers are sorted in linear time
            order = np.argsort((2 * block + (n == 1)).astype(np.min_scalar_type(2 * self.blocks)), kind="stable")
            names, n = names[order], n[order]
            ends = np.cumsum(np.bincount(block, minlength=self.blocks)).tolist()
            for at, (first, end) in enumerate(zip([0, *ends], ends)):
                for start in range(first, end, ROW_TERMS):
                    own = slice(start, min(start + ROW_TERMS, end))
                    yield at, lang, source, b" ".join(names[own].tolist()), n[own][n[own] != 1]

    def rows(self) -> Iterator[tuple[int, str | None, int, str]]:
        """``block, source, weight, words``. The count of a term is the sum of the weights of
        the rows that it is in, one per binary digit; rows without a source have a term as often
        as it has documents, or ``least_docs`` times."""
        for lang, found in self.docs.items():
            for enough in range(1, self.least_docs + 1):
                names = [t for t, n in found.items() if n >= enough]
                if not names:
                    break
                yield from self._dealt(lang, None, 0, names)
        for (lang, source), found in self.counts.items():
            names = np.fromiter(found, dtype=object, count=len(found))
            n = np.fromiter(found.values(), dtype=np.int64, count=len(found))
            for digit in range(int(n.max(initial=0)).bit_length()):
                yield from self._dealt(lang, source, 1 << digit, names[(n >> digit & 1).astype(bool)].tolist())

    def _dealt(self, lang: str, source: str | None, weight: int, terms: list[bytes]) -> Iterator[tuple]:
        head = _head(lang)
        of_block: list[list[bytes]] = [[] for _ in range(self.blocks)]
        if self.blocks == 1:
            of_block[0] = terms
        else:
            for t in terms:
                of_block[zlib.crc32(t) % self.blocks].append(t)
        for block, own in enumerate(of_block):
            for start in range(0, len(own), ROW_TERMS):
                words = head + (b" " + head).join(own[start : start + ROW_TERMS])
                yield block, source, weight, words.decode("utf-8", "replace")


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 512)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*some), kinds)], names=names)


def _terms(texts: DataFrame, least_docs: int) -> DataFrame:
    """``block, source, weight, words``: the terms of the documents as :class:`_Gathered` gives
    them, gathered by task and then by block: few rows with each term once, however often it is
    there and in however many tasks."""
    blocks = BLOCKS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "lang", "source", "words", "n"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        gathered = _Gathered(blocks, least_docs)
        for batch in slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if found := terms_of(text):
                    gathered.add(lang, source, found)
            if gathered.size() > GATHERED:
                yield from _batches(gathered.parts(), names, kinds)
                gathered = _Gathered(blocks, least_docs)
        yield from _batches(gathered.parts(), names, kinds)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "source", "weight", "words"]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.string()]
        gathered = _Gathered(blocks, least_docs)
        for batch in slices(batches):
            lists = batch.column(3)
            n, size = lists.flatten().to_numpy().tolist(), lists.value_lengths().to_pylist()
            start = 0
            for lang, source, words, many in zip(*(c.to_pylist() for c in batch.columns[:3]), size):
                gathered.add_part(lang, source, words.split(b" "), n[start : start + many], many)
                start += many
            if gathered.size() > GATHERED:
                yield from _batches(gathered.rows(), names, kinds)
                gathered = _Gathered(blocks, least_docs)
        yield from _batches(gathered.rows(), names, kinds)

    parts = texts.select("lang", "source", "text").mapInArrow(
        gather, "block int, lang string, source string, words binary, n array<bigint>"
    )
    dealt = parts.repartition("block").select("lang", "source", "words", "n")
    return dealt.mapInArrow(merge, "block int, source string, weight bigint, words string")


def _vocabularies(rows: DataFrame, least_docs: int) -> list[tuple[list[int], int, int]]:
    """``blocks, share, shares``: the blocks of each fit, or the share of a block that is too large
    for one. A term is kept by ``least_docs`` of its rows, which bounds the kept terms of a block."""
    words = F.size(F.split("words", " "))
    found = rows.filter("source IS NULL").groupBy("block").agg(F.sum(words).alias("n")).orderBy("block").collect()
    fits, whole, size = [], [], 0
    for block, n in ((r.block, r.n // least_docs) for r in found):
        if n > VOCABULARY:
            shares = -(-n // VOCABULARY)
            fits += [([block], share, shares) for share in range(shares)]
            continue
        if whole and size + n > VOCABULARY:
            fits.append((whole, 0, 1))
            whole, size = [], 0
        whole, size = [*whole, block], size + n
    return [*fits, (whole, 0, 1)] if whole else fits


def _entries(vectors: DataFrame) -> DataFrame:
    """``source, at, n``: sums of the entries of sparse vectors (``source, weight, v``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(0).dictionary_encode()
            vector = batch.column(2)
            at, values = vector.field("indices"), vector.field("values")
            sizes = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            place = at.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(sources.indices.to_numpy().astype(np.int64), sizes)
            width = int(place.max(initial=0)) + 1
            weight = np.repeat(batch.column(1).to_numpy(), sizes)
            # exact: no sum of a batch comes near 2^53
            keys, count = owner * width + place, values.flatten().to_numpy() * weight
            if len(sources.dictionary) * width <= 4 * len(keys):
                sums = np.bincount(keys, weights=count)
                keys = np.flatnonzero(sums)
                sums = sums[keys]
            else:
                keys, group = np.unique(keys, return_inverse=True)
                sums = np.bincount(group, weights=count)
            yield pa.RecordBatch.from_arrays(
                [
                    sources.dictionary.take(pa.array(keys // width)),
                    pa.array((keys % width).astype(np.int32)),
                    pa.array(sums.astype(np.int64)),
                ],
                names=["source", "at", "n"],
            )

    parts = vectors.select("source", "weight", "v").mapInArrow(work, "source string, at int, n bigint")
    return parts.groupBy("source", "at").agg(F.sum("n").alias("n"))


def _fit_counts(rows: DataFrame, share: int, shares: int, least_docs: int) -> DataFrame:
    """``lang, source, term, n`` for the kept terms of one fit, where ``n`` is not 0."""
    spark = rows.sparkSession
    terms = F.split("words", " ")
    if shares > 1:
        terms = F.filter(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(shares)) == share)
    found = rows.select("source", "weight", terms.alias("terms"))
    docs, counts = found.filter("source IS NULL"), found.filter("source IS NOT NULL")
    # so many documents of nothing, so that a vocabulary is never empty
    none = spark.range(least_docs).select(F.array(F.lit(BREAK)).alias("terms"))
    learn = CountVectorizer(inputCol="terms", outputCol="v", minDF=float(least_docs), vocabSize=NO_LIMIT)
    model = learn.fit(docs.select("terms").unionByName(none))
    # each term by itself, so that the model tells its place and the driver hands out no words
    alone = docs.select(F.explode("terms").alias("term")).distinct().select("term", F.array("term").alias("terms"))
    vocabulary = model.transform(alone).select(
        F.explode(F.unwrap_udt("v")["indices"]).alias("at"),
        F.decode(F.unhex(F.substring_index("term", BREAK, 1)), "UTF-8").alias("lang"),
        F.substring_index("term", BREAK, -1).alias("term"),
    )
    sums = _entries(model.transform(counts))
    return sums.join(vocabulary, "at").select("lang", "source", "term", "n")


def term_counts(
    df: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """``lang, source, term, n``: how often each term occurs in the documents of each source of
    a language, for the terms in ``least_docs`` documents of that language or more, where it
    does at all.

    A null language, source or text counts as empty; rows count one by one, repeats too. A
    table without such terms, or without rows, gives an empty result.
    """
    texts = _texts(df, lang_col, source_col, text_col)
    spark = texts.sparkSession
    rows = keep(_terms(texts, least_docs), "terms", layout=("block",), compression="zstd")
    columns = "lang string, source string, term string, n bigint"
    path = run_dir(spark, "term_counts")
    spark.createDataFrame([], columns).write.parquet(path)
    for blocks, share, shares in _vocabularies(rows, least_docs):
        own = rows.filter(F.col("block").isin(blocks)).select("source", "weight", "words")
        _fit_counts(own, share, shares, least_docs).write.mode("append").parquet(path)
    remove(rows)
    return spark.read.schema(columns).parquet(path)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + terms))``, exact for every count of 64 bits; where
    64 bits hold all parts, without decimals."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"))
    below = total.cast("decimal(19,0)") + terms.cast("decimal(19,0)")
    exact = F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)"))
    count, total, terms = (c.cast("bigint") for c in (count, total, terms))
    small = (count < 9 * UNIT) & (total < 1 << 62) & (terms < 1 << 62)
    return F.when(small, F.call_function("div", UNIT * (count + 1), total + terms)).otherwise(exact) + 1


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def diverge(
    df: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of every language.

    Terms are runs of letters (a-z, with A-Z lower-cased, and everything beyond ASCII); kept are
    those in ``least_docs`` documents of a language. With ``n`` occurrences of a term and ``N`` of
    all ``V`` kept ones, a source or a language gives it the share ``p`` of :func:`_share`, also
    where ``n`` is 0. The gap of two shares is ``floor((p - q)**2 / q)``.

    - ``pair``: each other source of the language, by the gaps to it, over all kept terms;
    - ``term``: the ``top`` terms that a source has and uses more than its language does, by
      their gaps to the language.

    ``rank`` counts from 1 within source and part; of equal values the item that is smaller
    in UTF-8 comes first. Null languages, sources and texts count as empty. Sources without
    kept terms have pairs (of value 0 where the language keeps no term) and no terms;
    languages of one source have no pairs. Texts of any length are read whole, repeated rows
    count one by one, other columns are not touched, and an empty table gives no rows.
    """
    counts = term_counts(df, lang_col, source_col, text_col, least_docs)
    every = _texts(df, lang_col, source_col, text_col).select("lang", "source").distinct()
    words = keep(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")), "term_sums")
    of_lang = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"))
    nothing = {"total": 0, "terms": 0, "own_terms": 0}
    groups = every.join(own, ["lang", "source"], "left").join(of_lang.select("lang", "terms"), "lang", "left")
    groups = keep(
        groups.fillna(nothing).withColumn(
            # the share of a term that the source does not have
            "none",
            F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))),
        ),
        "term_groups",
    )
    shares = keep(
        counts.join(groups.select("lang", "source", "total", "terms", "none"), ["lang", "source"]).select(
            "lang", "source", "term", "n", "none", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")
        ),
        "term_shares",
    )
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _pairs(groups, shares).select("*", F.lit("pair").alias("part"), F.row_number().over(place).alias("rank"))
    terms = _distinctive(words, of_lang, shares).select(
        "*", F.lit("term").alias("part"), F.row_number().over(place).alias("rank")
    )
    return pairs.select(*names).unionByName(terms.filter(F.col("rank") <= top).select(*names))


def _distinctive(words: DataFrame, of_lang: DataFrame, shares: DataFrame) -> DataFrame:
    mean = words.join(of_lang, "lang").select(
        "lang", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("q")
    )
    return (
        shares.join(mean, ["lang", "term"])
        .filter("p > q")
        .select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    )


def _shared(shares: pa.Table) -> pa.Table:
    """``lang, source, item, s``: over the terms that two sources both have, the sum of
    ``f(p, q) - f(p, 0) - f(0, q) + f(0, 0)``, for every two sources of some terms."""

    def codes(column: str) -> tuple[np.ndarray, pa.Array]:
        encoded = shares[column].combine_chunks().dictionary_encode()
        return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary

    def gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x - y) ** 2 // y

    (lang, langs), (term, terms), (source, sources) = codes("lang"), codes("term"), codes("source")
    order = np.argsort(lang * len(terms) + term, kind="stable")
    lang, term, source = lang[order], term[order], source[order]
    p, none = (shares[c].to_numpy()[order] for c in ("p", "none"))
    first = np.flatnonzero(np.diff(lang * len(terms) + term, prepend=-1))
    sizes = np.diff(np.append(first, len(order)))
    start, width = np.repeat(first, sizes), np.repeat(sizes, sizes)
    out: dict[int, int] = {}
    ends = np.cumsum(width)
    begin = 0
    while begin < len(order):
        # so many rows that their pairs are not too many at a time
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
        own = slice(begin, stop)
        i = np.repeat(np.arange(begin, stop), width[own])
        j = np.arange(len(i)) - np.repeat(np.cumsum(width[own]) - width[own], width[own]) + start[i]
        differ = source[i] != source[j]
        i, j = i[differ], j[differ]
        value = gap(p[i], p[j]) - gap(p[i], none[j]) - gap(none[i], p[j]) + gap(none[i], none[j])
        pair, at = np.unique((lang[i] * len(sources) + source[i]) * len(sources) + source[j], return_inverse=True)
        sums = np.zeros(len(pair), dtype=np.int64)
        np.add.at(sums, at, value)
        for k, v in zip(pair.tolist(), sums.tolist()):
            out[k] = out.get(k, 0) + v
        begin = stop
    found = np.array(list(out), dtype=np.int64)
    rest, b = np.divmod(found, max(1, len(sources)))
    of, a = np.divmod(rest, max(1, len(sources)))
    columns = [langs.take(pa.array(of)), sources.take(pa.array(a)), sources.take(pa.array(b))]
    return pa.table([*columns, pa.array(list(out.values()), pa.int64())], names=["lang", "source", "item", "s"])


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """The sum of gaps over all kept terms, for every two sources of a language.

    With ``f`` the gap and 0 the share of a missing term, the sum over all terms is that of
    ``f(p, 0)`` and ``f(0, q)`` less ``f(0, 0)`` each, and for terms that both have, of
    ``f(p, q) - f(p, 0) - f(0, q) + f(0, 0)`` besides. The first two depend on counts only.
    """
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("q0"))
    pairs = groups.join(others, "lang").filter("source <> item").select("lang", "source", "item", "terms", "none", "q0")
    # how many terms have a share: those of a count, and those that the source does not have
    counted = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).unionByName(
        groups.filter("terms > 0").select(
            "lang", "source", F.col("none").alias("p"), (F.col("terms") - F.col("own_terms")).alias("m")
        )
    )
    spread = counted.join(others, "lang").filter("source <> item")
    own = spread.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _gap("p", "q0")).alias("s"))
    mirror = counted.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "m").join(
        groups.select("lang", "source", F.col("none").alias("p0")), "lang"
    ).filter("source <> item")
    other = mirror.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _gap("p0", "q")).alias("s"))
    # all sources of a term lie in one group
    n_groups = 1 + shares.count() // COMPARED
    group = F.pmod(F.xxhash64("lang", "term"), F.lit(n_groups)).alias("group")
    both = (
        shares.groupBy(group)
        .applyInArrow(_shared, "lang string, source string, item string, s bigint")
        .groupBy("lang", "source", "item")
        .agg(F.sum("s").alias("s"))
    )
    base = pairs.select("lang", "source", "item", (-F.col("terms") * _gap("none", "q0")).alias("s"))
    sums = base.fillna({"s": 0}).unionByName(own).unionByName(other).unionByName(both)
    return sums.groupBy("lang", "source", "item").agg(F.sum("s").alias("value"))
