"""Quality scores by pairwise ranking.

A document has a worth that is linear in features of its text, and of two documents the one
with the larger worth is the better one (Bradley-Terry). The weights are learned from pairs
of a good and a bad document by logistic loss on the difference of their features. The
border between good and bad is a quantile of the worths of the labelled documents: the share
of bad ones among them.

Features are statistics of the whole text, each cut into ranges by its quantiles, so the
worth may rise and fall along a feature. Only the weights are fitted on a bounded sample: the
ranges, the border and the spread of the worths come from all labelled documents that may be
learned from, by Spark's quantile sketches, whose ranks are off by at most one part in
``RANGE_ACCURACY`` or ``BORDER_ACCURACY`` and exact for fewer rows.

Scale: statistics are taken in a narrow step, so texts are not shuffled; what meets the labels
are ``STATISTICS`` numbers a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import ROW, clean_text, keep, remove, slices, with_rows
from tidemark.llm.samples import by_label, fold

#: Rows to fit on: about so many in all, as many good as bad ones if there are.
TRAIN_ROWS = 3000
PAIRS = 20_000
RANGES = 8
RANGE_ACCURACY = 10_000
BORDER_ACCURACY = 100_000

_SYMBOLS = re.compile(r"[|#$%&*<>{}\[\]\\^~=_@]")
_MARKS = re.compile(r"[!?]")
_RUNS = re.compile(r"(\S)\1{2,}")
STATISTICS = 22


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; all zero without a word."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    n, chars = len(words), len(text)
    counts = Counter(words)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    small = codes[codes < 128]
    table = np.bincount(small, minlength=128)
    upper, lower, digits = table[65:91].sum(), table[97:123].sum(), table[48:58].sum()
    letters = max(1, upper + lower)
    lengths = np.fromiter(map(len, words), dtype=float, count=n)
    shares = table[table > 0] / max(1, len(small))
    ends = text.count(".") + text.count("!") + text.count("?")
    pairs = Counter(zip(words, words[1:]))
    return [
        float(np.log1p(n)),
        upper / letters,
        digits / chars,
        len(_SYMBOLS.findall(text)) / chars,
        len(_MARKS.findall(text)) / chars,
        text.count("|") / n,
        (chars - len(small)) / chars,
        float(lengths.mean()),
        float(lengths.std()),
        len(counts) / n,
        max(counts.values()) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        max(pairs.values(), default=0) / n,
        1 - len(line_counts) / max(1, len(lines)),
        n / max(1, len(lines)),
        n / max(1, ends),
        sum(w[0].isupper() for w in counts) / len(counts),
        sum(not w[-1].isalnum() for w in counts) / len(counts),
        sum(len(m[0]) for m in _RUNS.finditer(text)) / chars,
        float(-(shares * np.log2(shares)).sum()),
        sum(len(w) <= 3 for w in counts) / len(counts),
        text.count(",") / n,
    ]


@dataclass
class Model:
    edges: np.ndarray
    weights: np.ndarray
    border: float
    scale: float

    def ranges(self, x: np.ndarray) -> np.ndarray:
        """One-hot ranges: rows x (statistics * RANGES)."""
        place = (x[:, :, None] > self.edges[None]).sum(axis=2)
        out = np.zeros((len(x), x.shape[1], RANGES))
        np.put_along_axis(out, place[:, :, None], 1.0, axis=2)
        return out.reshape(len(x), -1)

    def worths(self, x: np.ndarray) -> np.ndarray:
        return self.ranges(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; from 0.5 on the worth is above the border."""
        if not len(self.weights):
            return np.full(len(x), 0.5)
        worth = self.worths(x)
        return 1 / (1 + np.exp(-np.clip((worth - self.border) / self.scale, -30, 30)))


def _unlearned(share: float) -> Model:
    return Model(np.zeros((STATISTICS, RANGES - 1)), np.zeros(0), share, 1.0)


def fit(
    x: np.ndarray, good: np.ndarray, bad_share: float, seed: int = 11, edges: np.ndarray | None = None
) -> Model:
    """Weights from pairs of good and bad rows; ``bad_share`` is that of all labelled rows.

    Ranges are those of ``edges``, or of the given rows; the border is that of the given rows.
    """
    if not good.any() or good.all():
        return _unlearned(bad_share)
    if edges is None:
        edges = np.quantile(x, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0).T
    model = Model(edges, np.zeros(0), 0.0, 1.0)
    z = model.ranges(x)
    rng = np.random.default_rng(seed)
    left = rng.choice(np.flatnonzero(good), PAIRS)
    right = rng.choice(np.flatnonzero(~good), PAIRS)
    w = v = np.zeros(z.shape[1])
    # differences of one-hot ranges have at most 2 * STATISTICS entries of size one
    step = 1 / (0.25 * 2 * STATISTICS + 1e-3)
    for t in range(400):
        worth = z @ v
        miss = 1 / (1 + np.exp(np.clip(worth[left] - worth[right], -30, 30)))
        pull = np.bincount(left, miss, len(z)) - np.bincount(right, miss, len(z))
        new = v + step * (z.T @ pull / PAIRS - 1e-3 * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    worth = z @ w
    weight = np.where(good, (1 - bad_share) / good.sum(), bad_share / (~good).sum())
    order = np.argsort(worth)
    below = np.cumsum(weight[order])
    k = int(np.searchsorted(below, bad_share - 1e-12))
    border = (worth[order[min(k, len(order) - 1)]] + worth[order[min(k + 1, len(order) - 1)]]) / 2
    return Model(edges, w, float(border), float(max(worth.std() / 4, 1e-9)))


def _edges(rows: DataFrame) -> np.ndarray:
    """The ranges of each statistic, from all ``rows``."""
    cuts = [float(c) for c in np.linspace(0, 1, RANGES + 1)[1:-1]]
    found = [F.percentile_approx(F.col("x")[i], cuts, RANGE_ACCURACY) for i in range(STATISTICS)]
    return np.array(list(rows.agg(*found).first()))


def _settle(model: Model, rows: DataFrame, bad: int, total: int) -> Model:
    """``model`` with the border between the worths of rank ``bad`` and the next, and the
    spread, of all ``rows``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array(batch.column(0).to_pylist()).reshape(batch.num_rows, STATISTICS)
            yield pa.RecordBatch.from_arrays([pa.array(model.worths(x), pa.float64())], names=["worth"])

    worth = rows.select("x").mapInArrow(work, "worth double")
    ranks = [(bad - 0.5) / total, (bad + 0.5) / total]
    cuts, spread = worth.agg(
        F.percentile_approx("worth", ranks, BORDER_ACCURACY), F.stddev_pop("worth")
    ).first()
    return replace(model, border=sum(cuts) / 2, scale=max(spread / 4, 1e-9))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    limit: int = TRAIN_ROWS,
    folds: int = 3,
    held_fold: int = 1,
) -> Model:
    """Learn from the labelled documents whose id is not in fold ``held_fold``: the weights
    from about ``limit`` of them, ranges and border from all.

    A document with several labels counts by their mean (half is good); labels of null ids
    or of no document are left out. Documents that repeat an id are one, that with the
    smallest statistics. Only the statistics of the sample and quantiles reach the driver.
    """
    marked = (
        labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("double").alias("q"))
        .filter(F.col("doc_id").isNotNull() & F.col("q").isNotNull())
        .filter(fold(F.col("doc_id"), folds) != held_fold)
        .groupBy("doc_id")
        .agg((F.avg("q") >= 0.5).alias("good"))
    )
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_text(text_col).alias("text")).filter(
        F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_fold)
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "x"])

    measured = texts.mapInArrow(work, "doc_id bigint, x array<double>")
    joined = measured.join(marked, "doc_id").groupBy("doc_id", "good").agg(F.min("x").alias("x"))
    labelled = keep(joined, "labelled")
    try:
        sample, sizes = by_label(labelled, "doc_id", "good", limit)
        total = sum(sizes.values())
        if len(sizes) < 2:
            return _unlearned(sizes.get(False, 0) / total if total else 0.5)
        rows = sorted(sample.collect(), key=lambda r: r.doc_id)
        x, good = np.array([r.x for r in rows]), np.array([r.good for r in rows], dtype=bool)
        model = fit(x, good, sizes[False] / total, edges=_edges(labelled))
        if not len(model.weights):
            return model
        return _settle(model, labelled, sizes[False], total)
    finally:
        remove(labelled)


def score(
    df: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 3,
    held_fold: int = 1,
) -> DataFrame:
    """``_row, doc_id, held_out, score, predicted`` for every row, from the whole text.

    Null and empty texts have a score like any other (that of a text without a word); if
    nothing was learned all scores are 0.5. A worth at the border itself scores 0.5 and counts
    as good; texts of any length are read whole. A null id counts as an empty text for
    ``held_out``. Narrow; ids may repeat, an empty table gives no rows, other columns are not
    touched.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()])
            found = pa.array(model.scores(x.reshape(batch.num_rows, STATISTICS)), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), found], names=["_row", "doc_id", "score"]
            )

    rows = with_rows(df.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_text(text_col).alias("text")))
    found = rows.select("_row", "doc_id", "text").mapInArrow(work, f"_row {ROW}, doc_id bigint, score double")
    return found.withColumn("held_out", fold(F.col("doc_id"), folds) == held_fold).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
