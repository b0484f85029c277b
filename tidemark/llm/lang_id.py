"""Language identification in two steps: the family, then the languages within it.

Texts become counts of letter groups (one to three letters, words bounded by a space),
hashed to ``SIZE`` places, damped and scaled to length one. One linear support vector machine
for each pair of families votes on the family; then one for each pair of languages of that family votes
on the language. All are fitted on the driver on a bounded sample of labelled rows; a
prediction reads nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import ROW, clean_text, slices, with_rows
from tidemark.llm.samples import by_label, fold

UNKNOWN = "und"
SIZE = 1 << 11
#: Rows to fit on: about so many in all, the same number of each language.
TRAIN_ROWS = 1600

#: Families of languages by their codes. Any other language is one of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "indic": "hi mr ne bn pa gu ur",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Hashed counts of letter groups of the whole text, damped, of length one (or zero)."""
    lower = text.lower()
    codes = np.frombuffer(lower.encode("utf-32-le", "replace"), dtype="<u4")
    out = np.zeros(SIZE)
    # whole text, some letters at a time
    for start in range(0, len(codes), 1 << 18):
        part = codes[max(0, start - 2) : start + (1 << 18)].astype(np.uint64)
        ascii_other = (part < 128) & ~((part >= 97) & (part <= 122))
        part[ascii_other] = 32
        part = np.concatenate([[32], part, [32]]).astype(np.uint64)
        part = part[(part != 32) | np.append(True, part[:-1] != 32)]
        with np.errstate(over="ignore"):
            two = part[:-1] * np.uint64(0x1F123BB5) + part[1:]
            three = two[:-1] * np.uint64(0x1F123BB5) + part[2:]
            for group, salt in ((part, 3), (two, 5), (three, 7)):
                place = (group + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
                out += np.bincount((place >> np.uint64(53)).astype(np.int64), minlength=SIZE)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def fit_pair(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Linear support vector machine with squared hinge loss for labels +1 and -1; the last
    weight is the bias. Both classes weigh the same. Accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (decay + 4)
    w = v = np.zeros(x.shape[1])
    for t in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (decay * v - 2 * x.T @ (share * miss * y))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass
class Votes:
    """One machine per pair of classes."""

    classes: list[str]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Votes:
        classes = sorted(set(y.tolist()))
        machines = []
        for a, b in combinations(classes, 2):
            own = (y == a) | (y == b)
            machines.append(fit_pair(x[own], np.where(y[own] == a, 1.0, -1.0)))
        return Votes(classes, np.array(machines).reshape(len(machines), x.shape[1] + 1))

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Rows x classes, each row adds up to one: the mean of the softened votes."""
        if len(self.classes) == 1:
            return np.ones((len(x), 1))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        vote = 1 / (1 + np.exp(-4 * margin))
        out = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
            out[:, a] += vote[:, k]
            out[:, b] += 1 - vote[:, k]
        # a class that wins all its votes is certain
        out = (out / (len(self.classes) - 1)) ** max(1, len(self.classes) - 1)
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


@dataclass
class Model:
    families: Votes
    within: dict[str, Votes]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text; without a letter, ``und`` and 0."""
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not known or not self.within:
            return out
        x = np.array([features(texts[i]) for i in known])
        family = self.families.chances(x)
        best = family.argmax(axis=1)
        for f, name in enumerate(self.families.classes):
            own = np.flatnonzero(best == f)
            if not len(own):
                continue
            chance = self.within[name].chances(x[own])
            top = chance.argmax(axis=1)
            for row, k, c in zip(own.tolist(), top.tolist(), chance.tolist()):
                score = float(min(1.0, family[row, f] * c[k]))
                out[known[row]] = (self.within[name].classes[k], score)
        return out


def fit(x: np.ndarray, languages: list[str]) -> Model:
    labels = np.array(languages, dtype=object)
    if not len(labels):
        return Model(Votes([], np.zeros((0, SIZE + 1))), {})
    family = np.array([FAMILY.get(c.lower().split("-")[0], c) for c in languages], dtype=object)
    within = {f: Votes.fit(x[family == f], labels[family == f]) for f in sorted(set(family))}
    return Model(Votes.fit(x, family), within)


def train(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    limit: int = TRAIN_ROWS,
    folds: int = 5,
) -> Model:
    """Fit on about ``limit`` rows with a label whose id is not in fold 0 of ``folds``.

    Rows without a label, and texts without a letter, are not learned from; of rows that repeat
    an id, the one with the smallest digest of its text and smallest label is. The model is the
    same however the table is partitioned. Without any such row nothing is learned. Only features of the sampled rows (``limit`` x ``SIZE`` numbers) reach the driver.
    """
    rows = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        clean_text(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).filter((F.trim("lang") != "") & (F.col("lang") != UNKNOWN) & (fold(F.col("doc_id"), folds) != 0))
    sample, _ = by_label(rows, "doc_id", "lang", limit, (F.sha2("text", 256),))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [features(t).astype("<f4").tobytes() if has_letter(t) else None for t in texts]
            columns = [batch.column(0), batch.column(2), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "x"])

    found = sample.mapInArrow(work, "doc_id bigint, lang string, x binary").filter("x IS NOT NULL")
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.x, dtype="<f4") for r in rows], dtype=float).reshape(len(rows), SIZE)
    return fit(x, [r.lang for r in rows])


def identify(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5
) -> DataFrame:
    """``_row, doc_id, held_out, lang_pred, score`` for every row, from the whole text.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if
    nothing was learned. Of languages with equal chances the one that sorts first is taken.
    ``held_out`` tells fold 0; a null id counts as an empty text there. Narrow; ids may repeat,
    every row is predicted on its own, an empty table gives no rows, other columns are not
    touched.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = model.predict(batch.column(2).to_pylist())
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "lang_pred", "score"])

    rows = with_rows(df.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_text(text_col).alias("text")))
    found = rows.select("_row", "doc_id", "text").mapInArrow(
        work, f"_row {ROW}, doc_id bigint, lang_pred string, score double"
    )
    return found.withColumn("held_out", fold(F.col("doc_id"), folds) == 0)


def settle(
    df: DataFrame,
    model: Model,
    text_col: str = "text",
    lang_col: str = "lang",
    languages: tuple[str, ...] | None = None,
) -> DataFrame:
    """The rows of ``df`` whose text has a language, with that language where none was given.

    Rejected are null texts and texts without a letter, and, where ``languages`` are named, texts
    that the model finds to be in another one. A null or blank ``lang_col`` is filled with the
    prediction; a language that was given stays, and all other columns pass as they are,
    whatever their names. A low score is no reason to reject. If nothing was learned, texts
    with a letter stay as they are. Narrow: rows, repeated ones too, are judged one by one, texts
    of any length as a whole, equal chances as in :func:`identify`; an empty table stays empty.
    """
    names = [f.name for f in df.schema]
    at, lang = names.index(text_col), names.index(lang_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if model.within:
                found = [language for language, _ in model.predict(texts)]
                kept = [x != UNKNOWN and (languages is None or x in languages) for x in found]
            else:
                found, kept = [None] * len(texts), [has_letter(t) for t in texts]
            given = batch.column(lang).to_pylist()
            filled = [f if f is not None and not (g or "").strip() else g for g, f in zip(given, found)]
            columns = list(batch.columns)
            columns[lang] = pa.array(filled, columns[lang].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(work, df.schema)


def known_only(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text can have a language; narrow. Rows, repeated ones too, are
    judged one by one; an empty table stays empty.

    All columns pass as they are. A text that is known but scored low stays, and so does
    every text with a letter if nothing was learned: only texts without a letter and null
    texts are rejected.
    """
    at = [f.name for f in df.schema].index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = batch.column(at).to_pylist()
            if model.within:
                kept = [language != UNKNOWN for language, _ in model.predict([t or "" for t in texts])]
            else:
                kept = [has_letter(t or "") for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(work, df.schema)
