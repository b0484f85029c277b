"""Packing documents into token windows, online and with a bounded number of open windows.

Every task keeps ``OPEN`` windows. What a document leaves over its full windows goes into the
open window in which it leaves the least room. If it fits none, its head fills the fullest
window, which is emitted, and the rest is placed the same way; so only the windows that are
open at the end are not full. Those are merged: first inside the task, which leaves one
window, then the windows of ``FAN_IN`` tasks in one, and again until one window is left. A
merge task holds ``FAN_IN`` windows at most, and only the very last window is padded.

Everything that a task decides follows from the order of its rows; the result is written
once, so a sequence never mixes two attempts of a task.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import clean_text, give_back, keep

WINDOW = 4096
OPEN = 32
FAN_IN = 64
END = 2
#: Bytes of words and ids that a Python worker remembers from task to task. Beyond them it keeps
#: those that have just come again, which costs time and nothing else.
REMEMBERED = 32 << 20
#: What a word takes besides its letters and ids: its ends in two arrays.
WORD_BYTES = 12
#: Longer words are not remembered.
LONGEST = 64
#: Unseen words that are encoded together.
TOGETHER = 2000
#: Rows and bytes of text that are cut into words together.
SLICE_ROWS = 4096
SLICE_BYTES = 4 << 20


class WordIds:
    """Ids by a ``tokenizers`` file whose words end at spaces, remembered by word.

    The tokenizer drops white space and merges inside words only, so a text may be cut at
    its spaces and line ends; what else counts as white space is left to the tokenizer. Arrow
    cuts the texts of a slice and numbers their words; each different word is looked up once,
    and the ids of the texts are gathered from one array by the places of their words.
    """

    def __init__(self, path: str, remembered: int | None = None):
        self.remembered = REMEMBERED if remembered is None else remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[0] if self.special else None
        self.forget()

    def forget(self) -> None:
        """Let go of all words."""
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, dtype="<u4")
        self.ends = np.zeros(1, dtype=np.int64)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        sizes = np.array([len(e.ids) for e in found], dtype=np.int64)
        return np.concatenate([np.array(e.ids, dtype="<u4") for e in found]), sizes

    def _new(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Unseen words in some order, their ids and how many each has. A special token always
        ends what stands before it, so one between words lets many be encoded as one text; words
        that hold one are not."""
        plain, odd = [], []
        for word in words:
            (odd if self.mark is None or any(s in word for s in self.special) else plain).append(word)
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        mark = self.tokenizer.token_to_id(self.mark) if plain else None
        for start in range(0, len(plain), TOGETHER):
            own = plain[start : start + TOGETHER]
            (found,) = self.tokenizer.encode_batch_fast([self.mark.join(own)], add_special_tokens=False)
            part = np.array(found.ids, dtype="<u4")
            marks = np.flatnonzero(part == mark)
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(part)]])) - 1)
            ids.append(np.delete(part, marks))
        if odd:
            more, many = self._alone(odd)
            ids.append(more)
            sizes.append(many)
        return plain + odd, np.concatenate(ids), np.concatenate(sizes)

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words: one array, and where each word's begin and end in it."""
        number = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(number)
        order, ids, sizes = self._new(words.filter(missing).to_pylist())
        new = pa.array(order, pa.string())
        pool = np.concatenate([self.ids, ids])
        stops = np.concatenate([self.ends, len(self.ids) + np.cumsum(sizes)])
        if len(order):
            later = pc.add(pc.index_in(words, value_set=new), len(self.words))
            number = pc.if_else(missing, later, number)
        number = number.to_numpy(zero_copy_only=False).astype(np.int64)
        starts, stops_of = stops[number], stops[number + 1]
        self._remember(new, ids, sizes, number[~missing.to_numpy(zero_copy_only=False)])
        return pool, starts, stops_of

    def held(self) -> int:
        """Bytes that the memory takes."""
        return self.words.nbytes + self.ids.nbytes + self.ends.nbytes

    def _only(self, numbers: np.ndarray) -> None:
        """Let go of all words but those of some numbers."""
        starts, sizes = self.ends[numbers], np.diff(self.ends)[numbers]
        after = np.cumsum(sizes)
        place = np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)
        self.words, self.ids = self.words.take(pa.array(numbers)), self.ids[place]
        self.ends = np.concatenate([[0], after])

    def _remember(self, new: pa.Array, ids: np.ndarray, sizes: np.ndarray, again: np.ndarray) -> None:
        """Keep the words of usual length. A worker that has no more room for the new ones goes on
        with the words that have just come ``again``, which are the frequent ones, and with as
        many of the new as fit."""
        if not len(new):
            return
        letters = pc.binary_length(new).to_numpy(zero_copy_only=False)
        cost = letters + WORD_BYTES + 4 * sizes
        fits = letters <= LONGEST
        if self.held() + int(cost[fits].sum()) > self.remembered:
            self._only(again)
            if self.held() > self.remembered // 2:
                self.forget()
            fits &= np.cumsum(np.where(fits, cost, 0)) <= self.remembered - self.held()
        self.words = pa.concat_arrays([self.words, new.filter(pa.array(fits))])
        self.ids = np.concatenate([self.ids, ids[np.repeat(fits, sizes)]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes[fits])])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        pool, starts, stops = self._places(words.dictionary)
        index = words.indices.to_numpy()
        sizes = (stops - starts)[index]
        after = np.cumsum(sizes)
        if not len(after) or not after[-1]:
            return [np.zeros(0, dtype="<u4") for _ in range(len(texts))]
        # each word's ids, one after the other: counting on from where they are in the pool
        ids = pool[np.repeat(starts[index] - (after - sizes), sizes) + np.arange(after[-1])]
        ends = np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))
        return np.split(ids, np.concatenate([[0], after])[ends[:-1]])


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of bounded rows and bytes of text (column 1), of one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + SLICE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


@lru_cache(maxsize=2)
def word_ids(path: str, remembered: int | None = None) -> WordIds:
    """One tokenizer per Python worker, with the words it has seen."""
    return WordIds(path, remembered)


class _Windows:
    """The open windows of one task. A piece is ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, window: int, n_open: int, emit: Callable[[list], None]):
        self.window, self.n_open, self.emit = window, n_open, emit
        self.open: list[list] = []
        self.room: list[int] = []

    def _put(self, at: int, piece: tuple) -> None:
        self.open[at].append(piece)
        self.room[at] -= len(piece[2])
        if not self.room[at]:
            self.emit(self.open.pop(at))
            self.room.pop(at)

    def add(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        while len(ids) >= self.window:
            self.emit([(doc, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        fitting = [(room, i) for i, room in enumerate(self.room) if room >= len(ids)]
        if fitting:
            self._put(min(fitting)[1], (doc, start, ids, total))
        elif len(self.open) < self.n_open:
            self.open.append([])
            self.room.append(self.window)
            self._put(len(self.open) - 1, (doc, start, ids, total))
        else:
            room, at = min((room, i) for i, room in enumerate(self.room))
            self._put(at, (doc, start, ids[:room], total))
            self.add((doc, start + room, ids[room:], total))

    def close(self) -> list:
        """Merge the open windows; the pieces of the one that is not full."""
        rest, room = [], self.window
        for pieces in self.open:
            for doc, start, ids, total in pieces:
                while len(ids) >= room:
                    self.emit([*rest, (doc, start, ids[:room], total)])
                    start, ids, rest, room = start + room, ids[room:], [], self.window
                if len(ids):
                    rest.append((doc, start, ids, total))
                    room -= len(ids)
        self.open, self.room = [], []
        return rest


class _Out:
    """Collects pieces as rows; ``value`` turns the ids of a piece into its last column."""

    def __init__(self, value: Callable, kind: pa.DataType, series: int, part: int):
        self.value, self.kind, self.part = value, kind, part
        self.sequence = (series << 56) | (part << 24)
        self.rows: list[list] = [[] for _ in range(9)]

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            row = (doc, start, len(ids), total, self.sequence, offset, self.value(ids), None, None)
            for column, x in zip(self.rows, row):
                column.append(x)
            offset += len(ids)
        self.sequence += 1

    def leave(self, pieces: list) -> None:
        """Pieces that go to the next merge, with their ids and their order."""
        for order, (doc, start, ids, total) in enumerate(pieces):
            place = (self.part << 24) | order
            row = (doc, start, len(ids), total, None, None, None, ids.astype("<u4").tobytes(), place)
            for column, x in zip(self.rows, row):
                column.append(x)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [self.kind, pa.binary(), pa.int64()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "value", "ids", "place"]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.rows, kinds)], names=names)
        self.rows = [[] for _ in range(9)]
        return out


def _schema(value_type: str) -> str:
    return (
        "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
        f"offset bigint, value {value_type}, ids binary, place bigint"
    )


def token_list(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int32)


def _merge(level: int, last: bool, window: int, value: Callable, kind: pa.DataType) -> Callable:
    """Merges the windows that the tasks of a group left; the last merge pads what remains."""

    def merge(table):
        table = table.sort_by("place")
        group = table["place"][0].as_py() // (FAN_IN << 24)
        out = _Out(value, kind, level, group)
        windows = _Windows(window, 1, out.emit)
        pieces = zip(*(table[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")))
        windows.open = [[(d, s, np.frombuffer(i, "<u4"), t) for d, s, i, t in pieces]]
        rest = windows.close()
        if last and rest:
            out.emit(rest)
        else:
            out.leave(rest)
        return pa.Table.from_batches([out.batch()])

    return merge


def pack(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    n_open: int = OPEN,
    value: Callable = token_list,
    value_type: str = "array<int>",
    value_arrow: pa.DataType = pa.list_(pa.int32()),
    remembered: int | None = None,
) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, doc_tokens, sequence_id,
    offset, value``.

    A document is its ids by the tokenizer file at ``path`` and an end id, so a null or empty
    text is one token. ``start`` counts the ids of the document before the piece, ``offset``
    those of the sequence, ``doc_tokens`` all of the document's. ``value`` is what the given
    function makes of the ids of the piece: the ids themselves by default. ``remembered``
    bounds the bytes of words and ids that a worker keeps (:data:`REMEMBERED`).

    Every row is packed, also when ids of documents repeat or are null (the pieces of such
    documents can then only be told apart by sequence and offset). Documents longer than a
    window are cut. All sequences but the last are full. An empty table gives no sequences.
    Other columns are not touched.
    """
    end = np.array([END], dtype="<u4")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_ids(path, remembered)
        out = _Out(value, value_arrow, 0, TaskContext.get().partitionId())
        windows = _Windows(window, n_open, out.emit)
        for batch in _text_slices(batches):
            docs = batch.column(0).to_pylist()
            for doc, ids in zip(docs, tokenizer.encode(batch.column(1))):
                windows.add((doc, 0, np.concatenate([ids, end]), len(ids) + 1))
            yield out.batch()
        give_back()
        out.leave(windows.close())
        yield out.batch()

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_text(text_col).alias("text"))
    packed = keep(rows.mapInArrow(first, _schema(value_type)), "packed")
    done, level = [packed], 0
    while True:
        # one row for each window that is not full: the tasks of the step before
        left = done[-1].filter("place IS NOT NULL")
        tasks = left.agg(F.max(F.shiftright("place", 24)).alias("m")).first().m
        if tasks is None:
            break
        level += 1
        last = tasks < FAN_IN

        merge = _merge(level, last, window, value, value_arrow)
        group = F.floor(F.col("place") / (FAN_IN << 24)).alias("g")
        merged = left.groupBy(group).applyInArrow(merge, _schema(value_type))
        done.append(keep(merged, "packed"))
        if last:
            break
    pieces = done[0]
    for more in done[1:]:
        pieces = pieces.unionByName(more)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "value"]
    return pieces.filter("sequence_id IS NOT NULL").select(*names)
