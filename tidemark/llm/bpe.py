"""Byte-pair encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix of a word is the encoding of a shorter prefix and one last token.
That token is unique: among the tokens that end at the prefix (the matches of an automaton
over the vocabulary), it is the one that fits the last token before it, and two tokens fit
if the merges by which they arise leave the border between them alone. So one token per
prefix is stored, and following the lengths back from the end gives the ids.

Words are encoded many at a time: all words take a step of the automaton together, and the
tests of a step are numpy operations.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import clean_text, slices

#: Fixed value: how byte-level vocabularies cut a text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1) << 40
#: Cells of a matrix of words that is worked on at a time.
CELLS = 1 << 21
#: Bytes of chunks, ids and decoded texts that a Python worker remembers. Beyond them it begins
#: anew, which costs time and nothing else.
REMEMBERED = 96 << 20
#: What a chunk takes besides its letters, ids and bytes: its objects and its place in the table.
CHUNK_BYTES = 280
#: Longer chunks are not remembered.
LONGEST = 256
MEMO_BITS = 20
#: Words above this size are encoded one by one: so few take a step together that numpy does
#: not pay.
LONG_WORD = 512
#: Pairs of tokens whose test is remembered for long words.
LONG_MEMO = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, others in order
    from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level vocabulary file: tokens, merges, and the automaton over the tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = spec["model"]["vocab"]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        of = {}
        for text, number in ids.items():
            if text not in self.special:
                self.tokens[number] = bytes(letters[c] for c in text)
                of[text] = number
        for text, number in self.special.items():
            self.tokens[number] = text.encode()
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        pairs = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole = of[a + b]
            if self.rank[whole] >= 0:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.rank[whole], self.left[whole], self.right[whole] = rank, of[a], of[b]
            pairs.append((of[a] * size + of[b], rank))
        pairs.sort()
        self.size = size
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [-1], dtype=np.int64)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self._memo_keys = np.full(1 << MEMO_BITS, -1, dtype=np.int64)
        self._memo = np.zeros(1 << MEMO_BITS, dtype=bool)
        self._ranks: dict[int, int] | None = None
        self._pairs: dict[tuple[int, int], bool] = {}
        known = np.array(sorted(of.values()), dtype=np.int64)
        self.whole = self._whole(known)
        self._automaton(known)

    def _whole(self, known: np.ndarray) -> np.ndarray:
        """Tokens that are their own encoding."""
        rank = np.where(self.rank[known] < 0, NEVER, self.rank[known])
        fits = self._test(self.left[known], self.right[known], rank)
        out = np.zeros(self.size, dtype=bool)
        for i in np.argsort(self.rank[known], kind="stable").tolist():
            t = known[i]
            out[t] = self.rank[t] < 0 or (fits[i] and out[self.left[t]] and out[self.right[t]])
        return out

    def _automaton(self, known: np.ndarray) -> None:
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for t in known.tolist():
            state = 0
            for byte in self.tokens[t]:
                nxt = children[state].get(byte)
                if nxt is None:
                    nxt = len(children)
                    children[state][byte] = nxt
                    children.append({})
                    token.append(-1)
                state = nxt
            token[state] = t
        n = len(children)
        self.step = np.zeros((n, 256), dtype=np.int32)
        shorter = np.zeros(n, dtype=np.int64)
        first = np.full(n, -1, dtype=np.int64)
        after = np.full(n, -1, dtype=np.int64)
        wave = [0]
        while wave:
            following = []
            for state in wave:
                back = shorter[state]
                if state:
                    self.step[state] = self.step[back]
                    after[state] = first[back]
                    first[state] = state if token[state] >= 0 else first[back]
                for byte, child in children[state].items():
                    shorter[child] = self.step[back, byte] if state else 0
                    self.step[state, byte] = child
                    following.append(child)
            wave = following
        self.token = np.array(token, dtype=np.int64)
        self.first, self.after = first, after

    def _test(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge ever crosses the border between tokens a and b (up to a rank).

        Undoes the merges of both from the latest on. Two parts at the border are neighbours
        until the first of them goes into a larger part; a merge of the two with an earlier
        rank would have joined them instead. Of equal ranks, the merge further left is first.
        """
        a, b = a.copy(), b.copy()
        end_a = np.full(len(a), NEVER) if until is None else until.copy()
        end_b = end_a.copy()
        out = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        while len(at):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[place] == key, self.pair_ranks[place], NEVER)
            joined = (rank < end_a) & (rank <= end_b) & (rank < NEVER)
            out[at[joined]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~joined & ((rank_a >= 0) | (rank_b >= 0))
            undo_a = (rank_a > rank_b)[go]
            at, a, b, end_a, end_b = at[go], a[go], b[go], end_a[go], end_b[go]
            end_a, end_b = np.where(undo_a, rank_a[go], end_a), np.where(undo_a, end_b, rank_b[go])
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_test` for whole tokens, with a memory of fixed size."""
        key = a * self.size + b
        place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        new = self._memo_keys[place] != key
        out = self._memo[place]
        if new.any():
            found = self._test(a[new], b[new])
            out[new] = found
            self._memo_keys[place[new]] = key[new]
            # of two pairs at one place the last one stays, for the key and the answer alike
            self._memo[place[new]] = found
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (a piece that merges do not leave)."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: -len(words[i]))
        start = 0
        while start < len(order) and len(words[order[start]]) > LONG_WORD:
            out[order[start]] = self._encode_long(words[order[start]])
            start += 1
        while start < len(order):
            width = len(words[order[start]])
            own = order[start : start + max(1, CELLS // width)]
            self._encode([words[i] for i in own], own, out)
            start += len(own)
        return out

    def _encode(self, words: list[bytes], own: list[int], out: list[list[int]]) -> None:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        width = int(sizes[0])
        letters = np.zeros((len(words), width), dtype=np.uint8)
        letters[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        last = np.full((len(words), width + 1), -1, dtype=np.int32)
        state = np.zeros(len(words), dtype=np.int64)
        active = np.searchsorted(-sizes, -np.arange(width), side="left").tolist()
        for i in range(width):
            n = active[i]
            state = self.step[state[:n], letters[:n, i]].astype(np.int64)
            todo, match = np.arange(n), self.first[state]
            while len(todo):
                if (match < 0).any():
                    raise ValueError("the vocabulary cannot encode a byte of the text")
                t = self.token[match]
                begin = i + 1 - self.lengths[t]
                ok = np.where(begin == 0, self.whole[t], False)
                inner = np.flatnonzero(begin > 0)
                if len(inner):
                    before = last[todo[inner], begin[inner]].astype(np.int64)
                    ok[inner] = self.fits(before, t[inner])
                last[todo[ok], i + 1] = t[ok]
                todo, match = todo[~ok], self.after[match[~ok]]
        rows, end = np.arange(len(words)), sizes.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            t = last[rows, end]
            found.append((rows, t))
            end = end - self.lengths[t]
            more = end > 0
            rows, end = rows[more], end[more]
        for rows, ids in reversed(found):
            for r, t in zip(rows.tolist(), ids.tolist()):
                out[own[r]].append(t)

    def _test_one(self, a: int, b: int) -> bool:
        """:meth:`_test` for one pair of whole tokens."""
        end_a = end_b = never = int(NEVER)
        while True:
            rank = self._ranks.get(a * self.size + b, never)
            if rank < end_a and rank <= end_b and rank < never:
                return False
            rank_a, rank_b = self.rank.item(a), self.rank.item(b)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                a, end_a = self.right.item(a), rank_a
            else:
                b, end_b = self.left.item(b), rank_b

    def _encode_long(self, word: bytes) -> list[int]:
        """:meth:`_encode` for one word, step by step."""
        if self._ranks is None:
            self._ranks = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        last, state, known = [-1] * (len(word) + 1), 0, self._pairs
        step, first, after = self.step.item, self.first.item, self.after.item
        for i, byte in enumerate(word):
            state = step(state, byte)
            match = first(state)
            while True:
                if match < 0:
                    raise ValueError("the vocabulary cannot encode a byte of the text")
                t = self.token.item(match)
                begin = i + 1 - self.lengths.item(t)
                if begin == 0:
                    ok = self.whole.item(t)
                else:
                    key = (last[begin], t)
                    ok = known.get(key)
                    if ok is None:
                        if len(known) >= LONG_MEMO:
                            known.clear()
                        ok = known[key] = self._test_one(*key)
                if ok:
                    last[i + 1] = t
                    break
                match = after(match)
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= self.lengths.item(last[end])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker; every worker reads the file itself."""
    return Vocabulary(path)


class Encoder:
    """Texts to ids, with the ids of chunks that were seen before.

    A chunk is what lies between two single spaces, with the space before it: texts are
    always cut there, so chunks can be encoded each on its own. Texts with longer runs of
    spaces are cut by the pattern itself. Chunks of usual length are remembered within
    ``REMEMBERED`` bytes.
    """

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.cut = regex.compile(CUT)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.seen: dict[str, tuple[str, bytes]] = {}
        self.used = 0

    def parts(self, text: str) -> list[str]:
        """The text cut at the strings of special tokens, which are kept as parts."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return [text]
        return self.special.split(text)

    def chunks(self, part: str) -> list[str]:
        if "  " in part:
            return self.cut.findall(part)
        first, *rest = part.split(" ")
        out = [" " + p for p in rest]
        return [first, *out] if first else out

    def encode(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """Per text, the ids (decimal, comma-joined) and decoded bytes of its chunks."""
        special = {s: (str(i), self.vocabulary.decode([i])) for s, i in self.vocabulary.special.items()}
        cut = [[self.chunks(p) if p not in special else p for p in self.parts(t)] for t in texts]
        missing = set()
        for parts in cut:
            for chunks in parts:
                if not isinstance(chunks, str):
                    missing.update(chunks)
        missing -= self.seen.keys()
        new = self._work_out(list(missing))
        usual = {c: x for c, x in new.items() if len(c) <= LONGEST}
        cost = sum(4 * len(c) + len(x[0]) + len(x[1]) + CHUNK_BYTES for c, x in usual.items())
        if len(usual) == len(new) and self.used + cost <= REMEMBERED:
            self.seen.update(new)
            self.used += cost
            known = self.seen
        else:
            # what this slice needs, apart from what is remembered
            known = {**new}
            for parts in cut:
                for chunks in parts:
                    if not isinstance(chunks, str):
                        known.update((c, self.seen[c]) for c in set(chunks) if c not in new)
            if self.used + cost > REMEMBERED:
                self.seen, self.used = {}, 0
            if self.used + cost <= REMEMBERED:
                self.seen.update(usual)
                self.used += cost
        return [
            [x for chunks in parts for x in ([special[chunks]] if isinstance(chunks, str) else map(known.__getitem__, chunks))]
            for parts in cut
        ]

    def _work_out(self, chunks: list[str]) -> dict[str, tuple[str, bytes]]:
        words = [self.cut.findall(c) for c in chunks]
        distinct = list({w for found in words for w in found})
        ids = dict(zip(distinct, self.vocabulary.encode_words([w.encode() for w in distinct])))
        out = {}
        for chunk, found in zip(chunks, words):
            own = [t for w in found for t in ids[w]]
            out[chunk] = (",".join(map(str, own)), self.vocabulary.decode(own))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array<int>) for every row: the ids of the whole text, special tokens
    in it included.

    Narrow. Null and empty texts give an empty array; ids of rows may be null or repeat;
    other columns are not touched. ``path`` is read by every worker.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches):
            found = [
                [int(i) for s, _ in chunks for i in s.split(",")]
                for chunks in own.encode(batch.column(1).to_pylist())
            ]
            ids = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_text(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` for every row of ids; bytes that are no UTF-8 become U+FFFD.

    Null ids give a null text; an id outside the vocabulary is an error. Narrow.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in slices(batches):
            texts = [
                None if ids is None else own.decode(ids).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            column = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "text"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(work, "doc_id bigint, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass.

    The ids never leave the task: their digest is that of the decimal ids joined by commas,
    and the decoded text is what the ids of the text give back. Null and empty texts have no
    ids; rows are treated one by one, also where ids repeat or are null; there are no ties, as
    an encoding is unique; texts of any length are read whole; an empty table gives no rows;
    other columns are not touched.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches):
            counts, ids, decoded = [], [], []
            for chunks in own.encode(batch.column(1).to_pylist()):
                joined = ",".join([c[0] for c in chunks])
                text = b"".join([c[1] for c in chunks]).decode("utf-8", "replace")
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_text(text_col).alias("text"))
    return rows.mapInArrow(
        work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
