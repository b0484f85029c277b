"""Personal data: exact patterns, and a linear-chain conditional random field beside them.

The field labels tokens (runs of digits, runs of letters, single signs) from their shapes:
kind, length, range of numbers, which sign, space before or not. It is trained on the driver
from a small labelled table and finds what the patterns miss: numbers without a plus sign,
written-out or bracketed addresses, unusual separators. Only the surroundings of digits and
of signs of addresses are decoded; everything else is plain words and outside by definition.
Viterbi runs in numpy over all such stretches of a batch together.

A stretch that the field labels counts only if it passes the check of its kind (number of
digits, check digit, range) and touches no span of the patterns; those always stay.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import ROW, clean_text, slices, with_rows
from tidemark.llm.patterns import PERSONAL, Span, luhn, personal

LABELS = ["O", *(f"{p}-{k}" for k in PERSONAL for p in "BI")]
N = len(LABELS)
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"
#: Words around a trigger that belong to its stretch, and the most code points.
AROUND = 6
MARGIN = 120
#: Tokens before and after a token that its scores see.
REACH = 3

_TRIGGER = re.compile(r"[0-9@]|[\[(] ?(?:at|dot|AT|DOT) ?[\])]| (?:dot|DOT) ")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_SPACE = re.compile(r"\s+")
_RUN = re.compile(r"\S*")
_SIGNS = "+@.-()[]_%:/=,;\"'#|"
_WORDS = ("at", "dot", "com", "org", "net", "phone", "call", "tel", "mail", "card", "ip")


def _shapes() -> dict[str, int]:
    names = ["pad"]
    names += [f"digits-{n}" for n in ("1", "2", "3", "4", "5-9", "10-13", "14-19", "20+")]
    names += [f"byte-{n}" for n in "123"] + ["lower", "upper", "mixed", "sign"]
    names += [f"sign-{s}" for s in _SIGNS] + [f"word-{w}" for w in _WORDS]
    return {name: i for i, name in enumerate(names)}


SHAPES = _shapes()
SYMBOLS = 2 * len(SHAPES)


def shape(token: str) -> int:
    first = token[0]
    if "0" <= first <= "9":
        n = len(token)
        if n <= 3:
            return SHAPES[f"byte-{n}" if int(token) <= 255 else f"digits-{n}"]
        if n == 4:
            return SHAPES["digits-4"]
        size = "5-9" if n <= 9 else "10-13" if n <= 13 else "14-19" if n <= 19 else "20+"
        return SHAPES[f"digits-{size}"]
    if first.isalpha():
        word = SHAPES.get(f"word-{token.lower()}")
        if word is not None:
            return word
        return SHAPES["lower" if token.islower() else "upper" if token.isupper() else "mixed"]
    return SHAPES.get(f"sign-{first}", SHAPES["sign"])


def tokens(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The symbols (shape, space before) and places of the tokens of a stretch."""
    symbols, places, last = [], [], start
    for match in _TOKEN.finditer(text, start, end):
        symbols.append(2 * shape(match.group()) + (match.start() > last or match.start() == start))
        places.append(match.span())
        last = match.end()
    return symbols, places


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a text has triggers: the run of signs around each, and up to ``AROUND`` words
    but no more than ``MARGIN`` code points on both sides. Linear in the text."""
    out: list[tuple[int, int]] = []
    at = 0
    while match := _TRIGGER.search(text, at):
        first = max(at, text.rfind(" ", at, match.start()) + 1, text.rfind("\n", at, match.start()) + 1)
        at = _RUN.match(text, match.end()).end()
        start = low = max(0, first - MARGIN)
        cut = first
        for _ in range(AROUND + 1):
            cut = text.rfind(" ", low, cut)
            if cut < 0:
                break
            start = cut
        else:
            start += 1
        if cut < 0:
            start = low
        end = at
        for _ in range(AROUND):
            space = _SPACE.search(text, end, min(len(text), at + MARGIN))
            if space is None:
                end = min(len(text), at + MARGIN)
                break
            end = space.end()
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


@dataclass
class Field:
    """Weights of the field: a symbol at each distance, neighbouring pairs, label pairs."""

    near: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """Scores of the labels for padded symbols (rows x time, 0 is padding)."""
        rows, time = symbols.shape
        wide = np.zeros((rows, time + 2 * REACH), dtype=np.int64)
        wide[:, REACH : REACH + time] = symbols
        out = sum(self.near[d][wide[:, d : d + time]] for d in range(2 * REACH + 1))
        middle = wide[:, REACH : REACH + time]
        out = out + self.before[wide[:, REACH - 1 : REACH - 1 + time] * SYMBOLS + middle]
        return out + self.after[middle * SYMBOLS + wide[:, REACH + 1 : REACH + 1 + time]]

    def viterbi(self, sequences: list[list[int]]) -> list[np.ndarray]:
        """The best labels of each sequence; all sequences of a batch step together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: -len(sequences[i]))
        at = 0
        while at < len(order):
            width = len(sequences[order[at]])
            own = order[at : at + max(1, 20_000 // width)]
            at += len(own)
            sizes = np.array([len(sequences[i]) for i in own])
            symbols = np.zeros((len(own), width), dtype=np.int64)
            for row, i in enumerate(own):
                symbols[row, : sizes[row]] = sequences[i]
            score = self.scores(symbols)
            best = score[:, 0] + self.step[0]
            back = np.zeros((len(own), width, N), dtype=np.int8)
            for t in range(1, width):
                n = int(np.searchsorted(-sizes, -t, side="left"))
                ways = best[:n, :, None] + self.step[1:][None]
                back[:n, t] = ways.argmax(axis=1)
                best[:n] = ways.max(axis=1) + score[:n, t]
            for row, i in enumerate(own):
                labels = np.empty(sizes[row], dtype=np.int64)
                labels[-1] = best[row].argmax()
                for t in range(sizes[row] - 1, 0, -1):
                    labels[t - 1] = back[row, t, labels[t]]
                out[i] = labels
        return out


def _allowed() -> np.ndarray:
    """0 where a label may follow another (row 0: at the start), a large loss elsewhere."""
    out = np.zeros((N + 1, N))
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            kind = label[2:]
            out[0, j] = -1e4
            for i, before in enumerate(LABELS):
                if before[2:] != kind:
                    out[i + 1, j] = -1e4
    return out


def train(rows: list[tuple[str, list[Span]]], rounds: int = 80, decay: float = 1e-3) -> Field:
    """Fit the field to labelled texts by full-batch gradient steps on the log-likelihood."""
    sequences, labels = [], []
    for text, spans in rows:
        symbols, places = tokens(text, 0, len(text))
        own = []
        for start, end in places:
            hit = next((s for s in spans if s[1] <= start and end <= s[2]), None)
            own.append(0 if hit is None else LABELS.index(("B-" if hit[1] == start else "I-") + hit[0]))
        if symbols:
            sequences.append(symbols)
            labels.append(own)
    width = max(map(len, sequences))
    sizes = np.array([len(s) for s in sequences])
    x = np.zeros((len(sequences), width), dtype=np.int64)
    y = np.zeros_like(x)
    for row, (s, l) in enumerate(zip(sequences, labels)):
        x[row, : len(s)], y[row, : len(l)] = s, l
    inside = np.arange(width) < sizes[:, None]
    weights = [
        np.zeros((2 * REACH + 1, SYMBOLS, N)),
        np.zeros((SYMBOLS * SYMBOLS, N)),
        np.zeros((SYMBOLS * SYMBOLS, N)),
        np.zeros((N + 1, N)),
    ]
    wide = np.zeros((len(x), width + 2 * REACH), dtype=np.int64)
    wide[:, REACH : REACH + width] = x
    pair_before = wide[:, REACH - 1 : REACH - 1 + width] * SYMBOLS + x
    pair_after = x * SYMBOLS + wide[:, REACH + 1 : REACH + 1 + width]
    truth = np.eye(N)[y] * inside[..., None]
    legal = _allowed()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]

    def log_sum(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

    for turn in range(1, rounds + 1):
        field = Field(*weights[:3], weights[3] + legal)
        score = field.scores(x)
        forward = np.zeros((len(x), width, N))
        forward[:, 0] = score[:, 0] + field.step[0]
        for t in range(1, width):
            moved = log_sum(forward[:, t - 1, :, None] + field.step[1:][None], 1) + score[:, t]
            forward[:, t] = np.where(inside[:, t, None], moved, forward[:, t - 1])
        total = log_sum(forward[:, -1], 1)
        backward = np.zeros((len(x), width, N))
        between = np.zeros((N + 1, N))
        for t in range(width - 1, 0, -1):
            onward = score[:, t] + backward[:, t]
            ways = field.step[1:][None] + onward[:, None, :]
            backward[:, t - 1] = np.where(inside[:, t, None], log_sum(ways, 2), 0)
            joint = np.exp(forward[:, t - 1, :, None] + ways - total[:, None, None])
            between[1:] += (joint * inside[:, t, None, None]).sum(axis=0)
        chance = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
        between[0] = chance[:, 0].sum(axis=0)
        seen = np.zeros((N + 1, N))
        np.add.at(seen[0], y[:, 0], 1)
        pairs = inside[:, 1:]
        np.add.at(seen, (y[:, :-1][pairs] + 1, y[:, 1:][pairs]), 1)
        error = truth - chance
        slopes = [np.zeros_like(w) for w in weights]
        for d in range(2 * REACH + 1):
            np.add.at(slopes[0][d], wide[:, d : d + width], error)
        np.add.at(slopes[1], pair_before, error)
        np.add.at(slopes[2], pair_after, error)
        slopes[3] = seen - between
        for w, slope, (first, second) in zip(weights, slopes, moments):
            slope = slope / len(x) - decay * w
            first *= 0.9
            first += 0.1 * slope
            second *= 0.99
            second += 0.01 * slope**2
            w += 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return Field(*weights[:3], weights[3] + legal)


def examples(n: int = 420, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """A small labelled table, made by rule: values of each kind in several spellings, and
    numbers that are none, between made-up words."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghinorstuv") for _ in range(rng.randint(2, 9)))

    def case(w):
        return rng.choice([w, w, w.capitalize(), w.upper()])

    def email():
        name = rng.choice([word(), f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}{digits(2)}"])
        host = [rng.choice([word(), f"mail{digits(1)}"]), rng.choice(["com", "org", "net"])]
        if rng.random() < 0.4:
            host.insert(1, word())
        at, dot = rng.choice([("@", ".")] * 3 + [(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("[at]", ".")])
        return name + at + dot.join(host)

    def ip():
        dot = rng.choice(["."] * 4 + ["[.]", " . "])
        return dot.join(str(rng.randint(0, 255)) for _ in range(4))

    def card():
        cut = rng.choice(["", "", "", "", " ", "-", ".", "  "])
        return cut.join(digits(4) for _ in range(4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        own = rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}"])
        return rng.choice(["", "+1 ", "+1-", "1-", "+49 "]) + own

    def other():
        return rng.choice(
            [
                f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{digits(2)}:{digits(2)}:{digits(2)}",
                f"{digits(2)}.{digits(2)}", f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}",
                digits(rng.randint(1, 9)), f"#{digits(6)}", f"{digits(3)},{digits(3)}", f"v{digits(1)}.{digits(1)}",
                f"password={word()}{digits(3)}{word()}", f"AKIA{digits(2)}{word().upper()}{digits(3)}",
                f'token = "{digits(4)}{word()}{digits(5)}"', f"{digits(2)}%", f"${digits(3)}.{digits(2)}",
                f"{word()}{digits(2)}", f"{digits(4)}-{digits(4)}", f"{digits(1)} {digits(2)} {digits(1)}",
                f"{word()} dot {word()}", f"{word()} at {word()}", f"({digits(3)})", f"{digits(2)}/{digits(2)}/{digits(4)}",
                f"{digits(10)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(22)}", f"@{word()}", f"{word()} @ {digits(2)}",
            ]
        )

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for i in range(n):
        kinds = [[*PERSONAL, None, None][i % 6]]
        if rng.random() < 0.25:
            kinds.append(rng.choice(["phone", "card", "ip", "email"]))
        before = " ".join(case(word()) for _ in range(rng.randint(0, 4)))
        after = " ".join(case(word()) for _ in range(rng.randint(0, 4)))
        text, spans = (before + rng.choice([" ", " ", " ", ": ", ", "]) if before else ""), []
        for place, kind in enumerate(kinds):
            value = makers[kind]() if kind else other()
            text += " " if place else ""
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
        out.append((text + rng.choice(["", "", ".", ",", ";"]) + (f" {after}" if after else ""), spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """:func:`examples` as a table: ``text, spans``. Any table of this form trains the field."""
    return spark.createDataFrame(examples(), "text string, spans array<struct<kind: string, start: int, end: int>>")


def train_on(table: DataFrame, limit: int = 5000) -> Field:
    """Train on a small labelled table; one of more than ``limit`` rows is refused."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the labelled table has more than {limit} rows")
    return train([(r.text, [tuple(s) for s in r.spans]) for r in rows if r.text])


def _valid(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and not value[-1].isalpha() and len(re.findall("[0-9]+", value)) >= 3
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    plain = re.sub(r" ?[\[(] ?at ?[\])] ?| at ", "@", value, flags=re.IGNORECASE)
    plain = re.sub(r" ?[\[(] ?(?:dot|\.) ?[\])] ?| dot ", ".", plain, flags=re.IGNORECASE)
    return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", plain) is not None


def find_all(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Per text the spans ``(kind, start, end, base)``, by start and kind."""
    base = [personal(t) for t in texts]
    owners, places, sequences = [], [], []
    for i, text in enumerate(texts):
        for start, end in stretches(text):
            symbols, own = tokens(text, start, end)
            owners.append(i)
            places.append(own)
            sequences.append(symbols)
    out = [[(*s, True) for s in spans] for spans in base]
    added: dict[int, list[Span]] = {}
    for i, own, labels in zip(owners, places, field.viterbi(sequences)):
        t = 0
        while t < len(own):
            if LABELS[labels[t]][0] != "B":
                t += 1
                continue
            kind, first = LABELS[labels[t]][2:], t
            t += 1
            while t < len(own) and LABELS[labels[t]] == f"I-{kind}":
                t += 1
            start, end = own[first][0], own[t - 1][1]
            if _valid(kind, texts[i][start:end]):
                added.setdefault(i, []).append((kind, start, end))
    for i, spans in added.items():
        taken = sorted((s, e) for _, s, e in base[i])
        starts = np.array([s for s, _ in taken])
        tops = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, dtype=int)
        for kind, start, end in spans:
            n = int(np.searchsorted(starts, end)) if taken else 0
            if not n or tops[n - 1] <= start:
                out[i].append((kind, start, end, False))
        out[i].sort(key=lambda s: (s[1], PERSONAL.index(s[0])))
    return out


def find(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, doc_id, spans`` for every row; ``base`` tells the patterns' spans from added ones.

    Narrow. Null and empty texts have no spans; ids may be null or repeat; whole texts are
    read, however long. Spans with the same start come in the order of their kinds. An empty
    table gives no rows. Other columns are not touched.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        )
        for batch in slices(batches):
            found = find_all(batch.column(2).to_pylist(), field)
            rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans] for spans in found]
            columns = [batch.column(0), batch.column(1), pa.array(rows, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "spans"])

    rows = with_rows(df.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_text(text_col).alias("text")))
    return rows.select("_row", "doc_id", "text").mapInArrow(work, f"_row {ROW}, doc_id bigint, spans {SPANS}")


def redact(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``df`` with ``<KIND>`` in place of every span of its texts; null texts stay null.

    Of overlapping spans the first, then the longest, is replaced, the rest as far as it
    stands out; of equal spans the kind that is listed first. Rows are treated one by one, also
    repeated ones; whole texts are read, however long; an empty table stays empty. All other
    columns are passed on as they are.
    """
    schema = df.schema
    at = [f.name for f in schema].index(text_col)

    def hide(text: str, spans) -> str:
        parts, done = [], 0
        for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if end <= done:
                continue
            parts += [text[done : max(done, start)], f"<{kind.upper()}>"]
            done = end
        return "".join([*parts, text[done:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            found = find_all([t or "" for t in texts], field)
            clean = [t if t is None else hide(t, s) for t, s in zip(texts, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return df.mapInArrow(work, schema)
