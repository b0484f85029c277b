"""Token counts of whole texts, huge ones in overlapping chunks that many tasks encode.

A text of more than a chunk is cut into chunks that reach into the next one. Each is encoded
alone, with the place of every token in the text. Two neighbours are spliced at a token that
both have, at the same place with the same id, in the letters they share.

Such a border is proven: merging takes the best pair, the leftmost of equal ones, whatever
stands around it. So a merge across a border of the result would have happened with the two
tokens alone, and a sequence is the encoding of its text if and only if each two neighbours
are the encoding of theirs. Up to the common token all neighbours are neighbours of the
first chunk's encoding, from it on of the second's. The mark that the model puts before a
text stands before the first letter of each later chunk and has no letter of its own, so
what it changes is no common token, or is proven in the same way.

Neighbours without a common token (long runs of one letter, shifted against each other) are
cut again with a wider overlap, up to the whole text in one chunk. Chunks are rows of a table
in the shared folder, in small row groups, so one document of any length is encoded by as many
tasks as it has groups of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import ROW, clean_text, keep, remove, slices, with_rows

#: Letters of a chunk, and letters that it shares with the next one at first.
CHUNK = 1 << 14
OVERLAP = 1 << 10
#: How much wider the overlap gets where neighbours have no token in common.
WIDER = 4
#: Bytes of chunks that one task reads at least.
GROUP_BYTES = 4 << 20
IDENTITY = "identity"
USER_DEFINED = 4

PARTS = "doc_id bigint, _row {row}, n_bytes bigint, n_tokens bigint, part bigint, start bigint, text string"
CODED = "doc_id bigint, _row {row}, n_bytes bigint, part bigint, n bigint, head array<bigint>, tail array<bigint>"


@lru_cache(maxsize=2)
def model(path: str):
    """One model per Python worker; every worker reads the file itself."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def may_be_cut(path: str) -> bool:
    """Whether the proof holds for a model: texts are merged as they are, letter by letter."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model(path).serialized_model_proto())
    rules = spec.normalizer_spec
    return (
        spec.trainer_spec.model_type == spec.trainer_spec.BPE
        and rules.name == IDENTITY
        and not rules.precompiled_charsmap
        and not rules.remove_extra_whitespaces
        and not any(p.type == USER_DEFINED for p in spec.pieces)
    )


def tokens(path: str, text: str, start: int = 0) -> np.ndarray:
    """Rows ``begin, end, id, number`` of the tokens; ``start`` is where the text begins. Of a
    letter that is spelled in bytes, the last byte has the letter's place, the others none."""
    found = model(path).encode(text, return_type="offset_mapping")
    out = np.empty((len(found["ids"]), 4), dtype=np.int64)
    out[:, :2] = np.array(found["offsets"], dtype=np.int64).reshape(-1, 2) + start
    out[:, 2] = found["ids"]
    out[:, 3] = np.arange(len(out))
    return out


def _cut(path: str, chunk: int, overlap: int) -> Callable:
    """Counts short texts, and cuts long ones into rows of a chunk each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "_row", "n_bytes", "n_tokens", "part", "start", "text"]
        kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple], row_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            arrays = [pa.array(list(c), k or row_type) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in slices(batches):
            row_type = batch.schema.field(0).type
            rows, docs, sizes = (batch.column(i).to_pylist() for i in (0, 1, 3))
            texts = batch.column(2).to_pylist()
            short = [i for i, t in enumerate(texts) if len(t) <= chunk + overlap]
            counts = map(len, model(path).encode([texts[i] for i in short], num_threads=1))
            yield batch_of([(docs[i], rows[i], sizes[i], n, None, None, None) for i, n in zip(short, counts)], row_type)
            held: list[tuple] = []
            for i, text in enumerate(texts):
                if len(text) <= chunk + overlap:
                    continue
                # the last chunk takes a rest that is no longer than the overlap
                for part in range(-(-(len(text) - overlap) // chunk)):
                    start = part * chunk
                    held.append((docs[i], rows[i], sizes[i], None, part, start, text[start : start + chunk + overlap]))
                    if len(held) * chunk >= GROUP_BYTES:
                        yield batch_of(held, row_type)
                        held = []
            if held:
                yield batch_of(held, row_type)

    return work


def _flat(tables: list[np.ndarray]) -> pa.Array:
    """Rows of tokens as lists of numbers, one after the other."""
    sizes = np.cumsum([0, *(t.size for t in tables)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(tables).ravel()))


def _encode(path: str, chunk: int, overlap: int) -> Callable:
    """The number of tokens of each chunk, and its tokens in what it shares with the one
    before (``head``) and the one after (``tail``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            numbers, heads, tails = [], [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist()):
                found = tokens(path, text, start)
                numbers.append(len(found))
                whole = found[found[:, 0] < found[:, 1]]
                heads.append(whole[whole[:, 1] <= start + overlap])
                tails.append(whole[whole[:, 0] >= start + chunk])
            kept = [batch.column(c) for c in ("doc_id", "_row", "n_bytes", "part")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(numbers, pa.int64()), _flat(heads), _flat(tails)],
                names=["doc_id", "_row", "n_bytes", "part", "n", "head", "tail"],
            )

    return work


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of neighbours the tokens that do not count: those of the first chunk after the
    last common token, and those of the second up to it. Null where there is none."""

    def tables(column: pa.Array) -> list[np.ndarray]:
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        return [t.reshape(-1, 4) for t in np.split(column.flatten().to_numpy(), ends)]

    for batch in slices(batches):
        found = []
        before = batch.column("n_before").to_pylist()
        for n, tail, head in zip(before, tables(batch.column("tail")), tables(batch.column("head"))):
            # tokens of a text begin at different places
            _, i, j = np.intersect1d(tail[:, 0], head[:, 0], assume_unique=True, return_indices=True)
            same = np.flatnonzero((tail[i, 1:3] == head[j, 1:3]).all(axis=1))
            found.append(int(n - tail[i[same[-1]], 3] + head[j[same[-1]], 3]) if len(same) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(found, pa.int64())], names=["_row", "twice"]
        )


def _splice(coded: DataFrame) -> DataFrame:
    """``doc_id, _row, n_bytes, n_tokens``: null tokens where two neighbours have none in
    common. Neighbours meet by row and number, so the chunks of one document spread."""
    before = coded.select("_row", (F.col("part") + 1).alias("part"), "tail", F.col("n").alias("n_before"))
    pairs = coded.select("_row", "part", "head").join(before, ["_row", "part"])
    lost = pairs.select("_row", "n_before", "tail", "head").mapInArrow(_twice, f"_row {ROW}, twice bigint")
    sums = coded.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("n").alias("n")
    )
    shared = lost.groupBy("_row").agg(
        F.sum("twice").alias("twice"), F.count_if(F.col("twice").isNull()).alias("failed")
    )
    total = F.when(F.coalesce("failed", F.lit(0)) == 0, F.col("n") - F.coalesce("twice", F.lit(0)))
    return sums.join(shared, "_row", "left").select("doc_id", "_row", "n_bytes", total.alias("n_tokens"))


def count_tokens(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row: the bytes of the text in UTF-8,
    its tokens by the sentencepiece model at ``path`` without begin and end tokens, and
    whether they are more than ``limit``.

    A null or empty text has no bytes and no tokens. Rows are counted one by one, also where
    ids are null or repeat; there are no ties. Texts of any length are counted whole:
    above ``chunk + overlap`` letters in chunks, by the module's method; texts of models that
    change what they read (other normalisers, tokens of the user) in one piece. An empty table
    gives an empty result. Other columns are not touched, whatever their names.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and no longer than a chunk")
    if not may_be_cut(path):
        chunk = overlap = 1 << 31
    text = clean_text(text_col)
    rows = with_rows(df.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")))
    rows = rows.select("_row", "doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"))
    done, todo = [], rows
    while True:
        cut = todo.mapInArrow(_cut(path, chunk, overlap), PARTS.format(row=ROW))
        parts = keep(cut, "token_chunks", **{"parquet.block.size": str(GROUP_BYTES)})
        done.append(parts.filter("part IS NULL").select("doc_id", "n_bytes", "n_tokens"))
        long = parts.filter("part IS NOT NULL")
        if long.isEmpty():
            break
        coded = keep(long.mapInArrow(_encode(path, chunk, overlap), CODED.format(row=ROW)), "token_parts")
        spliced = keep(_splice(coded), "token_sums")
        remove(coded)
        done.append(spliced.filter("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens"))
        failed = spliced.filter("n_tokens IS NULL").select("_row")
        if failed.isEmpty():
            break
        todo = rows.join(failed, "_row", "left_semi").select(*rows.columns)
        overlap *= WIDER
        chunk = max(chunk, overlap)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
