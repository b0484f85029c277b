"""Secrets: exact patterns, and how widely each candidate is held across the corpus.

A credential that many owners hold is an example that was copied; one that a single owner
holds looks live. So all candidates, those of the patterns and other token-like strings, are
reduced to digests of their values and counted by distinct owners and repositories over the
whole corpus. Token-like strings become spans only if they are specific to one owner; what
the patterns find always stays, with the verdict beside it.

Scale: texts are read once, in a narrow step; what moves are digests. Holders are made
distinct before they are counted, with a map-side step, so an example that a third of all
documents carry is one row per task and owner. The join back is by digest; a digest that
very many documents hold is a skewed key on one side only, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import ROW, clean_text, keep, slices, with_rows
from tidemark.llm.patterns import SECRET, secrets

SPAN = "struct<kind: string, start: int, end: int, base: boolean, digest: binary, strong: boolean>"
#: More owners or repositories than these make a candidate an example.
MANY_OWNERS = 3
MANY_REPOSITORIES = 6

_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in (value.count(c) for c in set(value)))


def strong(value: str) -> bool:
    """Random-looking: varied characters and not a placeholder."""
    lower = value.lower()
    if any(w in lower for w in ("example", "xxxx", "placeholder", "changeme", "your_", "12345678")):
        return False
    return entropy(value) >= 2.8


def _token_like(text: str) -> Iterator[tuple[str, int, int, str]]:
    for match in _TOKEN.finditer(text):
        value = match.group()
        if not any("0" <= c <= "9" for c in value):
            continue
        mixed = value.lower() != value and value.upper() != value
        if mixed and sum("0" <= c <= "9" for c in value) >= 3 and entropy(value) >= 3.5:
            yield "other", *match.span(), value


def candidates(text: str) -> list[dict]:
    """Candidates of a text by start and kind; token-like ones that touch no pattern's span."""
    base = secrets(text)
    out = [(*s, True) for s in base]
    last = 0
    ends = []
    for _, _, end, _ in base:
        last = max(last, end)
        ends.append(last)
    i = 0
    for found in _token_like(text):
        while i < len(base) and base[i][1] < found[2]:
            i += 1
        if not i or ends[i - 1] <= found[1]:
            out.append((*found, False))
    out.sort(key=lambda s: (s[1], SECRET.index(s[0])))
    return [
        {
            "kind": kind,
            "start": start,
            "end": end,
            "base": base,
            "digest": hashlib.sha256(value.encode()).digest()[:16],
            "strong": strong(value),
        }
        for kind, start, end, value, base in out
    ]


def scan(
    df: DataFrame,
    owner: Column,
    repository: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    many_owners: int = MANY_OWNERS,
    many_repositories: int = MANY_REPOSITORIES,
) -> DataFrame:
    """``_row, doc_id, spans`` for every row; a span is ``kind, start, end, base, verdict,
    owners, repositories``.

    ``verdict`` is ``example`` for values with more than ``many_owners`` owners or more than
    ``many_repositories`` repositories, ``live`` for random-looking values of one owner, and
    ``unsure`` for the rest. Spans of the patterns (``base``) are all reported, others
    (kind ``other``) only when live.

    Null and empty texts have no spans. Rows without an owner or repository count as one
    more holder together. Ids may be null or repeat; other columns are not touched; whole
    texts are read, and candidates of any length are hashed and judged whole. Spans with the
    same start come in the order of their kinds. An empty table gives no rows.
    """
    kind = pa.list_(
        pa.struct(
            [
                ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                ("base", pa.bool_()), ("digest", pa.binary()), ("strong", pa.bool_()),
            ]
        )
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([candidates(t) for t in batch.column(4).to_pylist()], kind)
            columns = [*(batch.column(i) for i in range(4)), found]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "owner", "repository", "found"])

    def holder(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(""))

    rows = with_rows(
        df.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            holder(owner).alias("owner"),
            holder(repository).alias("repository"),
            clean_text(text_col).alias("text"),
        )
    ).select("_row", "doc_id", "owner", "repository", "text")
    schema = f"_row {ROW}, doc_id bigint, owner string, repository string, found array<{SPAN}>"
    scanned = keep(rows.mapInArrow(work, schema), "candidates")
    single = scanned.select("_row", "owner", "repository", F.explode("found").alias("span"))
    held = single.select(F.col("span.digest").alias("digest"), "owner", "repository").distinct()
    counts = held.groupBy("digest").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
    )
    wide = (F.col("owners") > many_owners) | (F.col("repositories") > many_repositories)
    verdict = (
        F.when(wide, "example")
        .when((F.col("owners") == 1) & F.col("span.strong"), "live")
        .otherwise("unsure")
    )
    judged = (
        single.select("_row", "span", F.col("span.digest").alias("digest"))
        .join(counts, "digest")
        .withColumn("verdict", verdict)
        .filter("span.base OR verdict = 'live'")
    )
    order = F.array_position(F.array(*map(F.lit, SECRET)), F.col("span.kind")).cast("int")
    told = F.struct(
        F.col("span.start").alias("start"), order.alias("order"), F.col("span.kind").alias("kind"),
        F.col("span.end").alias("end"), F.col("span.base").alias("base"), "verdict", "owners", "repositories",
    )
    per_row = judged.groupBy("_row").agg(F.sort_array(F.collect_list(told)).alias("told"))
    names = ("kind", "start", "end", "base", "verdict", "owners", "repositories")
    spans = F.transform(
        F.coalesce("told", F.array().cast(per_row.schema["told"].dataType)),
        lambda s: F.struct(*(s[n].alias(n) for n in names)),
    )
    return scanned.select("_row", "doc_id").join(per_row, "_row", "left").select("_row", "doc_id", spans.alias("spans"))
