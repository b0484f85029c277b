"""The pipeline against the same steps by brute force, and the queries against SQL."""

from __future__ import annotations

import glob
import os

import corpus_pipeline
import duckdb
import pytest
from test_catalog import rows_of
from tidemark.llm import pii
from tidemark.llm.frames import keep
from tidemark.llm.queries import ORACLES, QUERIES

from .conftest import ODD, SF_DIR
from .test_exact_dups import digest
from .test_near_dups import expected as near_groups


def brute_force(rows):
    """Ids that stay, stage by stage, for documents with distinct ids."""
    rows = [(d, t) for d, t in rows if t and any(map(str.isalpha, t))]
    last = {}
    for doc, text in rows:
        last[digest(text)] = max(doc, last.get(digest(text), doc))
    rows = [(d, t) for d, t in rows if last[digest(t)] == d]
    return [d for d, _, group in near_groups(rows, 4) if d == group]


def test_stages(spark, real_docs):
    docs, rows = real_docs
    kept = brute_force([(d, t) for d, t, _ in rows])
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = keep(stage(spark, table, SF_DIR), name)
        assert table.columns == docs.columns and table.schema.simpleString() == docs.schema.simpleString()
    texts = {r.doc_id: r.text for r in table.collect()}
    assert sorted(texts) == sorted(kept) and table.count() == len(kept)
    field = pii.train(pii.examples())
    before = {d: t for d, t, _ in rows}
    for doc, spans in zip(kept, pii.find_all([before[d] for d in kept], field)):
        assert texts[doc].count("<EMAIL>") == sum(s[0] == "email" for s in spans)
        assert all(before[doc][a:b] not in texts[doc] for k, a, b, _ in spans if k == "email")
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept)


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {2, 6, 8, 9}
    no_docs.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert len(ODD) == 12


def test_unlabelled_documents_stay(spark, odd_docs, tmp_path):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, lang in (("null", "CAST(NULL AS string)"), ("blank", "' '")):
        folder = str(tmp_path / name)
        plain.selectExpr("doc_id", "text", f"{lang} AS lang", "source", "n_chars").write.parquet(
            f"{folder}/documents.parquet"
        )
        assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {2, 6, 8, 9}


def test_clashing_columns_pass_through_the_stages(spark, odd_docs):
    table = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = keep(stage(spark, table, SF_DIR), name)
        assert table.columns == odd_docs.columns
    assert {r.doc_id for r in table.collect()} == {2, 6, 8, 9}
    name, stage = corpus_pipeline.STAGES[-1]
    assert {r.doc_id for r in stage(spark, table, SF_DIR).collect()} == {2, 6, 8, 9}


def test_tables_of_earlier_stages_are_deleted(spark, odd_docs, tmp_path):
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    folder = os.path.dirname(os.path.dirname(pieces.inputFiles()[0].removeprefix("file://")))
    before = set(glob.glob(f"{folder}/stage_*/*.parquet"))
    corpus_pipeline.run(spark, str(tmp_path))
    new = set(glob.glob(f"{folder}/stage_*/*.parquet")) - before
    assert new and all("stage_packing-" in path for path in new)


def test_names():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, result.fetchall())
