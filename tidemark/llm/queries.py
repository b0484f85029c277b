"""The corpus operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    centroids,
    divergence,
    embed_dups,
    exact_dups,
    lang_id,
    near_dups,
    packing,
    patterns,
    pii,
    quality,
    secret_scan,
    token_counts,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", "fingerprint", "component_id", "kept")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dups.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"), least_bytes=0, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dups.exact_duplicates(table(spark, sf_dir, "documents"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    return found.select("doc_id", "keep_id", "group_size", "kept", sha)


def count_where(spans: Column, field: str, value: str) -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("bigint")


def span_columns(kinds: list[str]) -> list[Column]:
    """The counts and the digest of the patterns' spans, and all spans as text."""

    def place(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    base = F.filter("spans", lambda s: s["base"])
    counts = [count_where(base, "kind", kind).alias(f"n_{kind}") for kind in kinds]
    joined = F.concat_ws(",", F.transform(base, place))
    return [
        *counts,
        F.sha2(joined, 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", place)).alias("spans"),
    ]


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = pii.train_on(pii.labelled_table(spark))
    found = pii.find(table(spark, sf_dir, "documents"), field)
    return found.select("doc_id", *span_columns(list(patterns.PERSONAL)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    found = secret_scan.scan(docs, F.col("source"), repository)
    verdicts = [count_where(F.col("spans"), "verdict", v).alias(f"n_{v}") for v in ("example", "live")]
    return found.select("doc_id", *verdicts, *span_columns(["assign", "access", "hex"]))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        value=lambda ids: zlib.crc32(ids.astype("<u4").tobytes()),
        value_type="bigint",
        value_arrow=pa.int64(),
    )
    return pieces.withColumnRenamed("value", "ids_crc32")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, lang_id.train(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.diverge(table(spark, sf_dir, "documents"), least_docs=3, top=200)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_simhash_near_dedup,
        op2_pii_spans,
        op3_packing,
        op4_embedding_near_dedup,
        op5_warc_normaliser,
        op6_exact_dedup,
        op7_secret_scan,
        op8_bpe_round_trip,
        op9_language_id,
        op10_quality,
        op11_token_counts,
        op12_centroid_clustering,
        op13_source_divergence,
    )
}


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """The plain algorithm: every vector against every centroid, round after round."""
    gap = "CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT)"
    steps = []
    for j in range(rounds + 1):
        steps.append(f"""
        near{j} AS MATERIALIZED (
            SELECT r, c, gap FROM (
                SELECT k.r, c.c, {gap} AS gap, row_number() OVER (PARTITION BY k.r ORDER BY {gap}, c.c) AS n
                FROM k, cents{j} c)
            WHERE n = 1)""")
        if j < rounds:
            steps.append(f"""
        cents{j + 1} AS MATERIALIZED (
            SELECT c, coalesce(m.v, o.v) AS v FROM cents{j} o LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                    SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                    FROM near{j} JOIN parts USING (r) GROUP BY c, i)
                GROUP BY c) m USING (c))""")
    return f"""
        WITH k AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM k),
        cents0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
                SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM k ORDER BY h, v LIMIT {k})),
        {",".join(steps)}
        SELECT k.vec_id, CAST(n.c AS INTEGER) AS cluster, n.gap AS distance,
            CAST(sum(n.gap) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(n.gap) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM near{rounds} n JOIN k USING (r) JOIN cents{rounds} c ON c.c = n.c"""
ORACLES: dict[str, str] = {
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        fine AS (
            SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM least LEFT JOIN counts USING (vec_id)""",
    "op5_warc_normaliser": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, b, sha1(b) AS hex FROM p),
        five AS (SELECT list_transform(range(32), lambda x: lpad(bin(x), 5, '0')) AS codes,
            list_transform(range(16), lambda x: lpad(bin(x), 4, '0')) AS four),
        bits AS (
            SELECT page_id, b, codes, array_to_string(list_transform(range(1, 41),
                lambda i: four[strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS s
            FROM h, five),
        d AS (
            SELECT page_id, b, array_to_string(list_transform(range(32), lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                list_position(codes, substr(s, i * 5 + 1, 5))::BIGINT, 1)), '') AS payload_digest
            FROM bits),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS first FROM d)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op6_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
        FROM d WINDOW g AS (PARTITION BY h)""",
    "op12_centroid_clustering": _clusters_sql(),
    "op13_source_divergence": r"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        t AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
        kept AS MATERIALIZED (
            SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        langs AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
        counts AS MATERIALIZED (
            SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        totals AS (
            SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source)
            GROUP BY ALL),
        p AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.terms) AS HUGEINT) AS p
            FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang)
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        q AS (
            SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (n + 1) // (total + terms) AS HUGEINT) AS q
            FROM kept JOIN langs USING (lang)),
        gaps AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(g.value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT)
            FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        WHERE part = 'pair' OR rank <= 200""",
}
