"""Queries op1 to op13 over the corpus tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import divergence, exact_dedup, gif_media, html_extract, language_id, license_scan, mixing, pieces, quality, secret_scan, simhash, vector_codes, vector_tree
from plumbline.llm.common import bucket_of

PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 3) == 1)
    model = language_id.fit_language_model(docs.where("not held_out"))
    return language_id.identify_languages(docs, model, keep=("doc_id", "held_out"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf_dir, "documents"), batches=2)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op6_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), digests=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 5) == 0)
    labels = _table(spark, sf_dir, "labels").where(bucket_of("doc_id", 5) != 0)
    model = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, model, keep=("doc_id", "held_out"))


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_table(_table(spark, sf_dir, "documents"), with_media=False)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.nearest_vectors(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_secret_scan, op3_exact_dedup, op4_mix_sources, op5_html_main_text, op6_piece_tokens, op7_simhash, op8_quality, op9_gif_media, op10_license_scan,
        op11_source_divergence, op12_vector_tree, op13_vector_codes,
    )
}



def _codes_sql() -> str:
    """Rounds of assignment and means written out; distances of all parts with all entries."""
    steps = []
    for k in range(5):
        if k:
            steps.append(f"""s{k} AS (
  SELECT p, m[2] AS i, j, floor_of(sum(v[j]), count(*)) AS y FROM a{k - 1}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY 1, 2, 3
), c{k} AS MATERIALIZED (
  SELECT c.p, c.i, coalesce(t.v, c.v) AS v FROM c{k - 1} c LEFT JOIN (SELECT p, i, list(y::BIGINT ORDER BY j) AS v FROM s{k} GROUP BY 1, 2) t ON t.p = c.p AND t.i = c.i
)""".replace("floor_of(sum(v[j]), count(*))", "CASE WHEN sum(v[j]) >= 0 THEN sum(v[j]) // count(*) ELSE -((count(*) - 1 - sum(v[j])) // count(*)) END"))
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT x.vec_id, x.label, x.p, x.v, min([list_sum(list_transform(range(1, len(x.v) + 1), lambda j: (x.v[j] - c.v[j]) * (x.v[j] - c.v[j])))::BIGINT, c.i]) AS m
  FROM x JOIN c{k} c ON c.p = x.p GROUP BY 1, 2, 3, 4
)""")
    return f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM kept, (SELECT unnest(range(4)) AS p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, v FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
), {", ".join(steps)}, h AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c4
), r AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(m[2])), 2, '0'), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a4 GROUP BY 1
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r CROSS JOIN h"""


ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
""",
    "op4_mix_sources": """
WITH s AS (
  SELECT source, sum(length(coalesce(text, '')))::BIGINT AS mass, sqrt(count(*)::DOUBLE) AS share FROM documents GROUP BY source
), r AS (
  SELECT source, CASE WHEN mass > 0 THEN 1.0::DOUBLE * (SELECT sum(mass) FROM s)::DOUBLE * share / (SELECT sum(share) FROM s) / mass::DOUBLE
                      ELSE 1.0::DOUBLE END AS rate FROM s
), k AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM r
), p AS (
  SELECT source, k, exp(-rate + sum(CASE WHEN k > 0 THEN ln(rate / k) ELSE 0.0::DOUBLE END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k
), c AS (
  SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p) GROUP BY source
), n AS (
  SELECT d.*, len(list_filter(c.cdf, lambda x: x <= (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)) AS copies
  FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source
), e AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM n
)
SELECT *, md5('mix-1|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no::VARCHAR) AS mix_key FROM e
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(found) AS term FROM d) GROUP BY 1, 2, 3
), k AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(found)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 30
), l AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY 1, 2
), z AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM l GROUP BY 1
), g AS (
  SELECT DISTINCT lang, source FROM d
), t AS (
  SELECT lang, source, sum(n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY 1, 2
), p AS (
  SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * z.v) AS p,
         1 + (1000000000::HUGEINT * (l.n + 5)) // (z.n + 5 * z.v) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN z ON z.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
""",
    "op13_vector_codes": _codes_sql(),
}
