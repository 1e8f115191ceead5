"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimspark.llm import ann, bpe, impact_index, minhash, mixing, pii, quality, secrets_crf, toxicity, urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top_k(_read(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.find(_read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the public tokenizer's file is on this cluster."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_minhash": op2_minhash,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_mix_sources": op5_mix_sources,
    "op6_top_k": op6_top_k,
    "op7_url_filter": op7_url_filter,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM per
), live AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS left_over, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w
  FROM weighed WHERE source_size > 0
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT left_over AS lo, left_w AS lw, cap / w AS r FROM live WHERE left_over * w / left_w <= cap ORDER BY r LIMIT 1
), shares AS (
  SELECT source, source_size, w, cap,
    CASE WHEN source_size = 0 THEN 0.0 WHEN lo IS NULL OR cap / w < r AND lo * w / lw > cap THEN cap ELSE lo * w / lw END::DOUBLE AS target,
    ('0x' || substr(md5('7:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM weighed LEFT JOIN level ON true
), placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size)), coalesce(md5(doc_id::VARCHAR), ''), doc_id) - 1 AS place FROM sized s
)
SELECT doc_id, size, p.source_size, target,
  (greatest(0, least(crossed, ceil(expected)))::INT * size)::BIGINT AS taken, greatest(0, least(crossed, ceil(expected)))::INT AS copies, p.source
FROM (
  SELECT placed.doc_id, placed.size, placed.source, s.source_size, s.target, e AS expected, floor((place + 1)::DOUBLE * e + shift) - floor(place::DOUBLE * e + shift) AS crossed
  FROM placed JOIN (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS e FROM shares) s
    ON placed.source IS NOT DISTINCT FROM s.source
) p
""",
    "op6_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
""",
    "op7_url_filter": r"""
WITH rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), x AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), pairs AS (SELECT DISTINCT host, path FROM x
), fits AS (
  SELECT host, path, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY host, path ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, action) AS n
  FROM pairs JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, x.host, x.path, rule, coalesce(action, 'allow') AS verdict
FROM x LEFT JOIN fits ON x.host = fits.host AND x.path = fits.path AND n = 1
""",
}
