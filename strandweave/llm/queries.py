"""The registered queries of this subpackage, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, mixing, ngram_join, pieces, pii, quality, token_store, topk, toxicity, url_lists


#: The key of the registered queries' surrogates, public as their tables are; a user gives a secret one.
PII_KEY = "registered-queries"


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(_table(spark, sf_dir, "documents")).drop("node")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_table(spark, sf_dir, "documents"), PII_KEY, count_col="n_entities").select("doc_id", "n_entities", "text")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def captures(pages: DataFrame) -> DataFrame:
    """`pages` has no fetch time; its id fixes a day in four years from 2021 on."""
    return pages.select("page_id", "url", F.expr("date_add(date'2021-01-01', cast(pmod(page_id * 7919, 1460) as int))").alias("fetched"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(url_lists.ENTRIES, "dated string, pattern string, action string, category string")
    out = url_lists.judge(captures(_table(spark, sf_dir, "pages")), entries)
    return out.select("page_id", "url", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", "pattern", "category", F.col("valid_from").cast("string").alias("valid_from"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.vector_top_k(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "replica", "shuffle_key", "n_chars", F.md5("text").alias("text_md5"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_quality, op3_pii, op4_pieces, op5_embeddings, op6_url_filter, op7_topk, op8_toxicity, op9_tokens, op10_mixing, pipeline)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), sized AS (
  SELECT doc_id, s, len(s)::BIGINT AS n FROM sets
), tokens AS (
  SELECT doc_id, n, hash(t) AS t FROM (SELECT doc_id, n, unnest(s) AS t FROM sized)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least_of AS (
  SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id
)
SELECT s.doc_id, s.n AS n_shingles, coalesce(r.c, s.doc_id) AS component_id FROM sized s LEFT JOIN least_of r ON s.doc_id = r.doc_id
"""

_VALUES = ", ".join(f"(DATE '{d}', '{p}', '{a}', '{c}')" for d, p, a, c in url_lists.ENTRIES)
_OP6 = rf"""
WITH entries(valid_from, pattern, action, category) AS (VALUES {_VALUES}),
held AS (
  SELECT * FROM (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM entries) WHERE action <> 'remove'
), p AS (
  SELECT page_id, url, DATE '2021-01-01' + (page_id * 7919 % 1460)::INTEGER AS fetched,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS host,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) AS path FROM pages
), hits AS (
  SELECT p.page_id, h.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(h.pattern) DESC) AS i FROM p JOIN held h
    ON (p.host = h.pattern OR ends_with(p.host, '.' || h.pattern) OR starts_with(p.host || '/' || p.path || '/', h.pattern || '/') AND contains(h.pattern, '/'))
   AND h.valid_from <= p.fetched AND (h.valid_to IS NULL OR p.fetched < h.valid_to)
)
SELECT p.page_id, p.url, p.host, p.fetched::VARCHAR AS fetched, coalesce((h.action = 'block')::INTEGER, 0) AS blocked, h.pattern, h.category, h.valid_from::VARCHAR AS valid_from
FROM p LEFT JOIN hits h ON p.page_id = h.page_id AND h.i = 1
"""

_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

_U = "('0x' || substr(md5({0}), 1, 13))::BIGINT"
_OP10 = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, (SELECT sum(size) FROM sizes)::DOUBLE * pow(size::DOUBLE, {mixing.TEMPERATURE}) / (SELECT sum(pow(size::DOUBLE, {mixing.TEMPERATURE})) FROM sizes) / size AS rate FROM sizes
), steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + sqrt(rate) * 12 + 24)
), drawn AS (
  SELECT doc_id, source, n_chars, text, {_U.format(f"'{mixing.SEED}|copies|0|' || coalesce(doc_id::VARCHAR, 'null')")}::DOUBLE / {1 << 52} AS u FROM documents
), counted AS (
  SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND d.u >= s.c) AS n FROM drawn d
), rows AS (
  SELECT doc_id, source, n_chars, text, unnest(range(n))::INTEGER AS replica FROM counted
)
SELECT doc_id, source, replica, {_U.format(f"'{mixing.SEED}|order|' || replica || '|' || coalesce(doc_id::VARCHAR, 'null')")} AS shuffle_key, n_chars, md5(text) AS text_md5 FROM rows
"""

#: The other operators are learned models, keyed surrogates, tokenizers or approximate search, which SQL
#: cannot express; their tests compare them with brute force, round trips and held-out labels.
ORACLES = {"op1_ngram_jaccard": _OP1, "op6_url_filter": _OP6, "op7_topk": _OP7, "op10_mixing": _OP10}
