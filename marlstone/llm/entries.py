"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, histsort, langid, minhash, mixing, nbest, surrogate, urlrules, vamana, warczip

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its PII replaced by surrogates, and how many of each type there were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return surrogate.counted(docs)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SuperMinHash near-duplicate components of all documents: 3-word shingles, similarity 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return minhash.near_duplicates(docs, words=3, percent=85)


_OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3
      THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v
  WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id
"""


#: host, path, verdict
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = urlrules.judged(pages, urlrules.rule_table(spark, RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


_OP3 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(rhost, rpath, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (
  SELECT page_id, arg_max(rhost || rpath, len(rhost) + len(rpath)) AS rule, arg_max(v, len(rhost) + len(rpath)) AS v
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1
)
SELECT h.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id
"""


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all vectors whose cosine is 0.95 or more."""
    return covertree.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


_OP4 = """
WITH RECURSIVE l AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), v AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM l
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, k.v FROM reach r JOIN links k ON r.b = k.u
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixing.assigned(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written into ZIP packages and read back by ranges."""
    packages = warczip.packed(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warczip.records(packages, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


_OP6 = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, i * 5 + 1, 5) AS BIGINT)) AS parts FROM d),
b AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY hex) AS low, list_aggregate(list_transform(parts,
    lambda x: list_aggregate(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31) + 1, 1)), 'string_agg', '')),
    'string_agg', '') AS payload_digest
  FROM v
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> low THEN low END AS refers_to FROM b
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return langid.identified(docs)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product to every vector whose id is divisible by 20."""
    return vamana.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return histsort.sharded(docs, 8)


def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 best segmentations of every document: piece count, scores, digests of ids, round trip."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return nbest.digested(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_url_filters": op3_url_filters,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_mixing": op5_mixing,
        "op6_warc_zip": op6_warc_zip,
        "op7_language_id": op7_language_id,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_sharding": op9_sharding,
        "op10_sentencepiece_nbest": op10_sentencepiece_nbest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_near_dedup": _OP2,
        "op3_url_filters": _OP3,
        "op4_embedding_near_dedup": _OP4,
        "op6_warc_zip": _OP6,
    }
