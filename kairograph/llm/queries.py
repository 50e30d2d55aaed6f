"""One query for each corpus operator, over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import bpe, html_text, jaccard_join, mixing, mtree, multi_index, packing, periodic, quality, secrets, token_alignment, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op3_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op4_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(_table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return found.withColumn("headers", F.array_join(F.array_sort(lines), "\n"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_multi_index_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_recursive_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op11_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_array_html": op1_suffix_array_html,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_prefix_jaccard": op3_prefix_jaccard,
    "op4_revisit_asof": op4_revisit_asof,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_multi_index_neardup": op6_multi_index_neardup,
    "op7_bpe_tree": op7_bpe_tree,
    "op8_additive_quality": op8_additive_quality,
    "op9_counterfactual_toxicity": op9_counterfactual_toxicity,
    "op10_recursive_secrets": op10_recursive_secrets,
    "op11_nnls_packing": op11_nnls_packing,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

_OP4_SQL = r"""
WITH base AS (
  SELECT page_id AS p, url, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^http://', 'https://www.') ELSE url END AS other,
    (page_id * 37) % 1000 AS d, md5(coalesce(html, '')) AS first, md5(coalesce(html, '') || '2') AS second FROM pages
), dated AS (SELECT *, d - d % 50 AS since, 'v' || CAST(d - d % 50 AS VARCHAR) AS version FROM base),
pairs AS (SELECT p, url, other, 0 AS k, d AS at_day, first AS own FROM dated UNION ALL SELECT p, url, other, 2, d + 10, second FROM dated),
listed AS (
  SELECT 6 * p + k AS record_id, url AS uri, at_day AS ts, true AS whole, '"' || own || '"' AS etag, CASE WHEN p % 5 <> 0 THEN at_day END AS modified, CASE WHEN p % 3 <> 0 THEN own END AS digest FROM pairs
  UNION ALL
  SELECT 6 * p + k + 1, other, at_day + p % 5 - 1, false, CASE WHEN p % 7 = 0 THEN '"changed"' WHEN p % 2 = 0 THEN 'W/"' || own || '"' END,
    CASE WHEN p % 13 = 0 THEN 0 WHEN p % 4 = 1 THEN at_day END, CASE WHEN p % 11 = 0 THEN md5('other') ELSE own END FROM pairs
  UNION ALL
  SELECT 6 * p + 4, 'http://static.example.org/site.js', d, p % 4 = 0, '"' || version || '"', since, md5(version) FROM dated
  UNION ALL
  SELECT 6 * p + 5, 'https://www.static.example.org/site.js#x', d, false, NULL, CASE WHEN p % 2 = 0 THEN since END, NULL FROM dated
), records AS (
  SELECT record_id, uri, ts, whole, etag, digest, strftime(DATE '2000-01-01' + CAST(modified AS INTEGER), '%a, %d %b %Y %H:%M:%S GMT') AS modified FROM listed
), parts AS (
  SELECT *, regexp_replace(trim(uri), '#.*$', '') AS u, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?@]*@)?([^/?]*)([^?]*)\??(.*)$' AS pat FROM records
), urls AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, pat, 2)), ':(?:80|443)?$', ''), '^www\d*\.', '') AS host,
    regexp_replace(regexp_extract(u, pat, 3), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, pat, 4), '&'), lambda p: p <> '')), '&') AS query FROM parts
), named AS (
  SELECT *, CASE WHEN regexp_matches(u, pat) THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END ELSE u END AS canonical FROM urls
), matched AS (
  SELECT *, last_value(CASE WHEN whole AND canonical IS NOT NULL THEN struct_pack(id := record_id, etag := etag, modified := modified, digest := digest) END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM named
), judged AS (
  SELECT *, CASE WHEN s IS NULL THEN 'no earlier response' ELSE CASE coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(s.etag, '^W/', ''), modified = s.modified, digest = s.digest)
    WHEN true THEN 'confirmed' WHEN false THEN 'validator mismatch' ELSE 'unverified' END END AS verdict FROM matched WHERE NOT whole
)
SELECT record_id, canonical, CASE WHEN verdict IN ('confirmed', 'unverified') THEN s.id END AS resolved_id, verdict,
  CASE WHEN verdict IN ('confirmed', 'unverified') THEN 'age: 0' || chr(10) || 'cache-control: no-cache' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || s.etag
    || coalesce(chr(10) || 'last-modified: ' || coalesce(modified, s.modified), '') END AS headers
FROM judged
"""

_OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

_COMPONENTS = """walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b),
least AS (SELECT a, min(b) AS b FROM walk GROUP BY a)"""

_OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id
"""

_OP6_SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{_COMPONENTS}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, least(vec_id, coalesce(least.b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

ORACLES: dict[str, str] = {"op2_mtree_topk": _OP2_SQL, "op3_prefix_jaccard": _OP3_SQL, "op4_revisit_asof": _OP4_SQL, "op6_multi_index_neardup": _OP6_SQL}
