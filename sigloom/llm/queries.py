"""The queries op1_ to op10_ over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import bpe, lang_id, line_dedup, media, near_dedup, packing, secrets, sharding, topk, url_filter
from sigloom.sources.readers import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the operators whose work on a text is many times that of reading it."""
    return spread(_read(spark, sf_dir, "documents"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), url_filter.listed_frame(spark))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_texts(_documents(spark, sf_dir)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.detect_languages(_documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_every(_read(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_url_filter, op3_secrets, op4_media, op5_line_dedup, op6_language_id, op7_bpe, op8_packing, op9_top_k, op10_sharding)}

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _op1_sql() -> str:
    return rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_FOLD}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
    c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
    FROM s LEFT JOIN c ON a = doc_id"""


def _op2_sql() -> str:
    fits = "\n".join(f"WHEN (host = '{t.split('/', 1)[0]}' OR ends_with(host, '.{t.split('/', 1)[0]}')) AND starts_with(path, '/{t.split('/', 1)[1]}') THEN '{t}'" for _, t in sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1])))
    said = " ".join(f"WHEN '{t}' THEN '{v}'" for v, t in url_filter.RULES)
    listed = " OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in url_filter.LISTED)
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_FOLD}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT *, CASE {fits} END AS rule, ({listed}) AS listed FROM h)
    SELECT page_id, host, path, rule, listed, CASE rule {said} ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict FROM r"""


def _op5_sql() -> str:
    strip = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
    WITH l AS (SELECT doc_id, i, line, translate(trim(line, {strip}), {_FOLD}) AS key FROM
                (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
    k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT l.*, k.key IS NOT NULL AND doc_id <> last AS lost FROM l LEFT JOIN k USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""


def _op9_sql() -> str:
    return """
    WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.i <> q.i),
    r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


def _op10_sql() -> str:
    table = ",".join(map(str, sharding.fill()))
    return f"""
    WITH s AS (SELECT doc_id, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {sharding.SLOTS}, 0) AS slot, coalesce(strlen(text), 0) AS text_bytes FROM documents)
    SELECT doc_id, slot, ([{table}])[slot + 1]::INT AS shard, text_bytes FROM s"""


ORACLE_SQL = {"op1_near_dedup": _op1_sql(), "op2_url_filter": _op2_sql(), "op5_line_dedup": _op5_sql(), "op9_top_k": _op9_sql(), "op10_sharding": _op10_sql()}
