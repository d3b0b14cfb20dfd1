"""Queries over the driver's tables, one for each operator, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, exact_dedup, html_extract, jaccard_join, language_id, mixing, token_counts, toxicity, url_filter, warc
from tilewright.llm.common import crc_mod, table

#: The rules of the URL filter, as (verdict, host/path prefix).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    net = language_id.fit_on(docs.filter(~held_out))
    return language_id.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.join(table(spark, sf_dir, "documents"), words=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), limit=1024)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least=0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    trees = url_filter.fit_on(pages.select("url", url_filter.word_label(F.col("url")).alias("label")))
    return url_filter.judge(pages, URL_RULES, trees)


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def llm_held_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds that op1 and op7 hold out, as their queries compute them."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("op1_held_out"), (crc_mod("doc_id", 5) == 0).alias("op7_held_out"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_main_text": op4_main_text,
    "op5_warc_index": op5_warc_index,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_source_mixing": op9_source_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "llm_url_rules": llm_url_rules,
    "llm_held_out_folds": llm_held_out_folds,
}

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, sum(source_size) OVER ()::BIGINT AS total FROM s
), l AS (
  SELECT *, coalesce(sum(2 * source_size) OVER lv, 0)::BIGINT AS cap_before,
         sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER lv, 0)::BIGINT AS w_left
  FROM w WINDOW lv AS (ORDER BY 2 * source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, 4 * source_size * w_left <= (3 * total - 2 * cap_before) * w AS is_full FROM l
), r AS (
  SELECT *, 3 * total - 2 * sum(CASE WHEN is_full THEN 2 * source_size ELSE 0 END) OVER ()::BIGINT AS rest,
         sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()::BIGINT AS w_rest,
         greatest(1, total // 16777216)::BIGINT AS block, least(4096, (n_docs + 255) // 256) AS n_shards FROM f
), t AS (
  SELECT *, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE (w * rest)::DOUBLE / (2.0::DOUBLE * w_rest) END AS target,
         floor(rest / (2 * block) + 0.5)::BIGINT AS seats FROM r
), q1 AS (  -- seats surely won, then every quotient that may win one of the others
  SELECT rank, w, seats, greatest(0, floor(w / sum(w) OVER () * seats - w / sum(w) OVER () * count(*) OVER () / 2 - 1))::BIGINT AS low,
         floor(w / sum(w) OVER () * seats + w / sum(w) OVER () * count(*) OVER () / 2 + 2)::BIGINT AS high
  FROM t WHERE NOT is_full
), q2 AS (SELECT *, seats - sum(low) OVER () AS open FROM q1
), q3 AS (SELECT rank, low, open, row_number() OVER (ORDER BY w / (2.0::DOUBLE * k + 1) DESC, rank) AS pos
          FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM q2)
), q AS (SELECT rank, (max(low) + count(*) FILTER (WHERE pos <= open))::BIGINT AS quota FROM q3 GROUP BY rank
), p AS (
  SELECT d.doc_id, d.size, t.*, q.quota, md5('7:' || d.doc_id) AS key,
         ('0x' || md5('7:' || d.doc_id)[1:7])::BIGINT % n_shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON t.rank = q.rank
), h AS (SELECT rank, shard, sum(size)::BIGINT AS shard_size, max(quota) AS quota FROM p WHERE NOT is_full AND size > 0 GROUP BY rank, shard
), h1 AS (
  SELECT *, shard_size / sum(shard_size) OVER s AS share, count(*) OVER s AS n FROM h WINDOW s AS (PARTITION BY rank)
), h2 AS (
  SELECT *, greatest(0, floor(share * quota - share * n / 2 - 1))::BIGINT AS low, floor(share * quota + share * n / 2 + 2)::BIGINT AS high FROM h1
), h3 AS (SELECT *, quota - sum(low) OVER (PARTITION BY rank) AS open FROM h2
), h4 AS (SELECT rank, shard, low, open, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2.0::DOUBLE * k + 1) DESC, shard) AS pos
          FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM h3)
), hq AS (SELECT rank, shard, (max(low) + count(*) FILTER (WHERE pos <= open))::BIGINT AS blocks FROM h4 GROUP BY rank, shard
), e AS (
  SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e_end,
         sum(size) OVER (PARTITION BY rank, shard)::BIGINT AS shard_size FROM p
), g AS (
  SELECT e.*, greatest(1, shard_size) AS turn, least(coalesce(blocks, 0) * block, 2 * shard_size) AS wanted,
         ('0x' || md5('7:start:' || e.rank || ':' || e.shard)[1:7])::BIGINT % ((greatest(1, shard_size) + block - 1) // block) * block AS f
  FROM e LEFT JOIN hq ON e.rank = hq.rank AND e.shard = hq.shard
)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN is_full THEN 2 * size ELSE wanted // turn * size
         + greatest(0, least(e_end, f + wanted % turn) - greatest(e_end - size, f))
         + greatest(0, least(e_end, f + wanted % turn - turn) - (e_end - size)) END)::BIGINT AS taken
FROM g
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""

OP5_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, sha256(b) AS k FROM p
), f AS (SELECT k, min(page_id) AS first FROM h GROUP BY k)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         (((('0x' || h[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h JOIN f USING (k)
"""

URL_RULES_SQL = r"""
WITH s AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM s
), r(rule, rule_host, prefix) AS (
  VALUES ('com/en/', 'com', '/en/'), ('example.com/en/7', 'example.com', '/en/7'), ('net/de/', 'net', '/de/'),
         ('example.net/de/8', 'example.net', '/de/8'), ('org/es/', 'org', '/es/')
), m AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule FROM u JOIN r
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, prefix) GROUP BY page_id
)
SELECT u.page_id, host, path, rule FROM u LEFT JOIN m ON u.page_id = m.page_id
"""

FOLDS_SQL = """
WITH c AS (  -- CRC-32, byte by byte and bit by bit
  SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295) AS crc FROM documents
)
SELECT doc_id, crc % 3 = 1 AS op1_held_out, crc % 5 = 0 AS op7_held_out FROM c
"""

ORACLES: dict[str, str] = {"llm_url_rules": URL_RULES_SQL, "llm_held_out_folds": FOLDS_SQL, "op2_jaccard_join": OP2_SQL, "op5_warc_index": OP5_SQL, "op9_source_mixing": OP9_SQL, "op10_exact_dedup": OP10_SQL}
