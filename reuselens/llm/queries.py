"""The registered queries of this package: each applies its operator to its
whole table with the operator's own parameters and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import (conversations, decontaminate, htmltext, langid, licences, neighbours, packing, simhash, substring, tokenfile,
               urlfilter, variants, warc)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents", "doc_id", "text"), with_ids=False)


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "bits")


@query
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


ORACLE["op9_substring"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT md5(g) AS k, min(doc_id) AS d FROM win GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
hit AS (
  SELECT win.doc_id, unnest(range(i, i + 50)) AS j
  FROM win JOIN firsts ON md5(g) = k WHERE win.doc_id > d),
gone AS (SELECT DISTINCT doc_id, j FROM hit),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS x FROM w),
agg AS (
  SELECT word.doc_id, count(gone.j) AS n_removed,
         coalesce(string_agg(x, ' ' ORDER BY word.j) FILTER (WHERE gone.j IS NULL), '') AS kept
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN agg USING (doc_id)
"""


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents", "doc_id", "text"),
                               load(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "verdict string, host string, path string")
    return urlfilter.judge(load(spark, sf_dir, "pages", "page_id", "url"), rules)


ORACLE["op6_urlfilter"] = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT page_id, rowid_, translate(regexp_extract(rest, '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, row_number() OVER () AS rowid_,
               CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages))
SELECT u.page_id, any_value(u.host) AS host, any_value(u.path) AS path,
       arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule,
       coalesce(arg_max(r.verdict, length(r.host) + length(r.path)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
GROUP BY u.page_id, u.rowid_
"""


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(load(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_archive(spark, path).drop("payload", "target_uri")


ORACLE["op1_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS f FROM p),
x AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: list_extract(
        ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
        position(substr(h, i, 1) IN '0123456789abcdef'))), '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
         + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
         + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to,
       CASE WHEN page_id = f THEN true END AS intact
FROM x
"""


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(load(spark, sf_dir, "pages", "page_id", "html"))


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0)


@query
def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.write_tokens(load(spark, sf_dir, "documents", "doc_id", "text"))
    return tokenfile.read_tokens(spark, path, with_ids=False)


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows))
