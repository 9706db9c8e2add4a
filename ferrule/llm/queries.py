"""The text operators bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.packing import pack_documents

    pieces = pack_documents(_table(spark, sf_dir, "documents"), max_tokens=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "cost")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.common import learns
    from ferrule.llm.toxicity import score_toxicity, train

    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~learns("doc_id", 3)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.segments import sample_segmentations

    rows = sample_segmentations(_table(spark, sf_dir, "documents"), k=2, seed=0, decoded=True)
    return rows.select("doc_id", "sample", "n_pieces", F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion_log", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.pii import digest, find_pii

    return digest(find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.secret_scan import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.token_files import read_token_files, token_folder, write_token_files

    folder = token_folder(spark)
    manifest = write_token_files(_table(spark, sf_dir, "documents"), folder)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=80)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.katz import katz_scores

    return katz_scores(_table(spark, sf_dir, "documents"))


#: (host, path, verdict) of the query's filter; values of its contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.url_filter import judge_urls

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.divergence import audit_divergence

    return audit_divergence(_table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.filter_audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_fingerprints, op3_toxicity, op4_exact_dedup, op5_segments, op6_pii, op7_secret_scan, op8_token_files, op9_ngram_join, op10_katz, op11_url_filter, op12_source_divergence, op13_filter_audit)}


SQL: dict[str, str] = {}

# The text is normalised, then grouped by itself; the smallest id of a group stays.
SQL["op4_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""

# Host and path by pattern, each rule by itself, the longest last.
SQL["op11_url_filter"] = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rh, rp, v))
SELECT page_id, host, path, (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
 coalesce((SELECT arg_max(v, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict FROM u
"""

# Every group with every kept term, zero counts too.
SQL["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
g AS (SELECT *, sum(n) OVER (PARTITION BY lang, term) AS total, sum(n) OVER (PARTITION BY lang, source) AS size, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang) AS lang_size FROM f),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (size + 5 * v) AS p, 1 + (1000000000 * (total + 5)::HUGEINT) // (lang_size + 5 * v) AS q FROM g),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
t AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM (SELECT a.lang, a.source, b.source AS item FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source) LEFT JOIN x USING (lang, source, item)
 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM t) WHERE part = 'pair' OR rank <= 50
"""

# Every order walked along: a row's place in an order is the first filter that it fails.
SQL["op13_filter_audit"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, concat_ws('', CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN d.doc_id > first THEN 'E' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, step, o[step] AS x, o[:step - 1] AS done FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) WHERE length(o) = 5),
m AS (SELECT c.*, s.*, contains(fails, x) AS own, CASE WHEN done = '' THEN false ELSE translate(fails, done, '') <> fails END AS gone FROM c, s),
a AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM a
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
