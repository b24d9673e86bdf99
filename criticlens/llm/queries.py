"""The registered queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from criticlens.llm import alignment, decontaminate, mixing, neardup, neighbours, pages, pii, quality, resampling, substrings, suffixes, toxicity, urls
from criticlens.session import ensure_settings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(_table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.find_repeats(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_page_text": op1_page_text,
    "op2_url_filter": op2_url_filter,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_toxicity": op4_toxicity,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_repeated_spans": op6_repeated_spans,
    "op7_source_mix": op7_source_mix,
    "op8_adaptive_quality": op8_adaptive_quality,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_personal_data": op10_personal_data,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}

URL_SQL = r"""
WITH u AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages
), p AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u
), r AS (
    SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                          ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, rule_host, rule_path)
), m AS (
    SELECT p.page_id, p.host, p.path, r.verdict, rule_host || rule_path AS rule,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
    FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE nth = 1
"""

MIX_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 3))::INT AS slot
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
    SELECT source, source_size, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS lim FROM s
), o AS (
    SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS k, coalesce(sum(lim) OVER b, 0) AS fixed, sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
           (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total
    FROM w WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
    SELECT arg_min((total - fixed)::DOUBLE / free, k) FILTER (weight * ((total - fixed)::DOUBLE / free) <= lim) AS level FROM o
), t AS (
    SELECT source, source_size, least(weight * level, lim::DOUBLE) AS target,
           CASE WHEN source_size > 0 THEN floor(least(weight * level, lim::DOUBLE) / source_size) ELSE 0 END AS whole
    FROM w, l
), g AS (
    SELECT source, slot, sum(size) AS slot_size,
           coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
    FROM d GROUP BY source, slot
), q AS (
    SELECT t.source, slot, source_size, target, whole,
           CASE WHEN slot_size > 0 THEN greatest(0.0, least(1.0, (target - whole * source_size - run) / slot_size)) ELSE 0.0 END AS part
    FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (whole * size + floor(size * part + 0.5))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.slot = q.slot
"""

RESAMPLE_SQL = r"""
WITH RECURSIVE bits AS (
    SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
    UNION ALL
    SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), dw AS (
    SELECT doc_id, unnest(words) AS word FROM d
), bw AS (
    SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), v AS (
    SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), b AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM v, crc
), s AS (
    SELECT bucket, count(*) AS n FROM dw JOIN b USING (word) GROUP BY bucket
), t AS (
    SELECT bucket, count(*) AS n FROM bw JOIN b USING (word) GROUP BY bucket
), g AS (
    SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
                                     / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket)
), w AS (
    SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id
), c AS (
    SELECT d.doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN w USING (doc_id)
), r AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM c WHERE n_features >= 20
)
SELECT c.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM c LEFT JOIN r USING (doc_id)
"""

ORACLE = {"op2_url_filter": URL_SQL, "op7_source_mix": MIX_SQL, "op13_importance_resampling": RESAMPLE_SQL}
