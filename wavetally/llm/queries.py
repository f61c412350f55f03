"""The queries of the ten operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetally.llm import exact_dedup, html_extract, importance, lm_mix, media, mixing, packing, simhash, toxicity, url_filter
from wavetally.llm.common import held_out, table


def op1_lm_scoring(spark, sf_dir):
    out = held_out(F.col("doc_id"), 7, 2)
    return lm_mix.score(table(spark, sf_dir, "documents"), ~out).withColumn("held_out", out)


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    found = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments")


def op5_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_media_flac(spark, sf_dir):
    return media.digests(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_simhash_near_dedup, op3_exact_dedup, op4_toxicity, op5_html_extraction, op6_url_filter, op7_packing, op8_mixing, op9_media_flac, op10_importance_resampling)}

ORACLES = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_url_filter": r"""
        WITH seen AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                           WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                           WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                           WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM seen),
        judged AS (
            SELECT *, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END AS ruled
            FROM ruled),
        counted AS (
            SELECT host, count(ruled)::DOUBLE AS n, sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END)::DOUBLE AS bad, string_split(host, '.') AS labels,
                   CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'or.jp', 'ne.jp',
                        'co.kr', 'com.br', 'com.cn', 'com.tw', 'com.mx', 'com.ar', 'com.tr', 'co.in', 'co.za', 'co.il') THEN 2 ELSE 1 END AS width
            FROM judged WHERE host <> '' GROUP BY host),
        h AS (SELECT host, n, bad, array_to_string(labels[-width:], '.') AS suffix, array_to_string(labels[-(width + 1):], '.') AS domain FROM counted),
        d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
        moments AS (
            SELECT 'h' AS lv, sum(bad) / nullif(sum(n), 0) AS m, sum(bad * bad / nullif(n, 0)) / nullif(sum(n), 0) AS q, sum(n) AS t, (sum(bad) + 1) / (sum(n) + 2) AS m1 FROM h
            UNION ALL SELECT 'd' AS lv, sum(bad) / nullif(sum(n), 0) AS m, sum(bad * bad / nullif(n, 0)) / nullif(sum(n), 0) AS q, sum(n) AS t, (sum(bad) + 1) / (sum(n) + 2) AS m1 FROM d
            UNION ALL SELECT 's' AS lv, sum(bad) / nullif(sum(n), 0) AS m, sum(bad * bad / nullif(n, 0)) / nullif(sum(n), 0) AS q, sum(n) AS t, (sum(bad) + 1) / (sum(n) + 2) AS m1 FROM s),
        k AS (SELECT lv, m1, least(1000.0, greatest(2.0, least(t, CASE WHEN q - m * m > 1e-12 THEN m * (1 - m) / (q - m * m) - 1 ELSE 1000.0 END))) AS k FROM moments),
        ms AS (SELECT suffix, (bad + (SELECT k * m1 FROM k WHERE lv = 's')) / (n + (SELECT k FROM k WHERE lv = 's')) AS m FROM s),
        md AS (SELECT domain, (d.bad + (SELECT k FROM k WHERE lv = 'd') * ms.m) / (d.n + (SELECT k FROM k WHERE lv = 'd')) AS m FROM d JOIN ms USING (suffix)),
        mh AS (SELECT host, n + (SELECT k FROM k WHERE lv = 'h') AS w, (h.bad + (SELECT k FROM k WHERE lv = 'h') * md.m) / (h.n + (SELECT k FROM k WHERE lv = 'h')) AS m FROM h JOIN md USING (domain))
        SELECT page_id, judged.host AS host, path, rule,
               coalesce(ruled, CASE WHEN mh.m - 1.645 * sqrt(mh.m * (1 - mh.m) / (mh.w + 1)) > 0.5 THEN 'block' END, 'allow') AS verdict
        FROM judged LEFT JOIN mh USING (host)
    """,
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   coalesce(length(translate(text, '#$%&*|{}<>~^=+@_', ''))::DOUBLE / nullif(length(text), 0), 1.0) AS share FROM documents),
        keyed AS (
            SELECT doc_id, source, size,
                   -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
                       / greatest(0.05::DOUBLE, share * share * share * share) AS key FROM d),
        per AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM per),
        weighed AS (
            SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap,
                   (SELECT sum(source_size)::BIGINT * 150 / 100.0::DOUBLE FROM per) AS budget FROM ranked),
        lined AS (
            SELECT *, sum(weight) OVER () AS all_weight,
                   coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
                   coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS weight_before
            FROM weighed),
        filled AS (SELECT *, cap::DOUBLE / weight <= (budget - cap_before) / (all_weight - weight_before) AS is_full FROM lined),
        total AS (SELECT sum(CASE WHEN is_full THEN cap ELSE 0 END)::BIGINT AS caps, sum(CASE WHEN is_full THEN weight ELSE 0 END)::BIGINT AS full_weight FROM filled),
        t AS (
            SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (budget - caps) * weight / (all_weight - full_weight) END AS target
            FROM filled, total),
        run AS (
            SELECT keyed.*, t.source_size, t.target,
                   coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier,
                   CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
            FROM keyed JOIN t ON keyed.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * (epochs + CASE WHEN size > 0 AND 2 * earlier + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM run
    """,
}
