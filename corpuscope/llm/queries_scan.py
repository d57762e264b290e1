"""Queries of the scanning and filtering operators."""

from __future__ import annotations

from corpuscope.llm.license_scan import license_scan, license_sql
from corpuscope.llm.quality_rules import learn_from, quality_verdicts
from corpuscope.llm.queries import register
from corpuscope.llm.secret_scan import labelled_samples, secret_scan, train
from corpuscope.llm.url_filter import Rule, url_verdicts


@register("op2_license_scan", license_sql())
def op2_license_scan(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@register("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    """No SQL: tests hold it against a search with another regular-expression engine."""
    model = train(labelled_samples(spark))
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).drop("found")


#: The domain rules of the query.
URL_RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
             Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
#: Globs that block a URL which no domain rule decides.
URL_GLOBS = ["*ads-track*/*", "*cheap-pills*/*", "*adult*/*", "*casino*/*", "*ads-track*", "*cheap-pills*", "*adult*", "*casino*"]

OP9_SQL = r"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw_host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT rid, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
rules(verdict, r_host, r_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (SELECT h.*, r_host || r_path AS rule, verdict,
             row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC NULLS LAST) AS rn
      FROM h LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)),
g AS (SELECT *, CASE WHEN contains(host, 'ads-track') THEN '*ads-track*' WHEN contains(host, 'cheap-pills') THEN '*cheap-pills*'
        WHEN contains(host, 'adult') THEN '*adult*' WHEN contains(host, 'casino') THEN '*casino*' END
        || CASE WHEN path LIKE '/%' THEN '/*' ELSE '' END AS block_glob
      FROM j WHERE rn = 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN block_glob IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, block_glob
FROM g"""


@register("op9_url_filter", OP9_SQL)
def op9_url_filter(spark, sf_dir):
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, URL_GLOBS)


@register("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    """No SQL: tests hold the statistics against a plain version and the list against held-out labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_verdicts(docs, learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
