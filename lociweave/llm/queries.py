"""One query for each operator of this package, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, fingerprints, html_extract, ngram_join, packing, quality, token_counts, url_filter, warc

RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"), n=4, percent=85).withColumnRenamed("id", "doc_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


def redirect_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator where aliases decide: a redirect from each page whose id
    is no multiple of seven to the page before it makes chains of seven."""
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id", "concat('http://Host', page_id % 50, case page_id % 5 when 0 then '.org' when 1 then '.com' else '.net' end, '/', substring('defren', cast(1 + 2 * (page_id % 3) as int), 2), '/', page_id) as url", "html")
    before = pages.select((F.col("page_id") + 1).alias("p"), F.col("url").alias("dst"))
    redirects = pages.join(before, F.col("page_id") == F.col("p")).where("page_id % 7 <> 0").select(F.lower("url").alias("src"), F.regexp_replace("dst", "/([0-9]+)$", "/x/../$1#f").alias("dst"))
    return url_filter.judge(pages, RULES, redirects).withColumnRenamed("id", "page_id")


def op4_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), digests=True).withColumnRenamed("id", "doc_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache that no run before has filled, so that the query always does its whole work.
    cache = token_counts.CountCache.fresh(spark)
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), cache).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_html_extraction, op3_url_filters, op4_bpe_coding, op5_fingerprints, op6_packing, op7_exact_dedup, op8_quality_classifier, op9_warc, op10_token_counts, redirect_closure, pipeline)}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (
            select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] for i in range(1, len(ws) - 2)] end) as shingle from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (shingle) where a.doc_id < b.doc_id group by x, y),
        link as (select x, y from shared join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
        both_ways as (select x, y from link union all select y, x from link),
        reach as (select doc_id as x, doc_id as y from documents union select r.x, b.y from reach r join both_ways b on r.y = b.x)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id
        from documents d left join n on n.doc_id = d.doc_id join (select x, min(y) as component_id from reach group by x) r on r.x = d.doc_id
        """,
    "op3_url_filters": """
        with split as (
            select page_id,
                translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
            from pages),
        rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit as (
            select page_id, r.h || r.p as rule, r.verdict,
                row_number() over (partition by page_id order by length(r.h || r.p) desc) as n
            from split s join rules r on (s.host = r.h or s.host like '%.' || r.h) and starts_with(s.path, r.p))
        select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
        from split s left join fit f on s.page_id = f.page_id and f.n = 1
        """,
    "redirect_closure": """
        with recursive p as (
            select page_id, 'host' || (page_id % 50) || case page_id % 5 when 0 then '.org' when 1 then '.com' else '.net' end as host, '/' || ['de', 'fr', 'en'][1 + page_id % 3] || '/' || page_id as path from pages),
        rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit as (
            select page_id, r.h || r.p as rule, r.verdict, row_number() over (partition by page_id order by length(r.h || r.p) desc) as n
            from p s join rules r on (s.host = r.h or s.host like '%.' || r.h) and starts_with(s.path, r.p)),
        own as (select p.*, f.rule, f.verdict from p left join fit f on p.page_id = f.page_id and f.n = 1),
        edge as (select a.page_id as x, b.page_id as y from p a join p b on b.page_id = a.page_id - 1 where a.page_id % 7 <> 0),
        both_ways as (select x, y from edge union all select y, x from edge),
        reach as (select page_id as x, page_id as y from p union select r.x, b.y from reach r join both_ways b on r.y = b.x),
        told as (select x, min(verdict) as verdict from reach join own on y = page_id group by x)
        select own.page_id, host, path, rule, coalesce(own.verdict, told.verdict, 'allow') as verdict from own left join told on own.page_id = told.x
        """,
    "op7_exact_dedup": """
        with t as (select doc_id, coalesce(text, '') as text from documents),
        g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
        from t join g using (text)
        """,
}
