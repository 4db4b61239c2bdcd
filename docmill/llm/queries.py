"""The registered queries of the training-data operators, over whole tables, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lmscore, media, mixing, neardup, packing, search, secrets, sharding, topk, toxicity, urlfilter, whitening

#: Pages whose titles hold these marks of junk give the listed URLs of op10: their contents decide, not their URLs.
LISTED_TITLES = r"<title>[^<]*(%%%|###|[*]{3})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), mixed=False)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), forest)
    return found.select("doc_id", F.explode("findings").alias("x")).select("doc_id", "x.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.length(F.coalesce("text", F.lit(""))) + 1).alias("size"))
    return mixing.mix(docs, size=F.col("size")).select("doc_id", "source", "size", "block", "place", "release", "deadline", "slot", "round")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(_table(spark, sf_dir, "documents"))


def pages_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_pages(_table(spark, sf_dir, "pages"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(_table(spark, sf_dir, "embeddings"))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    listed = pages.where(F.rlike("html", F.lit(LISTED_TITLES))).select("url")
    return urlfilter.judge(pages.select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_minhash_near_dedup, op3_toxicity, op4_secret_scan, op5_source_mixing, op6_media_columns, op7_exact_top_k, op8_rendezvous_sharding, op9_lm_scores, op10_url_filter, op11_embedding_whitening, op12_lexical_search, op13_decontamination, pages_media_sequences)
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
        select query_id, cast(rank as int) as rank, vec_id, score from (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
    """,
    "op9_lm_scores": """
        with t as (
            select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
        g as (select r, words[i] as w, case when i > 1 then words[i - 1] end as v from (select r, words, unnest(range(1, len(words) + 1)) as i from t)),
        one as (select w, count(*) as n from g group by w),
        context as (select v, count(*) as n from g where v is not null group by v),
        two as (select v, w, count(*) as n from g where v is not null group by v, w),
        s as (
            select r, case
                when g.v is null then ln(one.n) - ln((select count(*) from g))
                when two.n >= 2 then ln(two.n) - ln(context.n)
                else ln(one.n) - ln((select count(*) from g)) + ln(0.4) end as x
            from g join one on g.w = one.w left join two on g.v = two.v and g.w = two.w left join context on g.v = context.v),
        d as (select r, count(*) as n, cast(sum(cast(round(x * 16777216) as bigint)) as double) / 16777216 as x from s group by r)
        select t.doc_id, coalesce(d.n, 0) as n_words, coalesce(d.x, 0.0) as log_score, d.x / d.n as score from t left join d on t.r = d.r
    """,
    "op10_url_filter": """
        with u as (
            select page_id, html, case when url like '%://%' then substr(url, instr(url, '://') + 3) end as rest from pages),
        h as (
            select page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
        k as (
            select *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || case when path = '' then '/' else path end as key from h),
        r as (
            select *, case
                when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
                when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
                when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
                when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
                when (host = 'org' or host like '%.org') and path like '/%' then 'org/' end as rule from k)
        select page_id, host, path, rule, case rule
            when 'org/' then 'allow' when 'example.org/es/' then 'block' when 'example.org/en/1' then 'block' when 'com/fr/' then 'allow' when 'com/de/' then 'block'
            else case when key in (select key from k where regexp_matches(html, '<title>[^<]*(%%%|###|[*]{3})')) then 'block' else 'allow' end end as verdict
        from r
    """,
    "op12_lexical_search": """
        with d as (
            select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as words from documents),
        totals as (select count(*) as docs, cast(sum(len(words)) as bigint) as words from d where len(words) > 0),
        tf as (select r, term, count(*) as tf from (select r, unnest(words) as term from d) group by r, term),
        df as (select term, count(*) as df from tf group by term),
        w as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from df, totals),
        m as (select r, doc_id, 10 + (90 * len(d.words) * totals.docs) // totals.words as m from d, totals),
        i as (
            select distinct item_id, i, term from (
                select item_id, i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) as term
                from (select row_number() over () as i, item_id, text from benchmark))),
        s as (
            select item_id, i, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
            from i join tf using (term) join w using (term) join m using (r) group by item_id, i, doc_id, r)
        select item_id, cast(rank as int) as rank, doc_id, score from (
            select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from s where score > 0) where rank <= 10
    """,
    "op13_decontamination": """
        with d as (
            select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as words from documents),
        b as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as words from benchmark),
        windows as (
            select distinct item_id, n, array_to_string(words[p : p + n - 1], ' ') as words from (
                select item_id, words, least(10, len(words)) as n, unnest(range(1, len(words) - least(10, len(words)) + 2)) as p from b where len(words) > 0)),
        sizes as (select distinct n from windows),
        grams as (
            select r, n, p, array_to_string(words[p : p + n - 1], ' ') as words from (
                select r, words, n, unnest(range(1, len(words) - n + 2)) as p from d, sizes where len(words) >= n)),
        found as (select r, p, n, item_id from grams join windows using (n, words)),
        hit as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from found) group by r),
        named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from found where item_id is not null) group by r)
        select doc_id, cast(len(d.words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (r) left join named using (r)
    """,
}
