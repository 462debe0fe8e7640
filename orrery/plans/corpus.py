"""Dedup, cascade, quality and statistics over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import hashing, quality, text
from orrery.operators import dedup, stats
from orrery.plans.base import query, t

BODY = "md5(lower(text))"
RANKED = f"""
pair_ranked as (
  select *, row_number() over (partition by md5(text) order by {BODY}, doc_id) as pair_rn from documents
), body_ranked as (
  select *, row_number() over (partition by {BODY} order by md5(text), doc_id) as body_rn from pair_ranked where pair_rn = 1
)"""


def _body():
    return F.md5(F.lower("text"))


@query(f"with {RANKED} select doc_id, source from body_ranked where body_rn <= 2")
def pair_dedup_body_cap(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("pair"), _body().alias("body"))
    return dedup.pair_dedup(docs, F.col("pair"), F.col("body"), "doc_id").select("doc_id", "source")


@query(f"""with {RANKED} select (select count(*) from documents) as total_pairs,
  (select count(*) from pair_ranked where pair_rn = 1) as rows_after_pair_dedup, (select count(*) from body_ranked where body_rn <= 2) as rows_exported,
  (select count(*) from pair_ranked where pair_rn > 1) as pair_duplicate_rows_dropped, (select count(*) from body_ranked where body_rn > 2) as body_cap_rows_dropped""")
def export_selection_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("pair"), _body().alias("body"))
    return dedup.selection_stats(docs, F.col("pair"), F.col("body"), "doc_id")


@query(f"""with p as (select text, count(*) n from documents group by 1), b as (select {BODY} k, count(*) n from documents group by 1)
select (select cast(sum(n) as bigint) from p) as total_pairs, (select count(*) from p) as unique_pairs, (select count(*) from b) as unique_bodies,
  (select count(*) from b where n > 2) as bodies_over_cap, (select cast(coalesce(sum(n - 2), 0) as bigint) from b where n > 2) as rows_over_cap,
  (select cast(sum(n) as bigint) - count(*) from p) as duplicate_pair_rows, (select cast(sum(n) as bigint) - count(*) from b) as duplicate_body_rows""")
def duplicate_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_stats(t(spark, d, "documents"), F.col("text"), _body())


@query(f"""with top as (select {BODY} as key, count(*) as n from documents group by 1 having count(*) > 1 order by n desc, key limit 5),
r as (select top.key, top.n, doc_id, row_number() over (partition by top.key order by doc_id) rn from documents join top on {BODY} = top.key)
select key, n, string_agg(cast(doc_id as varchar), ',' order by doc_id) as sample_ids from r where rn <= 5 group by 1, 2""")
def top_duplicate_bodies(spark: SparkSession, d: str) -> DataFrame:
    return dedup.top_duplicates(t(spark, d, "documents").select("doc_id", "text"), _body(), "doc_id")


@query("""with a as (select *, row_number() over (partition by text order by doc_id) rn from documents),
b as (select *, row_number() over (partition by concat(source, ':', n_chars) order by doc_id) rn2 from a where rn = 1)
select doc_id, concat(source, ':', n_chars) as address from b where rn2 = 1""")
def ingest_first_wins(spark: SparkSession, d: str) -> DataFrame:
    address = F.concat("source", F.lit(":"), F.col("n_chars").cast("string"))
    return dedup.ingest_first_wins(t(spark, d, "documents"), F.col("text"), address, "doc_id").select("doc_id", address.alias("address"))


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def unseen_documents(spark: SparkSession, d: str) -> DataFrame:
    return dedup.unseen(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), ["doc_id"])


CASCADE = """
e as (select *, case when contains(text, 'idiot') then 'partial_placeholder' when regexp_matches(text, '(?i)error') then 'tac_error_marker'
  when length(text) < 50 then 'min_length' when length(text) > 20000 then 'max_length' end as early from documents),
r as (select *, case when early is null then row_number() over (partition by lang, substr(text, 1, 300), early is null order by doc_id) end as rn from e),
c as (select doc_id, coalesce(early, case when rn > 1 then 'duplicate_signature_body' end, case when text ilike '%test%' then 'test_name'
  when not contains(text, ' the ') and length(text) - length(replace(text, '.', '')) < 5 then 'overly_simple' end) as rule from r)"""


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "lang", "text")
    n = F.length("text")
    before = [
        ("partial_placeholder", F.col("text").contains("idiot")), ("tac_error_marker", F.col("text").rlike("(?i)error")), ("min_length", n < 50), ("max_length", n > 20000),
    ]
    simple = ~F.col("text").contains(" the ") & (text.occurrences("text", ".") < 5)
    after = [("test_name", F.col("text").ilike("%test%")), ("overly_simple", simple)]
    return dedup.cascade(docs, before, ("duplicate_signature_body", [F.col("lang"), F.substring("text", 1, 300)]), after, "doc_id")


@query(f"with {CASCADE} select doc_id from c where rule is null")
def filter_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).where("rule is null").select("doc_id")


@query(f"with {CASCADE} select rule, count(*) as rows_dropped from c where rule is not null group by 1")
def filter_drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.drop_counts(_cascade(spark, d))


@query(f"select {BODY} as key, count(*) as n, count(*) - 2 as over_cap_by from documents group by 1 having count(*) > 2")
def body_cap_violations(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cap_violations(t(spark, d, "documents"), _body())


@query("""with h as (select *, md5(text) k from documents), f as (select *, min(case when length(text) >= 200 then doc_id end) over (partition by k) as first_ok from h)
select doc_id, coalesce(doc_id > first_ok, false) as is_duplicate from f""")
def final_row_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("key"), (F.length("text") >= 200).alias("ok"))
    return dedup.first_accepted_duplicates(docs, F.col("key"), F.col("ok"), "doc_id").select("doc_id", "is_duplicate")


EST = "greatest(len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')), (length({0}) + 3) // 4)"


@query(f"""with e as (select doc_id, cast({EST.format('text')} as bigint) c, cast({EST.format('text')} as bigint) g from documents)
select doc_id, c as context_tokens, g as target_tokens, c + g as total_tokens,
  concat_ws(',', case when g >= 512 then 'target_overlength' end, case when c + g > 512 then 'context_overlength' end) as reasons from e""")
def length_report(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", quality.length_report("text", "text", 512).alias("r"))
    return docs.select("doc_id", "r.context_tokens", "r.target_tokens", "r.total_tokens", F.array_join("r.reasons", ",").alias("reasons"))


@query("""with n as (select len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) n from documents)
select case when n <= 256 then '<=256' when n <= 512 then '257-512' when n <= 1024 then '513-1024' when n <= 2048 then '1025-2048' when n <= 4096 then '2049-4096' else '>4096' end as bucket,
  count(*) as rows from n group by 1""")
def length_bucket_distribution(spark: SparkSession, d: str) -> DataFrame:
    bucket = text.length_bucket(text.word_count("text"))
    return t(spark, d, "documents").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


@query("""with r as (select unnest(list_filter([case when regexp_matches(text, '^\\s*$') then 'tac_empty' end, case when regexp_matches(text, '(?i)\\bpathetic\\b') then 'mark_a' end,
  case when regexp_matches(text, '(?i)\\bpassword[_\\s=-]') then 'mark_b' end, case when not regexp_matches(text, '\\bthe\\b') then 'no_entry' end], lambda x: x is not null)) reason from documents)
select reason, count(*) as rows from r group by 1""")
def reject_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    why = quality.reasons((text.collapse_whitespace(c) == "", "tac_empty"), (c.rlike(r"(?i)\bpathetic\b"), "mark_a"), (c.rlike(r"(?i)\bpassword[_\s=-]"), "mark_b"), (~c.rlike(r"\bthe\b"), "no_entry"))
    return t(spark, d, "documents").select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("""select event_type, count(*) as rows, count(try_cast(json_extract_string(props, '$.k') as bigint)) as with_k,
  cast(sum(case when json_valid(props) then 0 else 1 end) as bigint) as invalid_json, max(try_cast(json_extract_string(props, '$.k') as bigint)) as max_k from events group by 1""")
def json_preflight(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    bad = F.expr("case when try_parse_json(props) is null then 1 else 0 end")
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count(k).alias("with_k"), F.sum(bad).alias("invalid_json"), F.max(k).alias("max_k"))


@query("select doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as body_hash, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as source_hash from documents")
def normalized_hashes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", hashing.body_hash("text").alias("body_hash"), hashing.source_hash("text").alias("source_hash"))


@query("""select doc_id, cast(length(text) as bigint) as chars, cast(len(string_split(text, chr(10))) - (case when text = '' or text like '%' || chr(10) then 1 else 0 end) as bigint) as lines,
  cast(length(text) - length(replace(text, '.', '')) as bigint) as stops from documents""")
def row_instrumentation(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), text.line_count("text").alias("lines"), text.occurrences("text", ".").alias("stops"))


@query("select coalesce(lang, 'unknown') as value, count(*) as n from documents group by 1")
def group_counts_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return stats.group_counts(t(spark, d, "documents"), "lang")


@query("select count(*) as rows, round(avg(length(text)), 6) as avg_length, cast(min(length(text)) as integer) as min_length, cast(max(length(text)) as integer) as max_length from documents")
def length_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_statistics(t(spark, d, "documents"), "text").withColumn("avg_length", F.round("avg_length", 6))


@query("""with top as (select concat_ws('|', event_type, user_id) as key, count(*) n from events group by 1 having count(*) > 1 order by n desc, key limit 10),
r as (select top.key, n, event_id, row_number() over (partition by top.key order by event_id) rn from events join top on concat_ws('|', event_type, user_id) = top.key)
select key, n, string_agg(cast(event_id as varchar), ',' order by event_id) as sample_ids from r where rn <= 5 group by 1, 2""")
def top_error_groups(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_groups(t(spark, d, "events"), [F.col("event_type"), F.col("user_id")], "event_id")


SUMMARY = """round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(quantile_cont(v, 0.5), 6) as median, round(min(v), 6) as min, round(max(v), 6) as max, count(v) as count,
  round(avg(v) - 1.959963984540054 * coalesce(stddev_samp(v), 0) / sqrt(count(v)), 6) as ci_low, round(avg(v) + 1.959963984540054 * coalesce(stddev_samp(v), 0) / sqrt(count(v)), 6) as ci_high"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in df.dtypes])


@query(f"with l as (select o_orderpriority, 'o_totalprice' as metric, cast(o_totalprice as double) v from orders) select o_orderpriority, metric, {SUMMARY} from l group by 1, 2")
def metric_summary_ci(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.metric_summary(t(spark, d, "orders"), ["o_totalprice"], ["o_orderpriority"]))


@query("select l_returnflag, " + ", ".join(f"round(quantile_cont(cast(l_extendedprice as double), {p}), 6) as p{round(100 * p)}" for p in (0.5, 0.9, 0.95, 0.99)) + " from lineitem group by 1")
def percentiles_linear(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.percentiles_linear(t(spark, d, "lineitem"), "l_extendedprice", by=["l_returnflag"]))


@query("select l_returnflag, " + ", ".join(f"round(quantile_disc(cast(l_extendedprice as double), {p}), 6) as p{round(100 * p)}" for p in (0.5, 0.95, 0.99)) + " from lineitem group by 1")
def percentiles_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.percentiles_nearest(t(spark, d, "lineitem"), "l_extendedprice", by=["l_returnflag"]))


@query("""with p as (select quantile_disc(cast(n_chars as double), 0.99) p from documents)
select round(p, 6) as p99, cast(least(greatest(pow(2, ceil(log2(greatest(p, 1)))), 128), 8192) as bigint) as sequence_length from p""")
def sequence_length(spark: SparkSession, d: str) -> DataFrame:
    return stats.sequence_length(t(spark, d, "documents"), "n_chars")


@query(f"""with j as (select d.doc_id, lang, source, cast(n_chars as double) n_chars, cast(toxic as double) toxic from documents d join labels l on d.doc_id = l.doc_id),
s as (select 'lang' as field, lang as segment, n_chars, toxic from j union all select 'source', source, n_chars, toxic from j),
u as (select field, segment, 'n_chars' as metric, n_chars v from s union all select field, segment, 'toxic', toxic from s)
select field, segment, metric, {SUMMARY} from u group by 1, 2, 3""")
def segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").drop("text").join(t(spark, d, "labels"), "doc_id")
    fields = {"lang": stats.as_values(F.col("lang")), "source": stats.as_values(F.col("source"))}
    return _rounded(stats.segment_metrics(docs, fields, ["n_chars", "toxic"], "doc_id"))


SPLIT_SQL = "case when doc_id % 20 < 17 then 'train' when doc_id % 20 < 19 then 'val' else 'test' end"
COVER_SQL = f"""c as (with s as (select {SPLIT_SQL} split, lang, source from documents), u as (select split, 'lang' field, lang as value from s union all select split, 'source', source from s)
select field, value, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test,
  count(*) filter (split in ('val', 'test')) as holdout, count(*) as total from u group by 1, 2)"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    m = F.col("doc_id") % 20
    split = F.when(m < 17, "train").when(m < 19, "val").otherwise("test")
    return stats.coverage(docs, split, {"lang": stats.as_values(F.col("lang")), "source": stats.as_values(F.col("source"))})


@query(f"with {COVER_SQL} select * from c")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)


@query(f"""with {COVER_SQL} select field, value, total, 'val' as split, val as n from c where total >= 15 and val < 5
union all select field, value, total, 'test', test from c where total >= 15 and test < 5""")
def coverage_violations(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage_violations(_coverage(spark, d), 5)


@query("""select source as suite, count(*) as rows, round(avg(n_chars), 6) as mean_chars, round(avg(case when n_chars > 2000 then 1.0 else 0 end), 6) as pct_above_2000,
  round(avg(case when n_chars < 500 then 1.0 else 0 end), 6) as pct_below_500 from documents group by 1""")
def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    suites = t(spark, d, "documents").groupBy(F.coalesce("source", F.lit("broad_holdout")).alias("suite"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return suites.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), share(F.col("n_chars") > 2000).alias("pct_above_2000"), share(F.col("n_chars") < 500).alias("pct_below_500"))


@query("""select lang as strategy, count(*) as rows, round(avg(case when n_chars > 4000 then 1.0 else 0.0 end), 6) as truncation_rate, """
       + ", ".join(f"round(quantile_cont(cast(n_chars as double), {p}), 6) as n_chars_p{round(100 * p)}" for p in (0.5, 0.9, 0.95, 0.99)) + " from documents group by 1")
def prompt_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.prompt_diagnostics(t(spark, d, "documents"), F.col("n_chars") > 4000, F.col("lang"), ["n_chars"]))
