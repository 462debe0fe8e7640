"""Leakage, splits, lookups, upserts and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import compare, dedup, leakage, lookup, stats
from orrery.plans.base import query, t

KEYS_SQL = """k as (select distinct doc_id, category, key from (
  select doc_id, 'output_hash' as category, md5(text) as key from documents union all
  select doc_id, 'body_hash', md5(lower(text)) from documents union all
  select doc_id, 'prefix_300', md5(substr(text, 1, 300)) from documents))"""


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leakage_keys(
        t(spark, d, "documents").select("doc_id", "text"), "doc_id",
        {"output_hash": F.md5("text"), "body_hash": F.md5(F.lower("text")), "prefix_300": F.md5(F.substring("text", 1, 300))},
    )


@query(f"with {KEYS_SQL} select * from k")
def leakage_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d)


@query("select doc_id, case when source <> '' then concat('source:', source) else concat('row:', md5(text)) end as group_key from documents")
def group_keys(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", leakage.group_key({"source": F.col("source"), "row": F.md5("text")}).alias("group_key"))


COMPONENTS_SQL = f"""with recursive {KEYS_SQL}, m as (select category, key, min(doc_id) as low from k group by 1, 2),
e as (select distinct k.doc_id as a, m.low as b from k join m using (category, key)), u as (select a, b from e union select b, a from e),
r(doc_id, reached) as (select a, a from u union select r.doc_id, u.b from r join u on r.reached = u.a),
c as (select doc_id, min(reached) as component from r group by 1)"""


def _components(spark: SparkSession, d: str) -> DataFrame:
    return leakage.components(_keys(spark, d), "doc_id", spark)


@query(f"{COMPONENTS_SQL} select * from c")
def leakage_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)


@query(f"{COMPONENTS_SQL}, s as (select component, count(*) as rows from c group by 1) select rows, count(*) as components from s group by 1")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("rows")).groupBy("rows").agg(F.count(F.lit(1)).alias("components"))


SPLIT_SQL = "case when doc_id % 20 < 17 then 'train' when doc_id % 20 < 19 then 'val' else 'test' end"


def _split(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 20
    return t(spark, d, "documents").select("doc_id", F.when(m < 17, "train").when(m < 19, "val").otherwise("test").alias("split"))


@query(f"""with {KEYS_SQL}, s as (select doc_id, {SPLIT_SQL} as split from documents)
select category, key, count(distinct split) as splits, count(*) as rows from k join s using (doc_id) group by 1, 2 having count(distinct split) > 1""")
def split_leakage_check(spark: SparkSession, d: str) -> DataFrame:
    return leakage.split_leaks(_keys(spark, d), "doc_id", _split(spark, d))


@query(f"""with s as (select {SPLIT_SQL} as split, count(*) as actual from documents group by 1), n as (select count(*) as total from documents),
b as (select md5(lower(text)) k, count(*) as rows from documents group by 1),
r as (select split, actual, case split when 'train' then 0.85 when 'val' then 0.1 else 0.05 end * total as target, total from s, n)
select split, actual, round(cast(target as double), 6) as target, round(cast(actual / target as double), 6) as actual_to_target_ratio,
  total >= 100 and target >= 10 and actual / target < 0.5 as below_target, (select max(rows) from b) as largest_component_rows,
  total >= 100 and (select max(rows) from b) > total * 0.85 as oversized_component from r""")
def split_quality(spark: SparkSession, d: str) -> DataFrame:
    sizes = t(spark, d, "documents").groupBy(F.md5(F.lower("text")).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    out = leakage.split_quality(_split(spark, d), sizes, {"train": 0.85, "val": 0.10, "test": 0.05})
    return out.withColumn("target", F.round("target", 6)).withColumn("actual_to_target_ratio", F.round("actual_to_target_ratio", 6))


@query()
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    strata = docs.select("doc_id", F.lit("lang").alias("field"), F.col("lang").alias("value"))
    parts = _components(spark, d)
    return parts.join(leakage.stratified_split(parts, strata, "doc_id"), "component").select("doc_id", "component", "split")


@query("""with b as (select md5(lower(text)) as key, min(doc_id) as body_id from documents join labels using (doc_id) where quality = 1 group by 1)
select d.doc_id, b.body_id from documents d left join b on b.key = md5(lower(d.text))""")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.md5(F.lower("text")).alias("key"))
    bodies = docs.join(t(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("body_id"))
    found = lookup.exact_lookup(docs, bodies, "key")
    return found.select("doc_id", "body_id")


@query("""with b as (select md5(lower(text)) k, count(*) as occurrences from documents group by 1)
select count(*) as bodies, cast(sum(occurrences) as bigint) as occurrences, round(avg(occurrences), 1) as mean_occurrences from b""")
def lookup_stats(spark: SparkSession, d: str) -> DataFrame:
    b = t(spark, d, "documents").groupBy(F.md5(F.lower("text")).alias("k")).agg(F.count(F.lit(1)).alias("occurrences"))
    return b.agg(F.count(F.lit(1)).alias("bodies"), F.sum("occurrences").alias("occurrences"), F.round(F.avg("occurrences"), 1).alias("mean_occurrences"))


@query("""with a as (select md5(lower(text)) as key, doc_id as pos, source as name, md5(text) as body, doc_id in (select doc_id from labels) as fresh from documents)
select key, count(*) as occurrences, arg_min(body, (fresh, pos)) as body, (select name from a b where b.key = a.key order by length(name) desc, fresh, pos limit 1) as name from a group by 1""")
def lookup_build(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").select(F.md5(F.lower("text")).alias("key"), F.lit(1).cast("long").alias("occurrences"), F.md5("text").alias("body"), F.col("source").alias("name"), F.col("doc_id").alias("pos"))
    labelled = t(spark, d, "labels").select(F.col("doc_id").alias("pos")).distinct()
    return lookup.upsert_counts(rows.join(labelled, "pos", "left_anti"), rows.join(labelled, "pos", "left_semi"), ["key"], "occurrences", "body", "name")


TIERS_SQL = """r as (select l_partkey as p_partkey, cast(l_suppkey as varchar) as name, count(*) as n from lineitem where l_returnflag = 'R' and l_quantity >= 49 group by 1, 2),
b as (select p_partkey, p_name as name, cast(1000 as bigint) as n from part where p_size < 15),
a as (select 0 as tier, 'builtin' as tname, * from b union all select 1, 'registry', * from r)"""


@query(f"""with {TIERS_SQL}, f as (select p_partkey, min(tier) as tier from a group by 1),
x as (select a.*, count(*) over (partition by a.p_partkey) as candidates, row_number() over (partition by a.p_partkey order by n desc, name) rn from a join f on a.p_partkey = f.p_partkey and a.tier = f.tier)
select p.p_partkey, coalesce(x.tname, 'unknown') as tier, x.name, coalesce(x.candidates, 0) as candidates from part p left join x on x.p_partkey = p.p_partkey and rn = 1""")
def tiered_resolution(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    builtin = part.where("p_size < 15").select("p_partkey", F.col("p_name").alias("name"), F.lit(1000).cast("long").alias("n"))
    seen = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return lookup.tiered(part.select("p_partkey"), [("builtin", builtin), ("registry", seen)], "p_partkey", "name", "n")


@query("""with a as (select l_partkey, l_suppkey, count(*) as n from lineitem where l_shipdate < timestamp '1996-01-01' group by 1, 2),
b as (select l_partkey, l_suppkey, count(*) as n from lineitem where l_shipdate >= timestamp '1996-01-01' group by 1, 2), u as (select * from a union all select * from b),
m as (select l_partkey, l_suppkey, max(n) as occurrences from u group by 1, 2)
select *, cast(case when occurrences >= 10 then 0.95 when occurrences >= 5 then 0.9 when occurrences >= 2 then 0.85 else 0.8 end as double) as confidence from m""")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows, keys = t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"]
    n = lambda c: rows.where(c).groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    both = lookup.registry_import(n("l_shipdate < timestamp '1996-01-01'"), n("l_shipdate >= timestamp '1996-01-01'"), keys, "occurrences")
    return both.withColumn("confidence", text.confidence("occurrences"))


@query("""with j as (select s_suppkey, v.version, f.flag from supplier, (values (4), (5), (8)) v(version), (values (true), (false)) f(flag)),
done as (select distinct l_suppkey from lineitem where l_quantity >= 49) select s_suppkey, version, flag from j where not (flag and s_suppkey in (select l_suppkey from done))""")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    jobs = lookup.jobs(t(spark, d, "supplier").select("s_suppkey"), [4, 5, 8])
    done = t(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"), F.lit(True).alias("flag"))
    return lookup.unmatched(jobs, done, ["s_suppkey", "flag"]).select("s_suppkey", "version", "flag")


@query("""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) rn from orders)
select c_custkey, c_name, o_orderkey from customer join o on c_custkey = o_custkey and rn = 1""")
def last_wins_match(spark: SparkSession, d: str) -> DataFrame:
    left = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    right = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    found = lookup.match_last(left, right, "k", "c_name", "o_orderkey")
    return found.select(F.col("k").alias("c_custkey"), "c_name", "o_orderkey")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def unmatched_partials(spark: SparkSession, d: str) -> DataFrame:
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.unmatched(t(spark, d, "customer").select("c_custkey", "c_name"), urgent, ["c_custkey"])


@query("""select user_id, case when count(*) filter (event_type = 'purchase') > 0 then 'processed' else coalesce(arg_min(event_type, event_id) filter (event_type = 'error'), 'no_pairs') end as status,
  case when count(*) filter (event_type = 'purchase') = 0 then arg_min(props, event_id) filter (event_type = 'error') end as error, count(*) as attempts from events group by 1""")
def outcome_status(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return lookup.outcomes(e, "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error", "event_type", "props")


HALVES_SQL = """a as (select l_orderkey * 10 + l_linenumber as k, l_quantity as quantity, l_discount as discount from lineitem where l_shipdate < timestamp '1996-06-01'),
b as (select l_orderkey * 10 + l_linenumber as k, l_quantity * 1.0 + (l_partkey % 3) - 1 as quantity, l_discount as discount from lineitem where l_shipdate < timestamp '1997-06-01'),
p as (select a.k, 'quantity' as metric, b.quantity - a.quantity as delta from a join b using (k) union all select a.k, 'discount', b.discount - a.discount from a join b using (k))"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = t(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    a = rows.where("l_shipdate < timestamp '1996-06-01'").select("k", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    b = rows.where("l_shipdate < timestamp '1997-06-01'").select("k", (F.col("l_quantity") + F.col("l_partkey") % 3 - 1).alias("quantity"), F.col("l_discount").alias("discount"))
    return a, b


@query(f"""with {HALVES_SQL} select metric, count(*) as paired_count, round(avg(delta), 6) as mean_delta, count(*) filter (delta > 0) as improved_count,
  count(*) filter (delta < 0) as regressed_count, count(*) filter (delta = 0) as unchanged_count from p group by 1""")
def paired_run_comparison(spark: SparkSession, d: str) -> DataFrame:
    return compare.paired_comparison(*_halves(spark, d), "k", ["quantity", "discount"]).withColumn("mean_delta", F.round("mean_delta", 6))


@query(f"with {HALVES_SQL} select k, round(delta, 6) as delta from p where metric = 'quantity' order by delta, k limit 10")
def worst_run_deltas(spark: SparkSession, d: str) -> DataFrame:
    deltas = compare.paired_deltas(*_halves(spark, d), "k", ["quantity", "discount"])
    return compare.worst_deltas(deltas, "quantity", "k").select("k", F.round("delta", 6).alias("delta"))


@query("""with a as (select l_returnflag as bucket, count(*) n from lineitem where l_shipdate < timestamp '1995-06-17' group by 1), b as (select l_returnflag as bucket, count(*) n from lineitem where l_shipdate >= timestamp '1995-06-17' group by 1)
select coalesce(a.bucket, b.bucket) as bucket, coalesce(a.n, 0) as baseline, coalesce(b.n, 0) as candidate, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b on a.bucket = b.bucket""")
def bucket_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").withColumnRenamed("l_returnflag", "bucket")
    return compare.bucket_delta(rows.where("l_shipdate < timestamp '1995-06-17'"), rows.where("l_shipdate >= timestamp '1995-06-17'"), "bucket")


METRICS_SQL = """m as (select l_linestatus as run, avg(l_quantity) as quantity_mean, avg(l_discount) as discount_distance, avg(case when l_quantity > 25 then 1.0 else 0 end) as pct_above_25, stddev_pop(l_tax) as tax_std from lineitem group by 1),
u as (unpivot m on quantity_mean, discount_distance, pct_above_25, tax_std into name metric value v)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("run")).agg(
        F.avg("l_quantity").alias("quantity_mean"), F.avg("l_discount").alias("discount_distance"), F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("pct_above_25"), F.stddev_pop("l_tax").alias("tax_std")
    )
    return stats.unpivot(m, ["run"], ["quantity_mean", "discount_distance", "pct_above_25", "tax_std"])


COMPARED_SQL = f"""{METRICS_SQL}, x as (select a.metric, a.v as current, b.v as baseline, a.v - b.v as delta, case when a.metric like '%distance%' then 'lower' else 'higher' end as direction
  from u a join u b on a.metric = b.metric and a.run = 'O' and b.run = 'F' where a.metric not like '%\\_std' escape '\\')"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return compare.baseline_comparison(m.where("run = 'O'"), m.where("run = 'F'"), 1e-6)


@query(f"""with {COMPARED_SQL} select metric, round(current, 6) as current, round(baseline, 6) as baseline, round(delta, 6) as delta, direction, round(delta / abs(baseline), 6) as relative_delta,
  case when (case direction when 'lower' then -delta else delta end) < -1e-6 then 'regressed' when (case direction when 'lower' then -delta else delta end) > 1e-6 then 'improved' else 'unchanged' end as status from x""")
def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    out = _compared(spark, d)
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("current", "baseline", "delta", "relative_delta")], "direction", "status")


@query("""with r(metric, op, threshold, required) as (values ('semantic_similarity_mean', '>=', 0.82, true), ('pct_above_25', '>=', 0.45, true), ('discount_distance', '<=', 0.01, true), ('absent_optional', '>=', 1.0, false)),
m as (select avg(l_discount) as discount_distance, avg(case when l_quantity > 25 then 1.0 else 0 end) as pct_above_25 from lineitem), u as (unpivot m on discount_distance, pct_above_25 into name metric value v)
select r.metric, round(u.v, 6) as value, op, cast(threshold as double) as threshold, required, case when u.v is null and not required then 'skipped'
  when coalesce(case op when '>=' then u.v >= threshold else u.v <= threshold end, false) then 'passed' else 'failed' end as status from r left join u on r.metric = u.metric""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "lineitem").agg(F.avg("l_discount").alias("discount_distance"), F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("pct_above_25"))
    rules = spark.createDataFrame([("semantic_similarity_mean", ">=", 0.82, True), ("pct_above_25", ">=", 0.45, True), ("discount_distance", "<=", 0.01, True), ("absent_optional", ">=", 1.0, False)], "metric string, op string, threshold double, required boolean")
    return compare.quality_gate(stats.unpivot(m, [], ["discount_distance", "pct_above_25"]), rules).withColumn("value", F.round("value", 6))


@query("""with g as (select l_shipmode, n, reg, imp from (select l_returnflag as l_shipmode, count(*) as n, count(*) filter (l_discount > 0.09) as reg, count(*) filter (l_quantity > 49) as imp from lineitem group by 1)),
d as (select l_shipmode as run, case when n < 30 then 'smoke_only' when reg > 0 then 'reject' when imp > 0 then 'keep_candidate' else 'no_change' end as decision from g)
select case when bool_or(decision = 'reject') then 'reject' when bool_or(decision = 'smoke_only') then 'smoke_only' when bool_or(decision = 'keep_candidate') then 'keep_candidate' else 'no_change' end as decision from d""")
def gate_suite(spark: SparkSession, d: str) -> DataFrame:
    count = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
    runs = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), count("l_discount > 0.09").alias("reg"), count("l_quantity > 49").alias("imp"))
    return compare.suite_decision(runs.select(compare.run_decision(F.col("n"), F.col("reg"), F.col("imp")).alias("decision")))


@query("""with j as (select d.doc_id, n_chars, quality, toxic from documents d join labels l on d.doc_id = l.doc_id),
a as (select 'toxic' as reason, doc_id, row_number() over (order by doc_id) as rank from j where toxic = 1), b as (select 'shortest', doc_id, row_number() over (order by n_chars, doc_id) from j),
c as (select 'longest_low_quality', doc_id, row_number() over (order by -n_chars, doc_id) from j where quality = 0)
select * from a where rank <= 5 union all (select * from b order by 3 limit 5) union all (select * from c order by 3 limit 5)""")
def worst_samples(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id")
    n = F.col("n_chars")
    lists = {"toxic": (F.col("toxic") == 1, F.lit(0).cast("long")), "shortest": (F.lit(True), n), "longest_low_quality": (F.col("quality") == 0, -n)}
    return compare.worst_samples(j, "doc_id", lists).withColumn("rank", F.col("rank").cast("long"))


@query("""with j as (select d.doc_id, lang, n_chars, quality, toxic from documents d join labels l on d.doc_id = l.doc_id),
s as (select quality, unnest(list_distinct(list_filter([concat('lang:', lang), case when toxic = 1 then 'toxic' end, case when n_chars < 500 then 'short' end, case when quality = 0 then 'low' end], lambda x: x is not null))) as slice from j)
select slice, count(*) as n, round(avg(coalesce(cast(quality as double), 0)), 6) as mean_score from s group by 1""")
def failure_slices(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id")
    names = F.filter(F.array(F.concat(F.lit("lang:"), "lang"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 500, "short"), F.when(F.col("quality") == 0, "low")), lambda x: x.isNotNull())
    return compare.failure_slices(j, names, F.col("quality").cast("double"), "doc_id").withColumn("mean_score", F.round("mean_score", 6))


@query("""with j as (select lang, source, n_chars, quality from documents d join labels l on d.doc_id = l.doc_id), s as (select 'lang' as field, lang as "pivot", n_chars, quality from j union all select 'source', source, n_chars, quality from j),
m as (select field, "pivot", avg(n_chars) filter (quality = 1) as a, avg(n_chars) filter (quality = 0) as b from s group by 1, 2)
select field, "pivot", round(a, 6) as left_mean, round(b, 6) as right_mean, case when b is null or a > b then 'left' when a is null or b > a then 'right' else 'tie' end as winner from m""")
def pivot_winner(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(t(spark, d, "labels"), "doc_id")
    out = compare.pivot_winner(j.where("quality = 1"), j.where("quality = 0"), ["lang", "source"], "n_chars")
    return out.withColumn("left_mean", F.round("left_mean", 6)).withColumn("right_mean", F.round("right_mean", 6))


@query("""with e as (select lang, source, doc_id from documents) select lang, source from e where doc_id not in (select doc_id from labels) group by 1, 2""")
def excluded_identities(spark: SparkSession, d: str) -> DataFrame:
    rest = dedup.unseen(t(spark, d, "documents").select("doc_id", "lang", "source"), t(spark, d, "labels"), ["doc_id"])
    return rest.select("lang", "source").distinct()
