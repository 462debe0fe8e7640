"""Evaluation and record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import records, text
from orrery.operators import evaluation, stats
from orrery.plans.base import query, t


@query("""with e as (select list_distinct([event_type, case when value > 500 then 'large' else 'small' end]) as issues from events)
select i as issue, count(*) as rows from (select unnest(issues) i from e) group by 1""")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return evaluation.issue_counts(e, F.array("event_type", F.when(F.col("value") > 500, "large").otherwise("small")))


@query("""with e as (select user_id, event_id, case event_type when 'error' then 'high' when 'purchase' then 'medium' when 'click' then 'low' else 'info' end as severity from events),
r as (select *, row_number() over (partition by user_id order by case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end desc, event_id) rn from e) select user_id, event_id, severity from r where rn = 1""")
def strongest_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_type")
    e = t(spark, d, "events").select("user_id", "event_id", F.when(k == "error", "high").when(k == "purchase", "medium").when(k == "click", "low").otherwise("info").alias("severity"))
    return evaluation.strongest_issues(e, "user_id", "severity", "event_id")


RULES = [("quantity_mean", "<", 30.0, 20.0, "more per line"), ("discount_mean", ">", 0.04, 0.09, "fewer discounts"), ("tax_mean", ">", 0.9, 0.95, "never")]
DIAGNOSED_SQL = """m as (select avg(l_quantity) as quantity_mean, avg(l_discount) as discount_mean, avg(l_tax) as tax_mean from lineitem), u as (unpivot m on quantity_mean, discount_mean, tax_mean into name metric value v),
r(metric, op, medium, high, advice) as (values ('quantity_mean', '<', 30.0, 20.0, 'more per line'), ('discount_mean', '>', 0.04, 0.09, 'fewer discounts'), ('tax_mean', '>', 0.9, 0.95, 'never')),
i as (select u.metric, round(v, 6) as value, case when (op = '<' and v < high) or (op = '>' and v > high) then 'high' when (op = '<' and v < medium) or (op = '>' and v > medium) then 'medium' end as severity, advice from u join r using (metric))"""


def _diagnosed(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "lineitem").agg(F.avg("l_quantity").alias("quantity_mean"), F.avg("l_discount").alias("discount_mean"), F.avg("l_tax").alias("tax_mean"))
    rules = spark.createDataFrame(RULES, "metric string, op string, medium double, high double, advice string")
    return evaluation.diagnostics(stats.unpivot(m, [], ["quantity_mean", "discount_mean", "tax_mean"]), rules)


@query(f"with {DIAGNOSED_SQL} select * from i where severity is not null")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _diagnosed(spark, d).withColumn("value", F.round("value", 6))


@query(f"with {DIAGNOSED_SQL} select case when bool_or(severity = 'high') then 'needs_attention' when bool_or(severity = 'medium') then 'watch' else 'healthy' end as status from i where severity is not null")
def diagnostic_status(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overall_status(_diagnosed(spark, d))


@query("""with k(interface, selector) as (values ('A', 0), ('A', 1), ('A', 2), ('A', 3), ('A', 4), ('B', 5), ('B', 6)), s as (select distinct l_suppkey, l_partkey % 50 as selector from lineitem where l_partkey % 50 < 7),
h as (select l_suppkey, interface, count(*) as matched from s join k using (selector) group by 1, 2), n as (select interface, count(*) as total from k group by 1)
select l_suppkey, interface, matched, round(cast(matched / total as double), 3) as coverage from h join n using (interface) where matched >= least(4, total)""")
def interface_detection(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("A", i) for i in range(5)] + [("B", 5), ("B", 6)], "interface string, selector long")
    s = t(spark, d, "lineitem").where("l_partkey % 50 < 7").select("l_suppkey", (F.col("l_partkey") % 50).alias("selector"))
    return evaluation.interfaces(s, "l_suppkey", known)


@query("""with v as (select n_regionkey, n_name, n_nationkey, n_nationkey % 4 = 0 as constant from nation) select n_regionkey, n_name, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as slot from v where not constant""")
def storage_slots(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "nation").withColumn("constant", F.col("n_nationkey") % 4 == 0)
    return evaluation.storage_slots(v, "n_regionkey", "n_nationkey").select("n_regionkey", "n_name", F.col("slot").cast("int").alias("slot"))


@query("""with b as (select md5(text) as key, min(doc_id) as body from documents join labels using (doc_id) where quality = 1 group by 1) select case when body is not null then 'lookup' else 'tac_only' end as source, count(*) as n from documents d left join b on b.key = md5(d.text) group by 1""")
def inference_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("key"))
    bodies = docs.join(t(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("body"))
    return evaluation.source_summary(evaluation.inference_results(docs, bodies, "key"))


@query("""select doc_id, concat_ws(', ', case when trim(lang) <> '' then concat('lang: ', lang) end, concat('chars: ', n_chars), case when trim(source) <> '' then concat('source: ', source) end) as line,
  md5(concat('### Instruction:', chr(10), 'Read', chr(10), chr(10), '### Input:', chr(10), text, chr(10), chr(10), '### Response:', chr(10))) as prompt from documents""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    line = records.metadata_line({"lang": F.col("lang"), "chars": F.col("n_chars"), "source": F.col("source")})
    return docs.select("doc_id", line.alias("line"), F.md5(records.prompt("text", F.lit(""), "Read")).alias("prompt"))


@query("""select source, case when contains(lower(source), 'src1') then 'transfer' when lower(source) like 'src2%' then 'mint' else 'other' end as family, count(*) as n from documents group by 1, 2""")
def family_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower("source")
    name = F.when(s.contains("src1"), "transferFrom").when(s.startswith("src2"), "mintTo").otherwise(F.col("source"))
    return t(spark, d, "documents").groupBy("source", text.function_family(name).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.sample(t(spark, d, "documents").select("doc_id"), "doc_id", 50, 42)


@query()
def greedy_cover(spark: SparkSession, d: str) -> DataFrame:
    chosen = evaluation.greedy_cover(t(spark, d, "documents"), "doc_id", F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")), 12)
    return spark.createDataFrame([(i, c) for i, c in enumerate(chosen)], "pick int, doc_id long")
