"""Similarities, fact sets, term features, risk scores and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import facts, features, risk
from orrery.plans.base import query, t

TURNS_SQL = """p as (select u.conv_id, u.turn, u.text as a, v.text as b, u.text as ua, v.text as va
  from conversations u join conversations v on u.conv_id = v.conv_id and v.turn = u.turn + 1 where u.role = 'user' and v.role = 'assistant')"""
WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ua"))
    v = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("va"))
    return u.join(v, ["conv_id", "turn"]).withColumn("a", F.col("ua")).withColumn("b", F.col("va"))


@query(f"""with {TURNS_SQL}, w as (select conv_id, turn, list_distinct({WORDS.format('a')}) x, list_distinct({WORDS.format('b')}) y from p)
select conv_id, turn, round(cast(case when len(x) = 0 then (case when len(y) = 0 then 1 else 0 end) else len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) end as double), 6) as jaccard from w""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    j = text.jaccard(F.array_distinct(text.words("a")), F.array_distinct(text.words("b")))
    return _turns(spark, d).select("conv_id", "turn", F.round(j, 6).alias("jaccard"))


@query(f"""with {TURNS_SQL}, n as (select conv_id, turn, trim(regexp_replace(regexp_replace(a, '[^ -~]+', ' ', 'g'), '\\s+', ' ', 'g')) a, trim(regexp_replace(regexp_replace(b, '[^ -~]+', ' ', 'g'), '\\s+', ' ', 'g')) b from p)
select conv_id, turn, round(cast(case when greatest(length(a), length(b)) = 0 then 0 else levenshtein(a, b) / greatest(length(a), length(b)) end as double), 6) as distance from n""")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    ascii_ = lambda c: F.regexp_replace(c, "[^ -~]+", " ")  # noqa: E731  DuckDB counts bytes
    return _turns(spark, d).select("conv_id", "turn", F.round(text.normalized_edit_distance(ascii_("a"), ascii_("b")), 6).alias("distance"))


PARTS = ("the", "on", "th", "er", ".", ",", "zz")


def _parts_sql() -> str:
    n = lambda c, p: f"((length({c}) - length(replace({c}, '{p}', ''))) // {len(p)})"
    each = [f"case when {n('ua', p)} + {n('va', p)} > 0 then abs({n('ua', p)} - {n('va', p)}) / ({n('ua', p)} + {n('va', p)}) end" for p in PARTS]
    return f"with {TURNS_SQL}, l as (select conv_id, turn, list_filter([{', '.join(each)}], lambda x: x is not null) l from p) select conv_id, turn, round(cast(case when len(l) = 0 then 1 else 1 - list_sum(l) / len(l) end as double), 6) as kept from l"


@query(_parts_sql())
def structural_preservation(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", F.round(text.structural_preservation("ua", "va", PARTS), 6).alias("kept"))


@query("select page_id, cast(length(html) - length(replace(html, '<', '')) as bigint) as opened, cast(length(html) - length(replace(html, '>', '')) as bigint) as closed from pages")
def tag_marks(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.occurrences("html", "<").alias("opened"), text.occurrences("html", ">").alias("closed"))


@query()
def nesting_depth(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.nesting_depth("html", "<", ">").alias("depth"))


@query("""select a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double)))
  / sqrt(list_sum(list_transform(a.embedding, lambda x: cast(x as double) * cast(x as double))) * list_sum(list_transform(b.embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as cosine
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    right = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(right, "vec_id").select("vec_id", F.round(text.cosine("embedding", "other"), 6).alias("cosine"))


FACTS_SQL = f"""{TURNS_SQL}, w as (select unnest({WORDS.format('ua')}) as fact, conv_id, turn, 0 as side from p union all select unnest({WORDS.format('va')}), conv_id, turn, 1 from p),
f as (select distinct conv_id, turn, side, lower(fact) as fact, case when length(fact) <= 3 then 'short' when length(fact) <= 6 then 'medium' else 'long' end as category from w),
g as (select conv_id, turn, category, fact, max(case when side = 0 then 1 else 0 end) r, max(case when side = 1 then 1 else 0 end) c from f group by 1, 2, 3, 4),
s as (select category, cast(sum(r * c) as bigint) tp, cast(sum((1 - r) * c) as bigint) fp, cast(sum(r * (1 - c)) as bigint) fn from g group by 1),
m as (select *, case when tp + fp = 0 then 1 else tp / (tp + fp) end as p, case when tp + fn = 0 then 1 else tp / (tp + fn) end as q from s),
scores as (select category, tp, fp, fn, round(cast(p as double), 6) as precision, round(cast(q as double), 6) as recall, round(cast(case when p + q = 0 then 0 else 2 * p * q / (p + q) end as double), 6) as f1 from m)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    kind = lambda w: F.when(F.length(w) <= 3, "short").when(F.length(w) <= 6, "medium").otherwise("long")
    of = lambda c, k: F.array_distinct(F.transform(F.filter(text.words(c), lambda w: kind(w) == k), F.lower))
    rows = turns.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), of("ua", k).alias("r"), of("va", k).alias("c")) for k in ("short", "medium", "long")])).alias("x")).select("x.*")
    scored = facts.category_scores(facts.compare(rows, F.col("r"), F.col("c")))
    return scored.select("category", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"with {FACTS_SQL} select * from scores")
def fact_prf_micro(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query(f"with {FACTS_SQL} select category, f1, fn, fp, case when fn >= fp then 'recall' else 'precision' end as primary_error from scores where fn + fp > 0")
def category_gaps(spark: SparkSession, d: str) -> DataFrame:
    return facts.category_gaps(_scores(spark, d)).select("category", "f1", "fn", "fp", "primary_error")


@query(f"""with {TURNS_SQL}, s as (select conv_id, turn, list_distinct({WORDS.format('ua')}) r, list_distinct({WORDS.format('va')}) c from p)
select conv_id, turn, len(list_filter(c, lambda w: not list_contains(r, w))) as extra, len(list_filter(c, lambda w: not list_contains(r, w) and length(w) > 4)) as ungrounded from s""")
def grounded_extras(spark: SparkSession, d: str) -> DataFrame:
    s = _turns(spark, d).select("conv_id", "turn", F.array_distinct(text.words("ua")).alias("r"), F.array_distinct(text.words("va")).alias("c"))
    extra = F.array_except("c", "r")
    return s.select("conv_id", "turn", F.size(extra).cast("long").alias("extra"), F.size(facts.ungrounded(extra, F.filter("c", lambda w: F.length(w) <= 4))).cast("long").alias("ungrounded"))


@query("select user_id, event_type, count(*) as n from events group by 1, 2")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return features.frequencies(t(spark, d, "events"), "user_id", "event_type")


IDF_SQL = f"""f as (select doc_id, lower(w) as term, count(*) as n from (select doc_id, unnest({WORDS.format('text')}) w from documents) group by 1, 2),
i as (select term, count(*) as df, ln(((select count(distinct doc_id) from f) + 1) / (count(*) + 1)) + 1 as idf from f group by 1)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    words = t(spark, d, "documents").select("doc_id", F.explode(text.words("text")).alias("w"))
    return features.frequencies(words.select("doc_id", F.lower("w").alias("term")), "doc_id", "term")


@query(f"with {IDF_SQL} select term, df, round(idf, 6) as idf from i")
def idf_fit(spark: SparkSession, d: str) -> DataFrame:
    return features.idf(_terms(spark, d), "doc_id", "term").withColumn("idf", F.round("idf", 6))


@query(f"""with {IDF_SQL}, s as (select doc_id, sum(n) as total from f group by 1) select f.doc_id, f.term, round(n / total * idf, 6) as tfidf from f join s using (doc_id) join i using (term)""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d)
    weights = features.idf(terms, "doc_id", "term")
    return features.tfidf(terms, weights, "doc_id", "term").withColumn("tfidf", F.round("tfidf", 6))


@query("""with f as (select user_id, event_type, count(*) as n from events group by 1, 2), g as (select distinct u.user_id, e.event_type from events u, (select distinct event_type from events) e)
select g.user_id, g.event_type, cast(coalesce(n, 0) as double) as n from g left join f using (user_id, event_type)""")
def dense_features(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events")
    counts = features.frequencies(events, "user_id", "event_type").withColumn("n", F.col("n").cast("double"))
    return features.dense(counts, events, events, "user_id", "event_type", "n")


@query("""with c as (select lang, quality, count(*) n from documents d join labels l on d.doc_id = l.doc_id group by 1, 2), s as (select lang, n, sum(n) over (partition by lang) total from c)
select lang, round(-sum(n / total * log2(n / total + 1e-10)), 6) as entropy from s group by 1""")
def label_entropy(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id")
    counts = j.groupBy("lang", "quality").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("lang").agg(F.sort_array(F.collect_list("n")).alias("c"))  # a count for each label
    return counts.select("lang", F.round(features.entropy(F.col("c")), 6).alias("entropy"))


LONG_SQL = """x as (select d.doc_id, quality as y, n_chars, length(text) - length(replace(text, '.', '')) as stops, length(text) - length(replace(text, chr(10), '')) as line_ends from documents d join labels l on d.doc_id = l.doc_id),
f as (select doc_id, y, 'n_chars' as feature, cast(n_chars as double) as v from x union all select doc_id, y, 'stops', cast(stops as double) from x union all select doc_id, y, 'line_ends', cast(line_ends as double) from x)"""
H = "(- (case when {a} > 0 then {a} / {n} * log2({a} / {n} + 1e-10) else 0 end) - (case when {n} - {a} > 0 then ({n} - {a}) / {n} * log2(({n} - {a}) / {n} + 1e-10) else 0 end))"
SPLITS_SQL = f"""{LONG_SQL}, g as (select feature, v, cast(count(*) as double) n, cast(sum(y) as double) a from f group by 1, 2),
s as (select feature, v, lead(v) over w as nxt, sum(n) over (w rows unbounded preceding) ln, sum(a) over (w rows unbounded preceding) la, sum(n) over (partition by feature) tn, sum(a) over (partition by feature) ta from g window w as (partition by feature order by v)),
i as (select feature, (v + nxt) / 2 as split, {H.format(a='ta', n='tn')} - (ln / tn * {H.format(a='la', n='ln')} + (tn - ln) / tn * {H.format(a='(ta - la)', n='(tn - ln)')}) as gain from s where nxt is not null),
b as (select *, row_number() over (partition by feature order by round(gain, 12) desc, split) rn from i), best as (select feature, split, gain from b where rn = 1)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    values = {"n_chars": F.col("n_chars"), "stops": text.occurrences("text", "."), "line_ends": text.occurrences("text", "\n")}
    each = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("v")) for k, v in values.items()])
    return j.select("doc_id", F.col("quality").alias("y"), F.explode(each).alias("f")).select("doc_id", "y", "f.*")


@query(f"with {SPLITS_SQL} select feature, round(split, 6) as split, round(gain, 6) as gain from best")
def optimal_split(spark: SparkSession, d: str) -> DataFrame:
    return features.optimal_split(_long(spark, d), "feature", "v", "y").select("feature", F.round("split", 6).alias("split"), F.round("gain", 6).alias("gain"))


@query(f"with {SPLITS_SQL} select f.doc_id, f.feature, case when f.v >= split then 1 else 0 end as bit from f join best using (feature)")
def binary_features(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    return features.binary_features(long, features.optimal_split(long, "feature", "v", "y"), "feature", "v").select("doc_id", "feature", "bit")


MODEL_SQL = f"""{LONG_SQL}, m as (select feature, coalesce(avg(v) filter (y = 1), 0) as p, coalesce(avg(v) filter (y = 0), 0) as q from f group by 1)"""


@query(f"with {MODEL_SQL}, s as (select doc_id, sum(v * (p - q)) as score, sum((p + q) / 2 * (p - q)) as bound from f join m using (feature) group by 1) select doc_id, round(score, 3) as score, round(bound, 3) as bound, score > bound as positive from s")
def threshold_classifier(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    out = features.threshold_classify(long, features.mean_difference(long, "feature", "v", "y"), "doc_id", "feature", "v")
    return out.select("doc_id", F.round("score", 3).alias("score"), F.round("bound", 3).alias("bound"), "positive")


@query(f"with {MODEL_SQL} select feature, round(abs(p - q), 6) as importance from m order by 2 desc, feature desc limit 2")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    m = features.mean_difference(_long(spark, d), "feature", "v", "y").select("feature", F.round(F.abs("weight"), 6).alias("importance"))
    return features.importance(m, "feature", "importance", "feature", 2)


@query("""with c as (select user_id, count(*) filter (event_type = 'error') e, count(*) filter (event_type = 'purchase') p, count(*) filter (event_type = 'click') k, count(*) filter (event_type = 'view') v, count(*) n from events group by 1),
s as (select user_id, round(least(greatest((case when e > 13 then 0.2 else 0 end) + (case when p > 12 then 0.2 else 0 end) - (case when k >= 14 then 0.1 else 0 end) + (case when v / n > 0.2 then 0.15 else 0 end), 0), 1), 6) as score from c)
select user_id, cast(score as double) as score, score > 0.4 as flagged, cast(greatest(score, 1 - score) as double) as confidence from s""")
def heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    counts = features.frequencies(t(spark, d, "events"), "user_id", "event_type")
    return features.heuristic_score(counts, "user_id", "event_type", "n", {"error": 13, "purchase": 12}, {"click": 14}, ("view", 0.2))


RISK_SQL = """f as (select user_id, case event_type when 'error' then 0.7 when 'purchase' then 0.4 when 'click' then 0.1 else 0 end as w, case event_type when 'error' then 0.5 when 'purchase' then 0.3 when 'click' then 0.1 else 0 end as fl, least(abs(value) / 1000, 1) as c from events),
r as (select user_id, least(greatest(1 - product(1 - w * c), max(fl)), 1) as risk from f group by 1)"""


def _risk(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    pick = lambda *v: F.when(e == "error", v[0]).when(e == "purchase", v[1]).when(e == "click", v[2]).otherwise(0.0)
    return risk.noisy_or(t(spark, d, "events"), "user_id", pick(0.7, 0.4, 0.1), F.least(F.abs("value") / 1000, F.lit(1.0)), pick(0.5, 0.3, 0.1))


@query(f"with {RISK_SQL} select user_id, round(cast(risk as double), 6) as risk from r")
def noisy_or_risk(spark: SparkSession, d: str) -> DataFrame:
    return _risk(spark, d).withColumn("risk", F.round("risk", 6))


@query(f"with {RISK_SQL}, l as (select case when risk >= 0.7 then 'critical' when risk >= 0.5 then 'high' when risk >= 0.3 then 'medium' when risk >= 0.1 then 'low' else 'minimal' end as level from r) select level, count(*) as n from l group by 1")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    return _risk(spark, d).groupBy(risk.risk_level(F.col("risk")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, round(least(sum(case event_type when 'error' then 1.0 when 'purchase' then 0.5 else 0 end * least(abs(value) / 1000, 1)) / 6, 1), 4) as risk from events group by 1")
def linear_risk(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    out = risk.linear_risk(t(spark, d, "events"), "user_id", F.when(e == "error", 1.0).when(e == "purchase", 0.5).otherwise(0.0), F.least(F.abs("value") / 1000, F.lit(1.0)))
    return out.withColumn("risk", F.round("risk", 4))


@query("""with p as (select page_id, html, lower(html) as low from pages), f as (
  select page_id, 'script' as kind, contains(low, '<script') and not contains(low, 'nonce') as hit, 0.7 as yes, 0.8 as no, 'high' as severity from p union all
  select page_id, 'clock', contains(html, 'now') or contains(html, '+'), 0.6, 0.9, 'medium' from p union all
  select page_id, 'form', contains(low, '<form'), 0.9, 0.95, 'critical' from p)
select page_id, kind, hit as detected, cast(case when hit then yes else no end as double) as confidence, severity from f""")
def source_pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    low, h = F.lower("html"), F.col("html")
    rules = {"script": (low.contains("<script") & ~low.contains("nonce"), 0.7, 0.8), "clock": (h.contains("now") | h.contains("+"), 0.6, 0.9), "form": (low.contains("<form"), 0.9, 0.95)}
    return risk.scan(t(spark, d, "pages"), "page_id", rules, {"script": "high", "clock": "medium", "form": "critical"})


@query("""with p as (select page_id, lower(html) as low, html from pages),
f as (select case when contains(html, '.call{value:') or contains(html, '.call.value(') or contains(low, '.send(') then 'high' end as s from p union all
  select case when contains(html, 'block.timestamp') or contains(html, 'now') then 'medium' end from p union all select case when contains(html, '+') or contains(html, '-') or contains(html, '*') then 'medium' end from p)
select s as severity, count(*) as n from f where s is not null group by 1""")
def finding_severities(spark: SparkSession, d: str) -> DataFrame:
    found = risk.scan(t(spark, d, "pages"), "page_id", risk.source_rules(F.col("html"))).where("detected")
    return risk.severity_counts(found)


@query("""with a as (select conv_id, turn, text, lead(text) over w as chosen, lead(text, 2) over w as rejected, lead(role) over w as r1, role from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, md5(chosen) as chosen, md5(rejected) as rejected from a where role = 'user' and r1 = 'assistant' and rejected is not null and chosen <> rejected and chosen <> '' and rejected <> ''""")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = t(spark, d, "conversations").withColumn("chosen", F.lead("text").over(w)).withColumn("rejected", F.lead("text", 2).over(w)).withColumn("r1", F.lead("role").over(w))
    good = "role = 'user' and r1 = 'assistant' and rejected is not null and chosen <> rejected and chosen <> '' and rejected <> ''"
    return a.where(good).select("conv_id", "turn", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query("""with d as (select doc_id, lang, n_chars, coalesce(quality, -1) as q from documents left join labels using (doc_id)), r as (select *, row_number() over (partition by lang, n_chars // 100 order by -q, n_chars, md5(cast(doc_id as varchar)), doc_id) rn from d)
select doc_id from r where rn = 1 order by -q, n_chars, md5(cast(doc_id as varchar)), doc_id limit 200""")
def curriculum(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id", "left").withColumn("q", F.coalesce("quality", F.lit(-1)))
    order = [-F.col("q"), F.col("n_chars"), F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    best = docs.withColumn("rn", F.row_number().over(Window.partitionBy("lang", F.expr("n_chars div 100")).orderBy(*order))).where("rn = 1")
    return best.orderBy(*order).limit(200).select("doc_id")
