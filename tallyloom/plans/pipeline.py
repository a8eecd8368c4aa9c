"""Composite queries: sampling by month and topic, the wide table of posts, reports, intervals, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import cleaning as C
from tallyloom.functions import replies as R
from tallyloom.functions import scalars as S
from tallyloom.functions import spans as P
from tallyloom.operators import keyed as K
from tallyloom.operators import stats
from tallyloom.operators.ranges import running_sums
from tallyloom.plans import claims as CL
from tallyloom.plans import measures as MS
from tallyloom.plans import posts as PO
from tallyloom.plans.registry import query
from tallyloom.session import table
from tallyloom.streaming import weekly

# The topics among which a month's quota is divided evenly.
TOPICS = ["community_platform", "crypto_finance", "entertainment", "gaming", "personal", "technology", "travel_lifestyle"]


def month_quotas(political: DataFrame, pool: DataFrame, total: int) -> DataFrame:
    """(month, category, quota): months in proportion to the political posts, capped by the pool, then evenly over topics.

    Quotas are computed on the table of months and topics, which has a few rows for each month.
    """
    weights = {r.month: r["count"] for r in political.groupBy("month").count().collect() if r.month}
    cells = {(r.month, r.category): r["count"] for r in pool.groupBy("month", "category").count().collect() if r.month}
    caps: dict = {}
    for (m, _), n in cells.items():
        caps[m] = caps.get(m, 0) + n
    by_month = K.capped_apportion(total, {m: weights.get(m, 0) for m in caps}, caps)
    rows = []
    for m, n in sorted(by_month.items()):
        each = {c: k for (x, c), k in cells.items() if x == m}
        rows += [(m, c, q) for c, q in sorted(K.capped_apportion(n, dict.fromkeys(each, 1), each).items())]
    return pool.sparkSession.createDataFrame(rows, "month string, category string, quota int")


def balanced_sample(posts: DataFrame, seed: int = 42) -> DataFrame:
    """All political posts and as many others, matched by month and spread over topics, drawn by hash."""
    political = posts.where("is_political")
    pool = posts.where(~F.col("is_political") & F.col("category").isin(*TOPICS))
    quotas = month_quotas(political, pool, political.count())
    picked = pool.join(F.broadcast(quotas), ["month", "category"])
    picked = K.sample_each(picked, ["month", "category"], ["author", "permlink"], F.col("quota"), seed).drop("quota")
    return political.withColumn("sample_stratum", F.lit("political")).unionByName(picked.withColumn("sample_stratum", F.lit("nonpolitical")))


def _gated(spark, d) -> DataFrame:
    posts = table(spark, d, "hive_cleaned").select("author", "permlink", "created", "classification", "category").distinct()
    return posts.select("author", "permlink", "category", S.month(F.col("created")).alias("month"), S.is_political(F.col("classification"), F.col("category")).alias("is_political"))


@query("balanced_sample")
def balanced_sample_query(spark, d):
    return balanced_sample(_gated(spark, d))


@query("balanced_sample_report")
def balanced_sample_report(spark, d):
    """Posts of the sample by month and stratum, with months of no posts filled."""
    s = balanced_sample(_gated(spark, d))
    return s.groupBy("month").pivot("sample_stratum", ["political", "nonpolitical"]).count().na.fill(0, ["political", "nonpolitical"])


_WIDE = """(with p as (select doc_id, any_value(author) as author, any_value(permlink) as permlink, any_value(created) as created, any_value(category) as category, bool_or(is_political) as is_political, max(net_votes) as net_votes, max(length(body_for_analysis)) as n_chars from hive_sample_master group by 1),
g as (select doc_id, max(cb_max_score) as gate_score from gate_scores where doc_id is not null group by 1),
a as (select author, count(distinct permlink) as author_posts, min(created) as first_post from hive_classified group by 1)
select doc_id, strftime(p.created, '%Y-%m') as month, hour(p.created) as post_hour, isodow(p.created) - 1 as post_dow, category, is_political, round(ln(1 + greatest(coalesce(net_votes, 0), 0)), 9) as log_votes, round(ln(1 + n_chars), 9) as log_chars,
  gate_score, author_posts, greatest(cast(floor((epoch(p.created) - epoch(first_post)) / 86400) as bigint), 0) as author_age_days from p left join g using (doc_id) left join a using (author))"""


def wide_table(spark, d) -> DataFrame:
    """One row for each sampled post with its gate score, time, lengths and author history; join keys are checked to be unique."""
    p = table(spark, d, "hive_sample_master").groupBy("doc_id").agg(
        F.min("author").alias("author"), F.min("created").alias("created"), F.min("category").alias("category"), F.bool_or("is_political").alias("is_political"),
        F.max("net_votes").alias("net_votes"), F.max(F.length("body_for_analysis")).alias("n_chars"),
    )
    g = table(spark, d, "gate_scores").where("doc_id is not null").groupBy("doc_id").agg(F.max("cb_max_score").alias("gate_score"))
    a = table(spark, d, "hive_classified").groupBy("author").agg(F.countDistinct("permlink").alias("author_posts"), F.min("created").alias("first_post"))
    rows = p.join(g, "doc_id", "left").join(a, "author", "left")
    age = F.floor((F.unix_micros(F.col("created").cast("timestamp")) - F.unix_micros(F.col("first_post").cast("timestamp"))) / 1e6 / 86400)
    return rows.select(
        "doc_id", S.month(F.col("created")).alias("month"), F.hour("created").alias("post_hour"), F.weekday("created").alias("post_dow"), "category", "is_political",
        F.round(S.log1p_count(F.coalesce("net_votes", F.lit(0))), 9).alias("log_votes"), F.round(F.log1p(F.col("n_chars").cast("double")), 9).alias("log_chars"),
        "gate_score", "author_posts", F.greatest(age, F.lit(0)).alias("author_age_days"),
    )


@query("regression_table", f"select * from {_WIDE}")
def regression_table(spark, d):
    return wide_table(spark, d)


_AUDIT = {
    "posts": "1",
    "posts_political": "case when is_political then 1 end",
    "posts_political_missing": "case when is_political is null then 1 end",
    "posts_without_score": "case when gate_score is null then 1 end",
    "posts_above_gate": "case when gate_score > 0.85 then 1 end",
    "posts_without_category": "case when category is null or trim(category) = '' then 1 end",
    "posts_of_new_authors": "case when author_age_days < 7 then 1 end",
}


@query("regression_audit", " union all ".join(f"select '{m}' as metric, count({c}) as value from {_WIDE}" for m, c in _AUDIT.items()))
def regression_audit(spark, d):
    """Counts of the wide table in long form, from one pass."""
    one = wide_table(spark, d).agg(*(F.count(F.expr(c)).alias(m) for m, c in _AUDIT.items()))
    return one.unpivot([], list(_AUDIT), "metric", "value")


@query("regression_coverage", f"select doc_id from {_WIDE} where author_posts is null")
def regression_coverage(spark, d):
    """Posts whose author has no history: an empty result is the contract."""
    return wide_table(spark, d).where("author_posts is null").select("doc_id")


@query("cleaning_report", "with s as (select distinct author, permlink, length(body_clean) as b, length(body_for_analysis) as a from hive_cleaned) select count(*) as n, round(avg(b), 6) as mean_before, round(avg(a), 6) as mean_after, round(median((b - a) / nullif(b::double, 0)), 9) as median_reduction, round(quantile_cont((b - a) / nullif(b::double, 0), 0.95), 9) as p95_reduction, count(*) filter (where a < 50) as n_short from s")
def cleaning_report(spark, d):
    s = table(spark, d, "hive_cleaned").select("author", "permlink", F.length("body_clean").alias("b"), F.length("body_for_analysis").alias("a")).distinct()
    s = s.withColumn("r", S.reduction_pct(F.col("b"), F.col("a")))
    q = stats.quantiles(s, "r", {"p50": 0.5, "p95": 0.95})
    return s.agg(
        F.count("*").alias("n"), F.round(F.avg("b"), 6).alias("mean_before"), F.round(F.avg("a"), 6).alias("mean_after"), F.round(q.select("p50").scalar(), 9).alias("median_reduction"),
        F.round(q.select("p95").scalar(), 9).alias("p95_reduction"), F.count_if(F.col("a") < 50).alias("n_short"),
    )


@query("corpus_overview", "select count(*) as n_posts, count(distinct author) as n_authors, count(distinct cast(created as date)) as n_days, min(created) as first, max(created) as last, round(count(*)::double / count(distinct cast(created as date)), 6) as per_day from (select distinct author, permlink, created from hive_classified)")
def corpus_overview(spark, d):
    p = table(spark, d, "hive_classified").select("author", "permlink", "created").distinct()
    days = F.countDistinct(F.to_date("created"))
    return p.agg(F.count("*").alias("n_posts"), F.countDistinct("author").alias("n_authors"), days.alias("n_days"), F.min("created").alias("first"), F.max("created").alias("last"), F.round(F.count("*") / days, 6).alias("per_day"))


@query("merged_intervals", """with i as (select l_orderkey as k, l_linenumber * 20 as s, l_linenumber * 20 + cast(l_quantity as integer) as e from lineitem),
m as (select *, case when s <= max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from i),
g as (select *, sum(new) over (partition by k order by s, e rows unbounded preceding) as grp from m) select k, min(s) as s, max(e) as e from g group by k, grp""")
def merged_intervals(spark, d):
    """Overlapping intervals of a key joined: one begins where none before it reaches; no list of a key's intervals is built."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 20).alias("s"), (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("int")).alias("e"))
    w = Window.partitionBy("k").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = i.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
    rows = rows.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("k", "grp").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("grp")


@query("claim_windows", """with d as (select doc_id, text, substr(text, 101, 40) as claim from documents where length(text) >= 300)
select doc_id, instr(text, claim) as at, length(substr(text, greatest(1, instr(text, claim) - 60), instr(text, claim) - greatest(1, instr(text, claim) - 60) + length(claim) + 60)) as n_chars from d where trim(claim) <> ''""")
def claim_windows(spark, d):
    docs = table(spark, d, "documents").where("length(text) >= 300").withColumn("claim", F.substring("text", 101, 40)).where("trim(claim) <> ''")
    return docs.select("doc_id", F.instr("text", F.col("claim")).alias("at"), F.length(P.exact_window(F.col("text"), F.col("claim"), 60)).alias("n_chars"))


@query("claim_spans")
def claim_spans(spark, d):
    """Where a folded copy of a passage stands in its text."""
    docs = table(spark, d, "documents").where("length(text) >= 300").withColumn("claim", F.upper(F.substring("text", 101, 60)))
    return docs.select("doc_id", P.claim_span(F.col("text"), F.col("claim")).alias("x")).select("doc_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


@query("outcome_grid", "select e as emotion, o as outcome, g as grp from (select unnest(['anger', 'joy', 'sadness']) as e), (select unnest(['votes', 'comments']) as o), (select unnest(['high', 'low']) as g)")
def outcome_grid(spark, d):
    """All combinations of a few parameters."""
    one = spark.range(1)
    for name, values in (("emotion", ["anger", "joy", "sadness"]), ("outcome", ["votes", "comments"]), ("grp", ["high", "low"])):
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return one.drop("id")


@query("key_overlap", "with a as (select distinct author || '/' || permlink as k from hive_cleaned), b as (select distinct doc_id as k from gate_scores where doc_id is not null), u as (select k from a union select k from b) select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from u) as n_union, (select count(*) from a) + (select count(*) from b) - (select count(*) from u) as n_both, (select count(*) from (select k from a except select k from b)) as only_a")
def key_overlap(spark, d):
    a = table(spark, d, "hive_cleaned").select(F.concat("author", F.lit("/"), "permlink").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "gate_scores").where("doc_id is not null").select(F.col("doc_id").alias("k")).distinct().withColumn("b", F.lit(1))
    u = a.join(b, "k", "full")
    return u.agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count("*").alias("n_union"), (F.count("a") + F.count("b") - F.count("*")).alias("n_both"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("only_a"),
    )


@query("wide_report", "select month, coalesce(max(n) filter (where lang_status = 'kept'), 0) as kept, coalesce(max(n) filter (where lang_status = 'dropped_low_english'), 0) as dropped from (select strftime(created, '%Y-%m') as month, lang_status, count(*) as n from (select distinct author, permlink, created, lang_status from hive_english_filtered) group by all) group by 1")
def wide_report(spark, d):
    p = table(spark, d, "hive_english_filtered").select("author", "permlink", "created", "lang_status").distinct()
    names = ["kept", "dropped_low_english"]
    wide = p.groupBy(S.month(F.col("created")).alias("month")).pivot("lang_status", names).count().na.fill(0, names)
    return wide.withColumnRenamed("dropped_low_english", "dropped")


_SPOKEN = "case when l_returnflag = 'N' then upper(replace(verdict, '_', ' ')) when l_returnflag = 'A' then ' ' || replace(verdict, '_', '-') || ' ' else 'half-' || verdict end"


@query("verdict_forms", f"""select raw, case when t in ('false', 'mostly_false', 'mixed', 'mostly_true', 'true') then t when t in ('partly_true', 'half_true', 'partially_true') then 'mixed' else 'unverified' end as six,
  case when lower(trim(raw)) in ('true', 'false') then lower(trim(raw)) else 'unverified' end as three, case when lower(trim(raw)) in ('asserted', 'quoted', 'unclear') then lower(trim(raw)) else 'unclear' end as stance, count(*) as n
from (select raw, regexp_replace(lower(trim(raw)), '[\\s-]+', '_', 'g') as t from (select {_SPOKEN} as raw from (select l_returnflag, {CL._CASE_V} as verdict from lineitem))) group by all""")
def verdict_forms(spark, d):
    """Verdicts as models write them, in their classes."""
    raw = table(spark, d, "lineitem").select("l_returnflag", CL._pick(F.col("l_partkey"), CL.VERDICT_OF).alias("verdict")).select(F.expr(_SPOKEN).alias("raw"))
    return raw.groupBy("raw").agg(F.count("*").alias("n")).select(
        "raw", R.verdict6(F.col("raw")).alias("six"), R.verdict3(F.col("raw")).alias("three"), R.stance(F.col("raw")).alias("stance"), "n"
    )


@query("reply_objects", "select doc_id, case when source is null then null else cast(coalesce(n_chars, -1) as varchar) end as a from documents")
def reply_objects(spark, d):
    """Objects read from replies with and without code fences, with prose around them, and none."""
    obj = F.concat(F.lit('{"a": '), F.coalesce("n_chars", F.lit(-1)).cast("string"), F.lit("}"))
    raw = F.when(F.col("source").isNull(), "no object { here").when(F.col("lang").isNull(), F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
    raw = raw.when(F.col("title").isNull(), F.concat(F.lit("Sure: "), obj, F.lit(" done."))).otherwise(obj)
    return table(spark, d, "documents").select("doc_id", F.get_json_object(R.reply_object(raw), "$.a").alias("a"))


@query(
    "search_texts",
    """select doc_id, concat_ws(chr(10), case when lang is not null then '[Featured] ' || coalesce(title, '') || ': ' || lang end, case when source is not null then '[Panel] ' || source || ' - ' end,
  '1. ' || coalesce(title, '') || ' - ' || coalesce(author, '') || chr(10) || '2. ' || coalesce(author, '') || ' (2024) - x') as formatted from documents""",
)
def search_texts(spark, d):
    """Search payloads, made of documents' fields, as texts."""
    box = F.when(F.col("lang").isNotNull(), F.struct(F.col("title"), F.col("lang").alias("answer")))
    panel = F.when(F.col("source").isNotNull(), F.struct(F.col("source").alias("title")))
    hits = F.array(F.struct(F.col("title"), F.col("author").alias("snippet"), F.lit(None).cast("string").alias("date")), F.struct(F.col("author").alias("title"), F.lit("x").alias("snippet"), F.lit("2024").alias("date")))
    payload = F.to_json(F.struct(box.alias("answerBox"), panel.alias("knowledgeGraph"), hits.alias("organic")))
    return table(spark, d, "documents").select("doc_id", R.search_text(payload).alias("formatted"))


@query("stream_weekly", "select date_trunc('week', ts) as week_start, event_type, count(*) as n from events group by all")
def stream_weekly(spark, d):
    """The events table read as a stream and counted by Monday weeks."""
    return weekly.run_available(spark, d).select(F.col("week_start").cast("timestamp_ntz").alias("week_start"), "event_type", "n")


@query("first_seen_months", "select author, strftime(min(created), '%Y-%m') as first_month, count(distinct strftime(created, '%Y-%m')) as n_months from hive_classified group by 1")
def first_seen_months(spark, d):
    m = S.month(F.col("created"))
    return table(spark, d, "hive_classified").groupBy("author").agg(F.min(m).alias("first_month"), F.countDistinct(m).alias("n_months"))


@query("post_positions", "select author, permlink, row_number() over (partition by author order by created, permlink) as n, count(*) over (partition by author) as of_posts from (select author, permlink, min(created) as created from hive_classified group by all)")
def post_positions(spark, d):
    """Each post's place among its author's, by range partitions with offsets, so that no author sits in one task."""
    p = table(spark, d, "hive_classified").groupBy("author", "permlink").agg(F.min("created").alias("created")).withColumn("one", F.lit(1))
    placed = running_sums(p, ["author"], ["created", "permlink"], {"one": "n"})
    return placed.join(p.groupBy("author").agg(F.count("*").alias("of_posts")), "author").select("author", "permlink", "n", "of_posts")


_DATASET = """(with p as (select lower(trim(doc_id)) as k, min(doc_id) as doc_id, min(author) as author, min(created) as created, min(nullif(trim(category), '')) as category, bool_or(is_political) as is_political,
    max(net_votes) as net_votes, max(children) as children, max(length(body_for_analysis)) as n_chars, min(title) as title from hive_sample_master where doc_id is not null group by 1),
g as (select lower(trim(doc_id)) as k, max(cb_max_score) as gate_score, max(cb_n_checkworthy) as n_claims, max(n_sentences) as n_sentences from gate_scores where doc_id is not null group by 1),
a as (select author, count(distinct permlink) as author_posts, min(created) as first_post, sum(greatest(coalesce(net_votes, 0), 0)) as author_votes from (select distinct author, permlink, created, net_votes from hive_classified) group by 1)
select doc_id, author, strftime(p.created, '%Y-%m') as month, hour(p.created) as post_hour, isodow(p.created) - 1 as post_dow, (isodow(p.created) >= 6)::int as is_weekend, category, is_political::int::double as political01,
  round(ln(1 + greatest(coalesce(net_votes, 0), 0)), 9) as log_votes, round(ln(1 + greatest(coalesce(children, 0), 0)), 9) as log_children, (coalesce(children, 0) > 0)::int as any_children, round(ln(1 + n_chars), 9) as log_chars,
  (title is not null)::int as has_title, gate_score, (coalesce(gate_score, 0) > 0.85)::int as above_gate, coalesce(n_claims, 0) as n_claims, coalesce((n_claims = 1)::int, 0) as claims_1, coalesce((n_claims = 2)::int, 0) as claims_2, coalesce((n_claims = 3)::int, 0) as claims_3,
  round(case when n_sentences > 0 then n_claims / n_sentences::double else 0 end, 9) as claim_rate, coalesce(author_posts, 0) as author_posts, round(ln(1 + author_votes), 9) as log_author_votes,
  greatest(cast(floor((epoch(p.created) - epoch(first_post)) / 86400) as bigint), 0) as author_age_days from p left join g using (k) left join a using (author))"""

# Fixed schema of the table that regressions read.
DATASET_SCHEMA = [
    ("doc_id", "string"), ("author", "string"), ("month", "string"), ("post_hour", "int"), ("post_dow", "int"), ("is_weekend", "int"), ("category", "string"), ("political01", "double"),
    ("log_votes", "double"), ("log_children", "double"), ("any_children", "int"), ("log_chars", "double"), ("has_title", "int"), ("gate_score", "double"), ("above_gate", "int"), ("n_claims", "bigint"),
    ("claims_1", "int"), ("claims_2", "int"), ("claims_3", "int"), ("claim_rate", "double"), ("author_posts", "bigint"), ("log_author_votes", "double"), ("author_age_days", "bigint"),
]


def build_dataset(posts: DataFrame, scores: DataFrame, history: DataFrame) -> DataFrame:
    """One row of fixed columns and types for each post, from posts, one row of scores for each doc_id and one of history for each author.

    Keys are joined trimmed and case-folded; scores or histories of several rows for a key raise in the job itself.
    """
    rows = K.join_normalised(posts, scores, "doc_id")
    rows = K.join_unique(rows, history, ["author"])
    age = F.floor((F.unix_micros(F.col("created").cast("timestamp")) - F.unix_micros(F.col("first_post").cast("timestamp"))) / 1e6 / 86400)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    wide = rows.select(
        "doc_id", "author", S.month(F.col("created")).alias("month"), F.hour("created").alias("post_hour"), F.weekday("created").alias("post_dow"), (F.weekday("created") >= 5).cast("int").alias("is_weekend"),
        "category", S.to01(F.col("is_political")).alias("political01"), F.round(S.log1p_count(F.coalesce("net_votes", F.lit(0))), 9).alias("log_votes"),
        F.round(S.log1p_count(F.coalesce("children", F.lit(0))), 9).alias("log_children"), flag(F.col("children") > 0).alias("any_children"), F.round(F.log1p(F.col("n_chars").cast("double")), 9).alias("log_chars"),
        F.col("title").isNotNull().cast("int").alias("has_title"), "gate_score", flag(F.col("gate_score") > 0.85).alias("above_gate"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"),
        *K.one_hot(F.col("n_claims"), [1, 2, 3], "claims"), F.round(S.safe_ratio(F.col("n_claims"), F.col("n_sentences")), 9).alias("claim_rate"),
        F.coalesce("author_posts", F.lit(0)).alias("author_posts"), F.round(F.log1p(F.col("author_votes").cast("double")), 9).alias("log_author_votes"), F.greatest(age, F.lit(0)).alias("author_age_days"),
    )
    return K.conform(wide, DATASET_SCHEMA)


def _dataset(spark, d) -> DataFrame:
    key = F.lower(F.trim("doc_id"))
    p = table(spark, d, "hive_sample_master").where("doc_id is not null").groupBy(key.alias("k")).agg(
        F.min("doc_id").alias("doc_id"), F.min("author").alias("author"), F.min("created").alias("created"), F.min(F.nullif(F.trim("category"), F.lit(""))).alias("category"), F.bool_or("is_political").alias("is_political"),
        F.max("net_votes").alias("net_votes"), F.max("children").alias("children"), F.max(F.length("body_for_analysis")).alias("n_chars"), F.min("title").alias("title"),
    ).drop("k")
    g = table(spark, d, "gate_scores").where("doc_id is not null").groupBy(key.alias("doc_id")).agg(
        F.max("cb_max_score").alias("gate_score"), F.max("cb_n_checkworthy").alias("n_claims"), F.max("n_sentences").alias("n_sentences")
    )
    h = table(spark, d, "hive_classified").select("author", "permlink", "created", "net_votes").distinct().groupBy("author").agg(
        F.countDistinct("permlink").alias("author_posts"), F.min("created").alias("first_post"), F.sum(F.greatest(F.coalesce("net_votes", F.lit(0)), F.lit(0))).alias("author_votes")
    )
    return build_dataset(p, g, h)


@query("regression_dataset", f"select * from {_DATASET}")
def regression_dataset(spark, d):
    """The table that regressions read: contracts on both joins run within the plan."""
    return _dataset(spark, d)


_DATASET_AUDIT = {
    "posts": "1", "authors": "author", "months": "month", "political": "case when political01 = 1 then 1 end", "political_missing": "case when political01 is null then 1 end", "with_score": "gate_score",
    "above_gate": "case when above_gate = 1 then 1 end", "without_claims": "case when n_claims = 0 then 1 end", "one_claim": "case when claims_1 = 1 then 1 end", "two_claims": "case when claims_2 = 1 then 1 end",
    "three_claims": "case when claims_3 = 1 then 1 end", "commented": "case when any_children = 1 then 1 end", "weekend": "case when is_weekend = 1 then 1 end", "untitled": "case when has_title = 0 then 1 end",
    "without_category": "case when category is null then 1 end", "authors_without_history": "case when author_posts = 0 then 1 end", "complete": "case when gate_score is not null and category is not null and political01 is not null then 1 end",
}
_DISTINCT = ("authors", "months")


@query("dataset_audit", " union all ".join(f"select '{m}' as metric, count({'distinct ' if m in _DISTINCT else ''}{c}) as value from {_DATASET}" for m, c in _DATASET_AUDIT.items()))
def dataset_audit(spark, d):
    """Counts of the regression table in long form, from one pass."""
    one = _dataset(spark, d).agg(*((F.countDistinct if m in _DISTINCT else F.count)(F.expr(c)).alias(m) for m, c in _DATASET_AUDIT.items()))
    return one.unpivot([], list(_DATASET_AUDIT), "metric", "value")


_INDEXED = rf"""ver as (select doc_id, 'a' as v, coalesce(text, '') as t from documents union all select doc_id, 'b', {{clean}} from documents),
lines as (select doc_id, v, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from ver),
parts as (select doc_id, v, k, unnest(string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) as j from lines),
sents as (select doc_id, v, trim(s) as s, row_number() over (partition by doc_id, v order by k, j) as idx from parts where trim(s) <> '')"""
_PLAIN = PO.sql_chain("coalesce(text, '')", [(r"<[^>]+>", ""), (r"\[[^\n]*?\]\([^\n]*?\)", "")])


@query(
    "text_dynamics",
    f"""with {_INDEXED.format(clean=_PLAIN)}, n as (select doc_id, count(*) filter (where v = 'a') as n, count(*) filter (where v = 'b') as m from sents group by 1),
fl as (select a.doc_id, a.idx, (length(a.s) % 97) / 97.0::double as x, coalesce(case when n.n = n.m then {PO._BOILER.replace('(s,', '(b.s,').replace('(s ', '(b.s ').replace('length(s)', 'length(b.s)')} end, false) as flag
  from (select * from sents where v = 'a') a join n using (doc_id) left join (select * from sents where v = 'b') b on b.doc_id = a.doc_id and b.idx = a.idx),
u as (select doc_id, count(*) as n, stddev_samp(dx) as vol from (select *, x - lag(x) over (partition by doc_id order by idx) as dx from fl) group by 1),
f as (select doc_id, count(*) as n, stddev_samp(dx) as vol from (select *, x - lag(x) over (partition by doc_id order by idx) as dx from fl where not flag) group by 1)
select u.doc_id, u.n as n_sentences_u, coalesce(f.n, 0) as n_sentences_f, round(case when u.n >= 3 then u.vol end, 9) as x_volatility_u, round(case when f.n >= 3 then f.vol end, 9) as x_volatility_f, n.n = n.m as aligned
from u join n using (doc_id) left join f using (doc_id)""",
)
def text_dynamics(spark, d):
    """Volatility of a sentence score (a stand-in: the sentence's length) with and without boilerplate; flags are computed anew from a cleaned text
    and count only where it has as many sentences."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    numbered = lambda text: docs.select("doc_id", F.posexplode(C.sentences(text)).alias("i", "s"))
    scored = numbered(F.col("t")).select("doc_id", F.col("i").alias("idx"), (F.length("s") % 97 / 97.0).alias("x"))
    again = numbered(F.regexp_replace(F.regexp_replace("t", r"<[^>]+>", ""), r"(?d)\[.*?\]\(.*?\)", ""))
    flags = again.select("doc_id", F.col("i").alias("idx"), C.is_boilerplate(F.col("s")).alias("flag"))
    rows = K.aligned_flags(scored, flags, "doc_id", "idx", "flag")
    measures = lambda df: MS.dynamics(df, ["x"], ["doc_id"], "idx").select("doc_id", "n_sentences", "x_volatility")
    n, m = scored.groupBy("doc_id").agg(F.count("*").alias("n")), flags.groupBy("doc_id").agg(F.count("*").alias("m"))
    both = K.join_suffixed(measures(rows), measures(rows.where("not flag")), ["doc_id"], "left", ("_u", "_f"))
    return both.join(n.join(m, "doc_id", "left").select("doc_id", F.coalesce(F.col("n") == F.col("m"), F.lit(False)).alias("aligned")), "doc_id").select(
        "doc_id", "n_sentences_u", F.coalesce("n_sentences_f", F.lit(0)).alias("n_sentences_f"), "x_volatility_u", "x_volatility_f", "aligned"
    )
