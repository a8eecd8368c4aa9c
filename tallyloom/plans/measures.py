"""Queries on measures: sentence dynamics, engagement and standing, descriptives, concentration, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import stats
from tallyloom.operators.ranges import running_sums
from tallyloom.plans.registry import query
from tallyloom.session import table

EMOTIONS = ["anger", "joy", "sadness", "neutral"]
_SENT = "(select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as sent_idx, (l_partkey % 97) / 97.0::double as anger, (l_suppkey % 89) / 89.0::double as joy, l_discount * 10 as sadness, l_tax * 10 as neutral, l_returnflag = 'R' as flagged from lineitem)"


def _sentences(spark, d) -> DataFrame:
    """Scored sentences of documents, made from lineitem."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), n.alias("sent_idx"), (F.col("l_partkey") % 97 / 97.0).alias("anger"), (F.col("l_suppkey") % 89 / 89.0).alias("joy"),
        (F.col("l_discount") * 10).alias("sadness"), (F.col("l_tax") * 10).alias("neutral"), (F.col("l_returnflag") == "R").alias("flagged"),
    )


def dynamics(df: DataFrame, values: list[str], keys: list[str], order: str) -> DataFrame:
    """Mean, dispersion (null below 2) and volatility (deviation of neighbours' differences, null below 3) of each value."""
    w = Window.partitionBy(*keys).orderBy(order)
    stepped = df.withColumns({f"__d_{v}": F.col(v) - F.lag(v).over(w) for v in values})
    n = F.count("*")
    aggs = [n.alias("n_sentences")]
    for v in values:
        aggs += [
            F.round(F.avg(v), 9).alias(f"{v}_mean"),
            F.round(F.when(n >= 2, F.stddev_samp(v)), 9).alias(f"{v}_sd"),
            F.round(F.when(n >= 3, F.stddev_samp(f"__d_{v}")), 9).alias(f"{v}_volatility"),
        ]
    return stepped.groupBy(*keys).agg(*aggs)


def _sql_dynamics(where: str) -> str:
    cols = ", ".join(f"{v}, {v} - lag({v}) over (partition by doc_id order by sent_idx) as d_{v}" for v in ("anger", "joy"))
    aggs = ", ".join(
        f"round(avg({v}), 9) as {v}_mean, round(case when count(*) >= 2 then stddev_samp({v}) end, 9) as {v}_sd, round(case when count(*) >= 3 then stddev_samp(d_{v}) end, 9) as {v}_volatility" for v in ("anger", "joy")
    )
    return f"select doc_id, count(*) as n_sentences, {aggs} from (select doc_id, {cols} from {_SENT} {where}) group by 1"


@query("dynamics_unfiltered", _sql_dynamics(""))
def dynamics_unfiltered(spark, d):
    return dynamics(_sentences(spark, d), ["anger", "joy"], ["doc_id"], "sent_idx")


@query("dynamics_filtered", f"select k.doc_id, n_total, n_total - coalesce(n_sentences, 0) as n_dropped, coalesce(n_sentences, 0) as n_kept, anger_volatility, joy_volatility from (select doc_id, count(*) as n_total from {_SENT} group by 1) k left join ({_sql_dynamics('where not flagged')}) f using (doc_id)")
def dynamics_filtered(spark, d):
    """Measures over kept sentences, neighbours being those next to each other after the filter; a document with none keeps a row."""
    s = _sentences(spark, d)
    kept = dynamics(s.where("not flagged"), ["anger", "joy"], ["doc_id"], "sent_idx")
    total = s.groupBy("doc_id").agg(F.count("*").alias("n_total"))
    n = F.coalesce("n_sentences", F.lit(0))
    return total.join(kept, "doc_id", "left").select("doc_id", "n_total", (F.col("n_total") - n).alias("n_dropped"), n.alias("n_kept"), "anger_volatility", "joy_volatility")


@query("implied_correlation", f"select round(1 - power(avg(anger_volatility) / avg(anger_sd), 2) / 2, 9) as anger_r, round(corr(anger_volatility, anger_sd), 9) as volatility_sd_r from ({_sql_dynamics('')}) where anger_volatility is not null and anger_sd is not null")
def implied_correlation(spark, d):
    m = dynamics(_sentences(spark, d), ["anger"], ["doc_id"], "sent_idx").where("anger_volatility is not null and anger_sd is not null")
    return m.agg(F.round(1 - F.pow(F.avg("anger_volatility") / F.avg("anger_sd"), 2) / 2, 9).alias("anger_r"), F.round(F.corr("anger_volatility", "anger_sd"), 9).alias("volatility_sd_r"))


@query("dominant_emotion", f"select doc_id, sent_idx, case greatest(anger, joy, sadness, neutral) when anger then 'anger' when joy then 'joy' when sadness then 'sadness' else 'neutral' end as emotion, round(1 - neutral, 4) as emotional from {_SENT}")
def dominant_emotion(spark, d):
    return _sentences(spark, d).select("doc_id", "sent_idx", S.dominant(EMOTIONS).alias("emotion"), F.round(1 - F.col("neutral"), 4).alias("emotional"))


@query("flag_shares", f"select doc_id, round(avg(flagged::int), 9) as share, max(flagged::int) as any_flag, arg_min(anger, sent_idx) as first_anger, count(*) as n from {_SENT} group by 1")
def flag_shares(spark, d):
    f = F.col("flagged").cast("int")
    return _sentences(spark, d).groupBy("doc_id").agg(F.round(F.avg(f), 9).alias("share"), F.max(f).alias("any_flag"), F.min_by("anger", "sent_idx").alias("first_anger"), F.count("*").alias("n"))


@query("flag_share_quantiles", f"select round(quantile_cont(share, 0.1), 9) as p10, round(quantile_cont(share, 0.5), 9) as p50, round(quantile_cont(share, 0.9), 9) as p90 from (select avg(flagged::int) as share from {_SENT} group by doc_id)")
def flag_share_quantiles(spark, d):
    share = _sentences(spark, d).groupBy("doc_id").agg(F.avg(F.col("flagged").cast("int")).alias("share"))
    at = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    return stats.quantiles(share, "share", at).select(*(F.round(n, 9).alias(n) for n in at))


@query("outrage_rollup", f"select o_orderkey as doc_id, case when count(doc_id) > 0 then round(avg((anger >= 0.5)::int), 9) end as share, round(avg(anger), 9) as mean_score, coalesce(max((anger >= 0.5)::int), 0) as any_outrage from orders left join {_SENT} on doc_id = o_orderkey group by 1")
def outrage_rollup(spark, d):
    """Share, mean and any of a sentence label by document; documents without sentences have any 0 and the others null."""
    hit = (F.col("anger") >= 0.5).cast("int")
    m = _sentences(spark, d).groupBy("doc_id").agg(F.round(F.avg(hit), 9).alias("share"), F.round(F.avg("anger"), 9).alias("mean_score"), F.max(hit).alias("any_outrage"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return docs.join(m, "doc_id", "left").na.fill(0, ["any_outrage"])


@query("weekly_tumbling", "select event_type, date '2024-01-01' + cast(7 * floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 7.0) as integer) as week_start, count(*) as n, round(sum(value), 4) as total from events group by all")
def weekly_tumbling(spark, d):
    """Seven-day windows that begin on a given day, not on the epoch's."""
    start = F.to_date(F.lit("2024-01-01"))
    week = F.date_add(start, (7 * F.floor(F.date_diff(F.to_date("ts"), start) / 7)).cast("int"))
    return table(spark, d, "events").groupBy("event_type", week.alias("week_start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("vote_sums", "select event_type, count(*) filter (where value > 50) as up, count(*) filter (where value <= 50) as down, count(distinct user_id) as voters, round(sum(case when value > 50 then value else 0 end), 4) as up_value from events group by 1")
def vote_sums(spark, d):
    up = F.col("value") > 50
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(up).alias("up"), F.count_if(F.col("value") <= 50).alias("down"), F.countDistinct("user_id").alias("voters"), F.round(F.sum(F.when(up, F.col("value")).otherwise(0.0)), 4).alias("up_value")
    )


@query("json_path_extract", "select cast(json_extract_string(props, '$.k') as bigint) % 10 as k, count(*) as n from events group by 1")
def json_path_extract(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint") % 10
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("json_marker_extract", r"""select regexp_extract(props, '"k": ?([0-9]+)', 1) as k, count(*) as n, count(*) filter (where instr(props, '"k"') = 0) as unmatched from events group by 1""")
def json_marker_extract(spark, d):
    return table(spark, d, "events").groupBy(F.regexp_extract("props", r'"k": ?([0-9]+)', 1).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.instr("props", F.lit('"k"')) == 0).alias("unmatched"))


_WINDOW = "2024-01-15"


@query(
    "pre_window_standing",
    f"""with h as (select user_id, count(*) as n_ops, sum(value) as rewards, count(distinct event_type) as n_types from events where ts < timestamp '{_WINDOW}' group by 1)
select u.user_id, coalesce(n_ops, 0) as n_ops, round(coalesce(rewards, 0), 4) as rewards, coalesce(n_types, 0) as n_types, round(case when n_ops > 0 then rewards / n_ops else 0 end, 6) as reward_per_op,
  greatest(cast(floor((epoch(timestamp '{_WINDOW}') - epoch(first_ts)) / 86400) as bigint), 0) as age_days
from (select user_id, min(ts) as first_ts from events group by 1) u left join h using (user_id)""",
)
def pre_window_standing(spark, d):
    """Histories before the window only; users without any have 0, and none divides by 0."""
    e = table(spark, d, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    start = F.lit(_WINDOW).cast("timestamp")
    h = e.where(F.col("ts") < start).groupBy("user_id").agg(F.count("*").alias("n_ops"), F.sum("value").alias("rewards"), F.countDistinct("event_type").alias("n_types"))
    u = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    age = F.floor((F.unix_micros(start) - F.unix_micros("first_ts")) / 1e6 / 86400)
    rows = u.join(h, "user_id", "left").na.fill(0, ["n_ops", "rewards", "n_types"])
    return rows.select(
        "user_id", "n_ops", F.round("rewards", 4).alias("rewards"), "n_types", F.round(S.safe_ratio(F.col("rewards"), F.col("n_ops")), 6).alias("reward_per_op"), F.greatest(age, F.lit(0)).alias("age_days")
    )


@query(
    "panel_left_join_chain",
    """select c_custkey, n_name, coalesce(n_orders, 0) as n_orders, round(coalesce(spend, 0), 2) as spend, coalesce(n_lines, 0) as n_lines
from customer left join nation on n_nationkey = c_nationkey
left join (select o_custkey, count(*) as n_orders, sum(o_totalprice) as spend from orders group by 1) o on o.o_custkey = c_custkey
left join (select o_custkey, count(*) as n_lines from lineitem join orders on o_orderkey = l_orderkey group by 1) l on l.o_custkey = c_custkey""",
)
def panel_left_join_chain(spark, d):
    """Left joins from a key table; counters become 0, other fields stay null. Sizes, not hints, choose the joins."""
    o = table(spark, d, "orders")
    spend = o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).join(o.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = lines.groupBy("o_custkey").agg(F.sum("n").alias("n_lines"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_custkey").alias("o_custkey"))
    rows = c.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(spend, "o_custkey", "left").join(lines, "o_custkey", "left")
    return rows.na.fill(0, ["n_orders", "spend", "n_lines"]).select("c_custkey", "n_name", "n_orders", F.round("spend", 2).alias("spend"), "n_lines")


@query("coverage_report", "select 'posts' as metric, count(*)::double as value from (select distinct author, permlink from hive_cleaned) union all select 'scored', count(distinct doc_id)::double from gate_scores where doc_id is not null union all select 'share_with_score', round(avg((g.doc_id is not null)::int), 9) from (select distinct author || '/' || permlink as doc_id from hive_cleaned) p left join (select distinct doc_id from gate_scores) g using (doc_id)")
def coverage_report(spark, d):
    """An audit in long form, from one pass over the joined keys."""
    posts = table(spark, d, "hive_cleaned").select(F.concat("author", F.lit("/"), "permlink").alias("doc_id")).distinct().withColumn("p", F.lit(1))
    scored = table(spark, d, "gate_scores").where("doc_id is not null").select("doc_id").distinct().withColumn("g", F.lit(1))
    both = posts.join(scored, "doc_id", "full")
    a = both.agg(F.count("p").cast("double").alias("posts"), F.count("g").cast("double").alias("scored"), F.round(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()) / F.count("p"), 9).alias("share_with_score"))
    return a.unpivot([], ["posts", "scored", "share_with_score"], "metric", "value")


@query(
    "describe_values",
    """select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, min(l_quantity) as min, median(l_quantity) as median, max(l_quantity) as max,
  round(100.0::double * avg((l_quantity = 0)::int), 6) as pct_zero, round(skewness(l_quantity), 6) as skew, round(kurtosis(l_quantity), 6) as kurt from lineitem group by 1""",
)
def describe_values(spark, d):
    return stats.describe(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


@query("price_quantiles", "select round(quantile_cont(o_totalprice, 0.01), 4) as p1, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.75), 4) as q3, round(quantile_cont(o_totalprice, 0.95), 4) as p95, round(quantile_cont(o_totalprice, 0.99), 4) as p99 from orders")
def price_quantiles(spark, d):
    at = {"p1": 0.01, "q1": 0.25, "q3": 0.75, "p95": 0.95, "p99": 0.99}
    return stats.quantiles(table(spark, d, "orders"), "o_totalprice", at).select(*(F.round(n, 4).alias(n) for n in at))


@query("correlations", "select a, b, round(r, 9) as r from (select 'l_quantity' as a, 'l_extendedprice' as b, corr(l_quantity, l_extendedprice) as r from lineitem union all select 'l_quantity', 'l_discount', corr(l_quantity, l_discount) from lineitem union all select 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) from lineitem)")
def correlations(spark, d):
    return stats.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "welch_vs_reference",
    """with g as (select o_orderpriority as grp, count(*)::double as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), r as (select * from g where grp = '5-LOW')
select g.grp, round(g.m - r.m, 6) as diff, round((g.m - r.m) / sqrt(g.v / g.n + r.v / r.n), 6) as t, round(power(g.v / g.n + r.v / r.n, 2) / (power(g.v / g.n, 2) / (g.n - 1) + power(r.v / r.n, 2) / (r.n - 1)), 4) as df from g, r where g.grp <> '5-LOW'""",
)
def welch_vs_reference(spark, d):
    return stats.welch(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", "5-LOW").select("grp", "diff", "t", "df")


@query("group_means", "select 'l_discount' as measure, l_linenumber % 4 as n_claims, round(avg(l_discount), 9) as mean from lineitem group by all union all select 'l_tax', l_linenumber % 4, round(avg(l_tax), 9) from lineitem group by all")
def group_means(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("n_claims")).agg(F.round(F.avg("l_discount"), 9).alias("l_discount"), F.round(F.avg("l_tax"), 9).alias("l_tax"))
    return m.unpivot(["n_claims"], ["l_discount", "l_tax"], "measure", "mean").select("measure", "n_claims", "mean")


_SPEND = "(select o_custkey as author, greatest(sum(o_totalprice), 0) as v, count(*) as n_posts from orders group by 1)"


@query(
    "gini_coefficient",
    f"with r as (select v, row_number() over (order by v, author) as i, count(*) over () as n, sum(v) over () as t from {_SPEND}) select max(n) as n, round(2 * sum(i * v) / (max(n) * max(t)) - (max(n) + 1.0) / max(n), 9) as gini, round(sum(case when i <= floor(n / 2) then v else 0 end) / max(t), 9) as bottom50, round(sum(case when i > n - floor(n / 10) then v else 0 end) / max(t), 9) as top10 from r",
)
def gini_coefficient(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.greatest(F.sum("o_totalprice"), F.lit(0.0)).alias("v"))
    return stats.concentration(v, "author", "v")


@query(
    "lorenz_curve",
    f"select author, round(i / n::double, 9) as x, round(cum / t, 9) as y from (select author, row_number() over w as i, count(*) over () as n, sum(v) over (order by v, author rows unbounded preceding) as cum, sum(v) over () as t from {_SPEND} window w as (order by v, author))",
)
def lorenz_curve(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.greatest(F.sum("o_totalprice"), F.lit(0.0)).alias("v"))
    return stats.lorenz(v, "author", "v").select("author", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(
    "popularity_split",
    f"""with q as (select median(v) as m, quantile_cont(v, 0.8) as p80 from {_SPEND}), s as (select a.*, v > m as high, v >= p80 as top20 from {_SPEND} a, q)
select 'median' as split, high as upper, count(*) as n_authors, cast(sum(n_posts) as bigint) as n_posts, round(sum(n_posts) / count(*), 6) as posts_per_author from s group by high
union all select 'top20', top20, count(*), cast(sum(n_posts) as bigint), round(sum(n_posts) / count(*), 6) from s group by top20""",
)
def popularity_split(spark, d):
    """Authors above the median and in the top fifth; thresholds are over authors, not posts."""
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.greatest(F.sum("o_totalprice"), F.lit(0.0)).alias("v"), F.count("*").alias("n_posts"))
    q = stats.quantiles(v, "v", {"m": 0.5, "p80": 0.8})
    m, p80 = q.select("m").scalar(), q.select("p80").scalar()
    marked = v.select("n_posts", (F.col("v") > m).alias("high"), (F.col("v") >= p80).alias("top"))
    s = marked.select("n_posts", F.explode(F.array(F.struct(F.lit("median").alias("split"), F.col("high").alias("upper")), F.struct(F.lit("top20").alias("split"), F.col("top").alias("upper")))).alias("x"))
    return s.groupBy("x.split", "x.upper").agg(F.count("*").alias("n_authors"), F.sum("n_posts").alias("n_posts"), F.round(F.sum("n_posts") / F.count("*"), 6).alias("posts_per_author"))


@query("authors_with_enough_posts", "select o_custkey, count(*) as n from orders group by 1 having count(*) >= 5 and count(distinct o_orderpriority) >= 2")
def authors_with_enough_posts(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("k")).where("n >= 5 and k >= 2").drop("k")


@query("category_modes", "select author, arg_max(category, (n, -ascii(category), category)) as mode, max(n) as n from (select author, category, count(*) as n from hive_classified where category = lower(category) and regexp_matches(category, '^[a-z_]+$') group by all) group by 1")
def category_modes(spark, d):
    """The commonest category of each author; ties fall to the greatest by the stated order."""
    c = F.col("category")
    n = table(spark, d, "hive_classified").where((c == F.lower(c)) & c.rlike("^[a-z_]+$")).groupBy("author", "category").agg(F.count("*").alias("n"))
    return n.groupBy("author").agg(F.max_by("category", F.struct("n", -F.ascii("category"), "category")).alias("mode"), F.max("n").alias("n"))


@query("z_scores", "select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / nullif(stddev_samp(c_acctbal) over (), 0), 6) as z from customer")
def z_scores(spark, d):
    return stats.z_score(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"))


@query("engagement_logs", "select distinct author, permlink, round(ln(1 + greatest(children, 0)), 9) as log_children, (children > 0) as any_children from hive_classified")
def engagement_logs(spark, d):
    return table(spark, d, "hive_classified").select("author", "permlink", F.round(S.log1p_count(F.col("children")), 9).alias("log_children"), (F.col("children") > 0).alias("any_children")).distinct()


@query("complete_cases", "select count(*) as n_all, count(*) filter (where title is not null and category is not null and net_votes is not null) as n_complete from hive_classified")
def complete_cases(spark, d):
    df = table(spark, d, "hive_classified").select("title", "category", "net_votes")
    need = F.col("title").isNotNull() & F.col("category").isNotNull() & F.col("net_votes").isNotNull()
    return df.agg(F.count("*").alias("n_all"), F.count_if(need).alias("n_complete"))


@query("ranked_slice", "select o_orderkey, rn from (select o_orderkey, row_number() over (order by o_orderkey) as rn from orders) where rn between 101 and 200")
def ranked_slice(spark, d):
    """Positions 101 to 200 of all rows, numbered by range partitions with offsets."""
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("one"), F.lit(0).alias("g"))
    return running_sums(rows, ["g"], ["o_orderkey"], {"one": "rn"}).where("rn between 101 and 200").select("o_orderkey", "rn")


@query(
    "simple_regression",
    "select 'o_totalprice' as term, round(regr_slope(n, o_totalprice), 12) as estimate, round(regr_intercept(n, o_totalprice), 9) as intercept, round(regr_r2(n, o_totalprice), 9) as r2, count(*) as n_obs from (select o_totalprice, count(*)::double as n from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_totalprice)",
)
def simple_regression(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("n"))
    rows = table(spark, d, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey")).select("n", "o_totalprice")
    fit = stats.ols(rows, "n", ["o_totalprice"])
    e = fit["terms"]
    return spark.createDataFrame(
        [("o_totalprice", round(e["o_totalprice"]["estimate"], 12), round(e["(intercept)"]["estimate"], 9), round(fit["r2"], 9), fit["n"])],
        "term string, estimate double, intercept double, r2 double, n_obs bigint",
    )


def _regression_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", S.month(F.col("o_orderdate")).alias("month"), F.log1p("o_totalprice").alias("y"))
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("n_lines"), F.avg("l_discount").alias("discount"))
    return o.join(n, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


@query("ols_hc1")
def ols_hc1(spark, d):
    """Least squares with robust errors on counts, their product and a mean."""
    rows = _regression_rows(spark, d).withColumn("n_x_discount", F.col("n_lines") * F.col("discount"))
    return stats.as_frame(spark, stats.ols(rows, "y", ["n_lines", "discount", "n_x_discount"]))


@query("ols_ladder")
def ols_ladder(spark, d):
    """The share of variance explained, step by step: a predictor, a control, then fixed effects."""
    rows = _regression_rows(spark, d)
    steps = [("(1)", ["n_lines"], []), ("(2)", ["n_lines", "discount"], []), ("(3)", ["n_lines", "discount"], ["o_orderpriority", "month"]), ("(4)", ["n_lines", "discount"], ["o_custkey"])]
    fits = [(name, stats.ols(rows, "y", x, fe)) for name, x, fe in steps]
    return spark.createDataFrame([(n, f["n"], f["r2"], f["within_r2"]) for n, f in fits], "model string, n_obs bigint, r2 double, within_r2 double")


_XY = "(select ln(1 + o_totalprice) as y, n as x, (o_orderstatus = 'F')::int::double as won, o_orderpriority as lvl, o_custkey from orders join (select l_orderkey, count(*)::double as n from lineitem group by 1) on l_orderkey = o_orderkey)"
_CLOSED = """m as (select {by} count(*)::double as n, avg(x) as mx, avg({y}) as my from {rows} group by all),
b as (select {by} any_value(n) as n, any_value(mx) as mx, any_value(my) as my, sum((x - mx) * ({y} - my)) / sum((x - mx) * (x - mx)) as slope, sum((x - mx) * (x - mx)) as sxx, sum(({y} - my) * ({y} - my)) as syy from {rows} join m {on} group by all),
e as (select {by} b.n, slope, my - slope * mx as intercept, sxx, syy, sum(power({y} - my - slope * (x - mx), 2)) as rss, sum(power((x - mx) * ({y} - my - slope * (x - mx)), 2)) as mid from {rows} join b {on} group by all)"""


def _simple(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("lvl"), F.log1p("o_totalprice").alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("won"))
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("x"))
    return o.join(n, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


@query(
    "ols_simple_hc1",
    "with " + _CLOSED.format(by="", y="y", rows=_XY, on="on true") + " select 'x' as term, round(slope, 9) as estimate, round(sqrt(n / (n - 2) * mid) / sxx, 9) as se, round(1 - rss / syy, 9) as r2, cast(n as bigint) as n_obs from e",
)
def ols_simple_hc1(spark, d):
    """One predictor with robust errors, which closed sums in SQL give as well."""
    fit = stats.ols(_simple(spark, d), "y", ["x"])
    e = fit["terms"]["x"]
    return spark.createDataFrame([("x", round(e["estimate"], 9), round(e["se"], 9), round(fit["r2"], 9), fit["n"])], "term string, estimate double, se double, r2 double, n_obs bigint")


@query(
    "ols_within",
    f"""with r as (select y - avg(y) over (partition by lvl) as y, x - avg(x) over (partition by lvl) as x, y as raw, lvl from {_XY} qualify count(*) over (partition by lvl) > 1),
b as (select count(*)::double as n, count(distinct lvl) as g, sum(x * y) / sum(x * x) as slope, sum(x * x) as sxx, sum(y * y) as syy, sum(raw * raw) - power(sum(raw), 2) / count(*) as sst from r),
e as (select any_value(n) as n, any_value(g) as g, any_value(slope) as slope, any_value(sxx) as sxx, any_value(syy) as syy, any_value(sst) as sst, sum(power(y - slope * x, 2)) as rss, sum(power(x * (y - slope * x), 2)) as mid from r, b)
select 'x' as term, round(slope, 9) as estimate, round(sqrt(n / (n - 1 - g) * mid) / sxx, 9) as se, round(1 - rss / sst, 7) as r2, round(1 - rss / syy, 9) as within_r2 from e""",
)
def ols_within(spark, d):
    """One predictor with the levels of a fixed effect absorbed."""
    fit = stats.ols(_simple(spark, d), "y", ["x"], ["lvl"])
    e = fit["terms"]["x"]
    return spark.createDataFrame([("x", round(e["estimate"], 9), round(e["se"], 9), round(fit["r2"], 7), round(fit["within_r2"], 9))], "term string, estimate double, se double, r2 double, within_r2 double")


@query(
    "lpm_by_popularity",
    f"""with s as (select o_custkey, count(*) as k from {_XY} group by 1), q as (select median(k) as m from s), rows_ as (select r.*, case when k > m then 'high' else 'low' end as part from {_XY} r join s using (o_custkey), q),
"""
    + _CLOSED.format(by="part,", y="won", rows="rows_", on="using (part)")
    + " select part, round(slope, 9) as estimate, round(sqrt(n / (n - 2) * mid) / sxx, 9) as se, cast(n as bigint) as n_obs from e",
)
def lpm_by_popularity(spark, d):
    """A binary outcome by least squares, refitted for authors above and not above the median number of posts."""
    rows = _simple(spark, d)
    size = rows.groupBy("o_custkey").agg(F.count("*").alias("k"))
    m = stats.quantiles(size, "k", {"m": 0.5}).scalar()
    marked = rows.join(size, "o_custkey").withColumn("part", F.when(F.col("k") > m, "high").otherwise("low"))
    out = []
    for part in ("high", "low"):
        fit = stats.ols(marked.where(F.col("part") == part), "won", ["x"])
        if "x" in fit["terms"]:
            out.append((part, round(fit["terms"]["x"]["estimate"], 9), round(fit["terms"]["x"]["se"], 9), fit["n"]))
    return spark.createDataFrame(out, "part string, estimate double, se double, n_obs bigint")


@query("welch_stars", """with g as (select o_orderpriority as grp, count(*)::double as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), r as (select * from g where grp = '5-LOW')
select g.grp, case when abs((g.m - r.m) / sqrt(g.v / g.n + r.v / r.n)) > 3.3 then '***' when abs((g.m - r.m) / sqrt(g.v / g.n + r.v / r.n)) < 1.9 then '' else null end as sure from g, r where g.grp <> '5-LOW'""")
def welch_stars(spark, d):
    """Stars of the differences from the reference where they are beyond doubt, else null."""
    w = stats.welch(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", "5-LOW")
    t = F.abs("t")
    return w.select("grp", F.when((t > 3.3) | (t < 1.9), S.stars(F.col("p"))).alias("sure"))
