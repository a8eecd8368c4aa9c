"""Queries on claims: roll-ups, cascades, audits, agreement with gold labels.

Claims are made from lineitem: an order is a document, its line number the claim's position, and the part and supplier
keys choose a verdict and a stance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import keyed as K
from tallyloom.plans.registry import query
from tallyloom.session import table

# Verdicts and stances by number.
VERDICT_OF = ["false", "mostly_false", "mixed", "mostly_true", "true", "unverified"]
STANCE_OF = ["asserted", "quoted", "unclear"]

_CASE_V = "case l_partkey % 6 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(VERDICT_OF)) + " end"
_CASE_S = "case l_suppkey % 3 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(STANCE_OF)) + " end"
_CLAIMS = f"(select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as claim_idx, {_CASE_V} as verdict, {_CASE_S} as stance from lineitem)"
_ORD = "case verdict " + " ".join(f"when '{v}' then {k}" for v, k in S.VERDICTS.items()) + " end"


def _pick(c: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(c, F.lit(len(names))) + 1).cast("int"))


def claims(spark, d) -> DataFrame:
    """One row for each claim; positions are numbered anew, as line numbers may repeat."""
    position = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), position.alias("claim_idx"),
        _pick(F.col("l_partkey"), VERDICT_OF).alias("verdict"), _pick(F.col("l_suppkey"), STANCE_OF).alias("stance"),
    )


def ordinal(verdict: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in S.VERDICTS.items() for x in kv)), verdict)


def counting(verdict: Column, stance: Column) -> Column:
    """Does a claim count for its post's label? On the false side only asserted ones do, on the true side all."""
    return F.when(verdict.isin(*S.FALSE_SIDE), stance == "asserted").otherwise(verdict.isin("mixed", *S.TRUE_SIDE))


def rollup_six(df: DataFrame) -> DataFrame:
    """(doc_id, final_label, ordinal): the least true verdict among the counting claims, else unverified."""
    low = F.min(F.when(counting(F.col("verdict"), F.col("stance")), ordinal(F.col("verdict"))))
    label = F.coalesce(F.get(F.array(*map(F.lit, S.VERDICTS)), low), F.lit("unverified"))
    return df.groupBy("doc_id").agg(label.alias("final_label"), low.alias("ordinal"))


_COUNT = "case when verdict in ('false', 'mostly_false') then stance = 'asserted' else verdict in ('mixed', 'mostly_true', 'true') end"
_SIX = f"(select doc_id, coalesce(case min(case when {_COUNT} then {_ORD} end) " + " ".join(f"when {k} then '{v}'" for v, k in S.VERDICTS.items()) + f" end, 'unverified') as final_label, min(case when {_COUNT} then {_ORD} end) as ordinal from {_CLAIMS} group by 1)"


@query("claim_rollup_6class", f"select * from {_SIX}")
def claim_rollup_6class(spark, d):
    return rollup_six(claims(spark, d))


@query(
    "verdict_counts",
    f"select doc_id, verdict, count(*) as n from {_CLAIMS} group by all",
)
def verdict_counts(spark, d):
    """Counts of each verdict of a document, by way of the map kept with its label."""
    n = claims(spark, d).groupBy("doc_id", "verdict").agg(F.count("*").alias("n"))
    maps = n.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("verdict_counts"))
    return maps.select("doc_id", F.explode("verdict_counts").alias("verdict", "n"))


def rollup_three(df: DataFrame) -> DataFrame:
    false = F.count_if((F.col("verdict") == "false") & (F.col("stance") == "asserted")) > 0
    true = F.count_if(F.col("verdict") == "true") > 0
    return df.groupBy("doc_id").agg(F.when(false, "misinformation").when(true, "true").otherwise("unverified").alias("final_label"))


_THREE = f"(select doc_id, case when count(*) filter (where verdict = 'false' and stance = 'asserted') > 0 then 'misinformation' when count(*) filter (where verdict = 'true') > 0 then 'true' else 'unverified' end as final_label from {_CLAIMS} group by 1)"


@query("claim_rollup_3class", f"select * from {_THREE}")
def claim_rollup_3class(spark, d):
    return rollup_three(claims(spark, d))


_SUMMARY = {
    "n_claims": "true",
    "n_asserted": "stance = 'asserted'",
    "n_nonasserted": "stance <> 'asserted'",
    "n_classified": "verdict <> 'unverified'",
    "n_unverified": "verdict = 'unverified'",
    "n_asserted_false": "stance = 'asserted' and verdict in ('false', 'mostly_false')",
    "n_asserted_true": "stance = 'asserted' and verdict in ('mixed', 'mostly_true', 'true')",
    "n_asserted_unverified": "stance = 'asserted' and verdict = 'unverified'",
}


def claim_summary(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts of claims by stance and verdict for every document, 0 for those without claims."""
    counts = df.groupBy("doc_id").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in _SUMMARY.items()))
    return docs.join(counts, "doc_id", "left").na.fill(0, list(_SUMMARY))


@query(
    "claim_status_summary",
    "select o_orderkey as doc_id, " + ", ".join(f"count(doc_id) filter (where {c}) as {n}" for n, c in _SUMMARY.items()) + f" from orders left join {_CLAIMS} on doc_id = o_orderkey group by 1",
)
def claim_status_summary(spark, d):
    return claim_summary(claims(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")))


@query(
    "title_measure",
    f"""select doc_id, case when count(*) filter (where stance = 'asserted' and verdict in ('false', 'mostly_false')) > 0 then 1 when count(*) filter (where stance = 'asserted' and verdict in ('mostly_true', 'true')) > 0 then 0 end as title_false,
  count(*) filter (where stance = 'asserted' and verdict in ('false', 'mostly_false')) > 0 and count(*) filter (where stance = 'asserted' and verdict in ('mostly_true', 'true')) > 0 as mixed,
  arg_min(verdict, claim_idx) as first_verdict, arg_min(stance, claim_idx) as first_stance from {_CLAIMS} group by 1""",
)
def title_measure(spark, d):
    asserted = F.col("stance") == "asserted"
    false = F.count_if(asserted & F.col("verdict").isin(*S.FALSE_SIDE)) > 0
    true = F.count_if(asserted & F.col("verdict").isin(*S.TRUE_SIDE)) > 0
    return claims(spark, d).groupBy("doc_id").agg(
        F.when(false, 1).when(true, 0).alias("title_false"), (false & true).alias("mixed"),
        F.min_by("verdict", "claim_idx").alias("first_verdict"), F.min_by("stance", "claim_idx").alias("first_stance"),
    )


def cascade(first: DataFrame, second: DataFrame) -> DataFrame:
    """First model's label unless unverified; then the second model's, if it has the document.

    The ordinal is blank where the second model decides; a committed label never changes.
    """
    b = second.select("doc_id", F.col("final_label").alias("__second"))
    falls = F.col("final_label") == "unverified"
    return first.join(b, "doc_id", "left").select(
        "doc_id",
        F.when(falls & F.col("__second").isNotNull(), F.col("__second")).otherwise(F.col("final_label")).alias("final_label"),
        F.when(falls, None).otherwise(F.col("ordinal")).alias("ordinal"),
        F.when(~falls, "model3").when(F.col("__second").isNotNull(), "model1_fallback").otherwise("model3_unverified_no_model1_row").alias("label_source"),
    )


#: The second model reads titles: an order has one if some line was returned or refused, as its flag says.
_TITLED = f"(select * from {_THREE} semi join (select distinct l_orderkey as doc_id from lineitem where l_returnflag <> 'N') using (doc_id))"


def titled(spark, d, df: DataFrame) -> DataFrame:
    return df.join(table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("doc_id")).distinct(), "doc_id", "left_semi")


_CASCADE = f"""(select a.doc_id, case when a.final_label = 'unverified' and b.final_label is not null then b.final_label else a.final_label end as final_label,
  case when a.final_label = 'unverified' then null else a.ordinal end as ordinal,
  case when a.final_label <> 'unverified' then 'model3' when b.final_label is not null then 'model1_fallback' else 'model3_unverified_no_model1_row' end as label_source
from {_SIX} a left join {_TITLED} b using (doc_id))"""


def _cascaded(spark, d) -> DataFrame:
    c = claims(spark, d)
    return cascade(rollup_six(c), titled(spark, d, rollup_three(c)))


@query("cascade_label", f"select * from {_CASCADE}")
def cascade_label(spark, d):
    """The second model has no row for documents without a title."""
    return _cascaded(spark, d)


@query("label_sources", f"select label_source, final_label, count(*) as n from {_CASCADE} group by all")
def label_sources(spark, d):
    return _cascaded(spark, d).groupBy("label_source", "final_label").agg(F.count("*").alias("n"))


@query("stance_audit", f"select * from (select 'body' as source, coalesce(nullif(trim(stance), ''), '(blank/missing)') as stance, count(*) as n from {_CLAIMS} group by all union all select 'title', coalesce(nullif(trim(stance), ''), '(blank/missing)'), count(*) from {_CLAIMS} where claim_idx = 1 group by all)")
def stance_audit(spark, d):
    c = claims(spark, d)
    both = c.select(F.lit("body").alias("source"), "stance").unionByName(c.where("claim_idx = 1").select(F.lit("title").alias("source"), "stance"))
    stance = F.coalesce(F.nullif(F.trim("stance"), F.lit("")), F.lit("(blank/missing)"))
    return both.groupBy("source", stance.alias("stance")).agg(F.count("*").alias("n")).orderBy("source", F.desc("n"), "stance")


_ROLE = "case when verdict in ('false', 'mostly_false') then case when stance = 'asserted' then 'trigger' else 'quoted_false' end when verdict in ('mixed', 'mostly_true', 'true') then 'true_side' else 'unverified' end"


@query("claim_roles", f"select {_ROLE} as role, stance, count(*) as n from {_CLAIMS} group by all")
def claim_roles(spark, d):
    return claims(spark, d).groupBy(S.claim_role(F.col("verdict"), F.col("stance")).alias("role"), "stance").agg(F.count("*").alias("n"))


_BIN = "case when {0} in ('misinformation', 'false', 'mostly_false') then 'misinfo' when {0} in ('ok', 'mixed', 'mostly_true', 'true') then 'ok' else 'abstain' end"


@query(
    "review_by_post",
    f"""select doc_id, {_BIN.format('final_label')} as pred, final_label, n_trigger, c.final_label3 is not null and {_BIN.format('final_label')} <> 'abstain' and {_BIN.format('c.final_label3')} <> 'abstain' and {_BIN.format('final_label')} <> {_BIN.format('c.final_label3')} as disagree
from {_SIX} a join (select doc_id, count(*) filter (where {_ROLE} = 'trigger') as n_trigger from {_CLAIMS} group by 1) b using (doc_id)
left join (select doc_id, final_label as final_label3 from {_TITLED}) c using (doc_id)""",
)
def review_by_post(spark, d):
    """One row for each post with its binary label, number of triggers and whether the two models disagree; worst first."""
    c = claims(spark, d)
    three = titled(spark, d, rollup_three(c)).select("doc_id", F.col("final_label").alias("l3"))
    n = c.groupBy("doc_id").agg(F.count_if(S.claim_role(F.col("verdict"), F.col("stance")) == "trigger").alias("n_trigger"))
    a, b = S.binary_label(F.col("final_label")), S.binary_label(F.col("l3"))
    rows = rollup_six(c).join(n, "doc_id").join(three, "doc_id", "left")
    disagree = F.col("l3").isNotNull() & (a != "abstain") & (b != "abstain") & (a != b)
    order = K.mapped_order(F.col("pred"), ["misinfo", "ok", "abstain"])
    return rows.select("doc_id", a.alias("pred"), "final_label", "n_trigger", disagree.alias("disagree")).orderBy(order, "doc_id")


def classification_metrics(df: DataFrame, gold: str, pred: str, by: list[str], positive: str = "misinfo", negative: str = "ok") -> DataFrame:
    """Scored and excluded rows, accuracy, precision, recall, F1 and macro-F1; other predictions abstain and are counted apart."""
    g, p = F.col(gold), F.col(pred)
    n = lambda c: F.count_if(c).cast("double")
    scored = p.isin(positive, negative)
    tp, fn = n((g == positive) & (p == positive)), n((g == positive) & (p == negative))
    fp, tn = n((g == negative) & (p == positive)), n((g == negative) & (p == negative))
    cells = df.groupBy(*by).agg(F.count_if(scored).alias("n_scored"), F.count_if(~scored).alias("n_excluded"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    f1, f0 = div("2 * tp", "2 * tp + fp + fn"), div("2 * tn", "2 * tn + fp + fn")
    r = lambda c: F.round(c, 9)
    return cells.select(
        *by, "n_scored", "n_excluded", r(div("tp + tn", "tp + tn + fp + fn")).alias("accuracy"), r(div("tp", "tp + fp")).alias("precision"),
        r(div("tp", "tp + fn")).alias("recall"), r(f1).alias("f1"), r((f1 + f0) / 2).alias("macro_f1"),
    )


_GOLD = "case when o_custkey % 3 = 0 then 'misinfo' else 'ok' end"
_FULL = f"(select o_orderkey, {_GOLD} as gold, coalesce(final_label, 'no_checkworthy_claim') as lab from orders left join (select * from {_SIX} semi join (select distinct l_orderkey as doc_id from lineitem where l_linestatus = 'F') using (doc_id)) on doc_id = o_orderkey)"
_VIEWS = f"(select 'FULL' as view, gold, case when lab = 'no_checkworthy_claim' then 'ok' else {_BIN.format('lab')} end as pred from {_FULL} union all select 'MATCHED', gold, {_BIN.format('lab')} from {_FULL} where lab <> 'no_checkworthy_claim')"


def _views(spark, d) -> DataFrame:
    """Gold labels with predictions: FULL fills missing predictions as ok, MATCHED leaves them out."""
    gold = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") % 3 == 0, "misinfo").otherwise("ok").alias("gold"))
    done = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("doc_id")).distinct()  # predictions exist for these
    pred = rollup_six(claims(spark, d)).join(done, "doc_id", "left_semi").select("doc_id", "final_label")
    rows = gold.join(pred, "doc_id", "left").withColumn("lab", F.coalesce("final_label", F.lit("no_checkworthy_claim")))
    none = F.col("lab") == "no_checkworthy_claim"
    full = rows.select(F.lit("FULL").alias("view"), "gold", F.when(none, "ok").otherwise(S.binary_label(F.col("lab"))).alias("pred"))
    return full.unionByName(rows.where(~none).select(F.lit("MATCHED").alias("view"), "gold", S.binary_label(F.col("lab")).alias("pred")))


@query(
    "binary_metrics_full_matched",
    f"""with c as (select view, count(*) filter (where pred <> 'abstain') as n_scored, count(*) filter (where pred = 'abstain') as n_excluded,
  count(*) filter (where gold = 'misinfo' and pred = 'misinfo')::double as tp, count(*) filter (where gold = 'misinfo' and pred = 'ok')::double as fn,
  count(*) filter (where gold = 'ok' and pred = 'misinfo')::double as fp, count(*) filter (where gold = 'ok' and pred = 'ok')::double as tn from {_VIEWS} group by 1)
select view, n_scored, n_excluded, round((tp + tn) / (tp + tn + fp + fn), 9) as accuracy, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall,
  round(2 * tp / (2 * tp + fp + fn), 9) as f1, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) as macro_f1 from c""",
)
def binary_metrics_full_matched(spark, d):
    return classification_metrics(_views(spark, d), "gold", "pred", ["view"])


@query("outcome_matrix", f"select view, case when pred not in ('misinfo', 'ok') then 'ABSTAIN' when gold = 'misinfo' and pred = 'misinfo' then 'TP' when gold = 'misinfo' then 'FN' when pred = 'misinfo' then 'FP' else 'TN' end as outcome, count(*) as n from {_VIEWS} group by all")
def outcome_matrix(spark, d):
    return _views(spark, d).groupBy("view", S.outcome(F.col("gold"), F.col("pred")).alias("outcome")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Observed agreement and Cohen's kappa of two binary labels (1 or 0)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb")
    )
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select(*by, "n", F.round("po", 9).alias("agreement"), F.round(F.try_divide(F.col("po") - pe, 1 - pe), 9).alias("kappa"))


@query(
    "cohen_kappa",
    f"""with r as (select view, gold = 'misinfo' as g, pred = 'misinfo' as p from {_VIEWS} where pred <> 'abstain'),
m as (select view, count(*) as n, avg((g = p)::int) as po, avg(g::int) as pa, avg(p::int) as pb from r group by 1)
select view, n, round(po, 9) as agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) as kappa from m""",
)
def cohen_kappa(spark, d):
    r = _views(spark, d).where("pred <> 'abstain'").select("view", (F.col("gold") == "misinfo").cast("int").alias("g"), (F.col("pred") == "misinfo").cast("int").alias("p"))
    return agreement(r, "g", "p", ["view"])


@query(
    "ordinal_agreement",
    f"""select count(*) as n, round(avg((a.o = b.o)::int), 9) as exact, round(avg((abs(a.o - b.o) <= 1)::int), 9) as within_one, round(avg(a.o - b.o), 9) as signed
from (select doc_id, {_ORD} as o from {_CLAIMS} where claim_idx = 1) a join (select doc_id, {_ORD} as o from {_CLAIMS} where claim_idx = 2) b using (doc_id) where a.o is not null and b.o is not null""",
)
def ordinal_agreement(spark, d):
    """Exact and within-one agreement of two raters on the ordered verdicts, and the mean signed difference."""
    c = claims(spark, d).withColumn("o", ordinal(F.col("verdict")))
    pair = c.where("claim_idx = 1").select("doc_id", F.col("o").alias("a")).join(c.where("claim_idx = 2").select("doc_id", F.col("o").alias("b")), "doc_id").where("a is not null and b is not null")
    diff = F.col("a") - F.col("b")
    return pair.agg(
        F.count("*").alias("n"), F.round(F.avg((diff == 0).cast("int")), 9).alias("exact"), F.round(F.avg((F.abs(diff) <= 1).cast("int")), 9).alias("within_one"), F.round(F.avg(diff), 9).alias("signed")
    )


@query("verdict_confusion", f"select v as verdict, {', '.join(f'count(*) filter (where b.verdict = {chr(39)}{x}{chr(39)}) as {x}' for x in VERDICT_OF)} from (select unnest([{', '.join(repr(v) for v in VERDICT_OF)}]) as v) left join (select * from {_CLAIMS} where claim_idx = 1) a on a.verdict = v left join (select * from {_CLAIMS} where claim_idx = 2) b on b.doc_id = a.doc_id group by 1")
def verdict_confusion(spark, d):
    """A confusion matrix with all rows and columns in a fixed set, zeros filled."""
    c = claims(spark, d)
    pair = c.where("claim_idx = 1").select("doc_id", "verdict").join(c.where("claim_idx = 2").select("doc_id", F.col("verdict").alias("other")), "doc_id")
    wide = pair.groupBy("verdict").pivot("other", VERDICT_OF).count()
    return spark.createDataFrame([(v,) for v in VERDICT_OF], "verdict string").join(wide, "verdict", "left").na.fill(0)


@query("last_verdict_wins", f"select doc_id, arg_max(verdict, claim_idx) as verdict from {_CLAIMS} group by 1")
def last_verdict_wins(spark, d):
    return K.last_wins(claims(spark, d), ["doc_id"], "verdict", "claim_idx")


@query("verdict_keys_union", f"select coalesce(a.doc_id, b.doc_id) as doc_id, a.doc_id is not null as in_orders, b.doc_id is not null as in_claims from (select o_orderkey as doc_id from orders where o_orderpriority <> '5-LOW') a full join (select distinct doc_id from {_CLAIMS} where verdict = 'false') b using (doc_id)")
def verdict_keys_union(spark, d):
    a = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("doc_id")).withColumn("in_orders", F.lit(True))
    b = claims(spark, d).where("verdict = 'false'").select("doc_id").distinct().withColumn("in_claims", F.lit(True))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("in_orders", F.lit(False)).alias("in_orders"), F.coalesce("in_claims", F.lit(False)).alias("in_claims"))


@query("claim_list_shape", f"select doc_id, array_length(list_slice(list(verdict order by claim_idx), 1, 3)) as n_kept, array_to_string(list_slice(list(verdict order by claim_idx), 1, 3), ',') as kept from {_CLAIMS} where verdict <> 'unverified' group by 1")
def claim_list_shape(spark, d):
    """First three usable claims of each document, in order."""
    lists = claims(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("claim_idx", "verdict"))).alias("all"))
    kept = lists.withColumn("kept", F.slice(F.filter("all", lambda c: c["verdict"] != "unverified"), 1, 3)).where(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("bigint").alias("n_kept"), F.array_join(F.transform("kept", lambda c: c["verdict"]), ",").alias("kept"))
