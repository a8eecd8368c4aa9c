"""Further queries: reviews of claims, keyed scans, requests to models, catalogues, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import cleaning as C
from tallyloom.functions import prompts as M
from tallyloom.functions import scalars as S
from tallyloom.operators import keyed as K
from tallyloom.operators.language import language_profile
from tallyloom.plans import claims as CL
from tallyloom.plans import posts as P
from tallyloom.plans.registry import query
from tallyloom.session import table
from tallyloom.sources import remote


@query("review_by_claim", f"select c.doc_id, claim_idx, verdict, stance, {CL._ROLE} as role, final_label from {CL._CLAIMS} c join {CL._SIX} p using (doc_id)")
def review_by_claim(spark, d):
    """Every claim with its part in the label of its post."""
    c = CL.claims(spark, d)
    return c.join(CL.rollup_six(c).select("doc_id", "final_label"), "doc_id").select(
        "doc_id", "claim_idx", "verdict", "stance", S.claim_role(F.col("verdict"), F.col("stance")).alias("role"), "final_label"
    )


@query("scan_by_keys", "select o_orderkey, o_custkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def scan_by_keys(spark, d):
    keys = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return remote.scan_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), keys, ["o_custkey"])


@query("valid_accounts", r"select distinct lower(trim(author)) as author from hive_classified where regexp_matches(lower(trim(author)), '^[a-z0-9.\-]{3,16}$')")
def valid_accounts(spark, d):
    return remote.valid_accounts(table(spark, d, "hive_classified"), "author")


@query("post_columns", "select column_name, row_number() over (order by column_index) as position from duckdb_columns() where table_name = 'orders'")
def post_columns(spark, d):
    return remote.columns_of(table(spark, d, "orders")).select("column_name", F.col("position").cast("bigint").alias("position"))


@query(
    "classification_requests",
    """select distinct author, permlink, case when title is null then 'Text:' else 'Title:' end as opens, least(length(coalesce(title, '')), 300) as title_chars, least(length(coalesce(body_clean, '')), 1500) as body_chars from hive_classified where body_clean is not null""",
)
def classification_requests(spark, d):
    """The messages that would ask a model for each post's class, described by their opening and sizes."""
    posts = table(spark, d, "hive_classified").where("body_clean is not null").select("author", "permlink", "title", "body_clean").distinct()
    asked = posts.withColumn("m", M.classification_request(F.col("title"), F.col("body_clean"), ["gaming", "personal"]))
    user = F.get_json_object("m", "$[1].content")
    return asked.select(
        "author", "permlink", F.regexp_extract(user, "^(Title:|Text:)", 1).alias("opens"),
        F.least(F.length(F.coalesce("title", F.lit(""))), F.lit(300)).alias("title_chars"), F.least(F.length(F.coalesce("body_clean", F.lit(""))), F.lit(1500)).alias("body_chars"),
    ).distinct()


@query("posts_eligible", "select distinct author, permlink from hive_cleaned where not regexp_matches(permlink, 'part-|post-') and author not in ('marlow-daily') and author || '/' || permlink in (select doc_id from gate_scores where cb_n_checkworthy > 0)")
def posts_eligible(spark, d):
    """Posts by no barred author, without barred parts of names, with at least one claim."""
    scored = table(spark, d, "gate_scores").where("cb_n_checkworthy > 0").select("doc_id").distinct()
    posts = table(spark, d, "hive_cleaned").select("author", "permlink").distinct().where(~F.col("permlink").rlike("part-|post-") & ~F.col("author").isin("marlow-daily"))
    return posts.withColumn("doc_id", F.concat("author", F.lit("/"), "permlink")).join(scored, "doc_id", "left_semi").select("author", "permlink")


# Function words by which the stand-in detector knows three languages.
_WORDS_OF = {"en": "the and of to in is was it for that we my", "es": "el la los de que y en un una para con por", "de": "der die das und ist nicht ein eine mit auf ich zu"}


def _is_one_of(words):
    return lambda w: w.isin(*words)


def rule_detector(sentence):
    """A stand-in for a detector of languages: the one of three whose function words are most, the first among equals, unless there are none."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit(r"\p{L}+"), F.lit(0))
    en, es, de = (F.size(F.filter(words, _is_one_of(_WORDS_OF[k].split(" ")))) for k in _WORDS_OF)
    return F.when(en + es + de == 0, "und").when((en >= es) & (en >= de), "en").when(es >= de, "es").otherwise("de")


_N = {k: rf"len(list_filter(regexp_extract_all(lower(s), '\p{{L}}+'), lambda w: list_contains({v.split(' ')}, w)))" for k, v in _WORDS_OF.items()}
_DETECT = f"case when {_N['en']} + {_N['es']} + {_N['de']} = 0 then 'und' when {_N['en']} >= {_N['es']} and {_N['en']} >= {_N['de']} then 'en' when {_N['es']} >= {_N['de']} then 'es' else 'de' end"
_PROFILE = rf"""(with t as (select author, permlink, any_value(coalesce(body_clean, '')) as t from hive_english_filtered where author is not null and permlink is not null group by 1, 2),
lines as (select author, permlink, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from t),
parts as (select author, permlink, k, unnest(string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) as j from lines),
clean as (select author, permlink, k, j, {P.sql_chain("s", P._LANG_STEPS)} as s from parts),
judged as (select author, permlink, k, j, length(s) as n, {_DETECT} as l from clean where length(s) >= 15),
per as (select author, permlink, l, sum(n) as n, min((k, j)) as first from judged group by all),
best as (select author, permlink, sum(n) as total, sum(n) filter (where l = 'en') as own, arg_max(l, (n, -first[1], -first[2])) as l from per group by all)
select t.author, t.permlink, case when trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' then 'empty' when coalesce(total, 0) < 30 then 'too_short' when coalesce(own, 0) / total::double >= 0.9 then 'kept' else 'dropped_low_english' end as lang_status,
  case when coalesce(total, 0) < 30 then 0 else round(coalesce(own, 0) / total::double, 9) end as pct_english, case when coalesce(total, 0) < 30 then '' else l end as dominant_lang from t left join best using (author, permlink))"""


def _profiles(spark, d):
    posts = table(spark, d, "hive_english_filtered").where("author is not null and permlink is not null").select("author", "permlink", "body_clean")
    # repeated rows of a post have one text; the smallest is taken where they had several
    posts = posts.groupBy("author", "permlink").agg(F.min("body_clean").alias("body_clean"))
    return language_profile(posts, "body_clean", lambda ss: F.transform(ss, rule_detector)).select(
        "author", "permlink", "lang_status", F.round("pct_english", 9).alias("pct_english"), "dominant_lang"
    )


@query("language_filter", f"select * from {_PROFILE}")
def language_filter(spark, d):
    """Share of English, dominant language and status of every post, sentence by sentence."""
    return _profiles(spark, d)


@query("language_filter_report", f"select lang_status, dominant_lang, count(*) as n_posts, round(100.0 * count(*) / (select count(*) from {_PROFILE}), 2) as pct from {_PROFILE} group by all")
def language_filter_report(spark, d):
    each = _profiles(spark, d)
    n = each.groupBy("lang_status", "dominant_lang").agg(F.count("*").alias("n_posts"))
    return n.select("lang_status", "dominant_lang", "n_posts", F.round(100 * F.col("n_posts") / n.agg(F.sum("n_posts")).scalar(), 2).alias("pct"))


@query("first_per_author", "select author, arg_min(permlink, (created, permlink)) as first_permlink, arg_max(permlink, (created, permlink)) as last_permlink from hive_classified group by 1")
def first_per_author(spark, d):
    key = F.struct("created", "permlink")
    return table(spark, d, "hive_classified").groupBy("author").agg(F.min_by("permlink", key).alias("first_permlink"), F.max_by("permlink", key).alias("last_permlink"))


@query("balanced_spot_check", "select doc_id, high from (select doc_id, cb_max_score > 0.85 as high, row_number() over (partition by cb_max_score > 0.85 order by md5('5|' || doc_id), doc_id) as rn from (select doc_id, max(cb_max_score) as cb_max_score from gate_scores where doc_id is not null and cb_max_score is not null group by 1)) where rn <= 30")
def balanced_spot_check(spark, d):
    """Thirty documents above and thirty at or below the gate."""
    s = table(spark, d, "gate_scores").where("doc_id is not null and cb_max_score is not null").groupBy("doc_id").agg(F.max("cb_max_score").alias("m"))
    return K.sample_each(s.select("doc_id", (F.col("m") > 0.85).alias("high")), ["high"], ["doc_id"], 30, 5)


@query("transcript_texts")
def transcript_texts(spark, d):
    """Texts cleaned as speech, with a capital at the start of each sentence."""
    return table(spark, d, "documents").select("doc_id", M.recapitalize(C.transcript_text(F.col("text"))).alias("clean"))


@query("lexicon_texts")
def lexicon_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", C.lexicon_text(F.col("text")).alias("clean"))
