"""Queries on posts: funnel, keys, money, labels, metadata, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import cleaning as C
from tallyloom.functions import scalars as S
from tallyloom.operators import keyed as K
from tallyloom.operators import stats
from tallyloom.plans.registry import query
from tallyloom.session import table

_POLITICAL = ", ".join(f"'{c}'" for c in S.POLITICAL)
_POSTS = "select distinct author, permlink, created, title, classification, category, lang_status from hive_english_filtered"


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hive_english_filtered").select(
        "author", "permlink", "created", "title", "classification", "category", "lang_status"
    ).distinct()


@query(
    "monthly_report",
    f"""select strftime(created, '%Y-%m') as month, count(*) as n_posts,
  count(*) filter (where coalesce(classification = 'YES' or category in ({_POLITICAL}), false)) as n_political,
  round(100.0 * count(*) filter (where coalesce(classification = 'YES' or category in ({_POLITICAL}), false)) / nullif(count(*), 0), 1) as pct_political
from ({_POSTS}) where lang_status in ('kept', 'kept_bilingual') group by 1""",
)
def monthly_report(spark, d):
    posts = _posts(spark, d).where(F.col("lang_status").isin("kept", "kept_bilingual"))
    political = F.count_if(S.is_political(F.col("classification"), F.col("category")))
    return (
        posts.groupBy(S.month(F.col("created")).alias("month"))
        .agg(F.count("*").alias("n_posts"), political.alias("n_political"), F.round(100 * F.try_divide(political, F.count("*")), 1).alias("pct_political"))
        .orderBy("month")
    )


@query(
    "monthly_rollup",
    f"""select strftime(created, '%Y-%m') as month, count(*) as n_posts from ({_POSTS}) group by rollup(strftime(created, '%Y-%m'))""",
)
def monthly_rollup(spark, d):
    return _posts(spark, d).withColumn("month", S.month(F.col("created"))).rollup("month").agg(F.count("*").alias("n_posts"))


@query(
    "weekly_windows",
    """with weeks as (select unnest(generate_series(timestamp '2024-09-01', timestamp '2025-01-20', interval 7 day)) as week_start),
w as (select week_start, least(week_start + interval 7 day, timestamp '2025-01-21') as week_end from weeks),
p as (select distinct author, permlink, created from hive_classified where length(body) > 100)
select week_start, week_end, count(permlink) as n_posts from w left join p on created >= week_start and created < week_end group by all""",
)
def weekly_windows(spark, d):
    """Half-open weeks clamped at the end of the window, with the posts of each; assigned by arithmetic, not a range join."""
    start, end = F.lit("2024-09-01").cast("timestamp_ntz"), F.lit("2025-01-21").cast("timestamp_ntz")
    weeks = spark.range(1).select(F.explode(F.sequence(start, end - F.expr("interval 1 day"), F.expr("interval 7 days"))).alias("week_start"))
    weeks = weeks.withColumn("week_end", F.least(F.col("week_start") + F.expr("interval 7 days"), end))
    posts = table(spark, d, "hive_classified").where("length(body) > 100").select("author", "permlink", F.col("created").cast("timestamp_ntz").alias("created")).distinct()
    posts = posts.where((F.col("created") >= start) & (F.col("created") < end))
    week = start + F.make_dt_interval(days=7 * F.floor(F.date_diff("created", F.lit("2024-09-01")) / 7).cast("int"))
    n = posts.groupBy(week.alias("week_start")).agg(F.count("*").alias("n"))
    return weeks.join(n, "week_start", "left").select("week_start", "week_end", F.coalesce("n", F.lit(0)).alias("n_posts"))


@query(
    "dedupe_keep_first",
    """select author, permlink, created, net_votes, children from (
  select author, permlink, created, net_votes, children, row_number() over (partition by author, permlink
    order by created, net_votes nulls first, children nulls first) as rn from hive_classified) where rn = 1""",
)
def dedupe_keep_first(spark, d):
    cols = table(spark, d, "hive_classified").select("author", "permlink", "created", "net_votes", "children")
    return K.keep_first(cols, ["author", "permlink"], [F.col("created"), F.asc_nulls_first("net_votes"), F.asc_nulls_first("children")])


@query("duplicate_posts", "select author, permlink, count(*) as n_rows from hive_classified group by all having count(*) > 1")
def duplicate_posts(spark, d):
    return K.duplicate_keys(table(spark, d, "hive_classified").select("author", "permlink"), ["author", "permlink"])


_MONEY = "coalesce(try_cast(regexp_extract(trim({0}), '^\\S+') as double), 0)"


@query(
    "post_payouts",
    f"""select author, permlink, 'https://peakd.com/@' || author || '/' || permlink as link, {_MONEY.format("total_payout_value")} as total_num,
  {_MONEY.format("pending_payout_value")} as pending_num, {_MONEY.format("total_payout_value")} + {_MONEY.format("pending_payout_value")} as payout_combined
from hive_classified""",
)
def post_payouts(spark, d):
    t, p = S.parse_money(F.col("total_payout_value")), S.parse_money(F.col("pending_payout_value"))
    return table(spark, d, "hive_classified").select(
        "author", "permlink", S.post_link(F.col("author"), F.col("permlink")).alias("link"),
        t.alias("total_num"), p.alias("pending_num"), (t + p).alias("payout_combined"),
    )


@query(
    "number_forms",
    r"""select author, permlink,
  coalesce(try_cast(total_payout_value as double), try_cast(nullif(regexp_extract(replace(total_payout_value, ',', ''), '(-?\d+(?:\.\d+)?)', 1), '') as double)) as payout,
  case when lower(trim(cast(is_political as varchar))) = 'true' then 1::double when lower(trim(cast(is_political as varchar))) = 'false' then 0::double end as political01
from hive_classified""",
)
def number_forms(spark, d):
    return table(spark, d, "hive_classified").select(
        "author", "permlink", S.to_num(F.col("total_payout_value")).alias("payout"), S.to01(F.col("is_political")).alias("political01")
    )


@query(
    "doc_keys",
    """select distinct doc_id, split_part(doc_id, '/', 1) as author, substr(doc_id, instr(doc_id, '/') + 1) as permlink,
  trim(author) || '/' || trim(permlink) as rebuilt from hive_sample_master""",
)
def doc_keys(spark, d):
    parts = F.split("doc_id", "/", 2)
    return table(spark, d, "hive_sample_master").select(
        "doc_id", F.get(parts, F.lit(0)).alias("author"), F.get(parts, F.lit(1)).alias("permlink"),
        S.post_id(F.col("author"), F.col("permlink")).alias("rebuilt"),
    ).distinct()


@query(
    "time_parts",
    """select distinct author, permlink, hour(created) as post_hour, isodow(created) - 1 as post_dow, case when isodow(created) >= 6 then 1 else 0 end as is_weekend,
  strftime(created, '%Y-%m') as month from hive_classified""",
)
def time_parts(spark, d):
    dow = F.weekday("created")
    return table(spark, d, "hive_classified").select(
        "author", "permlink", F.hour("created").alias("post_hour"), dow.alias("post_dow"), (dow >= 5).cast("int").alias("is_weekend"),
        S.month(F.col("created")).alias("month"),
    ).distinct()


@query(
    "status_counts",
    "select lang_status, count(*) as n, round(100.0 * count(*) / cast(sum(count(*)) over () as bigint), 2) as pct from (" + _POSTS + ") group by 1",
)
def status_counts(spark, d):
    n = _posts(spark, d).groupBy("lang_status").agg(F.count("*").alias("n"))
    return n.select("lang_status", "n", F.round(100 * F.col("n") / n.agg(F.sum("n")).scalar(), 2).alias("pct"))


#: All topics in order, as a topic that is part of a reply's, or the other way round, stands for it; the first does.
_TOPICS = sorted({*S.POLITICAL, *S.NONPOLITICAL})
_TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in _TOPICS) + "]"


@query(
    "label_parse",
    f"""with raw as (select distinct category from hive_classified), r as (select category, trim(coalesce(category, ''), ' ' || chr(9) || chr(10) || chr(13)) as reply from raw),
p as (select *, strpos(reply, '|') > 0 as piped, upper(trim(split_part(reply, '|', 1))) as head, replace(lower(trim(substr(reply, strpos(reply, '|') + 1))), ' ', '_') as tail from r),
q as (select *, case when piped and starts_with(head, 'YES') then 'YES' when piped and starts_with(head, 'NO') then 'NO' else 'PARSE_ERROR' end as label from p)
select category, label, case when label = 'PARSE_ERROR' then left(reply, 50) when list_contains({_TOPIC_LIST}, tail) then tail
  else coalesce(list_filter({_TOPIC_LIST}, lambda v: contains(tail, v) or contains(v, tail))[1], case label when 'YES' then 'other_political' else 'other_noise' end) end as topic from q""",
)
def label_parse(spark, d):
    """Class and topic of a labelling reply `CLASS|topic`; a reply that cannot be read keeps its first 50 characters as topic."""
    reply = C.strip_space(F.coalesce("category", F.lit("")))
    piped = F.instr(reply, F.lit("|")) > 0
    part = lambda k: C.strip_space(F.coalesce(F.get(F.split(reply, r"\|", 2), F.lit(k)), F.lit("")))
    head, tail = F.upper(part(0)), F.replace(F.lower(part(1)), F.lit(" "), F.lit("_"))
    label = F.when(piped & head.startswith("YES"), "YES").when(piped & head.startswith("NO"), "NO").otherwise("PARSE_ERROR")
    topics = F.array(*map(F.lit, _TOPICS))
    near = F.get(F.filter(topics, lambda v: F.contains(F.col("tail"), v) | F.contains(v, F.col("tail"))), F.lit(0))
    rest = F.when(F.col("label") == "YES", "other_political").otherwise("other_noise")
    rows = table(spark, d, "hive_classified").select("category").distinct().select("category", reply.alias("reply"), label.alias("label"), tail.alias("tail"))
    topic = F.when(F.col("label") == "PARSE_ERROR", F.substring("reply", 1, 50)).when(F.array_contains(topics, F.col("tail")), F.col("tail")).otherwise(F.coalesce(near, rest))
    return rows.select("category", "label", topic.alias("topic"))


def _sql_json_len(path: str) -> str:
    return f"case when json_valid(json_metadata) and json_type(json_metadata) = 'OBJECT' and json_type(json_metadata, '{path}') = 'ARRAY' then json_array_length(json_metadata, '{path}') else 0 end"


@query(
    "metadata_counts",
    f"select author, permlink, cast({_sql_json_len('$.tags')} as integer) as n_tags, cast({_sql_json_len('$.image')} as integer) as n_images, cast({_sql_json_len('$.links')} as integer) as n_links from hive_classified",
)
def metadata_counts(spark, d):
    j = F.col("json_metadata")
    return table(spark, d, "hive_classified").select(
        "author", "permlink", *(S.json_list_length(j, f"$.{p}").alias(n) for p, n in (("tags", "n_tags"), ("image", "n_images"), ("links", "n_links")))
    )


_IMG = r"!\[[^\]]*\]\([^)]*\)"


@query(
    "image_link_counts",
    rf"""select distinct doc_id, len(regexp_extract_all(coalesce(text, ''), '{_IMG}')) + len(regexp_extract_all(coalesce(text, ''), '(?i)<img')) as n_images,
  greatest(len(regexp_extract_all(coalesce(text, ''), 'https?://[^\s)\]]+')) - len(regexp_extract_all(coalesce(text, ''), '!\[[^\]]*\]\(https?://[^)]*\)')), 0) as n_links from documents""",
)
def image_link_counts(spark, d):
    t = F.coalesce("text", F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    return table(spark, d, "documents").select(
        "doc_id", (n(_IMG) + n("(?i)<img")).alias("n_images"),
        F.greatest(n(r"https?://[^\s)\]]+") - n(r"!\[[^\]]*\]\(https?://[^)]*\)"), F.lit(0)).alias("n_links"),
    )


_WS2 = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def re2(pattern: str) -> str:
    """A pattern in the dialect of DuckDB, with the white space and word characters of Unicode, as an SQL text."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in (r"\s", r"\w"):
            cls = _WS2 if two == r"\s" else r"\p{L}\p{N}_"
            out.append(cls if inside else f"[{cls}]")
            k += 2
        elif two == r"\S":
            out.append(f"[^{_WS2}]")
            k += 2
        elif pattern[k] == "\\":
            out.append(two)
            k += 2
        else:
            inside = pattern[k] == "[" or inside and pattern[k] != "]"
            out.append(pattern[k])
            k += 1
    return "".join(out).replace("'", "''")


def sql_chain(col: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        col = f"regexp_replace({col}, '{re2(pattern)}', {to if to.startswith('chr') else repr(to)}, 'g')"
    return col


_NL2 = "chr(10) || chr(10)"
_STRIP = (r"^\s+|\s+$", "")
_ANY = r"(?s:.)"
_LANG_STEPS = [
    (f"```{_ANY}*?```", " "), (r"`[^`]+`", " "), (r"https?://\S+|www\.\S+", " "), (r"#\w+", " "), (r"\$[A-Z]{2,10}\b", " "), (r"\b[a-zA-Z0-9]{25,}\b", " "), (r"\s+", " "), _STRIP,
]


@query(
    "clean_body",
    "select doc_id, "
    + sql_chain(
        "coalesce(text, '')",
        [(r"<[^>]+>", ""), (r"!\[[^\n]*?\]\([^\n]*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"#{1,6}\s", ""), (r"\*{1,2}([^*]+)\*{1,2}", r"\1"), (r"\n{3,}", _NL2), _STRIP],
    ).replace("\\\\1", "\\1")
    + " as clean from documents",
)
def clean_body(spark, d):
    return table(spark, d, "documents").select("doc_id", C.clean_body(F.col("text")).alias("clean"))


@query("language_text", "select doc_id, " + sql_chain("coalesce(text, '')", _LANG_STEPS) + " as clean from documents")
def language_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.language_text(F.col("text")).alias("clean"))


@query(
    "plain_post",
    "select doc_id, "
    + sql_chain(
        "coalesce(text, '')",
        [(f"```{_ANY}*?```", " "), (r"`[^`]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"<[^>]+>", " "), (r"https?://\S+|www\.\S+", " "), (r"[#>*_~`|]+", " "), (r"\s+", " "), _STRIP],
    ).replace("\\\\1", "\\1")
    + " as clean from documents",
)
def plain_post(spark, d):
    return table(spark, d, "documents").select("doc_id", C.plain_post(F.col("text")).alias("clean"))


_CODE_NAMES = (
    r"ipython|python|py|javascript|js|typescript|ts|bash|shell|sh|zsh|fish|powershell|ps|cmd|mysql|postgresql|sqlite|sql|json|yaml|yml|toml|ini|xml|java|kotlin|scala|groovy|cpp|c\+\+|csharp|c#|cs|css|c|"
    r"rust|rs|rb|golang|go|php|ruby|perl|lua|html|scss|sass|less|dockerfile|makefile|cmake|matlab|octave|diff|patch|regexp|regex|r"
)
_TAG = "[a-zA-Z0-9_+#-]"
_POST_STEPS = [
    (rf"```(?:(?i:{_CODE_NAMES})(?:[^a-zA-Z0-9_+#-]{_ANY}*?)??|{_TAG}*\s*{_ANY}{{0,99}}?|{_TAG}*\s*({_ANY}*?))```", "chr(57344) || '\\1' || chr(57345)"),
    ("\ue000\ue001", " "),
    ("[\ue000\ue001]", ""),
    (r"`[^`\n]+`", " "),
    (r"https?://\S+|www\.\S+", " "),
    (r"(?m)^\s*\|?[\s:|-]+\|?\s*$", ""),
    (r"(?m)^\s*\|[^\n]*\|\s*$", " "),
    (r"(?m)^\s*(?:[-*_]\s*){3,}\s*$", ""),
    (r"(?m)^\s*#{1,6}\s+", ""),
    (r"(?m)^>\s*", ""),
    (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""),
    (r"(?m)^\s*\[\^[^\]]+\]:[^\n]*$", ""),
    (r"(?im)^\s*posted\s+(?:via|using|with|from|on)\s+[^\n]*$", ""),
    (r"(?:@[a-zA-Z0-9.\-]{3,16}[\s,;]+){4,}@?[a-zA-Z0-9.\-]{0,16}", " "),
    (r"\$[A-Z]{2,10}\b", " "),
    (r"\b[a-zA-Z0-9]{25,}\b", " "),
    (r"\[\^[^\]]+\]", ""),
    (r"~~([^~]+)~~", r"\1"),
    (r"(?:#\w+\s*){2,}\s*$", ""),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    (r"\*{1,3}([^*\n]+?)\*{1,3}", r"\1"),
    *[(r"(^|[^\p{L}\p{N}_])_{1,3}([^_\n]+?)_{1,3}([^\p{L}\p{N}_]|$)", r"\1\2\3")] * 2,  # twice, as neighbours share a character
    (r"\n{3,}", _NL2),
    (r"[ \t]+", " "),
    *[(r"(^|\n)[ \r\x{a0}\x{2000}-\x{200a}\x{3000}]+|[ \r\x{a0}\x{2000}-\x{200a}\x{3000}]+(\n|$)", r"\1\2")] * 2,
    (r"\n{3,}", _NL2),
    _STRIP,
]
_FOOTER_WORDS = "|".join(
    [
        r"thanks?\s+(?:so\s+much\s+)?for\s+(?:reading|stopping\s+by|visiting|watching|taking\s+the\s+time)", r"thank\s+you\s+(?:so\s+much\s+)?for\s+(?:reading|stopping\s+by|visiting|watching|taking\s+the\s+time)",
        r"have\s+a\s+(?:great|wonderful|nice|good|blessed|amazing|productive)\s+(?:day|week|weekend|evening|night|morning)", r"see\s+you\s+(?:tomorrow|soon|next\s+time|in\s+the\s+next\s+post)",
        r"until\s+(?:next\s+time|tomorrow|the\s+next\s+post)", r"don'?t\s+forget\s+to\s+(?:upvote|comment|follow|reblog|like|subscribe)", r"if\s+you\s+(?:liked|enjoyed)\s+this\s+post",
        r"translated\s+(?:with|using)\s+(?:deepl|google\s+translate|chatgpt)", r"for\s+the\s+best\s+experience\s+view\s+this\s+post\s+on",
    ]
)
_CLEAN_POST = f"""with c as (select doc_id, {sql_chain("coalesce(text, '')", _POST_STEPS)} as t from documents),
f as (select *, greatest(length(t) - 400, 0) as start, regexp_replace(substr(t, greatest(length(t) - 400, 0) + 1), '{re2(r"(?is)" + chr(92) + "b(?:" + _FOOTER_WORDS + ")" + chr(92) + "b.*$")}', '') as before from c)
select doc_id, case when length(t) >= 200 and start + length(before) < length(t) and start + length(before) >= 0.5 * length(t) then rtrim(substr(t, 1, start + length(before)), ' ' || chr(9) || '.,;:-' || chr(10)) else t end as clean from f""".replace("\\\\", "\\")


@query("clean_post", _CLEAN_POST)
def clean_post(spark, d):
    return table(spark, d, "documents").select("doc_id", C.clean_post(F.col("text")).alias("clean"))


@query(
    "over_cleaned",
    """with s as (select distinct author, permlink, net_votes, length(body_clean) as before, length(body_for_analysis) as after,
    (length(body_clean) - length(body_for_analysis)) / nullif(cast(length(body_clean) as double), 0) as reduction from hive_cleaned),
q as (select quantile_cont(reduction, 0.95) as p95 from s)
select author, permlink, net_votes, before, after, round(reduction, 9) as reduction from s, q
where (before >= 500 and after < 50) or (reduction >= p95 and net_votes >= 10)""",
)
def over_cleaned(spark, d):
    """Posts that lost nearly all text, or much of it though voted for."""
    s = table(spark, d, "hive_cleaned").select(
        "author", "permlink", "net_votes", F.length("body_clean").alias("before"), F.length("body_for_analysis").alias("after")
    ).distinct().withColumn("reduction", S.reduction_pct(F.col("before"), F.col("after")))
    p95 = stats.quantiles(s, "reduction", {"p95": 0.95}).scalar()
    hit = ((F.col("before") >= 500) & (F.col("after") < 50)) | ((F.col("reduction") >= p95) & (F.col("net_votes") >= 10))
    return s.where(hit).select("author", "permlink", "net_votes", "before", "after", F.round("reduction", 9).alias("reduction"))


_LINES = r"unnest(string_split(coalesce(text, ''), chr(10)))"
_SENTS = r"""(select doc_id, trim(unnest(string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) as s
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents))"""


@query("sentence_counts", f"select doc_id, count(*) as n_sentences, cast(sum(length(s)) as bigint) as n_chars from {_SENTS} where s <> '' group by 1")
def sentence_counts(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(C.sentences(F.coalesce("text", F.lit("")))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


_BOILER = f"""(len(regexp_extract_all(s, '[A-Za-z]+')) < 3 or length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) < 0.5 * length(regexp_replace(s, '[{_WS2}]', '', 'g'))
  or regexp_matches(s, '(?i)https?://|www\\.') or (s like '%:' and length(s) < 60) or regexp_matches(s, '^(?:[^\\p{{L}}\\p{{N}}_]|_)*[◯∴•▶►★☆✔✅➤·\\-=~*]+[{_WS2}]|^[{_WS2}]*#[\\p{{L}}\\p{{N}}_]'))"""


@query("boilerplate_share", f"select doc_id, count(*) as n_sentences, count(*) filter (where {_BOILER}) as n_flagged, round(avg(case when {_BOILER} then 1.0 else 0.0 end), 9) as share from {_SENTS} where s <> '' group by 1")
def boilerplate_share(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(C.sentences(F.coalesce("text", F.lit("")))).alias("s"))
    flag = C.is_boilerplate(F.col("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(flag).alias("n_flagged"), F.round(F.avg(flag.cast("double")), 9).alias("share"))


#: Sides of the example dictionary, as a query's parameter.
DICTIONARY = {"left": ["welfare office", "wage law", "asylum rules", "student debt"], "right": ["payroll tax", "border bill", "swamp", "echo chamber"]}


def phrase_pattern(phrases: list[str]) -> str:
    """One alternation, the longest phrases first."""
    return r"\b(?:" + "|".join(sorted(set(phrases), key=lambda p: (-len(p), p))) + r")\b"


_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9@ ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(
    "dictionary_counts",
    "select doc_id, n_words, n_left, n_right, round(ln(1 + n_left), 9) as log_left, round(100.0 * n_left / nullif(n_words, 0), 9) as left_per_100, n_left + n_right > 0 as any_hit from (select doc_id, "
    + rf"len(regexp_extract_all({_NORM}, '\S+')) as n_words, len(regexp_extract_all({_NORM}, '{phrase_pattern(DICTIONARY['left'])}')) as n_left, len(regexp_extract_all({_NORM}, '{phrase_pattern(DICTIONARY['right'])}')) as n_right from documents)",
)
def dictionary_counts(spark, d):
    norm = C.dictionary_text(F.coalesce("text", F.lit("")))
    n = lambda p: F.regexp_count("norm", F.lit(p)).cast("bigint")
    rows = table(spark, d, "documents").select("doc_id", norm.alias("norm")).select(
        "doc_id", n(r"\S+").alias("n_words"), *(n(phrase_pattern(p)).alias(f"n_{side}") for side, p in DICTIONARY.items())
    )
    return rows.withColumns(
        {
            "log_left": F.round(F.log1p("n_left"), 9),
            "left_per_100": F.round(100 * F.try_divide("n_left", "n_words"), 9),
            "any_hit": F.col("n_left") + F.col("n_right") > 0,
        }
    )


@query(
    "phrase_tallies",
    rf"""select phrase, count(*) as n from (select unnest(regexp_extract_all({_NORM}, '{phrase_pattern([p for ps in DICTIONARY.values() for p in ps])}')) as phrase from documents) group by 1""",
)
def phrase_tallies(spark, d):
    pattern = phrase_pattern([p for ps in DICTIONARY.values() for p in ps])
    hits = F.regexp_extract_all(C.dictionary_text(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(0))
    return table(spark, d, "documents").select(F.explode(hits).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


@query(
    "lexicon_scores",
    rf"""with tok as (select doc_id, unnest(regexp_extract_all({_NORM}, '[a-z]+')) as w from documents),
lex as (select distinct w, ((length(w) * 7 + ascii(w)) % 100) / 100.0 as valence, ((length(w) * 13 + ascii(w)) % 100) / 100.0 as arousal from tok where length(w) >= 4)
select d.doc_id, count(t.w) as n_tokens, count(valence) as n_matched, round(avg(valence), 9) as valence, round(avg(arousal), 9) as arousal,
  round(count(valence) / nullif(cast(count(t.w) as double), 0), 9) as coverage
from documents d left join tok t using (doc_id) left join lex using (w) group by 1""",
)
def lexicon_scores(spark, d):
    """Means over the tokens that stand in a lexicon; here the lexicon is the table of all words of four letters or more with scores by a rule."""
    docs = table(spark, d, "documents").select("doc_id", F.explode_outer(F.regexp_extract_all(C.dictionary_text(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    rule = lambda k: (F.length("w") * k + F.ascii("w")) % 100 / 100.0
    lexicon = docs.where(F.length("w") >= 4).select("w").distinct().select("w", rule(7).alias("valence"), rule(13).alias("arousal"))
    return lexicon_means(docs, lexicon, ["valence", "arousal"])


#: Words of a lexicon up to which it is broadcast.
BROADCAST_WORDS = 200_000


def lexicon_means(tokens: DataFrame, lexicon: DataFrame, values: list[str]) -> DataFrame:
    """(doc_id, n_tokens, n_matched, a mean for each value, coverage) from tokens (doc_id, w) and a lexicon (w, values) with each word once.

    Tokens are counted for each document before they meet the lexicon, which is broadcast up to a checked size. Documents without a match have null means.
    """
    counts = tokens.groupBy("doc_id", "w").agg(F.count("w").alias("n"))
    if lexicon.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        lexicon = F.broadcast(lexicon)
    rows = counts.join(lexicon, "w", "left")
    matched = F.sum(F.when(F.col(values[0]).isNotNull(), F.col("n")).otherwise(0))
    total = F.sum("n")
    return rows.groupBy("doc_id").agg(
        total.alias("n_tokens"), matched.alias("n_matched"), *(F.round(F.try_divide(F.sum(F.col("n") * F.col(v)), matched.cast("double")), 9).alias(v) for v in values),
        F.round(F.try_divide(matched.cast("double"), total), 9).alias("coverage"),
    )


def window_means(docs: DataFrame, score, size: int = 512, most: int = 64, places: int = 4) -> DataFrame:
    """(doc_id, n_windows, score): the mean of score over a text's windows of size tokens, the first most of them, rounded.

    score maps an array of tokens to a number; a text without tokens has no window and a null score.
    """
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    rows = docs.select("doc_id", tokens.alias("__t")).withColumn("n_windows", F.least(F.lit(most), F.ceil(F.size("__t") / size)).cast("int"))
    windows = F.transform(F.sequence(F.lit(1), F.col("n_windows")), lambda k: score(F.slice("__t", (k - 1) * size + 1, F.lit(size))))
    mean = F.aggregate(windows, F.lit(0.0), lambda acc, x: acc + x) / F.col("n_windows")
    return rows.select("doc_id", "n_windows", F.when(F.col("n_windows") > 0, F.round(mean, places)).alias("score"))


@query(
    "token_window_scores",
    r"""with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') as ts from documents),
w as (select doc_id, (i - 1) // 32 as k, length(tok) > 6 as long from (select doc_id, unnest(ts) as tok, generate_subscripts(ts, 1) as i from t)),
m as (select doc_id, k, avg(long::int) as s from w where k < 64 group by all)
select t.doc_id, cast(count(k) as integer) as n_windows, round(avg(s), 9) as score from t left join m using (doc_id) group by 1""",
)
def token_window_scores(spark, d):
    """Means over windows of 32 tokens of a stand-in score, the share of long words."""
    share = lambda ts: F.size(F.filter(ts, lambda w: F.length(w) > 6)) / F.size(ts)
    return window_means(table(spark, d, "documents"), share, 32, places=9)


@query("text_lengths_check", "select doc_id, length(text) as n_found, n_chars, coalesce(length(text) = n_chars, false) as right_length from documents")
def text_lengths_check(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("n_found"), "n_chars", F.coalesce(F.length("text") == F.col("n_chars"), F.lit(False)).alias("right_length"))


@query(
    "link_domains",
    r"""select domain, count(*) as n from (select replace(regexp_extract(u, 'https?://([^/?#]+)', 1), 'www.', '') as domain
  from (select unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9.-]+')) as u from documents)) group by 1""",
)
def link_domains(spark, d):
    links = F.explode(F.regexp_extract_all("text", F.lit(r"https?://[A-Za-z0-9.-]+"), F.lit(0)))
    return table(spark, d, "documents").select(links.alias("u")).groupBy(S.url_domain(F.col("u")).alias("domain")).agg(F.count("*").alias("n"))


@query(
    "gate_sample",
    """with s as (select doc_id, cb_max_score, cb_n_checkworthy from (select *, row_number() over (partition by doc_id order by cb_max_score desc nulls last, cb_n_checkworthy desc nulls last) as rn from gate_scores) where rn = 1),
p as (select distinct author || '/' || permlink as doc_id, lang_status from hive_cleaned)
select doc_id, cb_max_score, cb_n_checkworthy from s join p using (doc_id) where cb_max_score > 0.85""",
)
def gate_sample(spark, d):
    """Posts above the gate: both sides deduplicated, then an inner join."""
    scores = K.keep_first(table(spark, d, "gate_scores").select("doc_id", "cb_max_score", "cb_n_checkworthy"), ["doc_id"], [F.desc_nulls_last("cb_max_score"), F.desc_nulls_last("cb_n_checkworthy")])
    posts = table(spark, d, "hive_cleaned").select(F.concat("author", F.lit("/"), "permlink").alias("doc_id")).distinct()
    return scores.where("cb_max_score > 0.85").join(posts, "doc_id").select("doc_id", "cb_max_score", "cb_n_checkworthy")


_CLAIMY = "least(1::double, 0.02::double * least(length(s), 30) + case when regexp_matches(s, '[0-9]') then 0.3::double else 0::double end)"
_ABBR = "['mr','mrs','ms','dr','prof','sr','jr','st','vs','etc','inc','ltd','co','u.s','u.k','e.g','i.e','a.m','p.m','no','vol','fig','approx','dept']"
_MERGED = f"""(select doc_id, {sql_chain("s", [_STRIP])} as s from (select doc_id, unnest(string_split(array_to_string(list_transform(
    list_filter(string_split(regexp_replace({sql_chain("coalesce(text, '')", [_STRIP])}, '([.!?])[{_WS2}]+', '\\1' || chr(57345), 'g'), chr(57345)), lambda p: p <> ''),
    lambda p: p || case when list_contains({_ABBR}, rtrim(lower(regexp_replace(regexp_extract(p, '[^{_WS2}]*$'), '[^a-zA-Z.]', '', 'g')), '.')) then ' ' else chr(57345) end), ''), chr(57345))) as s from documents))"""


def rule_score(s):
    """A stand-in for a scorer of check-worthiness: longer sentences and those with numbers score higher."""
    return F.least(F.lit(1.0), 0.02 * F.least(F.length(s), F.lit(30)) + F.when(s.rlike("[0-9]"), 0.3).otherwise(0.0))


def gate(docs: DataFrame, score=rule_score, above: float = 0.85) -> DataFrame:
    """(doc_id, max_score, n_checkworthy, n_sentences) of documents (doc_id, text); score maps a sentence to a number, by an expression or a pandas function."""
    rows = docs.select("doc_id", F.explode_outer(C.merged_sentences(F.col("text"))).alias("s"))
    scored = rows.withColumn("score", F.when(F.col("s").isNotNull(), score(F.col("s"))))
    return scored.groupBy("doc_id").agg(
        F.round(F.coalesce(F.max("score"), F.lit(0.0)), 4).alias("max_score"), F.count_if(F.col("score") > above).alias("n_checkworthy"), F.count("score").alias("n_sentences")
    )


@query(
    "sentence_gate",
    f"""select d.doc_id, round(coalesce(max(score), 0), 4) as max_score, count(*) filter (where score > 0.85) as n_checkworthy, count(score) as n_sentences
from (select distinct doc_id from documents) d left join (select doc_id, {_CLAIMY} as score from {_MERGED} where length(s) >= 15) x using (doc_id) group by 1""",
)
def sentence_gate(spark, d):
    """Per-document maximum, count above the gate and number of sentence scores, with sentences joined over abbreviations."""
    return gate(table(spark, d, "documents"))


@query("merged_sentence_counts", f"select doc_id, count(*) as n_sentences, cast(sum(length(s)) as bigint) as n_chars from {_MERGED} where length(s) >= 15 group by 1")
def merged_sentence_counts(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(C.merged_sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


@query(
    "posts_without_score",
    "select distinct author || '/' || permlink as doc_id from hive_cleaned where author || '/' || permlink not in (select doc_id from gate_scores where doc_id is not null)",
)
def posts_without_score(spark, d):
    posts = table(spark, d, "hive_cleaned").select(F.concat("author", F.lit("/"), "permlink").alias("doc_id")).distinct()
    return K.todo(posts, table(spark, d, "gate_scores").where("doc_id is not null"), ["doc_id"])


@query(
    "sample_by_category",
    """select author, permlink, category from (select *, row_number() over (partition by category order by md5('7|' || author || '|' || permlink), author, permlink) as rn
  from (select distinct author, permlink, category from hive_cleaned)) where rn <= 5""",
)
def sample_by_category(spark, d):
    posts = table(spark, d, "hive_cleaned").select("author", "permlink", "category").distinct()
    return K.sample_each(posts, ["category"], ["author", "permlink"], 5, 7)


@query(
    "rater_blocks",
    """select author, permlink, cast(floor((rn - 1) / 25) as bigint) as rater, rn as order_shown from (
  select author, permlink, row_number() over (order by md5('11|' || author || '|' || permlink), author, permlink) as rn
  from (select distinct author, permlink from hive_cleaned)) where rn <= 100""",
)
def rater_blocks(spark, d):
    """A random hundred posts in blocks of 25 for four raters; the top hundred are taken before they are numbered."""
    posts = table(spark, d, "hive_cleaned").select("author", "permlink").distinct()
    top = posts.orderBy(K.hash_order(11, "author", "permlink"), "author", "permlink").limit(100)
    n = F.row_number().over(Window.orderBy(K.hash_order(11, "author", "permlink"), "author", "permlink"))
    return top.withColumn("rn", n).select("author", "permlink", F.floor((F.col("rn") - 1) / 25).alias("rater"), F.col("rn").alias("order_shown"))


@query(
    "category_by_month",
    "select m.month, c.category, count(p.permlink) as n from (select distinct strftime(created, '%Y-%m') as month from hive_cleaned) m, (select unnest(['gaming', 'personal', 'technology']) as category) c left join (select distinct author, permlink, strftime(created, '%Y-%m') as month, category from hive_cleaned) p on p.month = m.month and p.category = c.category group by all",
)
def category_by_month(spark, d):
    """A crosstab in long form with its empty cells."""
    names = ["gaming", "personal", "technology"]
    posts = table(spark, d, "hive_cleaned").select("author", "permlink", S.month(F.col("created")).alias("month"), "category").distinct()
    wide = posts.groupBy("month").pivot("category", names).count().na.fill(0, names)
    return wide.unpivot("month", names, "category", "n")


@query(
    "top_voted",
    "select author, permlink, net_votes from (select distinct author, permlink, max(net_votes) over (partition by author, permlink) as net_votes from hive_classified) where net_votes is not null order by net_votes desc, author, permlink limit 20",
)
def top_voted(spark, d):
    votes = table(spark, d, "hive_classified").groupBy("author", "permlink").agg(F.max("net_votes").alias("net_votes"))
    return votes.where("net_votes is not null").orderBy(F.desc("net_votes"), "author", "permlink").limit(20)


@query(
    "reasoned_picks",
    """with v as (select author, permlink, max(net_votes) as v, max(children) as c from hive_classified group by all),
a as (select author, permlink, 1 as p, 'votes' as reason from v where v is not null order by v desc, author, permlink limit 15),
b as (select author, permlink, 2 as p, 'comments' as reason from v where c is not null order by c desc, author, permlink limit 15),
u as (select * from a union all select * from b)
select author, permlink, reason from (select *, row_number() over (partition by author, permlink order by p) as rn from u) where rn = 1""",
)
def reasoned_picks(spark, d):
    """Union of picks made for several reasons, the first reason kept."""
    v = table(spark, d, "hive_classified").groupBy("author", "permlink").agg(F.max("net_votes").alias("v"), F.max("children").alias("c"))
    pick = lambda col, p, reason: v.where(F.col(col).isNotNull()).orderBy(F.desc(col), "author", "permlink").limit(15).select("author", "permlink", F.lit(p).alias("p"), F.lit(reason).alias("reason"))
    return K.keep_first(pick("v", 1, "votes").unionByName(pick("c", 2, "comments")), ["author", "permlink"], [F.col("p")]).select("author", "permlink", "reason")


@query(
    "sheet_parts",
    "select cast(floor((rn - 1) / 500) as bigint) as part, count(*) as n_rows, max(n) as longest from (select least(length(body), 32000) as n, row_number() over (order by author, permlink, net_votes nulls first, md5(body) nulls first) as rn from hive_classified) group by 1",
)
def sheet_parts(spark, d):
    """Rows in parts of 500 with cells cut at 32,000 characters, numbered without one task for all rows."""
    from tallyloom.operators.ranges import running_sums

    rows = table(spark, d, "hive_classified").select("author", "permlink", "net_votes", "body", F.lit(1).alias("one"), F.least(F.length("body"), F.lit(32000)).alias("n"))
    keyed = rows.select(F.lit(0).alias("g"), F.struct("author", "permlink", "net_votes", F.md5("body").alias("b")).alias("k"), "one", "n")
    numbered = running_sums(keyed, ["g"], ["k"], {"one": "rn"})
    parts = numbered.groupBy(F.floor((F.col("rn") - 1) / 500).alias("part")).agg(F.count("*").alias("n_rows"), F.max("n").alias("longest"))
    return parts


@query(
    "top_phrases",
    rf"""select phrase, count(*) as n from (select unnest(regexp_extract_all({_NORM}, '{phrase_pattern([p for ps in DICTIONARY.values() for p in ps])}')) as phrase from documents) group by 1 order by n desc, phrase limit 5""",
)
def top_phrases(spark, d):
    """The five commonest phrases."""
    return phrase_tallies(spark, d).orderBy(F.desc("n"), "phrase").limit(5)


@query(
    "postprocessed_posts",
    "select author, permlink, " + sql_chain("coalesce(body, '')", [(r"<[^>]+>", ""), (r"!\[[^\n]*?\]\([^\n]*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"#{1,6}\s", ""), (r"\*{1,2}([^*]+)\*{1,2}", r"\1"), (r"\n{3,}", _NL2), _STRIP]).replace("\\\\1", "\\1")
    + f""" as body_clean, 'https://peakd.com/@' || author || '/' || permlink as link, {_MONEY.format("total_payout_value")} + {_MONEY.format("pending_payout_value")} as payout_combined
from (select *, row_number() over (partition by author, permlink order by created, net_votes nulls first, children nulls first, total_payout_value nulls first, pending_payout_value nulls first) as rn from hive_classified) where rn = 1""",
)
def postprocessed_posts(spark, d):
    """From raw rows to one cleaned row for each post: duplicates first, then texts, links and money."""
    cols = table(spark, d, "hive_classified").select("author", "permlink", "created", "net_votes", "children", "body", "total_payout_value", "pending_payout_value")
    order = [F.col("created"), *(F.asc_nulls_first(c) for c in ("net_votes", "children", "total_payout_value", "pending_payout_value"))]
    first = K.keep_first(cols, ["author", "permlink"], order)
    t, p = S.parse_money(F.col("total_payout_value")), S.parse_money(F.col("pending_payout_value"))
    return first.select(
        "author", "permlink", C.clean_body(F.col("body")).alias("body_clean"), S.post_link(F.col("author"), F.col("permlink")).alias("link"), (t + p).alias("payout_combined")
    )


@query(
    "post_features",
    rf"""select distinct author, permlink, greatest({_sql_json_len('$.image')}, len(regexp_extract_all(coalesce(body, ''), '{_IMG}')) + len(regexp_extract_all(coalesce(body, ''), '(?i)<img'))) as n_images,
  greatest(len(regexp_extract_all(coalesce(body, ''), 'https?://[^\s)\]]+')) - len(regexp_extract_all(coalesce(body, ''), '!\[[^\]]*\]\(https?://[^)]*\)')), 0) as n_links,
  cast({_sql_json_len('$.tags')} as integer) as n_tags, length(coalesce(title, '')) as title_chars, len(regexp_extract_all(coalesce(body_clean, ''), '[\p{{L}}\p{{N}}_]+')) as n_words,
  round(len(regexp_extract_all(coalesce(body_clean, ''), '[\p{{L}}\p{{N}}_]+')) / nullif(len(regexp_extract_all(coalesce(body, ''), '[\p{{L}}\p{{N}}_]+')), 0)::double, 9) as retention from hive_classified""",
)
def post_features(spark, d):
    """Images by metadata or text, whichever are more, links that are no images, tags, lengths and the share of words that cleaning kept."""
    b, c = F.coalesce("body", F.lit("")), F.coalesce("body_clean", F.lit(""))
    n = lambda t, p: F.regexp_count(t, F.lit(p)).cast("bigint")
    words = r"[\p{L}\p{N}_]+"
    return table(spark, d, "hive_classified").select(
        "author", "permlink", F.greatest(S.json_list_length(F.col("json_metadata"), "$.image").cast("bigint"), n(b, _IMG) + n(b, "(?i)<img")).alias("n_images"),
        F.greatest(n(b, r"https?://[^\s)\]]+") - n(b, r"!\[[^\]]*\]\(https?://[^)]*\)"), F.lit(0)).alias("n_links"), S.json_list_length(F.col("json_metadata"), "$.tags").alias("n_tags"),
        F.length(F.coalesce("title", F.lit(""))).alias("title_chars"), n(c, words).alias("n_words"), F.round(F.try_divide(n(c, words).cast("double"), n(b, words)), 9).alias("retention"),
    ).distinct()
