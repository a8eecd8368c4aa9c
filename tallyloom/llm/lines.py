"""Lines repeated across one author's posts.

A line is known by its letters, lower-cased. An author's posts with the same letters in the same lines are copies and
collapse into one cluster before any line is cut out: only the cluster's lines travel, each once, with the number of posts that
the cluster stands for. A line's clusters and posts are sums over the clusters that hold it; its publication dates are
counted over the lines that are frequent enough. So a rule on clusters and dates does not mistake republished articles
for boilerplate, and the number of posts stays exact.

Defined cases: null texts have no lines; empty lines count for the numbering alone; lines with fewer than
min_letters letters are never counted; rows without author or permlink are left out; repeated rows of a post count once,
and a post with several texts counts once for a line that stands in several of them; null dates count as no day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import cut, table

MIN_LETTERS = 12
MIN_POSTS = 5
#: Parts into which the rows of one frequent line, or of one cluster, are spread for the joins.
SALTS = 8


def letters(text: Column) -> Column:
    """Letters and line feeds of text."""
    return F.regexp_replace(text, r"[^\p{L}\n]+", "")


def keyed_lines(bare: Column, min_letters: int) -> Column:
    """Array of (line_no, line_key) of the lines that can count."""
    each = F.transform(
        F.split(bare, "\n", -1),
        lambda x, i: F.struct((i + 1).alias("line_no"), F.when(F.length(x) >= min_letters, F.unhex(F.md5(F.lower(x)))).alias("line_key")),
    )
    return F.filter(each, lambda x: x["line_key"].isNotNull())


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _spread(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def collapsed(posts: DataFrame, text: str = "body_for_analysis", min_letters: int = MIN_LETTERS) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): (author, cluster, lines) of each distinct text, and (author, permlink, cluster, days, texts) of the posts.

    days are a post's distinct dates, at most as many as the calendar has; texts is the number of the post's clusters.
    """
    rows = posts.where(F.col("author").isNotNull() & F.col("permlink").isNotNull() & F.col(text).isNotNull())
    rows = rows.select("author", "permlink", F.to_date("created").alias("day"), letters(F.col(text)).alias("bare"))
    rows = rows.select("author", "permlink", "day", F.unhex(F.md5(F.lower("bare"))).alias("cluster"), keyed_lines(F.col("bare"), min_letters).alias("lines"))
    rows = cut(rows)  # hashes alone, used for clusters and for members
    some = rows.where(F.size("lines") > 0)
    clusters = some.groupBy("author", "cluster").agg(F.min("lines").alias("lines"))
    members = some.groupBy("author", "permlink", "cluster").agg(F.collect_set("day").alias("days"))
    texts = members.groupBy("author", "permlink").agg(F.count("*").alias("texts")).where("texts > 1")
    members = members.join(texts, ["author", "permlink"], "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    return clusters, cut(members)


def line_counts(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(author, line_key, n_clusters, n_posts) from (author, cluster, line_key), each once for a cluster, and the members.

    Posts are summed over clusters; what that counts twice, posts with several texts, is counted apart and taken off.
    """
    sizes = members.groupBy("author", "cluster").agg(F.count("*").alias("n"))
    sums = lines.join(sizes, ["author", "cluster"]).groupBy("author", "line_key").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_posts"))
    several = members.where("texts > 1").select("author", "cluster", "permlink")
    again = lines.join(several, ["author", "cluster"]).groupBy("author", "line_key", "permlink").agg((F.count("*") - 1).alias("extra"))
    extra = again.groupBy("author", "line_key").agg(F.sum("extra").alias("extra"))
    return sums.join(extra, ["author", "line_key"], "left").withColumn("n_posts", F.col("n_posts") - F.coalesce("extra", F.lit(0))).drop("extra")


def occurrences(posts: DataFrame, text: str = "body_for_analysis", min_posts: int = MIN_POSTS, min_clusters: int = 1) -> DataFrame:
    """(author, permlink, line_key, line_no, n_posts, n_clusters, days) of each line in enough posts and clusters, in each text of a post.

    Frequent lines are joined back with salts, as one line may stand in most texts of a hot author, and so are the posts of a
    cluster, as one text may be most of its posts.
    """
    clusters, members = collapsed(posts, text)
    lines = clusters.select("author", "cluster", F.explode("lines").alias("l")).select("author", "cluster", "l.line_no", "l.line_key")
    once = clusters.select("author", "cluster", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line_key"]))).alias("line_key"))
    frequent = line_counts(once, members).where((F.col("n_posts") >= min_posts) & (F.col("n_clusters") >= min_clusters))
    held = lines.withColumn("salt", _salt("cluster")).join(_spread(frequent), ["author", "line_key", "salt"]).drop("salt")
    spread = members.select("author", "cluster", "permlink", "days", _salt("permlink").alias("salt"))
    return _spread(held).join(spread, ["author", "cluster", "salt"]).drop("salt", "cluster")


def repeated_lines(
    posts: DataFrame, text: str = "body_for_analysis", min_posts: int = MIN_POSTS, min_clusters: int = 1, min_days: int = 0
) -> DataFrame:
    """Each occurrence (author, permlink, line_no, n_posts, n_clusters, n_days) of a line repeated often enough."""
    hits = occurrences(posts, text, min_posts, min_clusters)
    days = hits.select("author", "line_key", F.explode("days").alias("day")).distinct().groupBy("author", "line_key").agg(F.count("*").alias("n_days"))
    found = hits.withColumn("salt", _salt("permlink")).join(_spread(days), ["author", "line_key", "salt"], "left")
    found = found.withColumn("n_days", F.coalesce("n_days", F.lit(0))).where(F.col("n_days") >= min_days)
    return found.select("author", "permlink", "line_no", "n_posts", "n_clusters", "n_days").distinct()


def without_repeated_lines(posts: DataFrame, text: str = "body_for_analysis", **rule: int) -> DataFrame:
    """(author, permlink, n_removed, text) of each distinct text, without its repeated lines."""
    found = occurrences(posts, text, **rule).groupBy("author", "permlink").agg(F.collect_set("line_no").alias("__nos"))
    texts = posts.select("author", "permlink", F.col(text).alias("__text")).distinct()
    kept = F.filter(F.split("__text", "\n", -1), lambda _, i: ~F.array_contains("__nos", i + 1))
    return texts.join(found, ["author", "permlink"], "left").select(
        "author",
        "permlink",
        F.when(F.col("__nos").isNull(), 0).otherwise(F.size("__nos")).alias("n_removed"),
        F.when(F.col("__nos").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(table(spark, sf_dir, "hive_cleaned")).select("author", "permlink", "line_no").distinct()


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "hive_cleaned"))


def p6_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of lines that stand in at least 5 different texts on at least 3 days."""
    return repeated_lines(table(spark, sf_dir, "hive_cleaned"), min_posts=1, min_clusters=5, min_days=3)


_LINES = r"""
with texts as (select distinct author, permlink, created, body_for_analysis as t from hive_cleaned
  where author is not null and permlink is not null and body_for_analysis is not null),
raw as (select author, permlink, cast(created as date) as day, lower(regexp_replace(t, '[^\p{L}\n]+', '', 'g')) as cluster,
  unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as line_no from texts),
lined as (select *, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) as line_key from raw
  where length(regexp_replace(line, '[^\p{L}]+', '', 'g')) >= 12),
counts as (select author, line_key, count(distinct permlink) as n_posts, count(distinct cluster) as n_clusters,
  count(distinct day) as n_days from lined group by all)
"""
QUERIES = {"p6_found": p6_found, "p6_cleaned": p6_cleaned, "p6_boilerplate": p6_boilerplate}
ORACLES = {
    "p6_found": _LINES + "select distinct author, permlink, cast(line_no as integer) as line_no from lined join counts using (author, line_key) where n_posts >= 5",
    "p6_boilerplate": _LINES
    + """select distinct author, permlink, cast(line_no as integer) as line_no, n_posts, n_clusters, n_days
from lined join counts using (author, line_key) where n_clusters >= 5 and n_days >= 3""",
    "p6_cleaned": _LINES
    + """, hit as (select distinct author, permlink, line_no from lined join counts using (author, line_key) where n_posts >= 5),
kept as (select r.author, r.permlink, count(h.line_no) as n_removed,
  coalesce(string_agg(case when h.line_no is null then line end, chr(10) order by r.line_no), '') as text
  from (select distinct author, permlink, line, line_no from raw) r left join hit h using (author, permlink, line_no) group by all)
select author, permlink, cast(n_removed as integer) as n_removed, text from kept""",
}
