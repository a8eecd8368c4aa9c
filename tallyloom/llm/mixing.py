"""Sources mixed to target weights by weighted fair queueing.

A source's documents come in shuffled order, once in each epoch up to its max_repeats. The virtual finish time of a
copy is its source's cumulative tokens divided by the source's weight; the mix is the copies by finish time, up to the
total size. Cumulative sums are exact and spread a source of any size over many tasks.

Defined cases: sources are trimmed and case-folded; documents without source or tokens count nowhere; a source of a mix
without documents has share 0; ties of finish time fall to source, epoch and id; weights not above 0 get nothing;
a mix without total_tokens is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import fold, wordpunct_count
from tallyloom.llm.packing import SQL_TOKENS
from tallyloom.operators.ranges import running_sums
from tallyloom.session import cut, table


def sized_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, src, tokens) of the documents that can count; tokens are counted once and written, as all that follows reads them."""
    rows = docs.select("doc_id", fold(F.col("source")).alias("src"), wordpunct_count(F.col("text")).alias("tokens"))
    return cut(rows.where("src is not null and tokens > 0"))


def shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with its wanted tokens, its source's tokens and what it can give at most; targets are parameters."""
    totals = sized.groupBy("src").agg(F.sum("tokens").alias("source_tokens"), F.max("tokens").alias("largest"))
    mix = Window.partitionBy("mix_id")
    asked = targets.withColumn("src", fold(F.col("source"))).withColumn(
        "wanted_tokens", F.col("weight") / F.nullif(F.sum("weight").over(mix), F.lit(0.0)) * F.col("total_tokens")
    )
    joined = asked.join(totals, "src", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    return joined.withColumn("most_tokens", F.coalesce("max_repeats", F.lit(1)) * F.col("source_tokens"))


def _stop_times(plan: DataFrame) -> DataFrame:
    """Plan with a time after which no copy of its mix finishes: the t where the sum of min(weight * t, most_tokens) is total_tokens
    and the largest document of each source, as at any time each source has at most one document begun and not finished.

    The sum is piecewise linear in t with a knot where each source ends, so running sums over a mix's few sources give it.
    """
    by_end = Window.partitionBy("mix_id").orderBy("__end", "src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("mix_id")
    knots = plan.where("weight > 0 and most_tokens > 0 and total_tokens > 0").withColumn("__end", F.col("most_tokens") / F.col("weight"))
    knots = knots.withColumn("__w", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_end), F.lit(0.0)))
    knots = knots.withColumn("__from", F.lag("__end").over(Window.partitionBy("mix_id").orderBy("__end", "src")))
    knots = knots.withColumn("__done", F.coalesce(F.sum("most_tokens").over(by_end), F.lit(0)))
    room = F.col("total_tokens") + F.sum("largest").over(whole)
    at = (room - F.col("__done")) / F.col("__w")
    # the first source in order of end that has not ended when the mix is full
    stop = knots.withColumn("__t", F.when((at <= F.col("__end")) & (at >= F.coalesce("__from", F.lit(0.0))), at))
    return stop.withColumn("stop", F.coalesce(F.min("__t").over(whole), F.max("__end").over(whole))).drop("__end", "__w", "__done", "__from", "__t")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """The copies of each mix: (mix_id, src, epoch, doc_id, tokens, finish), from sized_sources()."""
    plan = _stop_times(shares(sized, targets))
    laps = F.least(F.coalesce("max_repeats", F.lit(1)).cast("bigint"), F.ceil(F.col("weight") * F.col("stop") / F.col("source_tokens") + 1e-9))
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(laps, F.lit(1)))))
    plan = plan.select("mix_id", "src", "weight", "total_tokens", "source_tokens", "stop", "epoch")
    # the order in an epoch is the same for all mixes, so each (source, epoch) is summed once
    needed = plan.select("src", "epoch").distinct()
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    copies = sized.join(F.broadcast(needed), "src").withColumn("__o", order)
    summed = running_sums(copies, ["src", "epoch"], ["__o", "doc_id"], {"tokens": "__cum"})
    timed = summed.join(F.broadcast(plan), ["src", "epoch"]).withColumn(
        "finish", ((F.col("epoch") - 1) * F.col("source_tokens") + F.col("__cum")) / F.col("weight")
    )
    timed = timed.where(F.col("finish") <= F.col("stop") * (1 + 1e-9))
    timed = timed.select("mix_id", "src", "epoch", "doc_id", "tokens", "finish", "total_tokens")
    ranked = running_sums(timed, ["mix_id"], ["finish", "src", "epoch", "doc_id"], {"tokens": "__sum"})
    return ranked.where("__sum <= total_tokens").select("mix_id", "src", "epoch", "doc_id", "tokens", "finish")


def reached(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares with the tokens (got) and epochs (laps) of each target in the mix and whether its source is exhausted there.

    A source is exhausted whose copies through max_repeats all lie in the mix and end before its wanted tokens. The token totals
    must say the same, which is checked; they alone decide where weights not above 0 or a source asked for twice blur a mix.
    """
    got = mix(sized, targets).groupBy("mix_id", "src").agg(F.sum("tokens").alias("got"), F.max("epoch").alias("laps"))
    rows = shares(sized, targets).join(got, ["mix_id", "src"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    whole = Window.partitionBy("mix_id")
    plain = (F.min("weight").over(whole) > 0) & (F.count("*").over(Window.partitionBy("mix_id", "src")) == 1)
    ended = F.coalesce((F.col("got") >= F.col("most_tokens")) & (F.col("got") < F.col("wanted_tokens")), F.lit(False))
    short = F.coalesce(F.col("wanted_tokens") > F.col("most_tokens"), F.lit(False))
    wrong = F.raise_error(F.concat_ws(" ", F.lit("mix and token totals differ:"), "mix_id", "source"))
    rows = rows.withColumn("__plain", plain)
    return rows.withColumn("exhausted", F.when(~F.col("__plain"), short).when(ended == short, ended).otherwise(wrong.cast("boolean"))).drop("__plain")


def _in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sized_sources(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose source is exhausted in the mix."""
    return reached(*_in(spark, sf_dir)).where("exhausted").select("mix_id", "source").distinct()


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_in(spark, sf_dir)).withColumn("finish", F.round("finish", 6))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with wanted and reached tokens and shares, and the most often that a text was repeated."""
    return reached(*_in(spark, sf_dir)).select(
        "mix_id",
        "source",
        F.round("wanted_tokens", 3).alias("wanted_tokens"),
        F.col("got").alias("reached_tokens"),
        F.round(F.col("wanted_tokens") / F.col("total_tokens"), 6).alias("wanted_share"),
        F.round(F.try_divide("got", F.sum("got").over(Window.partitionBy("mix_id"))), 6).alias("reached_share"),
        F.coalesce("laps", F.lit(0)).alias("repeats"),
        (F.col("wanted_tokens") > F.col("most_tokens")).alias("short"),
    )


QUERIES = {"p9_found": p9_found, "p9_mix": p9_mix, "p9_report": p9_report}
_SIZED = rf"""with sized as (select doc_id, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as src, {SQL_TOKENS.format('text')} as tokens from documents where source is not null),
totals as (select src, sum(tokens) as n from sized where tokens > 0 and src <> '' group by 1),
asked as (select *, lower(trim(source)) as src, weight / sum(weight) over (partition by mix_id) * total_tokens as wanted from mix_targets)"""
ORACLES = {
    "p9_found": _SIZED + "\nselect distinct mix_id, source from asked left join totals using (src) where wanted > max_repeats * coalesce(n, 0)",
    "p9_mix": _SIZED
    + """, plan as (select mix_id, src, weight, total_tokens, n, unnest(generate_series(1, coalesce(max_repeats, 1))) as epoch from asked join totals using (src) where weight > 0),
summed as (select src, epoch, doc_id, tokens, sum(tokens) over (partition by src, epoch order by md5('42|' || epoch || '|' || doc_id), doc_id) as cum
  from (select distinct src, epoch from plan) join sized using (src) where tokens > 0),
timed as (select mix_id, src, epoch, doc_id, tokens, total_tokens, ((epoch - 1) * n + cum)::double / weight as finish from plan join summed using (src, epoch))
select mix_id, src, epoch, doc_id, tokens, round(finish, 6) as finish from (select *, sum(tokens) over (partition by mix_id order by finish, src, epoch, doc_id) as s from timed) where s <= total_tokens""",
}
