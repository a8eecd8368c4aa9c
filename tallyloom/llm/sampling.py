"""Samples that match target category proportions.

Each cell (stratum, category) keeps a reservoir: its posts with the lowest random priorities. Reservoirs of
parts of a cell merge into the reservoir of the whole, so a cell is first cut into salted parts, each keeps
its own, and only the kept rows meet. After the final counts each plan's reservoirs are trimmed to quotas
that can be met; a prefix of a reservoir is itself a uniform sample. Cells too small for their target are reported.

Defined cases: rows without author or permlink belong to no post and are left out; a post of several rows counts
once, in its smallest complete cell; a post without stratum (after is_political) or category counts nowhere;
priorities tie only for the same post; a plan over an empty table gets quotas of 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import fold
from tallyloom.session import cut, table

#: Parts into which the posts of one cell are spread for the first reservoirs.
SALTS = 64


def stratum_key(stratum: Column, is_political: Column) -> Column:
    return F.coalesce(
        fold(stratum), F.when(is_political, F.lit("political")).when(~is_political, F.lit("nonpolitical"))
    )


def category_key(category: Column) -> Column:
    return F.regexp_replace(fold(category), r"[\s-]", "_")


def posts_in_cells(posts: DataFrame) -> DataFrame:
    """One row (author, permlink, stratum, cat) for each post that has both."""
    rows = posts.select(
        "author",
        "permlink",
        F.struct(
            stratum_key(F.col("sample_stratum"), F.col("is_political")).alias("stratum"),
            category_key(F.col("category")).alias("cat"),
        ).alias("cell"),
    )
    whole = rows.where("author is not null and permlink is not null and cell.stratum is not null and cell.cat is not null")
    return whole.groupBy("author", "permlink").agg(F.min("cell").alias("cell")).select("author", "permlink", "cell.*")


def demands(targets: DataFrame) -> DataFrame:
    """Targets with the cell they mean and the rows they need: the larger of min_rows and the share rounded up."""
    need = F.greatest(
        F.coalesce(F.col("min_rows"), F.lit(0)), F.ceil(F.round(F.col("target_share") * F.col("sample_rows"), 6))
    )
    return targets.select(
        "plan_id",
        "sample_stratum",
        "category",
        "target_share",
        "min_rows",
        "sample_rows",
        fold(F.col("sample_stratum")).alias("stratum"),
        category_key(F.col("category")).alias("cat"),
        F.coalesce(need, F.lit(0)).cast("bigint").alias("needed_rows"),
    )


def level_fill(ideal: np.ndarray, low: np.ndarray, high: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers between low and high that add up to total as far as the bounds allow, all as far from ideal as one level says.

    The sum of clip(ideal + level, low, high) is piecewise linear in level, so the level is found between two of its knots; what
    is left after rounding down goes to the largest remainders, ties to the first.
    """
    goal = min(max(total, int(low.sum())), int(high.sum()))
    knots = np.unique(np.concatenate([low - ideal, high - ideal]))
    sums = np.array([np.clip(ideal + k, low, high).sum() for k in knots])
    exact = np.clip(ideal + np.interp(goal, sums, knots), low, high) if len(knots) else ideal
    out = np.floor(exact + 1e-9).astype(np.int64)
    order = np.argsort(-np.where(out < high, exact - out, -1.0), kind="stable")
    out[order[: goal - int(out.sum())]] += 1
    return out


def _quotas(plan: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one plan: needs as far as the posts go, then rows still missing to sample_rows by share; rows too many
    are taken from the cells furthest above their share, down to their minimum."""
    plan = plan.sort_values(["stratum", "cat"], na_position="last").reset_index(drop=True)
    have = plan["available_rows"].to_numpy(np.int64)
    quota = np.minimum(plan["needed_rows"].to_numpy(np.int64), have)
    floor = np.minimum(plan["min_rows"].fillna(0).to_numpy(np.int64), quota)
    total = int(plan["sample_rows"].fillna(0).max())
    share = plan["target_share"].fillna(0.0).to_numpy(float)
    if quota.sum() > total:
        quota = level_fill(share * total, floor, quota, total)
    elif quota.sum() < total:
        quota = level_fill(share * total, quota, np.where(share > 0, have, quota), total)
    return plan.assign(quota_rows=quota)


def capacities(targets: DataFrame) -> DataFrame:
    """(stratum, cat, capacity) of each cell that a target asks for; the largest sample or need bounds every quota, so no count is needed."""
    most = F.greatest(F.coalesce("sample_rows", F.lit(0)), "needed_rows")
    cells = demands(targets).groupBy("stratum", "cat").agg(F.max(most).alias("capacity"))
    return cells.where("stratum is not null and cat is not null")


def reservoirs(posts: DataFrame, capacities: DataFrame, seed: int = 42) -> DataFrame:
    """For each cell of capacities (stratum, cat, capacity), the posts with the lowest priorities, ranked from 1, each with its
    cell's posts as available_rows.

    capacities has a row for each cell that some target asks for, so it is as small as the targets. Each salted part keeps its count
    with its reservoir; both are merged. A cell of capacity 0 keeps one row, which carries the count.
    """
    priority = F.md5(F.concat_ws("|", F.lit(str(seed)), "author", "permlink"))
    rows = posts_in_cells(posts).join(F.broadcast(capacities), ["stratum", "cat"])
    rows = rows.withColumn("__p", priority).withColumn("__salt", F.pmod(F.xxhash64("permlink", F.lit(seed + 1)), F.lit(SALTS)))
    order = [F.col("__p"), F.col("author"), F.col("permlink")]
    room = F.greatest("capacity", F.lit(1))
    part = Window.partitionBy("stratum", "cat", "__salt")
    counted = rows.withColumn("__r", F.row_number().over(part.orderBy(*order))).withColumn("__n", F.count("*").over(part))
    kept = counted.where(F.col("__r") <= room)
    cell = Window.partitionBy("stratum", "cat")
    merged = kept.withColumn("rank", F.row_number().over(cell.orderBy(*order)))
    merged = merged.withColumn("available_rows", F.sum(F.when(F.col("__r") == 1, F.col("__n"))).over(cell))  # once for each part
    return merged.where(F.col("rank") <= room).drop("__p", "__salt", "__r", "__n")


def _needs(kept: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with its need, the posts at hand as the reservoirs kept count them, and whether its cell is exhausted."""
    counts = kept.where("rank = 1").select("stratum", "cat", "available_rows")
    asked = demands(targets)
    joined = asked.join(counts, ["stratum", "cat"], "left").select(asked["*"], F.coalesce("available_rows", F.lit(0)).alias("available_rows"))
    return joined.withColumn("exhausted", F.col("needed_rows") > F.col("available_rows"))


def _report(kept: DataFrame, targets: DataFrame) -> DataFrame:
    """sample_report() of the reservoirs kept."""
    needs = _needs(kept, targets)
    return needs.groupBy("plan_id").applyInPandas(_quotas, needs.withColumn("quota_rows", F.lit(0).cast("bigint")).schema)


def sample_report(posts: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Each target with its need, the posts at hand, a quota that can be met and whether the cell is exhausted.

    targets is a table of parameters; one plan's rows are handled together.
    """
    return _report(reservoirs(posts, capacities(targets), seed), targets)


def draw(posts: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """The sample of each plan: (plan_id, sample_stratum, category, author, permlink)."""
    kept = cut(reservoirs(posts, capacities(targets), seed))  # one pass gives counts, quotas and posts
    report = _report(kept, targets).where("quota_rows > 0").drop("available_rows")
    return (
        kept.join(F.broadcast(report), ["stratum", "cat"])
        .where("rank <= quota_rows")
        .select("plan_id", "sample_stratum", "category", "author", "permlink")
    )


def _in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "hive_sample_master"), table(spark, sf_dir, "sample_targets")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, targets = _in(spark, sf_dir)
    return _needs(reservoirs(posts, capacities(targets)), targets).where("exhausted").select("plan_id", "sample_stratum", "category").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, targets = _in(spark, sf_dir)
    return _needs(reservoirs(posts, capacities(targets)), targets).select(
        "plan_id", "sample_stratum", "category", "needed_rows", "available_rows", "exhausted"
    )


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(*_in(spark, sf_dir))


_FOLD = r"nullif(lower(regexp_replace({0}, '^[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g')), '')"
_CELLS = rf"""
with cells as (
  select author, permlink, min((s, c)) as cell from (
    select author, permlink,
      coalesce({_FOLD.format("sample_stratum")}, case when is_political then 'political' when not is_political then 'nonpolitical' end) as s,
      regexp_replace({_FOLD.format("category")}, '[\s-]', '_', 'g') as c
    from hive_sample_master where author is not null and permlink is not null)
  where s is not null and c is not null group by author, permlink),
counts as (select cell[1] as s, cell[2] as c, count(*) as n from cells group by all),
asked as (
  select *, greatest(coalesce(min_rows, 0), cast(ceil(round(target_share * sample_rows, 6)) as bigint)) as needed_rows,
    {_FOLD.format("sample_stratum")} as s, regexp_replace({_FOLD.format("category")}, '[\s-]', '_', 'g') as c
  from sample_targets)"""
_REPORT = _CELLS + """
select plan_id, sample_stratum, category, needed_rows, coalesce(n, 0) as available_rows, needed_rows > coalesce(n, 0) as exhausted
from asked left join counts using (s, c)"""

def p3_reservoirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts that each cell's reservoir keeps for the largest sample that any plan could ask of it."""
    posts, targets = _in(spark, sf_dir)
    kept = reservoirs(posts, capacities(targets))
    return kept.select("stratum", "cat", "author", "permlink", F.col("rank").cast("bigint").alias("rank"), "available_rows")


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_sample": p3_sample, "p3_reservoirs": p3_reservoirs}
ORACLES = {
    "p3_report": _REPORT,
    "p3_found": f"select distinct plan_id, sample_stratum, category from ({_REPORT}) where exhausted",
    "p3_reservoirs": _CELLS
    + """, room as (select s, c, greatest(max(greatest(coalesce(sample_rows, 0), needed_rows)), 1) as room from asked where s is not null and c is not null group by all)
select s as stratum, c as cat, author, permlink, rank, available_rows from (select s, c, author, permlink, room,
  row_number() over (partition by s, c order by md5('42|' || author || '|' || permlink), author, permlink) as rank, count(*) over (partition by s, c) as available_rows
  from (select author, permlink, cell[1] as s, cell[2] as c from cells) join room using (s, c)) where rank <= room""",
}
