"""Operators on keyed rows: first rows, contracts, incremental work, map-like joins, hashed sampling, apportionment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; order must end in a tie-break for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, with their counts: empty if keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error naming a few keys that repeat."""
    bad = duplicate_keys(df, keys).limit(10).collect()
    if bad:
        raise ValueError(f"keys {keys} repeat: {[tuple(r[k] for k in keys) for r in bad]}")
    return df


def assert_covered(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error naming a few keys of df without a row in reference."""
    bad = df.select(*keys).distinct().join(reference, keys, "left_anti").limit(10).collect()
    if bad:
        raise ValueError(f"keys {keys} are missing: {[tuple(r) for r in bad]}")
    return df


def checked_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with one row for each key; a key of several rows raises when the plan runs, in the same job."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("__r"))
    named = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    error = F.raise_error(F.concat(F.lit(f"keys {keys} repeat: "), named))
    one = one.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(error.cast("boolean")))  # a filter, which no pruning of columns can take out
    return one.select(*keys, *(F.col("__r")[c].alias(c) for c in rest))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which each row of left may meet one row of right at most; repeated keys of right raise when the join runs.

    A left join of which no column of right is read is left out by the optimiser, and the check with it; assert_unique checks at once.
    """
    return left.join(checked_unique(right, keys), keys, how)


def join_normalised(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join on a key that is trimmed and case-folded on both sides; keys of right that become equal raise, blank ones meet nothing."""
    norm = F.nullif(F.lower(F.trim(F.col(key).cast("string"))), F.lit(""))
    other = checked_unique(right.withColumn("__k", norm).drop(key).where("__k is not null"), ["__k"])
    return left.withColumn("__k", norm).join(other, "__k", how).drop("__k")


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_f", "_u")) -> DataFrame:
    """A join that keeps columns of both sides, those of one name with the suffix of their side."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    renamed = lambda df, x: df.select(*(F.col(c).alias(c + x if c in both else c) for c in df.columns))
    return renamed(left, suffixes[0]).join(renamed(right, suffixes[1]), keys, how)


def aligned_flags(scored: DataFrame, recomputed: DataFrame, doc: str, idx: str, flag: str) -> DataFrame:
    """scored (doc, idx) with flag from recomputed (doc, idx, flag), joined by position.

    Where a document has another number of rows in recomputed, all its flags are false, so none can stand at a wrong place.
    """
    n = scored.groupBy(doc).agg(F.count("*").alias("__n"))
    m = recomputed.groupBy(doc).agg(F.count("*").alias("__m"))
    same = n.join(m, doc).where("__n = __m").select(doc)
    fits = recomputed.join(same, doc, "left_semi").select(doc, idx, flag)
    return scored.join(fits, [doc, idx], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def one_hot(c: Column, values: list, prefix: str) -> list[Column]:
    """A 0/1 column for each value; null gives 0."""
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def mapped_order(c: Column, order: list[str]) -> Column:
    """Place of c in order, len(order) for other values and null: a sort key."""
    return F.when(c.isin(*order), F.array_position(F.array(*map(F.lit, order)), c).cast("int") - 1).otherwise(len(order))


def todo(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a finished row."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def incremental_apply(
    items: DataFrame, done: DataFrame, keys: list[str], fn: Callable[[DataFrame], DataFrame], keep: Column | None = None
) -> DataFrame:
    """done with the results of fn for the items not in it; of done only rows that satisfy keep count as finished.

    keep = None keeps failures too (they are not tried again); a condition on success has failures tried again.
    """
    finished = done if keep is None else done.where(keep)
    return finished.unionByName(fn(todo(items, finished, keys)))


def last_wins(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """One value for each key, that of the greatest position."""
    return df.groupBy(*keys).agg(F.max_by(value, position).alias(value))


def hash_order(seed: int, *keys: str) -> Column:
    """A text that orders keys at random, alike on every cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


#: Parts of a stratum that are cut to its quota each before the stratum is ordered as a whole.
PARTS = 32


def sample_each(df: DataFrame, strata: list[str], keys: list[str], k: int | Column, seed: int) -> DataFrame:
    """k rows of each stratum (or all of a smaller one), those of the lowest hashes.

    The rows of a stratum are spread over parts by hash, each keeps its lowest k, and these alone meet in one task.
    """
    rows = df.withColumns({"__h": hash_order(seed, *keys), "__k": F.lit(k) if isinstance(k, int) else k})
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__h"), F.lit(PARTS)))
    part = Window.partitionBy(*strata, "__part").orderBy("__h", *keys)
    whole = Window.partitionBy(*strata).orderBy("__h", *keys)
    rows = rows.withColumn("__rn", F.row_number().over(part)).where("__rn <= __k")
    return rows.withColumn("__rn", F.row_number().over(whole)).where("__rn <= __k").drop("__rn", "__h", "__k", "__part")


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of names that df has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} in {df.columns}")


def drop_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(n for n in names if n in df.columns))


def conform(df: DataFrame, schema: list[tuple[str, str]], missing: list[str] | None = None) -> DataFrame:
    """The columns of schema that df has, in its order, each tried as its type; names that df lacks are added to missing."""
    if missing is not None:
        missing += [n for n, _ in schema if n not in df.columns]
    return df.select(*(F.col(n).try_cast(t).alias(n) for n, t in schema if n in df.columns))


def capped_apportion(total: int, weights: dict, caps: dict) -> dict:
    """Whole quotas that add up to min(total, all caps), in proportion to weights, none above its cap.

    In each round the units with room share what is left by weight, rounded down and up to their room. A round that would give
    nothing gives one each by falling remainder (in the given order without weights) until all is given.
    """
    quota = dict.fromkeys(weights, 0)
    left = int(min(total, sum(caps.values())))
    while left > 0:
        room = {k: caps[k] - n for k, n in quota.items() if n < caps[k]}
        if not room:
            break
        mass = sum(weights[k] for k in room)
        ideal = {k: left * weights[k] / mass if mass > 0 else 0.0 for k in room}
        given = {k: min(int(ideal[k]), room[k]) for k in room}
        if not any(given.values()):
            by_rest = sorted(room, key=lambda k: int(ideal[k]) - ideal[k])
            given = dict.fromkeys(by_rest[:left], 1)
        for k, n in given.items():
            quota[k] += n
        left -= sum(given.values())
    return quota
