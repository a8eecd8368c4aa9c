"""Descriptives, tests, concentration and least squares. Sums run in Spark; only matrices of a few columns reach the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.ranges import running_sums
from tallyloom.session import cut


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, deviation, range, median, share of zeros and bias-corrected skewness and excess kurtosis."""
    x = F.col(value).cast("double")
    n = F.count(x).cast("double")
    middle = quantiles(df, value, {"median": 0.5}, by)
    g1, g2 = F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    rows = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.round(100 * F.avg((x == 0).cast("double")), 6).alias("pct_zero"), F.round(skew, 6).alias("skew"), F.round(kurt, 6).alias("kurt"),
    )
    on = F.lit(True)
    for b in by:
        on = on & rows[b].eqNullSafe(middle[b])
    return rows.join(middle, on, "left").select(*(rows[c] for c in rows.columns), "median")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of each pair, rows with a null in either left out; all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.round(F.corr(a, b), 9).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    part = F.split("pair", r"\|")
    return long.select(F.get(part, F.lit(0)).alias("a"), F.get(part, F.lit(1)).alias("b"), "r")


def z_score(df: DataFrame, value: str) -> DataFrame:
    """df with z; null where the deviation is 0. The two moments are scalar subqueries, not a window over everything."""
    m, s = df.agg(F.avg(value)).scalar(), df.agg(F.stddev_samp(value)).scalar()
    return df.withColumn("z", (F.col(value) - m) / F.nullif(s, F.lit(0.0)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """The t beyond which both tails of Student's t hold p."""
    low, high = 0.0, 2.0
    while t_p_value(high, df) > p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p_value(mid, df) > p else (low, mid)
    return (low + high) / 2


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, one column for each name of at): exact quantiles with linear interpolation, nulls left out.

    Distinct values are counted and summed over range partitions, so no task holds all values of a group.
    """
    by = by or []
    keys = by or ["__all"]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), *([] if by else [F.lit(0).alias("__all")]))
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    summed = running_sums(counts, keys, ["__v"], {"__c": "__cum"})
    n = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    on = [summed[k].eqNullSafe(n[k]) for k in keys]
    both = summed.join(n, on).select(*(summed[k] for k in keys), "__v", "__c", "__cum", "__n")
    out = []
    for name, q in at.items():
        place = F.lit(float(q)) * (F.col("__n") - 1)
        holds = lambda k: (F.col("__cum") > k) & (F.col("__cum") - F.col("__c") <= k)
        low, high = F.max(F.when(holds(F.floor(place)), F.col("__v"))), F.max(F.when(holds(F.ceil(place)), F.col("__v")))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return both.groupBy(*keys).agg(*out).select(*by, *at)


def welch(df: DataFrame, value: str, group: str, reference: str) -> DataFrame:
    """Difference of each group's mean from the reference's with Welch's t, degrees of freedom and p-value."""
    g = df.groupBy(F.col(group).alias("grp")).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    rows = {r.grp: r for r in g.where((F.col("n") >= 2) & F.col("grp").isNotNull()).collect()}  # one row for each group
    out = []
    if reference in rows:
        r = rows[reference]
        for name, x in sorted(rows.items()):
            if name == reference:
                continue
            a, b = x.v / x.n, r.v / r.n
            t = (x.m - r.m) / math.sqrt(a + b) if a + b else math.inf
            dof = (a + b) ** 2 / (a * a / (x.n - 1) + b * b / (r.n - 1)) if a + b else math.inf
            out.append((name, round(x.m - r.m, 6), round(t, 6), round(dof, 4), t_p_value(t, dof)))
    return df.sparkSession.createDataFrame(out, "grp string, diff double, t double, df double, p double")


def lorenz(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's place on the Lorenz curve; cumulative sums by range partitions, negative values as 0."""
    base = df.select(key, F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v"), F.lit(1).alias("one"), F.lit(0).alias("g"))
    ranked = running_sums(base, ["g"], ["v", key], {"one": "i", "v": "cum"})
    n, t = base.agg(F.count("*")).scalar(), base.agg(F.sum("v")).scalar()
    both = ranked.select(key, "v", "i", "cum", n.alias("n"), t.alias("t"))
    return both.select(key, "v", "i", "n", "t", (F.col("i") / F.col("n")).alias("x"), F.try_divide("cum", "t").alias("y"))


def concentration(df: DataFrame, key: str, value: str) -> DataFrame:
    """Gini coefficient and the shares of the lower half and the top tenth."""
    r = lorenz(df, key, value)
    n, t, i, v = F.max("n").cast("double"), F.max("t"), F.col("i"), F.col("v")
    low = F.sum(F.when(i <= F.floor(F.col("n") / 2), v).otherwise(0.0))
    top = F.sum(F.when(i > F.col("n") - F.floor(F.col("n") / 10), v).otherwise(0.0))
    return r.agg(
        F.max("n").alias("n"), F.round(2 * F.sum(i * v) / (n * t) - (n + 1) / n, 9).alias("gini"), F.round(low / t, 9).alias("bottom50"), F.round(top / t, 9).alias("top10")
    )


def _drop_singletons(df: DataFrame, effects: list[str]) -> DataFrame:
    """df without rows whose level of an effect has no other row, until none is left.

    Levels are counted and joined, so a level with many rows is counted in parts. Each round but the last takes rows away, so it ends.
    """
    n = df.count() if effects else 0
    while effects:
        for e in effects:
            lone = df.groupBy(e).agg(F.count("*").alias("__n")).where("__n = 1").select(e)
            df = df.join(lone, e, "left_anti")
        df = cut(df)
        left, n = n, df.count()
        if n == left:
            break
    return df


def _within(df: DataFrame, columns: list[str], effects: list[str], tolerance: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """columns without the effects' means, by alternating projections; one effect needs one round.

    The rows are kept once: what is subtracted is a table of levels for each effect, and a round aggregates the rows less the tables of the
    other effects. Without convergence after the given rounds an error is raised.
    """
    off = {e: df.select(e).distinct().select(e, *(F.lit(0.0).alias(f"__{e}_{c}") for c in columns)) for e in effects}

    def less(which: list[str]) -> DataFrame:
        out = df
        for e in which:
            out = out.join(off[e], e)
        return out.select(*df.columns[: len(df.columns)], *((F.col(c) - sum((F.col(f"__{e}_{c}") for e in which), F.lit(0.0))).alias(f"__r_{c}") for c in columns))

    for _ in range(1 if len(effects) == 1 else rounds):
        worst = 0.0
        for e in effects:
            means = less([x for x in effects if x != e]).groupBy(e).agg(*(F.avg(f"__r_{c}").alias(f"__{e}_{c}") for c in columns))
            change = means.join(off[e].select(e, *(F.col(f"__{e}_{c}").alias(f"__old_{c}") for c in columns)), e)
            step = cut(change)
            off[e] = step.select(e, *(f"__{e}_{c}" for c in columns))
            top = step.agg(*(F.max(F.abs(F.col(f"__{e}_{c}") - F.col(f"__old_{c}"))).alias(c) for c in columns)).first()
            worst = max(worst, *(x or 0.0 for x in top))
        if worst < tolerance:
            break
    else:
        if len(effects) > 1:
            raise ArithmeticError(f"effects {effects}: not converged after {rounds} rounds, last change {worst}")
    done = less(effects)
    return cut(done.select(*(c for c in df.columns if c not in columns), *(F.col(f"__r_{c}").alias(c) for c in columns)))


def ols(df: DataFrame, y: str, x: list[str], effects: list[str] | None = None) -> dict:
    """Least squares of y on x with HC1 errors; effects are absorbed, collinear later terms dropped and named.

    Rows with a null in a used column are left out. X'X, X'y and the robust middle are sums in Spark.
    """
    effects = effects or []
    used = df.select(F.col(y).cast("double").alias("__y"), *(F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(x)), *effects).na.drop()
    used = cut(_drop_singletons(used, effects))
    total = used.agg(F.count("*").alias("n"), F.var_pop("__y").alias("v")).first()
    n, sst = total.n, (total.v or 0.0) * total.n
    levels = sum(used.select(e).distinct().count() for e in effects)
    columns = ["__y", *(f"__x{k}" for k in range(len(x)))]
    rows = _within(used, columns, effects) if effects else used
    names = list(x) if effects else ["(intercept)", *x]
    design = [F.col(c) for c in columns[1:]] if effects else [F.lit(1.0), *(F.col(c) for c in columns[1:])]
    k = len(design)
    if not n or not k:
        return {"terms": {}, "dropped": names, "n": n, "r2": None, "within_r2": None}
    sums = rows.agg(
        *(F.sum(design[i] * design[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)),
        *(F.sum(design[i] * F.col("__y")).alias(f"b{i}") for i in range(k)),
        F.sum(F.col("__y") * F.col("__y")).alias("yy"),
    ).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    b = np.array([sums[f"b{i}"] for i in range(k)], float)
    keep: list[int] = []
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    for i in range(k):
        trial = [*keep, i]
        r = a[np.ix_(trial, trial)] / np.outer(scale[trial], scale[trial])
        if a[i, i] > 1e-12 and np.linalg.eigvalsh(r)[0] > 1e-10:
            keep = trial
    inv = np.linalg.inv(a[np.ix_(keep, keep)])
    beta = inv @ b[keep]
    fitted = sum((F.lit(float(c)) * design[i] for c, i in zip(beta, keep, strict=True)), F.lit(0.0))
    e2 = (F.col("__y") - fitted) ** 2
    mid = rows.agg(F.sum(e2).alias("rss"), *(F.sum(e2 * design[i] * design[j]).alias(f"m{i}_{j}") for i in keep for j in keep if i <= j)).first()
    m = np.array([[mid[f"m{min(i, j)}_{max(i, j)}"] for j in keep] for i in keep], float)
    free = n - len(keep) - max(0, levels - max(0, len(effects) - 1))
    v = inv @ m @ inv * n / max(1, free)
    se = np.sqrt(np.maximum(np.diag(v), 0))
    terms, far = {}, t_quantile(0.05, max(1, free))
    for c, s, i in zip(beta, se, keep, strict=True):
        t = c / s if s > 0 else math.inf
        terms[names[i]] = {"estimate": float(c), "se": float(s), "t": float(t), "p": t_p_value(float(t), max(1, free)), "low": float(c - far * s), "high": float(c + far * s)}
    rss = mid.rss or 0.0
    return {
        "terms": terms, "dropped": [names[i] for i in range(k) if i not in keep], "n": n,
        "r2": 1 - rss / sst if sst else None, "within_r2": 1 - rss / sums.yy if effects and sums.yy else None,
    }


def as_frame(spark: SparkSession, fit: dict) -> DataFrame:
    """A fit's terms as rows."""
    rows = [(t, e["estimate"], e["se"], e["t"], e["p"], e["low"], e["high"], fit["n"], fit["r2"]) for t, e in fit["terms"].items()]
    return spark.createDataFrame(rows, "term string, estimate double, se double, t double, p double, low double, high double, n_obs bigint, r2 double")
