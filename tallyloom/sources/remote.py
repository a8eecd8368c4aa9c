"""Scans of remote tables in ranges and by keys. Credentials come from the environment alone."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Account names that may stand in a key list.
ACCOUNT = r"^[a-z0-9.\-]{3,16}$"


def week_ranges(start: dt.date, end: dt.date, days: int = 7) -> list[tuple[str, dt.date, dt.date]]:
    """Half-open ranges of days clamped at end, with labels."""
    out, a = [], start
    while a < end:
        b = min(a + dt.timedelta(days=days), end)
        out.append((f"week{len(out) + 1:02d}_{a}_{b}", a, b))
        a = b
    return out


def week_predicates(column: str, start: dt.date, end: dt.date, extra: str = "") -> list[str]:
    """One condition for each range: a remote scan runs them as parallel partitions."""
    tail = f" AND {extra}" if extra else ""
    return [f"{column} >= '{a}' AND {column} < '{b}'{tail}" for _, a, b in week_ranges(start, end)]


def read_remote(spark: SparkSession, url: str, name: str, predicates: list[str], prefix: str = "TALLYLOOM_DB") -> DataFrame:
    """A remote table by JDBC; user and password from the variables PREFIX_USER and PREFIX_PASSWORD."""
    missing = [f"{prefix}_{k}" for k in ("USER", "PASSWORD") if f"{prefix}_{k}" not in os.environ]
    if missing:
        raise OSError(f"set {', '.join(missing)}")
    properties = {"user": os.environ[f"{prefix}_USER"], "password": os.environ[f"{prefix}_PASSWORD"]}
    return spark.read.jdbc(url, name, predicates=predicates, properties=properties)


def valid_accounts(keys: DataFrame, column: str) -> DataFrame:
    return keys.select(F.lower(F.trim(column)).alias(column)).where(F.col(column).rlike(ACCOUNT)).distinct()


def scan_keys(facts: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of facts whose columns stand in keys: a semi-join in place of batches of key lists."""
    return facts.join(keys.select(*columns).distinct(), columns, "left_semi")


def columns_of(df: DataFrame) -> DataFrame:
    """(column_name, data_type, position) of a table."""
    rows = [(n, t, k) for k, (n, t) in enumerate(df.dtypes, 1)]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, position int")
