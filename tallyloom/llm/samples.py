"""Bounded samples of rows for training, alike at every size of input."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows kept beyond the bound before the sort, as a factor: what reaches the driver stays in proportion to the bound.
SPARE = 2.0


def unit_hash(seed: int, *keys: str) -> Column:
    """A number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def lowest_by_hash(df: DataFrame, keys: list[str], limit: int, seed: int) -> DataFrame:
    """At most limit rows, those of the lowest hashes of keys; equal rows of a key are ordered by all columns.

    Without the first cut each task would send limit rows to the driver.
    """
    n = df.count()
    h = unit_hash(seed, *keys)
    near = df.where(h < F.lit(min(1.0, SPARE * limit / max(1, n)))) if n > SPARE * limit else df
    return near.orderBy(h, *df.columns).limit(limit)


_MODELS: dict = {}
#: Models kept at once; the oldest gives way.
KEPT = 8


def trained_once(spark: SparkSession, name: str, sf_dir: str, train: Callable[[], Any]) -> Any:
    """The model that train makes from the tables in sf_dir, made once in an application for all queries that use it.

    Tables written anew under the same path in one application would still get the old model; operators called with their own tables train each time.
    """
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _MODELS:
        while len(_MODELS) >= KEPT:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[key] = train()
    return _MODELS[key]
