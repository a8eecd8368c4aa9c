"""Share of a post's text in one language, measured sentence by sentence with any detector.

Everything is decided within a row by array functions, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import language_text, sentences, strip_space


def detector_function(make: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A detector of arrays of sentences from a Python one, which is made once for each task; sentences on which it fails have no language."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = make()

        def safe(s: str) -> str | None:
            try:
                return detect(s)
            except Exception:  # noqa: BLE001 - a sentence that the detector cannot judge is left out
                return None

        for part in parts:
            yield part.map(lambda ss: None if ss is None else [safe(s) for s in ss])

    return F.pandas_udf(run, "array<string>", F.PandasUDFType.SCALAR_ITER)


def language_profile(
    df: DataFrame, text: str, detect: Callable[[Column], Column], want: str = "en", share: float = 0.9, least_chars: int = 30, sentence_chars: int = 15
) -> DataFrame:
    """df with pct_english, dominant_lang and lang_status of column text; detect maps an array of sentences to their languages.

    Sentences are cleaned of code, links and tags; those shorter than sentence_chars are not judged. The status is empty for null and blank
    texts, too_short where less than least_chars characters could be judged, kept from the given share on, else dropped_low_english.
    The dominant language has most characters, the first seen among equals; it is blank and the share 0 for the first two.
    """
    cleaned = F.filter(F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), language_text), lambda s: F.length(s) >= sentence_chars)
    rows = df.withColumn("__s", cleaned).withColumn("__l", detect(F.col("__s")))
    pairs = F.filter(F.transform(F.arrays_zip(F.col("__s").alias("s"), F.col("__l").alias("l")), lambda x: F.struct(x["l"].alias("l"), F.length(x["s"]).alias("n"))), lambda x: x["l"].isNotNull())
    rows = rows.withColumn("__p", pairs)
    chars = lambda keep: F.aggregate(F.filter("__p", keep), F.lit(0), lambda acc, x: acc + x["n"])
    langs = F.array_distinct(F.transform("__p", lambda x: x["l"]))
    best = F.array_max(F.transform(langs, lambda name, i: F.struct(chars(lambda x: x["l"] == name).alias("n"), (-i).alias("first"), name.alias("l"))))["l"]
    total, own = chars(lambda x: F.lit(True)), chars(lambda x: x["l"] == want)
    rows = rows.withColumns({"__total": total, "__own": own, "__best": best})
    blank = F.coalesce(strip_space(F.col(text)), F.lit("")) == ""
    pct = F.when(blank | (F.col("__total") < least_chars), 0.0).otherwise(F.col("__own") / F.col("__total"))
    status = F.when(blank, "empty").when(F.col("__total") < least_chars, "too_short").when(pct >= share, "kept").otherwise("dropped_low_english")
    judged = status.isin("kept", "dropped_low_english")
    out = {"pct_english": pct, "dominant_lang": F.when(judged, F.col("__best")).otherwise(""), "lang_status": status}
    return rows.withColumns(out).drop("__s", "__l", "__p", "__total", "__own", "__best")
