"""Scalar expressions of posts, verdicts and money. All are built-in column expressions, safe under ANSI.

Nulls give null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories that count as political (the last one in the broad sense alone), and the others.
POLITICAL_US = (
    "election_campaign", "election_fraud", "trump_administration", "biden_administration", "foreign_policy", "domestic_policy",
    "political_violence", "political_commentary", "other_political",
)
POLITICAL = (*POLITICAL_US, "non_us_politics")
NONPOLITICAL = (
    "crypto_finance", "gaming", "travel_lifestyle", "entertainment", "technology", "personal", "non_us_politics", "community_platform", "other_noise",
)
# The six verdict classes from false to true, with their ranks.
VERDICTS = {"false": 0, "mostly_false": 1, "mixed": 2, "mostly_true": 3, "true": 4}
FALSE_SIDE, TRUE_SIDE = ("false", "mostly_false"), ("mostly_true", "true")


def parse_money(c: Column) -> Column:
    """First word of c as a number; null, blank and unreadable give 0."""
    return F.coalesce(F.get(F.split(F.trim(c), r"\s+"), F.lit(0)).try_cast("double"), F.lit(0.0))


def to_num(c: Column) -> Column:
    """c as a number: plain, or its first signed decimal after commas are taken out."""
    text = c.cast("string")
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1)
    return F.coalesce(text.try_cast("double"), F.nullif(found, F.lit("")).try_cast("double"))


def to01(c: Column) -> Column:
    """1 for yes, true and positive numbers, 0 for no, false and other numbers, else null."""
    t = F.lower(F.trim(c.cast("string")))
    num = t.try_cast("double")
    return (
        F.when(t.isin("true", "t", "yes", "y"), 1.0)
        .when(t.isin("false", "f", "no", "n"), 0.0)
        .when(num.isNotNull(), F.when(num > 0, 1.0).otherwise(0.0))
    )


def coalesce_text(a: Column, b: Column) -> Column:
    """a unless it is null or blank, else b."""
    return F.when(F.coalesce(F.trim(a), F.lit("")) != "", a).otherwise(b)


def normalise(c: Column) -> Column:
    """Lower-cased and trimmed; null becomes blank."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def post_id(author: Column, permlink: Column) -> Column:
    return F.concat_ws("/", F.trim(author), F.trim(permlink))


def post_link(author: Column, permlink: Column, base: str = "https://peakd.com/@") -> Column:
    return F.concat(F.lit(base), author, F.lit("/"), permlink)


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def is_political(classification: Column, category: Column) -> Column:
    return F.coalesce((classification == "YES") | category.isin(*POLITICAL), F.lit(False))


def log1p_count(c: Column) -> Column:
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is not above 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def binary_label(label: Column) -> Column:
    """misinfo, ok or abstain for a verdict label."""
    t = normalise(label)
    return (
        F.when(t.isin("misinformation", *FALSE_SIDE), "misinfo")
        .when(t.isin("ok", "mixed", *TRUE_SIDE), "ok")
        .otherwise("abstain")
    )


def claim_role(verdict: Column, stance: Column) -> Column:
    """Part that a claim plays in its post's label."""
    return (
        F.when(verdict.isin(*FALSE_SIDE), F.when(stance == "asserted", "trigger").otherwise("quoted_false"))
        .when(verdict.isin("mixed", *TRUE_SIDE), "true_side")
        .otherwise("unverified")
    )


def outcome(gold: Column, pred: Column) -> Column:
    """Cell of the confusion matrix, with misinfo as the positive class."""
    return (
        F.when(~pred.isin("misinfo", "ok"), "ABSTAIN")
        .when((gold == "misinfo") & (pred == "misinfo"), "TP")
        .when(gold == "misinfo", "FN")
        .when(pred == "misinfo", "FP")
        .otherwise("TN")
    )


def url_domain(url: Column) -> Column:
    """Authority of a URL without any www."""
    return F.replace(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("www."), F.lit(""))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def reduction_pct(before: Column, after: Column) -> Column:
    return F.try_divide((before - after).cast("double"), before.cast("double"))


def strip_controls(c: Column) -> Column:
    """c without control characters other than tab and line breaks."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def json_list_length(doc: Column, path: str) -> Column:
    """Length of a list in a JSON object; malformed documents, other roots and other values give 0."""
    is_object = doc.rlike(r"^\s*\{")
    return F.when(is_object, F.coalesce(F.json_array_length(F.get_json_object(doc, path)), F.lit(0))).otherwise(F.lit(0))


def json_author(doc: Column) -> Column:
    """The author named by an operation written as an object or as a pair."""
    return F.coalesce(F.get_json_object(doc, "$.author"), F.get_json_object(doc, "$[1].author"))


def dominant(names: list[str]) -> Column:
    """Name of the column with the greatest value, the first of equals; null if all are null."""
    values = F.array(*(F.col(n) for n in names))
    labels = F.array(*(F.lit(n) for n in names))
    return F.get(labels, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
