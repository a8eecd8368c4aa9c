"""Expressions that read a model's or a search service's replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.scalars import normalise


def reply_object(c: Column) -> Column:
    """The JSON object of a reply: without code fences, else from the first brace to the last; null if neither parses."""
    bare = F.trim(F.regexp_replace(c, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    whole = F.when(F.try_parse_json(bare).isNotNull(), bare)
    return F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner))


def verdict6(c: Column) -> Column:
    """A verdict in one of six classes; others are unverified."""
    t = F.regexp_replace(normalise(c), r"[\s-]+", "_")
    t = F.when(t.isin("partly_true", "half_true", "partially_true"), "mixed").otherwise(t)
    return F.when(t.isin("false", "mostly_false", "mixed", "mostly_true", "true"), t).otherwise("unverified")


def verdict3(c: Column) -> Column:
    t = normalise(c)
    return F.when(t.isin("false", "true"), t).otherwise("unverified")


def stance(c: Column) -> Column:
    t = normalise(c)
    return F.when(t.isin("asserted", "quoted", "unclear"), t).otherwise("unclear")


def claim_list(claims: Column, most: int = 3) -> Column:
    """Usable claims of an array of (claim, claim_normalized, query): trimmed, with both claim and query, the first ones."""
    shaped = F.transform(
        claims,
        lambda x: F.struct(
            F.trim(x["claim"]).alias("claim"),
            F.coalesce(F.nullif(F.trim(x["claim_normalized"]), F.lit("")), F.trim(x["claim"])).alias("claim_normalized"),
            F.trim(x["query"]).alias("query"),
        ),
    )
    return F.slice(F.filter(shaped, lambda x: (F.coalesce(x["claim"], F.lit("")) != "") & (F.coalesce(x["query"], F.lit("")) != "")), 1, most)


SEARCH_SCHEMA = (
    "struct<answerBox:struct<title:string,answer:string,snippet:string,link:string>,"
    "knowledgeGraph:struct<title:string,type:string,description:string>,"
    "organic:array<struct<title:string,link:string,snippet:string,date:string>>>"
)


def search_text(payload: Column) -> Column:
    """A search payload as text: featured answer, knowledge panel, then numbered results; malformed payloads give ''."""
    p = F.from_json(payload, SEARCH_SCHEMA)
    box, panel = p["answerBox"], p["knowledgeGraph"]
    featured = F.when(box.isNotNull(), F.concat(F.lit("[Featured] "), F.coalesce(box["title"], F.lit("")), F.lit(": "), F.coalesce(box["answer"], box["snippet"], F.lit(""))))
    known = F.when(panel.isNotNull(), F.concat(F.lit("[Panel] "), F.coalesce(panel["title"], F.lit("")), F.lit(" - "), F.coalesce(panel["description"], F.lit(""))))
    line = lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), F.coalesce(x["title"], F.lit("")), F.when(x["date"].isNotNull(), F.concat(F.lit(" ("), x["date"], F.lit(")"))).otherwise(""),
        F.lit(" - "), F.coalesce(x["snippet"], F.lit("")),
    )
    return F.concat_ws("\n", featured, known, F.array_join(F.transform(F.coalesce(p["organic"], F.array().cast("array<struct<title:string,link:string,snippet:string,date:string>>")), line), "\n"))
