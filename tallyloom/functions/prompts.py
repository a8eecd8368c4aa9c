"""Messages to models, put together from columns, and fallbacks of what they return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import WS


def message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *parts).alias("content"))


def section(name: str, body: Column, most: int) -> Column:
    """A named part of a message, cut at most characters; null bodies give no part."""
    return F.when(body.isNotNull(), F.concat(F.lit(f"{name}:\n"), F.substring(body, 1, most)))


def classification_request(title: Column, body: Column, classes: list[str]) -> Column:
    """JSON of the messages that ask for a class of a post."""
    rules = F.lit("Reply with CLASS|topic, topic being one of: " + ", ".join(sorted(classes)))
    return F.to_json(F.array(message("system", rules), message("user", section("Title", title, 300), section("Text", body, 1500))))


def verdict_request(claim: Column, evidence: Column, context: Column) -> Column:
    rules = F.lit("Judge the claim by the evidence. Reply with JSON: verdict, stance, justification.")
    return F.to_json(F.array(message("system", rules), message("user", section("Claim", claim, 2000), section("Evidence", evidence, 8000), section("Context", context, 2400))))


def search_query(reply: Column, title: Column) -> Column:
    """A model's query without quotes around it, or the title where it is blank."""
    bare = F.regexp_replace(F.trim(reply), "^[\"'“”]+|[\"'“”]+$", "")
    return F.coalesce(F.nullif(F.trim(bare), F.lit("")), title)


def recapitalize(text: Column) -> Column:
    """text with a capital for each small letter a to z at its start, or after an end mark and white space."""

    def raised(part: Column) -> Column:
        place = F.length(F.regexp_extract(part, f"^[{WS}]*", 0)) + 1
        first = F.substring(part, place, F.lit(1))
        return F.when(first.rlike("^[a-z]$"), F.concat(F.substring(part, F.lit(1), place - 1), F.upper(first), F.substring(part, place + 1, F.length(part)))).otherwise(part)

    parts = F.split(F.regexp_replace(text, f"^[{WS}]+(?=[a-z])", ""), f"(?<=[.!?])(?=[{WS}])")
    return F.array_join(F.transform(parts, raised), "")
