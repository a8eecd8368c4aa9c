"""Where a claim stands in its text: windows, spans, merged intervals, marked HTML.

Exact matches are column expressions; folded and fuzzy matches walk characters and run as Arrow functions.
"""

from __future__ import annotations

import difflib
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Quotes and dashes in one form.
FOLD = str.maketrans("“”„«»‘’‚–— ", "\"\"\"\"\"'''-- ")


def exact_window(text: Column, claim: Column, radius: int = 1200) -> Column:
    """The text around the first place of claim, null if it does not stand there."""
    at = F.instr(text, claim)
    start = F.greatest(F.lit(1), at - radius)
    return F.when((at > 0) & (F.length(claim) > 0), F.substring(text, start, at - start + F.length(claim) + radius))


def fold_map(text: str) -> tuple[str, list[int]]:
    """text with one form of quotes, single spaces and lower case, and each character's place in text."""
    out, at, space = [], [], True
    for k, c in enumerate(text.translate(FOLD)):
        if c.isspace():
            if not space:
                out.append(" ")
                at.append(k)
            space = True
            continue
        for low in c.lower():
            out.append(low)
            at.append(k)
        space = False
    return "".join(out), at


def find_span(text: str, claim: str, fuzzy: bool = True) -> tuple[int, int] | None:
    """Start and end of claim in text: as it is, folded, or by matching blocks that cover most of it in a short stretch."""
    if not text or not claim or not claim.strip():
        return None
    at = text.find(claim)
    if at >= 0:
        return at, at + len(claim)
    (t, places), (c, _) = fold_map(text), fold_map(claim)
    c = c.strip()
    at = t.find(c)
    if c and at >= 0:
        return places[at], places[at + len(c) - 1] + 1
    if not fuzzy or not c:
        return None
    blocks = [b for b in difflib.SequenceMatcher(None, t, c, autojunk=False).get_matching_blocks() if b.size >= 4]
    if not blocks or sum(b.size for b in blocks) < 0.85 * len(c):
        return None
    lo, hi = blocks[0].a, blocks[-1].a + blocks[-1].size
    return (places[lo], places[hi - 1] + 1) if hi - lo <= 1.6 * len(c) else None


def window(text: str, claim: str, radius: int = 1200) -> str:
    """The text around claim: exact, by its first 60 characters, folded, by its folded first 80, else the beginning."""
    if not text:
        return ""
    place, size = -1, 0
    for piece in (claim or "", (claim or "")[:60]):
        if piece.strip() and place < 0:
            place, size = text.find(piece), len(piece)
    if place < 0 and (claim or "").strip():
        (t, places), (c, _) = fold_map(text), fold_map(claim)
        for piece in (c.strip(), c.strip()[:80]):
            at = t.find(piece) if piece else -1
            if at >= 0:
                place, size = places[at], places[at + len(piece) - 1] + 1 - places[at]
                break
    if place < 0:
        return text[: 2 * radius]
    return text[max(0, place - radius) : place + size + radius]


@pandas_udf(StringType())
def context_window(text: pd.Series, claim: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else window(t, c or "") for t, c in zip(text, claim)])


@pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def claim_span(text: pd.Series, claim: pd.Series) -> pd.DataFrame:
    found = [find_span(t or "", c or "") or (None, None) for t, c in zip(text, claim)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


def merge_spans(spans: Column) -> Column:
    """Sorted spans (start, end) with those that overlap or touch joined."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last.isNotNull() & (s["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans).cast(kind), F.array().cast(kind), step)


def marked_html(text: str, spans: list[tuple[int, int]]) -> str:
    """Escaped text with <mark> around merged spans and <br> for line breaks."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            a = at
        if b <= a:
            continue
        out += [html.escape(text[at:a]), "<mark>", html.escape(text[a:b]), "</mark>"]
        at = b
    out.append(html.escape(text[at:]))
    return re.sub(r"\r?\n", "<br>", "".join(out))
