"""Text expressions shared by the operators. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it, for a Java character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Word characters of the WordPunct tokenizer.
WORD = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    """c without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def fold(c: Column) -> Column:
    """Trimmed and lower-cased; blank becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def wordpunct_count(c: Column) -> Column:
    """Number of WordPunct tokens: longest runs of word characters or of other non-space characters; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[{WORD}]+|[^{WORD}{WS}]+")), F.lit(0)).cast("bigint")
