"""Sentence boundaries across languages and scripts, as built-in column expressions.

Marks that do not end a sentence (decimals, URLs, initials, abbreviations, quoted speech, pauses) are
replaced one for one by private-use placeholders, so that positions hold; the masked text is cut at the
terminators left; the sentences are the original text between the positions found.

Defined cases: null and blank texts give no sentence; a text without terminators gives one sentence for
each line; repeated rows give the same sentences; any length is handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import table

# Placeholders.
MASK, QUOTED, QUOTE_END, SOFT_END = "\ue000", "\ue003", "\ue001", "\ue002"

# Marks by role.
LATIN_ENDS = r".!?…"
SCRIPT_ENDS = r"。！？｡।॥؟۔"
ENDS = LATIN_ENDS + SCRIPT_ENDS
CLOSERS = r"\"'”’»)\]}】」』）"
OPENERS = r"¿¡“„«‘(\[「『\"'"
EMOJI = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}"
BREAKS = r"\n\x0b\x0c\r\x85\u2028\u2029"

# Abbreviations that stand before a name or a further word and so never end a sentence.
NEVER_LAST = (
    "mr mrs ms mx dr drs prof st sr sra srta dra hr fr hrn sen rep gen gov lt col sgt capt rev hon mt mme mlle "
    "sig dott ing approx aprox vs i.e e.g al ca cf env bzw np tj ul ул г-н г-жа им डॉ श्री د av avda"
).split()
# Abbreviations that may end a sentence; they do where a capital follows.
MAYBE_LAST = "etc inc ltd co corp llc p.m a.m u.s u.k e.u usw ecc itd itp др т.д т.п т. д т. п dept est jr".split(" ")
# Abbreviations before a number.
BEFORE_NUMBER = "no nr fig figs núm num nº pp p pg pág vol ch art sec eq д рис стр с č".split()
# German months, after an ordinal with a dot.
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner"


def _any(words: list[str]) -> str:
    dot = f"[.{MASK}]"
    return "|".join(w.replace(".", dot) for w in sorted(filter(None, words), key=len, reverse=True))


_START = r"(?<![\p{L}\p{N}\p{M}.%s])" % MASK
_SP = r"[ \u00a0]"
# A closing single quote is not within a word; what may stand before it in its line.
_SINGLE = r"(?:[^‘’\n%s]|’(?=\p{L}))*+"
# Quoted speech: first the marks just before a closing quote, then those further inside, then the quotes that end a sentence.
# Where an opening quote decides, a match begins with it or where the last match ended (\G), so that quotes of any length are seen.
_QUOTES: list[tuple[str, str]] = [
    (r"[%s](?=%s?[”»」』])" % (ENDS, _SP), QUOTED),
    (r"(„[^“”„\n]*?)[%s](?=“)" % ENDS, "$1" + QUOTED),
    (r"(?m)[%s](?=\"(?:[^\"\n]*+\"[^\"\n]*+\")*+[^\"\n]*+$)" % ENDS, QUOTED),
    (
        r"(?m)[%s](?:(?=[^“”\n]*+”)|(?=[^«»\n]*+»)|(?=[^「」\n]*+」)|(?=[^\"\n]*+\"(?:[^\"\n]*+\"[^\"\n]*+\")*+[^\"\n]*+$))" % ENDS,
        MASK,
    ),
    (r"((?!\A)\G|„)([^“”„\n%s]*+)[%s](?=[^“”„\n]*+“)" % (ENDS, ENDS), "$1$2" + MASK),
    (r"((?!\A)\G|(?<![\p{L}\p{N}])‘)(%s)[%s](?=%s’)" % (_SINGLE % ENDS, ENDS, _SINGLE % ""), "$1$2" + MASK),
    (r"[”»“」』\"](?=%s+[\p{Lu}\p{Lt}%s])(?<=%s%s?.)" % (_SP, OPENERS, QUOTED, _SP), QUOTE_END),
]
# All in one pass; each case first takes the mark and then looks ahead and back, so nothing is tried at other characters.
_INSIDE = "|".join(
    [
        # inside words, numbers, links, before a comma; inside a word in capitals; after a capital without a space
        r"(?=[^\s\u00a0\p{Lu}\p{Lt}\p{Lo}%s%s%s%s])" % (ENDS, CLOSERS, OPENERS, EMOJI),
        r"(?=[\p{Lu}\p{N}])(?<=[\p{Lu}\p{N}][!?])",
        r"(?=[\p{Lu}\p{Lo}])(?<=\.)(?<![\p{Ll}\p{Lo}\p{M}\p{N}%s].)" % CLOSERS,
        # initials and abbreviations
        r"(?=%s?\p{L})(?<=(?<![\p{L}\p{N}\p{M}.*@$%s'’])[\p{L}&&[^I]]\.)" % (_SP, MASK),
        r"(?=%s?[^%s\s])(?<=%s(?i:%s)\.)" % (_SP, ENDS, _START, _any(NEVER_LAST)),
        r"(?=%s?\p{N})(?<=%s(?i:%s)\.)" % (_SP, _START, _any(BEFORE_NUMBER)),
        r"(?=%s?[^\p{Lu}\p{Lt}\s%s%s%s])(?<=%s(?i:%s)\.)" % (_SP, ENDS, CLOSERS, OPENERS, _START, _any(MAYBE_LAST)),
        # ordinals and dates
        r"(?=%s(?:%s))(?<=(?<!\p{N})\p{N}{1,2}\.)" % (_SP, MONTHS),
        r"(?=%s\p{Ll})(?<=\p{N}\.\p{N}{1,2}\.)" % _SP,
        # dots that mark a pause
        r"(?=\.++%s+\p{Ll})(?<=\.)" % _SP,
        r"(?=%s+\p{Ll})(?<=\.\.|…)" % _SP,
        r"(?=…*+\p{Lo})(?<=…)",
    ]
)
# Marks of whole lines, forward from their start: the dot after a list item's number, all marks of a line without letters.
_LINE_MARKS: list[tuple[str, str]] = [
    (r"(?m)^([ \t]*+\p{N}++)\.(?=[ \t])", "$1" + MASK),
    (r"(?m)(^(?=[^\p{L}\n]*+$)|(?!\A)\G)([^\p{L}\n%s]*+)[%s]" % (LATIN_ENDS, LATIN_ENDS), "$1$2" + MASK),
]
# Ends without a mark: an emoji (not at the start of a line) before a capital, a space between Thai or Lao letters.
_SOFT = r"([^\s%s]%s{0,2}[%s]+)%s(?=[\p{Lu}\p{Lt}\p{Lo}¿¡“„«(「])|([฀-໿]) (?=[฀-໿])" % (EMOJI, _SP, EMOJI, _SP)
_TILE = (
    r"[^%(t)s%(s)s]*+(?:[%(t)s]++[%(t)s%(c)s]*+(?:[ \u00a0]*+[%(e)s]++)*+|%(s)s|$)"
    % {"t": ENDS + QUOTE_END, "s": SOFT_END, "c": CLOSERS, "e": EMOJI}
)
_BLANK = "".join(filter(str.isspace, map(chr, range(0x3001)))) + SOFT_END + "\u200b\ufeff"


def masked(text: Column) -> Column:
    """text with a placeholder for each mark that ends no sentence, as long as text."""
    quoted = text
    for pattern, to in _QUOTES:
        quoted = F.regexp_replace(quoted, F.lit(pattern), F.lit(to))
    text = F.when(text.rlike("[”»」』“’\"]"), quoted).otherwise(text)
    text = F.regexp_replace(text, F.lit(f"(?m)[{LATIN_ENDS}](?:{_INSIDE})"), F.lit(MASK))
    for pattern, to in _LINE_MARKS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return F.regexp_replace(text, F.lit(_SOFT), F.lit("$1$2" + SOFT_END))


#: Pieces whose starts are found in one fold; longer arrays are folded in parts of so many.
PART = 128


def _fold_offsets(pieces: Column, start: Column, gap: int) -> Column:
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("done"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p) + gap).cast("int").alias("at"), F.concat(acc["done"], F.array(acc["at"])).alias("done")
    )
    return F.aggregate(pieces, zero, step)["done"]


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _offsets(pieces: Column, gap: int) -> Column:
    """Start of each piece, where pieces follow one another with gap characters between them.

    A fold copies the array that it grows, so long arrays are cut into parts: the parts' starts first, then those in each part.
    """

    def of_parts(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.array_join(p, " " * gap))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), _fold_offsets(whole, F.lit(0), gap).alias("at")), lambda x: _fold_offsets(x["p"], x["at"], gap)))

    parts = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(PART)), lambda k: F.slice(pieces, k, F.lit(PART)))
    return F.when(F.size(pieces) <= PART, _fold_offsets(pieces, F.lit(0), gap)).otherwise(_let(parts, of_parts))


def _spans_of_line(line: Column, at: Column) -> Column:
    span = lambda x: F.struct(
        (at + x["off"] + F.length(x["tile"]) - F.length(F.ltrim(x["tile"], F.lit(_BLANK)))).cast("int").alias("start_char"),
        (at + x["off"] + F.length(F.rtrim(x["tile"], F.lit(_BLANK)))).cast("int").alias("end_char"),
    )
    spans = lambda tiles: F.transform(F.arrays_zip(tiles.alias("tile"), _offsets(tiles, 0).alias("off")), span)
    return F.filter(_let(F.regexp_extract_all(line, F.lit(_TILE), F.lit(0)), spans), lambda s: s["start_char"] < s["end_char"])


def sentence_spans(text: Column) -> Column:
    """Array of (start_char, end_char) of the sentences of text, in code points; null text gives null."""

    def of(lines: Column) -> Column:
        both = F.arrays_zip(lines.alias("line"), _offsets(lines, 1).alias("at"))
        return F.flatten(F.transform(both, lambda x: _spans_of_line(x["line"], x["at"])))

    return _let(F.split(masked(text), f"[{BREAKS}]", -1), of)


def sentence_rows(text: Column) -> Column:
    """sentence_spans() with each sentence's text, cut from its own line, so that a long text is not searched from its start each time."""

    def of(lines: Column) -> Column:
        each = F.arrays_zip(lines.alias("line"), _offsets(lines, 1).alias("at"), F.split(text, f"[{BREAKS}]", -1).alias("own"))
        cut = lambda x, s: F.struct(
            s["start_char"].alias("start_char"), s["end_char"].alias("end_char"),
            F.substring(x["own"], s["start_char"] - x["at"] + 1, s["end_char"] - s["start_char"]).alias("sentence"),
        )
        return F.flatten(F.transform(each, lambda x: F.transform(_spans_of_line(x["line"], x["at"]), lambda s: cut(x, s))))

    return _let(F.split(masked(text), f"[{BREAKS}]", -1), of)


def split_sentences(
    df: DataFrame, text: str = "body_for_analysis", keys: tuple[str, ...] = ("author", "permlink"), sentence: bool = True
) -> DataFrame:
    """One row (keys, start_char, end_char, and sentence if asked for) for each sentence of each distinct text of a key.

    Only keys and text are read, so other columns of any name do no harm. A post of repeated rows counts once.
    No text is shuffled: the sentences of a row depend on that row alone.
    """
    of = sentence_rows if sentence else sentence_spans
    return df.select(*keys, F.inline(of(F.col(text))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "hive_cleaned"), sentence=False).distinct()


def p5_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences for each author: how many, of which mean and greatest length."""
    found = split_sentences(table(spark, sf_dir, "hive_cleaned"), sentence=False).distinct()
    n = F.col("end_char") - F.col("start_char")
    return found.groupBy("author").agg(
        F.count("*").alias("n_sentences"),
        F.countDistinct("permlink").alias("n_posts"),
        F.round(F.avg(n), 6).alias("mean_chars"),
        F.max(n).cast("bigint").alias("max_chars"),
    )


QUERIES = {"p5_found": p5_found, "p5_sentence_stats": p5_sentence_stats}
ORACLES: dict[str, str] = {}
