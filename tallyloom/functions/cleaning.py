"""Cleaning of post bodies: chains of built-in regular-expression steps, each in its place, as order matters.

Null texts become empty; only line feeds end lines; white space and word characters are those of Unicode. Repeated groups are
possessive or written as classes, so that texts of any length are matched without deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import WS

FENCE = "```"
WORD = r"\p{L}\p{N}_"
#: Start and end of a word, as of Unicode.
EDGE = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
#: The characters of white space.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Private-use marks that stand in a text between two steps.
OPEN, SHUT = "\ue000", "\ue001"

# Languages named after a code fence whose blocks are code.
CODE_LANGUAGES = (
    "python py ipython javascript js typescript ts bash sh shell zsh fish powershell ps cmd sql mysql postgresql sqlite json yaml yml toml ini xml "
    "java kotlin scala groovy cpp c++ c csharp cs c# rust rs go golang php ruby rb perl lua html css scss sass less dockerfile makefile cmake "
    "r matlab octave diff patch regex regexp"
).split(" ")
# Phrases of closing lines.
FOOTERS = [
    r"thanks?\s+(?:so\s+much\s+)?for\s+(?:reading|stopping\s+by|visiting|watching|taking\s+the\s+time)",
    r"thank\s+you\s+(?:so\s+much\s+)?for\s+(?:reading|stopping\s+by|visiting|watching|taking\s+the\s+time)",
    r"have\s+a\s+(?:great|wonderful|nice|good|blessed|amazing|productive)\s+(?:day|week|weekend|evening|night|morning)",
    r"see\s+you\s+(?:tomorrow|soon|next\s+time|in\s+the\s+next\s+post)",
    r"until\s+(?:next\s+time|tomorrow|the\s+next\s+post)",
    r"don'?t\s+forget\s+to\s+(?:upvote|comment|follow|reblog|like|subscribe)",
    r"if\s+you\s+(?:liked|enjoyed)\s+this\s+post",
    r"translated\s+(?:with|using)\s+(?:deepl|google\s+translate|chatgpt)",
    r"for\s+the\s+best\s+experience\s+view\s+this\s+post\s+on",
]
#: Characters at a text's end in which a footer may begin, and the length below which a text has none.
TAIL, SHORT = 400, 200
# Calls to act in spoken texts, as they are, and with what follows them.
TIGHT_CALLS = [
    r"\blike (and )?subscribe\b", r"\bcomment below\b", r"\bhit (the )?(notification )?bell\b", r"\b(please |make sure to )?ring (the )?bell\b",
    r"\bstay tuned\b", r"\bturn on notifications\b", r"\bclick the link (below|in the description)\b", r"\bsmash (that |the )?like button\b",
    r"\bthanks for watching\b", r"\b(I'll |we'll )?see you (next time|in the next (video|one))\b",
]
BOUNDED_CALLS = [
    r"\bdon'?t forget to [^.!?\n]{0,60}", r"\bsupport us on [^.!?\n]{0,40}", r"\bcheck out (our|my) [^.!?\n]{0,40}",
    r"\bsubscribe to [^.!?\n]{0,25}? channel\b", r"\bleave (your |a )?(opinion |comment )?below[^.!?\n]{0,40}",
]


def unicode_pattern(pattern: str) -> str:
    """pattern with white space, word characters and word edges of Unicode, spelled out as classes."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        known = {r"\s": (f"[{WS}]", WS), r"\S": (f"[^{WS}]", None), r"\w": (f"[{WORD}]", WORD), r"\b": (EDGE, None)}
        if two in known:
            out.append(known[two][inside])
            k += 2
        elif pattern[k] == "\\":
            out.append(two)
            k += 2
        else:
            inside = pattern[k] == "[" or inside and pattern[k] != "]"
            out.append(pattern[k])
            k += 1
    return "".join(out)


def _sub(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, F.lit("(?d)" + unicode_pattern(pattern)), F.lit(to))
    return text


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_body(text: Column) -> Column:
    """Plain text of a post: no HTML tags, images, link targets, headings, emphasis by stars, nor more than one empty line."""
    steps = [
        (r"<[^>]+>", ""),
        (r"!\[.*?\]\(.*?\)", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"#{1,6}\s", ""),
        (r"\*{1,2}([^*]+)\*{1,2}", "$1"),
        (r"\n{3,}", "\n\n"),
    ]
    return strip_space(_sub(_or_empty(text), steps))


def language_text(text: Column) -> Column:
    """Text that tells its language: no code, links, tags, tickers or long codes."""
    steps = [
        (FENCE + r"(?s:.)*?" + FENCE, " "),
        (r"`[^`]+`", " "),
        (r"https?://\S+|www\.\S+", " "),
        (r"#\w+", " "),
        (r"\$[A-Z]{2,10}\b", " "),
        (r"\b[a-zA-Z0-9]{25,}\b", " "),
        (r"\s+", " "),
    ]
    return strip_space(_sub(_or_empty(text), steps))


def code_blocks(text: Column) -> Column:
    """Fenced blocks of a known language, or with less than 100 characters, become a space; others keep their content.

    One pass pairs the fences. A block that goes leaves its two marks together, one that stays has its content between them.
    """
    tag = r"[a-zA-Z0-9_+#-]"
    names = "|".join(x.replace("+", r"\+") for x in sorted(CODE_LANGUAGES, key=len, reverse=True))
    known = rf"(?i:{names})(?!{tag})[\s\S]*?"
    short = rf"{tag}*+\s*+[\s\S]{{0,99}}?"
    steps = [
        (rf"{FENCE}(?:{known}|{short}|{tag}*+\s*+([\s\S]*?)){FENCE}".replace(r"[\s\S]", r"(?s:.)"), OPEN + "$1" + SHUT),
        (OPEN + SHUT, " "),
        (f"[{OPEN}{SHUT}]", ""),
    ]
    return _sub(text, steps)


def trim_footer(text: Column) -> Column:
    """Cut at a closing phrase within the last 400 characters, if in the second half of a text of at least 200."""
    n = F.length(text)
    start = F.greatest(F.lit(0), n - TAIL)
    tail = F.substring(text, start + 1, F.lit(TAIL))
    before = _sub(tail, [(r"(?is)\b(?:" + "|".join(FOOTERS) + r")\b.*\z", "")])
    at = start + F.length(before)
    hit = (n >= SHORT) & (F.length(before) < F.length(tail)) & (at >= 0.5 * n)
    return F.when(hit, F.rtrim(F.substring(text, F.lit(1), at.cast("int")), F.lit(" \t.,;:-\n"))).otherwise(text)


def clean_post(text: Column) -> Column:
    """Prose of a post without markup, links, tables, mention lists, tickers, codes, tags at the end and footers."""
    steps = [
        (r"`[^`\n]+`", " "),
        (r"https?://\S+|www\.\S+", " "),
        (r"(?m)^\s*\|?[\s:|-]+\|?\s*$", ""),
        (r"(?m)^\s*\|.*\|\s*$", " "),
        (r"(?m)^\s*[-*_]\s*[-*_]\s*[-*_][-*_\s]*$", ""),
        (r"(?m)^\s*#{1,6}\s+", ""),
        (r"(?m)^>\s*", ""),
        (r"(?m)^\s*(?:[-*+]|\p{Nd}+\.)\s+", ""),
        (r"(?m)^\s*\[\^[^\]]+\]:.*$", ""),
        (r"(?im)^\s*posted\s+(?:via|using|with|from|on)\s+.*$", ""),
        (r"(?:@[a-zA-Z0-9.\-]{3,16}[\s,;]++){4,}+@?[a-zA-Z0-9.\-]{0,16}", " "),
        (r"\$[A-Z]{2,10}\b", " "),
        (r"\b[a-zA-Z0-9]{25,}\b", " "),
        (r"\[\^[^\]]+\]", ""),
        (r"~~([^~]+)~~", "$1"),
        (r"((?:#\w++\s*+){2,}+)(?!\z)|(?:#\w++\s*+){2,}+\z", "$1"),  # a run within the text is passed over whole
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"\*{1,3}([^*\n]+?)\*{1,3}", "$1"),
        (r"(?<!\w)_{1,3}([^_\n]+?)_{1,3}(?!\w)", "$1"),
        (r"\n{3,}", "\n\n"),
        (r"[ \t]+", " "),
        (r"(?m)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""),
        (r"\n{3,}", "\n\n"),
    ]
    return trim_footer(strip_space(_sub(code_blocks(_or_empty(text)), steps)))


def plain_post(text: Column) -> Column:
    """A post as one line: no code, images, link targets, tags or markup characters."""
    steps = [
        (r"(?s)" + FENCE + ".*?" + FENCE, " "),
        (r"`[^`]*`", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"<[^>]+>", " "),
        (r"https?://\S+|www\.\S+", " "),
        (r"[#>*_~`|]+", " "),
        (r"\s+", " "),
    ]
    return strip_space(_sub(_or_empty(text), steps))


def dictionary_text(text: Column) -> Column:
    """Lower-cased words of letters, digits and @, with single spaces."""
    return F.trim(_sub(F.lower(text), [(r"[^a-z0-9@ ]+", " "), (r" +", " ")]))


def lexicon_text(text: Column, lemmatize: Callable[[Column], Column] | None = None) -> Column:
    """Lower-cased text for lexicon lookups: no brackets, links, tags, other than ASCII, stutters, nor single letters but a and i.

    lemmatize, if given, makes base forms of the words of the cleaned text.
    """
    steps = [
        (r"\[.*?\]", ""),
        (r"\(.*?\)", ""),
        (r"https?://\S+|www\.\S+", ""),
        (r"#\w+", ""),
        (r"[^\x00-\x7F]+", ""),
        (r">+", ""),
        (r"-{2,}", ""),
        (r"[^\w\s.,!?]", ""),
        (r"\b(\w{1,3})(?:\s+\1){2,}+\b", ""),
        (r"\b(?![ai]\b)[a-zA-Z]\b", ""),
        (r"\s+", " "),
    ]
    clean = strip_space(_sub(F.lower(_or_empty(text)), steps))
    return lemmatize(clean) if lemmatize else clean


def transcript_text(text: Column) -> Column:
    """Speech of a transcript: no notes in brackets, time marks, speakers, links, tags nor calls to act; stutters end after two."""
    steps = [
        (r"\[[^\]]*\]", " "),
        (r"\([^)]*\)", " "),
        (r"\b\d{1,2}:\d{2}(?::\d{2})?\b", " "),
        (r"(?:>>\s*)?[A-Z][A-Z\s.\-]{1,30}:", " "),
        (r"\s*>>\s*", " "),
        (r"https?://\S+|www\.\S+", " "),
        (r"#\w+", " "),
        *((f"(?i){p}", " ") for p in TIGHT_CALLS + BOUNDED_CALLS),
        (r"\b(\w{1,3})(?:\s+\1){2,}+\b", "$1 $1"),
        (r"-{2,}", " "),
        (r"\s+", " "),
    ]
    return strip_space(_sub(_or_empty(text), steps))


def sentences(text: Column) -> Column:
    """Array of sentences: lines cut after end marks followed by space; blanks dropped."""
    lines = F.split(text, r"\n")
    cut = F.flatten(F.transform(lines, lambda x: F.split(F.trim(x), r"(?<=[.!?])\s+")))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


# Abbreviations after which a sentence goes on.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc inc ltd co u.s u.k e.g i.e a.m p.m no vol fig approx dept".split(" ")


def merged_sentences(text: Column, least: int = 15) -> Column:
    """Sentences, those cut after an abbreviation joined again; shorter ones than least are dropped.

    Whether a part goes on depends on its own last word alone, so the parts are joined by a blank or a mark and cut once more.
    """

    def joint(part: Column) -> Column:
        last = F.element_at(F.split(part, f"[{WS}]+"), -1)
        bare = F.regexp_replace(F.lower(F.regexp_replace(last, "[^a-zA-Z.]", "")), r"\.+$", "")
        return F.concat(part, F.when(bare.isin(*ABBREVIATIONS), " ").otherwise(SHUT))

    parts = F.filter(F.split(strip_space(_or_empty(text)), f"(?<=[.!?])[{WS}]+"), lambda s: s != "")
    whole = F.split(F.array_join(F.transform(parts, joint), ""), SHUT)
    return F.filter(F.transform(whole, strip_space), lambda s: F.length(s) >= least)


def is_boilerplate(sentence: Column) -> Column:
    """Too few words, mostly no letters, a link, a short lead-in, or a bullet, decoration or tag at the start."""
    s = strip_space(sentence)
    solid = F.length(_sub(s, [(r"\s+", "")]))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    like = lambda p: s.rlike(unicode_pattern(p))
    return (
        (F.regexp_count(s, F.lit("[A-Za-z]+")) < 3)
        | (letters < 0.5 * solid)
        | like(r"(?i)https?://|www\.")
        | (s.endswith(":") & (F.length(s) < 60))
        | like(rf"^(?:[^{WORD}]|_)*[◯∴•▶►★☆✔✅➤·\-=~*]+\s|^\s*#\w")
    )
