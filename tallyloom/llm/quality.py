"""Per-document text statistics, exact ranks within a language, outlier scores, and lists, tables and junk among prose.

Each statistic gets its exact empirical distribution within the document's language and over all documents: distinct values are
counted, sorted by range partitioning and summed with partition offsets. Ranks are taken among the documents that are no
list, table or junk by the form of most of their lines, so that they do not depend on how many of these there are. For each kind the tail probabilities of
its statistics are combined into one outlier score. A document is of a kind if it is an outlier in that direction, in its language and
over all; that most of its characters stand in such lines is checked after it. Verse and short posts share the form of lists; the score tells them apart.

Defined cases: null, empty and blank texts have statistics of 0 and no kind but perhaps `length`; a null length is
wrong; equal values share one rank; languages with fewer than SMALL documents are ranked among all documents alone; repeated
rows count once; rows without author or permlink are left out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.ranges import running_sums
from tallyloom.session import cut, table

#: Common words of a language: so many by the number of documents that hold them, from at least so many documents.
COMMON, COMMON_DOCS = 150, 5
#: Languages with fewer documents of ordinary form have no distribution of their own.
SMALL = 50
#: Tail probabilities below exp(-FAR) are all as far out: what a sample of some hundred documents can tell.
FAR = 5.0
#: Mean of the negative logarithms of a kind's tail probabilities above which a document is an outlier of that kind.
OUTLIER = 4.05
#: Rows of the table of ranks up to which it is broadcast; a larger one is joined by shuffle, in so many salted parts.
BROADCAST_RANKS, SALTS = 500_000, 16
#: Distinct words that a task holds before it passes its counts on.
FLUSH = 200_000

# Statistics and the side of their distribution that tells junk, lists and tables from prose.
SIDES = {
    "words_per_line": "low",
    "mean_word_length": "both",
    "symbol_ratio": "high",
    "digit_ratio": "high",
    "ended_lines": "low",
    "common_words": "low",
    "letter_ratio": "low",
    "item_share": "high",
    "table_share": "high",
    "junk_share": "high",
}
#: The statistics that are combined for each kind. Junk is odd in many ways, of which some hide others, so two that all junk shares.
KINDS = {
    "junk": ("junk_share", "ended_lines"),
    "table": ("table_share", "digit_ratio", "words_per_line", "common_words"),
    "list": ("item_share", "ended_lines", "words_per_line", "common_words"),
}
#: The share of characters that gives a kind its name.
SHARE_OF = {"junk": "junk_share", "table": "table_share", "list": "item_share"}
#: Statistics are kept as whole numbers of 1 / UNIT, so that equal values are equal and the table of ranks is bounded; those of LOGS as log(1 + x).
UNIT = 1_000
LOGS = ("words_per_line", "mean_word_length")

_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯऀ-෿ัิ-๎]|['’-](?=[^\W\d_]))*")
_UNSPACED = re.compile(r"[฀-໿぀-ヿ㐀-鿿]")
_ENDED = re.compile(r"[.!?…。！？।؟۔:]['\"”’»)\]」』]*\s*[\U0001f000-\U0001faff☀-➿️\s]*$")
_PLAIN = set(".,;:'\"!?()-–—…’‘“”«»„、。！？「」।¿¡/&%$€£#@*")
_MOJIBAKE = re.compile(r"Ã[\u0080-ÿ€™œžƒ‘-„]?|â[€‚][\u0080-ÿ™¬œž‘-„œ]?|Â[\u00a0-ÿ]|ï»¿|�+|ð[ŸŸ].?.?")
_SYLLABLES = re.compile(r"^(\w{1,4}?)\1+\w{0,2}$")
_MIXED = re.compile(r"(?=\S*[a-z])(?=\S*[A-Z])(?=\S*\d)[A-Za-z0-9+/=_-]{8,}|[0-9a-fA-F]*\d[0-9a-fA-F]{11,}")
_MIXTURE = re.compile(r"[A-Za-z][0-9+/=]|[0-9][A-Za-z]")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿąęóıœů]")
_FIELDS = re.compile(r"\t+|\s*[;|]\s*|\s+[,:]\s+|\s{2,}|,(?=\S)")
_NUMBER = re.compile(r"^[-+]?[\d.,]+[%a-z]{0,3}$")
# Scripts by the first word of a letter's name.
_SCRIPTS = {"CYRILLIC", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "DEVANAGARI", "THAI", "LAO", "GREEK", "HEBREW"}


@lru_cache(100_000)
def _script(c: str) -> str:
    first = unicodedata.name(c, "").split(" ")[0]
    return first if first in _SCRIPTS else "LATIN"


def script_of(text: str) -> str:
    """The script of most of the text's letters."""
    counts: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            counts[_script(c)] += n
    return counts.most_common(1)[0][0].lower() if counts else "none"


def _solid(s: str) -> int:
    return len(s) - sum(map(s.count, " \t\u00a0\u3000"))


@lru_cache(50_000)
def _symbol(c: str) -> bool:
    return not (c.isalnum() or c.isspace() or c in _PLAIN or unicodedata.category(c)[0] == "M")


def symbols_in(text: str) -> int:
    return sum(text.count(c) for c in set(text) if _symbol(c))


@lru_cache(200_000)
def _syllables(word: str) -> bool:
    return len(word) > 1 and bool(_SYLLABLES.match(word))


@lru_cache(200_000)
def _no_vowel(word: str) -> bool:
    return not _VOWEL.search(word)


def is_junk(line: str, words: list[str], symbols: int, solid: int) -> bool:
    """Has the line no readable text: symbols, wrongly decoded text, random letters, codes or repeated syllables?"""
    if solid < 8:
        return False
    letters = sum(map(len, words))
    if symbols > 0.3 * solid or symbols > 0.1 * solid and letters == 0:
        return True
    if letters < 0.3 * solid:
        if sum(c in _PLAIN for c in line) > 0.45 * solid or letters < 0.1 * solid and not any(map(str.isdigit, line)):
            return True
    if ("Ã" in line or "â" in line or "ï»" in line or "Â" in line) and sum(map(len, _MOJIBAKE.findall(line))) > 0.3 * solid:
        return True
    if _MIXTURE.search(line) and sum(len(m.group()) for m in _MIXED.finditer(line)) > 0.5 * solid:
        return True
    if len(words) >= 4:
        if sum(map(_syllables, words)) > 0.5 * len(words):
            return True
        bare = sum(map(_no_vowel, words))
        if bare >= 2:
            latin = [w for w in words if w.isascii() and w not in ("g", "kg", "km", "cm", "x")]
            if len(latin) >= 5 and len(latin) > 0.6 * len(words) and sum(map(_no_vowel, latin)) > 0.28 * len(latin):
                return True
    return False


def describe(text: str, common: frozenset[str]) -> dict:
    """The statistics of a text and the shares of its characters that are items, table rows and junk."""
    lines = [x for x in text.split("\n") if x.strip()]
    solid = list(map(_solid, lines))
    total = sum(solid) or 1
    odd = [c for c in set(text) if _symbol(c)]
    symbols = [sum(map(x.count, odd)) for x in lines] if odd else [0] * len(lines)
    words = [[w.lower() for w in _WORD.findall(x)] for x in lines]
    n_words = sum(map(len, words))
    known = [sum(w in common for w in ws) for ws in words]
    ended = [bool(_ENDED.search(x)) for x in lines]
    out = {
        "n_chars": len(text),
        "n_words": n_words,
        "n_lines": len(lines),
        "words_per_line": n_words / max(1, len(lines)),
        "mean_word_length": sum(len(w) for ws in words for w in ws) / max(1, n_words),
        "symbol_ratio": sum(symbols) / total,
        "digit_ratio": sum(map(str.isdigit, text)) / total,
        "letter_ratio": sum(map(str.isalpha, text)) / total,
        "ended_lines": sum(ended) / max(1, len(lines)),
        "common_words": sum(known) / max(1, n_words),
    }
    # table rows: runs of lines with one number of fields, most of them numbers below the head
    fields = [_FIELDS.split(x.strip().strip("|").strip()) for x in lines]
    widths = Counter(len(f) for f in fields if len(f) >= 3)
    width = widths.most_common(1)[0][0] if widths else 0
    numeric = [len(f) == width and 2 * sum(bool(_NUMBER.match(v)) for v in f) >= width - 1 for f in fields]
    rows = [bool(width) and len(f) == width and (num or k == 0) for k, (f, num) in enumerate(zip(fields, numeric))]
    junk = [
        not (r and n) and is_junk(x, ws, y, z) for x, ws, r, n, y, z in zip(lines, words, rows, numeric, symbols, solid)
    ]
    items = []
    for x, ws, e, j in zip(lines, words, ended, junk):
        short = len(_UNSPACED.findall(x)) <= 10 if _UNSPACED.search(x) else 0 < len(ws) <= 10
        items.append(short and not e and not j)
    share = lambda marks: sum(z for z, m in zip(solid, marks) if m) / total
    out |= {
        "table_share": share(rows) if sum(numeric) >= 3 else 0.0,
        "junk_share": share(junk),
        "item_share": share(items) if sum(items) >= 4 else 0.0,
    }
    return out


_COUNTS = ["n_chars", "n_words", "n_lines"]
_SHARES = list(SIDES)
_SCHEMA = "author string, permlink string, lang string, " + ", ".join(
    [f"{c} bigint" for c in _COUNTS] + [f"{c} bigint" for c in _SHARES]
)


def _lang(label: str | None, script: str, codes: dict[str, str]) -> str:
    """A language for ranking: the label's where the script is Latin or Cyrillic and the label is known, else the script."""
    if script not in ("latin", "cyrillic"):
        return script
    label = (label or "").strip().lower()
    return codes.get(label) or codes.get(re.split("[-_]", label)[0]) or script


def _word_docs(parts: Iterator[pd.DataFrame], codes: dict[str, str]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def flush() -> pd.DataFrame:
        keys = list(counts)
        df = pd.DataFrame({"lang": [k[0] for k in keys], "word": [k[1] for k in keys], "n": [counts[k] for k in keys]})
        counts.clear()
        return df

    for part in parts:
        for label, text in zip(part["dominant_lang"], part["__text"]):
            lang = _lang(label, script_of(text), codes)
            counts.update((lang, w.lower()) for w in set(_WORD.findall(text)))
        if len(counts) > FLUSH:
            yield flush()
    if counts:
        yield flush()


def common_words(texts: DataFrame, codes: dict[str, str]) -> dict[str, frozenset[str]]:
    """The COMMON words of each language by the documents that hold them, over all documents: a bounded table."""
    counts = texts.mapInPandas(lambda it: _word_docs(it, codes), "lang string, word string, n bigint")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_DOCS)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= COMMON).collect()
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r.lang, set()).add(r.word)
    return {k: frozenset(v) for k, v in out.items()}


def _codes(lang_codes: DataFrame) -> dict[str, str]:
    out = {}
    for r in lang_codes.select("code", "code3", "lang_name").collect():  # the table of languages
        out |= {k.lower(): r.code for k in (r.code, r.code3, r.lang_name) if k}
    return out


def _whole(name: str, x: float) -> int:
    return round(UNIT * (math.log1p(x) if name in LOGS else x))


def statistics(posts: DataFrame, lang_codes: DataFrame, text: str = "body_for_analysis") -> DataFrame:
    """One row of statistics, as whole numbers, for each distinct text of a post, with a number of its own (row_id)."""
    codes = _codes(lang_codes)
    texts = posts.where("author is not null and permlink is not null").select(
        "author", "permlink", "dominant_lang", F.coalesce(F.col(text), F.lit("")).alias("__text")
    )
    common = common_words(texts, codes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for author, permlink, label, t in zip(part["author"], part["permlink"], part["dominant_lang"], part["__text"]):
                lang = _lang(label, script_of(t), codes)
                d = describe(t, common.get(lang, frozenset()))
                rows.append((author, permlink, lang, *(d[c] for c in _COUNTS), *(_whole(c, d[c]) for c in _SHARES)))
            if rows:
                yield pd.DataFrame(rows, columns=["author", "permlink", "lang", *_COUNTS, *_SHARES])

    # small rows, used several times below
    return cut(texts.mapInPandas(run, _SCHEMA).distinct().withColumn("row_id", F.monotonically_increasing_id()))


def ordinary(half: int = UNIT // 2) -> Column:
    """Has the document words, and are not most of its characters items, table rows or junk?"""
    return (F.col("n_words") > 0) & (F.greatest(*SHARE_OF.values()) <= half)


def tails(long: DataFrame) -> DataFrame:
    """(g, stat, v, lo, hi): of each value the share of a group's ordinary documents at or below it, and at or above it.

    long has (g, stat, v, ref); one is added to both counts, so that no tail is empty.
    """
    values = long.groupBy("g", "stat", "v").agg(F.sum("ref").alias("c"))
    summed = running_sums(values, ["g", "stat"], ["v"], {"c": "cum"})
    totals = values.groupBy("g", "stat").agg(F.sum("c").alias("n"))  # a row for each language and statistic
    n = F.col("n") + 1
    return summed.join(F.broadcast(totals), ["g", "stat"]).select(
        "g", "stat", "v", ((F.col("cum") + 1) / n).alias("lo"), ((F.col("n") - F.col("cum") + F.col("c") + 1) / n).alias("hi")
    )


def outlier_scores(stats: DataFrame) -> DataFrame:
    """stats with a score of each kind (list_score, table_score, junk_score) and outlier_score, the mean over all statistics: means of -ln of the
    tail probabilities, within the language or over all documents, whichever is smaller."""
    langs = stats.where(ordinary()).groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= SMALL)
    big = langs.select("lang", F.col("lang").alias("__g"))  # a row for each language
    rows = stats.join(F.broadcast(big), "lang", "left").withColumn("__g", F.coalesce("__g", F.lit("*")))
    groups = F.explode(F.array_distinct(F.array(F.col("__g"), F.lit("*"))))
    one = rows.select("row_id", ordinary().cast("bigint").alias("ref"), groups.alias("g"), *SIDES)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in SIDES)))
    long = one.select("row_id", "ref", "g", each.alias("__s")).select("row_id", "ref", "g", "__s.stat", "__s.v")
    ranks = cut(tails(long))
    if ranks.limit(BROADCAST_RANKS + 1).count() <= BROADCAST_RANKS:
        joined = long.join(F.broadcast(ranks), ["g", "stat", "v"])  # checked: at most BROADCAST_RANKS rows
    else:  # a value of 0 is most documents', so its rows are spread
        spread = ranks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = long.withColumn("salt", F.pmod(F.hash("row_id"), F.lit(SALTS))).join(spread, ["g", "stat", "v", "salt"])
    side = F.create_map(*(F.lit(x) for kv in SIDES.items() for x in kv))[F.col("stat")]
    p = F.when(side == "low", F.col("lo")).when(side == "high", F.col("hi")).otherwise(F.least(F.lit(1.0), 2 * F.least("lo", "hi")))
    far = joined.withColumn("__l", F.least(F.lit(FAR), -F.log(p)))
    mean = lambda names: F.sum(F.when(F.col("stat").isin(*names), F.col("__l")).otherwise(0.0)) / len(names)
    sets = {f"{k}_score": v for k, v in KINDS.items()} | {"outlier_score": tuple(SIDES)}
    scores = far.groupBy("row_id", "g").agg(*(mean(v).alias(k) for k, v in sets.items()))
    least = scores.groupBy("row_id").agg(*(F.min(k).alias(k) for k in sets))
    return stats.join(least, "row_id")


def kinds(scored: DataFrame, outlier: float = OUTLIER) -> DataFrame:
    """scored with kind: the first that the document is an outlier of and that most of its characters confirm, or null for prose."""
    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        kind = F.when((F.col(f"{name}_score") >= outlier) & (F.col(SHARE_OF[name]) > UNIT // 2), name).otherwise(kind)
    return scored.withColumn("kind", kind)


def wrong_lengths(posts: DataFrame, text: str = "body_for_analysis", length: str = "body_for_analysis_len") -> DataFrame:
    """(author, permlink, kind = 'length') of rows whose stated length is missing or not the number of characters."""
    right = F.col(length).eqNullSafe(F.coalesce(F.length(text), F.lit(0)).cast("bigint"))
    return posts.where("author is not null and permlink is not null").where(~right).select("author", "permlink", F.lit("length").alias("kind"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "hive_cleaned")
    named = kinds(outlier_scores(statistics(posts, table(spark, sf_dir, "lang_codes")))).where("kind is not null")
    return named.select("author", "permlink", "kind").unionByName(wrong_lengths(posts)).distinct()


def p7_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post's statistics with its outlier score and kind."""
    posts = table(spark, sf_dir, "hive_cleaned")
    scored = kinds(outlier_scores(statistics(posts, table(spark, sf_dir, "lang_codes")))).drop("row_id")
    return scored.withColumns({c: F.round(c, 6) for c in scored.columns if c.endswith("_score")})


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_lengths(table(spark, sf_dir, "hive_cleaned")).distinct()


QUERIES = {"p7_found": p7_found, "p7_statistics": p7_statistics, "p7_lengths": p7_lengths}
ORACLES = {
    "p7_lengths": """select distinct author, permlink, 'length' as kind from hive_cleaned
where author is not null and permlink is not null
  and (body_for_analysis_len is null or body_for_analysis_len <> coalesce(length(body_for_analysis), 0))"""
}
