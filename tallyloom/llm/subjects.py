"""Subject areas of posts by subject-specific interpolated n-gram language models.

Models of one and two words are trained for each subject on a bounded sample of labelled posts, with the labels
refined unit by unit (a unit is a sentence or line): expectation-maximisation shares each unit among the subjects and the background, as
labels are wrong at times and posts stray. Background counts of the models' n-grams come from the whole corpus. Each
unit's per-token cross-entropies under the subject models are compared with the background's; a post has each subject
that wins enough of its units. What a unit must win by is calibrated, for each subject, on the raters' posts under models that have not seen them.

Defined cases: null, blank and foreign texts have no subject; repeated rows count once; rows without author or permlink
are left out; labels outside the given subjects are not used; without usable labels nothing is found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import fold
from tallyloom.llm.samples import lowest_by_hash, trained_once
from tallyloom.session import table

#: Bounds of the training sample: posts read by raters, and posts with a usable category.
RATED, CATEGORISED = 5_000, 5_000
#: An n-gram enters the models if the sample has it so often.
MIN_COUNT = 3
#: Interpolation weights of the bigram, the unigram and the background.
LAMBDAS = (0.3, 0.3, 0.4)
ROUNDS = 10
#: Weight of the whole corpus in the background model, beside the neutral text.
CORPUS_SHARE = 0.05
#: Times that an n-gram must be more frequent in posts with a subject's label than overall to count for the subject in full.
LIFT = 2.8
#: A unit belongs to a subject that beats the background by so many nats for each token, and the next subject by this part of it.
MIN_GAIN, LEAD = 0.3, 0.6
#: Gains that calibration tries, and labels of a subject from which it has a gain of its own.
GAINS, LEAST_RATED = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5), 20
#: Units that make a subject.
MIN_UNITS = 2
#: A subject with a single unit is accepted if no other has one and the unit is at least this share of the post.
LONE_SHARE = 1 / 8

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_UNIT = re.compile(r"\n+|(?<=[.!?…。！？।])[\"”»’)\]]*\s+|(?<=[a-z0-9][.!?])(?=[A-Z])|(?<=[。！？।])")
_LINK = re.compile(r"https?://\S+|www\.\S+|#[\w-]+|@[\w.-]+")
# Function words of English and of other languages in Latin script.
ENGLISH = frozenset(
    "the of and to is that for on with was are it this be as at by from have not or but my we you they what who will can "
    "just about than more all one out so up if there their our his her she he i an when how why which into over after "
    "before nobody some your its were had has been would could should did does do no says near every".split()
)
FOREIGN = frozenset(
    "el la los las de que y en un una por con para se del al es su lo como pero muy ya os da do em não uma com na um "
    "le les des et est une pour pas dans sur il di che per è non della der die das und ist nicht ein eine mit auf zu den "
    "von ich w nie się z jest i że bir ve bu için o e a era mais nous vous je ne pas au du wir sie wie ale po gli ho sono".split()
) - {"a", "i", "me", "no", "on", "do", "at"}


def units_of(text: str) -> list[list[str]]:
    """Tokens of each English unit of text, lower-cased, with numbers as 0; none if text is mainly foreign."""
    ours, theirs, out = 0, 0, []
    for piece in _UNIT.split(_LINK.sub(" ", text)):
        if not piece:
            continue
        tokens = ["0" if t[0].isdigit() else t for t in _TOKEN.findall(piece.lower())]
        if not tokens:
            continue
        if 2 * tokens.count("0") >= len(tokens):  # rows of tables
            tokens = [t for t in tokens if t != "0"]
        size = sum(map(len, tokens))
        if piece.isascii():
            foreign = sum(t in FOREIGN for t in tokens) > sum(t in ENGLISH for t in tokens)
        else:
            odd = sum(ord(c) > 127 and c.isalpha() for c in piece)
            home, away = sum(t in ENGLISH for t in tokens), sum(t in FOREIGN for t in tokens)
            foreign = odd > 0.25 * size or away > home or (away == home and odd > 0)
            if odd > 0.5 * size:  # scripts with more meaning in a character
                size *= 2
        if foreign:
            theirs += size
        else:
            ours += size
            out.append(tokens)
    return out if ours > theirs else []


class Grams:
    """The n-grams of the models and their numbers: unigrams from 1, then bigrams; 0 is any other."""

    def __init__(self, posts: list[list[list[str]]]):
        uni: Counter = Counter()
        bi: Counter = Counter()
        for units in posts:
            for u in units:
                uni.update(u)
        keep = {w for w, n in uni.items() if n >= MIN_COUNT}
        for units in posts:
            for u in units:
                bi.update(f"{a} {b}" for a, b in pairwise(u) if a in keep and b in keep)
        self.uni = {w: k + 1 for k, w in enumerate(sorted(keep))}
        self.bi = {p: k + 1 + len(self.uni) for k, p in enumerate(sorted(p for p, n in bi.items() if n >= MIN_COUNT))}
        self.size = 1 + len(self.uni) + len(self.bi)
        self.first = np.zeros(self.size, np.int64)
        self.last = np.zeros(self.size, np.int64)
        for p, k in self.bi.items():
            a, b = p.split(" ")
            self.first[k], self.last[k] = self.uni[a], self.uni[b]

    def ids(self, unit: list[str]) -> list[int]:
        """For each token its bigram with the one before if the models have it, else its unigram."""
        if not unit:
            return []
        uni, bi = self.uni, self.bi
        out = [uni.get(unit[0], 0)]
        out += [bi.get(f"{a} {b}") or uni.get(b, 0) for a, b in pairwise(unit)]
        return out

    def counts(self, ids: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Counts of all n-grams where ids are as of ids(): a bigram also counts as its last word."""
        c = np.bincount(ids, weights, self.size).astype(float)
        full = c + np.bincount(self.last, c, self.size)
        full[0] = c[0]
        return full


def log_ratios(grams: Grams, subject: np.ndarray, neutral: np.ndarray, corpus: np.ndarray, purity: np.ndarray) -> np.ndarray:
    """log p_subject - log p_background of each n-gram, from counts: subject (subjects, n-grams), neutral and corpus.

    The background interpolates the neutral text (what no subject claims) with a little of the whole corpus; a subject's
    model interpolates its bigrams, its unigrams and the background. Gains count as far as the n-gram is the subject's (purity).
    """
    l2, l1, l0 = LAMBDAS
    n_uni = len(grams.uni) + 1

    def unigrams(c: np.ndarray) -> np.ndarray:
        return c[..., :n_uni] / np.maximum(c[..., :n_uni].sum(-1, keepdims=True), 1.0)

    bg = (1 - CORPUS_SHARE) * unigrams(neutral) + CORPUS_SHARE * unigrams(corpus) + 1e-9
    own = unigrams(subject)
    out = np.zeros(subject.shape, np.float32)
    out[..., :n_uni] = np.log(((l2 + l1) * own + l0 * bg) / bg)
    k = np.arange(n_uni, grams.size)
    if len(k):
        a, b = grams.first[k], grams.last[k]
        bg2 = 0.5 * neutral[k] / np.maximum(neutral[a], 1.0) + 0.5 * bg[b]
        own2 = l2 * subject[..., k] / np.maximum(subject[..., a], 1.0) + l1 * own[..., b] + l0 * bg2
        out[..., k] = np.log(own2 / bg2)
    out[..., 0] = 0.0
    return np.minimum(out, 0) + np.maximum(out, 0) * purity.astype(np.float32)


def train(posts: list[list[list[str]]], labels: list[dict[int, float]], n_subjects: int) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    """Models from posts (units of tokens) and each post's labels (subject -> trust in nats).

    Returns the n-grams, the expected counts (subjects, n-grams) of each subject's units, and those of neutral units.
    """
    grams = Grams(posts)
    unit_ids = [grams.ids(u) for units in posts for u in units]
    of_post = np.repeat(np.arange(len(posts)), [len(units) for units in posts])
    sizes = np.array([len(u) for u in unit_ids], np.int64)
    ids = np.fromiter((i for u in unit_ids for i in u), np.int64, sizes.sum())
    of_unit = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    prior = np.full((len(posts), n_subjects), -2.0)
    share = np.zeros((len(posts), n_subjects))
    for p, own in enumerate(labels):
        for s, trust in own.items():
            prior[p, s] = trust
            share[p, s] = 0.7 / len(own)
    prior, corpus = prior[of_post], grams.counts(ids)
    mine = share[of_post]
    counts = np.stack([grams.counts(ids, mine[of_unit, s]) for s in range(n_subjects)])
    # n-grams no more frequent in posts with a subject's label than elsewhere are not the subject's
    tagged = np.zeros((len(posts), n_subjects))
    for p, own in enumerate(labels):
        tagged[p, list(own)] = 1.0
    tagged = tagged[of_post][of_unit]
    part = np.maximum(tagged.mean(axis=0), 1e-9)[:, None] if len(ids) else np.ones((n_subjects, 1))
    lift = np.stack([grams.counts(ids, tagged[:, s]) for s in range(n_subjects)])
    lift = np.maximum(lift - 1.5 * np.sqrt(lift + 1), 0.0) / np.maximum(corpus, 1.0) / part  # with regard to chance
    full = np.minimum(LIFT, 1 + 0.35 * (1 / part - 1)) + 1e-9  # a subject of half the posts cannot be lifted far
    purity = np.clip((lift - 1) / (full - 1) * 1.4 - 0.4, 0.0, 1.0)
    free = 1 - 0.9 * purity.max(axis=0)  # what is some subject's own is seldom neutral
    neutral = corpus * free
    for _ in range(ROUNDS if len(ids) else 0):
        gain = np.add.reduceat(log_ratios(grams, counts, neutral, corpus, purity).T[ids], starts, axis=0)
        logit = np.concatenate([gain + prior, np.full((len(gain), 1), 1.0)], axis=1)
        logit -= logit.max(axis=1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=1, keepdims=True)
        counts = np.stack([grams.counts(ids, p[of_unit, s]) for s in range(n_subjects)])
        neutral = grams.counts(ids, p[of_unit, n_subjects]) * free
    return grams, counts, neutral, purity


def unit_gains(grams: Grams, ratios: np.ndarray, units: list[list[str]]) -> np.ndarray:
    """Per-token gains (units, subjects) of a post's units: the background's cross-entropy less the subject's."""
    unit_ids = [i for i in map(grams.ids, units) if i]
    if not unit_ids:
        return np.zeros((0, ratios.shape[1]), np.float32)
    sizes = np.array([len(u) for u in unit_ids])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(ratios[[i for u in unit_ids for i in u]], starts, axis=0) / sizes[:, None]


def accepted(gain: np.ndarray, least: float | np.ndarray = MIN_GAIN, lone: bool = True) -> dict[int, int]:
    """Subjects of a post and the units that each wins; least is the gain that a unit needs, for all subjects or for each.

    A subject with MIN_UNITS units is accepted; with one unit it is only if no other subject has any and the post is short (lone).
    """
    if not len(gain):
        return {}
    best = gain.argmax(axis=1)
    need = np.broadcast_to(least, gain.shape[1:])[best]
    top = gain[np.arange(len(gain)), best]
    rest = np.partition(gain, -2, axis=1)[:, -2] if gain.shape[1] > 1 else np.zeros(len(gain))
    won = Counter(best[(top >= need) & (top - rest >= LEAD * need)].tolist())
    found = {s: n for s, n in won.items() if n >= MIN_UNITS}
    if lone and not found and len(won) == 1 and LONE_SHARE * len(gain) <= 1:
        return dict(won)
    return found


def calibrate(gain: list[np.ndarray], labels: list[set[int]], n_subjects: int) -> dict:
    """The acceptance rule that agrees best with raters on posts that the models have not seen.

    Agreement is the share of labels found, less that of other subjects accepted, weighed down as raters name one subject of two at
    times. First one gain for all subjects, then one for each subject with labels enough; ties keep the middle of the best gains.
    """

    def agreement(least: np.ndarray, lone: bool, only: int | None = None) -> float:
        hit = extra = n = 0
        for g, own in zip(gain, labels):
            got = set(accepted(g, least, lone))
            if only is not None:
                got, own = got & {only}, own & {only}
            hit, extra, n = hit + len(got & own), extra + len(got - own), n + len(own)
        return (hit - 0.5 * extra) / max(1, n)

    def middle(scores: list[float]) -> int:
        good = [k for k, x in enumerate(scores) if x >= max(scores) - 1e-9]
        return good[len(good) // 2]

    if not labels:
        return {"least": np.full(n_subjects, MIN_GAIN), "lone": True}
    each = {lone: [agreement(np.full(n_subjects, g), lone) for g in GAINS] for lone in (True, False)}
    lone = max(each[True]) >= max(each[False])
    least = np.full(n_subjects, GAINS[middle(each[lone])])
    for s in range(n_subjects):
        if sum(s in own for own in labels) >= LEAST_RATED:
            tried = [np.where(np.arange(n_subjects) == s, g, least) for g in GAINS]
            scores = [agreement(t, lone, s) for t in tried]
            if max(scores) > agreement(least, lone, s) + 0.01:
                least = tried[middle(scores)]
    return {"least": least, "lone": lone}


def held_out_gains(units: list[list[list[str]]], own: list[dict[int, float]], rated: list[int], n_subjects: int) -> list[np.ndarray]:
    """Gains of the rated posts, each under models trained without it: the rated posts are halved, the other half and all else train."""
    out: dict[int, np.ndarray] = {}
    for half in (rated[::2], rated[1::2]):
        if not half:
            continue
        left_out = set(half)
        keep = [k for k in range(len(units)) if k not in left_out]
        grams, counts, neutral, purity = train([units[k] for k in keep], [own[k] for k in keep], n_subjects)
        whole = grams.counts(np.array([i for k in keep for u in units[k] for i in grams.ids(u)], np.int64))
        ratios = np.ascontiguousarray(log_ratios(grams, counts, neutral, whole, purity).T)
        out |= {k: unit_gains(grams, ratios, units[k]) for k in half}
    return [out[k] for k in rated]


def sample(posts: DataFrame, labels: DataFrame, subjects: DataFrame, text: str) -> tuple[list[str], list[list[list[str]]], list[dict[int, float]], list[set[int]]]:
    """The bounded training sample: (subjects, units of each post, labels with trust, raters' labels)."""
    names = sorted(r[0] for r in subjects.select(fold(F.col("subject"))).distinct().collect() if r[0])  # the table of subjects
    known = F.lit(",".join(["", *names, ""]))
    rated = labels.select("author", "permlink", fold(F.col("subject")).alias("subject")).where(
        F.col("author").isNotNull() & F.col("permlink").isNotNull() & F.instr(known, F.concat(F.lit(","), F.col("subject"), F.lit(","))).cast("boolean")
    )
    rated = rated.groupBy("author", "permlink").agg(F.sort_array(F.collect_set("subject")).alias("rated"))
    rated = lowest_by_hash(rated, ["author", "permlink"], RATED, 7)
    rows = posts.where(f"author is not null and permlink is not null and {text} is not null").select(
        "author", "permlink", F.col(text).alias("text"), F.regexp_replace(fold(F.col("category")), r"[\s-]", "_").alias("category")
    )
    with_raters = rows.join(F.broadcast(rated), ["author", "permlink"]).dropDuplicates(["author", "permlink"])
    by_category = rows.where(F.instr(known, F.concat(F.lit(","), F.col("category"), F.lit(","))) > 0)
    by_category = lowest_by_hash(by_category, ["author", "permlink"], CATEGORISED, 7)
    texts, own, raters, seen = [], [], [], set()
    order = {s: k for k, s in enumerate(names)}
    for r in with_raters.collect():
        mine = {order[s]: 1.0 for s in r.rated}
        if r.category in order:
            mine.setdefault(order[r.category], 0.0)
        texts.append(units_of(r.text))
        own.append(mine)
        raters.append({order[s] for s in r.rated})
        seen.add((r.author, r.permlink))
    for r in by_category.collect():
        if (r.author, r.permlink) not in seen:
            seen.add((r.author, r.permlink))
            texts.append(units_of(r.text))
            own.append({order[r.category]: 0.5})
            raters.append(set())
    return names, texts, own, raters


class Model(NamedTuple):
    """What scoring needs: the subjects, the models' n-grams, their log ratios (n-grams, subjects) and the acceptance rule."""

    names: list[str]
    grams: Grams
    ratios: np.ndarray
    rule: dict


def _texts(posts: DataFrame, text: str) -> DataFrame:
    return posts.where("author is not null and permlink is not null").select("author", "permlink", F.coalesce(F.col(text), F.lit("")).alias("__text"))


def fit(posts: DataFrame, labels: DataFrame, subjects: DataFrame, text: str = "body_clean") -> Model | None:
    """Models of the subjects from the bounded sample, with the background of the whole corpus; None without usable labels."""
    names, units, own, raters = sample(posts, labels, subjects, text)
    if not units:
        return None
    grams, counts, neutral, purity = train(units, own, len(names))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(grams.size)
        for part in parts:
            ids = [i for t in part["__text"] for u in units_of(t) for i in grams.ids(u)]
            total += np.bincount(np.array(ids, np.int64), minlength=grams.size)
        k = np.flatnonzero(total)
        if len(k):
            yield pd.DataFrame({"k": k, "n": total[k].astype("int64")})

    # counts of the models' n-grams over all posts: a table as bounded as the sample
    background = np.zeros(grams.size)
    for r in _texts(posts, text).mapInPandas(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        background[r.k] = r.n
    full = background + np.bincount(grams.last, background, grams.size)
    full[0] = background[0]
    # of the corpus, each n-gram's neutral part is as in the sample
    part = neutral / np.maximum(neutral + counts.sum(axis=0), 1e-9)
    ratios = np.ascontiguousarray(log_ratios(grams, counts, full * part, full, purity).T)
    rated = [k for k, r in enumerate(raters) if r]
    rule = calibrate(held_out_gains(units, own, rated, len(names)), [raters[k] for k in rated], len(names))
    return Model(names, grams, ratios, rule)


def find_subjects(posts: DataFrame, labels: DataFrame, subjects: DataFrame, text: str = "body_clean", model: Model | None = None) -> DataFrame:
    """(author, permlink, subject, n_units, total_units) of every subject of every post. Without a model of fit() one is fitted."""
    schema = "author string, permlink string, subject string, n_units int, total_units int"
    model = model or fit(posts, labels, subjects, text)
    if model is None:
        return posts.sparkSession.createDataFrame([], schema)
    names, grams, ratios, rule = model

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for a, p, t in zip(part["author"], part["permlink"], part["__text"]):
                g = unit_gains(grams, ratios, units_of(t))
                rows += [(a, p, names[s], n, len(g)) for s, n in accepted(g, **rule).items()]
            if rows:
                yield pd.DataFrame(rows, columns=["author", "permlink", "subject", "n_units", "total_units"])

    return _texts(posts, text).mapInPandas(score, schema).distinct()


def _in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("hive_classified", "subject_labels", "subject_areas"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _in(spark, sf_dir)
    return find_subjects(*tables, model=trained_once(spark, "subjects", sf_dir, lambda: fit(*tables)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("author", "permlink", "subject").distinct()


def p1_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each subject and their share of all posts."""
    n = table(spark, sf_dir, "hive_classified").select("author", "permlink").distinct().agg(F.count("*")).scalar()
    per = _found(spark, sf_dir).groupBy("subject").agg(F.countDistinct("author", "permlink").alias("n_posts"))
    return per.select("subject", "n_posts", F.round(F.col("n_posts") / n, 6).alias("share"))


QUERIES = {"p1_found": p1_found, "p1_composition": p1_composition}
ORACLES: dict[str, str] = {}
