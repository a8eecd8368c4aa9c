"""Abusive, hateful and sexual content by non-negative positive-unlabelled learning.

Moderators label posts, while single sentences offend; so the sentences of a confirmed post are a bag of which at least one
is positive. A linear classifier for each kind is trained in numpy on the bags' likeliest sentences as positives and
sentences of other posts as unlabelled, by the non-negative risk estimator corrected with the class prior, joined with the
risk on sentences of posts that moderators passed; the likeliest sentences are chosen anew with each round. Disguises
are undone first: look-alike letters, digits and marks for letters, spaced and stretched words.

Defined cases: null and blank texts score 0 and have no kind; labels other than the three kinds and `none` are not used;
a kind without confirmed posts scores 0 everywhere; repeated rows count once; rows without author or permlink are left out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import fold
from tallyloom.llm.samples import lowest_by_hash, trained_once
from tallyloom.session import table

KINDS = ("abusive", "hateful", "sexual")
#: Bounds of the training sample: labels, and unlabelled posts.
LABELS, UNLABELLED = 4_000, 2_500
#: Hashed features, rounds of choosing sentences, steps of a round, learning rate, decay.
FEATURES, ROUNDS, STEPS, RATE, DECAY = 1 << 18, 3, 80, 0.15, 2e-6
#: Weight of the risk on passed posts beside the positive-unlabelled risk.
PASSED = 0.3
#: A sentence is of each kind whose logit is at most so far below that of its likeliest kind.
RIVAL = 4.0
#: Bounds of the class prior among sentences.
PRIOR_LEAST, PRIOR_MOST = 2e-4, 0.03

# Look-alikes of Latin letters, and digits and marks that stand for letters.
LOOKALIKES = str.maketrans("абвеёзіїјкмнорстухһѕԁԛԝοαερντικυηΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "a6beesiijkmhopctyxhsdqwoaepvtikunabezhikmnoptyx")
LEET = str.maketrans("013457@$!|€", "oieastasiie")

_BREAK = re.compile(r"\n+|(?<=[.!?…])[\"”»’)\]]*\s+|(?<=[。！？।؟۔])[」』”]*|(?<=[^\W\d_A-Z][.!?])(?=[A-ZÀ-Þ])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_]){3,}[^\W\d_]{1,2}(?![^\W_])")
_TOKEN = re.compile(r"[^\W_](?:[\w@$!|€*'’-]*[\w$€*])?|[@$!|€*]+\w[\w@$!|€*]*")
_STRETCH = re.compile(r"(.)\1{2,}")
_HIDDEN = re.compile(r"[­​-‏⁠﻿]")
_UNSPACED = re.compile(r"[฀-໿぀-ヿ㐀-鿿]{2,}")
_QUOTE = re.compile(r"[“”\"«»„「」‘]")


@lru_cache(200_000)
def plain_word(word: str) -> str:
    """A word in lower case with its disguise undone; masks (*) stay."""
    w = word.lower()
    if not w.isascii():
        kinds = {unicodedata.name(c, " ").split(" ")[0] for c in w if c.isalpha()}
        if "LATIN" in kinds and kinds & {"CYRILLIC", "GREEK"}:
            w = w.translate(LOOKALIKES)
    if any(c.isalpha() for c in w) and not w.isalpha():
        t = w.translate(LEET)
        if sum(a != b for a, b in zip(w, t)) and re.search(r"[a-z][013457@$!|€]|[013457@$!|€][a-z]", w) and not re.fullmatch(r"\d+[a-z]{1,2}", w):
            w = t
    return _STRETCH.sub(r"\1", w)


def sentences_of(text: str) -> list[str]:
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return [s.strip() for s in _BREAK.split(text) if s and s.strip()]


def tokens_of(sentence: str) -> tuple[str, ...]:
    """Words with disguises undone, numbers as 0, names inside the sentence as <n> beside the marks of quotes."""
    s = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), sentence)
    words = _TOKEN.findall(s)
    loud = sum(map(str.isupper, words)) > 0.6 * len(words)
    out = ['"'] if _QUOTE.search(sentence) else []
    for k, w in enumerate(words):
        if w.isdigit():
            out.append("0")
        elif not loud and k and w[0].isupper() and w[1:].islower() and w.isascii():
            out += ["<n>", plain_word(w)]
        elif _UNSPACED.search(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(plain_word(w))
    return tuple(out)


@lru_cache(200_000)
def _word_features(w: str) -> tuple[int, ...]:
    h = zlib.crc32
    out = [h(f"w {w}".encode()) % FEATURES]
    if "*" in w:
        out += [h(f"m {w[0]}{len(w)}{w[-1]}".encode()) % FEATURES, h(b"masked") % FEATURES]
    elif len(w) > 4 and w.isalpha():
        padded = f"^{w}$"
        out += [h(f"c {padded[i:i + 5]}".encode()) % FEATURES for i in range(len(padded) - 4)]
    return tuple(out)


@lru_cache(500_000)
def _pair(kind: str, a: str, b: str) -> int:
    return zlib.crc32(f"{kind} {a} {b}".encode()) % FEATURES


def features_of(tokens: tuple[str, ...]) -> list[int]:
    out: set[int] = set()
    for k, w in enumerate(tokens):
        if w != "<n>" and (k == 0 or tokens[k - 1] != "<n>"):
            out.update(_word_features(w))
    words = [t for k, t in enumerate(tokens) if k == 0 or tokens[k - 1] != "<n>"]  # names give way to their place
    words = ["^", *words, "$"]
    out.update(_pair("b", a, b) for a, b in zip(words, words[1:]))
    out.update(_pair("s", a, b) for a, b in zip(words, words[2:]))
    return list(out)


class Bags:
    """Sentences of posts as sparse rows."""

    def __init__(self, texts: list[str]):
        rows, self.post, self.sentences = [], [], []
        for p, t in enumerate(texts):
            for s in sentences_of(t):
                f = features_of(tokens_of(s))
                rows.append(f)
                self.post.append(p)
                self.sentences.append(s)
        self.post = np.array(self.post, np.int64)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.ids = np.fromiter((i for r in rows for i in r), np.int64, int(self.size.sum()))
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        self.scale = (1 / np.sqrt(np.maximum(self.size, 1))).astype(np.float32)

    def __len__(self) -> int:
        return len(self.size)

    def logits(self, w: np.ndarray, bias: float) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.float32)
        return np.add.reduceat(w[self.ids], self.start) * self.scale + bias

    def gradient(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, np.repeat(d * self.scale, self.size), FEATURES).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def non_negative_gradient(z: np.ndarray, pos: np.ndarray, unl: np.ndarray, neg: np.ndarray, prior: float) -> np.ndarray:
    """Derivative by the logits z of the non-negative positive-unlabelled logistic risk, joined with that on passed rows.

    Where the estimated risk of negatives is below zero its gradient is reversed, as it then only fits the positives.
    """
    s = _sigmoid(z)
    d = np.zeros_like(z)
    n_p, n_u, n_n = max(1, pos.sum()), max(1, unl.sum()), max(1, neg.sum())
    soft = np.logaddexp(0, z)  # loss as a negative
    negative_risk = soft[unl].sum() / n_u - prior * soft[pos].sum() / n_p
    sign = 1.0 if negative_risk >= 0 else -0.2
    d[pos] += prior * (s[pos] - 1) / n_p
    d[unl] += (1 - PASSED) * sign * s[unl] / n_u
    d[pos] -= (1 - PASSED) * sign * prior * s[pos] / n_p
    d[neg] += PASSED * (1 - prior) * s[neg] / n_n
    return d


def train(texts: list[str], labels: list[set[str] | None]) -> dict[str, tuple[np.ndarray, float, float]]:
    """(weights, bias, threshold) of each kind; labels are a post's kinds, an empty set if passed, None if unlabelled."""
    bags = Bags(texts)
    n_posts = len(texts)
    unlabelled = np.array([own is None for own in labels])[bags.post] if len(bags) else np.zeros(0, bool)
    passed = np.array([own is not None and not own for own in labels])[bags.post] if len(bags) else np.zeros(0, bool)
    models = {}
    for kind in KINDS:
        bad_posts = np.array([bool(own) and kind in own for own in labels])
        in_bags = bad_posts[bags.post] if len(bags) else np.zeros(0, bool)
        if not in_bags.any() or not (unlabelled | passed).any():
            models[kind] = (np.zeros(FEATURES, np.float32), -20.0, 0.0)
            continue
        rest = unlabelled | passed
        # the first choice of sentences: features more frequent in confirmed posts than elsewhere
        on = np.bincount(bags.ids[np.repeat(in_bags, bags.size)], minlength=FEATURES) / in_bags.sum()
        off = np.bincount(bags.ids[np.repeat(rest, bags.size)], minlength=FEATURES) / rest.sum()
        seen = on * in_bags.sum()
        lift = np.where(seen >= 2, np.log((on + 2e-3) / (off + 2e-3)), 0.0).astype(np.float32)
        score = bags.logits(lift, 0.0)
        w, bias = np.zeros(FEATURES, np.float32), 0.0
        for round_ in range(ROUNDS):
            top = np.full(n_posts, -np.inf)
            np.maximum.at(top, bags.post[in_bags], score[in_bags])
            near = 0.8 * top if round_ == 0 else np.minimum(top, 0.0)
            pos = in_bags & (score >= near[bags.post]) & (score > (0.0 if round_ == 0 else -np.inf))
            if not pos.any():
                break
            level = np.median(score[pos])
            prior = float(np.clip(2 * (score[unlabelled] >= level).mean() if unlabelled.any() else PRIOR_LEAST, PRIOR_LEAST, PRIOR_MOST))
            w, bias = np.zeros(FEATURES, np.float32), float(np.log(prior / (1 - prior)))
            m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
            for step in range(1, STEPS + 1):
                z = bags.logits(w, bias)
                d = non_negative_gradient(z, pos, unlabelled, passed, prior) / prior
                g = bags.gradient(d) + DECAY * FEATURES * 1e-4 * w
                gb = float(d.sum())
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
                b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
                c1, c2 = 1 - 0.9**step, 1 - 0.99**step
                w -= RATE * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-4)
                bias -= RATE * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-4)
            score = bags.logits(w, bias)
        models[kind] = (w, bias, _threshold(bags, score, in_bags, passed, n_posts))
    return models


def _threshold(bags: Bags, score: np.ndarray, in_bags: np.ndarray, passed: np.ndarray, n_posts: int) -> float:
    """The logit that best parts confirmed from passed posts, in the middle of the best stretch.

    The fewer posts are confirmed the less can a low logit be trusted, so the search begins higher."""

    def tops(of: np.ndarray) -> np.ndarray:
        top = np.full(n_posts, -np.inf)
        np.maximum.at(top, bags.post[of], score[of])
        return top[np.unique(bags.post[of])]

    on, off = tops(in_bags), tops(passed) if passed.any() else np.zeros(0)
    grid = np.linspace(-5 + 5 / np.sqrt(max(1.0, len(on) / 10)), 2, 71)
    f1 = np.array([2 * (on >= t).sum() / max(1, (on >= t).sum() + (off >= t).sum() + len(on)) for t in grid])
    return float(np.median(grid[f1 >= f1.max() - 0.002]))


def sample(posts: DataFrame, labels: DataFrame, text: str) -> tuple[list[str], list[set[str] | None]]:
    """Texts of the bounded sample and their labels."""
    kind = fold(F.col("kind"))
    rows = labels.where("author is not null and permlink is not null").select("author", "permlink", kind.alias("kind"))
    rows = rows.where(F.col("kind").isin(*KINDS, "none")).groupBy("author", "permlink").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    rows = lowest_by_hash(rows, ["author", "permlink"], LABELS, 23)
    own = posts.where(f"author is not null and permlink is not null and {text} is not null").select("author", "permlink", F.col(text).alias("text"))
    known = own.join(F.broadcast(rows), ["author", "permlink"]).dropDuplicates(["author", "permlink"]).collect()
    seen = {(r.author, r.permlink) for r in known}
    others = lowest_by_hash(own, ["author", "permlink"], UNLABELLED, 29).collect()
    texts, marks = [r.text for r in known], [set(r.kinds) - {"none"} for r in known]
    for r in others:
        if (r.author, r.permlink) not in seen:
            seen.add((r.author, r.permlink))
            texts.append(r.text)
            marks.append(None)
    return texts, marks


def score_posts(posts: DataFrame, labels: DataFrame, text: str = "body_for_analysis", models: dict | None = None) -> DataFrame:
    """(author, permlink, kind, score, found): for every distinct text its highest sentence probability of each kind.

    Without models of train() they are trained.
    """
    models = models or train(*sample(posts, labels, text))
    weights = np.stack([models[k][0] for k in KINDS], axis=1)
    bias = np.array([models[k][1] for k in KINDS], np.float32)
    limit = np.array([models[k][2] for k in KINDS])
    texts = posts.where("author is not null and permlink is not null").select(
        "author", "permlink", F.coalesce(F.col(text), F.lit("")).alias("__text")
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            post, index, rows = [], [], {}
            for p, t in enumerate(part["__text"]):
                for s in sentences_of(t):
                    tokens = tokens_of(s)
                    # equal sentences but for names and numbers are scored once
                    key = tuple(x for k, x in enumerate(tokens) if k == 0 or tokens[k - 1] != "<n>")
                    index.append(rows.setdefault(key, (len(rows), tokens))[0])
                    post.append(p)
            top = np.full((len(part), len(KINDS)), -30.0, np.float32)
            if index:
                each = [features_of(tokens) for _, tokens in rows.values()]
                size = np.array([len(f) for f in each])
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                ids = np.fromiter((i for f in each for i in f), np.int64, int(size.sum()))
                z = np.add.reduceat(weights[ids], start, axis=0) / np.sqrt(size)[:, None] + bias
                z = np.where(z < z.max(axis=1, keepdims=True) - RIVAL, -30.0, z)
                np.maximum.at(top, np.array(post), z[np.array(index)].astype(np.float32))
            n = len(KINDS)
            yield pd.DataFrame(
                {
                    "author": np.repeat(part["author"].to_numpy(), n),
                    "permlink": np.repeat(part["permlink"].to_numpy(), n),
                    "kind": list(KINDS) * len(part),
                    "score": _sigmoid(top.astype(float)).round(6).ravel(),
                    "found": (top > limit).ravel(),
                }
            )

    return texts.mapInPandas(run, "author string, permlink string, kind string, score double, found boolean").distinct()


def _in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "hive_cleaned"), table(spark, sf_dir, "moderation_labels")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, labels = _in(spark, sf_dir)
    models = trained_once(spark, "toxicity", sf_dir, lambda: train(*sample(posts, labels, "body_for_analysis")))
    return score_posts(posts, labels, models=models)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("found").select("author", "permlink", "kind").distinct()


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each author and kind the posts, those found and their rate."""
    each = _scored(spark, sf_dir).groupBy("author", "permlink", "kind").agg(F.max("found").alias("found"))
    found = F.count_if("found")
    return each.groupBy("author", "kind").agg(F.count("*").alias("n_posts"), found.alias("n_found"), F.round(found / F.count("*"), 6).alias("rate"))


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores, "p4_rates": p4_rates}
ORACLES: dict[str, str] = {}
