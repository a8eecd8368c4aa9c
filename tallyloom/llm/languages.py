"""Languages of posts and of stretches of mixed posts by a bidirectional gated recurrent network over bytes.

The labels of a bounded sample are cleaned first: sentences are relabelled by a cross-fitted n-gram classifier until the
labels agree with the texts, and languages that only ever were wrong labels vanish. The network, written in numpy and
trained by backpropagation through time on the cleaned sentences, gives every byte a distribution over languages; those
of a sentence's bytes are pooled, and a smoothed path over a post's sentences gives its stretches.

Defined cases: null, blank and unreadable texts have no language and give no row; links, tags, numbers and names inside
a sentence carry none; a null, blank or unknown label is missing; ties fall to the first code; repeated rows count once;
rows without author or permlink are left out; without usable labels nothing is found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.quality import _WORD, _solid, _symbol, is_junk
from tallyloom.llm.samples import SPARE, trained_once, unit_hash
from tallyloom.llm.sentences import BEFORE_NUMBER, MAYBE_LAST, NEVER_LAST
from tallyloom.session import table

#: Bound of the training sample: posts of each label.
POSTS_OF_LABEL = 300
#: The n-gram classifier that cleans the labels: buckets, rounds and folds.
BUCKETS, CLEAN_ROUNDS, FOLDS = 1 << 16, 5, 5
#: Nats for each n-gram that a nat of a language's log frequency outweighs: what tells labels of one language apart is chance.
PRIOR = 0.1
#: A language stays if so many sentences, and this share of those labelled so, keep it.
LEAST_SENTENCES, LEAST_KEPT = 6, 0.3
#: The network: units of each direction, bytes of a training window, batch, steps, learning rate.
HIDDEN, WINDOW, BATCH, STEPS, RATE = 24, 72, 128, 1000, 0.01
#: Rows of bytes run through the network at once: products of this size are not spread over threads, which would cost more time than they save.
ROWS = 512
#: Cost in nats of a change of language between sentences, and bytes at which a sentence's evidence is full.
SWITCH, FULL = 5.0, 48

# All cases begin with a mark of one set, so that nothing is tried at other characters.
_CUT = re.compile(
    r"[.!?…。！？।؟۔\U0001f000-\U0001faff☀-➿️](?:(?<=[.!?…])[\"”»’)\]]*\s+|(?<=[。！？।؟۔])[」』”]*|(?<=[^\W\d_A-Z][.!?])(?=[A-ZÀ-Þ])|(?<=[\U0001f000-\U0001faff☀-➿️])\s+)"
)
_UNMARKED = re.compile(r"(?<=[฀-໿])\s+(?=[^\W\d_])|(?<=[^\W_])\s+(?=[฀-໿])")
_THAI = re.compile(r"[฀-໿]")
#: A sentence goes on after these, with a dot.
_OPEN = frozenset(w.split(".")[-1] for w in (*NEVER_LAST, *BEFORE_NUMBER, *MAYBE_LAST)) - {"", "no"} | {"no"}
_LAST = re.compile(r"(?:^|[^\w])([^\W\d_]+|\d{1,2})\.$")
_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|[#@$][\w-]+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|invalid|test|com|org|net|io)\S*")
_ENDS = re.compile(r"[.!?…。！？।؟۔][\"”»’)\]」』]*\s*$")
#: Lines of at most so many words without an end mark are items; those in a row are judged together.
ITEM_WORDS = 6
#: _WORD for ASCII lines in lower case.
_ASCII_WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*")
_MARKS = re.compile(r"[^\w\s̀-ͯऀ-ॿ฀-໿'’]|[\d_]")
#: What _MARKS does to the characters of ASCII texts, which need no search then.
_ASCII = {k: " " for k in range(128) if _MARKS.match(chr(k))}
# What a link, tag or address has in it.
_SIGNS = ("://", "www.", "#", "@", "$", ".example", ".invalid", ".test", ".com", ".org", ".net", ".io")
_TAG = re.compile(r"<[^>\n]{1,200}>|!\[[^\]\n]*\]\([^)\s]*\)|\]\([^)\s]*\)")
# Three-letter codes besides those of the table, and placeholders.
OTHER_CODES = {"ger": "deu", "fre": "fra", "chi": "zho", "dut": "nld", "cze": "ces", "per": "fas", "cmn": "zho", "iw": "heb", "in": "ind"}


def normal_code(label: str | None, codes: dict[str, str]) -> str | None:
    """The code that a label in any notation names, or None."""
    label = (label or "").strip().lower()
    for x in (label, re.split("[-_ ]", label)[0]):
        x = OTHER_CODES.get(x, x)
        if x in codes:
            return codes[x]
    return None


def reduced(sentence: str) -> str:
    """Letters of a sentence without links that carry language: no digits, marks, nor names inside the sentence."""
    words = (sentence.translate(_ASCII) if sentence.isascii() else _MARKS.sub(" ", sentence)).split()
    if not words:
        return ""
    if any(map(str.islower, words)):
        words[1:] = [w for w in words[1:] if not w[0].isupper()]
    return " ".join(words).lower()


def sentences_of(text: str) -> list[tuple[str, int]]:
    """(reduced sentence, its characters) for each readable sentence, in reading order."""
    out: list[tuple[str, int]] = []
    if "<" in text or "](" in text:
        text = _TAG.sub(" ", text)
    if any(x in text for x in _SIGNS):
        text = "\n".join(_NOISE.sub(" ", x) if any(y in x for y in _SIGNS) else x for x in text.split("\n"))
    odd = [c for c in set(text) if _symbol(c)]
    items = False
    for line in text.split("\n"):
        solid = _solid(line)
        if not solid:
            continue
        words = (_ASCII_WORD if line.isascii() else _WORD).findall(line.lower())
        if not words or is_junk(line, words, sum(map(line.count, odd)) if odd else 0, solid):
            continue
        if len(words) <= ITEM_WORDS and line.isascii() and not _ENDS.search(line):
            if r := reduced(line):
                if items:
                    out[-1] = (f"{out[-1][0]} {r}", out[-1][1] + solid)
                else:
                    out.append((r, solid))
                items = True
            continue
        items = False
        before = ""
        if _THAI.search(line):
            parts = _UNMARKED.sub("\0", _CUT.sub("\\g<0>\0", line)).split("\0")
        else:
            ends = [m.end() for m in _CUT.finditer(line)]
            parts = [line[a:b] for a, b in zip([0, *ends], [*ends, len(line)])] if ends else [line]
        for s in parts:
            s = s.rstrip()
            if not s:
                continue
            whole = f"{before} {s}" if before else s
            end = _LAST.search(s.rsplit(None, 1)[-1]) if s[-1] == "." else None
            if end and (len(end[1]) == 1 or end[1].isdigit() or end[1].lower() in _OPEN):
                before = whole
                continue
            before = ""
            if r := reduced(whole):
                out.append((r, _solid(whole)))
        if before and (r := reduced(before)):
            out.append((r, _solid(before)))
    return out


def _buckets(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three characters of all sentences, and where each sentence's begin."""
    chars = [np.frombuffer(f" {s} ".encode("utf-32-le"), np.uint32).astype(np.uint64) for s in sentences]
    out, sizes = [], []
    for c in chars:
        h1 = c * np.uint64(0x9E3779B1)
        h2 = (c[:-1] * np.uint64(0x85EBCA77) + c[1:]) * np.uint64(0xC2B2AE3D)
        h3 = ((c[:-2] * np.uint64(31) + c[1:-1]) * np.uint64(0x27D4EB2F) + c[2:]) * np.uint64(0x165667B1)
        h = np.concatenate([h1, h2, h3])
        out.append(((h ^ (h >> np.uint64(15))) % np.uint64(BUCKETS)).astype(np.int64))
        sizes.append(len(h))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def clean_labels(sentences: list[str], labels: np.ndarray, fold: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Labels (or -1) of the sentences after relabelling each by a classifier trained on the other folds."""
    ids, starts = _buckets(sentences)
    sizes = np.diff(np.append(starts, len(ids)))
    of = np.repeat(np.arange(len(sentences)), sizes)
    now = labels.copy()
    for _ in range(CLEAN_ROUNDS):
        new = now.copy()
        for f in range(FOLDS):
            train, test = (fold != f) & (now >= 0), fold == f
            if not train.any() or not test.any():
                continue
            table_ = np.zeros((n, BUCKETS), np.float32)
            tok = train[of]
            np.add.at(table_, (now[of[tok]], ids[tok]), 1.0)
            prior = np.log(np.bincount(now[train], weights[train], n) + 1e-3)
            total = table_.sum(axis=1, keepdims=True)
            logp = np.log((table_ + 0.02) / (total + 0.02 * BUCKETS))
            logp[total[:, 0] == 0] = -30.0
            rows = np.flatnonzero(test)
            picked = np.flatnonzero(test[of])
            begin = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            # per n-gram, so that a language as good but for chance gives way to the more common one
            score = np.add.reduceat(logp[:, ids[picked]], begin, axis=1) / sizes[rows] + PRIOR * prior[:, None]
            new[rows] = score.argmax(axis=0)
        if (new == now).all():
            break
        now = new
    kept = np.bincount(labels[(labels >= 0) & (labels == now)], minlength=n) / np.maximum(np.bincount(labels[labels >= 0], minlength=n), 1)
    sound = (kept >= LEAST_KEPT) & (np.bincount(now[now >= 0], minlength=n) >= LEAST_SENTENCES)
    return np.where((now >= 0) & sound[now], now, -1)


class Network:
    """A bidirectional gated recurrent network over bytes with a distribution over classes at each position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.h, self.c = hidden, classes
        # for each direction: what a byte gives to the gates (update, reset, candidate), recurrent weights
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": 0.3 * rng.normal(size=(257, 3 * hidden)).astype(np.float32), f"u{d}": init(hidden, 2 * hidden), f"v{d}": init(hidden, hidden)}
        self.w |= {"o": init(2 * hidden, classes), "ob": np.zeros(classes, np.float32)}

    def _run(self, d: str, x: np.ndarray, keep: np.ndarray, save: bool) -> tuple[np.ndarray, list]:
        """States (time, rows, hidden) of one direction over bytes x (time, rows); keep is 0 at padding."""
        h_, wx, u, v = self.h, self.w[f"x{d}"], self.w[f"u{d}"], self.w[f"v{d}"]
        t_, n = x.shape
        states, saved = np.zeros((t_, n, h_), np.float32), []
        h = np.zeros((n, h_), np.float32)
        for t in range(t_) if d == "f" else range(t_ - 1, -1, -1):
            a = wx[x[t]]
            zr = 0.5 * np.tanh(0.5 * (a[:, : 2 * h_] + h @ u)) + 0.5
            z, r = zr[:, :h_], zr[:, h_:]
            rh = r * h
            g = np.tanh(a[:, 2 * h_ :] + rh @ v)
            k = keep[t][:, None]
            new = h + k * (1 - z) * (g - h)
            if save:
                saved.append((t, h, zr, rh, g))
            h = new
            states[t] = h
        return states, saved

    def _states(self, d: str, x: np.ndarray, first: list[int]) -> np.ndarray:
        """States of _run() without a mask: at each step only the rows from first on, those that have a byte there, take part.

        Gates are kept apart, so that all arrays are contiguous; the halves of the logistic function are in the weights.
        """
        h_, u = self.h, self.w[f"u{d}"]
        wz, wr, wg = (np.ascontiguousarray(w) for w in np.split(self.w[f"x{d}"] * np.repeat(np.float32([0.5, 0.5, 1]), h_), 3, axis=1))
        uz, ur = (np.ascontiguousarray(w) for w in np.split(0.5 * u, 2, axis=1))
        v = 0.5 * self.w[f"v{d}"]
        t_, n = x.shape
        states, all_h = np.zeros((t_, n, h_), np.float32), np.zeros((n, h_), np.float32)
        for t in range(t_) if d == "f" else range(t_ - 1, -1, -1):
            at, h = x[t, first[t] :], all_h[first[t] :]
            r = wr.take(at, axis=0)
            r += h @ ur
            np.tanh(r, out=r)
            r += 1.0
            r *= h
            g = wg.take(at, axis=0)
            g += r @ v
            np.tanh(g, out=g)
            z = wz.take(at, axis=0)
            z += h @ uz
            np.tanh(z, out=z)
            z += 1.0
            h -= g
            h *= z
            h *= 0.5
            h += g
            states[t, first[t] :] = h
        return states

    def forward(self, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Log probabilities (rows, classes) pooled over the positions that keep marks, the first ones of each row."""
        sizes = keep.sum(axis=0).astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        x = np.ascontiguousarray(x[:, order])
        first = np.searchsorted(sizes[order], np.arange(len(x)), side="right").tolist()
        both = [self._states(d, x, first) for d in "fb"]
        of, ob = (np.ascontiguousarray(w.T) for w in np.split(self.w["o"], 2))
        bias, total = self.w["ob"][:, None], np.zeros((self.c, x.shape[1]), np.float32)
        for t, a in enumerate(first):
            logit = of @ both[0][t, a:].T
            logit += ob @ both[1][t, a:].T
            logit += bias
            logit -= logit.max(axis=0)
            total[:, a:] += logit
            total[:, a:] -= np.log(np.exp(logit, out=logit).sum(axis=0))
        out = np.empty((x.shape[1], self.c), np.float32)
        out[order] = total.T
        return out / (sizes[:, None].astype(np.float32) + np.float32(1e-6))

    def gradients(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients by backpropagation through time; y (rows) is the class of all positions of a row."""
        h_, w = self.h, self.w
        runs = {d: self._run(d, x, keep, True) for d in "fb"}
        cat = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        logit = cat @ w["o"] + w["ob"]
        logit -= logit.max(axis=2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=2, keepdims=True)
        total = keep.sum()
        rows = np.arange(len(y))
        loss = -float((np.log(p[:, rows, y] + 1e-9) * keep).sum() / total)
        p[:, rows, y] -= 1.0
        dlogit = p * (keep / total)[:, :, None]
        grad = {k: np.zeros_like(a) for k, a in w.items()}
        grad["o"] = np.matmul(cat.transpose(0, 2, 1), dlogit).sum(axis=0)  # step by step, each product small
        grad["ob"] = dlogit.reshape(-1, self.c).sum(axis=0)
        dcat = dlogit @ w["o"].T
        by_byte = np.argsort(x.ravel(), kind="stable")
        first = np.flatnonzero(np.diff(x.ravel()[by_byte], prepend=-1))
        for k, d in enumerate("fb"):
            u, v = w[f"u{d}"], w[f"v{d}"]
            dh = np.zeros((x.shape[1], h_), np.float32)
            grads = np.zeros((*x.shape, 3 * h_), w[f"x{d}"].dtype)
            for t, h, zr, rh, g in reversed(runs[d][1]):
                dh = dh + dcat[t, :, k * h_ : (k + 1) * h_]
                z, r, m = zr[:, :h_], zr[:, h_:], keep[t][:, None]
                dg = dh * m * (1 - z) * (1 - g * g)
                dz = dh * m * (h - g) * z * (1 - z)
                drh = dg @ v.T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                grad[f"u{d}"] += h.T @ dzr
                grad[f"v{d}"] += rh.T @ dg
                grads[t, :, : 2 * h_], grads[t, :, 2 * h_ :] = dzr, dg
                dh = dh * (1 - m * (1 - z)) + drh * r + dzr @ u.T
            grad[f"x{d}"][x.ravel()[by_byte[first]]] = np.add.reduceat(grads.reshape(-1, 3 * h_)[by_byte], first, axis=0)
        return loss, grad

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> float:
        """Adam steps on windows of the texts, classes drawn by the root of their size; returns the last mean loss."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == c) for c in range(self.c)]
        odds = np.sqrt([len(g) for g in groups])
        odds = odds / odds.sum()
        m1, m2 = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        recent = []
        for step in range(1, steps + 1):
            y = rng.choice(self.c, BATCH, p=odds)
            rows = []
            for c in y:
                b = texts[rng.choice(groups[c])]
                size = int(rng.integers(12, WINDOW + 1))
                at = int(rng.integers(0, max(1, len(b) - size + 1)))
                rows.append(b[at : at + size])
            x, keep = as_rows(rows)
            loss, grad = self.gradients(x, keep, y)
            recent = [*recent[-49:], loss]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1))) * min(1.0, 5.0 / (norm + 1e-9))
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(recent)) if recent else 0.0


def as_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, rows), padded with 256, and a mask of the real ones."""
    size = max(map(len, texts))
    x = np.full((len(texts), size), 256, np.int64)
    for k, b in enumerate(texts):
        x[k, : len(b)] = np.frombuffer(b, np.uint8)
    return np.ascontiguousarray(x.T), np.ascontiguousarray((x != 256).T.astype(np.float32))


def classify(net: Network, sentences: list[str]) -> np.ndarray:
    """Pooled log probabilities (sentences, classes); equal sentences run once, those of like length together."""
    if not sentences:
        return np.zeros((0, net.c), np.float32)
    number = {s: k for k, s in enumerate(dict.fromkeys(sentences))}
    data = [s.encode() for s in number]
    order = sorted(range(len(data)), key=lambda k: len(data[k]))
    out = np.zeros((len(data), net.c), np.float32)
    at = 0
    while at < len(order):
        # long sentences run in smaller groups, so that a batch's memory is bounded
        size = max(1, min(ROWS, 400_000 // max(1, len(data[order[min(at + ROWS, len(order)) - 1]]))))
        part = order[at : at + size]
        out[part] = net.forward(*as_rows([data[k] for k in part]))
        at += size
    return out[[number[s] for s in sentences]]


def stretches(logp: np.ndarray, sizes: list[int]) -> list[int]:
    """The class of each sentence on the best path, where a change of class costs SWITCH."""
    best_each = logp.argmax(axis=1)
    if (best_each == best_each[0]).all():
        return best_each.tolist()
    emit = logp * (np.minimum(sizes, FULL) / 6.0)[:, None]
    score, back = emit[0], []
    for e in emit[1:]:
        best = int(score.argmax())
        stay = score >= score[best] - SWITCH
        back.append(np.where(stay, np.arange(len(score)), best))
        score = np.where(stay, score, score[best] - SWITCH) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _codes(lang_codes: DataFrame) -> dict[str, str]:
    out: dict[str, str] = {}
    for r in lang_codes.select("code", "code3", "lang_name").collect():  # the table of languages
        out |= {k.strip().lower(): r.code for k in (r.code, r.code3, r.lang_name) if k}
    return out


def training_sentences(posts: DataFrame, codes: dict[str, str], text: str) -> tuple[list[str], np.ndarray, list[str]]:
    """Sentences of the bounded sample, their cleaned labels and the languages, in order of code."""
    rows = posts.where(f"author is not null and permlink is not null and {text} is not null and dominant_lang is not null")
    rows = rows.select("author", "permlink", F.lower(F.trim("dominant_lang")).alias("label"), F.col(text).alias("text"))
    names = {k: v for k, v in codes.items()} | {k: codes[v] for k, v in OTHER_CODES.items() if v in codes}
    as_code = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    label = F.coalesce(F.try_element_at(as_code, F.col("label")), F.try_element_at(as_code, F.get(F.split("label", "[-_ ]"), F.lit(0))))
    rows = rows.withColumn("code", label).where("code is not null").drop("label")
    totals = {r.code: r["count"] for r in rows.groupBy("code").count().collect()}  # at most one row for each code
    share = F.create_map(*(F.lit(x) for c, n in totals.items() for x in (c, min(1.0, SPARE * POSTS_OF_LABEL / n)))) if totals else None
    if totals:  # so that no task sorts more texts than the sample needs
        rows = rows.where(unit_hash(11, "author", "permlink") < F.try_element_at(share, F.col("code")))
    pick = Window.partitionBy("code").orderBy(unit_hash(11, "author", "permlink"), "author", "permlink", "text")
    sample = rows.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= POSTS_OF_LABEL).drop("r").collect()
    langs = sorted(totals)
    order = {c: k for k, c in enumerate(langs)}
    taken = Counter(r.code for r in sample)
    sentences, labels, fold, weights = [], [], [], []
    for r in sorted(sample, key=lambda r: (r.author, r.permlink)):
        f = zlib.crc32(f"{r.author}/{r.permlink}".encode()) % FOLDS
        for s, _ in sentences_of(r.text):
            if len(s) >= 4:
                sentences.append(s)
                labels.append(order[r.code])
                fold.append(f)
                weights.append(totals[r.code] / taken[r.code])
    if not sentences:
        return [], np.zeros(0, np.int64), langs
    clean = clean_labels(sentences, np.array(labels), np.array(fold), np.array(weights), len(langs))
    return [s for s, y in zip(sentences, clean) if y >= 0], clean[clean >= 0], langs


def train(posts: DataFrame, codes: dict[str, str], text: str = "body_clean") -> tuple[Network | None, list[str]]:
    sentences, labels, langs = training_sentences(posts, codes, text)
    if not sentences:
        return None, []
    used = np.unique(labels)
    net = Network(len(used))
    net.fit([s.encode() for s in sentences], np.searchsorted(used, labels))
    return net, [langs[k] for k in used]


def find_languages(posts: DataFrame, lang_codes: DataFrame, text: str = "body_clean", model: tuple[Network | None, list[str]] | None = None) -> DataFrame:
    """(author, permlink, seg_no, lang, n_chars, confidence, right_label) of each post and each stretch.

    seg_no 0 is the whole post in the language with most characters; 1, 2, ... are the stretches of mixed posts. Without a model of train() one is trained.
    """
    spark = posts.sparkSession
    schema = "author string, permlink string, seg_no int, lang string, n_chars bigint, confidence double, right_label boolean"
    codes = _codes(lang_codes)
    net, langs = model or train(posts, codes, text)
    if net is None:
        return spark.createDataFrame([], schema)
    texts = posts.where("author is not null and permlink is not null").select(
        "author", "permlink", "dominant_lang", F.coalesce(F.col(text), F.lit("")).alias("__text")
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            each = [sentences_of(t) for t in part["__text"]]
            logp = classify(net, [s for ss in each for s, _ in ss])
            sure, likeliest = np.exp(logp), logp.argmax(axis=1).tolist()
            rows, at = [], 0
            for author, permlink, label, ss in zip(part["author"], part["permlink"], part["dominant_lang"], each):
                begin, at = at, at + len(ss)
                if not ss:
                    continue
                path = likeliest[begin:at]
                if path.count(path[0]) < len(path):
                    path = stretches(logp[begin:at], [len(s.encode()) - s.count(" ") for s, _ in ss])
                sizes: Counter = Counter()
                runs: list[list] = []
                for k, ((_, n), c) in enumerate(zip(ss, path)):
                    sizes[c] += n
                    if not runs or runs[-1][0] != c:
                        runs.append([c, 0, 0.0])
                    runs[-1][1] += n
                    runs[-1][2] += n * float(sure[begin + k, c])
                main = max(sorted(sizes), key=lambda c: sizes[c])
                total = sum(r[2] for r in runs if r[0] == main)
                right = normal_code(label, codes) == langs[main]
                rows.append((author, permlink, 0, langs[main], sizes[main], total / max(1, sizes[main]), right))
                if len(sizes) > 1:
                    rows += [(author, permlink, k, langs[c], n, p / max(1, n), True) for k, (c, n, p) in enumerate(runs, 1)]
            if rows:
                yield pd.DataFrame(rows, columns=["author", "permlink", "seg_no", "lang", "n_chars", "confidence", "right_label"])

    return texts.mapInPandas(run, schema)


def _in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "hive_english_filtered"), table(spark, sf_dir, "lang_codes")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, codes = _in(spark, sf_dir)
    model = trained_once(spark, "languages", sf_dir, lambda: train(posts, _codes(codes)))
    return find_languages(posts, codes, model=model)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).where("seg_no > 0 or not right_label").select("author", "permlink", "seg_no", "lang").distinct()


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post's and stretch's language with its confidence."""
    found = _found(spark, sf_dir)
    return found.select("author", "permlink", "seg_no", "lang", "n_chars", F.round("confidence", 4).alias("confidence")).distinct()


QUERIES = {"p2_found": p2_found, "p2_languages": p2_languages}
ORACLES: dict[str, str] = {}
