"""The text operators on small fixtures: edge cases, brute force, round trips, held-out accuracy."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import entry, languages, lines, mixing, packing, quality, sampling, sentences, spam, subjects, toxicity
from tallyloom.session import table

POST = "author string, permlink string, created timestamp, "


@pytest.mark.parametrize("name", ["p3_found", "p3_sample", "p5_found", "p5_sentence_stats", "p6_found", "p6_cleaned", "p7_found", "p7_statistics", "p8_found", "p8_packed", "p8_report", "p9_found", "p9_report", "p10_found", "p10_sources"])
def test_queries_run(spark, small, name):
    assert entry.QUERIES[name](spark, small).columns


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_against_duckdb(spark, small, name):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    cur = con.execute(entry.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(str([dict(zip(names, r))[c] for c in cols]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


# sentences

CASES = [
    ("Dr. Vey arrived at 5 p.m. and left. The doors close at 9 p.m. Nobody waits.", ["Dr. Vey arrived at 5 p.m. and left.", "The doors close at 9 p.m.", "Nobody waits."]),
    ("It grew from 0.5 to 1.5 units, i.e. little. See www.a.example/x?y=1.html for more!", ["It grew from 0.5 to 1.5 units, i.e. little.", "See www.a.example/x?y=1.html for more!"]),
    ("He asked, “Why now?” No one replied. “Stop!” shouted she.", ["He asked, “Why now?”", "No one replied.", "“Stop!” shouted she."]),
    ("Wait... what was that? Hmm... Later. end.Next one", ["Wait... what was that?", "Hmm...", "Later.", "end.", "Next one"]),
    ("Done 🙂 We go. 😀 On!! (All of it.) Yes", ["Done 🙂", "We go. 😀", "On!!", "(All of it.)", "Yes"]),
    ("别走！你好吗？“别走！”他喊道。好", ["别走！", "你好吗？", "“别走！”他喊道。", "好"]),
    ("Am 3. Oktober zahlte Hr. Karr 3.500 Kronen, z. B. hier. Gut.", ["Am 3. Oktober zahlte Hr. Karr 3.500 Kronen, z. B. hier.", "Gut."]),
    ("line one\n\n  line two  \r\nthree.", ["line one", "line two", "three."]),
    ("1. item one\n2. item two", ["1. item one", "2. item two"]),
    ("मैं गया। तुम कहाँ हो?", ["मैं गया।", "तुम कहाँ हो?"]),
    ("***!!! ??? ...", ["***!!! ??? ..."]),
    ("🎉 Join us now. You lying piece of sh*t. Yes", ["🎉 Join us now.", "You lying piece of sh*t.", "Yes"]),
    ("天已经下雨了……大家都没带伞。好", ["天已经下雨了……大家都没带伞。", "好"]),
    ("Er rief: „" + "Das ist ein langer Satz. " * 40 + "Ende.“ Dann ging er.", ["Er rief: „" + "Das ist ein langer Satz. " * 40 + "Ende.“", "Dann ging er."]),
    ("She said ‘" + "I don’t know. " * 30 + "No.’ and left. Bye.", ["She said ‘" + "I don’t know. " * 30 + "No.’ and left.", "Bye."]),
    ("                1. item after many blanks\n123456. item", ["1. item after many blanks", "123456. item"]),
    ("1.5 2.5 ... " * 120 + "\nEnd. Yes", [("1.5 2.5 ... " * 120).strip(), "End.", "Yes"]),
    ("", []),
    (" \n\t", []),
    (None, []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(spark, text, want):
    df = spark.createDataFrame([("a", "p", text, 1)], "author string, permlink string, body_for_analysis string, start_char int")
    got = sorted(sentences.split_sentences(df).collect(), key=lambda r: r.start_char)
    assert [r.sentence for r in got] == want
    for r in got:
        assert text[r.start_char : r.end_char] == r.sentence


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n“”\"'1A。é😀(", max_size=40), min_size=1, max_size=20))
def test_sentences_cover_all_but_space(spark, texts):
    df = spark.createDataFrame([(str(k), "p", t) for k, t in enumerate(texts)], "author string, permlink string, body_for_analysis string")
    got = {k: [] for k in map(str, range(len(texts)))}
    for r in sentences.split_sentences(df).collect():
        got[r.author].append((r.start_char, r.end_char))
    for k, t in enumerate(texts):
        spans = sorted(got[str(k)])
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert all(t[a:b].strip() == t[a:b] != "" for a, b in spans)
        covered = {i for a, b in spans for i in range(a, b)}
        assert {i for i, c in enumerate(t) if not c.isspace()} <= covered


def test_very_long_text(spark):
    df = spark.createDataFrame([("a", "p", "One here. " * 20_000)], "author string, permlink string, body_for_analysis string")
    assert sentences.split_sentences(df).count() == 20_000
    lines_ = spark.createDataFrame([("a", "p", "\n".join(f"Line {k} here. Yes" for k in range(60_000)))], df.schema)
    got = sentences.split_sentences(lines_)
    assert got.where("sentence = 'Yes' or sentence rlike '^Line [0-9]+ here[.]$'").count() == 120_000


# repeated lines

def test_repeated_lines_by_brute_force(spark):
    rng = np.random.default_rng(1)
    pool = [f"A line with letters number {'abcdefgh'[k]}" for k in range(8)] + ["short", "", "the SAME line of WORDS!!", "The same line, of words"]
    rows = [(f"a{p % 3}", f"p{p}", "\n".join(rng.choice(pool, 5))) for p in range(40)]
    rows += [rows[0], (None, "x", pool[0]), ("a0", "n", None)]
    df = spark.createDataFrame(rows, "author string, permlink string, body_for_analysis string").withColumn("created", F.current_timestamp())
    key = lambda x: "".join(c for c in x if c.isalpha()).lower()
    posts: dict = {}
    for a, p, t in rows:
        for x in (t or "").split("\n") if a else []:
            if len(key(x)) >= 12:
                posts.setdefault((a, key(x)), set()).add(p)
    want = {(a, p, k) for a, p, t in rows if a and t for k, x in enumerate(t.split("\n"), 1) if len(posts.get((a, key(x)), ())) >= 5}
    assert {(r.author, r.permlink, r.line_no) for r in lines.repeated_lines(df).collect()} == want
    cleaned = {(r.author, r.permlink): r.text for r in lines.without_repeated_lines(df).collect()}
    for a, p, t in rows[:40]:
        assert cleaned[(a, p)] == "\n".join(x for k, x in enumerate(t.split("\n"), 1) if (a, p, k) not in want)


def test_republished_articles_are_no_boilerplate(spark):
    rows = [("a", f"p{k}", "One long article with a first line\nand its second line of words") for k in range(6)]
    df = spark.createDataFrame(rows, "author string, permlink string, body_for_analysis string").withColumn("created", F.current_timestamp())
    assert lines.repeated_lines(df).count() == 12
    assert lines.repeated_lines(df, min_posts=1, min_clusters=5).count() == 0


def _line_fixture(spark):
    """Copies of one text, posts with several texts, repeated rows, null dates, a line twice in a text."""
    rng = np.random.default_rng(8)
    pool = [f"A line with letters number {'abcdefgh'[k]}" for k in range(8)] + ["short", ""]
    day = lambda k: None if k % 5 == 0 else pd.Timestamp(2024, 1, 1 + k % 9).to_pydatetime()
    rows = [("a", f"c{k}", day(k), "The article that is copied often\nA line with letters number a" + "!" * (k % 3)) for k in range(30)]
    rows += [(f"a{k % 2}", f"p{k % 25}", day(k), "\n".join(rng.choice(pool, 6))) for k in range(60)]
    return rows + rows[:4] + [("a0", "q", None, pool[0] + "\n" + pool[0]), (None, "x", None, pool[0]), ("a0", None, None, pool[0]), ("a0", "n", None, None)]


def test_counts_of_posts_clusters_and_days_by_brute_force(spark):
    rows = _line_fixture(spark)
    df = spark.createDataFrame(rows, "author string, permlink string, created timestamp, body_for_analysis string")
    bare = lambda x: "".join(c for c in x if c.isalpha()).lower()
    posts, clusters, days, places = {}, {}, {}, set()
    for a, p, d, t in rows:
        if a is None or p is None or t is None:
            continue
        for n, x in enumerate(t.split("\n"), 1):
            if len(bare(x)) >= 12:
                posts.setdefault((a, bare(x)), set()).add(p)
                clusters.setdefault((a, bare(x)), set()).add(tuple(map(bare, t.split("\n"))))
                days.setdefault((a, bare(x)), set()).update([d.date()] if d else [])
                places.add((a, p, n, bare(x)))
    for rule in ({}, {"min_posts": 1, "min_clusters": 3}, {"min_posts": 2, "min_clusters": 2, "min_days": 4}):
        lim = {"min_posts": 5, "min_clusters": 1, "min_days": 0} | rule
        want = {
            (a, p, n, len(posts[a, x]), len(clusters[a, x]), len(days[a, x])) for a, p, n, x in places
            if len(posts[a, x]) >= lim["min_posts"] and len(clusters[a, x]) >= lim["min_clusters"] and len(days[a, x]) >= lim["min_days"]
        }
        assert {tuple(r) for r in lines.repeated_lines(df, **rule).collect()} == want


def test_copies_collapse_before_lines_are_cut_out(spark, monkeypatch):
    df = spark.createDataFrame(_line_fixture(spark), "author string, permlink string, created timestamp, body_for_analysis string")
    clusters, members = lines.collapsed(df)
    assert clusters.where("author = 'a'").count() == 1 and members.where("author = 'a'").count() == 30
    whole = lines.occurrences(df).count()
    real = lines.collapsed
    monkeypatch.setattr(lines, "collapsed", lambda *x: (real(*x)[0], real(*x)[1].dropDuplicates(["author", "cluster"])))
    assert lines.occurrences(df).count() < whole  # without the posts that clusters stand for, lines are lost


# sampling

def test_sample_meets_quotas(spark):
    rows = [(f"a{k}", "p", "Political " if k % 2 else None, ["gaming", "crypto finance", "x"][k % 3], None if k % 2 else False) for k in range(300)]
    rows += [rows[0]] * 3 + [("n", "p", None, "gaming", None), (None, "p", "political", "gaming", True), ("m", "p", "political", " ", True)]
    posts = spark.createDataFrame(rows, "author string, permlink string, sample_stratum string, category string, is_political boolean")
    targets = spark.createDataFrame(
        [(1, "political", "gaming", 0.5, 3, 40), (1, "nonpolitical", "crypto_finance", 0.3, 60, 40), (1, "political", "none", 0.2, 0, 40)],
        "plan_id int, sample_stratum string, category string, target_share double, min_rows long, sample_rows long",
    )
    report = {r.category: r for r in sampling.sample_report(posts, targets).collect()}
    assert (report["gaming"].needed_rows, report["gaming"].available_rows, report["gaming"].exhausted) == (20, 50, False)
    assert (report["crypto_finance"].needed_rows, report["crypto_finance"].exhausted) == (60, True)
    assert (report["none"].available_rows, report["none"].quota_rows) == (0, 0)
    drawn = sampling.draw(posts, targets).collect()
    assert len(drawn) == len(set(drawn))
    assert Counter(r.category for r in drawn) == Counter({c: r.quota_rows for c, r in report.items() if r.quota_rows})
    assert sampling.draw(posts.limit(0), targets).count() == 0


def test_level_fill():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        low = rng.integers(0, 9, n)
        high = low + rng.integers(0, 12, n)
        ideal, total = rng.random(n) * 20, int(rng.integers(0, 120))
        got = sampling.level_fill(ideal, low, high, total)
        assert (low <= got).all() and (got <= high).all()
        assert got.sum() == min(max(total, low.sum()), high.sum())
        # no row could move from a cell further above its ideal to one further below it
        up, down = got < high, got > low
        if up.any() and down.any():
            assert (got - ideal)[down].max() - (got - ideal)[up].min() <= 2.0 + 1e-9
    assert sampling.level_fill(np.array([1.0]), np.array([0]), np.array([40_000]), 30_000).tolist() == [30_000]


def test_counts_and_quotas_come_from_one_reservoir_pass(spark, small, monkeypatch):
    posts = spark.createDataFrame([(f"a{k % 7}", f"p{k}", "Political", "gaming" if k % 3 else "travel", True) for k in range(900)], "author string, permlink string, sample_stratum string, category string, is_political boolean")
    caps = spark.createDataFrame([("political", "gaming", 5), ("political", "travel", 0)], "stratum string, cat string, capacity long")
    kept = sampling.reservoirs(posts, caps).collect()
    assert Counter((r.cat, r.available_rows) for r in kept) == {("gaming", 600): 5, ("travel", 300): 1}
    targets = spark.createDataFrame([(1, "political", "gaming", 0.5, 4, 20), (1, "political", "travel", 0.5, 301, 20)], "plan_id int, sample_stratum string, category string, target_share double, min_rows long, sample_rows long")
    want = sorted(sampling.draw(posts, targets).collect())
    seen, whole = [], sampling.posts_in_cells
    monkeypatch.setattr(sampling, "posts_in_cells", lambda x: seen.append(x) or whole(x))
    assert sorted(sampling.draw(posts, targets).collect()) == want and len(seen) == 1
    passes, pass_ = [], sampling.reservoirs
    monkeypatch.setattr(sampling, "reservoirs", lambda *x: passes.append(x) or pass_(*x))
    assert {(r.category, r.available_rows, r.exhausted) for r in sampling.sample_report(posts, targets).collect()} == {("gaming", 600, False), ("travel", 300, True)}
    assert sampling.p3_found(spark, small).columns and sampling.p3_report(spark, small).columns and len(passes) == 3


# packing

@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_packing_never_overflows(sizes):
    where = packing.pack_block(sizes, 50)
    sums = Counter()
    for s, w in zip(sizes, where, strict=True):
        sums[w] += s
    assert all(v <= 50 for v in sums.values())


def test_differencing_is_near_equal():
    rng = np.random.default_rng(2)
    sizes = rng.integers(20, 400, 900).tolist()
    sums = np.bincount(packing.differencing(sizes, 100), sizes, 100)
    assert sums.max() - sums.min() <= 0.02 * sums.mean()


def test_packing_is_near_equal_where_best_fit_would_do():
    sizes = np.random.default_rng(2).integers(20, 400, 900).tolist()
    for capacity in (1930, 1990):  # the smallest number of windows leaves some room
        sums = np.bincount(packing.pack_block(sizes, capacity), sizes)
        assert len(sums) == -(-sum(sizes) // capacity)
        assert sums.max() <= capacity and sums.max() - sums.min() <= 0.02 * sums.mean()


def test_packing_adds_windows_until_none_overflows():
    for sizes, least in (([6] * 40, 40), ([4, 3, 3] * 30, 30), ([10] * 7 + [1] * 5, 8)):
        sums = np.bincount(packing.pack_block(sizes, 10), sizes)
        assert sums.max() <= 10 and sums.min() > 0 and least <= len(sums) <= 1.25 * least


def test_pack_places_every_token_once(spark):
    docs = spark.createDataFrame([(k, int(n)) for k, n in enumerate([5, 0, 120, 50, 49, 3, 100] * 30)], "doc_id long, n_tokens long")
    bins = spark.createDataFrame([("b", 50), ("bad", 0)], "bin_name string, capacity_tokens long")
    rows = packing.pack(docs, bins, block=4).toPandas()
    assert rows.groupby(["block", "window_no"]).tokens.sum().max() <= 50
    assert rows.groupby("doc_id").tokens.sum().to_dict() == {r.doc_id: r.n_tokens for r in docs.collect() if r.n_tokens}
    assert {r.doc_id for r in packing.must_split(docs, bins).collect()} == {r.doc_id for r in docs.collect() if r.n_tokens > 50}
    assert packing.pack(docs.limit(0), bins).count() == 0


# mixing

def test_mix_by_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(k, "w " * int(rng.integers(1, 30)), ["A ", "b", "c", None][k % 4]) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([(1, "a", 2.0, 2, 2000), (1, "b", 1.0, 1, 2000), (1, "c", 5.0, 3, 2000), (1, "none", 1.0, 2, 2000)], "mix_id int, source string, weight double, max_repeats int, total_tokens long")
    size = {k: len(t.split()) for k, t, _ in docs}
    total = Counter()
    for k, _, s in docs:
        total[(s or "").strip().lower()] += size[k]
    got = mixing.mix(mixing.sized_sources(df), targets).collect()
    assert sum(r.tokens for r in got) <= 2000 < sum(r.tokens for r in got) + 60
    assert max(Counter((r.doc_id, r.epoch) for r in got).values()) == 1
    share = Counter()
    for r in got:
        share[r.src] += r.tokens
    assert share["a"] / share["b"] == pytest.approx(2.0, rel=0.1)
    short = {r.source for r in mixing.shares(mixing.sized_sources(df), targets).where("wanted_tokens > most_tokens").collect()}
    assert short == {s for s, w, m in (("a", 2, 2), ("b", 1, 1), ("c", 5, 3), ("none", 1, 2)) if w / 9 * 2000 > m * total[s]}


def test_exhausted_sources_come_from_the_mix(spark, small, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "abcd"[k % 4]) for k in range(80)], "doc_id long, text string, source string")
    rows = [(1, "a", 1.0, 2, 200), (1, "b", 1.0, 1, 200), (2, "a", 9.0, 2, 400), (2, "b", 1.0, None, 400), (2, "absent", 1.0, 3, 400), (3, "c", 1.0, 1, 400), (3, "d", 0.0, 1, 400), (4, "a", 1.0, None, 900), (4, "d", 1.0, 9, 900)]
    targets = spark.createDataFrame(rows, "mix_id int, source string, weight double, max_repeats int, total_tokens long")
    got = {(r.mix_id, r.source): r for r in mixing.reached(mixing.sized_sources(docs), targets).collect()}
    assert {k for k, r in got.items() if r.exhausted} == {k for k, r in got.items() if r.wanted_tokens > r.most_tokens}
    assert got[2, "a"].exhausted and got[2, "a"].got == got[2, "a"].most_tokens and got[2, "absent"].exhausted
    assert got[4, "a"].laps == 1 and got[4, "a"].exhausted and not got[1, "a"].exhausted
    seen, whole = [], mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *x: seen.append(x) or whole(*x))
    assert mixing.p9_found(spark, small).count() and seen
    monkeypatch.setattr(mixing, "mix", lambda *x: whole(*x).where("epoch = 0"))  # a mix that lost its copies is noticed
    with pytest.raises(Exception, match="mix and token totals differ"):
        mixing.p9_found(spark, small).collect()


# spam

def test_spam_share_of_kinds():
    phrase = {"sofa covers"}
    assert spam.spam_share("buy sofa covers cheap sofa covers best sofa covers free sofa covers", phrase) == 1.0
    assert spam.spam_share("\n".join(f"* https://a{k}.example/x" for k in range(9)), set()) == 1.0
    assert spam.spam_share(" ".join(f"#tag{k}x" for k in range(9)), set()) == 1.0
    assert spam.spam_share("A short post here.\n#one #two #three #four", set()) == 0.0
    assert spam.spam_share("- [Name](https://a.example/1) A sentence of prose that says why this is worth reading today.\n" * 5, set()) < 0.5
    assert spam.spam_share("People asked me about sofa covers and I told them all that I know about them, which is little.", phrase) < 0.3
    assert spam.spam_share("", set()) == 0.0


def test_spam_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a", 7), (2, "", None, 8), (3, " \n ", "b", 9)], "doc_id long, text string, source string, key int")
    assert [r.spam_share for r in spam.score_pages(docs).collect()] == [0.0, 0.0, 0.0]
    assert spam.score_pages(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "#a1 " * 9, "a"), (1, "One short sentence here.", "b"), (None, "#a1 " * 9, "a"), (2, "#b " * 40_000, None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in spam.score_marked(odd).collect()) == [(1, 1.0), (2, 1.0)]


def _keyword_page(k: int, phrase: str) -> str:
    filler = ["best", "cheap", "fast", "near", "top", "sale", "buy", "shop"]
    return " ".join(f"{filler[(k + j) % 8]} {phrase}" for j in range(8))


def test_phrases_must_be_replicated_on_hosts(spark):
    """Pages of one host alone, or one page posted again on many hosts, are not replicated; on three hosts they are."""
    rows = [(k, _keyword_page(k, "sofa covers"), f"h{k}") for k in range(3)]
    rows += [(10 + k, _keyword_page(k, "garden hoses"), "one host") for k in range(6)]
    rows += [(20 + k, _keyword_page(0, "paper lamps").upper() if k % 2 else _keyword_page(0, "paper lamps"), f"h{k}") for k in range(6)]
    rows += [(30, "The ferry left at noon with the mail and nobody asked about sofa covers.", "h9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lambda n: {r.doc_id for r in spam.score_marked(docs, n).where("spam_share > 0.5").collect()}
    assert found(3) == {0, 1, 2}
    assert found(1) == {0, 1, 2, *range(10, 16), *range(20, 26)} and found(4) == set()


def test_replicated_phrases_by_brute_force(spark, small):
    docs = table(spark, small, "documents")
    hosts, once = {}, {}
    for r in docs.collect():
        for name, spans in spam.page_marks(r.text or "")[1]:
            page = "".join(c for c in r.text.lower() if c.isalnum())
            host = (r.source or "").strip().lower()
            once[name, page] = min(once.get((name, page), host), host)
    for (name, _), host in once.items():
        hosts.setdefault(name, set()).add(host)
    good = {n for n, h in hosts.items() if n and len(h) >= 2}
    want = {r.doc_id for r in docs.collect() if r.text and spam.spam_share(r.text, good) > 0.5}
    assert {r.doc_id for r in spam.score_marked(docs, 2).where("spam_share > 0.5").collect()} == want


def test_hosts_that_list_a_phrase_count(spark):
    """A page that repeats a phrase is found by hosts that only have it as an item or link title; what a sentence mentions counts for none."""
    lists = ["Paper lamps, cheap sofa covers, garden hoses", "[sofa covers](https://a.example/1)\n[dog beds](https://a.example/2)"]
    rows = [(0, _keyword_page(0, "sofa covers"), "h0"), (1, _keyword_page(0, "night trains"), "h0")]
    rows += [(2 + k, text, f"h{k + 1}") for k, text in enumerate(lists)]
    rows += [(4 + k, f"All of them went by night trains, as number {k} did.", f"h{k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in spam.score_marked(docs).where("spam_share > 0.5").collect()} == {0, 3}  # 3 by its links


def test_phrases_of_one_word_with_function_words_and_in_a_stretch(spark):
    fill = ["best", "cheap", "fast", "near", "top", "sale", "buy", "shop"]
    pages = lambda phrase: [" ".join(f"{fill[(k + j) % 8]} {phrase}" for j in range(8)) for k in range(3)]
    long = [" ".join(_keyword_page(k + n, f"thing{n}x goods{n}x") for n in range(30)) for k in range(3)]  # each phrase is 3 % of the words
    rows = [text for phrase in ("sofacovers", "loans for the retired") for text in pages(phrase)] + long
    docs = spark.createDataFrame([(k, text, f"h{k % 3}") for k, text in enumerate(rows)], "doc_id long, text string, source string")
    assert {r.doc_id for r in spam.score_marked(docs).where("spam_share > 0.5").collect()} == set(range(9))
    prose = "The ferry left at noon with the mail. In the town the bakers had sold out. " * 2
    assert spam.phrases(spam.plain_words(prose)) == set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=12))
def test_merged_spans(spans):
    got = spam.merged(spans)
    assert {x for a, b in got for x in range(a, b)} == {x for a, b in spans for x in range(a, b)}
    assert all(b < c for (_, b), (c, _) in zip(got, got[1:]))


# quality

def test_kinds_of_lines():
    common = frozenset("the a of and to is in it was".split())
    d = lambda t: quality.describe(t, common)
    assert d("item;price;n\na;1;2\nb;3;4\nc;5;6")["table_share"] == 1.0
    assert d("%%%@@@>>><<<***\n///[[[]]]===+++")["junk_share"] == 1.0
    assert d("xk fj wq rt pl zz vb\nqw rtp sdf ghj klz")["junk_share"] == 1.0
    assert d("haha hahaha ha hahaha haha\nlala lalala lala lala")["junk_share"] == 1.0
    assert d("red apples\ngreen pears\nplums\nsmall figs")["item_share"] == 1.0
    p = d("It was the best of days, and it was long. The end is in the book.")
    assert (p["junk_share"], p["table_share"], p["item_share"]) == (0.0, 0.0, 0.0)
    assert d("")["n_words"] == 0


@pytest.mark.parametrize("most", [10**6, 10])
def test_exact_tails_by_brute_force(spark, small, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_RANKS", most)  # both ways to join the ranks
    stats = quality.statistics(table(spark, small, "hive_cleaned"), table(spark, small, "lang_codes"))
    got = quality.outlier_scores(stats).toPandas()
    plain = (got.n_words > 0) & (got[list(quality.SHARE_OF.values())].max(axis=1) <= quality.UNIT // 2)
    n = plain.groupby(got.lang).transform("sum")
    sets = {f"{k}_score": v for k, v in quality.KINDS.items()} | {"outlier_score": tuple(quality.SIDES)}
    for i, r in got.iterrows():
        refs = [got[plain]] + ([got[plain & (got.lang == r.lang)]] if n[i] >= quality.SMALL else [])
        for name, stats_ in sets.items():
            scores = []
            for g in refs:
                s = 0.0
                for stat in stats_:
                    lo, hi = (((g[stat] <= r[stat]).sum() + 1) / (len(g) + 1), ((g[stat] >= r[stat]).sum() + 1) / (len(g) + 1))
                    s += min(quality.FAR, -math.log({"low": lo, "high": hi, "both": min(1.0, 2 * min(lo, hi))}[quality.SIDES[stat]]))
                scores.append(s / len(stats_))
            assert r[name] == pytest.approx(min(scores))


def test_the_score_decides_what_form_cannot(spark):
    """Verse has the lines of a list; without the score it would be one, and without outliers nothing has a kind."""
    rng = np.random.default_rng(9)
    name = lambda: "".join(rng.choice(list("kmtrs")) + rng.choice(list("aeiou")) for _ in range(4))
    prose = "The road was long and the day was warm, so we sat down by the river and talked of what we had seen. It was good to rest in the shade."
    rows = [("a", f"p{k}", f"{prose} We met {' and '.join(name() for _ in range(2 + k % 15))}.\nIn the end all of us went home, and it was late in the night.") for k in range(300)]
    rows += [("l", f"l{k}", "\n".join(name() for _ in range(9))) for k in range(12)]
    verse = ["the day was long and so was the road", "and we sat by the river in the shade", "it was good to rest and the day was warm", "so all of us went home in the night"]
    rows += [("v", f"v{k}", "\n".join(verse)) for k in range(3)]
    df = spark.createDataFrame(rows, "author string, permlink string, body_for_analysis string").withColumn("dominant_lang", F.lit("en"))
    codes = spark.createDataFrame([("en", "eng", "English")], "code string, code3 string, lang_name string")
    scored = quality.outlier_scores(quality.statistics(df, codes)).cache()
    found = lambda least: {r.author for r in quality.kinds(scored, least).where("kind = 'list'").collect()}
    assert scored.where(f"author = 'v' and item_share > {quality.UNIT // 2}").count() == 3
    assert found(quality.OUTLIER) == {"l"} and found(0.0) == {"l", "v"} and found(99.0) == set()


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([("a", "p", None, None, None), ("a", "q", "", "xx", 0), (None, "r", "t", "en", 1), ("a", "s", "word", "en", 4)], "author string, permlink string, body_for_analysis string, dominant_lang string, body_for_analysis_len long")
    codes = spark.createDataFrame([("en", "eng", "English")], "code string, code3 string, lang_name string")
    got = quality.kinds(quality.outlier_scores(quality.statistics(df, codes)))
    assert {(r.permlink, r.kind) for r in got.collect()} == {("p", None), ("q", None), ("s", None)}
    assert {r.permlink for r in quality.wrong_lengths(df).collect()} == {"p"}


# subjects

def _subject_corpus(n=240, seed=5):
    rng = np.random.default_rng(seed)
    words = {"gaming": "guild raid boss deck mana".split(), "travel": "ferry hostel beach trail harbour".split(), "finance": "token wallet ledger swap yield".split()}
    posts, truth = [], []
    for _ in range(n):
        own = sorted(rng.choice(list(words), int(rng.integers(1, 3)), replace=False))
        text = []
        for s in own:
            text += [f"The {rng.choice(words[s])} was near the {rng.choice(words[s])} and it was good." for _ in range(3)]
        text += [str(rng.choice(["We will see how it goes.", "That is all for now.", "I do not have an answer yet."])) for _ in range(3)]
        posts.append(" ".join(text))
        truth.append(set(own))
    return list(words), posts, truth


def test_subjects_on_held_out_posts(spark):
    names, posts, truth = _subject_corpus()
    rows = [(f"a{k}", "p", t, sorted(map(str, truth[k]))[k % len(truth[k])] if k % 9 else None) for k, t in enumerate(posts)]
    rows += [("es", "p", "La casa de la playa es muy grande y no hay nada que hacer en la ciudad.", "travel"), ("e", "p", None, "gaming"), ("e2", "p", " ", None)]
    df = spark.createDataFrame(rows, "author string, permlink string, body_clean string, category string")
    labels = spark.createDataFrame([(f"a{k}", "p", s) for k in range(120) for s in truth[k]] + [("a1", "p", "unknown"), (None, "p", "gaming")], "author string, permlink string, subject string")
    subs = spark.createDataFrame([(n,) for n in names], "subject string")
    got: dict = {}
    for r in subjects.find_subjects(df, labels, subs).collect():
        got.setdefault(r.author, set()).add(r.subject)
    right = sum(got.get(f"a{k}", set()) == truth[k] for k in range(120, 240))
    assert right >= 110
    assert not {"es", "e", "e2"} & set(got)
    none = labels.limit(0)
    assert subjects.find_subjects(df.withColumn("category", F.lit(None).cast("string")), none, subs).count() == 0


def test_calibration_is_held_out_and_for_each_subject():
    names, posts, truth = _subject_corpus(120)
    units = [subjects.units_of(t) for t in posts]
    own = [{names.index(s): 1.0 for s in t} for t in truth]
    seen, real = [], subjects.train
    subjects.train = lambda posts_, *x: seen.append(len(posts_)) or real(posts_, *x)
    try:
        got = subjects.held_out_gains(units, own, list(range(0, 60)), len(names))
    finally:
        subjects.train = real
    assert seen == [90, 90] and [len(g) for g in got] == [len(u) for u in units[:60]]
    # one subject's units need more than the others'
    gain = [np.array([[0.45 if s == k % 3 else 0.0 for s in range(3)]] * 2 + [[0.0, 0.0, 0.3]] * 2) for k in range(90)]
    rule = subjects.calibrate(gain, [{k % 3} for k in range(90)], 3)
    assert rule["least"][2] > 0.3 and all(set(subjects.accepted(g, **rule)) == {k % 3} for k, g in enumerate(gain))
    assert subjects.calibrate([], [], 3)["least"].tolist() == [subjects.MIN_GAIN] * 3


def test_models_are_trained_once_for_all_queries(spark, small, monkeypatch):
    made, real = [], subjects.fit
    monkeypatch.setattr(subjects, "fit", lambda *x: made.append(1) or real(*x))
    first = subjects.p1_found(spark, small).count()
    assert subjects.p1_composition(spark, small).count() and subjects.p1_found(spark, small).count() == first and len(made) <= 1


# languages

def test_backpropagation_through_time():
    net = languages.Network(3, hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, keep = languages.as_rows([b"abca", b"bb", b"cabcab"])
    y = np.array([0, 2, 1])
    _, grad = net.gradients(x, keep, y)
    rng = np.random.default_rng(0)
    for name, w in net.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name.startswith("x"):
                at = (int(rng.choice([97, 98, 99])), at[1])
            old, step = w[at], 1e-3
            w[at] = old + step
            up = net.gradients(x, keep, y)[0]
            w[at] = old - step
            down = net.gradients(x, keep, y)[0]
            w[at] = old
            assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-5)


def test_network_tells_languages_apart():
    en = [f"the {a} of the {b} was in the house" for a in ("cat", "dog", "bird") for b in ("man", "girl", "king")]
    es = [f"el {a} de la {b} estaba en la casa" for a in ("gato", "perro", "loro") for b in ("mujer", "reina", "hija")]
    train = [t.encode() for t in en[:7] + es[:7]]
    net = languages.Network(2, hidden=8)
    net.fit(train, np.array([0] * 7 + [1] * 7), steps=60)
    assert languages.classify(net, en[7:] + es[7:]).argmax(axis=1).tolist() == [0, 0, 1, 1]
    assert languages.classify(net, []).shape == (0, 2)


def test_network_in_use_has_all_its_units():
    net = languages.Network(3)
    assert net.w["uf"].shape == net.w["ub"].shape == (24, 48) and net.w["o"].shape == (48, 3)


def test_network_runs_each_byte_once(monkeypatch):
    """Pooled probabilities are those of the masked run of training, without any work on padding."""
    net = languages.Network(5)
    x, keep = languages.as_rows([b"a", b"longer text than the others", b"bc", b"some words", b"xy z"])
    both = np.concatenate([net._run(d, x, keep, False)[0] for d in "fb"], axis=2)
    logit = both @ net.w["o"] + net.w["ob"]
    logp = logit - np.log(np.exp(logit).sum(axis=2, keepdims=True))
    want = (logp * keep[:, :, None]).sum(axis=0) / keep.sum(axis=0)[:, None]
    done, tanh = [], np.tanh
    monkeypatch.setattr(np, "tanh", lambda a, **kw: done.append(a.size) or tanh(a, **kw))
    got = net.forward(x, keep)
    assert got == pytest.approx(want, abs=1e-5) and got.dtype == np.float32
    assert sum(done) == 2 * 3 * net.h * keep.sum()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZbéé๎ก'’-. !?…。」\"1_ \t😀☀", max_size=40))
def test_patterns_of_sentences_as_plainly_written(text):
    cut = re.compile(r"[.!?…][\"”»’)\]]*\s+|[。！？।؟۔][」』”]*|(?<=[^\W\d_A-Z])[.!?](?=[A-ZÀ-Þ])|[\U0001f000-\U0001faff☀-➿️]\s+")
    assert [m.span() for m in languages._CUT.finditer(text)] == [m.span() for m in cut.finditer(text)]
    plain = "".join(c for c in text.lower() if c.isascii())
    assert languages._ASCII_WORD.findall(plain) == quality._WORD.findall(plain)
    assert plain.translate(languages._ASCII) == languages._MARKS.sub(" ", plain)
    if (s := f"{text.strip()}.".strip())[-1] == ".":
        whole, last = languages._LAST.search(s), languages._LAST.search(s.rsplit(None, 1)[-1])
        assert (whole and whole[1]) == (last and last[1])


def test_language_labels_in_other_notations():
    codes = {"en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de"}
    assert [languages.normal_code(x, codes) for x in ("EN", "en-US", "eng", " English ", "ger", "und", "", None)] == ["en", "en", "en", "en", "de", None, None, None]


def test_sentences_for_languages():
    got = [s for s, _ in languages.sentences_of("Dr. Vey went home.So it was. See https://a.example now\n%%%%@@@@****\n")]
    assert got[1:2] == ["so it was"] and not any("http" in s for s in got)
    assert languages.sentences_of("") == []


# toxicity

def test_disguises_are_undone():
    for raw in ("1d10t", "!d!ot", "idiooot", "IDIOT", "іdіоt"):
        assert toxicity.plain_word(raw) == "idiot"
    assert "idiot" in toxicity.tokens_of("you are an i d i o t now")
    assert toxicity.plain_word("2024") == "2024" and toxicity.plain_word("f**k") == "f**k"


def test_non_negative_gradient():
    z = np.array([0.3, -0.2, 0.5, -1.0, 0.1])
    pos, unl, neg = (np.array(m, bool) for m in ([1, 0, 0, 0, 0], [0, 1, 1, 0, 0], [0, 0, 0, 1, 1]))
    d = toxicity.non_negative_gradient(z, pos, unl, neg, 0.1)

    def risk(z):
        a, b = np.logaddexp(0, -z), np.logaddexp(0, z)
        return 0.1 * a[pos].mean() + 0.7 * (b[unl].mean() - 0.1 * b[pos].mean()) + 0.3 * 0.9 * b[neg].mean()

    for k in range(5):
        up, down = z.copy(), z.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert d[k] == pytest.approx((risk(up) - risk(down)) / 2e-5, abs=1e-6)


def test_toxicity_on_held_out_posts(spark):
    rng = np.random.default_rng(6)
    plain = ["The ferry left at noon with the mail.", "We cooked soup and talked for hours.", "The wallet shows no swap today.", "My guild won the raid again last night.", "I was a fool to leave the keys there."]
    bad = ["You are a worthless fool and everyone knows.", "Shut up you stupid worthless clown.", "Go away you pathetic stupid fool."]
    rows, labels, truth = [], [], {}
    for k in range(400):
        toxic = k % 4 == 0
        text = [str(x) for x in rng.choice(plain, 5)]
        if toxic:
            text.insert(int(rng.integers(0, 5)), str(rng.choice(bad)))
        rows.append((f"a{k}", "p", " ".join(text)))
        truth[f"a{k}"] = toxic
        if k < 160:
            labels.append((f"a{k}", "p", "abusive" if toxic else "none"))
    rows += [("n", "p", None), ("b", "p", " "), rows[0]]
    df = spark.createDataFrame(rows, "author string, permlink string, body_for_analysis string")
    lab = spark.createDataFrame(labels, "author string, permlink string, kind string")
    got = {r.author for r in toxicity.score_posts(df, lab).where("found and kind = 'abusive'").collect()}
    held = [k for k in truth if int(k[1:]) >= 160]
    assert sum((k in got) == truth[k] for k in held) >= 0.97 * len(held)
    assert not got & {"n", "b"}
    assert toxicity.score_posts(df, lab.limit(0)).where("found").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "author string, permlink string, body_for_analysis string, body_clean string, category string, dominant_lang string, created timestamp")
    codes = spark.createDataFrame([("en", "eng", "English")], "code string, code3 string, lang_name string")
    assert languages.find_languages(none, codes).count() == 0
    assert sentences.split_sentences(none).count() == 0
    assert lines.repeated_lines(none).count() == 0
    assert quality.outlier_scores(quality.statistics(none, codes)).count() == 0
    assert toxicity.score_posts(none, spark.createDataFrame([], "author string, permlink string, kind string")).count() == 0
