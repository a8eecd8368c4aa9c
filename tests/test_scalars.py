import pytest
from pyspark.sql import functions as F

from tallyloom.functions import cleaning as C
from tallyloom.functions import replies as R
from tallyloom.functions import scalars as S
from tallyloom.functions import spans as P
from tallyloom.functions.text import strip, wordpunct_count


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("1.23 HBD", 1.23), ("x", 0.0), (None, 0.0), ("", 0.0), ("  7 a b", 7.0)])
def test_money(spark, raw, want):
    assert one(spark, raw, S.parse_money) == want


@pytest.mark.parametrize("raw,want", [("1,234.5 HBD", 1234.5), ("-3 x", -3.0), ("abc", None), (None, None), ("8", 8.0)])
def test_to_num(spark, raw, want):
    assert one(spark, raw, S.to_num) == want


@pytest.mark.parametrize("raw,want", [("true", 1.0), ("Yes", 1.0), ("2", 1.0), ("n", 0.0), ("0", 0.0), ("maybe", None), (None, None)])
def test_to01(spark, raw, want):
    assert one(spark, raw, S.to01) == want


def test_blank_text_gives_way(spark):
    df = spark.createDataFrame([(" ", "b"), (None, "b"), (" a ", "b")], "a string, b string")
    assert [r.y for r in df.select(S.coalesce_text(F.col("a"), F.col("b")).alias("y")).collect()] == ["b", "b", " a "]


@pytest.mark.parametrize("raw,want", [("{\"tags\": [1, 2]}", 2), ("[1]", 0), ("{\"tags\": 5}", 0), ("broken", 0), (None, 0), ("{}", 0)])
def test_json_lengths(spark, raw, want):
    assert one(spark, raw, lambda c: S.json_list_length(c, "$.tags")) == want


def test_json_author_both_forms(spark):
    assert one(spark, '{"author": "a"}', S.json_author) == "a"
    assert one(spark, '["reblog", {"author": "a"}]', S.json_author) == "a"


def test_dominant_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 2.0), (None, None)], "a double, b double")
    assert [r.y for r in df.select(S.dominant(["a", "b"]).alias("y")).collect()] == ["a", "b", None]


@pytest.mark.parametrize("gold,pred,want", [("misinfo", "misinfo", "TP"), ("misinfo", "ok", "FN"), ("ok", "misinfo", "FP"), ("ok", "ok", "TN"), ("ok", "abstain", "ABSTAIN")])
def test_outcome(spark, gold, pred, want):
    assert spark.createDataFrame([(gold, pred)], "g string, p string").select(S.outcome(F.col("g"), F.col("p"))).first()[0] == want


def test_clean_body(spark):
    raw = "# Head\n<b>bold</b> ![i](u) [text](http://x)\n\n\n\n**strong** end "
    assert one(spark, raw, C.clean_body) == "Head\nbold  text\n\nstrong end"
    assert one(spark, "snake_case_name and _emphasis_ stay", C.clean_body) == "snake_case_name and _emphasis_ stay"
    assert one(spark, None, C.clean_body) == ""


def test_clean_post_steps(spark):
    assert one(spark, "> quote\n- item\n1. num\n| a | b |\n---\ntext `code` ~~gone~~ #one #two", C.clean_post) == "quote\nitem\nnum\n\ntext gone"
    assert one(spark, "", C.clean_post) == ""
    assert one(spark, None, C.clean_post) == ""


def test_code_blocks(spark):
    fence = "```"
    long = "x" * 120
    assert one(spark, f"a {fence}python\nprint(1)\n{fence} b", C.code_blocks) == "a   b"
    assert one(spark, f"a {fence}short{fence} b", C.code_blocks) == "a   b"
    assert long in one(spark, f"a {fence}\n{long}\n{fence} b", C.code_blocks)


def test_footer_is_cut_only_late_and_in_long_texts(spark):
    body = "word " * 60
    assert one(spark, body + "Thanks for reading, all.", C.trim_footer) == body.rstrip()
    assert one(spark, "Thanks for reading. short", C.trim_footer) == "Thanks for reading. short"
    early = "Thanks for reading. " + body
    assert one(spark, early, C.trim_footer) == early


def test_merged_sentences(spark):
    assert one(spark, "Dr. Smith arrived late today. He then left the building.", C.merged_sentences) == ["Dr. Smith arrived late today.", "He then left the building."]
    assert one(spark, "No. Yes.", C.merged_sentences) == []


def test_sentences_keep_first_characters(spark):
    assert one(spark, "Fig. 3 shows. 1 more! 2", C.sentences) == ["Fig.", "3 shows.", "1 more!", "2"]


@pytest.mark.parametrize("s,want", [("Follow me:", True), ("See www.example.com for all the details", True), ("An ordinary sentence of eight words stands here", False)])
def test_boilerplate(spark, s, want):
    assert one(spark, s, C.is_boilerplate) is want


def test_replies(spark):
    assert one(spark, "```json\n{\"a\": 1}\n```", lambda c: F.get_json_object(R.reply_object(c), "$.a")) == "1"
    assert one(spark, "none here", R.reply_object) is None
    assert one(spark, " Mostly-False ", R.verdict6) == "mostly_false"
    assert one(spark, None, R.stance) == "unclear"


def test_claim_list(spark):
    rows = [([(" a ", None, "q"), ("", "x", "q"), ("b", " n ", "q"), ("c", "c", " "), ("d", "d", "q"), ("e", "e", "q")],)]
    df = spark.createDataFrame(rows, "x array<struct<claim:string,claim_normalized:string,query:string>>")
    got = df.select(R.claim_list(F.col("x")).alias("y")).first().y
    assert [(r.claim, r.claim_normalized) for r in got] == [("a", "a"), ("b", "n"), ("d", "d")]


def test_spans():
    text = "He said “Hello   World” to all of us yesterday evening."
    assert text[slice(*P.find_span(text, 'said "hello world" to'))] == "said “Hello   World” to"
    assert P.find_span(text, "nothing like that in here at all") is None
    assert P.window("a" * 50, "zzz", 10) == "a" * 20
    assert P.marked_html("a<b c", [(0, 3), (2, 3)]) == "<mark>a&lt;b</mark> c"


def test_merge_spans(spark):
    df = spark.createDataFrame([([(5, 8), (1, 3), (3, 4), (20, 21), (6, 7)],), ([],)], "x array<struct<start:int,end:int>>")
    got = [[tuple(s) for s in r.y] for r in df.select(P.merge_spans(F.col("x")).alias("y")).collect()]
    assert got == [[(1, 4), (5, 8), (20, 21)], []]


def test_strip_and_tokens(spark):
    assert one(spark, "  a \n", strip) == "a"
    import re

    for t in ("Hello, world!! it's 3.5", "दुनिया", "a_b c", "", None, "😀😀 x²"):
        want = len(re.findall(r"\w+|[^\w\s]+", t)) if t else 0
        assert one(spark, t, wordpunct_count) == want


FOOTER_CASES = [
    "Thanks so much for stopping by!", "thank you for taking the time", "Have a blessed weekend, all", "see you in the next post", "until tomorrow",
    "Dont forget to reblog", "If you enjoyed this post, vote", "Translated using Google  Translate", "For the best experience view this post on the site",
]


@pytest.mark.parametrize("footer", FOOTER_CASES)
def test_each_family_of_footers(spark, footer):
    body = "The ferry left at noon with the mail. " * 12
    assert one(spark, body + "\n\n" + footer + " more words", C.clean_post) == body.strip().rstrip(".")
    assert footer.split()[0] in one(spark, footer + " " + body, C.clean_post)  # at the start it is no footer
    assert one(spark, "Short. " + footer, C.clean_post) == "Short. " + " ".join(footer.split(" ")).replace("  ", " ")


@pytest.mark.parametrize("kept", ["follow me on my page", "all rights reserved", "original content by me"])
def test_other_closings_stay(spark, kept):
    body = "The ferry left at noon with the mail. " * 12
    assert one(spark, body + kept, C.clean_post).endswith(kept)


def test_code_blocks_are_paired_in_one_pass(spark):
    long = "some prose in a fence " * 6
    assert one(spark, "a ```python\nx = 1\n``` b ```x``` c", C.clean_post) == "a b c"
    assert one(spark, f"a ```\n{long}``` b", C.clean_post) == f"a {long}b"
    assert one(spark, f"a ```c++\n{long}``` b ```cx\n{long}``` c", C.clean_post) == f"a b {long}c"
    assert one(spark, "no ``` end", C.clean_post) == "no ``` end"


def test_clean_post_marks(spark):
    assert one(spark, "  #  Title\n- a\n12. b\n3) c\n* d\n> e", C.clean_post) == "Title\na\nb\n3) c\nd\ne"
    assert one(spark, "x\n|---|---|\n| 1 | 2 |\n* * *\ny", C.clean_post) == "x\n\ny"
    assert one(spark, "*i* **b** __u__ _e_ snake_case_name a_b", C.clean_post) == "i b u e snake_case_name a_b"
    assert one(spark, "hi @abc @defg, @hij; @klm and $HIVE $hive " + "Q" * 25, C.clean_post) == "hi $hive"  # a list takes the word after it along
    assert one(spark, "see[^1] it\n[^1]: note here\nPosted via an app\nend #a #b", C.clean_post) == "see it\n\nend"


def test_very_long_texts_are_cleaned(spark):
    raw = "@abcd, " * 20_000 + "#a " * 20_000 + "- " * 20_000 + "\n" + "* " * 20_000 + "end"
    for f in (C.clean_post, C.clean_body, C.plain_post, C.language_text, C.transcript_text):
        assert one(spark, raw, f).endswith("end")


def test_transcripts_and_plain_posts(spark):
    raw = "[music] HOST NAME: hello (laughs) >> at 1:02:30 go go go go on -- #x thanks for watching. Please ring the bell, and check out our new thing today. End"
    assert one(spark, raw, C.transcript_text) == "hello at go go on . , and . End"
    assert one(spark, "`c` ![i](u) [t](u) <b>x</b> # h_ *k* https://a.b/c", C.plain_post) == "t x h k"
    assert one(spark, "The [x] (y) HA ha ha end \u00e9 b a i >> -- don't www.x.y #tag", C.lexicon_text) == "the end a i dont"
    assert one(spark, "word b", lambda c: C.lexicon_text(c, F.upper)) == "WORD"


def test_sentences_merged_over_abbreviations(spark):
    got = one(spark, "Dr. Vey came at 5 p.m. and left early. Short. He stayed (e.g. for tea) the whole day!", C.merged_sentences)
    assert got == ["Dr. Vey came at 5 p.m. and left early.", "He stayed (e.g. for tea) the whole day!"]
    assert one(spark, None, C.merged_sentences) == [] and one(spark, "It ends with approx.", C.merged_sentences) == ["It ends with approx."]
    assert len(one(spark, "This is sentence one. " * 20_000, C.merged_sentences)) == 20_000


@pytest.mark.parametrize("s,flag", [("one two", True), ("we went to the river", False), ("- we went to the river", True), ("\u2605 we went there", True), ("*we went there then", False), ("#tag we went there", True), ("see www.a.example for more of it", True), ("In short, what we did:", True), ("a1 b2 c3 4444444 555555", True), ("w e   w e n t", False)])
def test_boilerplate_rules(spark, s, flag):
    assert one(spark, s, C.is_boilerplate) is flag


def test_recapitalize(spark):
    from tallyloom.functions.prompts import recapitalize

    assert one(spark, "  hello there. yes!  no? \u00e9t\u00e9. ok", recapitalize) == "Hello there. Yes!  No? \u00e9t\u00e9. Ok"


def test_language_profile(spark):
    from tallyloom.operators.language import detector_function, language_profile

    en, es = "This is a sentence of ours.", "Esta es una frase de ellos."
    rows = [(1, f"{en} " * 9 + es), (2, f"{en} {es}"), (3, "short one"), (4, "  "), (5, None), (6, f"{en} {en} bad sentence without an answer.")]
    df = spark.createDataFrame(rows, "id int, t string")

    def make():
        def detect(s):
            if s.startswith("bad"):
                raise ValueError(s)
            return "es" if "una" in s else "en"
        return detect

    got = {r.id: (r.lang_status, r.dominant_lang, round(r.pct_english, 3)) for r in language_profile(df, "t", detector_function(make)).collect()}
    assert got == {1: ("kept", "en", 0.9), 2: ("dropped_low_english", "en", 0.5), 3: ("too_short", "", 0.0), 4: ("empty", "", 0.0), 5: ("empty", "", 0.0), 6: ("kept", "en", 1.0)}
