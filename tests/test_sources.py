import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import files, services
from tallyloom.streaming import weekly


def test_ratings_with_either_separator(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("﻿rater,post_id,human_label\nr,1,TRUE\n", encoding="utf8")
    b.write_text("rater;post_id;human_label\nr;2;FALSCH\n", encoding="utf8")
    assert files.read_ratings(spark, str(a)).first().human_label == "true"
    assert files.read_ratings(spark, str(b)).first().human_label == "false"


def test_arrays_and_lines(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"documents": [{"doc_id": "a"}], "claims": [{"doc_id": "a", "claim": "x"}, {"doc_id": "a", "claim": "y"}]}))
    got = files.read_arrays(spark, str(tmp_path / "d.json"))
    assert [r.claim for r in got["claims"].orderBy("position").collect()] == ["x", "y"]
    (tmp_path / "l.jsonl").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    assert sorted(r.k for r in files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "k int").collect()) == [1, 2]


def test_dictionary_and_lexicon(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Big Word, ab,big word\nother\n")
    assert [(r.phrase, r.kept) for r in files.read_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [("big word", True), ("other", True), ("ab", False)]
    (tmp_path / "x.csv").write_text("Word,Val_mean,aro\nA ,0.5,0.1\na,0.9,0.2\nb,x,0.1\n")
    got = files.read_lexicon(spark, str(tmp_path / "x.csv"), {"word": "word", "valence": "val", "arousal": "aro"}).collect()
    assert [tuple(r) for r in got] == [("a", 0.5, 0.1)]


def test_writers(spark, tmp_path):
    df = spark.range(25).select(F.col("id"), F.concat(F.lit("t\x01"), F.col("id").cast("string")).alias("t"))
    assert files.write_verified(df, str(tmp_path / "p"), ["id"]) == 25
    files.write_sheets(df, str(tmp_path / "s"), ["id"], rows=10)
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert {r.part: r["count"] for r in back.groupBy("part").count().collect()} == {0: 10, 1: 10, 2: 5}
    assert back.where("id = 3").first().t == "t3"


def test_resolve(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f.json").write_text("{}")
    assert files.resolve(["nowhere/f.json"], str(tmp_path)).endswith("f.json")
    (tmp_path / "f.json").write_text("{}")
    with pytest.raises(FileNotFoundError, match="several"):
        files.resolve(["nowhere/f.json"], str(tmp_path))


def test_services(spark, tmp_path):
    tries = []

    def call(q):
        tries.append(q)
        if len(tries) < 3:
            raise ValueError
        return {"q": q}

    assert services.with_retries(call, "x", wait=0) == (True, {"q": "x"})
    assert services.with_retries(lambda q: 1 / 0, "x", wait=0) == (False, {})
    with pytest.raises(services.Refused):
        services.with_retries(lambda q: (_ for _ in ()).throw(services.Refused()), "x")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, q string")
    got = services.ask(df, "k", "q", lambda: lambda q: {"echo": q}).collect()
    assert {r.k: json.loads(r.answer)["echo"] for r in got} == {1: "a", 2: "b"}
    assert sorted(r.score for r in services.score_texts(df, "k", "q", lambda: lambda ts: [float(len(t)) for t in ts]).collect()) == [1.0, 1.0]
    services.batch_requests(df, "k", "q", str(tmp_path / "b"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        services.batch_requests(df, "k", "q", str(tmp_path / "b"))
    lines = spark.createDataFrame([('{"custom_id": "1", "response": {"status_code": 200, "body": "x"}}',), ('{"custom_id": "2", "response": {"status_code": 500, "body": "x"}}',), ("no",)], "value string")
    assert [tuple(r) for r in services.batch_answers(lines).collect()] == [("1", "x")]


def test_append_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(str(src))
    for n in (1, 2):  # the second run reads all again
        stream = spark.readStream.schema("k int, v string").parquet(str(src))
        weekly.append_once(stream, ["k"], out, str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b")]


def test_remote_ranges_and_keys(spark, monkeypatch):
    import datetime as dt

    from tallyloom.sources import remote

    got = remote.week_ranges(dt.date(2024, 9, 1), dt.date(2024, 9, 17))
    assert got[0][0] == "week01_2024-09-01_2024-09-08" and got[-1][2] == dt.date(2024, 9, 17) and len(got) == 3
    assert remote.week_predicates("created", dt.date(2024, 9, 1), dt.date(2024, 9, 2), "depth = 0") == ["created >= '2024-09-01' AND created < '2024-09-02' AND depth = 0"]
    monkeypatch.delenv("TALLYLOOM_DB_USER", raising=False)
    with pytest.raises(OSError, match="TALLYLOOM_DB_USER"):
        remote.read_remote(spark, "jdbc:x", "t", [])
    keys = remote.valid_accounts(spark.createDataFrame([(" Abc ",), ("a b",), (None,), ("x",)], "author string"), "author")
    assert [r.author for r in keys.collect()] == ["abc"]


def test_prompts(spark):
    from tallyloom.functions import prompts as M

    df = spark.createDataFrame([("t", "b"), (None, "c")], "title string, body string")
    rows = [json.loads(r.m) for r in df.select(M.classification_request(F.col("title"), F.col("body"), ["x"]).alias("m")).collect()]
    assert rows[0][1]["content"] == "Title:\nt\n\nText:\nb" and rows[1][1]["content"] == "Text:\nc"
    df = spark.createDataFrame([('"q x"', "T"), (" ", "T"), (None, "T")], "r string, t string")
    assert [r.q for r in df.select(M.search_query(F.col("r"), F.col("t")).alias("q")).collect()] == ["q x", "T", "T"]
    one = spark.createDataFrame([("hello there. how are you? ok",)], "x string")
    assert one.select(M.recapitalize(F.col("x")).alias("y")).first().y == "Hello there. How are you? Ok"


def test_a_failed_write_leaves_the_file_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert files.write_verified(spark.range(5), path) == 5
    with pytest.raises(OSError, match="missing"):
        files.write_verified(spark.range(9), path, ["gone"])
    with pytest.raises(Exception, match="stop"):
        files.write_verified(spark.range(9).select(F.raise_error(F.lit("stop")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    assert files.write_verified(spark.range(7), path, ["id"]) == 7 and spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_files_shards_and_memos(spark, tmp_path):
    for k in (2, 1):
        spark.range(k).withColumn(f"c{k}", F.lit(k)).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    got = files.read_sorted_files(spark, str(tmp_path / "part*"))
    assert {(r.file_no, r.c1, r.c2) for r in got.collect()} == {(1, 1, None), (2, None, 2)}
    with pytest.raises(FileNotFoundError):
        files.read_sorted_files(spark, str(tmp_path / "none*"))
    out, df = str(tmp_path / "shards"), spark.range(40)
    assert len(files.write_shards(df, "id", out, 4, lambda x: x, stop_after=3)) == 3
    assert len(files.write_shards(df, "id", out, 4, lambda x: x)) == 1 and files.write_shards(df, "id", out, 4, lambda x: x) == []
    assert spark.read.parquet(out).select("id").distinct().count() == 40
    made: list = []
    make = lambda: made.append(1) or spark.range(3)
    assert [files.memo(spark, str(tmp_path), "step", make).count() for _ in range(2)] == [3, 3] and made == [1]


def test_json_table_and_text_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\x01b", "c\x02"), (2, None, "d")], "k int, s string, t string")
    files.write_json(files.strip_text_columns(df), str(tmp_path / "j"))
    rows = sorted(x for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines())
    assert [json.loads(x) for x in rows] == [{"k": 1, "s": "ab", "t": "c"}, {"k": 2, "s": None, "t": "d"}]
    files.write_table(df.select("k"), "tallyloom_test_table")
    try:
        assert spark.table("tallyloom_test_table").count() == 2
    finally:
        spark.sql("drop table tallyloom_test_table")
