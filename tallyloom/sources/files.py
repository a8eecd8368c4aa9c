"""Readers and writers of the formats that posts, labels and replies come in."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scalars import strip_controls


def resolve(candidates: list[str], root: str | None = None) -> str:
    """The first candidate that exists, else the only file of that name below root; several are an error."""
    for c in candidates:
        if Path(c).exists():
            return c
    hits = sorted({str(p) for c in candidates for p in Path(root).rglob(Path(c).name)}) if root else []
    if len(hits) == 1:
        return hits[0]
    raise FileNotFoundError(f"{'several files' if hits else 'no file'} for {candidates}: {hits[:5]}")


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header, every column as text and blanks for nulls."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"').na.fill("")


def sniff_separator(line: str) -> str:
    return max(",;\t", key=line.count)


# Words for true and false as exported under two locales.
TRUE_WORDS, FALSE_WORDS = ("true", "wahr", "yes", "1"), ("false", "falsch", "no", "0")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """A rater's export with an unknown separator and perhaps a byte order mark; labels in capitals become words."""
    head = spark.read.text(path).limit(1).first()
    sep = sniff_separator(head[0]) if head else ","
    df = read_strings(spark, path, sep)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    if "human_label" in df.columns:
        t = F.lower(F.trim("human_label"))
        df = df.withColumn("human_label", F.when(t.isin(*TRUE_WORDS), "true").when(t.isin(*FALSE_WORDS), "false").otherwise(t))
    if "is_checkable_claim" in df.columns:
        t = F.lower(F.trim("is_checkable_claim"))
        df = df.withColumn("is_checkable_claim", F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False))
    return df


def read_arrays(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON document of arrays as one DataFrame for each; arrays of rows keep their position."""
    doc = spark.read.option("multiLine", True).json(path)
    out = {}
    for f in doc.schema.fields:
        if f.dataType.typeName() == "array" and getattr(f.dataType, "elementType", None) is not None and f.dataType.elementType.typeName() == "struct":
            out[f.name] = doc.select(F.posexplode(f.name).alias("position", "__r")).select("position", "__r.*")
    return out


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_dictionary(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """Phrases (phrase, kept) of lines separated by commas, normalised, each once; shorter ones are marked as dropped."""
    words = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("w"))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("w"), r"[^a-z0-9@ ]+", " "), r" +", " "))
    phrases = words.select(norm.alias("phrase")).where("phrase <> ''").distinct()
    return phrases.withColumn("kept", F.length("phrase") >= least).orderBy(F.desc(F.length("phrase")), "phrase")


def read_lexicon(spark: SparkSession, path: str, prefixes: dict[str, str]) -> DataFrame:
    """A lexicon whose columns are known by the beginnings of their names; words lower-cased, the first row of each kept."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    found = {}
    for name, prefix in prefixes.items():
        hits = [c for c in df.columns if c.strip().lower().startswith(prefix)]
        if not hits:
            raise ValueError(f"no column begins with {prefix}: {df.columns}")
        found[name] = hits[0]
    word, *scores = found
    rows = df.select(
        F.lower(F.trim(F.col(found[word]))).alias(word), *(F.col(found[s]).try_cast("double").alias(s) for s in scores), F.monotonically_increasing_id().alias("__n")
    ).na.drop()
    return rows.groupBy(word).agg(*(F.min_by(s, "__n").alias(s) for s in scores))


def _folder(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration, local or shared alike."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_verified(df: DataFrame, path: str, required: list[str] = ()) -> int:
    """Write df as Parquet beside path, read it again (the rows and required columns must be there), then put it in place of path.

    Until then path keeps what it held; a failed or wrong write leaves it alone and takes its own files away. Returns the rows.
    """
    import uuid

    from pyspark.sql import Observation

    spark, new, old = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    fs, target = _folder(spark, path)
    _, fresh = _folder(spark, new)
    _, aside = _folder(spark, old)
    try:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(new)
        back = spark.read.parquet(new)
        missing = [c for c in required if c not in back.columns]
        n = back.count()
        if missing or n != seen.get["n"]:
            raise OSError(f"{path}: {n} rows of {seen.get['n']}, missing columns {missing}")
        had = fs.exists(target)
        if had and not fs.rename(target, aside):
            raise OSError(f"{path}: cannot be moved aside")
        if not fs.rename(fresh, target):
            if had:
                fs.rename(aside, target)
            raise OSError(f"{new}: cannot be renamed to {path}")
        if had:
            fs.delete(aside, True)
        return n
    finally:
        if fs.exists(fresh):
            fs.delete(fresh, True)


def read_sorted_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Parquet files that match pattern, in order of their paths (file_no from 1), with columns of one file alone null in others."""
    df = spark.read.option("mergeSchema", True).parquet(*sorted(_matches(spark, pattern)))
    files = sorted({r[0] for r in df.select(F.input_file_name()).distinct().collect()})  # one row for each file
    number = F.array_position(F.array(*map(F.lit, files)), F.input_file_name()).cast("int") if files else F.lit(None).cast("int")
    return df.withColumn("file_no", number)


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _folder(spark, pattern)
    found = [x.getPath().toString() for x in fs.globStatus(p) or []]
    if not found:
        raise FileNotFoundError(pattern)
    return found


def write_shards(df: DataFrame, key: str, path: str, n: int, work, stop_after: int | None = None) -> list[int]:
    """Rows of df worked on in n shards by a hash of key, each appended to path under shard=k; shards that are there are not done again.

    work maps the rows of a shard to its result. A shard counts as done by its _SUCCESS file, which Spark writes last. Returns the shards done now.
    """
    spark, now = df.sparkSession, []
    for k in range(n):
        fs, done = _folder(spark, f"{path}/shard={k}/_SUCCESS")
        if fs.exists(done):
            continue
        if stop_after is not None and len(now) >= stop_after:
            break
        part = df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)
        work(part).write.mode("overwrite").parquet(f"{path}/shard={k}")
        now.append(k)
    return now


def memo(spark: SparkSession, folder: str, name: str, make) -> DataFrame:
    """The step called name, read from folder if it was finished there, else made and written first."""
    path = f"{folder}/{name}.parquet"
    fs, done = _folder(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, name: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    """df as a table of the session's catalogue."""
    df.write.mode(mode).partitionBy(*partition_by).format("parquet").saveAsTable(name)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """df as JSON lines, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def strip_text_columns(df: DataFrame) -> DataFrame:
    """df with control characters taken out of every text column."""
    return df.withColumns({f.name: strip_controls(F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() == "string"})


def write_sheets(df: DataFrame, path: str, order: list[str], rows: int = 1_000_000, cell: int = 32_000) -> None:
    """CSV parts of at most rows rows in the given order, with cells cut and control characters taken out."""
    from tallyloom.operators.ranges import running_sums

    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    clean = df.withColumns({c: F.substring(strip_controls(F.col(c)), 1, cell) for c in text}).withColumns({"__g": F.lit(0), "__one": F.lit(1)})
    numbered = running_sums(clean, ["__g"], order, {"__one": "__rn"})
    part = F.floor((F.col("__rn") - 1) / rows).alias("part")
    numbered.select(part, *df.columns).write.mode("overwrite").partitionBy("part").option("header", True).option("escape", '"').csv(path)


def text_block(title: str, fields: list[str], body: str):
    """A report block of a row: a title line, its fields and its text, as one column."""
    head = F.concat(F.lit("=== "), F.coalesce(F.col(title).cast("string"), F.lit("")), F.lit(" ==="))
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    return F.concat_ws("\n", head, *lines, F.coalesce(F.col(body), F.lit("")))


def tabled_range(spark: SparkSession, path: str, column: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """Columns of the rows with column in [start, end): both reach the Parquet scan."""
    c = F.col(column)
    return spark.read.parquet(path).where((c >= F.lit(start).cast("timestamp")) & (c < F.lit(end).cast("timestamp"))).select(*columns)
