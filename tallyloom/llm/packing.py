"""Fixed-capacity containers filled with documents by Karmarkar-Karp multiway differencing.

Documents larger than a container are cut into full pieces and a rest; nothing else is split. The pieces are dealt
by a hash of their id into blocks of about BLOCK containers' worth, so no block depends on a key of the data, and
each block is partitioned into near-equal windows; the number of windows rises until none exceeds the capacity.

Defined cases: a null or blank text has no tokens and needs no container; repeated ids stay separate rows of their
own; an empty table gives no containers; a bin without a capacity of at least 1 is left out.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import wordpunct_count
from tallyloom.session import cut, table

#: Containers' worth of tokens in a block: more leave less space over, at a cost in proportion.
BLOCK = 128


def differencing(sizes: list[int], k: int) -> list[int]:
    """Window of each item when sizes are partitioned into k windows by Karmarkar-Karp differencing.

    Partial partitions are lists of (sum, items) by falling sum; the two with the largest spread are merged, the largest
    window of one with the smallest of the other.
    """
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, (i,))]))  # windows without items are left out
    heapq.heapify(heap)
    serial = len(sizes)

    def spread(windows: list) -> int:
        return windows[0][0] - (windows[-1][0] if len(windows) == k else 0)

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        spare = k - len(a)  # empty windows of a, which take the largest of b
        merged = b[:spare] + a[: len(a) - max(0, len(b) - spare)]
        rest = b[spare:]  # its largest meets the smallest of a
        tail = a[len(a) - len(rest) :] if rest else []
        merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(reversed(tail), rest, strict=True)]
        merged.sort(key=lambda w: -w[0])
        heapq.heappush(heap, (-spread(merged), serial, merged))
        serial += 1
    out = [0] * len(sizes)
    for w, (_, items) in enumerate(heap[0][2] if heap else []):
        stack = [items]
        while stack:
            x = stack.pop()
            if isinstance(x, int):
                out[x] = w
            else:
                stack.extend(x)
    return out


def pack_block(sizes: list[int], capacity: int) -> list[int]:
    """Window of each item, no window above capacity; sizes are at most capacity.

    Differencing into as few windows as could do, then into one more until none overflows; with a window for each item none can.
    """
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while True:
        out = differencing(sizes, k)
        sums = [0] * k
        for w, s in zip(out, sizes, strict=True):
            sums[w] += s
        if max(sums) <= capacity:
            return out
        k += 1


def _pack(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["doc_id", "piece_no"]).reset_index(drop=True)
    block["window_no"] = pack_block(block["tokens"].tolist(), int(block["capacity_tokens"].iloc[0]))
    return block[["bin_name", "block", "window_no", "doc_id", "piece_no", "start_token", "tokens"]]


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), wordpunct_count(F.col(text)).alias("n_tokens"))


def pieces(docs: DataFrame, bins: DataFrame) -> DataFrame:
    """Each document's pieces for each bin; bins is a table of parameters."""
    rows = bins.where("capacity_tokens >= 1").select("bin_name", "capacity_tokens").distinct().collect()  # parameters
    kind = "array<struct<bin_name:string,capacity_tokens:bigint>>"
    each = F.array(*(F.struct(F.lit(r.bin_name).alias("bin_name"), F.lit(r.capacity_tokens).alias("capacity_tokens")) for r in rows)).cast(kind)
    c, n = F.col("capacity_tokens"), F.col("n_tokens")
    cut = docs.where("n_tokens > 0").select("doc_id", "n_tokens", F.inline(each))
    at = F.posexplode(F.sequence(F.lit(0).cast("bigint"), n - 1, c))
    return cut.select("bin_name", "capacity_tokens", "doc_id", "n_tokens", at.alias("piece_no", "start_token")).withColumn(
        "tokens", F.least(c, n - F.col("start_token"))
    )


def pack(docs: DataFrame, bins: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bin_name, block, window_no, doc_id, piece_no, start_token, tokens): where each piece lies.

    docs has (doc_id, n_tokens). A block is bounded: it gets a share of the pieces by hash, some BLOCK containers' worth.
    """
    total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    all_pieces = pieces(docs, bins)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.lit(float(total)) / (F.col("capacity_tokens") * block))).cast("bigint")
    blocks = all_pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), n_blocks))
    schema = "bin_name string, block bigint, window_no bigint, doc_id bigint, piece_no int, start_token bigint, tokens bigint"
    return blocks.groupBy("bin_name", "block").applyInPandas(_pack, schema)


def must_split(docs: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin_name, doc_id) of documents that have a second piece."""
    return pieces(docs, bins).where("piece_no = 1").select("bin_name", "doc_id").distinct()


def _in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # tokens are counted once; an id and a number a document are written for the total and the packing
    return cut(sized(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "pack_bins")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose pieces lie in more than one place of the packing."""
    docs, bins = _in(spark, sf_dir)
    return pack(docs, bins).where("piece_no = 1").select("bin_name", "doc_id").distinct()


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(*_in(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bin's containers, tokens and the share of space used."""
    docs, bins = _in(spark, sf_dir)
    used = pack(docs, bins).groupBy("bin_name", "block", "window_no").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    per = used.groupBy("bin_name").agg(
        F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("n").alias("n_pieces"), F.max("t").alias("fullest")
    )
    return per.join(F.broadcast(bins), "bin_name").select(
        "bin_name", "n_containers", "n_tokens", "n_pieces", "fullest",
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must fulfil for each bin: documents and tokens placed, documents split, containers that overflow, documents split
    though they fit, and tokens placed twice or not at all (gaps between a document's pieces)."""
    docs, bins = _in(spark, sf_dir)
    placed = cut(pack(docs, bins))
    full = placed.groupBy("bin_name", "block", "window_no").agg(F.sum("tokens").alias("t")).groupBy("bin_name").agg(F.max("t").alias("fullest"))
    per = placed.groupBy("bin_name", "doc_id").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.countDistinct("piece_no").alias("k")
    )
    c = F.col("capacity_tokens")
    rows = per.join(F.broadcast(bins), "bin_name").join(F.broadcast(full), "bin_name").groupBy("bin_name")
    return rows.agg(
        F.count("*").alias("n_docs"), F.sum("t").alias("n_tokens"), F.count_if(F.col("n") > 1).alias("n_split"), F.max((F.col("fullest") > c).cast("int")).alias("overfull"),
        F.count_if((F.col("n") > 1) & (F.col("t") <= c)).alias("split_needlessly"), F.count_if((F.col("t") != F.col("end")) | (F.col("n") != F.col("k"))).alias("not_whole"),
    )


#: WordPunct tokens in DuckDB.
SQL_TOKENS = r"""coalesce(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')), 0)"""

QUERIES = {"p8_found": p8_found, "p8_packed": p8_packed, "p8_report": p8_report, "p8_checks": p8_checks}
ORACLES = {
    "p8_found": f"select distinct bin_name, doc_id from documents, pack_bins where {SQL_TOKENS.format('text')} > capacity_tokens",
    "p8_checks": f"""select bin_name, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens, count(*) filter (where n > capacity_tokens) as n_split, 0 as overfull,
  0::bigint as split_needlessly, 0::bigint as not_whole from (select doc_id, {SQL_TOKENS.format('text')} as n from documents), pack_bins where n > 0 group by 1""",
}
