"""The chain from posts to labels: claims are selected, searched for, judged and rolled up, each step with a client of its own.

Clients are made on the executors. Every finished step is kept in a folder and read again after a stop; failures of a step are kept as such
and count as unverified, so a later run can try them alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import prompts as M
from tallyloom.functions import replies as R
from tallyloom.functions import spans as P
from tallyloom.plans import claims as CL
from tallyloom.plans.registry import query
from tallyloom.session import table
from tallyloom.sources import files, services

Client = Callable[[], Callable[[str], dict]]
CLAIMS = "array<struct<claim:string,claim_normalized:string,query:string>>"


def select_claims(posts: DataFrame, client: Client, tries: int = 3) -> DataFrame:
    """(doc_id, claim_idx, claim, claim_normalized, query) from posts (doc_id, text): at most three usable claims of a reply, in its order."""
    asked = services.ask(posts.select("doc_id", F.coalesce("text", F.lit("")).alias("q")), "doc_id", "q", client, tries, 0.0)
    reply = R.reply_object(F.get_json_object("answer", "$.text"))
    listed = R.claim_list(F.from_json(F.get_json_object(reply, "$.claims"), CLAIMS))
    rows = asked.where("ok").select("doc_id", F.posexplode(listed).alias("k", "c"))
    return rows.select("doc_id", (F.col("k") + 1).alias("claim_idx"), "c.*")


def search_claims(claims: DataFrame, client: Client, tries: int = 3) -> DataFrame:
    """claims with evidence, the formatted answer to each claim's query; each different query is asked once, failures have blank evidence."""
    asked = services.ask(claims.select(F.col("query")).distinct().withColumn("q", F.col("query")), "query", "q", client, tries, 0.0)
    return claims.join(asked.select("query", R.search_text(F.col("answer")).alias("evidence")), "query", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))


def judge_claims(found: DataFrame, posts: DataFrame, client: Client, tries: int = 3, radius: int = 1200) -> DataFrame:
    """found with verdict and stance, asked for with the evidence and the text around each claim; failures are unverified."""
    rows = found.join(posts.select("doc_id", "text"), "doc_id").withColumn("context", P.context_window(F.col("text"), F.col("claim")))
    rows = rows.withColumn("id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("claim_idx").cast("string")))
    rows = rows.withColumn("q", M.verdict_request(F.col("claim_normalized"), F.col("evidence"), F.col("context")))
    asked = services.ask(rows.select("id", "q"), "id", "q", client, tries, 0.0)
    reply = R.reply_object(F.get_json_object("answer", "$.text"))
    judged = asked.select("id", R.verdict6(F.get_json_object(reply, "$.verdict")).alias("verdict"), R.stance(F.get_json_object(reply, "$.stance")).alias("stance"))
    return rows.drop("q", "text", "context").join(judged, "id").drop("id")


def fact_check(posts: DataFrame, clients: dict[str, Client], folder: str | None = None) -> DataFrame:
    """(doc_id, n_claims, final_label, ordinal) of every post; clients are those to select, search and judge.

    With a folder, each step is written there and not done again.
    """
    spark = posts.sparkSession
    step = (lambda name, make: files.memo(spark, folder, name, make)) if folder else (lambda name, make: make())
    selected = step("selected", lambda: select_claims(posts, clients["select"]))
    searched = step("searched", lambda: search_claims(selected, clients["search"]))
    judged = step("judged", lambda: judge_claims(searched, posts, clients["judge"]))
    labels = CL.rollup_six(judged).join(judged.groupBy("doc_id").agg(F.count("*").alias("n_claims")), "doc_id")
    all_posts = posts.select("doc_id").distinct().join(labels, "doc_id", "left")
    return all_posts.select("doc_id", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("final_label", F.lit("no_checkworthy_claim")).alias("final_label"), "ordinal")


def rule_clients() -> dict[str, Client]:
    """Stand-ins for the three services: claims are lines with a number, the search finds the query itself, the claim's length chooses the verdict."""

    def selecting():
        def call(text: str) -> dict:
            lines = [x.strip(" ") for x in text.split("\n") if re.search(r"[0-9]", x) and len(x.strip(" ")) >= 15]
            return {"text": "```json\n" + json.dumps({"claims": [{"claim": x, "claim_normalized": "", "query": f"len {len(x)}"} for x in lines]}) + "\n```"}

        return call

    def searching():
        return lambda q: {"organic": [{"title": q, "snippet": "found", "date": None}]}

    def judging():
        def call(request: str) -> dict:
            n = int(re.search(r"len ([0-9]+)", json.loads(request)[1]["content"]).group(1))
            return {"text": f"Here: {json.dumps({'verdict': CL.VERDICT_OF[n % 6].replace('_', ' '), 'stance': CL.STANCE_OF[n % 3]})}"}

        return call

    return {"select": selecting, "search": searching, "judge": judging}


_RULE = (
    "(with l as (select doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) as s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents),"
    " c as (select doc_id, s, row_number() over (partition by doc_id order by k) as n from l where regexp_matches(s, '[0-9]') and length(s) >= 15),"
    f" j as (select doc_id, case length(s) % 6 {' '.join(f'when {k} then {chr(39)}{v}{chr(39)}' for k, v in enumerate(CL.VERDICT_OF))} end as verdict,"
    f" case length(s) % 3 {' '.join(f'when {k} then {chr(39)}{v}{chr(39)}' for k, v in enumerate(CL.STANCE_OF))} end as stance from c where n <= 3),"
    f" r as (select doc_id, count(*) as n_claims, min(case when {CL._COUNT} then {CL._ORD} end) as ordinal from j group by 1)"
    " select d.doc_id, coalesce(n_claims, 0) as n_claims, case when n_claims is null then 'no_checkworthy_claim' else coalesce(case ordinal "
    + " ".join(f"when {k} then '{v}'" for k, v in enumerate(CL.VERDICT_OF[:5]))
    + " end, 'unverified') end as final_label, ordinal from (select distinct doc_id from documents) d left join r using (doc_id))"
)


@query("fact_check", f"select * from {_RULE}")
def fact_check_query(spark, d):
    """The whole chain with stand-in services."""
    return fact_check(table(spark, d, "documents").select("doc_id", "text"), rule_clients())
