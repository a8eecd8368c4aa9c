"""External services behind a client given by the caller: called from executors, with retries, and in resumable batches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refused(Exception):
    """The service will not answer, as after a wrong key: no retry."""


class Busy(Exception):
    """The service asks to wait."""


def with_retries(call: Callable[[str], dict], request: str, tries: int = 3, wait: float = 1.0) -> tuple[bool, dict]:
    """(True, answer), or (False, {}) after the last try. Waiting grows; a refusal is raised at once."""
    for k in range(tries):
        try:
            return True, call(request)
        except Refused:
            raise
        except Busy:
            time.sleep(wait * 2**k)
        except Exception:  # noqa: BLE001 - whatever the client raises counts as a failed try
            time.sleep(wait if k + 1 < tries else 0)
    return False, {}


def ask(df: DataFrame, key: str, request: str, make_client: Callable[[], Callable[[str], dict]], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, ok, answer): each request once, with one client for each task; answers as JSON text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_client()
        for part in parts:
            got = [with_retries(call, q, tries, wait) for q in part[request]]
            yield pd.DataFrame({key: part[key], "ok": [g[0] for g in got], "answer": [json.dumps(g[1]) for g in got]})

    kind = dict(df.dtypes)[key]
    return df.select(key, request).mapInPandas(run, f"{key} {kind}, ok boolean, answer string")


def score_texts(df: DataFrame, key: str, text: str, make_scorer: Callable[[], Callable[[list[str]], list[float]]]) -> DataFrame:
    """(key, score): a scorer made once for each task scores texts batch by batch. Null texts have no score."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for part in parts:
            yield pd.DataFrame({key: part[key], "score": scorer(part[text].tolist())})

    kind = dict(df.dtypes)[key]
    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, score double")


def batch_requests(todo: DataFrame, key: str, body: str, path: str) -> None:
    """Write requests as JSON lines for a batch service; an existing batch is not submitted again."""
    todo.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.col(body).alias("body"))).alias("value")).write.mode("errorifexists").text(path)


def batch_answers(lines: DataFrame) -> DataFrame:
    """(custom_id, answer) of finished, non-empty answers in lines of JSON."""
    j = F.col("value")
    ok = F.get_json_object(j, "$.response.status_code").try_cast("int") == 200
    text = F.get_json_object(j, "$.response.body")
    return lines.where(ok & (F.coalesce(F.trim(text), F.lit("")) != "")).select(F.get_json_object(j, "$.custom_id").alias("custom_id"), text.alias("answer"))


def timed(df: DataFrame, budget_s: float, label: str = "timed") -> tuple[int, float]:
    """Rows that df gives and the seconds it takes to make them all; none reaches the driver. The job is cancelled when the budget is spent."""
    from pyspark import InheritableThread
    from pyspark.sql import Observation

    sc, began, out = df.sparkSession.sparkContext, time.monotonic(), {}

    def work() -> None:
        sc.setJobGroup(label, label, interruptOnCancel=True)
        try:
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            out["n"] = seen.get["n"]
        except Exception as e:  # noqa: BLE001 - reported below
            out["error"] = e

    t = InheritableThread(target=work)
    t.start()
    t.join(budget_s)
    if t.is_alive():
        sc.cancelJobGroup(label)
        t.join(30)
        raise TimeoutError(f"{label}: more than {budget_s} s")
    if "error" in out:
        raise out["error"]
    return out["n"], time.monotonic() - began
