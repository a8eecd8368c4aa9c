"""The fact-check chain: order and shape of claims, failures, resumed steps."""

import json

from tallyloom.plans import factcheck as FC


def docs(spark):
    rows = [(1, "First line with 12 things.\nSecond one has 3 more.\nThird has 4 of them.\nFourth 5 is too many."), (2, "no numbers here at all"), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_three_claims_in_order_and_posts_without_any(spark):
    claims = FC.select_claims(docs(spark), FC.rule_clients()["select"]).orderBy("claim_idx").collect()
    assert [(r.doc_id, r.claim_idx, r.claim) for r in claims] == [(1, 1, "First line with 12 things."), (1, 2, "Second one has 3 more."), (1, 3, "Third has 4 of them.")]
    assert all(r.claim_normalized == r.claim for r in claims)
    got = {r.doc_id: (r.n_claims, r.final_label) for r in FC.fact_check(docs(spark), FC.rule_clients()).collect()}
    assert got[1][0] == 3 and got[2] == got[3] == (0, "no_checkworthy_claim")
    assert FC.fact_check(docs(spark).limit(0), FC.rule_clients()).count() == 0


def test_failures_are_unverified(spark):
    def broken():
        def call(request):
            raise TimeoutError(request)

        return call

    got = {r.doc_id: (r.n_claims, r.final_label, r.ordinal) for r in FC.fact_check(docs(spark), FC.rule_clients() | {"judge": broken}).collect()}
    assert got[1] == (3, "unverified", None)
    found = FC.search_claims(FC.select_claims(docs(spark), FC.rule_clients()["select"]), broken)
    assert {r.evidence for r in found.collect()} == {""}


def test_finished_steps_are_not_done_again(spark, tmp_path):
    log = str(tmp_path / "calls")

    def counted(make, name):
        def outer():
            call = make()

            def inner(q):
                with open(log, "a", encoding="utf8") as f:
                    f.write(json.dumps([name, q]) + "\n")
                return call(q)

            return inner

        return outer

    clients = {k: counted(v, k) for k, v in FC.rule_clients().items()}
    first = sorted(map(tuple, FC.fact_check(docs(spark), clients, str(tmp_path / "steps")).collect()))
    calls = open(log, encoding="utf8").read().splitlines()
    assert sorted(map(tuple, FC.fact_check(docs(spark), clients, str(tmp_path / "steps")).collect())) == first
    assert open(log, encoding="utf8").read().splitlines() == calls
    assert sum(json.loads(x)[0] == "judge" for x in calls) == 3
