"""Behaviour of rankers and gate on the adversarial set and on single statements."""

import re

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import lexicon as L
from tessera.operators import gate as G
from tessera.operators import metrics as M
from tessera.operators import rankers as R
from tessera.plans.cases import CATEGORIES, adversarial_cases, conversation_cases

SCHEMA = "case_id string, pos long, memory_id string, text string, ts string, query string"


def one_case(spark, query, *memories):
    return spark.createDataFrame([("c", k, f"m{k}", m if isinstance(m, str) else m[0], f"2026-07-{1 if isinstance(m, str) else m[1]:02d}T12:00:00+00:00", query) for k, m in enumerate(memories)], SCHEMA)


def verdict(spark, query, *memories):
    c = one_case(spark, query, *memories)
    ranked = c.select("case_id", F.lit(1).alias("rank"), "memory_id", F.lit(0.0).alias("score"))
    return G.verdicts(c, ranked).first()["verdict"]


@pytest.mark.parametrize("text, role", [("The code is on the agenda.", "AGENDA"), ("What is the code for X-1?", "QUESTION"), ("Review of the code for X-1.", "REVIEW"), ("There is no recorded value for the code.", "NO_VALUE"), ("We discussed the code.", "META"), ("The code for X-1 is not Q.", "NEGATIVE"), ("The code is probably Q.", "UNRESOLVED")])
def test_roles(spark, text, role):
    assert G.evidence(one_case(spark, "What is the code for X-1?", text)).first()["role"] == role


@pytest.mark.parametrize("relation, value", [("code", "ZX-41"), ("email", "a@b"), ("phone number", "555"), ("budget", "100"), ("status", "READY"), ("owner", "Alex"), ("location", "Room B2"), ("version", "V9"), ("provider", "Northwind"), ("deadline", "Friday"), ("price", "50"), ("color", "amber"), ("timezone", "UTC"), ("quantity", "12"), ("serial number", "S-1")])
def test_relations_are_supported(spark, relation, value):
    assert verdict(spark, f"What is the current {relation} for CLN-R01?", f"The current {relation} for CLN-R01 is {value}.") == "SUPPORTED"


@pytest.mark.parametrize("want, memories", [
    ("SUPPORTED", ["The current code for AB-1 is Q1."]),
    ("SUPPORTED", ["AB-1's current code is Q1."]),
    ("SUPPORTED", ["The code for AB-1 changed to Q1.", "The current code for AB-1 is Q0."]),
    ("INSUFFICIENT", ["The previous code for AB-1 was Q0."]),
    ("INSUFFICIENT", ["The current code for AB-2 is Q1."]),
    ("INSUFFICIENT", ["The current email for AB-1 is Q1."]),
    ("INSUFFICIENT", ["Is the current code for AB-1 known?"]),
    ("CONTRADICTED", ["The current code for AB-1 is Q1.", "The current code for AB-1 is Q2."]),
    ("AMBIGUOUS", [("The current code for AB-1 updated to Q1.", 5), ("The current code for AB-1 updated to Q2.", 5)]),
    ("SUPPORTED", [("The current code for AB-1 updated to Q1.", 5), ("The current code for AB-1 updated to Q2.", 6)]),
])
def test_verdicts(spark, want, memories):
    assert verdict(spark, "What is the current code for AB-1?", *memories) == want


def test_a_distractor_changes_nothing_and_no_assertion_abstains(spark):
    q, fact, noise = "What is the current code for AB-1?", "The current code for AB-1 is Q1.", "The current color for AB-7 is red."
    assert verdict(spark, q, fact, noise) == "SUPPORTED"
    assert verdict(spark, q, noise) == "INSUFFICIENT"


def test_adversarial_set(spark):
    c = adversarial_cases(spark)
    rows = c.collect()
    assert len({r["case_id"] for r in rows}) == 120 and sum(r["relevant"] for r in rows) == 80 and not any("$" in r["text"] for r in rows)
    assert all(len({r["case_id"] for r in rows if r["category"] == k}) == 4 for k in CATEGORIES)
    assert len({r["pos"] for r in rows if r["relevant"]}) == 8
    gold = c.where("relevant").select("case_id", F.col("memory_id").alias("id"))
    names = c.select("case_id").distinct()
    found = {}
    for name in ("v2", "v6", "recency", "random"):
        ranked = R.rank(c, name, 5).select("case_id", "rank", F.col("memory_id").alias("id"))
        found[name] = M.decision_metrics(M.per_case(names, ranked, gold)).first()
    assert found["v6"]["mrr"] == found["v6"]["hit_1"] == found["v6"]["answerable_recall"] == found["v6"]["abstention_correct"] == 1
    assert found["v6"]["false_retrieval"] == 0 and found["v2"]["false_retrieval"] == 1
    assert found["v2"]["mrr"] >= max(found["recency"]["mrr"], found["random"]["mrr"]) + 0.15


@pytest.mark.parametrize("name", sorted(R.RANKERS))
def test_rankers_are_deterministic(spark, sf, name):
    c = conversation_cases(spark, sf)
    seen = set()
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str(sorted(R.rank(c.repartition(n + 2), name, 5).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_users_register_rankers(spark, sf):
    R.register("shortest", lambda c, k: R.top(c.withColumn("score", -F.length("text").cast("double")), k, F.desc("score"), F.col("pos")))
    assert R.rank(conversation_cases(spark, sf), "shortest", 1).count() > 0
    del R.RANKERS["shortest"]


def test_the_gate_meets_the_conversations(spark, tmp_path):
    turns = [(1, 0, "user", "The current code for ACME-1 updated to ZX-7."), (1, 1, "assistant", "Noted."), (1, 2, "user", "What is the current code for ACME-1?"), (2, 0, "user", "Hello there."), (2, 1, "user", "What is the current code for ACME-2?")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r["case_id"]: r["verdict"] for r in run("gate_verdicts_cases")} == {"1": "SUPPORTED", "2": "INSUFFICIENT"}
    assert {(r["case_id"], r["pos"]): r["value"] for r in run("gate_evidence_cases")}[("1", 0)] is not None and len(run("gate_evidence_cases")) == 3
    assert {r["case_id"] for r in run("gate_coverage_cases")} == {"1", "2"} and {r["case_id"] for r in run("rank_v6_cases")} == {"1"}


def test_relations_are_those_whose_alias_is_a_word(spark):
    names = sorted(L.RELATIONS.items())
    texts = ["", None, "The Phone number: phones", "time zone", "time  zone", "a responsible person-", "responsible person", "e-mail", "due date!", "ROOM\ncode_1 code-2 code", "ß pin", "registration number plate", *(f"x {a}." for a, _ in L.aliases())]
    got = {r["t"]: r["r"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", G.relations(F.col("t")).alias("r")).collect()}
    plain = lambda t: [r for r, ns in names if re.search(rf"(^|[^A-Za-z0-9_-])({'|'.join(ns)})([^A-Za-z0-9_-]|$)", (t or "").lower().replace("ß", "ss"))]
    assert got == {t: plain(t) for t in texts}


def test_word_boundaries_of_roles_are_ascii(spark):
    texts = {"Doías de y.": "QUESTION", "Dooías": "UNKNOWN", "no\x0bvalue": "UNKNOWN", "no value": "NO_VALUE", "agendaé": "AGENDA", "So? ": "UNKNOWN", "So? \n": "QUESTION"}
    rows = [(f"c{k}", k, f"m{k}", t, "2026-07-01", "q") for k, t in enumerate(texts)]
    got = {r["text"]: r["role"] for r in G.evidence(spark.createDataFrame(rows, "case_id string, pos long, memory_id string, text string, ts string, query string")).collect()}
    assert got == texts


def test_patterns_of_roles_hold_a_needed_word():
    for role, _, patterns in L.ROLE_PATTERNS:
        for p in patterns if role in G.NEEDED else ():
            assert all(any(w in m for w in G.NEEDED[role]) for m in ("agenda item", "action item", "no value", "value missing", "contains no result", "without answer", "answer not present", "review of", "topic for", "discussion topic of", "still pending", "remains unknown", "pending value", "uncertain issue", "is not", "do not use", "wrong code", "discussed", "mention", "prompt", "query") if re.search(p, m))
