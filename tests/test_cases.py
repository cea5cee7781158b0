"""Cases with native pools, flags, bounds, counters, replays and shards against plain versions."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import cases as C
from tessera.operators import flags, rankers, relational, replay, thresholds
from tessera.sources import corpora, shards

BASE = f"id string, source string, domain string, subject string, relation string, implicit_relation boolean, query string, gold array<{C.MEMORY}>, pool array<{C.MEMORY}>"


def h(*parts):
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def norm(x):
    return re.sub(r"\s+", " ", x.lower()).strip()


def shared(query, text):
    return len(set(re.findall(r"\w+", query.lower())) & set(re.findall(r"\w+", text.lower())))


def plain_decoy(b, family, bases):
    others = [o for o in bases if o["id"] != b["id"] and o["gold"]]
    if family == "N9":
        best = max(shared(b["query"], g["text"]) for g in b["gold"])
        better = [o for o in others if o["domain"] == b["domain"] and shared(b["query"], o["gold"][0]["text"]) > best]
        return min(better, key=lambda o: h("decoy", "N9", b["id"], o["id"]), default=None)
    fits = {"N3": lambda o: o["domain"] == b["domain"] and o["subject"] != b["subject"], "N4": lambda o: not b["implicit_relation"] and o["subject"] == b["subject"] and o["relation"] != b["relation"], "N12": lambda o: o["subject"] == b["subject"] and o["relation"] == b["relation"]}.get(family)
    return min((o for o in others if fits and fits(o)), key=lambda o: h("decoy", family, b["id"], o["source"], o["id"]), default=None)


def plain_case(b, family, no_evidence, bases, budget):
    out, seen = [], set()
    ids, texts = {g["id"] for g in b["gold"]}, {norm(g["text"]) for g in b["gold"]}

    def push(m, priority):
        if m["id"] not in seen and not (no_evidence and (m["id"] in ids or norm(m["text"]) in texts)):
            seen.add(m["id"])
            out.append((m["id"], priority))

    if not no_evidence:
        for g in b["gold"]:
            push(g, 0)
    if d := plain_decoy(b, family, bases):
        push(d["gold"][0], 1)
    for m in sorted(b["pool"], key=lambda m: h("native-pool", b["id"], m["id"])):
        push(m, 2)
    for o in sorted((o for o in bases if o["id"] != b["id"] and o["domain"] == b["domain"] and o["gold"]), key=lambda o: h("filler", b["id"], o["source"], o["id"])):
        if len(out) < budget:
            push(o["gold"][0], 3)
    return out[:budget]


def made_bases(n=90):
    r = random.Random(6)
    words = "tea hotel train price when who sleeps Ann".split()
    say = lambda k: " ".join(r.choices(words, k=k))
    out = []
    for k in range(n):
        gold = [{"id": f"g{k // 2}-{j}", "text": say(3), "ts": "t"} for j in range(r.randint(1, 3))]
        pool = gold + [{"id": f"p{k}-{j}", "text": say(2), "ts": "t"} for j in range(r.randint(0, 4))]
        out.append({"id": f"b{k}", "source": r.choice("xy"), "domain": r.choice(["D1", "D1", "D2"]), "subject": r.choice(["s", "t", None]), "relation": r.choice(["q", "r"]), "implicit_relation": r.random() < 0.3, "query": say(4), "gold": gold, "pool": pool})
    return out


@pytest.mark.parametrize("budget, block", [(6, 4096), (20, 8)])
def test_cases(spark, budget, block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    bases = made_bases()
    known = [b for b in bases if b["subject"] is not None]
    families = ["N3", "N4", "N9", "N12", "N1"]
    chosen = [(b["id"], families[k % 5], k % 3 == 0) for k, b in enumerate(known)]
    table = spark.createDataFrame([tuple(b[c] if c not in ("gold", "pool") else [tuple(m.values()) for m in b[c]] for c in b) for b in bases], BASE)
    got = C.materialise(table, spark.createDataFrame(chosen, "id string, family string, no_evidence boolean"), budget).collect()
    want = {}
    for b, (i, family, without) in zip(known, chosen, strict=True):
        want[i] = plain_case(b, family, without, bases, budget)
    have = {i: [] for i in want}
    for r in sorted(got, key=lambda r: r["pos"]):
        have[r["case_id"]].append((r["memory_id"], r["priority"]))
    assert have == want


def test_a_second_gold_text_that_equals_the_query_leaves_no_better_decoy(spark):
    m = lambda i, t: (i, t, "t")
    rows = [("a", "x", "D1", "s", "r", False, "one two three", [m("a1", "four"), m("a2", "one two three")], []), ("b", "x", "D1", "s", "r", False, "q", [m("b1", "one two")], [])]
    b = spark.createDataFrame(rows, BASE)
    assert C.decoys(b.withColumn("family", F.lit("N9")), b).collect() == []


@pytest.mark.parametrize("chosen, why", [([("none", "N1", False)], "missing source detail"), ([("a", "N1", False)], "insufficient runtime memories"), ([("b", "N1", False)], "gold dropped by budget")])
def test_odd_cases_are_errors(spark, chosen, why):
    m = lambda i: (i, f"text {i}", "t")
    rows = [("a", "x", "D1", "s", "r", False, "q", [m("a1")], []), ("b", "x", "D2", "s", "r", False, "q", [m(f"b{k}") for k in range(4)], [])]
    with pytest.raises(Exception, match=why):
        C.materialise(spark.createDataFrame(rows, BASE), spark.createDataFrame(chosen, "id string, family string, no_evidence boolean"), 3).collect()


def test_flags_compare_normal_forms(spark):
    rows = [(1, "D1", "Ann", "Food"), (2, "D1", "ann ", "food"), (3, "D1", "Bob", "x"), (4, "D2", "Bob", "y"), (5, None, "Cy", "z")]
    got = {r["id"]: (r["n3"], r["n4"], r["n12"]) for r in flags.group_flags(spark.createDataFrame(rows, "id int, domain string, subject string, relation string")).collect()}
    assert got == {1: (True, False, True), 2: (True, False, True), 3: (True, True, False), 4: (False, True, False), 5: (False, False, False)}


def test_a_bound_without_a_measurement_is_an_error(spark):
    limits = thresholds.bounds(spark, "frame")
    with pytest.raises(Exception, match="no measurement of"):
        thresholds.check(spark.createDataFrame([("temporal_scope_accuracy", 1.0)], "metric string, measured double"), limits).collect()


def test_collapse_by_family(spark):
    one = spark.createDataFrame([(10, 8, 2, 0.25, 0.5)], "n long, answerable long, no_evidence long, false_abstention double, false_retrieval double")
    groups = spark.createDataFrame([("family", "N2", 0.5), ("family", "N3", 0.9), ("domain", None, 0.8)], "axis string, value string, decision_accuracy double")
    r = thresholds.anti_collapse(one, groups).first()
    assert (r["retrieval_share"], r["structural_family_collapse"], r["domain_specific_collapse"], r["families_below"], r["passed"]) == (0.7, True, False, ["N2"], False)


def test_adapters_count_what_they_leave_out(spark):
    rows = [(0, "1", "a?", "g"), (1, "2", " ", "g"), (2, "3", "b?", ""), (3, "4", "", ""), (4, "5", "c?", "g")]
    seen = Observation()
    out = corpora.personamem_rows(spark.createDataFrame(rows, "n long, persona_id string, user_query string, related_conversation_snippet string"), seen)
    assert out.count() == 2
    assert seen.get == {"rows": 5, "kept": 2, "no_question": 2, "no_gold": 1}


def test_united_bases_have_different_questions(spark):
    rows = [("x", "1", " What now? "), ("y", "2", "what  now?"), ("x", "3", "Who?")]
    got = corpora.unique(spark.createDataFrame(rows, "source string, id string, query string")).collect()
    assert sorted(r["id"] for r in got) == sorted([min(("x", "1"), ("y", "2"), key=lambda k: h(*k))[1], "3"])


def test_a_ranker_that_peeks_is_found(spark):
    rows = [(f"c{c}", "which tea", k, f"m{k}", f"tea {k}", "2026-07-01", k == 2) for c in range(4) for k in range(4)]
    cases = spark.createDataFrame(rows, "case_id string, query string, pos long, memory_id string, text string, ts string, relevant boolean")
    changed = {"relevant": ~F.col("relevant")}
    assert replay.mutation_replay(rankers.RANKERS["lexical"], cases, changed).count() == 0
    peeks = lambda c, k: c.where("relevant").select("case_id", F.lit(1).alias("rank"), "memory_id", F.lit(1.0).alias("score"))
    assert replay.mutation_replay(peeks, cases, changed).count() == 4
    assert replay.determinism_replay(rankers.RANKERS["lexical"], cases, 2).count() == 0
    assert replay.firewalled(cases).columns == list(replay.VISIBLE)
    with pytest.raises(ValueError, match="lack ts"):
        replay.firewalled(cases.drop("ts"))
    with pytest.raises(ValueError, match="may use text"):
        replay.mutation_replay(peeks, cases, {"text": F.lit("")})


def put(folder, k, count=2, **other):
    value = {"schema_version": "1", "source_commit": "c", "dataset_sha256": "d", "model": "m", "shard_index": k, "shard_count": count, "case_count": 1, "predictions": [{"case_id": f"c{k}", "retrieved_memory_ids": ["a", "b"]}]} | other
    (folder / f"{k}-{len(list(folder.iterdir()))}.json").write_text(json.dumps(value, indent=1))


def test_shards(spark, tmp_path):
    put(tmp_path, 0)
    put(tmp_path, 1)
    read = shards.read_shards(spark, str(tmp_path))
    assert sorted(map(tuple, shards.predictions(read).collect())) == [("c0", 1, "a"), ("c0", 2, "b"), ("c1", 1, "a"), ("c1", 2, "b")]
    assert sorted((r["shard_index"], r["case_count"], r["n"], r["first"]) for r in shards.manifest(read).collect()) == [(0, 1, 1, "c0"), (1, 1, 1, "c1")]


@pytest.mark.parametrize("odd, why", [({"case_count": 2}, "another number of cases"), ({"model": "n"}, "different runs"), ({"shard_index": 0}, "missing or repeated"), ({"predictions": [{"case_id": "c0", "retrieved_memory_ids": ["a"]}]}, "predicted twice")])
def test_odd_shards_are_errors(spark, tmp_path, odd, why):
    put(tmp_path, 0)
    put(tmp_path, 1, **odd)
    with pytest.raises(Exception, match=why):
        shards.predictions(shards.read_shards(spark, str(tmp_path))).collect()


def test_a_case_that_finds_few_fillers_below_the_bound_looks_at_all(spark):
    pool = [(f"b{k}", "x", "D1", f"p{k % 50}") for k in range(150)]
    barred = {"b0": [f"p{k}" for k in range(45)], "b1": None}
    cases = spark.createDataFrame([(i, "D1", b) for i, b in barred.items()], "id string, domain string, barred array<string>")
    got = relational.fillers(cases, spark.createDataFrame(pool, "id string, source string, domain string, print string"), 10).collect()
    for i, bar in barred.items():
        want = sorted((h("filler", i, s, o), o) for o, s, _, p in pool if o != i and p not in (bar or ()))[:10]
        assert sorted((r["ord"], r["memory_id"]) for r in got if r["case_id"] == i) == want


def test_a_pool_in_blocks_meets_all(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    monkeypatch.setattr(C, "POOL_BLOCK", 4)
    asking = spark.createDataFrame([(f"a{k}", "g") for k in range(10)], "id string, domain string")
    pool = spark.createDataFrame([(f"a{k}", "g") for k in range(25)], "id string, domain string")
    got = [(r["id"], r["o_id"]) for r in C.paired(asking, pool, ("domain",)).collect()]
    assert sorted(got) == sorted((f"a{i}", f"a{j}") for i in range(10) for j in range(25) if i != j)
