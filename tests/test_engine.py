"""Every query with SQL against that SQL; sampling, sources and sinks."""

import ast
import hashlib
import json
import random
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text
from tessera.operators import flags, relational, sampling, thresholds
from tessera.plans import q_ops, q_sampling
from tessera.sources import readers, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    q = catalog.queries()[name](spark, sf)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(q.columns) == sorted(names)
    got = sorted(tuple(cell(r[c]) for c in sorted(names)) for r in q.collect())
    want = sorted(tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert got == want


def test_flow_meets_quotas():
    r = random.Random(4)
    for _ in range(60):
        s, d = [f"s{k}" for k in range(4)], [f"d{k}" for k in range(3)]
        hidden = {(a, b): r.randint(0, 4) for a in s for b in d}
        cells = {c: n + r.randint(0, 3) for c, n in hidden.items()}
        got = sampling.transport(cells, {a: sum(hidden[a, b] for b in d) for a in s}, {b: sum(hidden[a, b] for a in s) for b in d}, "x", r.randint(0, 9))
        assert got is not None and all(n <= cells[c] for c, n in got.items())
        assert all(sum(got.get((a, b), 0) for b in d) == sum(hidden[a, b] for b in d) for a in s)
        assert all(sum(got.get((a, b), 0) for a in s) == sum(hidden[a, b] for a in s) for b in d)
    assert sampling.transport({("a", "b"): 1}, {"a": 2}, {"b": 2}, "x") is None


def test_stratified_sample(spark):
    sf = "/root/testdata/sf0.01"
    rows = q_sampling.stratified_sample(spark, sf).collect()
    flags = {r["id"]: r for r in q_sampling.cases(spark, sf).collect()}
    for key, quota in (("source", q_sampling.SOURCES), ("domain", q_sampling.DOMAINS), ("family", q_sampling.FAMILIES)):
        assert {v: sum(r[key] == v for r in rows) for v in quota} == quota
    assert len({r["id"] for r in rows}) == len(rows) == 60
    assert all(flags[r["id"]][r["family"]] for r in rows)
    assert sum(r["no_evidence"] for r in rows) == 24 and all(r["no_evidence"] for r in rows if r["family"] == "n10")
    two = q_sampling.disjoint_stages(spark, sf).collect()
    assert len({r["id"] for r in two}) == len(two)


def test_order_of_a_stage_follows_stress(spark):
    cases = spark.createDataFrame([(f"c{k}", "s", "d", True, k) for k in range(9)], "id string, source string, domain string, n10 boolean, stress int")
    quota = ({"n10": 3}, {"s": 3}, {"d": 3})
    got = sampling.stages(cases, [(name, *quota) for name in ("ev_b", "ev_c", "ev_a")])
    assert [sorted(r["id"] for r in g.collect()) for g in got] == [["c0", "c1", "c2"], ["c6", "c7", "c8"], ["c3", "c4", "c5"]]


def test_cases_of_stages_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(f"c{k}", "s", "d", True, k) for k in range(9)], "id string, source string, domain string, n10 boolean, stress int")
    got = sampling.stages(rows.mapInArrow(count, rows.schema), [(name, {"n10": 3}, {"s": 3}, {"d": 3}) for name in ("ev_b", "ev_c")])
    assert sorted(r["id"] for r in got[0].unionByName(got[1]).collect()) == ["c0", "c1", "c2", "c6", "c7", "c8"]
    assert seen.value == 9


def test_group_flags_scan_keys_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, "d", "A", "r"), (2, "d", "a ", "q"), (3, None, None, None), (4, None, "", "r"), (5, "e", "b", "r"), (6, "e", "b", "R")], "id long, domain string, subject string, relation string")
    got = {r["id"]: (r["n3"], r["n4"], r["n12"]) for r in flags.group_flags(rows.mapInArrow(count, rows.schema)).collect()}
    assert got == {1: (True, True, False), 2: (True, True, False), 3: (False, True, False), 4: (False, True, False), 5: (False, False, True), 6: (False, False, True)}
    assert seen.value == 12  # the keys, and the rows that get the flags


def test_reservoir_of_a_dealt_domain(spark):
    rows = spark.range(700).select(F.col("id"), F.when(F.col("id") % 7 > 0, "d").alias("domain"))
    got = flags.reservoir(rows, "t", 90, "id").collect()
    for domain in ("d", None):
        hashes = sorted((hashlib.sha256("\u001f".join(x for x in ("t", domain, str(k)) if x is not None).encode()).hexdigest(), k) for k in range(700) if (k % 7 > 0) == (domain is not None))
        assert sorted(r["id"] for r in got if r["domain"] == domain) == sorted(k for _, k in hashes[:90])
    odd = spark.createDataFrame([(x,) for x in (None, "", " ", "\t\n\r\f\x0b", "\u00a0", "’", "ß", " a", "\x00")], "x string")
    assert odd.where(text.filled("x") != (text.norm("x") != "")).count() == 0


def test_stress_gate_and_decisions():
    g = sampling.stress_gate({"a": 0.5, "b": 0.99, "c": 0.2}, {"a": 0.6, "b": 0.99, "c": 0.2}, {"a": 500, "b": 500, "c": 5}, 1)
    assert g["pass"] and g["dimensions"]["c"][0].startswith("insufficient")
    assert not sampling.stress_gate({"a": 0.5}, {"a": 0.505}, {"a": 500}, 1)["pass"]
    assert [thresholds.decide(*x) for x in ((False, True, True), (True, False, True), (True, True, False), (True, True, True))] == ["INVALID", "FAIL_COLLAPSE", "FAIL_PERFORMANCE", "PASS"]
    assert thresholds.integrity_gate({"a": 0}, 384) and not thresholds.integrity_gate({"a": 1}, 384)
    assert thresholds.guardrails({"m": 0.5}, {"m": 0.48}, {"m": ("min", -0.03)}) == {"m": True}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n,3\n')
    assert [tuple(r) for r in readers.csv_records(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), (None, "3")]
    assert sorted(r["value"] for r in readers.csv_cells(spark, str(tmp_path / "a.csv")).collect()) == ["1", "3", "two\nlines", "x", "y"]
    (tmp_path / "b.json").write_text('[{"a": 1, "b": ["x"]},\n {"a": 2, "b": []}]')
    assert readers.json_records(spark, str(tmp_path / "b.json"), "a int, b array<string>").count() == 2
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert [r["a"] for r in readers.jsonl_records(spark, str(tmp_path / "c.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "d.md").write_text("# t\n\n  b  \n")
    assert [r["value"] for r in readers.text_lines(spark, str(tmp_path / "d.md")).collect()] == ["# t", "b"]
    j = spark.createDataFrame([('{"t1": [{"q": "a"}]}',), ('{"t2": {"x": [{"q": "b"}], "y": [{"q": "c"}]}}',), ('[{"q": "d"}]',)], "j string")
    assert sorted((str(r["topic"]), r["item"]["q"]) for r in readers.topic_lists(j, "j", "struct<q: string>").collect()) == [("None", "d"), ("T1", "a"), ("T2", "b"), ("T2", "c")]


def test_history_and_archives(spark, tmp_path):
    base = tmp_path / "h"
    (base / "in").mkdir(parents=True)
    (base / "in/a.json").write_text('{"k": ["v", " ", {"n": 1}]}')
    (base / "b.py").write_text('x = "const"\n')
    (base / "c.md").write_text("line\n")
    (base / "d.bin").write_text("no")
    (base / "in/skip.txt").write_text("skipped")
    found = readers.files(spark, str(base), exclude="skip")
    assert sorted(r["value"] for r in readers.history_strings(found).collect()) == ["const", "k", "line", "n", "v"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/train/dialogues_001.json", "[1]")
        z.writestr("d/other.json", "[2]")
    rows = readers.zip_members(spark, str(tmp_path / "z.zip")).collect()
    assert [(r["split"], r["text"]) for r in rows] == [("train", "[1]")]


def test_sinks_take_aggregates_only(spark, tmp_path):
    agg = spark.range(5).groupBy((F.col("id") % 2).alias("odd")).agg(F.count("*").alias("n"))
    rows = sinks.write_json(agg, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == rows and "| odd | n |" in sinks.report("t", rows)
    with pytest.raises(ValueError):
        sinks.write_json(spark.range(5), str(tmp_path / "y.json"))
    with pytest.raises(ValueError):
        sinks.write_json(spark.range(5).select(F.col("id").alias("n")), str(tmp_path / "y.json"), 3)


def hashed(*parts):
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Documents of which one domain has more bases than the reservoir, and its bases as a list of (id, source, query, gold, domain)."""
    r = random.Random(8)
    v = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(flags.RESERVOIR + 300):
        head, rest = " ".join(r.choices(v, k=r.randint(1, 6))), " ".join(r.choices(v, k=r.randint(2, 12)))
        rows.append((k, f"{head}. {rest}", "en" if k % 12 else "de", f"s{r.randrange(5)}", 9))
    rows += [(5000, "no rest", "en", "s1", 7), (5001, "Nur eins. hier", "fr", "s1", 14)]
    sf = str(tmp_path_factory.mktemp("crowded"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(sf + "/documents.parquet")
    base = [(i, s, t.split(".")[0] + ".", t.split(".")[1], {"en": "D1", "de": "D2", "fr": "D3"}[g]) for i, t, g, s, _ in rows if "." in t]
    return sf, base


def test_decoys_are_chosen_from_all_bases(spark, crowded):
    sf, base = crowded
    got = {x["id"]: x["decoy"] for x in catalog.queries()["decoy_other_subject"](spark, sf).collect()}
    assert len(got) == len(base) - 1 > flags.RESERVOIR
    for i, s, _, _, d in base[::97]:
        assert got[i] == min((b for b in base if b[4] == d and b[1] != s), key=lambda b: hashed("decoy", "N3", i, b[1], b[0]))[0]
    pairs = {x["id"]: x["decoy"] for x in catalog.queries()["decoy_same_pair"](spark, sf).collect()}
    for i, s, _, _, d in base[::97]:
        assert pairs[i] == min((b for b in base if b[4] == d and b[1] == s and b[0] != i), key=lambda b: hashed("decoy", "N12", i, b[1], b[0]))[0]


def test_fillers_and_better_decoys_come_from_all_bases(spark, crowded):
    sf, base = crowded
    own = {b[0]: b for b in base}
    got = {}
    for x in catalog.queries()["same_domain_fillers"](spark, sf).orderBy("ord").collect():
        got.setdefault(x["case_id"], []).append((x["memory_id"], x["ord"]))
    for i, rows in list(got.items())[::31]:
        assert rows == sorted(((b[0], hashed("filler", i, b[1], b[0])) for b in base if b[4] == own[i][4] and b[0] != i), key=lambda x: x[1])[:20]
    toks = {b[0]: (set(b[2].rstrip(".").lower().split()), set(b[3].lower().split())) for b in base}
    better = {x["id"]: x["decoy"] for x in catalog.queries()["decoy_better_overlap"](spark, sf).collect()}
    assert len(better) > 125
    for i in list(got)[::31]:
        q = toks[i][0]
        want = [b[0] for b in base if b[4] == own[i][4] and b[0] != i and len(q & toks[b[0]][1]) > len(q & toks[i][1])]
        assert better.get(i) == min(want, key=lambda b: hashed("decoy", "N9", i, b), default=None)


def test_every_base_is_a_case(spark, crowded):
    sf, base = crowded
    fill = {}
    for x in catalog.queries()["same_domain_fillers"](spark, sf).collect():
        fill.setdefault(x["case_id"], set()).add(x["memory_id"])
    alone = [b[0] for b in base if b[4] == "D3"]
    assert sorted(fill) == sorted(b[0] for b in base if b[0] not in alone) and {len(x) for x in fill.values()} == {20}


def test_no_evidence_cases_get_no_copy_of_their_gold(spark):
    rows = [(i, f"s{i % 3}", "D1", [t], i % 2 == 0) for i, t in enumerate(["Same text", "same  TEXT", "other", "third", "same text", "last"])]
    cases = spark.createDataFrame(rows, "id long, source string, domain string, gold array<string>, no_evidence boolean")
    decoy = spark.createDataFrame([(0, 4), (1, 0), (2, 0)], "id long, decoy long")
    got = {}
    for x in relational.materialise(cases, cases, decoy).collect():
        got.setdefault(x["case_id"], {})[x["memory_id"]] = x["priority"]
    assert set(got[0]) == set(got[4]) == {2, 3, 5}
    assert got[1] == {1: 0, 0: 1, 2: 3, 3: 3, 4: 3, 5: 3} and got[2] == {0: 1, 1: 3, 3: 3, 4: 3, 5: 3}
    with pytest.raises(Exception, match="insufficient runtime memories"):
        relational.materialise(cases.where("id in (0, 1)"), cases.where("id in (0, 1, 4)"), decoy).collect()
    kept = relational.budgeted(spark.createDataFrame([(1, 2, 1, ""), (1, 3, 1, ""), (1, 1, 2, "")], "case_id long, memory_id long, priority int, ord string"), 2)
    with pytest.raises(Exception, match="gold dropped by budget"):
        relational.checked(cases.where("id = 1"), kept).collect()


def test_cases_get_the_decoy_of_their_family(spark, sf):
    rows = catalog.queries()["materialised_cases"](spark, sf).collect()
    base = {r["id"]: r for r in flags.valid(q_ops.bases(spark, sf)).collect()}
    assert {r["case_id"] for r in rows} == set(base)
    kinds = set()
    for r in rows:
        if r["priority"] == 1:
            a, b = base[r["case_id"]], base[r["memory_id"]]
            kinds.add((a["subject"] == b["subject"], a["relation"] == b["relation"]))
    assert {(False, True), (True, False), (True, True)} <= kinds


def test_last_prior_is_strictly_earlier(spark):
    d = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 5, True), ("b", 1, False)], "k string, t int, e boolean")
    assert sorted((r["k"], r["t"], str(r["p"])) for r in relational.last_prior(d, ["k"], "t", F.col("e"), "p").collect()) == [("a", 1, "None"), ("a", 2, "1"), ("a", 5, "1"), ("b", 1, "None")]


def test_the_engine_doesnt_need_the_training_operators():
    root = Path(catalog.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for n in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any("llm" in x or "corpus_pipeline" in x for x in names), f


def test_freshness_and_summary():
    d = {"a": "1", "b": "2"}
    assert thresholds.freshness("a", d, d, "PASS_NO_MATERIAL_CONTAMINATION", 0)["pass"]
    assert not thresholds.freshness("a", {"a": "2"}, d, "PASS_NO_MATERIAL_CONTAMINATION", 0)["matches"]
    assert not thresholds.freshness("a", d, {"a": "1", "b": "1"}, "PASS_NO_MATERIAL_CONTAMINATION", 0)["distinct"]
    assert thresholds.summary({"x": {"status": "PASS"}, "y": None}) == {"x": "PASS", "y": None}


def test_n9_of_whole_tables_meets_every_base(spark, crowded):
    sf, base = crowded
    toks = {b[0]: (set(b[2].rstrip(".").lower().split()), set(b[3].lower().split())) for b in base}
    got = {r["id"]: r["n9"] for r in flags.all_flags(q_ops.bases(spark, sf), whole=True).collect()}
    want = {i: any(len(toks[i][0] & toks[b[0]][1]) > len(toks[i][0] & toks[i][1]) for b in base if b[4] == d and b[0] != i) for i, _, _, _, d in base}
    assert got == want and 0 < sum(want.values()) < len(want)
    stress = q_sampling.cases(spark, sf).join(flags.all_flags(q_ops.bases(spark, sf), whole=True).select(F.col("id").cast("string").alias("id"), flags.stress_count().alias("s")), "id")
    assert stress.where("stress <> s").count() == 0 and stress.count() == len(base)
    assert sum(got.values()) > sum(r["n9"] for r in flags.all_flags(q_ops.bases(spark, sf)).collect())
