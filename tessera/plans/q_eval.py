"""Evaluation queries: relevance judgements, metrics, intervals, breakdowns, thresholds, the audit and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import audit as A
from tessera.operators import gate as G
from tessera.operators import metrics as M
from tessera.operators import rankers as R
from tessera.operators import thresholds as X
from tessera.operators.flags import boundaries
from tessera.operators.sizes import once
from tessera.plans import sql_parts as S
from tessera.plans.cases import ACCOUNT_SQL, account_cases, conversation_cases, customer_cases, customer_sql
from tessera.plans.q_rank import BM25, V2, V2_SCORE, _scored, benchmark_hits
from tessera.plans.registry import SQL, query, table

GOLD = f"""ig AS (SELECT item_id, unnest(list_distinct({S.grams('k')})) AS g FROM (SELECT item_id, {S.audit('text')} AS k FROM benchmark)), dg AS (SELECT doc_id, unnest(list_distinct({S.grams('k')})) AS g FROM (SELECT doc_id, {S.audit('text')} AS k FROM documents)),
gold AS (SELECT item_id, doc_id, count(*)::DOUBLE / n AS coverage FROM ig JOIN dg USING (g) JOIN (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id) USING (item_id) GROUP BY item_id, doc_id, n HAVING count(*)::DOUBLE / n >= {A.COVERAGE})"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return A.judgements(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@query(f"WITH {GOLD} SELECT item_id, doc_id, round(coverage, 6) AS coverage FROM gold")
def relevance_judgements(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).withColumn("coverage", F.round("coverage", 6))


def _results(name: str, rank: str, k: int = 5) -> str:
    """Per-case results of a ranking CTE (item_id, rank, doc_id)."""
    depth = ", ".join(f"sum(CASE WHEN rank <= {d} THEN g ELSE 0 END) AS hits_{d}" for d in M.DEPTHS)
    cols = ", ".join(f"CASE WHEN answerable THEN hits_{d} / n_gold::DOUBLE END AS recall_{d}, CASE WHEN answerable THEN hits_{d} / {d}::DOUBLE END AS precision_{d}" for d in M.DEPTHS)
    zero = ", ".join(f"coalesce(hits_{d}, 0) AS hits_{d}" for d in M.DEPTHS)
    return f"""{name}_h AS (SELECT r.item_id, r.rank, r.doc_id, (gold.doc_id IS NOT NULL)::INT AS g FROM {rank} r LEFT JOIN gold ON r.item_id = gold.item_id AND r.doc_id = gold.doc_id WHERE r.rank <= {k}),
{name}_b AS (SELECT item_id, count(*) AS n_returned, min(CASE WHEN g = 1 THEN rank END) AS first_rank, sum(1 - g) AS n_irrelevant, {depth}, sum(CASE WHEN rank <= 5 THEN g / log2(rank + 1) ELSE 0 END) AS dcg FROM {name}_h GROUP BY item_id),
{name}_c AS (SELECT b.item_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_gold, 0) > 0 AS answerable, coalesce(n_returned, 0) AS n_returned, coalesce(n_irrelevant, 0) AS n_irrelevant, first_rank, coalesce(dcg, 0) AS dcg, {zero}, source, lang, family
  FROM (SELECT item_id, CASE WHEN len({S.tokens('text')}) > 40 THEN 'long' ELSE 'short' END AS family FROM benchmark) b LEFT JOIN {name}_b USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY item_id) USING (item_id)
  LEFT JOIN (SELECT item_id, min(source) AS source, min(lang) AS lang FROM {rank} r JOIN documents USING (doc_id) WHERE rank = 1 GROUP BY item_id) USING (item_id)),
{name} AS (SELECT *, CASE WHEN answerable THEN coalesce(1.0::DOUBLE / first_rank, 0) END AS rr, {cols},
  CASE WHEN answerable THEN dcg / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END AS ndcg_5 FROM {name}_c)"""


PC = f"{BM25}, {GOLD}, {_results('pc', 'r')}"


def found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The first five results of each item and the judgements, each computed once for all that a query makes of them."""
    return once(benchmark_hits(spark, sf)), once(judged(spark, sf))


def results(spark: SparkSession, sf: str, hits: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    if hits is None:
        hits, gold = found(spark, sf)
    first = hits.where("rank = 1").join(docs.select("doc_id", "source", "lang"), "doc_id").groupBy(F.col("item_id").alias("case_id")).agg(F.min("source").alias("source"), F.min("lang").alias("lang"))
    cases = items.select(F.col("item_id").alias("case_id"), F.when(F.size(T.tokens("text")) > 40, "long").otherwise("short").alias("family")).join(first, "case_id", "left")
    return M.per_case(cases, hits.select(F.col("item_id").alias("case_id"), "rank", F.col("doc_id").alias("id")), gold.select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("id")))


@query(f"WITH {PC} SELECT item_id, answerable, n_gold::BIGINT AS n_gold, n_returned::BIGINT AS n_returned, first_rank::INT AS first_rank, round(rr, 6) AS rr, round(recall_5, 6) AS recall_5, round(precision_5, 6) AS precision_5, round(ndcg_5, 6) AS ndcg_5 FROM pc")
def per_case_results(spark: SparkSession, sf: str) -> DataFrame:
    x = results(spark, sf).withColumnRenamed("case_id", "item_id")
    return x.select("item_id", "answerable", F.col("n_gold").cast("long").alias("n_gold"), F.col("n_returned").cast("long").alias("n_returned"), F.col("first_rank").cast("int").alias("first_rank"), *(F.round(c, 6).alias(c) for c in ("rr", "recall_5", "precision_5", "ndcg_5")))


MEANS = ["rr", *(f"{m}_{d}" for m in ("recall", "precision") for d in M.DEPTHS), "ndcg_5"]


@query(f"""WITH {PC} SELECT count(*) AS n_cases, count(*) FILTER (answerable) AS n_answerable, {', '.join(f"round(avg({c}), 6) AS {'mrr' if c == 'rr' else c}" for c in MEANS)},
round(CASE WHEN sum(n_returned) > 0 THEN sum(n_irrelevant) / sum(n_returned)::DOUBLE ELSE 0 END, 6) AS irrelevant_rate, round(avg(CASE WHEN NOT answerable THEN (n_returned = 0)::INT END), 6) AS abstention_accuracy FROM pc""")
def set_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = M.set_metrics(results(spark, sf))
    return x.select(*(c if c.startswith("n_") else F.round(c, 6).alias(c) for c in x.columns))


ABST = "sum(CASE WHEN answerable THEN (n_returned > 0)::INT ELSE (n_returned = 0)::INT END)"
DECISIONS = f"""count(*) AS n, count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS no_evidence, sum(coalesce(rr, 0)) / greatest(1, count(*) FILTER (answerable)) AS mrr,
{', '.join(f"count(*) FILTER (answerable AND first_rank <= {d}) / greatest(1, count(*) FILTER (answerable))::DOUBLE AS hit_{d}" for d in M.DEPTHS)},
count(*) FILTER (answerable AND first_rank IS NOT NULL) / greatest(1, count(*) FILTER (answerable))::DOUBLE AS answerable_recall,
count(*) FILTER (answerable AND n_returned = 0) / greatest(1, count(*) FILTER (answerable))::DOUBLE AS false_abstention,
count(*) FILTER (NOT answerable AND n_returned > 0) / greatest(1, count(*) FILTER (NOT answerable))::DOUBLE AS false_retrieval, {ABST} / greatest(1, count(*))::DOUBLE AS abstention_correct"""
MEASURES = ["mrr", *(f"hit_{d}" for d in M.DEPTHS), "answerable_recall", "false_abstention", "false_retrieval", "abstention_correct"]


@query(f"WITH {PC}, dm AS (SELECT {DECISIONS} FROM pc) SELECT n, answerable, no_evidence, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)} FROM dm")
def decision_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.decision_metrics(results(spark, sf)).select("n", "answerable", "no_evidence", *(F.round(m, 6).alias(m) for m in MEASURES))


@query(f"""WITH {PC}, dm AS ({' UNION ALL '.join(f"SELECT '{a}' AS axis, {a} AS value, {DECISIONS} FROM pc GROUP BY {a}" for a in ('source', 'lang', 'family'))})
SELECT axis, value, n, answerable, no_evidence, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)}, round((hit_1 * answerable + (1 - false_retrieval) * no_evidence) / n, 6) AS decision_accuracy FROM dm""")
def group_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return M.breakdown(results(spark, sf), "source", "lang", "family").select("axis", "value", "n", "answerable", "no_evidence", *(F.round(m, 6).alias(m) for m in (*MEASURES, "decision_accuracy")))


@query(f"WITH {PC} SELECT first_rank::INT AS rank, count(*) AS n FROM pc WHERE answerable AND first_rank IS NOT NULL GROUP BY first_rank")
def rank_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return M.rank_histogram(results(spark, sf)).select(F.col("rank").cast("int").alias("rank"), "n")


def _wilson(k: str, n: str, z: float = L.WILSON_Z) -> tuple[str, str]:
    p, den = f"({k}::DOUBLE / greatest({n}, 1))", f"(1 + {z * z}::DOUBLE / greatest({n}, 1))"
    mid, half = f"(({p} + {z * z}::DOUBLE / (2 * greatest({n}, 1))) / {den})", f"({z}::DOUBLE * sqrt(({p} * (1 - {p}) + {z * z}::DOUBLE / (4 * greatest({n}, 1))) / greatest({n}, 1)) / {den})"
    return f"CASE WHEN {n} > 0 THEN greatest(0, {mid} - {half}) ELSE 0 END", f"CASE WHEN {n} > 0 THEN least(1, {mid} + {half}) ELSE 0 END"


_W = _wilson("count(*) FILTER (l.quality = 1)", "count(*)")


@query(f"SELECT source, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, round({_W[0]}, 6) AS low, round({_W[1]}, 6) AS high FROM labels l JOIN documents d USING (doc_id) GROUP BY source")
def wilson_intervals(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    w = M.wilson(F.col("good"), F.col("n"))
    return g.select("source", "n", "good", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


SHORT = f"""{BM25}, {GOLD}, {_results('a', 'r', 1)}, {_results('b', 'r', 5)}, dl AS (SELECT a.item_id AS case_id, b.rr - a.rr AS delta FROM a JOIN b USING (item_id) WHERE a.answerable)"""


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 cut at depth 1 against depth 5."""
    hits, gold = found(spark, sf)
    hits = hits.select(F.col("item_id").alias("case_id"), "rank", F.col("doc_id").alias("id"))
    cases = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"))
    gold = gold.select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("id"))
    return M.paired(M.per_case(cases, hits.where("rank = 1"), gold), M.per_case(cases, hits, gold))


@query(f"WITH {SHORT} SELECT count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses, round(avg(delta), 6) AS mean_delta FROM dl")
def paired_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return M.win_tie_loss(_deltas(spark, sf)).withColumn("mean_delta", F.round("mean_delta", 6))


@query(f"""WITH {SHORT}, od AS (SELECT delta, row_number() OVER (ORDER BY case_id) - 1 AS no FROM dl), nn AS (SELECT count(*) AS n, avg(delta) AS delta FROM dl),
ww AS (SELECT i, ('0x' || substr({S.hashed("20260808", "i", "j")}, 1, 8))::BIGINT % n AS no FROM range(1000) t(i), nn, unnest(range(n)) u(j) WHERE n > 1),
mm AS (SELECT i, round(avg(delta), 9) AS m FROM ww JOIN od USING (no) GROUP BY i), srt AS (SELECT list_sort(list(m)) AS l FROM mm)
SELECT CASE WHEN n < 30 THEN 'UNDERPOWERED' ELSE 'ESTIMATED' END AS status, n, CASE WHEN n > 1 THEN round(delta, 6) END AS delta, round(l[{int(0.025 * 999) + 1}], 6) AS low, round(l[{int(0.975 * 999) + 1}], 6) AS high FROM nn, srt""")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return M.paired_bootstrap(_deltas(spark, sf)).select("status", "n", *(F.round(c, 6).alias(c) for c in ("delta", "low", "high")))


@query("""WITH e AS (SELECT DISTINCT doc_id AS id FROM documents), g AS (SELECT doc_id AS id, count(*) AS times FROM labels GROUP BY doc_id), x AS (SELECT e.id AS e, g.id AS g, times FROM e FULL JOIN g USING (id))
SELECT count(e) AS expected, coalesce(sum(times), 0)::BIGINT AS got, count(*) FILTER (times IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unexpected, count(*) FILTER (times > 1) AS repeated FROM x""")
def prediction_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return M.accounting(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query(f"""WITH {PC}, dm AS (SELECT {DECISIONS} FROM pc), m AS (SELECT unnest(['MRR', 'R@1', 'R@3', 'R@5', 'answerable_recall', 'false_abstention_rate', 'false_retrieval_rate', 'abstention_accuracy', 'eligible_rank1_accuracy']) AS metric,
unnest([mrr, hit_1, hit_3, hit_5, answerable_recall, false_abstention, false_retrieval, abstention_correct, hit_1]) AS measured FROM dm),
t(stage, metric, least, bound) AS (VALUES {', '.join(f"('{s}', '{k[:-4]}', {k.endswith('_min')}, {v}::DOUBLE)" for s in L.THRESHOLDS for k, v in L.THRESHOLDS[s]['aggregate'].items())})
SELECT stage, metric, round(measured, 6) AS measured, bound, CASE WHEN least THEN measured >= bound ELSE measured <= bound END AS passed FROM t JOIN m USING (metric)""")
def threshold_checks(spark: SparkSession, sf: str) -> DataFrame:
    return X.aggregate_checks(M.decision_metrics(results(spark, sf))).withColumn("measured", F.round("measured", 6))


# Primary families of the items: by clauses and digits of their texts.
FAMILY = """CASE WHEN length(text) - length(translate(text, ',;()', '')) >= 2 THEN 'N2' WHEN regexp_matches(text, '[0-9]') THEN 'N6' ELSE 'N7' END"""
FRAMED = f"""{PC}, wt AS (SELECT item_id, min(source) AS wanted_subject, min(lang) AS wanted_relation FROM gold JOIN documents USING (doc_id) GROUP BY item_id),
pf AS (SELECT pc.* REPLACE (b.f AS family), pc.source AS subject, pc.lang AS relation, wanted_subject, wanted_relation FROM pc JOIN (SELECT item_id, {FAMILY} AS f FROM benchmark) b USING (item_id) LEFT JOIN wt USING (item_id))"""
_FIRST = {True: "coalesce(first_rank = 1, false)", False: "NOT coalesce(first_rank = 1, false)"}
_GOT = "answerable AND n_returned > 0"
FRAME = ", ".join(f"count(*) FILTER ({_GOT} AND {a} = {w}) / greatest(1, count(*) FILTER ({_GOT}))::DOUBLE AS {name}" for name, (a, w) in M.BINDINGS.items()) + ", " + ", ".join(f"count(*) FILTER (answerable AND family = '{f}' AND {_FIRST[hit]}) / greatest(1, count(*) FILTER (answerable AND family = '{f}'))::DOUBLE AS {name}" for name, (f, hit) in M.FRAMES.items())


MEASURED = (*M.BINDINGS, *M.FRAMES)


def framed(spark: SparkSession, sf: str, hits: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    """Results with primary families; the first document's source and language are the subject and relation, those of the gold
    documents (the smallest, if there are several) the wanted ones."""
    if hits is None:
        hits, gold = found(spark, sf)
    family = F.when(boundaries(F.col("text")) >= 2, "N2").when(F.col("text").rlike("[0-9]"), "N6").otherwise("N7")
    wanted = gold.join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").groupBy(F.col("item_id").alias("case_id")).agg(F.min("source").alias("wanted_subject"), F.min("lang").alias("wanted_relation"))
    x = results(spark, sf, hits, gold).drop("family").join(table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), family.alias("family")), "case_id")
    return x.withColumns({"subject": F.col("source"), "relation": F.col("lang")}).join(wanted, "case_id", "left")


_ACCURACY = "(count(*) FILTER (answerable AND first_rank = 1) + count(*) FILTER (NOT answerable AND n_returned = 0)) / count(*)::DOUBLE"
_NEAR = f"p >= {L.NEAR_UNIVERSAL} OR 1 - p >= {L.NEAR_UNIVERSAL}"


@query(f"""WITH {FRAMED}, dm AS (SELECT {DECISIONS} FROM pf), f AS (SELECT (answerable * (1 - false_abstention) + no_evidence * false_retrieval) / greatest(1, n) AS p FROM dm),
lo AS (SELECT coalesce((SELECT list_sort(list(v)) FROM (SELECT family AS v, {_ACCURACY} AS acc FROM pf GROUP BY family) WHERE acc < {L.CATASTROPHIC}), []) AS families_below,
  coalesce((SELECT list_sort(list(coalesce(v, 'none'))) FROM (SELECT lang AS v, {_ACCURACY} AS acc FROM pf GROUP BY lang) WHERE acc < {L.CATASTROPHIC}), []) AS domains_below)
SELECT round(p, 6) AS retrieval_share, round(1 - p, 6) AS abstention_share, p >= 1 - 1e-12 AS universal_retrieval, 1 - p >= 1 - 1e-12 AS universal_abstention, p >= {L.NEAR_UNIVERSAL} AS near_universal_retrieval, 1 - p >= {L.NEAR_UNIVERSAL} AS near_universal_abstention,
{_NEAR} AS single_class_collapse, len(families_below) > 0 AS structural_family_collapse, len(domains_below) > 0 AS domain_specific_collapse, families_below, domains_below, NOT ({_NEAR}) AND len(families_below) = 0 AND len(domains_below) = 0 AS passed FROM f, lo""")
def anti_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """The policy's flags; languages stand for domains."""
    r = framed(spark, sf)
    x = X.anti_collapse(M.decision_metrics(r), M.breakdown(r, "family", "lang"), domain="lang")
    return x.withColumns({c: F.round(c, 6) for c in ("retrieval_share", "abstention_share")})


@query(f"WITH {FRAMED}, fm AS (SELECT {FRAME} FROM pf) SELECT {', '.join(f'round({m}, 6) AS {m}' for m in MEASURED)} FROM fm")
def frame_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.frame_metrics(framed(spark, sf)).select(*(F.round(m, 6).alias(m) for m in MEASURED))


_BOUNDS = ", ".join(f"('{k[:-4]}', {k.endswith('_min')}, {v}::DOUBLE)" for k, v in L.THRESHOLDS["ev_b"]["frame"].items())
FRAME_CHECKS = f"""SELECT 'ev_b' AS stage, metric, round(measured, 6) AS measured, bound, CASE WHEN least THEN measured >= bound ELSE measured <= bound END AS passed
FROM (SELECT unnest([{', '.join(f"'{m}'" for m in MEASURED)}]) AS metric, unnest([{', '.join(MEASURED)}]) AS measured FROM (SELECT {FRAME} FROM pf)) m JOIN (VALUES {_BOUNDS}) t(metric, least, bound) USING (metric)"""


@query(f"WITH {FRAMED} {FRAME_CHECKS}")
def frame_checks(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame_checks(M.frame_metrics(framed(spark, sf))).withColumn("measured", F.round("measured", 6))


_FLOORS = ", ".join(f"('ev_b', '{f}', {v}::DOUBLE)" for f, v in L.THRESHOLDS["ev_b"]["structural"].items()) + "".join(f", ('ev_c', '{f}', {L.CATASTROPHIC}::DOUBLE)" for f in L.THRESHOLDS["ev_b"]["structural"])
FLOOR_CHECKS = f"""SELECT stage, family AS value, round(acc, 6) AS decision_accuracy, bound, acc >= bound AS passed
FROM (SELECT family, (hit_1 * answerable + (1 - false_retrieval) * no_evidence) / n AS acc FROM (SELECT family, {DECISIONS} FROM pf GROUP BY family)) JOIN (VALUES {_FLOORS}) t(stage, family, bound) USING (family)"""


def _floors(rows: DataFrame) -> DataFrame:
    groups = M.breakdown(rows, "family")
    by = [X.structural_checks(groups, s).withColumn("stage", F.lit(s)) for s in L.THRESHOLDS]
    return by[0].unionByName(by[1])


@query(f"WITH {FRAMED} {FLOOR_CHECKS}")
def structural_floors(spark: SparkSession, sf: str) -> DataFrame:
    return _floors(framed(spark, sf)).select("stage", "value", F.round("decision_accuracy", 6).alias("decision_accuracy"), "bound", "passed")


@query(f"""WITH {FRAMED}, ck AS (SELECT stage, passed FROM ({SQL['threshold_checks']}) UNION ALL SELECT stage, passed FROM ({FRAME_CHECKS}) UNION ALL SELECT stage, passed FROM ({FLOOR_CHECKS})),
g AS (SELECT NOT EXISTS (SELECT 1 FROM r WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS integrity, (SELECT passed FROM ({SQL['anti_collapse']})) AS collapse), st AS (SELECT stage, bool_and(passed) AS performance FROM ck GROUP BY stage)
SELECT stage, integrity, collapse, performance, CASE WHEN NOT integrity THEN 'INVALID' WHEN NOT collapse THEN 'FAIL_COLLAPSE' WHEN performance THEN 'PASS' ELSE 'FAIL_PERFORMANCE' END AS decision FROM st, g""")
def stage_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Integrity: no result comes from outside the documents."""
    hits, gold = found(spark, sf)
    rows = framed(spark, sf, hits, gold)
    one = M.decision_metrics(rows)
    checks = [X.aggregate_checks(one), X.frame_checks(M.frame_metrics(rows)), _floors(rows)]
    outside = hits.join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti").agg((F.count("*") == 0).alias("passed"))
    passed = [c.select("stage", "passed") for c in checks]
    return X.stage_decisions(passed[0].unionByName(passed[1]).unionByName(passed[2]), outside, X.anti_collapse(one, M.breakdown(rows, "family", "lang"), domain="lang"))


# The smallest or largest difference that a deeper ranking may make to a metric.
LIMITS = {"answerable_recall": ("min", 0.01), "hit_1": ("min", 0.0), "false_retrieval": ("max", 0.0), "abstention_correct": ("min", 0.05)}


@query(f"""WITH {BM25}, {GOLD}, {_results('a', 'r', 1)}, {_results('b', 'r', 5)}, da AS (SELECT {DECISIONS} FROM a), db AS (SELECT {DECISIONS} FROM b),
gd AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, round(db.{m} - da.{m}, 9) AS difference, {b}::DOUBLE AS bound, {kind == 'min'} AS least FROM da, db" for m, (kind, b) in LIMITS.items())})
SELECT metric, round(difference, 6) AS difference, bound, CASE WHEN least THEN difference >= bound ELSE difference <= bound END AS passed FROM gd""")
def guardrail_checks(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 cut at depth 5 against depth 1."""
    hits, gold = found(spark, sf)
    hits = hits.select(F.col("item_id").alias("case_id"), "rank", F.col("doc_id").alias("id"))
    cases = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"))
    gold = gold.select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("id"))
    one, five = (M.decision_metrics(M.per_case(cases, h, gold)) for h in (hits.where("rank = 1"), hits))
    return X.guardrail_checks(one, five, LIMITS).withColumn("difference", F.round("difference", 6))


STRESS = """ms AS (SELECT lang AS dimension, avg((quality = 1)::INT) AS before, avg((toxic = 0)::INT) AS after, count(*) AS reserve FROM labels JOIN documents USING (doc_id) GROUP BY lang),
sd AS (SELECT *, CASE WHEN reserve < 100 THEN 'insufficient_reserve_not_testable' WHEN before > 0.98 THEN 'saturated_not_testable' ELSE 'testable' END AS kind,
CASE WHEN reserve < 100 THEN true WHEN before > 0.98 THEN after + 1e-12 >= before ELSE after - before >= 0.01 - 1e-12 END AS passed FROM ms)"""


def _dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as dimensions: the share of good documents before, of harmless ones after."""
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("dimension")), "doc_id")
    return X.stress_dimensions(x.groupBy("dimension").agg(F.avg((F.col("quality") == 1).cast("int")).alias("before"), F.avg((F.col("toxic") == 0).cast("int")).alias("after"), F.count("*").alias("reserve")))


@query(f"WITH {STRESS} SELECT dimension, round(before, 6) AS before, round(after, 6) AS after, reserve, kind, passed FROM sd")
def stress_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return _dimensions(spark, sf).withColumns({"before": F.round("before", 6), "after": F.round("after", 6)})


@query(f"WITH {STRESS} SELECT count(*) FILTER (kind = 'testable') AS testable, coalesce(bool_and(passed), true) AND count(*) FILTER (kind = 'testable') >= 4 AS passed FROM sd")
def stress_gate(spark: SparkSession, sf: str) -> DataFrame:
    return X.stress_passes(_dimensions(spark, sf))


AUD = f"""h AS (SELECT text FROM benchmark), hg AS (SELECT DISTINCT unnest({S.grams('k')}) AS g FROM (SELECT {S.audit('text')} AS k FROM h)), own AS (SELECT doc_id, unnest({S.grams('k')}) AS g FROM (SELECT doc_id, {S.audit('text')} AS k FROM documents)),
cv AS (SELECT doc_id, count(*) AS n, count(hg.g)::DOUBLE / count(*) AS coverage FROM own LEFT JOIN hg USING (g) GROUP BY doc_id),
fl AS (SELECT doc_id, trim(text) <> '' AND trim(text) IN (SELECT trim(text) FROM h) AS exact, {S.norm('text')} <> '' AND {S.norm('text')} IN (SELECT {S.norm('text')} FROM h) AS normalised, coalesce(coverage, 0) AS coverage,
  coalesce(n >= 2 AND coverage >= {A.COVERAGE}, false) AS gram_material, regexp_matches(text, '{L.NAMESPACE}', 'i') AS namespace, {S.skeleton(S.audit('text'))} <> '' AND {S.skeleton(S.audit('text'))} IN (SELECT {S.skeleton(S.audit('text'))} FROM h) AS skeleton
  FROM documents LEFT JOIN cv USING (doc_id)), ff AS (SELECT *, exact OR normalised OR gram_material OR namespace AS material FROM fl)"""


@query(f"WITH {AUD} SELECT doc_id, exact, normalised, round(coverage, 6) AS coverage, gram_material, namespace, skeleton, material FROM ff")
def contamination_audit(spark: SparkSession, sf: str) -> DataFrame:
    return A.audit(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id").withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {AUD} SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({c}) AS n_{c}' for c in ('exact', 'normalised', 'gram_material', 'namespace', 'skeleton', 'material'))},
CASE WHEN count(*) FILTER (material) = 0 THEN 'PASS_NO_MATERIAL_CONTAMINATION' ELSE 'MATERIAL_CONTAMINATION_FOUND' END AS status, sha256(coalesce(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR) FILTER (material), '')) AS digest FROM ff""")
def contamination_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.audit_summary(A.audit(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id"), "doc_id")


def _relations(x: str) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({S.fold(x)}, '(^|[^A-Za-z0-9_-])({'|'.join(n)})([^A-Za-z0-9_-]|$)') THEN '{r}' END" for r, n in sorted(L.RELATIONS.items()))
    return f"list_filter([{tests}], lambda v: v IS NOT NULL)"


def _anchors(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({x}, '{L.SUBJECT}'), lambda a, i: NOT list_contains({S.listed(G.GENERIC_STEMS)}, {S.stem('lower(a)')}) AND (regexp_matches(a, '[0-9-]') OR (regexp_matches(a, '^[A-Z]') AND i > 1))), lambda a: lower(a))))"


def _hits(stems: str, names) -> str:
    return f"list_has_any({stems}, {S.listed(L.stems_of(names))})"


def _scope(scope: str | None = None) -> str:
    low = S.stem(f"lower({scope})") if scope else None
    head = f"WHEN list_contains({S.listed(L.stems_of(L.STALE))}, {low}) THEN 'STALE' WHEN list_contains({S.listed(L.stems_of(L.CURRENT))}, {low}) THEN 'CURRENT'" if scope else ""
    return f"CASE {head} WHEN {_hits('st', L.STALE)} THEN 'STALE' WHEN {_hits('st', L.CURRENT)} OR {_hits('st', L.RESOLUTION)} THEN 'CURRENT' ELSE 'UNSPECIFIED' END"


def _role(k: int) -> str:
    out = []
    for r in L.ROLE_PATTERNS:
        pattern = "|".join(f"(?:{p})" for p in r[2])
        extra = f" OR {_hits('st', L.INFERENCE)}" if r[0] == "UNRESOLVED" else ""
        out.append(f"WHEN regexp_matches(text, '(?i){pattern}'){extra} THEN '{r[k]}'")
    return f"CASE {' '.join(out)} ELSE '{('ASSERTION', 'UNKNOWN')[k]}' END"


def _slot(pattern: str, at: dict[str, int]) -> str:
    p = pattern.replace("'", "''")
    get = {k: f"regexp_extract(text, '{p}', {g})" for k, g in at.items()}
    quotes = G.QUOTES.replace("'", "''")
    value = rf"replace(lower(regexp_replace(trim(trim({get['value']}, chr(9) || chr(10) || chr(12) || chr(13) || ' '), '{quotes}'), '[ \t\n\r\f\x0B]+', ' ', 'g')), 'ß', 'ss')"
    return f"struct_pack(subject := lower({get['subject']}), predicate := {G.RELATION_OF.format(x='lower(' + get['relation'] + ')')}, value := {value}, scope := {get.get('scope', chr(39) * 2)})"


EVIDENCE = f"""e0 AS (SELECT *, {S.stems(S.tokens('text'))} AS st, {_relations('query')} AS asked, {_anchors('query')} AS names, {_relations('text')} AS own FROM av),
e1 AS (SELECT *, {_role(0)} AS drole, {_role(1)} AS dkind, list_filter([{', '.join(_slot(p, a) for p, a in L.assertion_patterns())}], lambda s: s.value <> '' AND s.predicate IS NOT NULL AND (len(asked) = 0 OR list_contains(asked, s.predicate)) AND (len(names) = 0 OR list_contains(names, s.subject)))[1] AS slot FROM e0),
ev AS (SELECT *, drole = 'ASSERTION' AND slot IS NOT NULL AS parsed, list_filter(asked, lambda r: list_contains(own, r)) AS shared FROM e1),
evd AS (SELECT case_id, category, query, pos, memory_id, text, ts, relevant, CASE WHEN drole = 'ASSERTION' AND NOT parsed THEN 'UNKNOWN' ELSE drole END AS role, CASE WHEN parsed THEN 'ASSERTED_VALUE' ELSE dkind END AS assertion_type,
  CASE WHEN parsed THEN slot.subject WHEN drole <> 'ASSERTION' THEN list_filter(names, lambda a: contains({S.fold('text')}, a))[1] END AS subject, CASE WHEN parsed THEN slot.predicate WHEN drole <> 'ASSERTION' AND len(shared) = 1 THEN shared[1] END AS predicate,
  CASE WHEN parsed THEN slot.value END AS value, CASE WHEN parsed THEN 'POSITIVE' WHEN drole = 'NEGATIVE' THEN 'NEGATIVE' ELSE 'NONE' END AS polarity, CASE WHEN parsed THEN {_scope('slot.scope')} ELSE {_scope()} END AS scope,
  CASE WHEN parsed THEN 'PARSED' WHEN drole = 'ASSERTION' THEN 'FAIL_CLOSED' ELSE 'NON_ASSERTION' END AS status, parsed AND {_hits('st', L.RESOLUTION)} AS resolving FROM ev)"""
FIELDS = "role, assertion_type, subject, predicate, value, polarity, scope, status, resolving"


_RANKED = f"{V2}, {_scored(V2_SCORE, 'v3').replace('SELECT case_id, rank', ', rk AS (SELECT case_id, rank', 1)})"
#: Cases as av and cm, and their ranking as rk: of accounts, of customers by the adversarial templates, of conversations.
ACCOUNTS = f"{ACCOUNT_SQL}, cm AS (SELECT * FROM av), {_RANKED}"
CUSTOMERS = f"{customer_sql()}, cm AS (SELECT * FROM av), {_RANKED}"
TALKS = f"{S.CASES}, av AS (SELECT case_id, '' AS category, query, pos, memory_id, text, ts, relevant FROM cm), {_RANKED}"
VERDICT = f"""{EVIDENCE}, rq AS (SELECT case_id, unnest(CASE WHEN len(r) = 0 THEN ['generic'] ELSE r END) AS requirement FROM (SELECT case_id, {_relations('min(query)')} AS r FROM av GROUP BY case_id)),
us AS (SELECT case_id, predicate, memory_id, value, scope, resolving, {S.parse_time('ts')} AS tm FROM evd WHERE (case_id, memory_id) IN (SELECT case_id, memory_id FROM rk) AND assertion_type = 'ASSERTED_VALUE' AND NOT ({_hits(S.stems(S.tokens('query')), L.CURRENT)} AND scope = 'STALE')),
cg AS (SELECT rq.case_id, requirement, memory_id, value, scope, resolving, tm FROM rq LEFT JOIN us ON rq.case_id = us.case_id AND (requirement = 'generic' OR requirement = predicate)),
lt AS (SELECT case_id, requirement, max(tm) FILTER (resolving) AS latest FROM cg GROUP BY ALL),
sg AS (SELECT case_id, requirement, CASE WHEN count(memory_id) = 0 THEN 'INSUFFICIENT' WHEN max(latest) IS NOT NULL THEN CASE WHEN count(DISTINCT value) FILTER (resolving AND tm = latest) > 1 THEN 'AMBIGUOUS' ELSE 'SUPPORTED' END
  WHEN count(DISTINCT value) FILTER (scope <> 'STALE') > 1 THEN 'CONTRADICTED' ELSE 'SUPPORTED' END AS state FROM cg JOIN lt USING (case_id, requirement) GROUP BY ALL),
sl AS (SELECT case_id, list_sort(list(DISTINCT requirement || '=' || memory_id)) AS selected FROM (SELECT cg.*, latest, coalesce(bool_or(scope <> 'STALE') OVER (PARTITION BY case_id, requirement), false) AS fresh FROM cg JOIN lt USING (case_id, requirement) WHERE memory_id IS NOT NULL)
  WHERE CASE WHEN latest IS NOT NULL THEN resolving AND tm = latest WHEN fresh THEN scope <> 'STALE' ELSE true END GROUP BY case_id),
vx AS (SELECT case_id, CASE WHEN bool_or(state = 'INSUFFICIENT') THEN 'INSUFFICIENT' ELSE coalesce(min_by(state, requirement) FILTER (state IN ('AMBIGUOUS', 'CONTRADICTED')), 'SUPPORTED') END AS verdict,
  list_sort(list(requirement)) AS requirements, coalesce(list_sort(list(requirement) FILTER (state = 'INSUFFICIENT')), []) AS missing FROM sg GROUP BY case_id),
vd AS (SELECT case_id, verdict, requirements, missing, CASE WHEN verdict = 'SUPPORTED' THEN coalesce(selected, []) ELSE [] END AS selected FROM vx LEFT JOIN sl USING (case_id))"""


def _gate(suffix: str, ranked: str, cases) -> None:
    """The four queries of the gate over a table of cases."""

    def evidence(spark: SparkSession, sf: str) -> DataFrame:
        return G.evidence(cases(spark, sf)).select("case_id", "pos", *FIELDS.split(", "))

    def coverage(spark: SparkSession, sf: str) -> DataFrame:
        c = cases(spark, sf)
        return G.coverage(c, R.v2_rank(c)).select("case_id", "requirement", "memory_id", "value", "scope", F.coalesce("resolving", F.lit(False)).alias("resolving"))

    def verdicts(spark: SparkSession, sf: str) -> DataFrame:
        c = cases(spark, sf)
        return G.verdicts(c, R.v2_rank(c))

    def ranking(spark: SparkSession, sf: str) -> DataFrame:
        return R.v6_rank(cases(spark, sf))

    sql = {
        "gate_evidence": (evidence, f"WITH {ranked}, {EVIDENCE} SELECT case_id, pos, {FIELDS} FROM evd"),
        "gate_coverage": (coverage, f"WITH {ranked}, {VERDICT} SELECT case_id, requirement, memory_id, value, scope, coalesce(resolving, false) AS resolving FROM cg"),
        "gate_verdicts": (verdicts, f"WITH {ranked}, {VERDICT} SELECT case_id, verdict, requirements, missing, selected FROM vd"),
        "rank_v6": (ranking, f"WITH {ranked}, {VERDICT} SELECT case_id, rank, memory_id, score FROM rk WHERE case_id IN (SELECT case_id FROM vd WHERE verdict = 'SUPPORTED')"),
    }
    for name, (f, text) in sql.items():
        f.__name__ = f"{name}{suffix}"
        query(text)(f)


_gate("", ACCOUNTS, account_cases)
_gate("_adversarial", CUSTOMERS, customer_cases)
_gate("_cases", TALKS, lambda spark, sf: conversation_cases(spark, sf).drop("role"))


@query(f"WITH {CUSTOMERS} SELECT case_id, rank, memory_id, score FROM rk")
def rank_v2_adversarial(spark: SparkSession, sf: str) -> DataFrame:
    return R.v2_rank(customer_cases(spark, sf))


@query(f"""WITH {BM25}, tp AS (SELECT r.item_id, d.source FROM r JOIN documents d USING (doc_id) WHERE rank = 1), wt AS (SELECT item_id, min(source) AS wanted FROM gold JOIN documents USING (doc_id) GROUP BY item_id)
SELECT count(*) AS n, round(count(*) FILTER (source = wanted) / greatest(1, count(*))::DOUBLE, 6) AS accuracy FROM tp JOIN wt USING (item_id)""".replace("tp AS", GOLD + ", tp AS", 1))
def binding_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the first result comes from the source of the item's (first) judged document."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    tops = benchmark_hits(spark, sf, 1).join(d, "doc_id").select("item_id", "source")
    wanted = judged(spark, sf).join(d, "doc_id").groupBy("item_id").agg(F.min("source").alias("wanted"))
    return M.binding_accuracy(tops.join(wanted, "item_id"), "source", "wanted").withColumn("accuracy", F.round("accuracy", 6))
