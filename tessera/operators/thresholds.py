"""Table-driven gates: measured values against least and most bounds, collapse flags, decisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L

#: Names of the measured aggregates in the threshold tables.
NAMES = {"MRR": "mrr", "R@1": "hit_1", "R@3": "hit_3", "R@5": "hit_5", "answerable_recall": "answerable_recall", "false_abstention_rate": "false_abstention", "false_retrieval_rate": "false_retrieval", "abstention_accuracy": "abstention_correct", "eligible_rank1_accuracy": "hit_1"}


def bounds(spark: SparkSession, section: str = "aggregate") -> DataFrame:
    """(stage, metric, least, bound): a name that ends in neither _min nor _max isn't a bound."""
    rows = [(stage, k[:-4], k.endswith("_min"), float(v)) for stage, t in L.THRESHOLDS.items() for k, v in t[section].items() if k.endswith(("_min", "_max"))]
    return spark.createDataFrame(rows, "stage string, metric string, least boolean, bound double")


def check(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured (metric, measured) against limits: one row for each bound, with passed. A bound without a measurement is an error."""
    ok = F.when(F.col("least"), F.col("measured") >= F.col("bound")).otherwise(F.col("measured") <= F.col("bound"))
    x = limits.join(measured, "metric", "left")
    known = F.coalesce("measured", F.raise_error(F.concat(F.lit("no measurement of "), "metric")).cast("double"))
    return x.withColumn("measured", known).select("stage", "metric", "measured", "bound", ok.alias("passed"))


def unpivoted(one: DataFrame, names: Mapping[str, str] = NAMES) -> DataFrame:
    """A single row of metrics as (metric, measured)."""
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("measured")) for n, c in names.items()))).alias("m")).select("m.*")


def aggregate_checks(one: DataFrame) -> DataFrame:
    return check(unpivoted(one), bounds(one.sparkSession))


def frame_checks(one: DataFrame) -> DataFrame:
    """Frame metrics, one row, against the bounds of the stages that have any."""
    return check(unpivoted(one, {c: c for c in one.columns}), bounds(one.sparkSession, "frame"))


def structural_checks(groups: DataFrame, stage: str = "ev_b") -> DataFrame:
    """(value, decision_accuracy, bound, passed) of the family axis: its own floor, or the catastrophic one."""
    floors = L.THRESHOLDS[stage]["structural"]
    floor = F.lit(L.CATASTROPHIC) if not floors else F.coalesce(*(F.when(F.col("value") == f, F.lit(float(v))) for f, v in floors.items()))
    return groups.where("axis = 'family'").select("value", "decision_accuracy", floor.alias("bound")).where("bound is not null").withColumn("passed", F.col("decision_accuracy") >= F.col("bound"))


def anti_collapse(one: DataFrame, groups: DataFrame, family: str = "family", domain: str = "domain") -> DataFrame:
    """One row: shares of cases with and without a result, the seven collapse flags, families and domains below the
    catastrophic floor, and passed. groups: a breakdown with the axes ``family`` and ``domain``."""
    share = (F.col("answerable") * (1 - F.col("false_abstention")) + F.col("no_evidence") * F.col("false_retrieval")) / F.greatest(F.lit(1), F.col("n"))
    low = lambda axis: F.sort_array(F.collect_list(F.when((F.col("axis") == axis) & (F.col("decision_accuracy") < L.CATASTROPHIC), F.coalesce("value", F.lit("none")))))
    below = groups.agg(low(family).alias("families_below"), low(domain).alias("domains_below"))
    x = one.select(share.alias("retrieval_share")).join(F.broadcast(below))  # one row each
    p = F.col("retrieval_share")
    x = x.withColumns({"abstention_share": 1 - p, "universal_retrieval": p >= 1 - 1e-12, "universal_abstention": 1 - p >= 1 - 1e-12, "near_universal_retrieval": p >= L.NEAR_UNIVERSAL, "near_universal_abstention": 1 - p >= L.NEAR_UNIVERSAL})
    x = x.withColumns({"single_class_collapse": F.col("near_universal_retrieval") | F.col("near_universal_abstention"), "structural_family_collapse": F.size("families_below") > 0, "domain_specific_collapse": F.size("domains_below") > 0})
    failed = F.col("universal_retrieval") | F.col("universal_abstention")
    for f in ("single_class_collapse", "structural_family_collapse", "domain_specific_collapse"):
        failed = failed | F.col(f)
    return x.withColumn("passed", ~failed)


def guardrail_checks(left: DataFrame, right: DataFrame, limits: Mapping[str, tuple[str, float]]) -> DataFrame:
    """(metric, difference, bound, passed): right minus left, a row of decision metrics each, against ('min' or 'max', bound)."""
    rows = [(m, kind == "min", float(b)) for m, (kind, b) in limits.items()]
    names = {m: m for m in limits}
    both = unpivoted(left, names).join(unpivoted(right, names).withColumnRenamed("measured", "then"), "metric").join(F.broadcast(left.sparkSession.createDataFrame(rows, "metric string, least boolean, bound double")), "metric")
    off = F.round(F.col("then") - F.col("measured"), 9)
    return both.select("metric", off.alias("difference"), "bound", F.when(F.col("least"), off >= F.col("bound")).otherwise(off <= F.col("bound")).alias("passed"))


def stress_dimensions(measured: DataFrame, reserve: int = 100, saturated: float = 0.98, gain: float = 0.01) -> DataFrame:
    """measured (dimension, before, after, reserve) with kind and passed: too few cases, saturated, or to gain by at least ``gain``."""
    few, full = F.col("reserve") < reserve, F.col("before") > saturated
    kind = F.when(few, "insufficient_reserve_not_testable").when(full, "saturated_not_testable").otherwise("testable")
    ok = F.when(few, True).when(full, F.col("after") + 1e-12 >= F.col("before")).otherwise(F.col("after") - F.col("before") >= gain - 1e-12)
    return measured.withColumns({"kind": kind, "passed": ok})


def stress_passes(dimensions: DataFrame, least: int = 4) -> DataFrame:
    """One row: how many dimensions are testable, and whether they suffice and none fails."""
    n = F.count_if(F.col("kind") == "testable")
    return dimensions.agg(n.alias("testable"), (F.coalesce(F.bool_and("passed"), F.lit(True)) & (n >= least)).alias("passed"))


def stage_decisions(checks: DataFrame, integrity: DataFrame, collapse: DataFrame) -> DataFrame:
    """(stage, integrity, collapse, performance, decision) of checks (stage, passed) and two tables of one row with passed."""
    x = checks.groupBy("stage").agg(F.bool_and("passed").alias("performance"))
    x = x.join(F.broadcast(integrity.select(F.col("passed").alias("integrity")))).join(F.broadcast(collapse.select(F.col("passed").alias("collapse"))))  # one row each
    label = F.when(~F.col("integrity"), "INVALID").when(~F.col("collapse"), "FAIL_COLLAPSE").when(F.col("performance"), "PASS").otherwise("FAIL_PERFORMANCE")
    return x.select("stage", "integrity", "collapse", "performance", label.alias("decision"))


def decide(integrity: bool, collapse: bool, performance: bool) -> str:
    """The label of a stage: integrity first, then collapse, then performance."""
    if not integrity:
        return "INVALID"
    if not collapse:
        return "FAIL_COLLAPSE"
    return "PASS" if performance else "FAIL_PERFORMANCE"


def integrity_gate(violations: dict[str, int], cases: int, expected: int = 384) -> bool:
    """No violation of any kind, and as many cases as there must be."""
    return not any(violations.values()) and cases == expected


def guardrails(left: dict[str, float], right: dict[str, float], limits: dict[str, tuple[str, float]]) -> dict[str, bool]:
    """Differences right - left against ('min' or 'max', bound), by metric."""
    return {m: (right[m] - left[m] >= b) if kind == "min" else (right[m] - left[m] <= b) for m, (kind, b) in limits.items()}


def freshness(stage: str, digests: dict[str, str], expected: dict[str, str], audit_status: str, contaminated: int) -> dict[str, bool]:
    """A stage's selection is the expected one, differs from the other stages' and comes from clean data."""
    out = {"matches": digests[stage] == expected[stage], "distinct": all(digests[stage] != d for s, d in expected.items() if s != stage), "clean": audit_status == "PASS_NO_MATERIAL_CONTAMINATION" and contaminated == 0}
    return out | {"pass": all(out.values())}


def summary(parts: dict[str, dict | None]) -> dict[str, object]:
    """Statuses of optional results, by name; missing ones are None."""
    return {k: (v or {}).get("status") for k, v in parts.items()}
