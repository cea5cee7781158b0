"""Stratified samples of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import flags as X
from tessera.operators import sampling as P
from tessera.plans.q_ops import bases
from tessera.plans.registry import query

SOURCES = {f"src{k}": 3 for k in range(20)}
DOMAINS = {"D1": 30, "D2": 12, "D3": 10, "D4": 8}
FAMILIES = {"n2": 4, "n3": 12, "n4": 12, "n11": 8, "n12": 12, "n10": 12}


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return X.all_flags(bases(spark, sf), whole=True).select(F.col("id").cast("string").alias("id"), "source", "domain", *FAMILIES, X.stress_count().alias("stress"))


@query()
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A flow decides, so there is no SQL; the tests check the quotas."""
    return P.without_evidence(P.draw(cases(spark, sf), FAMILIES, SOURCES, DOMAINS, "ev_a"), 24)


@query()
def disjoint_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Two samples of half the size, one after the other."""
    half = [{k: v // 2 for k, v in q.items()} for q in (FAMILIES, DOMAINS)]
    sources = {k: v for (k, v), _ in zip(({s: 3 for s in SOURCES}).items(), range(10), strict=False)}
    got = P.stages(cases(spark, sf), [("ev_a", half[0], sources, half[1]), ("ev_b", half[0], sources, half[1])])
    return got[0].unionByName(got[1])
