"""Checks that a ranking follows from what a ranker may see: a contract of columns, and runs that must not differ."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rankers import Ranker

#: What a ranker may see of a case: its question, and of each memory place, id, text and time.
VISIBLE = ("case_id", "query", "pos", "memory_id", "text", "ts")


def firewalled(cases: DataFrame) -> DataFrame:
    """Exactly the visible columns; one that lacks is an error."""
    lacking = [c for c in VISIBLE if c not in cases.columns]
    if lacking:
        raise ValueError(f"cases lack {', '.join(lacking)}")
    return cases.select(*VISIBLE)


def digests(ranked: DataFrame) -> DataFrame:
    """(case_id, digest, n): of each case's rows, whatever their order: hashes of rows are added up."""
    return ranked.groupBy("case_id").agg(F.sum(F.xxhash64("rank", "memory_id", "score").cast("decimal(20)")).alias("digest"), F.count("*").alias("n"))


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Cases that two rankings treat differently."""
    a, b = digests(one), digests(other).toDF("case_id", "_digest", "_n")
    same = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("n").eqNullSafe(F.col("_n"))
    return a.join(b, "case_id", "full_outer").where(~same).select("case_id")


def mutation_replay(ranker: Ranker, cases: DataFrame, changed: Mapping[str, Column], k: int = 5) -> DataFrame:
    """Cases whose ranking changes when columns that no ranker may use are changed (``changed``); none if it keeps the contract."""
    hidden = [c for c in changed if c in VISIBLE]
    if hidden:
        raise ValueError(f"rankers may use {', '.join(hidden)}")
    return differences(ranker(cases, k), ranker(cases.withColumns(dict(changed)), k))


def first_cases(cases: DataFrame, n: int) -> DataFrame:
    """The rows of the first n cases by id: what is run again to see that it gives the same."""
    return cases.join(cases.select("case_id").distinct().orderBy("case_id").limit(n), "case_id", "left_semi")


def determinism_replay(ranker: Ranker, cases: DataFrame, n: int, k: int = 5) -> DataFrame:
    """Of the first n cases those whose ranking differs when their rows arrive in another order and number of partitions."""
    some = first_cases(cases, n)
    return differences(ranker(some, k), ranker(some.repartition(3, "memory_id"), k))
