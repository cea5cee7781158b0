"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 200_000


def small_or_shuffled(df: DataFrame, bound: DataFrame | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """df with a broadcast hint if it, or a table that has no fewer rows and is cheaper to count, has at most so many rows; else
    it is left to a shuffled join."""
    return F.broadcast(df) if (df if bound is None else bound).limit(most_rows + 1).count() <= most_rows else df


def once(df: DataFrame) -> DataFrame:
    """df, computed now and kept for all its uses: in the shared folder of spark.checkpoint.dir, where there is one."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", "") else df.localCheckpoint()


def tasks(df: DataFrame, a_core: int = 8) -> int:
    """Tasks for a stage whose work doesn't follow from its bytes."""
    return a_core * df.sparkSession.sparkContext.defaultParallelism
