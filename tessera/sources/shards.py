"""Predictions that several runs wrote as shards: one JSON object a file, checked as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARD = "schema_version string, source_commit string, dataset_sha256 string, model string, shard_index int, shard_count int, case_count long, predictions array<struct<case_id string, retrieved_memory_ids array<string>>>"
#: What all shards of one run have in common.
COMMON = ("schema_version", "source_commit", "dataset_sha256", "model", "shard_count")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder, with the file that each comes from."""
    return spark.read.schema(SHARD).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_path"))


def manifest(shards: DataFrame) -> DataFrame:
    """(file, shard_index, shard_count, case_count, n, first, last): what each file says of itself, and what it holds."""
    ids = F.transform("predictions", lambda p: p["case_id"])
    return shards.select("file", "shard_index", "shard_count", "case_count", F.size("predictions").alias("n"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"))


def predictions(shards: DataFrame) -> DataFrame:
    """(case_id, rank, memory_id) of all shards. The plan raises an error where a shard doesn't hold as many cases as it says, shards
    of a run differ in what they must share, a number is missing or twice there, or a case stands in two places."""
    whole = Window.partitionBy()  # one row for each file; the predictions don't pass here
    said = shards.select("file", "shard_index", "shard_count", "case_count", F.size("predictions").alias("n"), F.struct(*COMMON).alias("common"))
    counted = said.withColumns({"files": F.count("*").over(whole), "numbers": F.size(F.collect_set("shard_index").over(whole)), "runs": F.size(F.collect_set(F.to_json("common")).over(whole))})
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.col("file"))).cast("boolean")
    ok = (
        F.when(F.col("n") != F.col("case_count"), fail("another number of cases than stated in "))
        .when(F.col("runs") > 1, fail("shards of different runs, one of them "))
        .when((F.col("files") != F.col("shard_count")) | (F.col("numbers") != F.col("shard_count")) | ~F.col("shard_index").between(0, F.col("shard_count") - 1), fail("shards are missing or repeated, seen at "))
        .otherwise(F.lit(True))
    )
    sound = counted.where(ok).select("file")
    each = shards.join(sound, "file").select("file", F.explode("predictions").alias("p")).select("file", "p.*")
    twice = F.when(F.count("*").over(Window.partitionBy("case_id")) > 1, F.raise_error(F.concat(F.lit("predicted twice: "), F.col("case_id"))).cast("boolean")).otherwise(F.lit(True))
    return each.where(F.col("case_id").isNotNull()).withColumn("_ok", twice).where("_ok").select("case_id", F.posexplode("retrieved_memory_ids").alias("rank", "memory_id")).select("case_id", (F.col("rank") + 1).alias("rank"), "memory_id")
