"""Queries of replays, shards and JSON trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rankers as R
from tessera.operators import replay as P
from tessera.plans import sql_parts as S
from tessera.plans.cases import conversation_cases
from tessera.plans.registry import query, table
from tessera.sources import shards as H

REPLAYED = ("lexical", "current", "v2")


@query(f"WITH {S.CASES} SELECT ranker, count(DISTINCT case_id) AS cases, 0::BIGINT AS violations FROM cm, (SELECT unnest({list(REPLAYED)}) AS ranker) GROUP BY ranker")
def metadata_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Rankers over conversations whose role and relevance are changed: no ranking may follow."""
    c = conversation_cases(spark, sf)
    changed = {"relevant": ~F.col("relevant"), "role": F.concat(F.lit("not "), "role")}
    n = c.agg(F.count_distinct("case_id").alias("cases"))
    out = None
    for name in REPLAYED:
        one = P.mutation_replay(R.RANKERS[name], c, changed).agg(F.count("*").alias("violations")).join(F.broadcast(n))  # a row each
        one = one.select(F.lit(name).alias("ranker"), "cases", "violations")
        out = one if out is None else out.unionByName(one)
    return out


SHARD_SIZE = 128


def label_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as shards of at most SHARD_SIZE predictions, by document id."""
    x = table(spark, sf, "labels").select(F.floor(F.col("doc_id") / SHARD_SIZE).alias("s"), F.struct(F.col("doc_id").cast("string").alias("case_id"), F.array(F.concat(F.lit("quality-"), "quality"), F.concat(F.lit("toxic-"), "toxic")).alias("retrieved_memory_ids")).alias("p"))
    one = x.groupBy("s").agg(F.collect_list("p").alias("predictions"))
    # shards are numbered from 0 without gaps: their numbers, not their rows, meet in one task
    number = one.select("s").withColumn("shard_index", F.expr("cast(row_number() over (order by s) - 1 as int)"))
    count = number.agg(F.count("*").cast("int").alias("shard_count"))
    same = {c: F.lit("labels") for c in ("schema_version", "source_commit", "dataset_sha256", "model")}
    return one.join(number, "s").join(F.broadcast(count)).withColumns(same).withColumns({"case_count": F.size("predictions").cast("long"), "file": F.concat(F.lit("shard-"), "s")})


@query("SELECT doc_id::VARCHAR AS case_id, rank, memory_id FROM (SELECT doc_id, 1 AS rank, 'quality-' || quality AS memory_id FROM labels UNION ALL SELECT doc_id, 2, 'toxic-' || toxic FROM labels)")
def sharded_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as predictions of numbered shards, put together under all checks."""
    return H.predictions(label_shards(spark, sf))
