"""A training-data pipeline over documents: five stages, each one of the operators of tessera.llm.

Every stage takes (spark, docs, sf_dir) and returns the rows that it keeps with all columns of documents;
the last one adds the shard. Null and empty texts, repeated rows and extra columns are treated as the
stage's operator says; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._pack import fresh, written
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.mixing import ADDED, mixed
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.quality import keep_good
from tessera.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier takes for good; null and empty texts go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five words, 0.8).

    Of rows that repeat a doc_id with its text the one with the smallest other columns stays (any of them if these
    can't be ordered). Rows with a null doc_id are linked with nothing and stay.
    """
    rows = near_duplicates(docs).where("kept and doc_id is not null")
    own, n = fresh(docs, "doc"), fresh(docs, "n")
    kept = rows.groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(n)).hint("merge")
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col(own))
    once = named.where(F.col(n) == 1).select(*docs.columns)
    # texts are sorted and compared only for ids that repeat
    many = named.where(F.col(n) > 1).select(*docs.columns)
    rest = [f.name for f in docs.schema if f.name not in ("doc_id", "text")]
    if rest and "map<" not in docs.select(*rest).schema.simpleString():
        least = fresh(docs, "rest")
        many = many.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias(least)).select("doc_id", "text", f"{least}.*").select(*docs.columns)
    else:
        many = many.dropDuplicates(["doc_id", "text"])
    return once.unionByName(many).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have tempered shares of sources, languages and topics. Columns named as what the operator adds come back unchanged."""
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
    aside = {c: fresh(docs, f"own_{c.lower()}") for c in docs.columns if c.lower() in ADDED}
    kept = mixed(docs.select(*(F.col(q).alias(aside.get(c, c)) for c, q in quoted.items()))).where("mix_kept")
    return kept.select(*(F.col(aside.get(c, q)).alias(c) for c, q in quoted.items()))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their slot and shard."""
    return assign_shards(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: A trained scorer can't be written in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
