"""Contamination audit: texts against the fingerprints of a history (exact, normalised, 12-gram, skeleton)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators.sizes import MOST_ROWS, small_or_shuffled

COVERAGE = 0.80


def tokenised(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, toks): a column of its own, so that what is built on the tokens doesn't find them anew."""
    return df.select(key, T.audit_tokens(text).alias("toks"))


def grams(df: DataFrame, key: str, text: str = "text", n: int = 12) -> DataFrame:
    """(key, g, h): distinct n-grams of audit tokens with a 64-bit hash, on which they are joined."""
    x = tokenised(df, key, text).select(key, F.explode(F.array_distinct(T.ngrams(F.col("toks"), n))).alias("g"))
    return x.withColumn("h", F.xxhash64("g"))


def gram_pairs(small: DataFrame, small_key: str, large: DataFrame, large_key: str, n: int = 12) -> DataFrame:
    """(small_key, large_key, shared): common distinct n-grams; the large side's grams aren't shuffled while the small side's fit a broadcast.

    Hashes of the large side's windows of words find the texts that can hold any; only of these are n-grams made.
    """
    s = grams(small, small_key, n=n)
    known = small_or_shuffled(s.select(F.xxhash64(F.split("g", " ")).alias("w")).distinct())
    starts = F.when(F.size("toks") >= n, F.sequence(F.lit(1), F.size("toks") - (n - 1)))
    windows = tokenised(large, large_key).select(large_key, F.explode(F.transform(starts, lambda i: F.xxhash64(F.slice("toks", i, n)))).alias("w"))
    may = windows.join(known, "w", "left_semi").select(large_key).distinct()
    both = grams(large.join(may, large_key, "left_semi"), large_key, n=n).join(small_or_shuffled(s.withColumnRenamed("g", "g2")), "h").where("g = g2")
    return both.groupBy(small_key, large_key).agg(F.count("*").alias("shared"))


def judgements(items: DataFrame, docs: DataFrame, least: float = COVERAGE) -> DataFrame:
    """(item_id, doc_id, coverage): documents that hold at least this share of an item's distinct 12-grams."""
    size = grams(items, "item_id").groupBy("item_id").agg(F.count("*").alias("n"))
    return gram_pairs(items, "item_id", docs, "doc_id").join(size, "item_id").select("item_id", "doc_id", (F.col("shared") / F.col("n")).alias("coverage")).where(F.col("coverage") >= least)


def audit(texts: DataFrame, history: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, exact, normalised, coverage, gram_material, namespace, skeleton, material) for each row of texts.

    coverage is the share of a text's 12-grams, counted with repeats, that history holds; below 2 of them it
    isn't material. All tests are semi-joins on distinct fingerprints of history.
    """
    h = history.select(F.trim(text).alias("e"), T.norm(text).alias("m"), T.skeleton(T.audit_tokens(text)).alias("s"))
    exact = small_or_shuffled(h.select(F.sha2("e", 256).alias("fe")).where("e <> ''").distinct().withColumn("exact", F.lit(True)))
    normal = small_or_shuffled(h.select(F.sha2("m", 256).alias("fm")).where("m <> ''").distinct().withColumn("normalised", F.lit(True)))
    skel = small_or_shuffled(h.select(F.sha2("s", 256).alias("fs")).where("s <> ''").distinct().withColumn("skeleton", F.lit(True)))
    own = tokenised(texts, key, text).select(key, F.explode(T.ngrams(F.col("toks"))).alias("g")).withColumn("h", F.xxhash64("g"))
    there = grams(history.withColumn("k", F.lit(0)), "k", text).select("h", "g").distinct().withColumnRenamed("g", "g2")
    if there.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        there = F.broadcast(there)
    else:  # a large history: only what the texts hold takes part in the join
        there = there.join(own.select("h").distinct(), "h", "left_semi")
    covered = own.join(there, "h", "left").groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("g") == F.col("g2")).alias("c")).select(key, "n", (F.col("c") / F.col("n")).alias("coverage"))
    x = texts.select(key, text, F.sha2(F.trim(text), 256).alias("fe"), F.sha2(T.norm(text), 256).alias("fm"), F.sha2(T.skeleton(T.audit_tokens(text)), 256).alias("fs"))
    x = x.join(exact, "fe", "left").join(normal, "fm", "left").join(skel, "fs", "left").join(covered, key, "left")
    no, zero = F.lit(False), F.lit(0.0)
    flags = x.select(key, F.coalesce("exact", no).alias("exact"), F.coalesce("normalised", no).alias("normalised"), F.coalesce("coverage", zero).alias("coverage"), F.coalesce((F.col("n") >= 2) & (F.col("coverage") >= COVERAGE), no).alias("gram_material"), F.coalesce(F.col(text).rlike(f"(?i){L.NAMESPACE}"), no).alias("namespace"), F.coalesce("skeleton", no).alias("skeleton"))
    return flags.withColumn("material", F.col("exact") | F.col("normalised") | F.col("gram_material") | F.col("namespace"))


def audit_summary(flags: DataFrame, key: str = "id") -> DataFrame:
    """One row: counters, the verdict, and the digest of the contaminated ids."""
    bad = F.when(F.col("material"), F.col(key).cast("string"))
    return flags.agg(
        F.count("*").alias("n"),
        *(F.count_if(c).alias(f"n_{c}") for c in ("exact", "normalised", "gram_material", "namespace", "skeleton", "material")),
        F.when(F.count_if("material") == 0, "PASS_NO_MATERIAL_CONTAMINATION").otherwise("MATERIAL_CONTAMINATION_FOUND").alias("status"),
        T.id_digest(bad).alias("digest"),
    )
