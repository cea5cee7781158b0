"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are added up to cells (source, language, topic) of tokens. Raking multiplies the cells' factors
until the tokens of every source, language and topic have their target shares, one dimension after the
other, sweep by sweep; the cells stay a distributed table. The factors, divided by the largest, are the
probabilities with which documents are kept, so that the expected tokens have the target shares; a hash of
the doc_id decides, so the sample doesn't depend on partitions.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._pack import written

#: A dimension's default target is its share of tokens to this power, made to sum to 1.
TEMPER = 0.95
TOLERANCE = 1e-9
SWEEPS = 100
#: Cells up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
ADDED = (*(f"mix_{d}" for d in DIMENSIONS), "mix_tokens", "mix_keep", "mix_kept")


def form_of(text: Column) -> Column:
    """The default topic, from the form of a text: records, tables, long prose or prose."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.rlike("[0-9]{4}"), "records").when(t.contains("|"), "tables").when(F.length(t) >= 4000, "long prose").otherwise("prose")


def uniform_of(key: Column, salt: str) -> Column:
    """A number in [0, 1) from a hash of key."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(salt))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """cells (source, lang, topic, tokens) with factor and keep, the probability; targets: shares by dimension and value.

    Values that a given target doesn't name get none of it, so their documents go. Without cells, no rows.
    Targets that can't be met together (a named value without cells, for instance) don't converge: after SWEEPS
    a warning tells the largest relative distance from a target, and the last factors hold.
    """
    now = cells.where("tokens > 0")
    for d in DIMENSIONS:
        if targets and d in targets:
            named = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv]) if targets[d] else F.lit(None)
            goal = F.coalesce(named[F.col(d)], F.lit(0.0))
        else:
            goal = F.pow(F.sum("tokens").over(Window.partitionBy(d)).cast("double"), F.lit(temper))
        now = now.withColumn(f"goal_{d}", goal)
    for d in DIMENSIONS:
        sums = now.groupBy(d).agg(F.first(f"goal_{d}").alias("g")).agg(F.sum("g").alias(f"all_{d}"))
        now = now.join(F.broadcast(sums))  # one row
    now = now.select(*DIMENSIONS, "tokens", *((F.col(f"goal_{d}") / F.nullif(F.col(f"all_{d}"), F.lit(0.0))).alias(f"goal_{d}") for d in DIMENSIONS), F.lit(1.0).alias("factor"))
    now = written(now, "raking")
    for _ in range(SWEEPS):
        step, worst = now.withColumn("off", F.lit(0.0)), F.lit(0.0)
        everything = now.agg(F.sum("tokens").cast("double").alias("everything"))
        step = step.join(F.broadcast(everything))  # one row
        for d in DIMENSIONS:
            have = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(d)) / F.col("everything")
            step = step.withColumn("ratio", F.col(f"goal_{d}") / F.nullif(have, F.lit(0.0)))
            step = step.withColumn("off", F.greatest("off", F.abs(F.coalesce("ratio", F.lit(1.0)) - 1))).withColumn("factor", F.col("factor") * F.coalesce("ratio", F.lit(0.0)))
        now = written(step.drop("everything", "ratio"), "raking")
        worst = now.agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
        now = now.drop("off")
    else:
        warnings.warn(f"raking ended after {SWEEPS} sweeps at a relative distance of {worst:.3g} from its targets", stacklevel=2)
    top = now.agg(F.max("factor").alias("top"))
    return now.join(F.broadcast(top)).select(*DIMENSIONS, "tokens", "factor", F.coalesce(F.col("factor") / F.nullif("top", F.lit(0.0)), F.lit(0.0)).alias("keep"))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, salt: str = ":mix") -> DataFrame:
    """docs, all columns (those of the following names, in any case, are replaced), with mix_source, mix_lang, mix_topic, mix_tokens (words), mix_keep (probability), mix_kept.

    Null sources, languages and topics are values of their own, written as an empty text. Null and empty
    texts have no tokens: they weigh nothing and are dropped (probability 0) if no other document of the
    cell has tokens, else sampled like the cell's other documents. Rows that repeat a doc_id are kept or
    dropped together; a null doc_id counts as an empty text. An empty table gives no rows.
    """
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in ADDED]  # names differ by more than case, and may hold dots
    docs = docs.select(*own)
    value = {"source": F.col(source).cast("string"), "lang": F.col(lang).cast("string"), "topic": form_of(F.col(text_col)) if topic is None else topic.cast("string")}
    rows = docs.select("*", *(F.coalesce(v, F.lit("")).alias(f"mix_{d}") for d, v in value.items()), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("mix_tokens"))
    cells = rows.groupBy(*(F.col(f"mix_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("mix_tokens").alias("tokens"))
    keep = rake(written(cells, "cells"), targets, temper).select(*(F.col(d).alias(f"mix_{d}") for d in DIMENSIONS), F.col("keep").alias("mix_keep"))
    keep = written(keep, "probabilities")
    few = keep.count() <= BROADCAST_CELLS
    joined = rows.join(F.broadcast(keep) if few else keep.hint("merge"), [f"mix_{d}" for d in DIMENSIONS], "left")
    chance = F.coalesce("mix_keep", F.lit(0.0))
    return joined.select(*own, *(f"mix_{d}" for d in DIMENSIONS), "mix_tokens", chance.alias("mix_keep"), (uniform_of(F.col(id_col), salt) < chance).alias("mix_kept"))
