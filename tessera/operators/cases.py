"""Cases of selected bases: their gold memories, the decoy of their family, their source's own pool and fillers, under a budget.

A base has id, source, domain, subject, relation, implicit_relation, query, and as its detail gold and pool: arrays of
memories struct<id,text,ts>. Only selected bases ask; all bases stream past blocks of them, digests are made by
sha2 inside the join's stage, and what leaves it is one row for each asking base and decoy, or the few
fillers whose hash is below a bound that follows from the number of bases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.operators.sizes import tasks

MEMORY = "struct<id:string,text:string,ts:string>"
#: Asking bases of one block, which is the build side of a hash join.
BLOCK = 4096
#: Rows of the pool that a block of asking bases meets at once.
POOL_BLOCK = 8192
BUDGET = 20
#: Families with a decoy: columns that must be equal, and the one that must differ.
FAMILIES: dict[str, tuple[tuple[str, ...], str | None]] = {"N3": (("domain",), "subject"), "N4": (("subject",), "relation"), "N12": (("subject", "relation"), None)}


def paired(asking: DataFrame, pool: DataFrame, same: tuple[str, ...]) -> DataFrame:
    """asking with every other row of the pool that is equal in ``same``; both have an id, the pool's columns get the prefix o_.

    A group's asking rows and its rows of the pool are dealt to blocks, and each block of the one meets each of the other, so
    what a task does is bounded however large the group is. Where a group has one block of each a row travels once.
    """
    n = asking.groupBy(*same).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    n = n.join(pool.groupBy(*same).agg(F.ceil(F.count("*") / POOL_BLOCK).cast("int").alias("_others")), list(same))
    one = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = asking.join(n, list(same)).withColumn("_block", one("_blocks")).withColumn("_other", every("_others")).drop("_blocks", "_others")
    right = pool.join(n, list(same)).withColumn("_block", every("_blocks")).withColumn("_other", one("_others")).drop("_blocks", "_others")
    keys = [*same, "_block", "_other"]
    right = right.select(*(F.col(c).alias(c) for c in keys), *(F.col(c).alias(f"o_{c}") for c in pool.columns))
    parts = tasks(pool)
    return left.repartition(parts, *keys).hint("shuffle_hash").join(right.repartition(parts, *keys), keys).where(F.col("id") != F.col("o_id")).drop("_block", "_other")


def first_gold(bases: DataFrame) -> DataFrame:
    """What bases are to others: their first gold memory, by its id, with the print of its text."""
    gold = F.get("gold", F.lit(0))
    return bases.where(F.size("gold") > 0).select("id", "source", "domain", "subject", "relation", gold["id"].alias("memory_id"), printed(gold["text"]).alias("print"))


def printed(text: Column) -> Column:
    return F.sha2(T.norm(text), 256)


def decoys(asking: DataFrame, bases: DataFrame) -> DataFrame:
    """(id, decoy) of asking bases (the columns of bases, family): the other base of their family's kind whose hash with them is lowest.

    N3: another subject of the domain; N4: another relation of the subject, not if the relation is implicit; N12: the same
    subject and relation; N9: a base of the domain whose first gold text shares more words with the query than any
    of the own gold texts does. Other families have none. A null subject or relation is an empty one.
    """
    filled = {c: F.coalesce(c, F.lit("")) for c in ("subject", "relation")}
    asking, bases = asking.withColumns(filled), bases.withColumns(filled)
    pool = first_gold(bases)
    found = []
    for family, (same, different) in FAMILIES.items():
        own = asking.where(F.col("family") == family)
        if family == "N4":
            own = own.where(~F.coalesce("implicit_relation", F.lit(False)))
        found.append(R.decoys(pool, family, list(same), different, own))
    texts = lambda x: x.where(F.size("gold") > 0).select("id", "domain", "query", F.transform("gold", lambda g: g["text"]).alias("gold"))
    found.append(R.better_decoys(texts(asking.where(F.col("family") == "N9")), texts(bases)))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def fillers(asking: DataFrame, bases: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(id, filler, memory_id, ord): for each asking base the first gold memories of other bases of its domain, in hash order, the budget's worth of different ones.

    Where asking has ``barred`` and ``barred_ids``, memories with such a print or id are left out.
    """
    pool = first_gold(bases).select("id", "source", "domain", "memory_id", "print")
    sizes = pool.groupBy("domain").agg(F.count("*").alias("_members"))
    barred = [c for c in ("barred", "barred_ids") if c in asking.columns]
    asks = asking.select("id", "domain", *barred)
    # the bound that the hash of the budget's worth is below, but for a chance of about 1e-11
    bound = F.least(F.lit(1.0), F.lit(float(budget + 8 * budget**0.5 + 16)) / F.col("_members"))
    limit = F.when(bound >= 1, F.lit("g")).otherwise(F.lower(F.lpad(F.hex((bound * 2.0**48).cast("long")), 12, "0")))

    def best(asks: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
        x = paired(asks, pool, ("domain",)).withColumn("h", T.stable_hash(F.lit("filler"), "id", "o_source", "o_id")).where(keep(F.col("h")))
        if barred:
            x = x.where(~F.coalesce(F.array_contains("barred", F.col("o_print")), F.lit(False)) & ~F.coalesce(F.array_contains("barred_ids", F.col("o_memory_id")), F.lit(False)))
        x = x.groupBy("id", F.col("o_memory_id").alias("memory_id")).agg(F.min(F.struct("h", "o_id")).alias("x"))
        place = F.row_number().over(Window.partitionBy("id").orderBy("x"))
        return x.withColumn("place", place).where(F.col("place") <= budget).select("id", F.col("x.o_id").alias("filler"), "memory_id", F.col("x.h").alias("ord"))

    near = best(asks.join(sizes.select("domain", limit.alias("limit")), "domain"), lambda h: h < F.col("limit"))
    # a base that found fewer looks at all
    full = near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= budget).select("id")
    rest = best(asks.join(full, "id", "left_anti"), lambda h: F.lit(True))
    return near.join(full, "id", "left_semi").unionByName(rest)


def materialise(bases: DataFrame, chosen: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(case_id, pos, memory_id, text, ts, priority, relevant) of chosen (id, family, no_evidence).

    In order of priority: all gold memories (0; none without evidence), the family's decoy (1), the native pool in hash order (2),
    fillers of the domain in hash order (3). A memory counts once, at its first place; of a case without evidence no memory
    has the id or the normalised text of a gold one. A chosen id without a base or gold, a case of fewer than two memories and
    one that lost gold to the budget are errors, raised by the plan.
    """
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.col("id").cast("string"))).cast("boolean")
    found = chosen.select("id", "family", "no_evidence").join(bases, "id", "left")
    asking = found.where(F.when(F.coalesce(F.size("gold"), F.lit(-1)) <= 0, fail("missing source detail for ")).otherwise(F.lit(True)))
    bar = lambda x: F.when(F.col("no_evidence"), x).otherwise(F.array().cast("array<string>"))
    asking = asking.withColumns({"barred": bar(F.transform("gold", lambda g: printed(g["text"]))), "barred_ids": bar(F.transform("gold", lambda g: g["id"]))})

    def listed(memories: str, priority: int, order: Callable[[Column, Column], Column]) -> DataFrame:
        x = asking.select("id", "no_evidence", "barred", "barred_ids", F.posexplode(memories).alias("at", "m")).where(F.col("m.id").isNotNull())
        x = x.select("*", F.lit(priority).alias("priority"), order(F.col("m.id"), F.col("at")).alias("ord"))
        return x.where(~F.array_contains("barred_ids", F.col("m.id")) & ~F.array_contains("barred", printed(F.col("m.text")))).select("id", "m", "priority", "ord")

    def fetched(x: DataFrame, other: str, priority: int, order: Column) -> DataFrame:
        memory = bases.select(F.col("id").alias(other), F.get("gold", F.lit(0)).alias("m"))
        return x.join(memory, other).select("id", "m", F.lit(priority).alias("priority"), order.alias("ord"))

    gold = listed("gold", 0, lambda _, at: F.lpad(at.cast("string"), 10, "0"))
    native = listed("pool", 2, lambda m, _: T.stable_hash(F.lit("native-pool"), "id", m))
    decoy = fetched(decoys(asking, bases), "decoy", 1, F.lit("")).join(asking.select("id", "barred", "barred_ids"), "id")
    decoy = decoy.where(~F.array_contains("barred_ids", F.col("m.id")) & ~F.array_contains("barred", printed(F.col("m.text")))).drop("barred", "barred_ids")
    rest = fetched(fillers(asking, bases, budget), "filler", 3, F.col("ord"))
    every = gold.unionByName(decoy).unionByName(native).unionByName(rest)
    once = every.groupBy("id", F.col("m.id").alias("memory_id")).agg(F.min_by(F.struct("priority", "ord", "m"), F.struct("priority", "ord")).alias("x"))
    by = Window.partitionBy("id")
    placed = once.withColumn("pos", F.row_number().over(by.orderBy("x.priority", "x.ord", "memory_id"))).where(F.col("pos") <= budget)
    counted = placed.withColumns({"_n": F.count("*").over(by), "_gold": F.count_if(F.col("x.priority") == 0).over(by)})
    wanted = asking.select("id", "no_evidence", F.size(F.array_distinct(F.transform("gold", lambda g: g["id"]))).alias("_wanted"))
    checked = wanted.join(counted, "id", "left")
    ok = F.when(F.coalesce("_n", F.lit(0)) < 2, fail("insufficient runtime memories ")).when(~F.col("no_evidence") & (F.col("_gold") < F.col("_wanted")), fail("gold dropped by budget ")).otherwise(F.lit(True))
    return checked.where(ok).select(F.col("id").alias("case_id"), "pos", "memory_id", F.col("x.m.text").alias("text"), F.col("x.m.ts").alias("ts"), F.col("x.priority").alias("priority"), (F.col("x.priority") == 0).alias("relevant"))
