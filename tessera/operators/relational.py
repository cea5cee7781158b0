"""Joins, windows, set operations and digests that the evaluation is made of."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from tessera.functions import text as T
from tessera.operators.sizes import once, tasks

#: Cases and members of a pool that a block holds at most; a group's cases are dealt to some blocks as soon as they are enough for them.
CASE_BLOCK, POOL_BLOCK = 1 << 14, 1 << 11
FEW_CASES, SOME_BLOCKS = 1 << 10, 8
#: Words of cases whose shared words are counted at once.
WORD_STEP = 1 << 14


def dedup(df: DataFrame, by: Column, *identity: str) -> DataFrame:
    """For each value of by the row whose identity hashes lowest."""
    w = Window.partitionBy(by).orderBy(T.stable_hash(*identity))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_prior(df: DataFrame, keys: list[str], order: str, explicit: Column, name: str) -> DataFrame:
    """df with the latest strictly earlier order value at which explicit held, in the same group of keys."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.max(F.when(explicit, F.col(order))).over(w))


def all_resolve(refs: DataFrame, targets: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """Owners of which every reference has a target."""
    hit = refs.join(targets.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "left")
    return hit.groupBy(owner).agg(F.count("*").alias("n_refs"), F.count("_t").alias("n_found")).where("n_refs = n_found").select(owner, "n_refs")


def sole_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def _blocked(cases: DataFrame, pool: DataFrame, same: list[str]) -> PandasCogroupedOps:
    """Cases (id) and pool (decoy) equal in ``same``, cogrouped in blocks: pairs exist only inside a task, never as rows."""
    count = lambda df, name: df.groupBy(*same).agg(F.count("*").alias(name))
    parts = lambda c, size: F.ceil(F.col(c) / size)
    left_blocks = F.greatest(parts("_n", CASE_BLOCK), F.least(F.lit(SOME_BLOCKS), parts("_n", FEW_CASES)))
    n = once(count(cases, "_n").join(count(pool, "_m"), same).select(*same, left_blocks.cast("int").alias("_i"), parts("_m", POOL_BLOCK).cast("int").alias("_j")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda of, c: F.pmod(F.xxhash64(of), F.col(c)).cast("int")
    sized = lambda df: df.join(n.select(*(F.col(c).alias(c) for c in n.columns)), same)
    left = sized(cases).withColumn("_a", one("id", "_i")).withColumn("_b", every("_j")).drop("_i", "_j")
    right = sized(pool).withColumn("_a", every("_i")).withColumn("_b", one("decoy", "_j")).drop("_i", "_j")
    # few bytes are much work here: a number of tasks of its own keeps blocks from being put together by their bytes
    block = (tasks(pool), *same, "_a", "_b")
    return left.repartition(*block).groupBy(*block[1:]).cogroup(right.repartition(*block).groupBy(*block[1:]))


def _digests(start: str, ends: list[bytes]) -> list[bytes]:
    """For each end the digest of start and it, which join as in ``T.stable_hash``; start is taken in once."""
    new, out = hashlib.sha256(start.encode() + b"\x1f").copy, []
    for e in ends:
        x = new()
        x.update(e)
        out.append(x.digest())
    return out


def _sharing(asked: pa.ChunkedArray, own: list[int], golds: pa.ChunkedArray) -> Iterator[tuple[int, list[int]]]:
    """(place, places): for each case, given by its different words, the texts that share more of them than own says."""
    asked, golds = (x.combine_chunks() for x in (asked, golds))
    known = pc.unique(pc.list_flatten(asked))
    word, case, held, text = (x.to_numpy(zero_copy_only=False) for x in (pc.index_in(pc.list_flatten(asked), known), pc.list_parent_indices(asked), pc.fill_null(pc.index_in(pc.list_flatten(golds), known), -1), pc.list_parent_indices(golds)))
    text, held = text[held >= 0], held[held >= 0]
    start, lo = np.searchsorted(case, np.arange(len(own) + 1)), 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + WORD_STEP, "right")) - 1)
        here = np.unique(word[start[lo] : start[hi]])
        place = np.full(len(known), -1)
        place[here] = np.arange(len(here))
        row = place[held]
        holds = np.zeros((len(here), len(golds)), np.uint8)
        holds[row[row >= 0], text[row >= 0]] = 1
        for k in range(lo, hi):
            rows = holds[place[word[start[k] : start[k + 1]]]]
            shared = rows.sum(axis=0, dtype=np.uint8 if len(rows) < 256 else np.int32)
            found = np.flatnonzero(shared > own[k])
            if len(found):
                yield k, found.tolist()
        lo = hi


def _lists(t: pa.Table, *names: str) -> list[list]:
    return [t.column(c).to_pylist() for c in names]


def _named(df: DataFrame, same: list[str], **columns: Column) -> DataFrame:
    return df.where(F.col("id").isNotNull()).select(*(F.col(c).alias(c) for c in same), *(v.alias(k) for k, v in columns.items()))


def _ends(sources: list[str | None], ids: list) -> list[bytes]:
    return ["\x1f".join(x for x in (s, str(i)) if x is not None).encode() for s, i in zip(sources, ids, strict=True)]


def decoys(base: DataFrame, tag: str, same: list[str], different: str | None = None, cases: DataFrame | None = None) -> DataFrame:
    """(id, decoy): for each case (by default each base), of the other bases equal in ``same`` (and unequal in
    ``different``) the one whose hash with the case is lowest.

    The hash holds both ids, so all pairs of a group are hashed; a block gives one row for each of its cases.
    """
    kind = base.schema["id"].dataType.simpleString()
    extra = F.col(different) if different else F.lit(None).cast("string")
    right = once(_named(base, same, decoy=F.col("id"), source=F.col("source").cast("string"), differs=extra))
    left = once(_named(cases, same, id=F.col("id"), differs=extra)) if cases is not None else right.select(*(F.col(c).alias(c) for c in same), F.col("decoy").alias("id"), F.col("differs").alias("differs"))

    def pick(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = _lists(left, "id", "differs")
        others, sources, theirs = _lists(right, "decoy", "source", "differs")
        ends, held, out = _ends(sources, others), set(others), []
        asking: dict[object, list] = {}
        for i, v in zip(ids, own, strict=True):
            if different is None or v is not None:
                asking.setdefault(v, []).append(i)
        for v, group in asking.items():
            rows = [j for j, w in enumerate(theirs) if different is None or w is not None and w != v]
            tails = [ends[j] for j in rows]
            for i in group:
                places, parts = rows, tails
                if i in held:
                    places = [j for j in rows if others[j] != i]
                    parts = [ends[j] for j in places]
                found = _digests(f"decoy\x1f{tag}\x1f{i}", parts)
                if found:
                    best = min(found)
                    out.append((i, others[places[found.index(best)]], best.hex()))
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((left.schema.field("id").type, right.schema.field("decoy").type, pa.string()))], names=["id", "decoy", "h"])

    found = _blocked(left, right, same).applyInArrow(pick, f"id {kind}, decoy {kind}, h string")
    return found.groupBy("id").agg(F.min_by("decoy", "h").alias("decoy"))


def budgeted(candidates: DataFrame, budget: int = 20) -> DataFrame:
    """candidates (case_id, memory_id, priority, ord): the first occurrence of each memory, in order of priority then ord, up to the budget."""
    first = candidates.groupBy("case_id", "memory_id").agg(F.min(F.struct("priority", "ord")).alias("at"))
    w = Window.partitionBy("case_id").orderBy("at", "memory_id")
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= budget).select("case_id", "pos", "memory_id", F.col("at.priority").alias("priority"))


def ordered_distinct(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """The first position of each value."""
    return df.groupBy(*keys, value).agg(F.min(pos).alias(pos))


def last_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in which the last part that has a key gives its row."""
    out = None
    for k, p in enumerate(parts):
        x = p.withColumn("_p", F.lit(k))
        out = x if out is None else out.unionByName(x)
    w = Window.partitionBy(key).orderBy(F.desc("_p"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def fillers(cases: DataFrame, pool: DataFrame, budget: int = 20) -> DataFrame:
    """(case_id, memory_id, ord): for each case (id, domain) other members of its domain's pool (id, source, domain), the budget's worth that hash lowest.

    Where cases have ``barred``, members of the pool whose ``print`` is in it are left out. A block gives
    at most the budget's worth for each of its cases, and only hashes below a bound that follows from the size of the domain.
    """
    kind = pool.schema["id"].dataType.simpleString()
    none = F.lit(None)
    left = once(_named(cases, ["domain"], id=F.col("id"), barred=F.col("barred") if "barred" in cases.columns else none.cast("array<string>")))
    right = once(_named(pool, ["domain"], decoy=F.col("id"), source=F.col("source").cast("string"), print=F.col("print") if "print" in pool.columns else none.cast("string")))

    def pick(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, barred, limits), (others, sources, prints) = _lists(left, "id", "barred", "limit"), _lists(right, "decoy", "source", "print")
        ends, out = _ends(sources, others), []
        for i, bar, most in zip(ids, barred, limits, strict=True):
            found, below = _digests(f"filler\x1f{i}", ends), most and bytes.fromhex(most)
            low = ((h, j) for j, h in enumerate(found) if below is None or h < below)
            out += [(i, others[j], h.hex()) for h, j in heapq.nsmallest(budget, ((h, j) for h, j in low if others[j] != i and not (bar and prints[j] in bar)))]
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((left.schema.field("id").type, right.schema.field("decoy").type, pa.string()))], names=["case_id", "memory_id", "ord"])

    def best(asking: DataFrame) -> DataFrame:
        x = _blocked(asking, right, ["domain"]).applyInArrow(pick, f"case_id {kind}, memory_id {kind}, ord string")
        n = F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))
        return x.withColumn("_n", n).where(F.col("_n") <= budget).select("case_id", "memory_id", "ord")

    # the bound that the hash of the budget's worth is below, but for a chance of about 1e-11
    share = F.lit(float(budget + 8 * budget**0.5 + 16)) / F.col("_m")
    limit = F.when(share < 1, F.lower(F.lpad(F.hex((share * 2.0**48).cast("long")), 12, "0")))
    bounded = left.join(right.groupBy("domain").agg(F.count("*").alias("_m")), "domain").withColumn("limit", limit).drop("_m")
    near = once(best(bounded))
    # a case that found fewer below its bound looks at all
    few = bounded.where(F.col("limit").isNotNull()).join(near.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("_k")).where(F.col("_k") >= budget), "id", "left_anti")
    few = once(few.withColumn("limit", F.lit(None).cast("string")).select(*bounded.columns))
    if few.isEmpty():
        return near
    return near.join(few.select(F.col("id").alias("case_id")), "case_id", "left_anti").unionByName(best(few))


def better_decoys(cases: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, decoy): of the pool's members of the domain whose first gold text overlaps the query more than any of the case's own, the one that hashes lowest.

    A case of whose words none is missing in its own texts has none, and isn't dealt.
    """
    kind = pool.schema["id"].dataType.simpleString()
    right = once(_named(pool, ["domain"], decoy=F.col("id"), g=different_words(F.get("gold", F.lit(0)))))

    def pick(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, own), (others,) = _lists(left, "id", "own"), _lists(right, "decoy")
        ends, out = _ends([None] * len(others), others), []
        for k, rows in _sharing(left.column("q"), own, right.column("g")):
            rows = [j for j in rows if others[j] != ids[k]]
            found = _digests(f"decoy\x1fN9\x1f{ids[k]}", [ends[j] for j in rows])
            if found:
                best = min(found)
                out.append((ids[k], others[rows[found.index(best)]], best.hex()))
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((left.schema.field("id").type, right.schema.field("decoy").type, pa.string()))], names=["id", "decoy", "h"])

    found = _blocked(once(asking_more(cases)), right, ["domain"]).applyInArrow(pick, f"id {kind}, decoy {kind}, h string")
    return found.groupBy("id").agg(F.min_by("decoy", "h").alias("decoy"))


def different_words(text: Column | str) -> Column:
    return F.array_distinct(T.tokens(text))


def asking_more(cases: DataFrame) -> DataFrame:
    """(domain, id, q, own) of cases (id, domain, query, gold): the query's different words and how many of them one of their own texts
    holds at most; without cases that hold all."""
    x = _named(cases, ["domain"], id=F.col("id"), q=different_words("query"), gold=F.col("gold"))
    own = F.array_max(F.transform("gold", lambda g: F.size(F.array_intersect("q", different_words(g)))))
    return x.withColumn("own", F.coalesce(own, F.lit(0))).drop("gold").where(F.size("q") > F.col("own"))


def better_elsewhere(asking: DataFrame, texts: DataFrame) -> DataFrame:
    """(id) of asking (domain, id, q, own) that share more words with a text of another id of their domain, of texts (domain, decoy, g), than own says."""
    kind = asking.schema["id"].dataType.simpleString()

    def pick(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, own), (others,) = _lists(left, "id", "own"), _lists(right, "decoy")
        out = [ids[k] for k, rows in _sharing(left.column("q"), own, right.column("g")) if any(others[j] != ids[k] for j in rows)]
        return pa.table([pa.array(out, left.schema.field("id").type)], names=["id"])

    return _blocked(asking, texts, ["domain"]).applyInArrow(pick, f"id {kind}").distinct()


def materialise(cases: DataFrame, pool: DataFrame, decoy: DataFrame, budget: int = 20) -> DataFrame:
    """(case_id, pos, memory_id, priority) of cases (id, domain, no_evidence): the gold memory (0; left out without evidence), the decoy (1), fillers (3), up to the budget.

    No-evidence cases get no memory whose normalised text is that of one of their gold texts, and a case with fewer
    than two memories or without its gold raises an error. Needs gold in cases and pool.
    """
    gold = cases.where(~F.col("no_evidence")).select(F.col("id").alias("case_id"), F.col("id").alias("memory_id"), F.lit(0).alias("priority"), F.lit("").alias("ord"))
    must = decoy.join(cases.select("id"), "id", "left_semi").select(F.col("id").alias("case_id"), F.col("decoy").alias("memory_id"), F.lit(1).alias("priority"), F.lit("").alias("ord"))
    print_of = lambda x: F.sha2(T.norm(x), 256)
    barred = F.when(F.col("no_evidence"), F.transform("gold", print_of))
    pool = pool.withColumn("print", print_of(F.get("gold", F.lit(0))))
    cases = cases.withColumn("barred", barred)
    copies = pool.select(F.col("id").alias("memory_id"), "print").join(cases.select(F.col("id").alias("case_id"), F.explode("barred").alias("print")), "print").select("case_id", "memory_id")
    must = must.join(copies, ["case_id", "memory_id"], "left_anti")
    rest = fillers(cases, pool, budget).select("case_id", "memory_id", F.lit(3).alias("priority"), "ord")
    return checked(cases, budgeted(gold.unionByName(must).unionByName(rest), budget))


def checked(cases: DataFrame, memories: DataFrame) -> DataFrame:
    """memories; raises an error where a case has fewer than two, or has evidence and lost its gold to the budget."""
    w = Window.partitionBy("case_id")
    x = cases.select(F.col("id").alias("case_id"), "no_evidence").join(memories, "case_id", "left")
    x = x.withColumns({"_n": F.count("memory_id").over(w), "_g": F.count_if(F.col("priority") == 0).over(w)})
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.col("case_id").cast("string"))).cast("boolean")
    ok = F.when(F.col("_n") < 2, fail("insufficient runtime memories ")).when(~F.col("no_evidence") & (F.col("_g") < 1), fail("gold dropped by budget ")).otherwise(F.lit(True))
    return x.where(ok).select("case_id", "pos", "memory_id", "priority")
