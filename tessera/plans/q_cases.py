"""Queries of cases with native pools, made of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cases as C
from tessera.plans import sql_parts as S
from tessera.plans.registry import query, table


def conversation_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as bases: the last user turn asks, the two turns before it are gold, all turns before it the native pool.

    The number of the asking turn stands for the domain, the first turn's role for the subject, the number of turns that
    answer for the relation; a question without a question mark leaves its relation implicit.
    """
    own = Window.partitionBy("conv_id")
    c = table(spark, sf, "conversations").withColumn("asked", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(own))
    memory = F.struct(F.concat_ws(":", F.lit("conv"), "conv_id", "turn").alias("id"), F.col("text").alias("text"), F.format_string("2026-07-%02dT12:00:00+00:00", 1 + F.col("turn") % 28).alias("ts"))
    before = F.when(F.col("turn") < F.col("asked"), F.struct("turn", memory.alias("m"), "role"))
    x = c.groupBy("conv_id").agg(F.max("asked").alias("asked"), F.min(F.when(F.col("turn") == F.col("asked"), F.col("text"))).alias("query"), F.array_sort(F.collect_list(before)).alias("before"))
    x = x.withColumn("pool", F.transform("before", lambda b: b["m"])).where((F.size("pool") > 0) & (T.norm("query") != ""))
    gold = F.filter("before", lambda b: b["turn"] >= F.col("asked") - 2)
    answers = F.size(F.filter("before", lambda b: b["role"] == "assistant"))
    return x.select(
        F.col("conv_id").cast("string").alias("id"),
        F.lit("conversations").alias("source"),
        F.concat(F.lit("D"), 1 + F.col("asked") % 4).alias("domain"),
        F.col("before")[0]["role"].alias("subject"),
        F.concat(F.lit("answers-"), answers).alias("relation"),
        (~F.contains("query", F.lit("?"))).alias("implicit_relation"),
        "query",
        F.transform(gold, lambda b: b["m"]).alias("gold"),
        "pool",
    ).where(F.size("gold") > 0)


CONVERSATION_BASES = f"""ca AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS asked FROM conversations),
cb AS (SELECT conv_id::VARCHAR AS id, 'conversations' AS source, 'D' || (1 + max(asked) % 4) AS domain, min(text) FILTER (turn = asked) AS query,
  arg_min(role, struct_pack(turn := turn, id := concat_ws(':', 'conv', conv_id, turn), text := text)) FILTER (turn < asked) AS subject, 'answers-' || count(*) FILTER (turn < asked AND role = 'assistant') AS relation,
  list(struct_pack(id := concat_ws(':', 'conv', conv_id, turn), text := text, turn := turn) ORDER BY turn, text) FILTER (turn < asked) AS pool,
  list(struct_pack(id := concat_ws(':', 'conv', conv_id, turn), text := text, turn := turn) ORDER BY turn, text) FILTER (turn < asked AND turn >= asked - 2) AS gold FROM ca GROUP BY conv_id),
bs AS MATERIALIZED (SELECT *, NOT contains(query, '?') AS implicit, gold[1].id AS memory_id, {S.norm('gold[1].text')} AS print FROM cb WHERE gold IS NOT NULL AND {S.norm('query')} <> '')"""


def chosen(bases: DataFrame) -> DataFrame:
    """Every base, with the families in turn (a fifth of them has none) and every third base without evidence."""
    k = F.col("id").cast("long")
    family = F.element_at(F.array(*map(F.lit, ("N3", "N4", "N9", "N12", "N1"))), (k % 5 + 1).cast("int"))
    return bases.select("id", family.alias("family"), (k % 3 == 0).alias("no_evidence"))


_ASK = "ask AS MATERIALIZED (SELECT *, ['N3', 'N4', 'N9', 'N12', 'N1'][id::BIGINT % 5 + 1] AS family, id::BIGINT % 3 = 0 AS no_evidence FROM bs)"
_HASH = {f: S.hashed("'decoy'", f"'{f}'", "a.id", "b.source", "b.id") for f in ("N3", "N4", "N12")}
_OVERLAP = f"len(list_intersect(list_distinct({S.tokens('a.query')}), list_distinct({S.tokens('b.gold[1].text')})))"
DECOYS = f"""dq AS (SELECT a.id, b.id AS decoy, {_HASH['N3']} AS h FROM ask a JOIN bs b ON a.domain = b.domain AND a.id <> b.id AND a.subject <> b.subject WHERE a.family = 'N3'
UNION ALL SELECT a.id, b.id, {_HASH['N4']} FROM ask a JOIN bs b ON a.subject = b.subject AND a.id <> b.id AND a.relation <> b.relation WHERE a.family = 'N4' AND NOT a.implicit
UNION ALL SELECT a.id, b.id, {_HASH['N12']} FROM ask a JOIN bs b ON a.subject = b.subject AND a.relation = b.relation AND a.id <> b.id WHERE a.family = 'N12'
UNION ALL SELECT a.id, b.id, {S.hashed("'decoy'", "'N9'", 'a.id', 'b.id')} FROM (SELECT *, list_max(list_transform(gold, lambda g: len(list_intersect(list_distinct({S.tokens('query')}), list_distinct({S.tokens('g.text')}))))) AS best FROM ask WHERE family = 'N9') a
  JOIN bs b ON a.domain = b.domain AND a.id <> b.id WHERE {_OVERLAP} > a.best),
dy AS (SELECT id, min_by(decoy, h) AS decoy FROM dq GROUP BY id)"""


@query(f"WITH {CONVERSATION_BASES}, {_ASK}, {DECOYS} SELECT id, decoy FROM dy")
def family_decoys(spark: SparkSession, sf: str) -> DataFrame:
    """The decoy of each conversation's family, of all conversations; N9 compares with the best of the own gold texts."""
    b = conversation_bases(spark, sf)
    return C.decoys(b.join(chosen(b), "id"), b)


@query(f"""WITH {CONVERSATION_BASES}, {_ASK}, {DECOYS},
gx AS (SELECT id, no_evidence, unnest(gold) AS m, unnest(range(0, len(gold))) AS nth FROM ask), px AS (SELECT id, unnest(pool) AS m FROM ask),
al AS (SELECT id, m.id AS memory_id, m.text AS text, m.turn AS turn, 0 AS priority, printf('%010d', nth) AS ord FROM gx WHERE NOT no_evidence
UNION ALL SELECT dy.id, b.memory_id, b.gold[1].text, b.gold[1].turn, 1, '' FROM dy JOIN bs b ON b.id = dy.decoy
UNION ALL SELECT id, m.id, m.text, m.turn, 2, {S.hashed("'native-pool'", 'id', 'm.id')} FROM px
UNION ALL SELECT a.id, b.memory_id, b.gold[1].text, b.gold[1].turn, 3, {S.hashed("'filler'", 'a.id', 'b.source', 'b.id')} FROM ask a JOIN bs b ON a.domain = b.domain AND a.id <> b.id),
bar AS (SELECT id, list(m.id) AS ids, list({S.norm('m.text')}) AS texts FROM gx WHERE no_evidence GROUP BY id),
ok AS (SELECT al.* FROM al LEFT JOIN bar USING (id) WHERE bar.id IS NULL OR NOT (list_contains(ids, memory_id) OR list_contains(texts, {S.norm('text')}))),
fo AS (SELECT id, memory_id, min_by(struct_pack(priority := priority, ord := ord, text := text, turn := turn), struct_pack(priority := priority, ord := ord)) AS x FROM ok GROUP BY ALL)
SELECT id AS case_id, pos::INT AS pos, memory_id, sha256(x.text) AS text, printf('2026-07-%02dT12:00:00+00:00', (1 + x.turn % 28)::INT) AS ts, x.priority::INT AS priority, x.priority = 0 AS relevant FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY x.priority, x.ord, memory_id) AS pos FROM fo) WHERE pos <= 20""")
def native_pool_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as a case: all gold turns, its family's decoy, its other turns, fillers of its domain."""
    b = conversation_bases(spark, sf)
    return C.materialise(b, chosen(b)).withColumn("text", F.sha2("text", 256))
