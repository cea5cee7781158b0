"""Queries of the corpora's adapters: the given tables brought into each corpus' shape, and their bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.plans import sql_parts as S
from tessera.plans.registry import query, table
from tessera.sources import corpora as C

_OUT = ("id", "query", "subject", "relation", "domain", "temporal", "contradiction")


def shown(bases: DataFrame) -> DataFrame:
    return bases.select(*_OUT, F.sha2(F.array_join("gold", "\n"), 256).alias("gold"))


def _base_sql(source: str) -> str:
    """Valid rows of source (the columns of bases, gold an array) as the queries show them."""
    return f"SELECT {', '.join(_OUT)}, sha256(array_to_string(gold, chr(10))) AS gold FROM ({source}) WHERE {S.norm('query')} <> '' AND len(gold) > 0 AND len(list_filter(gold, lambda g: {S.norm('g')} = '')) = 0"


PERSONAS = f"""SELECT 'personamem-v2' AS source, 'pm:' || c_custkey AS id, 'What does ' || c_name || ' prefer?' AS query, c_custkey::VARCHAR AS subject, lower(c_mktsegment) AS relation,
  [CASE WHEN c_nationkey = 7 THEN ' ' ELSE c_name || ' of ' || n_name || ' prefers ' || c_mktsegment END] AS gold, {S.domain("concat_ws(' ', lower(c_mktsegment), CASE c_nationkey % 3 WHEN 0 THEN 'travel plans' WHEN 1 THEN 'bank account' ELSE '' END)", "'D1'", L.TOPICS)} AS domain,
  c_acctbal < 0 OR c_nationkey % 5 = 0 AS temporal, c_acctbal < 0 AND {S.norm("'No ' || lower(c_mktsegment)")} <> {S.norm('c_mktsegment')} AS contradiction FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def persona_rows(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_nationkey")
    return x.select(
        F.col("c_custkey").alias("n"),
        F.col("c_custkey").cast("string").alias("persona_id"),
        F.lower("c_mktsegment").alias("topic_preference"),
        F.when(k % 3 == 0, "travel plans").when(k % 3 == 1, "bank account").otherwise("").alias("topic_query"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("No "), F.lower("c_mktsegment"))).otherwise("").alias("prev_pref"),
        F.col("c_mktsegment").alias("preference"),
        F.when(k % 5 == 0, " Yes ").otherwise("").alias("updated"),
        F.concat(F.lit("What does "), "c_name", F.lit(" prefer?")).alias("user_query"),
        F.when(k == 7, " ").otherwise(F.concat("c_name", F.lit(" of "), "n_name", F.lit(" prefers "), "c_mktsegment")).alias("related_conversation_snippet"),
    )


@query(_base_sql(PERSONAS))
def persona_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as preferences: the market segment is what is preferred."""
    return shown(C.personamem_rows(persona_rows(spark, sf)))


_SESSION = f"""ses AS (SELECT conv_id, turn // 2 AS s, coalesce(string_agg(role || ': ' || {S.stripped('text')}, chr(10) ORDER BY turn, text) FILTER ({S.stripped('text')} <> ''), '') AS told FROM conversations GROUP BY ALL),
lst AS (SELECT conv_id, min(s) AS a, max(s) AS z FROM ses GROUP BY conv_id)"""
SESSIONS = f"""SELECT 'longmemeval-cleaned' AS source, 'lme:' || conv_id AS id, query, 'lme:' || conv_id AS subject, relation, gold, {S.domain("concat_ws(' ', query, array_to_string(gold, ' '))", "'D8'")} AS domain, relation <> 'single' AS temporal, false AS contradiction
FROM (SELECT l.conv_id, coalesce(max_by(c.text, c.turn), '') AS query, ['temporal-reasoning', 'knowledge-update', 'single'][l.conv_id % 3 + 1] AS relation, CASE WHEN l.conv_id % 4 = 1 THEN [any_value(z.told), any_value(a.told)] ELSE [any_value(z.told)] END AS gold
  FROM lst l JOIN conversations c USING (conv_id) JOIN ses z ON z.conv_id = l.conv_id AND z.s = l.z JOIN ses a ON a.conv_id = l.conv_id AND a.s = l.a WHERE l.conv_id % 7 <> 0 GROUP BY l.conv_id)"""


def session_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("s", F.floor(F.col("turn") / 2).cast("long"))
    message = F.struct(F.col("role"), F.col("text").alias("content"), F.lit(None).cast("boolean").alias("has_answer"))
    one = c.groupBy("conv_id", "s").agg(F.array_sort(F.collect_list(F.struct("turn", "text", message.alias("m")))).alias("told"), F.max_by("text", "turn").alias("last"))
    x = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", F.transform("told", lambda t: t["m"]).alias("m")))).alias("all"), F.max_by("last", "s").alias("question"))
    sid = lambda s: F.concat_ws("-", F.col("conv_id").cast("string"), s["s"].cast("string"))
    x = x.withColumn("haystack_session_ids", F.transform("all", sid))
    first, last = F.element_at("haystack_session_ids", 1), F.element_at("haystack_session_ids", -1)
    answers = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit("none"))).when(F.col("conv_id") % 4 == 1, F.array(last, first)).otherwise(F.array(last))
    kind = F.element_at(F.array(*map(F.lit, ("temporal-reasoning", "knowledge-update", "single"))), (F.col("conv_id") % 3 + 1).cast("int"))
    return x.select(F.col("conv_id").alias("n"), F.col("conv_id").cast("string").alias("question_id"), "question", kind.alias("question_type"), "haystack_session_ids", F.transform("all", lambda s: s["m"]).alias("haystack_sessions"), answers.alias("answer_session_ids"))


@query(f"WITH {_SESSION} {_base_sql(SESSIONS)}")
def session_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as sessions of two turns; the last one answers, in every fourth also the first, in every seventh one that isn't there."""
    return shown(C.longmemeval_rows(session_rows(spark, sf)))


_ENDS = "en AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM conversations GROUP BY conv_id)"
DIALOGUES = f"""SELECT 'locomo' AS source, 'locomo:' || conv_id || ':' || k AS id, query, conv_id || ':' || CASE WHEN k = 0 AND ra <> rz THEN least(ra, rz) || '|' || greatest(ra, rz) ELSE ra END AS subject, 'category-' || conv_id % 3 AS relation, gold,
  {S.domain("concat_ws(' ', query, array_to_string(gold, ' '))", "'D8'")} AS domain, false AS temporal, false AS contradiction
FROM (SELECT en.conv_id, k, a.role AS ra, z.role AS rz, CASE k WHEN 0 THEN {S.stripped('z.text')} ELSE 'Who spoke first?' END AS query, CASE k WHEN 0 THEN [a.role || ': ' || a.text, z.role || ': ' || z.text] ELSE [a.role || ': ' || a.text] END AS gold
  FROM en JOIN conversations a ON a.conv_id = en.conv_id AND a.turn = en.a JOIN conversations z ON z.conv_id = en.conv_id AND z.turn = en.z, (SELECT unnest([0, 3]) AS k)) WHERE query <> ''"""


def dialogue_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("s", 1 + F.floor(F.col("turn") / 2).cast("long"))
    dia = F.concat(F.lit("D"), "s", F.lit(":"), "turn")
    told = F.struct(dia.alias("dia_id"), F.col("role").alias("speaker"), "text")
    one = c.groupBy("conv_id", "s").agg(F.array_sort(F.collect_list(F.struct("turn", told.alias("t")))).alias("all"), F.min_by(dia, "turn").alias("first"), F.max_by(dia, "turn").alias("last"), F.max_by("text", "turn").alias("asked"))
    entry = F.struct(F.concat(F.lit("session_"), "s").alias("key"), F.to_json(F.transform("all", lambda t: t["t"])).alias("value"))
    x = one.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("conversation"), F.min_by("first", "s").alias("first"), F.max_by("last", "s").alias("last"), F.max_by("asked", "s").alias("asked"))
    item = lambda q, a, e: F.struct(q.alias("question"), F.lit(a).alias("answer"), e.alias("evidence"), (F.col("conv_id") % 3).cast("string").alias("category"))
    both = F.to_json(F.array("first", "last"))
    qa = F.array(item(F.col("asked"), "a", both), item(F.lit(" "), "a", both), item(F.lit("Where?"), "a", F.lit("D9:99")), item(F.lit("Who spoke first?"), "a", F.col("first")))
    return x.select(F.col("conv_id").alias("n"), F.col("conv_id").cast("string").alias("sample_id"), "conversation", F.to_json(qa).alias("qa"))


@query(f"WITH {_ENDS} {_base_sql(DIALOGUES)}")
def dialogue_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a JSON map of numbered sessions with four questions each, two of which can't be resolved."""
    return shown(C.locomo_rows(dialogue_rows(spark, sf)))


_LINES = """li AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ti, CASE l_returnflag WHEN 'R' THEN 'Hotels_1' WHEN 'A' THEN 'Banks_1' ELSE 'Weather_1' END AS service, l_linestatus = 'O' AS named, l_suppkey % 3 AS value, 'line ' || l_linenumber || ' of part ' || l_partkey AS utterance FROM lineitem),
pr AS (SELECT *, max(CASE WHEN named THEN ti END) OVER (PARTITION BY l_orderkey, service, value ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM li WHERE service <> 'Weather_1')"""
SLOTS = """SELECT 'sgd-carryover' AS source, 'sgd:train:' || p.l_orderkey || ':' || p.ti AS id, p.utterance AS query, 'sgd:train:' || p.l_orderkey AS subject, p.service || ':supplier' AS relation, [g.utterance] AS gold, CASE p.service WHEN 'Hotels_1' THEN 'D5' ELSE 'D4' END AS domain,
  false AS temporal, false AS contradiction FROM pr p JOIN li g ON g.l_orderkey = p.l_orderkey AND g.ti = p.prior WHERE NOT p.named"""


def slot_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    service = F.when(F.col("l_returnflag") == "R", "Hotels_1").when(F.col("l_returnflag") == "A", "Banks_1").otherwise("Weather_1")
    slots = F.when(F.col("l_linestatus") == "O", F.array(F.struct(F.lit("supplier").alias("slot")))).otherwise(F.array().cast("array<struct<slot:string>>"))
    state = F.struct(F.create_map(F.lit("supplier"), F.array((F.col("l_suppkey") % 3).cast("string"))).alias("slot_values"))
    frame = F.struct(service.alias("service"), slots.alias("slots"), state.alias("state"))
    said = F.concat(F.lit("line "), "l_linenumber", F.lit(" of part "), "l_partkey")
    turn = F.struct(F.lit("USER").alias("speaker"), said.alias("utterance"), F.array(frame).alias("frames"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = li.select("l_orderkey", *order, F.to_json(turn).alias("t")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order, "t"))).alias("all"))
    text = F.concat(F.lit('[{"dialogue_id":"'), "l_orderkey", F.lit('","turns":['), F.array_join(F.transform("all", lambda a: a["t"]), ","), F.lit("]}]"))
    return x.select(F.concat(F.lit("dialogues_"), "l_orderkey").alias("member"), F.lit("train").alias("split"), text.alias("text"))


@query(f"WITH {_LINES} {_base_sql(SLOTS)}")
def slot_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dialogues: open lines name the supplier's slot, the others carry it over from the nearest line that named the same value."""
    return shown(C.sgd_rows(slot_rows(spark, sf), most=None))


MESSAGES = f"""SELECT 'evermembench-dynamic' AS source, 'ever:' || topic || ':' || conv_id AS id, 'What was said in ' || conv_id || '?' AS query, 'ever:' || topic || ':g' || conv_id AS subject, topic AS relation, gold, CASE topic WHEN 'T1' THEN 'D6' ELSE 'D7' END AS domain, false AS temporal, false AS contradiction
FROM (SELECT conv_id, 'T' || (1 + conv_id % 5) AS topic, list(concat_ws(': ', nullif({S.stripped('role')}, ''), {S.stripped('text')}) ORDER BY turn) AS gold FROM conversations WHERE turn <= 1 AND {S.stripped('text')} <> '' AND conv_id % 11 <> 0 GROUP BY conv_id HAVING count(DISTINCT turn) = 2)"""


def message_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(questions, messages)."""
    c = table(spark, sf, "conversations")
    topic, date = F.concat(F.lit("T"), 1 + F.col("conv_id") % 5), F.concat(F.lit("2026-01-0"), 1 + F.col("conv_id") % 9)
    none = F.lit(None).cast("string")
    fields = {"msg_index": F.col("turn").cast("string"), "role": F.col("role"), "content": F.col("text")}
    message = F.struct(*(fields.get(f, none).alias(f) for f in ("msg_index", "message_index", *C.SPEAKERS, *C.TEXTS)))
    said = c.select("conv_id", message.alias("m")).groupBy("conv_id").agg(F.collect_list("m").alias("m"))
    told = said.select(F.lower(topic).alias("topic_id"), F.concat(date, F.lit("T10:00")).alias("date"), F.create_map(F.concat(F.lit("g"), "conv_id"), F.col("m")).alias("dialogues"), F.col("conv_id").alias("n"))
    reference = F.struct(F.lower(topic).alias("topic_id"), date.alias("date"), F.concat(F.lit("g"), "conv_id").alias("group"), F.when(F.col("conv_id") % 11 == 0, "0-99").otherwise("0-1").alias("message_index"))
    item = F.struct(F.concat(F.lit("What was said in "), "conv_id", F.lit("?")).alias("Q"), F.lit("x").alias("A"), topic.alias("topic_id"), F.to_json(F.array(reference)).alias("R"))
    asked = c.select("conv_id").distinct().select(F.col("conv_id").alias("n"), F.struct(topic.alias("topic"), item.alias("item")).alias("q"))
    return asked, C.message_rows(told)


@query(_base_sql(MESSAGES))
def message_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as groups of messages; questions refer to their first two by ranges, every eleventh to some that aren't there."""
    return shown(C.evermem_rows(*message_rows(spark, sf)))


@query(f"""WITH {_SESSION}, {_ENDS}, {_LINES}, al AS ({' UNION ALL '.join(f"SELECT source, id, query, gold, domain, temporal, contradiction FROM ({q})" for q in (PERSONAS, SESSIONS, DIALOGUES, SLOTS, MESSAGES))}),
va AS (SELECT * FROM al WHERE {S.norm('query')} <> '' AND len(gold) > 0 AND len(list_filter(gold, lambda g: {S.norm('g')} = '')) = 0)
SELECT source, id, domain, temporal, contradiction FROM (SELECT *, row_number() OVER (PARTITION BY {S.norm('query')} ORDER BY {S.hashed('source', 'id')}) AS k FROM va) WHERE k = 1""")
def united_bases(spark: SparkSession, sf: str) -> DataFrame:
    """All five corpora in one table, each question once."""
    five = (C.personamem_rows(persona_rows(spark, sf)), C.longmemeval_rows(session_rows(spark, sf)), C.locomo_rows(dialogue_rows(spark, sf)), C.sgd_rows(slot_rows(spark, sf), most=None), C.evermem_rows(*message_rows(spark, sf)))
    return C.unique(C.united(*five)).select("source", "id", "domain", "temporal", "contradiction")
