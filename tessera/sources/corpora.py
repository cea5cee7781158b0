"""Adapters of five corpora to one table of bases: questions with the texts that answer them.

A base has source, id, query, subject, relation, gold (array of texts), domain, temporal, contradiction, carried (a
question that goes on from earlier turns) and several (two or more carried slots). Readers take a path; every adapter
leaves out what it can't resolve, and numbers rows in the order of paths and of rows within a file. Each has a second form, ``..._rows``, over a
DataFrame of the corpus' shape, for data that a user holds as tables. With an Observation an adapter counts, in the same
pass, the rows it leaves out by reason.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import flags
from tessera.operators.relational import dedup
from tessera.sources import readers as R

COLUMNS = ("source", "id", "query", "subject", "relation", "gold", "domain", "temporal", "contradiction", "carried", "several")
MESSAGE = "struct<role string, content string, has_answer boolean>"
LONGMEMEVAL = f"question_id string, question string, question_type string, haystack_session_ids array<string>, haystack_sessions array<array<{MESSAGE}>>, haystack_dates array<string>, answer_session_ids array<string>"
DIALOGUE = "struct<dialogue_id string, turns array<struct<speaker string, utterance string, frames array<struct<service string, slots array<struct<slot string>>, state struct<slot_values map<string, array<string>>>>>>>>"
QAR = "struct<Q string, A string, topic_id string, R string>"
REFERENCE = "struct<topic_id string, date string, `group` string, message_index string, msg_index string>"
# Names under which messages hold their speaker and their text, in the order in which they are tried.
SPEAKERS = ("sender_name", "sender", "speaker", "name", "role", "author")
TEXTS = ("content", "text", "message", "body", "msg", "utterance")


def stripped(x: Column | str) -> Column:
    """Without white space at the ends; null gives an empty text."""
    return F.regexp_replace(F.coalesce(T.col(x).cast("string"), F.lit("")), rf"^{T.SPACES}|{T.SPACES}$", "")


def filled(x: Column, otherwise: Column | str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), T.col(otherwise))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, read from files that aren't split, with the number of each row from 0. Only paths and counts meet in one task."""
    x = df.select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at"))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy("_path").orderBy("_at")) - 1)
    earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy("_path").agg(F.count("*").alias("_n")).select("_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return x.join(before, "_path").withColumn(name, F.col("_before") + F.col("_in")).drop("_path", "_at", "_in", "_before")


def records(text: Column, schema: str) -> Column:
    """The elements of a JSON array as structs; those that aren't objects are null, in their places."""
    return F.transform(F.from_json(text, "array<string>"), lambda e: F.when(e.startswith("{"), F.from_json(e, schema)))


def base(df: DataFrame, source: str, **given: Column) -> DataFrame:
    """The columns of bases; flags that aren't given are false."""
    no = dict.fromkeys(COLUMNS[-4:], F.lit(False))
    cols = {"source": F.lit(source)} | no | given
    return flags.valid(df.select(*(cols.get(c, F.col(c)).alias(c) for c in COLUMNS)))


def kept(df: DataFrame, reasons: Mapping[str, Column], seen: Observation | None = None) -> DataFrame:
    """The rows to which no reason applies. ``seen`` gets rows, kept, and for each reason the rows of which it is the first."""
    why = F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in reasons.items()))
    x = df.withColumn("_why", why)
    if seen is not None:
        x = x.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("_why").isNull()).alias("kept"), *(F.count_if(F.col("_why") == name).alias(name) for name in reasons))
    return x.where("_why is null").drop("_why")


def personamem(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """CSV of preferences; the gold text is the snippet of the conversation."""
    return personamem_rows(numbered(R.csv_records(spark, path), "n"), seen)


def personamem_rows(x: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Bases of preferences: the corpus' columns (those that lack are empty) and n, the row's number."""
    has = {c: F.col(c) if c in x.columns else F.lit("") for c in ("persona_id", "topic_preference", "topic_query", "prev_pref", "preference", "updated", "user_query", "related_conversation_snippet")}
    old, new = stripped(has["prev_pref"]), stripped(has["preference"])
    topic = F.concat_ws(" ", has["topic_preference"], has["topic_query"])
    x = kept(x, {"no_question": T.norm(has["user_query"]) == "", "no_gold": T.norm(has["related_conversation_snippet"]) == ""}, seen)
    return base(
        x,
        "personamem-v2",
        id=F.concat(F.lit("pm:"), "n"),
        query=F.coalesce(has["user_query"], F.lit("")),
        subject=filled(F.coalesce(has["persona_id"], F.lit("")), F.concat(F.lit("persona:"), "n")),
        relation=F.coalesce(T.first_filled(stripped(has["topic_preference"]), stripped(has["topic_query"])), F.lit("preference")),
        gold=F.array(F.coalesce(has["related_conversation_snippet"], F.lit(""))),
        domain=T.domain_of(topic, F.lit("D1"), L.TOPICS),
        temporal=(old != "") | T.norm(has["updated"]).isin("true", "1", "yes", "y"),
        contradiction=(old != "") & (new != "") & (T.norm(old) != T.norm(new)),
    )


def session_text(session: Column) -> Column:
    """'role: content' of the messages that have content, a line each."""
    said = F.filter(session, lambda m: stripped(m["content"]) != "")
    return F.array_join(F.transform(said, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), stripped(m["content"]))), "\n")


def longmemeval(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """Questions over sessions: ids and sessions must have equal numbers, and every answer must be one of them (the last of equal ids)."""
    return longmemeval_rows(numbered(R.json_records(spark, path, LONGMEMEVAL), "n"), seen)


def longmemeval_rows(x: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Bases of the columns of LONGMEMEVAL and n."""
    known = F.forall("answer_session_ids", lambda a: F.array_contains("haystack_session_ids", a))
    x = kept(x, {"unequal": F.size("haystack_session_ids") != F.size("haystack_sessions"), "no_answers": F.coalesce(F.size("answer_session_ids"), F.lit(-1)) <= 0, "unresolved": ~F.coalesce(known, F.lit(False))}, seen)
    told = F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.transform("haystack_sessions", session_text).alias("told"))
    x = x.withColumn("told", told).withColumn("gold", F.transform("answer_session_ids", lambda a: F.get(F.reverse(F.filter("told", lambda t: t["sid"] == a)), F.lit(0))["told"]))
    x = x.where(F.forall("gold", lambda g: g.isNotNull())).withColumns({"query": F.coalesce("question", F.lit("")), "id": F.concat(F.lit("lme:"), F.coalesce("question_id", F.col("n").cast("string"))), "relation": F.coalesce("question_type", F.lit("unknown"))})
    return base(x, "longmemeval-cleaned", subject=F.col("id"), domain=T.domain_of(F.concat_ws(" ", "query", F.array_join("gold", " ")), F.lit("D8")), temporal=F.col("relation").isin("knowledge-update", "temporal-reasoning"))


def turn_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, query, pos, memory_id, text, ts, relevant): a memory for each turn of the sessions, with the session's time.

    Relevant are the turns marked as holding the answer; questions whose id holds _abs have none.
    """
    x = R.json_records(spark, path, LONGMEMEVAL).where(F.size("haystack_session_ids") == F.size("haystack_sessions"))
    each = x.select(F.col("question_id").alias("case_id"), F.coalesce("question", F.lit("")).alias("query"), "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("s", "session"))
    turns = each.select("case_id", "query", "s", F.get("haystack_session_ids", F.col("s")).alias("sid"), F.get("haystack_dates", F.col("s")).alias("ts"), F.posexplode("session").alias("t", "turn"))
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy("s", "t")) - 1
    relevant = F.coalesce(F.col("turn.has_answer"), F.lit(False)) & ~F.contains("case_id", F.lit("_abs"))
    return turns.select("case_id", "query", pos.cast("long").alias("pos"), F.concat_ws(":", "sid", "t").alias("memory_id"), F.coalesce("turn.content", F.lit("")).alias("text"), "ts", relevant.alias("relevant"))


def locomo(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """Questions over the turns of numbered sessions, in the order of numbers; every evidence id must be a turn (the last of equal ids)."""
    return locomo_rows(numbered(R.json_records(spark, path, "sample_id string, conversation string, qa string"), "n"), seen)


def locomo_rows(x: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Bases of sample_id, conversation and qa (both JSON) and n."""
    named = F.filter(F.map_entries(F.from_json("conversation", "map<string, string>")), lambda e: e["key"].rlike("^session_[0-9]+$") & e["value"].startswith("["))
    in_order = F.array_sort(F.transform(named, lambda e: F.struct(F.substring_index(e["key"], "_", -1).cast("long").alias("at"), e["value"].alias("value"))))
    turns = F.flatten(F.transform(in_order, lambda s: F.filter(records(s["value"], "struct<dia_id string, speaker string, text string>"), lambda t: t["dia_id"].isNotNull())))
    x = x.select(F.coalesce("sample_id", F.col("n").cast("string")).alias("sid"), turns.alias("turns"), F.posexplode(records(F.col("qa"), "struct<question string, answer string, evidence string, category string>")).alias("at", "item"))
    ids = F.when(F.ltrim("item.evidence").startswith("["), F.from_json("item.evidence", "array<string>")).when(stripped("item.evidence") != "", F.array("item.evidence"))
    x = x.withColumns({"query": stripped("item.question"), "ids": ids})
    x = x.withColumn("found", F.transform("ids", lambda i: F.get(F.reverse(F.filter("turns", lambda t: t["dia_id"] == i)), F.lit(0))))
    x = kept(x, {"no_question": F.col("query") == "", "no_answer": stripped("item.answer") == "", "no_evidence": F.coalesce(F.size("ids"), F.lit(-1)) <= 0, "unresolved": ~F.forall("found", lambda t: t.isNotNull())}, seen)
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda t: F.coalesce(t["speaker"], F.lit(""))), lambda s: s != "")))
    said = F.transform("found", lambda t: F.concat(F.coalesce(t["speaker"], F.lit("")), F.lit(": "), F.coalesce(t["text"], F.lit(""))))
    x = x.withColumns({"gold": said, "subject": F.concat_ws(":", "sid", filled(F.array_join(speakers, "|"), F.concat(F.lit("sample:"), "sid")))})
    return base(x, "locomo", id=F.concat_ws(":", F.lit("locomo"), "sid", "at"), relation=F.concat(F.lit("category-"), F.coalesce("item.category", F.lit("unknown"))), domain=T.domain_of(F.concat_ws(" ", "query", F.array_join("gold", " ")), F.lit("D8")))


def slot_states(frame: Column) -> Column:
    """Map of the frame's slots to their distinct normalised values; slots without any are left out."""
    values = F.transform_values(frame["state"]["slot_values"], lambda _, v: F.array_distinct(F.filter(F.transform(v, T.norm), lambda y: y != "")))
    return F.map_filter(values, lambda _, v: F.size(v) > 0)


def explicit_slots(frame: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(frame["slots"], F.array().cast("array<struct<slot: string>>")), lambda s: s["slot"]), lambda s: s != ""))


def sgd(spark: SparkSession, path: str, most: int | None = 6000) -> DataFrame:
    """User turns whose state holds slots that an earlier user turn named: the nearest earlier turn of each slot is gold.

    Turns that carry slots of several domains are left out. Of each domain the first ``most`` bases in the order of a hash
    stay, as the sampling of this corpus has it (None: all). Where a slot carries several values, the latest turn counts.
    """
    return sgd_rows(R.zip_members(spark, path), most)


def sgd_rows(files: DataFrame, most: int | None = 6000) -> DataFrame:
    """Bases of files (member, split, text: a JSON array of dialogues)."""
    key = ["member", "di", "split", "did"]
    d = files.select("member", "split", F.posexplode(records(F.col("text"), DIALOGUE)).alias("di", "dialogue"))
    d = d.select("member", "di", "split", F.coalesce("dialogue.dialogue_id", F.col("di").cast("string")).alias("did"), F.posexplode("dialogue.turns").alias("ti", "turn")).where("turn.speaker = 'USER'")
    d = d.select(*key, "ti", F.coalesce("turn.utterance", F.lit("")).alias("utterance"), F.explode("turn.frames").alias("frame"))
    named = F.create_map(*(F.lit(x) for domain, services in L.SERVICES.items() for s in services for x in (s, domain)))
    d = d.withColumns({"service": F.coalesce("frame.service", F.lit("")), "explicit": explicit_slots(F.col("frame"))}).withColumn("domain", named[F.substring_index("service", "_", 1)]).where("domain is not null")
    d = d.select(*key, "ti", "utterance", "service", "domain", "explicit", F.explode(slot_states(F.col("frame"))).alias("slot", "values"))
    d = d.select(*key, "ti", "utterance", "service", "domain", "slot", F.array_contains("explicit", F.col("slot")).alias("named"), F.explode("values").alias("value"))
    before = Window.partitionBy(*key, "service", "slot", "value").orderBy("ti").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("prior", F.last(F.when(F.col("named"), F.struct("ti", "utterance")), ignorenulls=True).over(before)).where("not named and prior is not null")
    slots = d.groupBy(*key, "ti", "service", "slot", "domain").agg(F.first("utterance").alias("utterance"), F.max("prior").alias("prior"))
    x = slots.groupBy(*key, "ti").agg(F.first("utterance").alias("query"), F.min("domain").alias("domain"), F.max("domain").alias("other"), F.array_sort(F.collect_set("prior")).alias("turns"), F.array_sort(F.collect_list(F.concat_ws(":", "service", "slot"))).alias("slots"))
    subject = F.concat_ws(":", F.lit("sgd"), "split", "did")
    out = base(x.where("domain = other"), "sgd-carryover", id=F.concat_ws(":", subject, "ti"), subject=subject, relation=F.array_join("slots", "|"), gold=F.transform("turns", lambda t: t["utterance"]), carried=F.lit(True), several=F.size("slots") >= 2)
    return out if most is None else flags.reservoir(out, "sgd-feasibility-reservoir", most, "id")


def listed_questions(text: Column) -> Column:
    """Array of (topic, item) of JSON {topic: [..]}, {topic: {name: [..]}} or [..], in the order of the file."""
    of = F.transform(F.map_entries(F.from_json(text, "map<string, string>")), lambda e: F.struct(F.upper(e["key"]).alias("topic"), F.when(e["value"].startswith("["), records(e["value"], QAR)).otherwise(F.flatten(F.transform(F.map_values(F.from_json(e["value"], "map<string, string>")), lambda v: F.coalesce(records(v, QAR), F.array().cast(f"array<{QAR}>"))))).alias("items")))
    nested = F.flatten(F.transform(of, lambda t: F.transform(F.filter(F.coalesce(t["items"], F.array().cast(f"array<{QAR}>")), lambda i: i.isNotNull()), lambda i: F.struct(t["topic"].alias("topic"), i.alias("item")))))
    bare = F.transform(F.filter(records(text, QAR), lambda i: i.isNotNull()), lambda i: F.struct(F.upper(F.coalesce(i["topic_id"], F.lit(""))).alias("topic"), i.alias("item")))
    return F.when(F.ltrim(text).startswith("["), bare).otherwise(nested)


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(topic, date, group, at, told): the index of messages; of equal keys the last one. Messages without text have no entry."""
    fields = dict.fromkeys(("msg_index", "message_index", *SPEAKERS, *TEXTS))
    schema = f"topic_id string, date string, dialogues map<string, array<struct<{', '.join(f'{f} string' for f in fields)}>>>"
    return message_rows(numbered(R.json_records(spark, path, schema), "n"))


def message_rows(x: DataFrame) -> DataFrame:
    """The index of messages from topic_id, date, dialogues (a map of groups to arrays of messages) and n."""
    x = x.select(F.upper("topic_id").alias("topic"), F.left("date", F.lit(10)).alias("date"), "n", F.explode("dialogues").alias("group", "all"))
    x = x.select("topic", "date", "group", "n", F.posexplode("all").alias("nth", "m")).where("topic <> '' and date <> ''")
    at, who, what = F.coalesce("m.msg_index", "m.message_index"), T.first_filled(*(stripped(f"m.{f}") for f in SPEAKERS)), T.first_filled(*(stripped(f"m.{f}") for f in TEXTS))
    x = x.select("topic", "date", "group", "n", "nth", F.when(at.rlike("^[0-9]+$"), F.regexp_replace(at, "^0+(?=[0-9])", "")).otherwise(at).alias("at"), F.concat_ws(": ", who, what).alias("told"), what.alias("what"))
    return x.where("at is not null and what is not null").groupBy("topic", "date", "group", "at").agg(F.max_by("told", F.struct("n", "nth")).alias("told"))


def evermem(spark: SparkSession, questions: str, dialogues: str) -> DataFrame:
    """Questions whose references (topic, date, group, index ranges) all meet a message: a join on four keys."""
    x = spark.read.option("wholetext", True).text(questions).select(F.posexplode(listed_questions(F.col("value"))).alias("n", "q"))
    return evermem_rows(x, messages(spark, dialogues))


def evermem_rows(x: DataFrame, told: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Bases of questions (n, q: what listed_questions gives) and told, the index of messages."""
    refs = records(F.col("q.item.R"), REFERENCE)
    x = x.select("n", "q.topic", stripped("q.item.Q").alias("query"), stripped("q.item.A").alias("answer"), refs.alias("refs"))
    odd = (F.coalesce(F.size("refs"), F.lit(-1)) <= 0) | F.exists("refs", lambda r: r.isNull())
    x = kept(x, {"no_question": F.col("query") == "", "no_answer": F.col("answer") == "", "other_topic": ~F.col("topic").isin("T1", "T2", "T3", "T4", "T5"), "references": odd}, seen)
    each = x.select("n", "topic", "query", F.posexplode("refs").alias("r", "ref"))
    each = each.select("n", F.col("topic").alias("own"), "query", "r", filled(F.upper("ref.topic_id"), "topic").alias("topic"), F.coalesce(F.left("ref.date", F.lit(10)), F.lit("")).alias("date"), F.coalesce("ref.group", F.lit("")).alias("group"), T.index_ranges(F.coalesce("ref.message_index", "ref.msg_index")).alias("wanted"))
    # a reference without date, group or numbers keeps a row of its own, which meets nothing
    each = each.select("*", F.explode_outer("wanted").alias("i")).withColumn("at", F.col("i").cast("string"))
    found = each.join(told, ["topic", "date", "group", "at"], "left")
    by = found.groupBy("n", "own", "query").agg(F.count_if(F.col("told").isNull()).alias("lost"), F.array_sort(F.collect_list(F.struct("r", "i", "told"))).alias("all"), F.array_join(F.array_sort(F.collect_set("group")), "|").alias("groups")).where("lost = 0")
    return base(by, "evermembench-dynamic", id=F.concat_ws(":", F.lit("ever"), "own", "n"), subject=F.concat_ws(":", F.lit("ever"), "own", "groups"), relation=F.col("own"), gold=F.transform("all", lambda a: a["told"]), domain=F.when(F.col("own") == "T1", "D6").otherwise("D7"))


def united(*bases: DataFrame) -> DataFrame:
    """All bases of several corpora."""
    out = bases[0]
    for b in bases[1:]:
        out = out.unionByName(b)
    return out


def unique(bases: DataFrame) -> DataFrame:
    """Of bases with the same normal form of the query the one whose source and id hash lowest."""
    return dedup(bases.withColumn("_q", F.sha2(T.norm("query"), 256)), F.col("_q"), "source", "id").drop("_q")


def flagged(bases: DataFrame) -> DataFrame:
    """All structural flags of bases with different queries, with those that a corpus states; other relations and repeats of
    a subject count in preferences alone."""
    x = flags.all_flags(unique(bases), temporal=F.col("temporal"), contradiction=F.col("contradiction"), carried=F.col("carried"), plain_source=F.col("source") != "sgd-carryover")
    people = F.col("source") == "personamem-v2"
    return x.withColumns({"n4": F.col("several") | (people & F.col("n4")), "n12": people & F.col("n12")})
