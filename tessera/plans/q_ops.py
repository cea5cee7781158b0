"""Queries of the text primitives, projections, flags, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import flags as X
from tessera.operators import relational as R
from tessera.plans import sql_parts as S
from tessera.plans.cases import conversation_cases
from tessera.plans.registry import query, table

DOC = "doc_id"


def docs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return table(spark, sf, "documents").select(*cols) if cols else table(spark, sf, "documents")


@query(f"SELECT doc_id, sha256({S.norm('text')}) AS h FROM documents")
def text_norm(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(DOC, F.sha2(T.norm("text"), 256).alias("h"))


@query(f"SELECT doc_id, len(t)::INT AS n, len(list_distinct(t))::INT AS n_distinct, sha256(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    x = docs(spark, sf).select(DOC, T.tokens("text").alias("t"))
    return x.select(DOC, F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("h"))


@query(f"SELECT doc_id, len(c)::INT AS n, sha256(array_to_string(c, ' ')) AS h, sha256(array_to_string(st, ' ')) AS stems FROM (SELECT doc_id, {S.content('t')} AS c, {S.stems('t')} AS st FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents))")
def content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    x = docs(spark, sf).select(DOC, T.tokens("text").alias("t")).select(DOC, T.content_tokens(F.col("t")).alias("c"), T.stems(F.col("t")).alias("st"))
    return x.select(DOC, F.size("c").alias("n"), F.sha2(F.array_join("c", " "), 256).alias("h"), F.sha2(F.array_join("st", " "), 256).alias("stems"))


@query(f"SELECT doc_id, sha256({S.skeleton('t')}) AS h FROM (SELECT doc_id, {S.audit('text')} AS t FROM documents)")
def skeletons(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(DOC, T.audit_tokens("text").alias("t")).select(DOC, F.sha2(T.skeleton(F.col("t")), 256).alias("h"))


@query(f"SELECT doc_id, len(g)::INT AS n, len(list_distinct(g))::INT AS n_distinct FROM (SELECT doc_id, {S.grams('t')} AS g FROM (SELECT doc_id, {S.audit('text')} AS t FROM documents))")
def twelve_grams(spark: SparkSession, sf: str) -> DataFrame:
    x = docs(spark, sf).select(DOC, T.audit_tokens("text").alias("t")).select(DOC, T.ngrams(F.col("t")).alias("g"))
    return x.select(DOC, F.size("g").alias("n"), F.size(F.array_distinct("g")).alias("n_distinct"))


@query(f"SELECT doc_id, {S.hashed('source', 'doc_id')} AS h FROM documents")
def stable_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(DOC, T.stable_hash("source", "doc_id").alias("h"))


@query("SELECT source, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS digest FROM documents GROUP BY source")
def id_digests(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, DOC, "source").groupBy("source").agg(T.id_digest(DOC).alias("digest"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS j FROM nation")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", T.canonical("n_nationkey", "n_name", "n_regionkey").alias("j"))


@query(f"SELECT doc_id, {S.domain('text', chr(39) + 'D1' + chr(39))} AS domain FROM documents")
def domain_classes(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(DOC, T.domain_of("text", F.lit("D1")).alias("domain"))


@query(rf"SELECT doc_id, regexp_matches({S.norm('text')}, '(^|[^a-z0-9_])the([^a-z0-9_]|$)') AS word, contains({S.norm('text')}, 'of the') AS phrase FROM documents")
def phrase_matches(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(DOC, T.norm("text").alias("n")).select(DOC, T.has_phrase(F.col("n"), "the").alias("word"), T.has_phrase(F.col("n"), "of the").alias("phrase"))


@query(r"""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN l_suppkey || '-' || (l_suppkey + l_linenumber) ELSE l_suppkey || ' - ' || l_linenumber END || CASE l_returnflag WHEN 'R' THEN ',x' WHEN 'A' THEN ', ' || l_suppkey ELSE ',0-' || l_partkey END AS x FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, unnest(string_split(x, ',')) AS s FROM r), v AS (SELECT l_orderkey, l_linenumber, regexp_replace(s, '[ \t]+', '', 'g') AS s FROM p),
b AS (SELECT l_orderkey, l_linenumber, split_part(s, '-', 1)::INT AS lo, CASE WHEN contains(s, '-') THEN split_part(s, '-', 2) ELSE s END::INT AS hi FROM v WHERE regexp_full_match(s, '[0-9]{1,9}(-[0-9]{1,9})?')),
e AS (SELECT DISTINCT l_orderkey, l_linenumber, unnest(range(lo, hi + 1))::INT AS i FROM b WHERE hi >= lo AND hi - lo <= 1000)
SELECT l_orderkey, l_linenumber, count(*) AS n, sum(i)::BIGINT AS total FROM e GROUP BY ALL""")
def index_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges written from the numbers of every line: forward, backward, too wide and no number."""
    one = F.when(F.col("l_linestatus") == "O", F.concat("l_suppkey", F.lit("-"), F.col("l_suppkey") + F.col("l_linenumber"))).otherwise(F.concat("l_suppkey", F.lit(" - "), "l_linenumber"))
    two = F.when(F.col("l_returnflag") == "R", ",x").when(F.col("l_returnflag") == "A", F.concat(F.lit(", "), "l_suppkey")).otherwise(F.concat(F.lit(",0-"), "l_partkey"))
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(T.index_ranges(F.concat(one, two))).alias("i")).distinct()
    return x.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(F.col("i").cast("long")).alias("total"))


@query("SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, text)) AS h, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def session_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where(F.trim("text") != "")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(turns, lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n"), 256).alias("h"), F.count("*").alias("n"))


@query("SELECT event_id, key, value::BIGINT AS value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def json_map_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS nth, turn FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def numbered_session_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions come as a map with keys session_N; they are put in the order of N."""
    c = table(spark, sf, "conversations").select("conv_id", F.concat(F.lit("session_"), "turn").alias("k")).distinct()
    m = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.lit(True).alias("v")))).alias("m"))
    keys = F.array_sort(F.transform(F.filter(F.map_keys("m"), lambda k: k.rlike("^session_[0-9]+$")), lambda k: F.substring(k, 9, 20).cast("long")))
    return m.select("conv_id", F.posexplode(keys).alias("p", "turn")).select("conv_id", (F.col("p") + 1).alias("nth"), "turn")


@query(f"SELECT event_id, round({S.recency('ts::TIMESTAMPTZ')}, 9) AS recency FROM events")
def recencies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(T.recency(F.col("ts").cast("timestamp")), 9).alias("recency"))


@query(f"""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' ELSE event_type END AS x FROM events)
SELECT event_id, epoch({S.parse_time('x')})::BIGINT AS t FROM r""")
def parsed_times(spark: SparkSession, sf: str) -> DataFrame:
    """The events' times written in four forms, and every fifth as no time at all."""
    k, second = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    x = F.when(k == 0, F.concat(second, F.lit("+00:00"))).when(k == 1, second).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).when(k == 3, F.concat(second, F.lit("Z"))).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.unix_seconds(T.parse_time(x)).alias("t"))


BASES = r"""base AS (SELECT doc_id AS id, source, trim(regexp_extract(text, '^[^.!?\n]*[.!?]?')) AS query, source AS subject, lang AS relation, [substr(text, length(regexp_extract(text, '^[^.!?\n]*[.!?]?')) + 1)] AS gold, CASE lang WHEN 'en' THEN 'D1' WHEN 'de' THEN 'D2' WHEN 'fr' THEN 'D3' WHEN 'es' THEN 'D4' ELSE 'D5' END AS domain FROM documents),
vb AS (SELECT * FROM base WHERE """ + S.norm("query") + " <> '' AND " + S.norm("gold[1]") + " <> '')"


def bases(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as base cases: the first sentence asks, the rest is the gold memory, the language stands for the domain."""
    d = F.when(F.col("lang") == "en", "D1").when(F.col("lang") == "de", "D2").when(F.col("lang") == "fr", "D3").when(F.col("lang") == "es", "D4").otherwise("D5")
    x = docs(spark, sf).withColumn("head", F.regexp_extract("text", r"^[^.!?\n]*[.!?]?", 0))
    rest = F.substr("text", F.length("head") + 1)
    return x.select(F.col(DOC).alias("id"), "source", F.trim("head").alias("query"), F.col("source").alias("subject"), F.col("lang").alias("relation"), F.array(rest).alias("gold"), d.alias("domain"))


_MARK = " OR ".join(f"contains(qn, '{m}')" for m in L.DISCOURSE_MARKERS)
TEXT_FLAGS = BASES + f""", f0 AS (SELECT *, {S.tokens('query')} AS q, {S.norm('query')} AS qn, {S.tokens("query || ' ' || gold[1]")} AS alls, length(query) - length(translate(query, ',;()', '')) AS bounds, ends_with(query, '?') AS ends FROM vb),
f1 AS (SELECT *, len(q) >= 18 OR bounds >= 2 OR {_MARK} AS n2, list_has_any(q, {S.listed(L.COREFERENCE)}) AND (coalesce(subject, '') = '' OR NOT contains(qn, {S.norm('subject')})) AS n5, list_has_any(alls, {S.listed(L.MODALITY)}) AS n8,
  len(q) <= 12 AND (NOT ends OR coalesce(list_contains({S.listed(L.COREFERENCE)}, q[1]), false) OR contains(query, '...') OR contains(query, '…')) AS n11, bounds >= 2 AS multi_clause FROM f0),
f2 AS (SELECT *, len(gold) = 1 AND len(q) BETWEEN 3 AND 30 AND ends AND NOT (n2 OR n5 OR n8 OR n11) AS n1, coalesce(min(subject) OVER (PARTITION BY domain) <> max(subject) OVER (PARTITION BY domain), false) AS n3,
  min(rn) OVER (PARTITION BY sn) <> max(rn) OVER (PARTITION BY sn) AS n4, count(*) OVER (PARTITION BY sn, rn) >= 2 AS n12 FROM (SELECT *, """ + S.norm("subject") + " AS sn, " + S.norm("relation") + """ AS rn FROM f1))"""
RESERVOIR = f"""rv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {S.hashed("'n9-feasibility-reservoir'", 'domain', 'source', 'id')}) AS rn FROM vb) WHERE rn <= {X.RESERVOIR})"""
NINE = f"""{RESERVOIR}, rq AS (SELECT id, domain, unnest(list_distinct({S.tokens('query')})) AS t FROM rv), rg AS (SELECT id AS other, domain, unnest(list_distinct({S.tokens('gold[1]')})) AS t FROM rv),
ov AS (SELECT id, other, count(*) AS c FROM rq JOIN rg USING (domain, t) GROUP BY ALL), nine AS (SELECT id, coalesce(max(c) FILTER (id <> other), 0) > coalesce(max(c) FILTER (id = other), 0) AS n9 FROM ov GROUP BY id)"""
_FLAGS = ["n1", "n2", "n3", "n4", "n5", "n8", "n9", "n11", "n12"]


@query(f"WITH {TEXT_FLAGS}, {NINE}, fl AS (SELECT f2.*, coalesce(n9, false) AS n9 FROM f2 LEFT JOIN nine USING (id)) SELECT id, domain, {', '.join(_FLAGS)}, multi_clause, (multi_clause::INT + n3::INT + n4::INT + n5::INT + n9::INT + n11::INT)::INT AS stress FROM fl")
def structural_flags(spark: SparkSession, sf: str) -> DataFrame:
    return X.all_flags(bases(spark, sf)).withColumn("stress", X.stress_count()).select("id", "domain", *_FLAGS, "multi_clause", "stress")


@query(f"WITH {TEXT_FLAGS}, {NINE}, fl AS (SELECT f2.*, coalesce(n9, false) AS n9 FROM f2 LEFT JOIN nine USING (id)) SELECT {', '.join(f'round(avg({c}::INT), 6) AS {c}' for c in [*_FLAGS, 'multi_clause'])}, count(*) AS n FROM fl")
def stress_proportions(spark: SparkSession, sf: str) -> DataFrame:
    return X.all_flags(bases(spark, sf)).agg(*(F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in [*_FLAGS, "multi_clause"]), F.count("*").alias("n"))


@query(f"WITH {BASES}, {RESERVOIR} SELECT id, domain FROM rv")
def hash_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    return X.reservoir(X.valid(bases(spark, sf)), "n9-feasibility-reservoir", X.RESERVOIR, "source", "id").select("id", "domain")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {S.norm('text')} ORDER BY {S.hashed('source', 'doc_id')}) AS n FROM documents) WHERE n = 1")
def global_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.dedup(docs(spark, sf).withColumn("k", F.sha2(T.norm("text"), 256)), F.col("k"), "source", DOC).select(DOC)


@query(f"SELECT count(*) - count(DISTINCT {S.norm('text')}) AS removed FROM documents")
def duplicates_removed(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy(F.sha2(T.norm("text"), 256).alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations")
def last_prior_turn(spark: SparkSession, sf: str) -> DataFrame:
    return R.last_prior(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "asked").select("conv_id", "turn", "role", "asked")


@query("SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def join_single_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(docs(spark, sf, DOC, "source"), DOC).select(DOC, "source", "quality")


@query("SELECT a.conv_id, a.turn, b.role AS prior_role FROM conversations a JOIN (SELECT DISTINCT conv_id, turn, role FROM conversations) b ON a.conv_id = b.conv_id AND a.turn - 1 = b.turn")
def join_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    prior = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("prior_role")).distinct()
    return c.select("conv_id", "turn").join(prior, ["conv_id", "turn"]).select("conv_id", "turn", "prior_role")


@query("WITH r AS (SELECT l_orderkey, count(*) AS n_refs, count(p_partkey) AS n_found FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size >= 5) ON l_partkey = p_partkey GROUP BY l_orderkey) SELECT l_orderkey, n_refs FROM r WHERE n_refs = n_found")
def references_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of which every line names a part of size 5 or more."""
    parts = table(spark, sf, "part").where("p_size >= 5").select(F.col("p_partkey").alias("l_partkey"))
    return R.all_resolve(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), parts, "l_orderkey", ["l_partkey"])


@query("SELECT user_id, min(event_type) AS event_type FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 1")
def sole_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return R.sole_value(table(spark, sf, "events"), "user_id", "event_type")


@query("SELECT l_orderkey, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) = 1")
def sole_line_status(spark: SparkSession, sf: str) -> DataFrame:
    return R.sole_value(table(spark, sf, "lineitem"), "l_orderkey", "l_linestatus")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def _decoys(name: str, tag: str, same: str, different: str | None) -> None:
    """Decoys from all valid bases, in blocks; the SQL makes all pairs of a group."""
    keep = f"AND a.{different} <> b.{different}" if different else ""
    on = " AND ".join(f"a.{c} = b.{c}" for c in same.split(", "))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return R.decoys(X.valid(bases(spark, sf)), tag, same.split(", "), different)

    run.__name__ = name
    query(f"""WITH {BASES} SELECT a.id, min_by(b.id, {S.hashed("'decoy'", f"'{tag}'", 'a.id', 'b.source', 'b.id')}) AS decoy FROM vb a JOIN vb b ON {on} AND a.id <> b.id {keep} GROUP BY a.id""")(run)


_decoys("decoy_other_subject", "N3", "domain", "subject")
_decoys("decoy_other_relation", "N4", "subject", "relation")
_decoys("decoy_same_pair", "N12", "subject, relation", None)


@query(f"""WITH {S.CASES}, c AS (SELECT case_id, memory_id, CASE WHEN relevant THEN 0 ELSE 2 END AS priority, CASE WHEN relevant THEN '' ELSE {S.hashed("'native-pool'", 'case_id', 'memory_id')} END AS ord FROM cm
  UNION ALL SELECT case_id, memory_id, 1, '' FROM cm WHERE pos = 0),
f AS (SELECT case_id, memory_id, min(struct_pack(priority := priority, ord := ord)) AS at1 FROM c GROUP BY ALL)
SELECT case_id, pos::INT AS pos, memory_id, priority::INT AS priority FROM (SELECT case_id, memory_id, at1.priority AS priority, row_number() OVER (PARTITION BY case_id ORDER BY at1.priority, at1.ord, memory_id) AS pos FROM f) WHERE pos <= 4""")
def memory_budget(spark: SparkSession, sf: str) -> DataFrame:
    c = conversation_cases(spark, sf)
    own = c.select("case_id", "memory_id", F.when(F.col("relevant"), 0).otherwise(2).alias("priority"), F.when(F.col("relevant"), "").otherwise(T.stable_hash(F.lit("native-pool"), "case_id", "memory_id")).alias("ord"))
    must = c.where("pos = 0").select("case_id", "memory_id", F.lit(1).alias("priority"), F.lit("").alias("ord"))
    return R.budgeted(own.unionByName(must), 4)


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def left_semi_good(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, DOC).join(table(spark, sf, "labels").where("quality = 1"), DOC, "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def left_anti_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, DOC).join(table(spark, sf, "labels"), DOC, "left_anti")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return R.ordered_distinct(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT doc_id AS id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def last_wins_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts = [docs(spark, sf).select(F.col(DOC).alias("id"), F.lit("document").alias("origin")), table(spark, sf, "labels").select(F.col(DOC).alias("id"), F.lit("label").alias("origin"))]
    return R.last_wins(parts, "id")


@query(f"""WITH t AS (SELECT item_id, {S.tokens('text')} AS t FROM benchmark), u AS (SELECT list_distinct(flatten(list(t))) AS u FROM (SELECT {S.tokens('query')} AS t FROM (WITH {S.CASES} SELECT DISTINCT case_id, query FROM cm)))
SELECT item_id, len(list_intersect(t, u))::INT AS shared, len(list_filter(list_distinct(t), lambda x: NOT list_contains(u, x)))::INT AS novel FROM t, u""")
def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection and difference of each item's tokens with those of all queries: joins on the token, no arrays of all."""
    own = table(spark, sf, "benchmark").select("item_id", F.explode_outer(F.array_distinct(T.tokens("text"))).alias("t"))
    asked = conversation_cases(spark, sf).select("case_id", "query").distinct().select(F.explode(T.tokens("query")).alias("t")).distinct().withColumn("q", F.lit(1))
    return own.join(asked, "t", "left").groupBy("item_id").agg(F.count("q").cast("int").alias("shared"), F.count_if(F.col("t").isNotNull() & F.col("q").isNull()).cast("int").alias("novel"))


@query("SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((quality), (toxic))")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "labels").join(docs(spark, sf, DOC, "n_chars"), DOC)
    return x.groupingSets([[F.col("quality")], [F.col("toxic")]], F.col("quality"), F.col("toxic")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("SELECT event_type, event_id, value FROM (SELECT event_type, event_id, value, rank() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    r = F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("ts")))
    return table(spark, sf, "events").withColumn("r", r).where("r = 1").select("event_type", "event_id", "value")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'language' ELSE 'kept' END AS reason FROM documents) GROUP BY reason")
def exclusion_counters(spark: SparkSession, sf: str) -> DataFrame:
    why = F.when(F.trim("text") == "", "empty").when(F.length("text") < 100, "short").when(~F.col("lang").isin("en", "de", "fr", "es"), "language").otherwise("kept")
    return docs(spark, sf).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(nullif(trim(event_type), ''), nullif(trim(props), ''), 'none') AS label FROM events")
def first_filled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.coalesce(T.first_filled("event_type", "props"), F.lit("none")).alias("label"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT NULL, r_name, r_name FROM region")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    own = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    return own.unionByName(r.select(F.lit(None).cast("int").alias("n_nationkey"), F.col("r_name").alias("n_name"), "r_name"))


CASE_ROWS = f"""vn AS MATERIALIZED (SELECT *, {S.norm('gold[1]')} AS gn FROM vb), cs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {S.hashed("'n9-feasibility-reservoir'", 'domain', 'source', 'id')}) % 3 = 0 AS no_evidence FROM vn)"""


def all_cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every valid base as a case (every third of a domain, in hash order, without evidence), and the valid bases."""
    pool = X.valid(bases(spark, sf))
    w = Window.partitionBy("domain").orderBy(T.stable_hash(F.lit("n9-feasibility-reservoir"), "domain", "source", "id"))
    return pool.withColumn("no_evidence", F.row_number().over(w) % 3 == 0), pool


def _filler_sql(keep: str = "") -> str:
    return f"""fi AS (SELECT cs.id AS case_id, vn.id AS memory_id, {S.hashed("'filler'", 'cs.id', 'vn.source', 'vn.id')} AS ord FROM cs JOIN vn ON cs.domain = vn.domain AND cs.id <> vn.id {keep}),
fl20 AS MATERIALIZED (SELECT case_id, memory_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS k FROM fi) WHERE k <= 20)"""


@query(f"WITH {BASES}, {CASE_ROWS}, {_filler_sql()} SELECT case_id, memory_id, ord FROM fl20")
def same_domain_fillers(spark: SparkSession, sf: str) -> DataFrame:
    return R.fillers(*all_cases(spark, sf))


BETTER = f"""q9 AS (SELECT id, domain, unnest(list_distinct({S.tokens('query')})) AS t FROM cs), g9 AS (SELECT id AS decoy, domain, unnest(list_distinct({S.tokens('gold[1]')})) AS t FROM vb),
c9 AS MATERIALIZED (SELECT id, decoy, count(*) AS c FROM q9 JOIN g9 USING (domain, t) GROUP BY ALL),
b9 AS MATERIALIZED (SELECT id, min_by(decoy, {S.hashed("'decoy'", "'N9'", 'id', 'decoy')}) AS decoy FROM c9 LEFT JOIN (SELECT id, c AS own FROM c9 WHERE id = decoy) USING (id) WHERE id <> decoy AND c > coalesce(own, 0) GROUP BY id)"""


@query(f"WITH {BASES}, {CASE_ROWS}, {BETTER} SELECT id, decoy FROM b9")
def decoy_better_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return R.better_decoys(*all_cases(spark, sf))


FAMILY = {"n3": ("N3", ("domain",), "subject"), "n4": ("N4", ("subject",), "relation"), "n12": ("N12", ("subject", "relation"), None)}


def _family_sql(flag: str) -> str:
    tag, same, different = FAMILY[flag]
    on = " AND ".join([*(f"a.{c} = b.{c}" for c in same), *([f"a.{different} <> b.{different}"] if different else [])])
    return f"""SELECT a.id, min_by(b.id, {S.hashed("'decoy'", f"'{tag}'", 'a.id', 'b.source', 'b.id')}) AS decoy FROM vb a JOIN vb b ON {on} AND a.id <> b.id WHERE a.id IN (SELECT id FROM fam WHERE family = '{flag}') GROUP BY a.id"""


_FLAGGED = " UNION ALL ".join(f"SELECT id, '{f}' AS f FROM f2 {'JOIN nine USING (id) ' if f == 'n9' else ''}WHERE {f}" for f in ("n3", "n4", "n9", "n12"))


@query(f"""WITH {TEXT_FLAGS}, {NINE}, {CASE_ROWS}, {BETTER},
fam AS MATERIALIZED (SELECT id, min_by(f, {S.hashed("'family'", 'id', 'f')}) AS family FROM ({_FLAGGED}) GROUP BY id),
dy AS ({' UNION ALL '.join(map(_family_sql, FAMILY))} UNION ALL SELECT id, decoy FROM b9 WHERE id IN (SELECT id FROM fam WHERE family = 'n9')),
{_filler_sql("AND NOT (cs.no_evidence AND cs.gn = vn.gn)")},
al AS (SELECT id AS case_id, id AS memory_id, 0 AS priority, '' AS ord FROM cs WHERE NOT no_evidence
  UNION ALL SELECT dy.id, dy.decoy, 1, '' FROM dy JOIN cs ON dy.id = cs.id JOIN vn b ON b.id = dy.decoy WHERE NOT (cs.no_evidence AND cs.gn = b.gn)
  UNION ALL SELECT case_id, memory_id, 3, ord FROM fl20),
fo AS (SELECT case_id, memory_id, min(struct_pack(priority := priority, ord := ord)) AS at1 FROM al GROUP BY ALL)
SELECT case_id, pos::INT AS pos, memory_id, priority::INT AS priority FROM (SELECT case_id, memory_id, at1.priority AS priority, row_number() OVER (PARTITION BY case_id ORDER BY at1.priority, at1.ord, memory_id) AS pos FROM fo) WHERE pos <= 20""")
def materialised_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of every valid base with the decoy of their family: of the flagged ones of N3, N4, N9 and N12 the one that hashes lowest."""
    cases, pool = all_cases(spark, sf)
    flagged = F.array(*(F.when(F.col(f), F.struct(T.stable_hash(F.lit("family"), "id", F.lit(f)).alias("h"), F.lit(f).alias("f"))) for f in ("n3", "n4", "n9", "n12")))
    family = X.all_flags(bases(spark, sf)).select("id", F.array_min(flagged)["f"].alias("family"))
    cases = cases.join(family, "id", "left")
    decoy = R.better_decoys(cases.where("family = 'n9'"), pool)
    for flag, (tag, same, different) in FAMILY.items():
        decoy = decoy.unionByName(R.decoys(pool, tag, list(same), different, cases.where(F.col("family") == flag)))
    return R.materialise(cases, pool, decoy)
