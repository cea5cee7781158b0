"""Ranking queries: every ranker over the conversation cases, BM25 of the benchmark over the documents, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import rankers as R
from tessera.plans import sql_parts as S
from tessera.plans.cases import conversation_cases
from tessera.plans.registry import query, table

TS = S.parse_time("ts")
TF = f"tf AS (SELECT case_id, pos, term, count(*) AS tf FROM (SELECT case_id, pos, unnest({S.tokens('text')}) AS term FROM cm) GROUP BY ALL), qf AS (SELECT case_id, term, count(*) AS qtf FROM (SELECT case_id, unnest({S.tokens('query')}) AS term FROM (SELECT case_id, min(query) AS query FROM cm GROUP BY case_id)) GROUP BY ALL), n AS (SELECT case_id, count(*) AS n FROM cm GROUP BY case_id)"


def _top(source: str, order: str, k: int = 5) -> str:
    return f"SELECT case_id, rank::INT AS rank, memory_id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


def _cases(body: str) -> str:
    return f"WITH {S.CASES}, {body}"


@query(_cases("x AS (SELECT *, 0.0::DOUBLE AS score, " + S.hashed("case_id", "memory_id") + " AS h FROM cm) " + _top("x", "h, pos")))
def rank_random(spark: SparkSession, sf: str) -> DataFrame:
    return R.random_rank(conversation_cases(spark, sf))


@query(_cases(f"x AS (SELECT *, round({S.recency(TS)}, 6) AS score, {TS} AS t FROM cm) " + _top("x", "t DESC, pos")))
def rank_recency(spark: SparkSession, sf: str) -> DataFrame:
    return R.recency_rank(conversation_cases(spark, sf))


JAC = f"j AS (SELECT *, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE ELSE 0.0 END AS jaccard FROM (SELECT *, {S.tokens('text')} AS a, {S.tokens('query')} AS b FROM cm))"


@query(_cases(JAC + ", x AS (SELECT *, round(jaccard, 9) AS score FROM j WHERE round(jaccard, 9) > 0) " + _top("x", "score DESC, pos")))
def rank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return R.lexical_rank(conversation_cases(spark, sf))


@query(_cases(TF + """, df AS (SELECT case_id, term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT case_id, term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM df JOIN n USING (case_id)),
w AS (SELECT case_id, pos, term, tf * idf AS w FROM tf JOIN idf USING (case_id, term)),
a AS (SELECT case_id, term, qtf * coalesce(idf, ln((1 + n)::DOUBLE) + 1) AS qw FROM qf JOIN n USING (case_id) LEFT JOIN idf USING (case_id, term)),
qn AS (SELECT case_id, sqrt(sum(qw * qw)) AS qn FROM a GROUP BY case_id), dn AS (SELECT case_id, pos, sqrt(sum(w * w)) AS dn FROM w GROUP BY ALL),
d AS (SELECT case_id, pos, sum(w * qw) AS dot FROM w JOIN a USING (case_id, term) GROUP BY ALL),
x AS (SELECT case_id, pos, memory_id, round(dot / (dn * qn), 9) AS score FROM d JOIN dn USING (case_id, pos) JOIN qn USING (case_id) JOIN cm USING (case_id, pos)) """ + _top("(SELECT * FROM x WHERE score > 0)", "score DESC, pos")))
def rank_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return R.tfidf_rank(conversation_cases(spark, sf))


@query(_cases(TF + f""", df AS (SELECT case_id, term, count(*) AS df FROM tf GROUP BY ALL),
l AS (SELECT case_id, pos, len({S.tokens('text')}) AS dl FROM cm), p AS (SELECT case_id, coalesce(nullif(avg(dl), 0), 1) AS avgdl FROM l GROUP BY case_id),
s AS (SELECT case_id, pos, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {L.BM25_K1 + 1}::DOUBLE / (tf + {L.BM25_K1}::DOUBLE * ({1 - L.BM25_B}::DOUBLE + {L.BM25_B}::DOUBLE * dl / avgdl)))), 9) AS score
      FROM tf JOIN qf USING (case_id, term) JOIN df USING (case_id, term) JOIN l USING (case_id, pos) JOIN p USING (case_id) JOIN n USING (case_id) GROUP BY case_id, pos),
x AS (SELECT case_id, pos, memory_id, score FROM s JOIN cm USING (case_id, pos) WHERE score > 0) """ + _top("x", "score DESC, pos")))
def rank_bm25_cases(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25_rank(conversation_cases(spark, sf))


BM25 = f"""
qf AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({S.tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents), p AS (SELECT count(*) AS n, coalesce(nullif(avg(len(toks)), 0), 1) AS avgdl FROM d),
h AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM qf) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(qtf * (ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {L.BM25_K1 + 1}::DOUBLE / (tf + {L.BM25_K1}::DOUBLE * ({1 - L.BM25_B}::DOUBLE + {L.BM25_B}::DOUBLE * dl / avgdl))))), 9) AS score
      FROM h JOIN df USING (term) JOIN qf USING (term), p GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
"""


def benchmark_hits(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"))
    return R.bm25_search(items, table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text"), k).select(F.col("case_id").alias("item_id"), "rank", F.col("pos").alias("doc_id"), "score")


@query(f"WITH {BM25} SELECT item_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def rank_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_hits(spark, sf).withColumn("score", F.round("score", 6))


@query(_cases(JAC + f", x AS (SELECT *, {TS} AS t, round(0.75::DOUBLE * jaccard + 0.25::DOUBLE * {S.recency(TS)}, 9) AS score FROM j WHERE jaccard > 0) " + _top("x", "score DESC, round(jaccard, 9) DESC, t DESC, pos")))
def rank_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return R.hybrid_rank(conversation_cases(spark, sf))


COS = TF + """, co AS (SELECT case_id, pos, sum(tf * qtf) / (any_value(dn) * any_value(qn)) AS c FROM tf JOIN qf USING (case_id, term)
  JOIN (SELECT case_id, pos, sqrt(sum(tf * tf)) AS dn FROM tf GROUP BY ALL) USING (case_id, pos) JOIN (SELECT case_id, sqrt(sum(qtf * qtf)) AS qn FROM qf GROUP BY ALL) USING (case_id) GROUP BY case_id, pos),
cx AS (SELECT cm.*, coalesce(c, 0.0) AS cosine FROM cm LEFT JOIN co USING (case_id, pos))"""
BASE = f"({L.SIMILARITY_WEIGHT}::DOUBLE * SIM + {L.BASE}::DOUBLE + {L.RECENCY_WEIGHT}::DOUBLE * {S.recency(TS)})"


def _scored(score: str, source: str = "cx") -> str:
    return f"x AS (SELECT *, {TS} AS t, round({score}, 6) AS score FROM {source}) " + _top("x", "score DESC, t DESC, pos")


@query(_cases(COS + ", " + _scored(BASE.replace("SIM", "cosine"))))
def rank_current(spark: SparkSession, sf: str) -> DataFrame:
    return R.current_rank(conversation_cases(spark, sf))


def _any(stems: str, names) -> str:
    return f"list_has_any({stems}, {S.listed(L.stems_of(names))})"


@query(_cases(COS + ", " + _scored(BASE.replace("SIM", "cosine") + f" + CASE WHEN {_any(S.stems(S.tokens('text')), L.UPDATE_CUES)} THEN {L.UPDATE_BONUS}::DOUBLE ELSE 0 END + CASE WHEN {_any(S.stems(S.tokens('query')), L.CURRENT_QUERY_CUES)} THEN {L.CURRENT_RECENCY}::DOUBLE * {S.recency(TS)} ELSE 0 END")))
def rank_v1(spark: SparkSession, sf: str) -> DataFrame:
    return R.v1_rank(conversation_cases(spark, sf))


V2 = COS + f""", aq AS (SELECT case_id, n, unnest(list_distinct({S.content(S.tokens('query'))})) AS term FROM (SELECT case_id, min(query) AS query, count(*) AS n FROM cm GROUP BY case_id)),
hd AS (SELECT case_id, pos, term FROM (SELECT case_id, pos, unnest(list_distinct({S.content(S.tokens('text'))})) AS term FROM cm) JOIN aq USING (case_id, term)),
ai AS (SELECT case_id, term, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM aq LEFT JOIN (SELECT case_id, term, count(*) AS df FROM hd GROUP BY ALL) USING (case_id, term)),
cv AS (SELECT case_id, pos, round(sum(idf) / any_value(total), 9) AS coverage FROM hd JOIN ai USING (case_id, term) JOIN (SELECT case_id, sum(idf) AS total FROM ai GROUP BY case_id) USING (case_id) GROUP BY case_id, pos),
v AS (SELECT cx.*, coalesce(coverage, 0.0) AS coverage, {S.tokens('text')} AS toks, list_distinct({S.content(S.tokens('query'))}) AS q, list_distinct({S.content(S.tokens('text'))}) AS content FROM cx LEFT JOIN cv USING (case_id, pos)),
v1 AS (SELECT *, {S.stems('toks')} AS st, list_transform(list_filter(toks, lambda t: NOT list_contains({S.listed(L.STOPWORDS)}, t) AND length({S.stem('t')}) > 1), lambda t: {S.stem('t')}) AS raw FROM v),
v2 AS (SELECT *, len(list_intersect(q, content)) AS n_overlap, len(list_filter(content, lambda t: NOT list_contains(q, t))) AS n_novel,
  CASE WHEN len(raw) > 0 THEN len(list_filter(raw, lambda t: list_contains(q, t))) / len(raw)::DOUBLE ELSE 0 END AS query_only, CASE WHEN len(raw) > 0 THEN 1 - len(list_distinct(raw)) / len(raw)::DOUBLE ELSE 0 END AS repetition FROM v1),
v3 AS (SELECT *, coverage >= {L.ECHO_COVERAGE} AND n_novel <= {L.ECHO_NOVEL} AND (ends_with(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '?') OR coalesce(list_contains({S.listed(L.QUESTION_WORDS)}, toks[1]), false)
  OR (query_only >= {L.ECHO_QUERY_ONLY} AND round(repetition, 9) >= {L.ECHO_REPETITION})) AS echo FROM v2)"""
V2_SCORE = BASE.replace("SIM", f"least(cosine, {L.SIMILARITY_CAP}::DOUBLE)") + f""" + CASE WHEN {_any('st', L.STRONG_UPDATE)} THEN {L.UPDATE_BONUS}::DOUBLE WHEN {_any('st', L.WEAK_UPDATE)} THEN {L.WEAK_UPDATE_BONUS}::DOUBLE ELSE 0 END
  + {L.ANCHOR_WEIGHT}::DOUBLE * coverage + CASE WHEN n_overlap > 0 THEN least(n_novel, {L.NOVEL_CAP}) * {L.NOVEL_BONUS}::DOUBLE ELSE 0 END
  - CASE WHEN echo THEN {L.ECHO_PENALTY}::DOUBLE ELSE 0 END - CASE WHEN {_any('st', L.ADVERSARIAL)} THEN {L.ADVERSARIAL_PENALTY}::DOUBLE ELSE 0 END"""


@query(_cases(V2 + ", " + _scored(V2_SCORE, "v3")))
def rank_v2(spark: SparkSession, sf: str) -> DataFrame:
    return R.v2_rank(conversation_cases(spark, sf))


@query(_cases(V2 + " SELECT case_id, pos, coverage, n_novel::INT AS n_novel, round(query_only, 6) AS query_only, round(repetition, 6) AS repetition, echo FROM v3"))
def echo_features(spark: SparkSession, sf: str) -> DataFrame:
    x = R.v2_features(conversation_cases(spark, sf))
    return x.select("case_id", "pos", "coverage", "n_novel", F.round("query_only", 6).alias("query_only"), F.round("repetition", 6).alias("repetition"), "echo")


@query(_cases(f"x AS (SELECT case_id, pos, list_distinct({S.tokens('query')}) AS q, {S.tokens('text')} AS t FROM cm) SELECT case_id, pos, round(len(list_intersect(q, t)) / greatest(1, len(q))::DOUBLE, 6) AS overlap FROM x"))
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_cases(spark, sf).select("case_id", "pos", F.round(T.overlap(T.tokens("query"), T.tokens("text")), 6).alias("overlap"))
