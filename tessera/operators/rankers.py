"""Rankers over cases: DataFrame (case_id, pos, memory_id, text, ts, query) -> (case_id, rank, memory_id, score).

pos numbers a case's memories from 0, ts is ISO 8601 text. Each ranker is a set of equi-joins on (case,
term) and one window by case, so cases of any number spread over the cluster. Scores are rounded before
they are ordered: sums of doubles depend on their order in the last places, and ties must not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators.sizes import small_or_shuffled

Ranker = Callable[[DataFrame, int], DataFrame]


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each case (ties of rows are settled by pos), with their rank."""
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("case_id", "rank", "memory_id", "score")


def terms(cases: DataFrame) -> DataFrame:
    """(case_id, pos, term, tf)."""
    return cases.select("case_id", "pos", F.explode(T.tokens("text")).alias("term")).groupBy("case_id", "pos", "term").agg(F.count("*").alias("tf"))


def query_terms(cases: DataFrame) -> DataFrame:
    """(case_id, term, qtf) of the cases' queries."""
    one = cases.groupBy("case_id").agg(F.min("query").alias("query"))
    return one.select("case_id", F.explode(T.tokens("query")).alias("term")).groupBy("case_id", "term").agg(F.count("*").alias("qtf"))


def pool_sizes(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count("*").alias("n"))


def cosine(cases: DataFrame) -> DataFrame:
    """cases with the cosine of the raw term counts of text and query, 0 without common terms."""
    tf, q = terms(cases), query_terms(cases)
    length = tf.groupBy("case_id", "pos").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dn"))
    asked = q.groupBy("case_id").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qn"))
    dot = tf.join(q, ["case_id", "term"]).groupBy("case_id", "pos").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))
    both = dot.join(length, ["case_id", "pos"]).join(asked, "case_id").select("case_id", "pos", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("cosine"))
    return cases.join(both, ["case_id", "pos"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def random_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    return top(cases.withColumn("score", F.lit(0.0)).withColumn("h", T.stable_hash("case_id", "memory_id")), k, F.col("h"), F.col("pos"))


def recency_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    ts = T.parse_time("ts")
    return top(cases.withColumn("score", F.round(T.recency(ts), 6)).withColumn("at", ts), k, F.desc("at"), F.col("pos"))


def _jaccard(cases: DataFrame) -> DataFrame:
    a, b = T.tokens("text"), T.tokens("query")
    union = F.size(F.array_union(a, b))
    return cases.withColumn("jaccard", F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0))


def lexical_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    scored = _jaccard(cases).withColumn("score", F.round("jaccard", 9)).where("score > 0")
    return top(scored, k, F.desc("score"), F.col("pos"))


def tfidf_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    tf, q, n = terms(cases), query_terms(cases), pool_sizes(cases)
    df = tf.groupBy("case_id", "term").agg(F.count("*").alias("df"))
    idf = df.join(n, "case_id").select("case_id", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = tf.join(idf, ["case_id", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    unseen = F.log(1 + F.col("n")) + 1
    asked = q.join(n, "case_id").join(idf, ["case_id", "term"], "left").withColumn("qw", F.col("qtf") * F.coalesce("idf", unseen)).select("case_id", "term", "qw")
    qn = asked.groupBy("case_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dn = weight.groupBy("case_id", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    dot = weight.join(asked, ["case_id", "term"]).groupBy("case_id", "pos").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    score = dot.join(dn, ["case_id", "pos"]).join(qn, "case_id").withColumn("score", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 9))
    return top(score.where("score > 0").join(cases.select("case_id", "pos", "memory_id"), ["case_id", "pos"]), k, F.desc("score"), F.col("pos"))


def bm25_scores(tf: DataFrame, lengths: DataFrame, pool: DataFrame, df: DataFrame, asked: DataFrame) -> DataFrame:
    """(case_id, pos, score): a term counts as often as the query has it.

    tf (case_id, pos, term, tf) may hold query terms only; pool (case_id, n, avgdl); df (case_id, term, df).
    """
    hit = tf.join(asked, ["case_id", "term"]).join(df, ["case_id", "term"]).join(lengths, ["case_id", "pos"]).join(pool, "case_id")
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * F.col("dl") / F.col("avgdl"))
    each = F.col("qtf") * idf * (F.col("tf") * (L.BM25_K1 + 1) / norm)
    return hit.groupBy("case_id", "pos").agg(F.round(F.sum(each), 9).alias("score")).where("score > 0")


def bm25_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    tf = terms(cases)
    lengths = cases.select("case_id", "pos", F.size(T.tokens("text")).alias("dl"))
    pool = lengths.groupBy("case_id").agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    df = tf.groupBy("case_id", "term").agg(F.count("*").alias("df"))
    score = bm25_scores(tf, lengths, pool, df, query_terms(cases))
    return top(score.join(cases.select("case_id", "pos", "memory_id"), ["case_id", "pos"]), k, F.desc("score"), F.col("pos"))


def bm25_search(items: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """BM25 of all items (case_id, query) over one shared pool docs (pos, text): (case_id, rank, pos, score).

    An inverted index: only the postings of the items' terms are joined and only their lengths are kept. Postings
    are dealt by document before they meet the items, so a document's scores are summed, and cut to each item's
    first k, where its postings are: items times documents are never shuffled. Documents are ordered by pos in ties.
    """
    asked = items.select("case_id", F.explode(T.tokens("query")).alias("term")).groupBy("case_id", "term").agg(F.count("*").alias("qtf"))
    toks = docs.select("pos", T.tokens("text").alias("toks"))
    pool = toks.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg(F.size("toks")), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    asked = small_or_shuffled(asked)
    names = small_or_shuffled(asked.select("term").distinct())
    hits = toks.select("pos", F.size("toks").alias("dl"), F.explode("toks").alias("term")).join(names, "term").groupBy("pos", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # needs tf, so that the postings' exchange is the same and made once
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * F.col("dl") / F.col("avgdl"))
    each = hits.repartition("pos").join(small_or_shuffled(df, names), "term").join(F.broadcast(pool)).select("pos", "term", (idf * (F.col("tf") * (L.BM25_K1 + 1) / norm)).alias("w"))  # pool is one row
    score = each.join(asked, "term").groupBy("case_id", "pos").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 9).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "pos"))
    return score.withColumn("rank", rank).where(F.col("rank") <= k).select("case_id", "rank", "pos", "score")


def hybrid_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    ts = T.parse_time("ts")
    scored = _jaccard(cases).where("jaccard > 0").withColumn("at", ts).withColumn("score", F.round(0.75 * F.col("jaccard") + 0.25 * T.recency(ts), 9))
    return top(scored, k, F.desc("score"), F.desc(F.round("jaccard", 9)), F.desc("at"), F.col("pos"))


def _by_score(scored: DataFrame, k: int) -> DataFrame:
    return top(scored.withColumn("score", F.round("score", 6)).withColumn("at", T.parse_time("ts")), k, F.desc("score"), F.desc("at"), F.col("pos"))


def _base(similarity: Column) -> Column:
    return L.SIMILARITY_WEIGHT * similarity + L.BASE + L.RECENCY_WEIGHT * T.recency(T.parse_time("ts"))


def current_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    return _by_score(cosine(cases).withColumn("score", _base(F.col("cosine"))), k)


def _has(stems: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(stems, T.words(L.stems_of(words)))


def v1_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    text, asked = T.stems(T.tokens("text")), T.stems(T.tokens("query"))
    bonus = F.when(_has(text, L.UPDATE_CUES), L.UPDATE_BONUS).otherwise(0.0)
    recent = F.when(_has(asked, L.CURRENT_QUERY_CUES), L.CURRENT_RECENCY * T.recency(T.parse_time("ts"))).otherwise(0.0)
    return _by_score(cosine(cases).withColumn("score", _base(F.col("cosine")) + bonus + recent), k)


def anchors(cases: DataFrame) -> DataFrame:
    """cases with coverage: the share of the query's idf that the memory's content words hold."""
    q = cases.groupBy("case_id").agg(F.min("query").alias("query"), F.count("*").alias("n"))
    asked = q.select("case_id", "n", F.explode(F.array_distinct(T.content_tokens(T.tokens("query")))).alias("term"))
    held = cases.select("case_id", "pos", F.explode(F.array_distinct(T.content_tokens(T.tokens("text")))).alias("term"))
    hit = held.join(asked.select("case_id", "term"), ["case_id", "term"])
    df = hit.groupBy("case_id", "term").agg(F.count("*").alias("df"))
    idf = asked.join(df, ["case_id", "term"], "left").select("case_id", "term", (F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    total = idf.groupBy("case_id").agg(F.sum("idf").alias("total"))
    share = hit.join(idf, ["case_id", "term"]).groupBy("case_id", "pos").agg(F.sum("idf").alias("part")).join(total, "case_id").select("case_id", "pos", F.round(F.col("part") / F.col("total"), 9).alias("coverage"))
    return cases.join(share, ["case_id", "pos"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def v2_features(cases: DataFrame) -> DataFrame:
    """cases with cosine, coverage, n_novel, query_only, repetition, echo, and the memory's stems."""
    toks = T.tokens("text")
    x = anchors(cosine(cases)).withColumns({"toks": toks, "stems": T.stems(toks), "q": F.array_distinct(T.content_tokens(T.tokens("query")))})
    stop = T.words(L.STOPWORDS)
    raw = F.transform(F.filter("toks", lambda t: ~F.array_contains(stop, t) & (F.length(T.stem(t)) > 1)), T.stem)
    x = x.withColumns({"content": F.array_distinct(T.content_tokens(F.col("toks"))), "raw": raw})
    size = F.size("raw")
    x = x.withColumns({
        "n_overlap": F.size(F.array_intersect("q", "content")),
        "n_novel": F.size(F.array_except("content", "q")),
        "query_only": F.when(size > 0, F.size(F.filter("raw", lambda t: F.array_contains("q", t))) / size).otherwise(0.0),
        "repetition": F.when(size > 0, 1.0 - F.size(F.array_distinct("raw")) / size).otherwise(0.0),
    })
    asks = F.trim(F.regexp_replace("text", T.SPACES, " ")).endswith("?") | F.coalesce(F.array_contains(T.words(L.QUESTION_WORDS), F.get("toks", F.lit(0))), F.lit(False))
    echo = (F.col("coverage") >= L.ECHO_COVERAGE) & (F.col("n_novel") <= L.ECHO_NOVEL) & (asks | ((F.col("query_only") >= L.ECHO_QUERY_ONLY) & (F.round("repetition", 9) >= L.ECHO_REPETITION)))
    return x.withColumn("echo", echo)


def v2_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    x = v2_features(cases)
    update = F.when(_has(F.col("stems"), L.STRONG_UPDATE), L.UPDATE_BONUS).when(_has(F.col("stems"), L.WEAK_UPDATE), L.WEAK_UPDATE_BONUS).otherwise(0.0)
    novel = F.when(F.col("n_overlap") > 0, F.least(F.col("n_novel"), F.lit(L.NOVEL_CAP)) * L.NOVEL_BONUS).otherwise(0.0)
    against = F.when(F.col("echo"), L.ECHO_PENALTY).otherwise(0.0) + F.when(_has(F.col("stems"), L.ADVERSARIAL), L.ADVERSARIAL_PENALTY).otherwise(0.0)
    score = _base(F.least(F.col("cosine"), F.lit(L.SIMILARITY_CAP))) + update + L.ANCHOR_WEIGHT * F.col("coverage") + novel - against
    return _by_score(x.withColumn("score", score), k)


def v6_rank(cases: DataFrame, k: int = 5) -> DataFrame:
    """The ranking of v2 for cases whose evidence supports an answer, else nothing."""
    from tessera.operators.gate import verdicts

    ranked = v2_rank(cases, k)
    sure = verdicts(cases, ranked).where("verdict = 'SUPPORTED'").select("case_id")
    return ranked.join(sure, "case_id", "left_semi")


RANKERS: dict[str, Ranker] = {"random": random_rank, "recency": recency_rank, "lexical": lexical_rank, "tfidf": tfidf_rank, "bm25": bm25_rank, "hybrid": hybrid_rank, "current": current_rank, "v1": v1_rank, "v2": v2_rank, "v6": v6_rank}


def register(name: str, ranker: Ranker) -> None:
    """Adds a user's ranker; any callable (cases, k) -> DataFrame will do."""
    RANKERS[name] = ranker


def rank(cases: DataFrame, name: str, k: int = 5) -> DataFrame:
    return RANKERS[name](cases, k)
