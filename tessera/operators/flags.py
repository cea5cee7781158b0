"""Structural flags of base cases: base (source, id, query, subject, relation, gold array, domain) -> n1 .. n12 and stress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.operators import sizes as Z

FAMILIES = tuple(f"n{k}" for k in range(1, 13))
RESERVOIR = 1600
#: Groups into which a domain is dealt before the first of them all are found.
DEALT = 64
#: Groups of a domain's texts of which the longest is tried first.
TRIED = 512
STRESSED = ("n3", "n4", "n5", "n6", "n7", "n9", "n11")


def valid(base: DataFrame) -> DataFrame:
    """Bases with a query and only filled gold texts."""
    return base.where(T.filled("query") & (F.size("gold") > 0) & F.forall("gold", T.filled))


def boundaries(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, ",;()", ""))


def text_flags(base: DataFrame, temporal: Column | None = None, contradiction: Column | None = None, plain_source: Column | None = None, carried: Column | None = None) -> DataFrame:
    """base with the flags that follow from its own texts; carried: questions that are fragments in any case."""
    no = F.lit(False)
    x = base.withColumns({"q": T.tokens("query"), "qn": T.norm("query"), "all": T.tokens(F.concat_ws(" ", "query", F.array_join("gold", " ")))})
    x = x.withColumns({"n6": F.coalesce(temporal, no) if temporal is not None else no, "n7": F.coalesce(contradiction, no) if contradiction is not None else no, "bounds": boundaries(F.col("query")), "ends": F.rtrim(F.regexp_replace("query", T.SPACES, " ")).endswith("?")})
    coref = F.arrays_overlap("q", T.words(L.COREFERENCE)) & ((F.coalesce("subject", F.lit("")) == "") | ~F.contains("qn", T.norm("subject")))
    marked = F.lit(False)
    for m in L.DISCOURSE_MARKERS:
        marked = marked | F.contains("qn", F.lit(m))
    first = F.get("q", F.lit(0))
    fragment = (F.size("q") <= 12) & (~F.col("ends") | F.coalesce(F.array_contains(T.words(L.COREFERENCE), first), no) | F.contains("query", F.lit("...")) | F.contains("query", F.lit("…")))
    fragment = fragment | F.coalesce(carried, no) if carried is not None else fragment
    x = x.withColumns({"n2": (F.size("q") >= 18) | (F.col("bounds") >= 2) | marked, "n5": coref, "n8": F.arrays_overlap("all", T.words(L.MODALITY)), "n10": F.lit(True), "n11": fragment, "multi_clause": F.col("bounds") >= 2})
    plain = (plain_source if plain_source is not None else F.lit(True)) & (F.size("gold") == 1) & F.size("q").between(3, 30) & F.col("ends")
    for f in ("n2", "n5", "n6", "n7", "n8", "n11"):
        plain = plain & ~F.col(f)
    return x.withColumn("n1", plain).drop("q", "qn", "all", "bounds", "ends")


def group_flags(base: DataFrame) -> DataFrame:
    """base with n3 (another subject in the domain), n4 (another relation of the subject), n12 (the same subject and relation
    twice): aggregates of the different keys, which are found once and joined back. Subjects and relations are compared by
    their normal form but for n3."""
    keys = ["domain", "subject", "relation"]
    k = Z.once(base.groupBy(*keys).agg(F.count("*").alias("_n"))).withColumns({"_s": T.norm("subject"), "_r": T.norm("relation")})
    domains = k.groupBy(F.col("domain").alias("_d")).agg((F.min("subject") != F.max("subject")).alias("n3"))
    pairs = k.groupBy("_s", "_r").agg((F.sum("_n") >= 2).alias("n12"))
    subjects = pairs.groupBy("_s").agg((F.count("*") >= 2).alias("n4"))
    no = F.lit(False)
    flags = k.join(domains, F.col("domain").eqNullSafe(F.col("_d")), "left").join(subjects, "_s", "left").join(pairs, ["_s", "_r"], "left")
    flags = flags.select(*(F.col(c).alias(f"_{c}") for c in keys), *(F.coalesce(f, no).alias(f) for f in ("n3", "n4", "n12")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return base.join(Z.small_or_shuffled(flags, k), same, "left").select(*base.columns, "n3", "n4", "n12")


def reservoir(base: DataFrame, tag: str, cap: int, *key: str) -> DataFrame:
    """The first cap rows of each domain in hash order: of those that are the first of a part of it, so no task sorts a whole domain."""
    x = base.withColumn("_h", T.stable_hash(F.lit(tag), "domain", *key))
    for groups in (["domain", F.pmod(F.xxhash64("_h"), F.lit(DEALT))], ["domain"]):
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("_h"))).where(F.col("_n") <= cap)
    return x.drop("_n", "_h")


def better_in_reservoir(base: DataFrame, cap: int = RESERVOIR) -> DataFrame:
    """(id, n9): whether a gold text of another base of the domain's reservoir overlaps the query more than the base's own; bases outside have no row.

    Any better one shares a token, so an inverted index of the reservoir's distinct gold tokens finds it.
    """
    keys = Z.once(reservoir(base.select("id", "source", "domain"), "n9-feasibility-reservoir", cap, "source", "id").select("id"))
    distinct = lambda text: F.array_distinct(T.tokens(text))
    r = Z.once(base.join(Z.small_or_shuffled(keys), "id", "left_semi").select("id", "domain", distinct("query").alias("q"), F.transform("gold", distinct).alias("g")))
    q = r.select("id", "domain", F.explode("q").alias("t"))
    size = r.select("id", F.greatest(F.lit(1), F.size("q")).alias("m"))
    g = r.select(F.col("id").alias("other"), "domain", F.posexplode("g").alias("ord", "ts")).select("other", "domain", "ord", F.explode("ts").alias("t"))
    hits = q.join(g, ["domain", "t"]).groupBy("id", "other", "ord").agg(F.count("*").alias("c")).groupBy("id").agg(F.max(F.when(F.col("id") == F.col("other"), F.col("c"))).alias("own"), F.max(F.when(F.col("id") != F.col("other"), F.col("c"))).alias("best"))
    return size.join(hits, "id", "left").select("id", (F.coalesce("best", F.lit(0)) > F.coalesce("own", F.lit(0))).alias("n9"))


def better_elsewhere(base: DataFrame) -> DataFrame:
    """(id, n9) of the bases whose query a gold text of any other base of the domain overlaps more than the base's own does.

    One such text is enough, so some of the domain's longest are tried first; bases without one among them meet all texts, in blocks.
    """
    asking = Z.once(R.asking_more(base))
    texts = Z.once(base.select("domain", F.col("id").alias("decoy"), F.explode(F.transform("gold", R.different_words)).alias("g")))
    dealt = F.pmod(F.xxhash64("decoy"), F.lit(TRIED))
    longest = texts.groupBy("domain", dealt.alias("_d")).agg(F.max_by("decoy", F.size("g")).alias("decoy")).select("decoy")
    found = Z.once(R.better_elsewhere(asking, texts.join(F.broadcast(longest), "decoy", "left_semi").select(*texts.columns)))  # TRIED rows a domain
    rest = Z.once(asking.join(found, "id", "left_anti").select(*asking.columns))
    return found.unionByName(R.better_elsewhere(rest, texts)).withColumn("n9", F.lit(True))


def all_flags(base: DataFrame, whole: bool = False, **given: Column) -> DataFrame:
    """base with all flags; n9 compares with the domain's reservoir, or with all bases (whole)."""
    x = group_flags(text_flags(valid(base), **given))
    return x.join(better_elsewhere(x) if whole else better_in_reservoir(x), "id", "left").withColumn("n9", F.coalesce("n9", F.lit(False)))


def stress_count(extra: Column | None = None) -> Column:
    out = F.col("multi_clause").cast("int") + (extra.cast("int") if extra is not None else F.lit(0))
    for f in STRESSED:
        out = out + F.col(f).cast("int")
    return out
