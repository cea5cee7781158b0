"""The evidence gate: typed assertions in the ranked memories decide whether a case is answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T

#: Relation of an alias, as SQL that any engine reads; {x} is the lower-cased alias.
RELATION_OF = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{r}'" for a, r in sorted(L.aliases())) + " END"
GENERIC_STEMS = sorted({*L.stems_of(L.GENERIC), *L.stems_of(L.CURRENT), *L.stems_of(tuple(w for a, _ in L.aliases() for w in a.split()))})
QUOTES = "\"'()[]{}<> "


#: Relation of each alias of one word, and of the phrases none of whose words is an alias of the same relation.
_SINGLE = {a: r for r, names in L.RELATIONS.items() for a in names if " " not in a}
_PHRASES = {a: r for r, names in L.RELATIONS.items() for a in names if " " in a and not any(_SINGLE.get(w) == r for w in a.split(" "))}


def relations(text: Column) -> Column:
    """The relations of which text holds an alias, sorted.

    The text's words are found once and looked up; a search for each relation would read the text as often.
    """
    table = F.create_map(*(F.lit(x) for pair in _SINGLE.items() for x in pair))

    def held(low: Column) -> Column:
        words = F.array_intersect(F.regexp_extract_all(low, F.lit("[A-Za-z0-9_-]+"), 0), T.words(_SINGLE))
        phrases = [F.when(low.contains(a) & low.rlike(rf"(^|[^A-Za-z0-9_-]){a}([^A-Za-z0-9_-]|$)"), r) for a, r in _PHRASES.items()]
        return F.concat(F.transform(words, lambda w: F.try_element_at(table, w)), F.array_compact(F.array(*phrases)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array(T.casefold(text)), held))))


def java(pattern: str) -> str:
    """A pattern of the lexicon as Java must read it to find what the SQL's engine finds: word boundaries and letters of
    classes are ASCII, white space has no vertical tab, $ is the very end, and (?i) folds all letters."""
    for mark, same in ((r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"), (r"\s", r"[\t\n\f\r ]"), ("$", r"\z"), ("(?i)", "(?iu)")):
        pattern = pattern.replace(mark, same)
    return pattern


def anchors(query: Column) -> Column:
    """Names in the query: words with a digit or hyphen, or capitalised and not first; sorted, folded."""
    atoms = F.regexp_extract_all(query, F.lit(f"({L.SUBJECT})"), 1)
    plain = T.words(GENERIC_STEMS)
    named = F.filter(atoms, lambda a, i: ~F.array_contains(plain, T.stem(F.lower(a))) & (a.rlike("[0-9-]") | (a.rlike("^[A-Z]") & (i > 0))))
    return F.array_sort(F.array_distinct(F.transform(named, F.lower)))


def _any(stems: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(stems, T.words(L.stems_of(words)))


def is_current(query: Column) -> Column:
    return _any(T.stems(T.tokens(query)), L.CURRENT)


def temporal_scope(stems: Column, scope: Column | None = None) -> Column:
    out = F
    if scope is not None:
        low = T.stem(F.lower(scope))
        out = out.when(F.array_contains(T.words(L.stems_of(L.STALE)), low), "STALE").when(F.array_contains(T.words(L.stems_of(L.CURRENT)), low), "CURRENT")
    return out.when(_any(stems, L.STALE), "STALE").when(_any(stems, L.CURRENT) | _any(stems, L.RESOLUTION), "CURRENT").otherwise("UNSPECIFIED")


#: Words of which a text holds one, however cased, where a pattern of the role can match; QUESTION has none.
NEEDED = {
    "NO_VALUE": ("answer", "value", "result", "record"),
    "AGENDA": ("agenda", "action"),
    "REVIEW": ("review", "topic", "discussion"),
    "UNRESOLVED": ("unresolved", "unknown", "pending", "uncertain"),
    "NEGATIVE": ("not", "wrong", "incorrect", "invalid"),
    "META": ("discuss", "mention", "prompt", "instruction", "keyword", "query"),
}


def discourse(text: Column, stems: Column) -> Column:
    """Struct of role and type; the order of the tests decides. A role's patterns are only searched for where one of its words occurs."""

    def tried(low: Column) -> Column:
        out = F
        for role, kind, patterns in L.ROLE_PATTERNS:
            hit = text.rlike(java("(?i)" + "|".join(f"(?:{p})" for p in patterns)))
            if role in NEEDED:
                may = low.contains("ſ")  # folds to s only in patterns
                for w in NEEDED[role]:
                    may = may | low.contains(w)
                hit = may & hit
            if role == "UNRESOLVED":
                hit = hit | _any(stems, L.INFERENCE)
            out = out.when(hit, F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind")))
        return out.otherwise(F.struct(F.lit("ASSERTION").alias("role"), F.lit("UNKNOWN").alias("kind")))

    return F.transform(F.array(F.lower(text)), tried)[0]


def value(x: Column) -> Column:
    """Without outer quotes and brackets, white space collapsed, folded."""
    return T.casefold(F.regexp_replace(F.btrim(F.btrim(x, F.lit(" \t\n\r\f")), F.lit(QUOTES)), T.SPACES, " "))


def evidence(cases: DataFrame) -> DataFrame:
    """cases with one parsed evidence object per memory: role, assertion_type, subject, predicate, value, polarity, scope, status, resolving."""
    x = cases.withColumns({"stems": T.stems(T.tokens("text")), "asked": relations(F.col("query")), "names": anchors(F.col("query"))})
    x = x.withColumn("d", discourse(F.col("text"), F.col("stems")))
    found = []
    for pattern, at in ((java(p), at) for p, at in L.assertion_patterns()):
        part = {k: F.regexp_extract("text", pattern, g) for k, g in at.items()}
        # groups are taken only of texts that match: most don't, and each group is a search of its own
        found.append(F.when(F.col("text").rlike(pattern), F.struct(F.lower(part["subject"]).alias("subject"), F.lower(part["relation"]).alias("alias"), value(part["value"]).alias("value"), part.get("scope", F.lit("")).alias("scope"))))
    x = x.withColumn("slots", F.array_compact(F.array(*found)))
    named = F.transform("slots", lambda s: F.struct(s["subject"].alias("subject"), F.expr("1").alias("one"), s["alias"].alias("alias"), s["value"].alias("value"), s["scope"].alias("scope")))
    x = x.withColumn("slots", named).withColumn("slots", F.expr(f"transform(slots, s -> struct(s.subject AS subject, {RELATION_OF.format(x='s.alias')} AS predicate, s.value AS value, s.scope AS scope))"))
    fits = F.filter("slots", lambda s: (s["value"] != "") & s["predicate"].isNotNull() & ((F.size("asked") == 0) | F.array_contains("asked", s["predicate"])) & ((F.size("names") == 0) | F.array_contains("names", s["subject"])))
    x = x.withColumn("slot", F.get(fits, F.lit(0)))
    claims = F.col("d")["role"] == "ASSERTION"
    parsed = claims & F.col("slot").isNotNull()
    both = F.array_intersect("asked", relations(F.col("text")))
    named_first = F.get(F.filter("names", lambda a: F.contains(T.casefold("text"), a)), F.lit(0))
    fields = (
        F.when(claims & ~parsed, "UNKNOWN").otherwise(F.col("d")["role"]).alias("role"),
        F.when(parsed, "ASSERTED_VALUE").otherwise(F.col("d")["kind"]).alias("assertion_type"),
        F.when(parsed, F.col("slot")["subject"]).when(~claims, named_first).alias("subject"),
        F.when(parsed, F.col("slot")["predicate"]).when(~claims & (F.size(both) == 1), F.get(both, F.lit(0))).alias("predicate"),
        F.when(parsed, F.col("slot")["value"]).alias("value"),
        F.when(parsed, "POSITIVE").when(F.col("d")["role"] == "NEGATIVE", "NEGATIVE").otherwise("NONE").alias("polarity"),
        F.when(parsed, temporal_scope(F.col("stems"), F.col("slot")["scope"])).otherwise(temporal_scope(F.col("stems"))).alias("scope"),
        F.when(parsed, "PARSED").when(claims, "FAIL_CLOSED").otherwise("NON_ASSERTION").alias("status"),
        (parsed & _any(F.col("stems"), L.RESOLUTION)).alias("resolving"),
    )
    # one row for each memory, through a generator: a filter on top then doesn't repeat all of the above inside its condition
    return x.select(*cases.columns, F.explode(F.array(F.struct(*fields))).alias("_e")).select(*cases.columns, "_e.*")


def requirements(cases: DataFrame) -> DataFrame:
    """(case_id, requirement, query): the query's relations, or 'generic'."""
    one = cases.groupBy("case_id").agg(F.min("query").alias("query")).withColumn("r", relations(F.col("query")))
    return one.select("case_id", "query", F.explode(F.when(F.size("r") == 0, F.array(F.lit("generic"))).otherwise(F.col("r"))).alias("requirement"))


def coverage(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case_id, requirement, memory_id, value, scope, resolving, at): what the ranked memories assert for each requirement; memory_id is null where nothing does."""
    shown = cases.join(ranked.select("case_id", "memory_id").distinct(), ["case_id", "memory_id"], "left_semi")
    e = evidence(shown).where((F.col("assertion_type") == "ASSERTED_VALUE") & ~(is_current(F.col("query")) & (F.col("scope") == "STALE")))
    e = e.select("case_id", "predicate", "memory_id", "value", "scope", "resolving", T.parse_time("ts").alias("at"))
    return requirements(cases).drop("query").alias("r").join(e.alias("e"), (F.col("r.case_id") == F.col("e.case_id")) & ((F.col("r.requirement") == "generic") | (F.col("r.requirement") == F.col("e.predicate"))), "left").select("r.case_id", "r.requirement", "memory_id", "value", "scope", "resolving", "at")


def requirement_states(covered: DataFrame) -> DataFrame:
    """(case_id, requirement, state, selected): what is asserted for a requirement, from one aggregate; selected are the ids of the memories that decide.

    The latest resolving assertions decide; without any, those that aren't stale; without these, all. Ranked memories
    alone are gathered, so a list is never longer than the ranking.
    """
    seen = F.collect_list(F.when(F.col("memory_id").isNotNull(), F.struct("at", "memory_id", "value", "scope", F.coalesce("resolving", F.lit(False)).alias("resolving"))))
    x = covered.groupBy("case_id", "requirement").agg(seen.alias("seen"))
    x = x.withColumns({"resolved": F.filter("seen", lambda s: s["resolving"]), "fresh": F.filter("seen", lambda s: s["scope"] != "STALE")})
    latest = F.array_max(F.transform("resolved", lambda s: s["at"]))
    x = x.withColumn("latest", latest).withColumn("resolved", F.filter("resolved", lambda s: s["at"] == F.col("latest")))
    chosen = F.when(F.size("resolved") > 0, F.col("resolved")).when(F.size("fresh") > 0, F.col("fresh")).otherwise(F.col("seen"))
    different = lambda c: F.size(F.array_distinct(F.transform(c, lambda s: s["value"])))
    state = F.when(F.size("seen") == 0, "INSUFFICIENT").when(F.size("resolved") > 0, F.when(different("resolved") > 1, "AMBIGUOUS").otherwise("SUPPORTED")).when(different("fresh") > 1, "CONTRADICTED").otherwise("SUPPORTED")
    return x.select("case_id", "requirement", state.alias("state"), F.array_sort(F.array_distinct(F.transform(chosen, lambda s: s["memory_id"]))).alias("selected"))


def verdicts(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case_id, verdict, requirements, missing, selected): a missing requirement first, else the first that fails, in their order.

    selected: of a supported case the deciding memories, as requirement=memory_id.
    """
    s = requirement_states(coverage(cases, ranked))
    failed = F.when(F.col("state").isin("AMBIGUOUS", "CONTRADICTED"), F.col("requirement"))
    g = s.groupBy("case_id").agg(
        F.sort_array(F.collect_list("requirement")).alias("requirements"),
        F.sort_array(F.collect_list(F.when(F.col("state") == "INSUFFICIENT", F.col("requirement")))).alias("missing"),
        F.min_by("state", failed).alias("failed"),
        F.array_sort(F.flatten(F.collect_list(F.transform("selected", lambda m: F.concat_ws("=", "requirement", m))))).alias("selected"),
    )
    verdict = F.when(F.size("missing") > 0, "INSUFFICIENT").otherwise(F.coalesce("failed", F.lit("SUPPORTED")))
    none = F.array().cast("array<string>")
    return g.withColumn("verdict", verdict).select("case_id", "verdict", "requirements", "missing", F.when(F.col("verdict") == "SUPPORTED", F.col("selected")).otherwise(none).alias("selected"))
