"""Text primitives as Column functions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as L

SPACES = r"[ \t\n\r\f\x0B]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(values: Iterable[str]) -> Column:
    """An array literal."""
    return F.array(*map(F.lit, values))


def casefold(x: Column | str) -> Column:
    return F.replace(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("ß"), F.lit("ss"))


def norm(x: Column | str) -> Column:
    """Folded, typographic apostrophes plain, white space collapsed and trimmed; null gives an empty text."""
    return F.trim(F.regexp_replace(F.replace(casefold(x), F.lit("’"), F.lit("'")), SPACES, " "))


def filled(x: Column | str) -> Column:
    """Whether norm(x) isn't empty, told by the first character that is no white space."""
    return F.coalesce(col(x).rlike(r"[^ \t\n\r\f\x0B]"), F.lit(False))


def tokens(x: Column | str) -> Column:
    """Runs of letters, digits and underscores, folded."""
    return F.regexp_extract_all(casefold(x), F.lit(r"[\p{L}\p{N}_]+"), 0)


def stem(t: Column) -> Column:
    n = F.length(t)
    return F.when((n > 4) & t.endswith("ing"), F.left(t, n - 3)).when((n > 3) & t.endswith("ed"), F.left(t, n - 2)).when((n > 3) & t.endswith("s"), F.left(t, n - 1)).otherwise(t)


def stems(toks: Column) -> Column:
    return F.transform(toks, stem)


def content_tokens(toks: Column) -> Column:
    """Stems of tokens that are neither stop words nor a letter, in order and with repeats."""
    stop = words(L.STOPWORDS)
    kept = F.filter(toks, lambda t: ~F.array_contains(stop, t) & ~F.array_contains(stop, stem(t)) & (F.length(stem(t)) > 1))
    return F.transform(kept, stem)


def audit_tokens(x: Column | str) -> Column:
    """ASCII words with inner apostrophes and hyphens, folded."""
    found = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit("[A-Za-z0-9][A-Za-z0-9_'’-]*"), 0)
    return F.transform(found, lambda t: F.replace(F.lower(t), F.lit("’"), F.lit("'")))


def ngrams(toks: Column, n: int = 12) -> Column:
    """Runs of n tokens, joined by spaces; none if there are fewer."""
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))


def skeleton(toks: Column) -> Column:
    """Function words kept, numbers and other words by placeholders."""
    keep = words(L.FUNCTION_WORDS)
    return F.array_join(F.transform(toks, lambda t: F.when(t.rlike("^[0-9]+$"), "<NUM>").when(F.array_contains(keep, t), t).otherwise("<CONTENT>")), " ")


def stable_hash(*parts: Column | str) -> Column:
    """sha256 of the parts joined by the unit separator: the only source of arbitrary order."""
    return F.sha2(F.concat_ws("\u001f", *(col(p).cast("string") for p in parts)), 256)


def id_digest(ids: Column | str) -> Column:
    """Aggregate: sha256 of the sorted ids, a line each."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(col(ids).cast("string"))), "\n"), 256)


def canonical(*names: str) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def has_phrase(text: Column, phrase: str) -> Column:
    """text, already normalised, holds the phrase: anywhere if it has several words, else as a word of its own."""
    return text.contains(phrase) if " " in phrase else text.rlike(rf"(^|[^a-z0-9_]){phrase}([^a-z0-9_]|$)")


def domain_of(text: Column | str, fallback: Column | str, table: Mapping[str, Iterable[str]] = L.DOMAINS) -> Column:
    """The first domain, by priority (the table's order), of which text holds a phrase.

    The text is normalised and its words are found once, for all domains; phrases of one word are words of their own.
    """
    single = {d: [p for p in phrases if " " not in p] for d, phrases in table.items()}
    many = {d: [p for p in phrases if " " in p] for d, phrases in table.items()}
    known = words(dict.fromkeys(p for ps in single.values() for p in ps))

    def first(n: Column) -> Column:
        return F.transform(F.array(F.array_intersect(F.regexp_extract_all(n, F.lit("[a-z0-9_]+"), 0), known)), lambda held: named(n, held))[0]

    def named(n: Column, held: Column) -> Column:
        out = F
        for domain in table:
            hit = F.arrays_overlap(held, words(single[domain]))
            for p in many[domain]:
                hit = hit | n.contains(p)
            out = out.when(hit, domain)
        return out.otherwise(F.lit(None).cast("string"))

    return F.coalesce(F.transform(F.array(norm(text)), first)[0], col(fallback))


def first_filled(*values: Column | str) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*(F.nullif(F.trim(col(v)), F.lit("")) for v in values))


def index_ranges(x: Column | str) -> Column:
    """'1,3-5' as [1, 3, 4, 5]; parts that aren't numbers, run backward or span over 1000 are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), ","), lambda p: F.regexp_replace(p, SPACES, "")), lambda p: p.rlike(r"^[0-9]{1,9}(-[0-9]{1,9})?$"))
    bounds = F.transform(parts, lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("lo"), F.element_at(F.split(p, "-"), -1).cast("int").alias("hi")))
    sound = F.filter(bounds, lambda b: (b["hi"] >= b["lo"]) & (b["hi"] - b["lo"] <= 1000))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(sound, lambda b: F.sequence(b["lo"], b["hi"])))))


def parse_time(x: Column | str) -> Column:
    """ISO 8601 text as a timestamp; the reference time if it is missing or can't be read."""
    return F.coalesce(F.try_to_timestamp(col(x)), F.lit(L.REFERENCE_TIME).cast("timestamp"))


def recency(ts: Column) -> Column:
    """1 / (1 + age in units of 30 days), with ages from 0."""
    days = (F.unix_micros(F.lit(L.REFERENCE_TIME).cast("timestamp")) - F.unix_micros(ts)) / F.lit(86400e6)
    return 1.0 / (1.0 + F.greatest(F.lit(0.0), days) / 30.0)


def overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q = F.array_distinct(query_tokens)
    return F.size(F.array_intersect(q, text_tokens)) / F.greatest(F.lit(1), F.size(q))
