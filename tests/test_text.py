import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T

SAMPLES = ["Straße ÜBER  alles, It’s\tfine", None, "", "  ", "running walked cats is the User's", "ZX-41 is 12, naïve_x", "a\u000bb c"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "i int, t string")


def folded(x):
    return (x or "").lower().replace("ß", "ss")


def test_tokens_and_stems(rows):
    got = rows.select("t", T.tokens("t").alias("k"), T.stems(T.tokens("t")).alias("s"), T.content_tokens(T.tokens("t")).alias("c")).collect()
    for r in got:
        want = re.findall(r"\w+", folded(r["t"]))
        assert r["k"] == want
        assert r["s"] == [L.stem_of(w) for w in want]
        assert r["c"] == [L.stem_of(w) for w in want if w not in L.STOPWORDS and L.stem_of(w) not in L.STOPWORDS and len(L.stem_of(w)) > 1]


def test_norm_and_audit_tokens(rows):
    for r in rows.select("t", T.norm("t").alias("n"), T.audit_tokens("t").alias("a"), T.skeleton(T.audit_tokens("t")).alias("s")).collect():
        assert r["n"] == re.sub(r"[ \t\n\r\f\v]+", " ", folded(r["t"]).replace("’", "'")).strip(" ")
        want = [w.lower().replace("’", "'") for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9_'’-]*", r["t"] or "")]
        assert r["a"] == want
        assert r["s"] == " ".join("<NUM>" if w.isdigit() else w if w in L.FUNCTION_WORDS else "<CONTENT>" for w in want)


def test_ngrams_need_enough_tokens(spark):
    d = spark.createDataFrame([(["a"] * 11,), (["a", "b"] * 7,), ([],)], "t array<string>")
    assert [len(r["g"]) for r in d.select(T.ngrams(F.col("t")).alias("g")).collect()] == [0, 3, 0]


def test_domains(spark):
    d = spark.createDataFrame([("My FLIGHT and bank",), ("the phone plan",), ("nothing",), ("workday",), ("a research project",)], "t string")
    assert [r["d"] for r in d.select(T.domain_of("t", F.lit("D9")).alias("d")).collect()] == ["D4", "D4", "D9", "D9", "D7"]


def test_index_ranges_and_times(spark):
    d = spark.createDataFrame([("1,3-5",), ("7-3,2,x",), ("1-2000",), (None,)], "t string")
    assert [r["i"] for r in d.select(T.index_ranges("t").alias("i")).collect()] == [[1, 3, 4, 5], [2], [], []]
    t = spark.createDataFrame([("2026-08-08T00:00:00+00:00",), ("2026-07-09",), ("soon",), (None,), ("2027-01-01T00:00:00Z",)], "t string")
    assert [round(r["x"], 6) for r in t.select(T.recency(T.parse_time("t")).alias("x")).collect()] == [1.0, 0.5, 1.0, 1.0, 1.0]


def test_domains_by_words_in_any_place(spark):
    rows = ["", None, "phone", "phones", "the phone", "hotel-bus", "flight_1", "a member  of", "Member of\na club", "every\tday", "études, job"]
    got = [r["d"] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(T.domain_of("t", F.lit("-")).alias("d")).collect()]
    assert got == ["-", "-", "D6", "-", "D6", "D5", "-", "D7", "D7", "D8", "D2"]
