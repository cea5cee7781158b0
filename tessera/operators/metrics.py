"""Retrieval metrics over per-case results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L

DEPTHS = (1, 3, 5)


def per_case(cases: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """cases (case_id, ...) with n_gold, n_returned, first_rank, rr, recall_k, precision_k (by depth), ndcg5, answerable.

    ranked (case_id, rank, id), gold (case_id, id). One pass over ranked joined with gold; no pairs else.
    """
    hits = ranked.join(gold.select("case_id", "id", F.lit(1).alias("g")), ["case_id", "id"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    by = hits.groupBy("case_id").agg(
        F.count("*").alias("n_returned"),
        F.min(F.when(F.col("g") == 1, F.col("rank"))).alias("first_rank"),
        F.sum(1 - F.col("g")).alias("n_irrelevant"),
        *(F.sum(F.when(F.col("rank") <= k, F.col("g")).otherwise(0)).alias(f"hits_{k}") for k in DEPTHS),
        F.sum(F.when(F.col("rank") <= 5, F.col("g") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    golds = gold.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    x = cases.join(by, "case_id", "left").join(golds, "case_id", "left")
    zero = ["n_returned", "n_irrelevant", "n_gold", *(f"hits_{k}" for k in DEPTHS)]
    x = x.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}).withColumn("answerable", F.col("n_gold") > 0)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_gold"), F.lit(5)))), lambda i: 1.0 / F.log2(i + 1)), F.lit(0.0), lambda a, b: a + b)
    return x.select(
        *cases.columns, "answerable", "n_gold", "n_returned", "n_irrelevant", "first_rank",
        F.when(F.col("answerable"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("rr"),
        *(F.when(F.col("answerable"), F.col(f"hits_{k}") / F.col("n_gold")).alias(f"recall_{k}") for k in DEPTHS),
        *(F.when(F.col("answerable"), F.col(f"hits_{k}") / F.lit(k)).alias(f"precision_{k}") for k in DEPTHS),
        F.when(F.col("answerable"), F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_5"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return part / F.greatest(F.lit(1), whole)


def set_metrics(results: DataFrame) -> DataFrame:
    """Means over answerable cases (null without any), irrelevant share of all returned, abstention over the others."""
    returned = F.sum("n_returned")
    return results.agg(
        F.count("*").alias("n_cases"),
        F.count_if("answerable").alias("n_answerable"),
        F.avg("rr").alias("mrr"),
        *(F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("recall", "precision") for k in DEPTHS),
        F.avg("ndcg_5").alias("ndcg_5"),
        F.when(returned > 0, F.sum("n_irrelevant") / returned).otherwise(0.0).alias("irrelevant_rate"),
        F.avg(F.when(~F.col("answerable"), (F.col("n_returned") == 0).cast("double"))).alias("abstention_accuracy"),
    )


def decision_aggregates() -> dict[str, Column]:
    """Aggregates by which decisions are judged; all ratios are 0 for an empty whole."""
    a, z = F.count_if("answerable"), F.count_if(~F.col("answerable"))
    out, empty = F.col("n_returned") > 0, F.col("n_returned") == 0
    return {
        "n": F.count("*"),
        "answerable": a,
        "no_evidence": z,
        "mrr": ratio(F.sum(F.coalesce("rr", F.lit(0.0))), a),
        **{f"hit_{k}": ratio(F.count_if(F.col("answerable") & (F.col("first_rank") <= k)), a) for k in DEPTHS},
        "answerable_recall": ratio(F.count_if(F.col("answerable") & F.col("first_rank").isNotNull()), a),
        "false_abstention": ratio(F.count_if(F.col("answerable") & empty), a),
        "false_retrieval": ratio(F.count_if(~F.col("answerable") & out), z),
        "abstention_correct": ratio(F.count_if(F.when(F.col("answerable"), out).otherwise(empty)), F.count("*")),
    }


#: Frame metrics: the primary family of the cases that count, and whether a gold text at rank 1 is what is counted.
FRAMES = {"temporal_scope_accuracy": ("N6", True), "contradiction_handling_accuracy": ("N7", True), "discourse_contamination_rate": ("N2", False)}


#: Binding metrics: the attribute of the first result and the column that says what it should be.
BINDINGS = {"subject_binding_accuracy": ("subject", "wanted_subject"), "relation_binding_accuracy": ("relation", "wanted_relation")}


def frame_metrics(results: DataFrame) -> DataFrame:
    """One row: of the answerable cases with a result the shares whose first result has the wanted subject and relation, and
    shares of the answerable cases of a primary family (column family) with, or without, a gold text at rank 1; 0 for none."""
    first = F.coalesce(F.col("first_rank") == 1, F.lit(False))
    got = F.col("answerable") & (F.col("n_returned") > 0)
    out = [ratio(F.count_if(got & (F.col(a) == F.col(wanted))), F.count_if(got)).alias(name) for name, (a, wanted) in BINDINGS.items()]
    for name, (family, hit) in FRAMES.items():
        asked = F.col("answerable") & (F.col("family") == family)
        out.append(ratio(F.count_if(asked & (first if hit else ~first)), F.count_if(asked)).alias(name))
    return results.agg(*out)


def decision_metrics(results: DataFrame) -> DataFrame:
    return results.agg(*(v.alias(k) for k, v in decision_aggregates().items()))


def breakdown(results: DataFrame, *axes: str) -> DataFrame:
    """(axis, value, measures): every axis in one pass by grouping sets, with the combined decision accuracy."""
    agg = [v.alias(k) for k, v in decision_aggregates().items()]
    cols = [F.col(a) for a in axes]
    one = results.groupingSets([[c] for c in cols], *cols).agg(F.grouping_id().alias("gid"), *agg)
    bits = {a: (1 << len(axes)) - 1 - (1 << (len(axes) - 1 - k)) for k, a in enumerate(axes)}
    axis = F.coalesce(*(F.when(F.col("gid") == b, a) for a, b in bits.items()))
    value = F.coalesce(*(F.when(F.col("gid") == b, F.col(a).cast("string")) for a, b in bits.items()))
    right = F.col("hit_1") * F.col("answerable") + (1 - F.col("false_retrieval")) * F.col("no_evidence")
    return one.withColumn("axis", axis).withColumn("value", value).withColumn("decision_accuracy", F.when(F.col("n") > 0, right / F.col("n")).otherwise(0.0)).drop("gid", *axes)


def wilson(k: Column, n: Column, z: float = L.WILSON_Z) -> Column:
    """Struct of low and high of the Wilson interval, within [0, 1]; (0, 0) without trials."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p, den = k / m, 1 + z * z / m
    center, half = (p + z * z / (2 * m)) / den, z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m) / den
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), center - half).alias("low"), F.least(F.lit(1.0), center + half).alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high")))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """(case_id, delta) of reciprocal ranks, over cases that both have as answerable."""
    return left.where("answerable").select("case_id", F.col("rr").alias("a")).join(right.select("case_id", F.col("rr").alias("b")), "case_id").select("case_id", (F.col("b") - F.col("a")).alias("delta"))


def win_tie_loss(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("delta") < 0).alias("losses"), F.avg("delta").alias("mean_delta"))


def paired_bootstrap(deltas: DataFrame, iterations: int = 1000, seed: int = 20260808) -> DataFrame:
    """One row: status, n, delta, low, high. Draw j of iteration i takes the case whose number a hash of (seed, i, j) gives.

    The answerable cases of one evaluation, two narrow columns, are numbered by case_id in one task; draws are dealt by iteration, so n times iterations rows spread over the
    cluster and meet the n cases by an equi-join on the drawn number.
    """
    from pyspark.sql import Window

    one = deltas.select("case_id", "delta", (F.row_number().over(Window.orderBy("case_id")) - 1).alias("at"))
    n = deltas.agg(F.count("*").alias("n"))
    draws = deltas.sparkSession.range(iterations).select(F.col("id").alias("i")).join(F.broadcast(n)).where("n > 1").select("i", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("j"))
    pick = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\u001f", F.lit(seed), "i", "j"), 256), 1, 8), 16, 10).cast("long"), F.col("n")).cast("int")
    means = draws.withColumn("at", pick).join(one, "at").groupBy("i").agg(F.round(F.avg("delta"), 9).alias("m"))
    lo, hi = (int(q * (iterations - 1)) for q in (0.025, 0.975))
    sorted_ = F.sort_array(F.collect_list("m"))
    ci = means.agg(F.get(sorted_, F.lit(lo)).alias("low"), F.get(sorted_, F.lit(hi)).alias("high"))
    whole = deltas.agg(F.count("*").alias("n"), F.avg("delta").alias("delta"))
    status = F.when(F.col("n") < 30, "UNDERPOWERED").otherwise("ESTIMATED")
    return whole.join(F.broadcast(ci)).select(status.alias("status"), "n", F.when(F.col("n") > 1, F.round("delta", 9)).alias("delta"), "low", "high")


def rank_histogram(results: DataFrame) -> DataFrame:
    return results.where("answerable and first_rank is not null").groupBy(F.col("first_rank").alias("rank")).agg(F.count("*").alias("n"))


def accounting(expected: DataFrame, got: DataFrame) -> DataFrame:
    """One row: expected and got ids (column id), missing, unexpected and repeated ones."""
    g = got.groupBy("id").agg(F.count("*").alias("times"))
    x = expected.select("id", F.lit(1).alias("e")).distinct().join(g, "id", "full_outer")
    return x.agg(F.count_if(F.col("e") == 1).alias("expected"), F.coalesce(F.sum("times"), F.lit(0)).alias("got"), F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(F.col("times") > 1).alias("repeated"))


def binding_accuracy(tops: DataFrame, attribute: str, wanted: str) -> DataFrame:
    """One row: cases with a first result, and the share of them whose result has the wanted attribute; 0 without any."""
    return tops.agg(F.count("*").alias("n"), ratio(F.count_if(F.col(attribute) == F.col(wanted)), F.count("*")).alias("accuracy"))
