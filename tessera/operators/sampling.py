"""Exactly stratified samples: quotas of sources, domains and families met by maximum flow.

Only counts leave the cluster: cells (source, domain) for the transport, and classes of cases with equal
cell and eligibility for the matching, at most 2 ** families for each cell. Flow through a class is as
good as through its cases, which are interchangeable; within a class they are taken in hash order.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import sizes as Z

VARIANTS = 32


def max_flow(edges: Sequence[tuple[object, object, int]], source: object, sink: object) -> list[int]:
    """Flow on each edge, by shortest augmenting paths in the order of the edges."""
    out: dict[object, list[int]] = {}
    ends, room = [], []
    for u, v, cap in edges:
        for a, b, c in ((u, v, cap), (v, u, 0)):
            out.setdefault(a, []).append(len(ends))
            ends.append(b)
            room.append(c)
    while True:
        via: dict[object, int] = {source: -1}
        queue = deque([source])
        while queue and sink not in via:
            u = queue.popleft()
            for e in out.get(u, ()):
                if room[e] > 0 and ends[e] not in via:
                    via[ends[e]] = e
                    queue.append(ends[e])
        if sink not in via:
            return [room[2 * k + 1] for k in range(len(edges))]
        path, v = [], sink
        while via[v] >= 0:
            path.append(via[v])
            v = ends[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def _hash(*parts: object) -> str:
    return hashlib.sha256("\u001f".join(map(str, parts)).encode()).hexdigest()


def transport(cells: Mapping[tuple[str, str], int], sources: Mapping[str, int], domains: Mapping[str, int], stage: str, variant: int = 0) -> dict[tuple[str, str], int] | None:
    """How many cases to take from each cell so that all quotas are met; None if they can't be."""
    order = sorted((c for c, n in cells.items() if n > 0 and c[0] in sources and c[1] in domains), key=lambda c: _hash("transport", stage, variant, *c))
    edges = [("s", ("source", s), n) for s, n in sources.items()] + [(("source", a), ("domain", b), cells[a, b]) for a, b in order] + [(("domain", d), "t", n) for d, n in domains.items()]
    flow = max_flow(edges, "s", "t")
    if sum(flow[: len(sources)]) != sum(sources.values()) or sum(sources.values()) != sum(domains.values()):
        return None
    return {c: f for c, f in zip(order, flow[len(sources) :], strict=False) if f}


def match_families(classes: Mapping[tuple[str, str, int], int], matrix: Mapping[tuple[str, str], int], families: Mapping[str, int]) -> list[tuple[str, str, int, str, int]] | None:
    """(source, domain, mask, family, n) so that each cell gives its quota and each family gets its own; None if impossible.

    Bit k of a class's mask says whether its cases are eligible for family k.
    """
    cells = sorted(matrix)
    kinds = sorted(k for k in classes if k[:2] in matrix)
    edges: list[tuple[object, object, int]] = [("s", ("cell", *c), matrix[c]) for c in cells]
    edges += [(("cell", *k[:2]), ("class", *k), classes[k]) for k in kinds]
    fits = [(k, f) for k in kinds for b, f in enumerate(families) if k[2] >> b & 1]
    edges += [(("class", *k), ("family", f), classes[k]) for k, f in fits]
    edges += [(("family", f), "t", n) for f, n in families.items()]
    flow = max_flow(edges, "s", "t")
    if sum(flow[: len(cells)]) != sum(matrix.values()) or sum(matrix.values()) != sum(families.values()):
        return None
    at = len(cells) + len(kinds)
    return [(*k, f, n) for (k, f), n in zip(fits, flow[at:], strict=False) if n]


def draw(cases: DataFrame, families: Mapping[str, int], sources: Mapping[str, int], domains: Mapping[str, int], stage: str, order: Column | None = None) -> DataFrame | None:
    """cases (id, source, domain, a boolean column for each family) -> (stage, id, source, domain, family), or None.

    The first of the transport's variants that can be matched wins. order: what cases of a class are sorted by
    before the hash. cases are computed once.
    """
    return _draw(Z.once(cases), families, sources, domains, stage, order)


def _draw(cases: DataFrame, families: Mapping[str, int], sources: Mapping[str, int], domains: Mapping[str, int], stage: str, order: Column | None) -> DataFrame | None:
    mask = sum((F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(1 << k)).otherwise(0) for k, f in enumerate(families)), F.lit(0))
    x = cases.select("id", "source", "domain", mask.alias("mask"), (order if order is not None else F.lit(0)).alias("o"))
    classes = {(r["source"], r["domain"], r["mask"]): r["n"] for r in x.groupBy("source", "domain", "mask").agg(F.count("*").alias("n")).collect()}
    cells: dict[tuple[str, str], int] = {}
    for (s, d, _), n in classes.items():
        cells[s, d] = cells.get((s, d), 0) + n
    for variant in range(VARIANTS):
        matrix = transport(cells, sources, domains, stage, variant)
        taken = matrix and match_families(classes, matrix, families)
        if taken:
            break
    else:
        return None
    rows, at = [], {}
    for s, d, m, f, n in taken:
        first = at.get((s, d, m), 0)
        rows.append((s, d, m, f, first, first + n))
        at[s, d, m] = first + n
    plan = F.broadcast(cases.sparkSession.createDataFrame(rows, "source string, domain string, mask int, family string, lo int, hi int"))  # a row for each class and family
    nth = F.row_number().over(Window.partitionBy("source", "domain", "mask").orderBy("o", T.stable_hash(F.lit("family"), F.lit(stage), "id"), "id"))
    first = x.withColumn("nth", nth).where(F.col("nth") <= max(hi for *_, hi in rows))  # a literal, so that few rows of a class are shuffled
    y = first.alias("x").join(plan.alias("p"), ["source", "domain", "mask"]).where("nth > lo AND nth <= hi")
    return y.select(F.lit(stage).alias("stage"), "id", "source", "domain", "family")


def stages(cases: DataFrame, plans: Sequence[tuple[str, Mapping[str, int], Mapping[str, int], Mapping[str, int]]]) -> list[DataFrame]:
    """Samples of stages in order; a stage doesn't get what an earlier one has taken.

    If cases have a column stress, ev_b takes the least stressed of a class first and ev_c the most stressed.
    cases are computed once, and so is each sample, which has as many rows as its quotas.
    """
    cases = Z.once(cases)
    orders = {"ev_b": F.col("stress"), "ev_c": -F.col("stress")} if "stress" in cases.columns else {}
    out: list[DataFrame] = []
    for name, families, sources, domains in plans:
        got = _draw(cases, families, sources, domains, name, orders.get(name))
        if got is None:
            raise ValueError(f"the quotas of {name} can't be met")
        got = Z.once(got)
        out.append(got)
        cases = cases.join(F.broadcast(got.select("id")), "id", "left_anti")
    return out


def without_evidence(assigned: DataFrame, target: int, always: str = "n10") -> DataFrame:
    """assigned with no_evidence: all of the family ``always``, then others in hash order up to the target (never fewer than the former)."""
    w = Window.partitionBy("stage").orderBy(F.when(F.col("family") == always, 0).otherwise(1), T.stable_hash(F.lit("no-evidence"), "stage", "id"))
    return assigned.withColumn("no_evidence", (F.col("family") == always) | (F.row_number().over(w) <= target))


def stress_gate(before: dict[str, float], after: dict[str, float], reserve: dict[str, int], least: int = 4) -> dict[str, object]:
    """Dimensions as not testable, saturated or testable, whether each passes, and whether the whole does."""
    out, testable, failed = {}, 0, False
    for k in before:
        if reserve[k] < 100:
            kind, ok = "insufficient_reserve_not_testable", True
        elif before[k] > 0.98:
            kind, ok = "saturated_not_testable", after[k] + 1e-12 >= before[k]
        else:
            kind, ok = "testable", after[k] - before[k] >= 0.01 - 1e-12
            testable += 1
        failed |= not ok
        out[k] = (kind, ok)
    return {"dimensions": out, "testable": testable, "pass": testable >= least and not failed}
