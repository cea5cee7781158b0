"""Exact top-k inner-product search with a bit-sliced index.

Rows are dealt into blocks. A block holds its quantised components as bit slices: slice b of dimension d
is a bitmap over the block's rows with bit b of their component, less the dimension's smallest. For a
query the slices are added with bitmap arithmetic only: a component is written in signed binary digits,
each digit adds the dimension's slices shifted by its place (a negative one adds their complement, which
differs from the negated number by a constant), and carry-save adders reduce the bitmaps of each place
to the slices of all rows' scores at once. The top rows are then selected from the most significant
score slice downward; rows that are still tied after the last slice are resolved by their ids.

Queries travel in small bundles to every index block and stream past it; an index block is copied only where there
are fewer blocks than tasks. k rows for each query leave a block. Vectors with a component of 2**20 or more
after scaling have blocks of their own, whose slices are as many as their components need.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
BLOCK_ROWS = 16_384
QUERY_ROWS = 32
#: Scaled components from which a vector is wide; below, a score of up to 2**20 dimensions is below 2**60.
LIMIT = 2**20
WIDE_ROWS = 512
#: Tasks that a search should have at least.
TASKS = 256
_MOST = 2**63 - 1
_INDEX = "block int, n int, dims int, low binary, width binary, ids binary, slices binary"
_INDEX_SCHEMA = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("low", pa.binary()), ("width", pa.binary()), ("ids", pa.binary()), ("slices", pa.binary())])
_ASKS = "part int, qids binary, q binary"
_HITS = "query_id long, vec_id long, score long, beyond binary"
_HITS_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), exactly; from 2**53 on a number is whole."""
    return int(np.floor(x * scale)) if abs(x) < 2.0**53 / scale else int(x) * scale if abs(x) >= 2.0**53 else int(x * scale // 1)


def matrix(col: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Lists of numbers as rows of scaled integers, filled up with zeros; as Python's integers where some are wide."""
    x = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False)
    wide = bool(len(flat)) and bool(np.abs(flat).max() >= LIMIT / scale)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0), object if wide else np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = [scaled(v, scale) for v in flat.tolist()] if wide else np.floor(flat * scale).astype(np.int64)
    return out


def saturated(score: int) -> tuple[int, bytes]:
    """A score as a long, and where it doesn't fit bytes that order scores beyond the same bound."""
    if -_MOST <= score <= _MOST:
        return score, b""
    size = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return _MOST, size.to_bytes(2, "big") + score.to_bytes(size, "big")
    return -_MOST, (0xFFFF - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def build_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values (rows x dims): the smallest of each dimension, bits of each dimension, slices in the order of dimension, then bit."""
    low = values.min(axis=0) if len(values) else np.zeros(values.shape[1], np.int64)
    up = values - low if values.dtype == object else (values - low).astype(np.uint64)
    width = np.array([int(m).bit_length() for m in up.max(axis=0)] if len(values) else [0] * values.shape[1], np.int64)
    words = -(-len(values) // 64)
    out = np.zeros((int(width.sum()), words * 8), np.uint8)
    row = 0
    for d, w in enumerate(width):
        for b in range(w):
            one = [v >> b & 1 for v in up[:, d]] if up.dtype == object else (up[:, d] >> np.uint64(b)) & np.uint64(1)
            bits = np.packbits(np.array(one, bool), bitorder="little")
            out[row, : len(bits)] = bits
            row += 1
    return low, width, out.view(np.uint64)


def signed_digits(a: int) -> list[tuple[int, int]]:
    """(place, 1 or -1): the shortest sum of signed powers of two."""
    out, place = [], 0
    while a:
        if a & 1:
            digit = 2 - (a & 3)
            out.append((place, digit))
            a -= digit
        a >>= 1
        place += 1
    return out


def add_slices(query: np.ndarray, low: np.ndarray, width: np.ndarray, slices: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of all rows' scores, least significant first, and the constant to add to them."""
    first = np.cumsum(width) - width
    columns: list[list[tuple[int, bool]]] = []
    constant = 0
    for d, a in enumerate(map(int, query)):
        constant += a * int(low[d])
        w = int(width[d])
        for place, digit in signed_digits(a):
            if digit < 0:
                constant -= ((1 << w) - 1) << place
            while len(columns) < place + w:
                columns.append([])
            for b in range(w):
                columns[place + b].append((int(first[d]) + b, digit < 0))
    out: list[np.ndarray] = []
    carry = np.empty((0, slices.shape[1]), np.uint64)
    place = 0
    while place < len(columns) or len(carry):
        stack = carry
        if place < len(columns) and columns[place]:
            plus = [k for k, neg in columns[place] if not neg]
            minus = [k for k, neg in columns[place] if neg]
            stack = np.concatenate([carry, slices[plus], ~slices[minus]])
        carries = []
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            else:
                carries.append((stack[:1] & stack[1:2]))
                stack = stack[:1] ^ stack[1:2]
        out.append(stack[0] if len(stack) else np.zeros(slices.shape[1], np.uint64))
        carry = np.concatenate(carries) if carries else np.empty((0, slices.shape[1]), np.uint64)
        place += 1
    return out, constant


def set_rows(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(np.ascontiguousarray(bitmap[words]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return words[at] * 64 + bit


def select_top(score: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows (bit numbers) of the k largest scores, ties to the lower bit; from the most significant slice downward."""
    sure, tied = np.zeros_like(allowed), allowed
    for s in reversed(score):
        high = tied & s
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            tied = high
        else:
            sure = sure | high
            tied = tied & ~s
            if n == k:
                break
    else:
        left = k - int(np.bitwise_count(sure).sum())
        return np.concatenate([set_rows(sure), set_rows(tied)[: max(0, left)]])
    return set_rows(sure)


def score_of(score: list[np.ndarray], rows: np.ndarray, constant: int) -> list[int]:
    out = [constant] * len(rows)
    for w, s in enumerate(score):
        bits = (s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        out = [a + (b << w) for a, b in zip(out, bits.tolist(), strict=True)]
    return out


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, r: dict):
        self.ids, self.width = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["width"], np.int64)
        self.low, words = np.array(json.loads(r["low"]), object), -(-r["n"] // 64)
        self.slices = np.frombuffer(r["slices"], np.uint64).reshape(int(self.width.sum()), words)
        self.every = np.packbits(np.arange(words * 64) < r["n"], bitorder="little").view(np.uint64)

    def best(self, qid: int, query: list[int], k: int) -> list[tuple[int, int, int, bytes]]:
        a, z = np.searchsorted(self.ids, qid), np.searchsorted(self.ids, qid, "right")
        allowed = self.every.copy()
        for own in range(a, z):
            allowed[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        dims = min(len(query), len(self.low))
        score, constant = add_slices(query[:dims], self.low[:dims], self.width[:dims], self.slices)
        top = select_top(score, allowed, k)
        return [(qid, i, *saturated(v)) for i, v in zip(self.ids[top].tolist(), score_of(score, top, constant), strict=True)]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows, exactly; all, if there are fewer.

    A component x counts as floor(scale * x), the score is the integer inner product, ties go to the
    smaller vec_id. Scores that no long holds are ranked exactly and shown as the nearest of +-(2**63 - 1). Vectors that are
    null or hold a null or a number that isn't finite take no part, nor do rows with a null vec_id. Shorter
    vectors are filled up with zeros. Rows that share the query's vec_id are its own and aren't among its
    results; other rows that repeat a vec_id are results each for itself, and a query that repeats is answered
    once, for its smallest vector in the order of components, before scaling. Extra columns are ignored; an
    empty table gives no rows.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    sound = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = sound.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.withColumn("wide", F.exists("x", lambda v: F.abs(v) >= LIMIT / scale))
    n, n_wide, asked = rows.agg(F.count_if(~F.col("wide")), F.count_if("wide"), F.count_if("q")).first()
    narrow, wide, parts = max(1, -(-n // BLOCK_ROWS)), -(-n_wide // WIDE_ROWS), max(1, -(-asked // QUERY_ROWS))
    blocks = narrow + wide
    copies = max(1, min(parts, -(-TASKS // blocks)))
    deal = lambda into: F.expr(f"cast(pmod(xxhash64(id), {max(1, into)}) as int)")

    def build(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        values = matrix(t.column("x"), scale)
        low, width, slices = build_slices(values)
        row = [key[0].as_py(), t.num_rows, values.shape[1], json.dumps(low.tolist()).encode(), width.tobytes(), t.column("id").to_numpy().tobytes(), slices.tobytes()]
        return pa.table([pa.array([v], f.type) for v, f in zip(row, _INDEX_SCHEMA, strict=True)], schema=_INDEX_SCHEMA)

    def bundle(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        asks = json.dumps(matrix(t.column("x"), scale).tolist(), separators=(",", ":")).encode()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), pa.array([asks], pa.binary())], names=["part", "qids", "q"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for b in batches:
            for j in range(b.num_rows):
                r = b.slice(j, 1).to_pylist()[0]
                if r["kind"] == 0:
                    at, block = Block(r), r["block"]
                    continue
                if r["block"] != block:  # no row was dealt to this block
                    continue
                hits = [h for qid, q in zip(np.frombuffer(r["qids"], np.int64).tolist(), json.loads(r["q"]), strict=True) for h in at.best(qid, q, k)]
                yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], f.type) for c, f in enumerate(_HITS_SCHEMA)], schema=_HITS_SCHEMA)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.when(F.col("wide"), F.lit(narrow) + deal(wide)).otherwise(deal(narrow))
    index = rows.select(place.alias("block"), "id", "x").groupBy("block").applyInArrow(build, _INDEX)
    asks = rows.where("q").groupBy("id").agg(F.min("x").alias("x")).select(deal(parts).alias("part"), "id", "x").groupBy("part").applyInArrow(bundle, _ASKS)
    one = index.withColumns({"copy": each(copies), "kind": F.lit(0)})
    two = asks.withColumns({"block": each(blocks), "kind": F.lit(1)}).withColumn("copy", F.pmod("part", F.lit(copies))).drop("part")
    # a block stands before the queries that stream past it
    meeting = one.unionByName(two, allowMissingColumns=True).repartition(blocks * copies, "block", "copy").sortWithinPartitions("block", "copy", "kind")
    hits = meeting.mapInArrow(search, _HITS)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return hits.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
