"""Token ids packed into fixed-length rows, by best-fit-decreasing with a segment tree over capacities.

Texts become token ids; a document longer than a row is split into pieces that follow each other without
loss. The pieces of a bounded run of documents are placed from long to short, each into the open row with
the least capacity that still takes it: a segment tree over the capacities 0..length, which holds whether a
row of that capacity is open, finds it in O(log length). Each row carries its id matrix line, cumulative
segment lengths, and position ids that start anew with every segment. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
#: Tokens of one run of documents that is packed by itself.
RUN_TOKENS = 2_000_000
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SLICE = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ROWS = "pack_id long, n_tokens long, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
_SCHEMA = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int64()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])
_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    """The encoding of a rank file's content; each worker process builds it once."""
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def encode(text: str, enc: object) -> np.ndarray:
    """Token ids. Long texts go in slices cut before a single space between words, where tokens never span."""
    out, i = [], 0
    while i < len(text):
        m = _CUT.search(text, i + _SLICE)
        j = m.start() if m else len(text)
        out.append(np.array(enc.encode_ordinary(text[i:j]), np.uint32))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class CapacityTree:
    """Rows by free capacity; finds the least capacity of at least a size."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.any = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = self.base + capacity
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of a best fit, which is then no longer there."""
        k = self.base + size
        if not self.any[k]:
            while k > 1 and not (k % 2 == 0 and self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        capacity = k - self.base
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.any[k] = 0
            k >>= 1
            while k and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
                k >>= 1
        return capacity, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece indexes; pieces go from long to short, ties in their order."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.take(sizes[i])
        if got is None:
            got = length, len(rows)
            rows.append([])
        rows[got[1]].append(i)
        if got[0] > sizes[i]:
            tree.put(got[0] - sizes[i], got[1])
    return rows


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ranks_path: str = RANKS, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """Packed rows: pack_id, n_tokens, n_segments, doc_ids and pieces (by segment: document and number of the piece,
    from 0), cu_seqlens (from 0), input_ids and position_ids (little-endian uint32, ``length`` of each).

    Each text is followed by an end token, whose id is the number of ranks; it also fills rows up, beyond the last
    of cu_seqlens and with position 0. The pieces of a document, in order, without the end are its tokens.
    Null and empty texts have no tokens and are in no row. A null doc_id is null in doc_ids; rows that repeat
    a doc_id are documents each for itself. Other columns are ignored; an empty table gives no rows.
    """
    with open(ranks_path, "rb") as f:  # on the driver, which sends the vocabulary to the tasks
        ranks = f.read()
    end = ranks.count(b"\n") + (not ranks.endswith(b"\n"))

    def rows(first: int, ids: list[int | None], tokens: list[np.ndarray]) -> pa.RecordBatch:
        pieces = [(d, k, t[i : i + length]) for d, t in zip(ids, tokens, strict=True) for k, i in enumerate(range(0, len(t), length))]
        packs = best_fit([len(p[2]) for p in pieces], length)
        matrix = np.full((len(packs), length), end, "<u4")
        place = np.zeros((len(packs), length), "<u4")
        docs, parts, cuts = [], [], []
        for r, pack in enumerate(packs):
            at, cut = 0, [0]
            for i in pack:
                t = pieces[i][2]
                matrix[r, at : at + len(t)] = t
                place[r, at : at + len(t)] = np.arange(len(t))
                at += len(t)
                cut.append(at)
            docs.append([pieces[i][0] for i in pack])
            parts.append([pieces[i][1] for i in pack])
            cuts.append(cut)
        cols = [[first + r for r in range(len(packs))], [c[-1] for c in cuts], [len(p) for p in packs], docs, parts, cuts, [m.tobytes() for m in matrix], [m.tobytes() for m in place]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, made = encoder(ranks), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                ids.append(i)
                held.append(np.append(encode(t, enc), np.uint32(end)))
                size += len(held[-1])
                if size >= run_tokens:
                    out = rows(made, ids, held)
                    made, ids, held, size = made + out.num_rows, [], [], 0
                    yield out
        if held:
            yield rows(made, ids, held)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _ROWS)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: the id matrix and position resets as binary columns, a line for each row."""
    packed.write.mode("overwrite").parquet(path)
