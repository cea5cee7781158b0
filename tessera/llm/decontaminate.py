"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item of q shingles inside a document of x shingles has a Jaccard similarity of about q / x however
complete it is, so one similarity threshold can't serve all sizes. As in the LSH Ensemble (Zhu et al.
2016), documents are partitioned by size, and items by theirs: for each pair of partitions the containment
threshold gives the least similarity of a true pair, and that gives the number of sketch coordinates at
which such a pair agrees nowhere with a chance below 1e-9. Items and documents that agree in a coordinate
are candidates and are verified on exact shingle sets. Where that number exceeds the document's number of
shingles (items very short for the document), its whole set takes the place of the sketch.

Coordinates are those of fast similarity sketching. A coordinate agrees only where both sides filled it
in the same round, and a document fills its sketch within a few rounds, so an item needs no later ones.
Documents stream past the items' index; only the pairs found are shuffled. Items come in blocks of bounded
size, each a pass over the documents whose result is written before the next block is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._sketch import EMPTY
from tessera.llm._pack import written
from tessera.llm.near_dedup import shingles_of

WIDTH = 5
CONTAINMENT = (80, 100)
#: Bytes of item texts in one block, which the driver sends to every task.
BLOCK_BYTES = 8 << 20
MISS = 1e-9
ROUNDS = 48
_PAIRS = "doc_id long, item_id long, shared long, n_item long"
_PAIRS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("n_item", pa.int64())])


def coordinates(item_least: int, doc_most: int, containment: tuple[int, int]) -> int:
    """Coordinates at which an item of at least so many shingles and a document of at most so many agree at least once."""
    t = containment[0] / containment[1]
    least = t * item_least / (item_least + doc_most - t * item_least)
    return math.ceil(math.log(MISS) / math.log(1 - least)) if least < 1 else 1


def _first_filled(elements: np.ndarray, owner: np.ndarray, sets: int, size: int, until_full: bool) -> tuple[np.ndarray, np.ndarray]:
    """(set, agreement key) of each coordinate that is filled within ROUNDS rounds; equal keys: same coordinate, round and element."""
    out = np.full(sets * size, EMPTY)
    bin_of = np.arange(sets * size, dtype=np.uint64) % np.uint64(size)
    for k in range(1, ROUNDS + 1):
        h = T.mix(elements ^ np.uint64((k * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64))
        at = owner * size + ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        free = out[at] == EMPTY
        np.minimum.at(out, at[free], h[free])
        if until_full:
            open_ = (out.reshape(sets, size) == EMPTY).any(axis=1)
            if not open_.any():
                break
            elements, owner = elements[open_[owner]], owner[open_[owner]]
    full = np.flatnonzero(out != EMPTY)
    return full // size, T.mix(out[full] + bin_of[full] * np.uint64(0x9E3779B97F4A7C15))


class ItemIndex:
    """The items of a block: their shingle sets, and for each pair of size partitions the items' coordinates."""

    def __init__(self, texts: list[bytes | None], width: int, containment: tuple[int, int]):
        self.containment = containment
        self.els, self.off = shingles_of(texts, width)
        self.n = np.diff(self.off)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.least = np.where(self.n > 0, 1 << np.maximum(np.frexp(np.maximum(self.n, 1))[1] - 1, 0), 0)
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def table(self, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and items; size 0: the elements themselves."""
        if (least, size) not in self.tables:
            use = self.least[self.owner] == least
            owner, els = self.owner[use], self.els[use]
            keys = els
            if size:
                names, small = np.unique(owner, return_inverse=True)
                rows, keys = _first_filled(els, small, len(names), size, False)
                owner = names[rows]
            order = np.argsort(keys, kind="stable")
            self.tables[least, size] = keys[order], owner[order]
        return self.tables[least, size]

    def matches(self, els: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of all contained items, for documents given as sorted sets."""
        n = np.diff(off)
        most = np.where(n > 0, 1 << np.frexp(np.maximum(n - 1, 0))[1], 0)
        found: list[np.ndarray] = []
        for u in np.unique(most[n > 0]).tolist():
            docs = np.flatnonzero(most == u)
            sizes = n[docs]
            to = np.cumsum(sizes)
            mine = els[np.repeat(off[docs] - (to - sizes), sizes) + np.arange(int(to[-1]))]
            owner = np.repeat(np.arange(len(docs)), sizes)
            for least in np.unique(self.least[self.n > 0]).tolist():
                size = coordinates(least, max(u, least), self.containment)
                size = size if size < u else 0
                keys, items = self.table(least, size)
                rows, look = _first_filled(mine, owner, len(docs), size, True) if size else (owner, mine)
                lo, hi = np.searchsorted(keys, look), np.searchsorted(keys, look, "right")
                hit = np.flatnonzero(hi > lo)
                count = (hi - lo)[hit]
                ends = np.cumsum(count)
                at = np.repeat(lo[hit] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
                found.append(np.unique(np.stack([docs[np.repeat(rows[hit], count)], items[at]]), axis=1))
        out = []
        for d, i in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist() if found else []:
            mine, item = els[off[d] : off[d + 1]], self.els[self.off[i] : self.off[i + 1]]
            at = np.searchsorted(mine, item)
            at[at == len(mine)] = 0
            shared = int((mine[at] == item).sum())
            if self.containment[1] * shared >= self.containment[0] * len(item):
                out.append((d, i, shared))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int | None], list[bytes], bool]]:
    """The items in blocks of bounded size, and whether the block is the last."""
    one = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = one.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        rows = one.where(F.expr(f"pmod(xxhash64(i, t), {blocks}) = {k}")).collect()
        yield [r["i"] for r in rows], [r["t"].encode() for r in rows], k == blocks - 1


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, containment: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, n_item): each document that holds an item, by shared / n_item >= containment.

    Shingles are distinct runs of ``width`` words after A-Z are lowered; a text with fewer words is one
    shingle as a whole, so such an item is found only in documents that consist of it. Null and empty texts
    hold and match nothing; a null doc_id or item_id is reported as null. Rows that repeat an id on either side
    are judged each for itself, and equal result rows are one, whatever the partitions. Other columns are
    ignored; an empty table on either side gives no rows.
    """
    one = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = None
    for ids, texts, last in item_blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, texts: list = texts) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(texts, width, containment)
            for b in batches:
                for i, j, t in T.slices(b.column(1)):
                    own = b.column(0).slice(i, j - i).to_pylist()
                    got = [(own[d], ids[k], s, int(index.n[k])) for d, k, s in index.matches(*shingles_of(t, width))]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), _PAIRS_SCHEMA, strict=True)], schema=_PAIRS_SCHEMA)

        found = one.mapInArrow(run, _PAIRS)
        found = found if last else written(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, containment: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item; cases as in contaminated_pairs."""
    at = docs.columns.index(text_col)
    for _, texts, last in item_blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], texts: list = texts) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(texts, width, containment)
            for b in batches:
                held = np.zeros(b.num_rows, bool)
                for i, _, t in T.slices(b.column(at).cast(pa.string())):
                    held[[i + d for d, _, _ in index.matches(*shingles_of(t, width))]] = True
                yield b.filter(pa.array(~held))

        docs = docs.mapInArrow(run, docs.schema)
        docs = docs if last else written(docs, "decontaminated")
    return docs
