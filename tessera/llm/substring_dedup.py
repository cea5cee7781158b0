"""Substring dedup by prefix-partitioned suffix trees (after Mansour et al. 2011, ERA) over words.

A passage of at least ``window`` words that occurs more than once is a repeat: an internal node of the
corpus' suffix tree at that depth or deeper. The tree is never built as a whole. Variable-length prefixes
split the suffixes into groups that fit in memory, each group's subtrees are built by themselves, and their
deep internal nodes are the repeats. Suffixes are cut off at ``window`` words, as deeper nodes cover nothing else.

1. Every part sends the sorted fingerprints of its suffixes' shortest prefixes; a census adds up how
   many different suffixes stand below each. A prefix with one suffix can't hold a repeat and ends there.
   Others get a length by their number of suffixes: SHORT words, then MIDDLE, then the whole window.
2. The suffixes that are left are sent to the group of their prefix (prefixes are dealt to groups by ranges
   of fingerprints, so a group holds many small subtrees), each with the labels of the words below the shortest
   prefix, eight bits of each word. A group's task sorts them into its suffix array, takes the longest
   common prefix of neighbours from the labels, and reads the internal nodes off these lengths. Of
   a node of full depth the first leaf (smallest document, then start) is the original.
3. Each part gets one bit for each suffix that it sent, and removes what repeated windows cover.

Equal suffixes of a part are combined before they are sent, so a passage that a third of all rows hold
costs a few bytes for each part. Eight bits of a word can be equal by chance: a node of full depth counts
only if the fingerprints of the whole windows, 64 bits, are equal too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import _pack as P
from tessera.llm import _text as T

WINDOW = 20
#: Suffixes below one prefix beyond which a longer prefix splits the group.
GROUP = 50_000
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_NO_ID = np.iinfo(np.int64).max


class _Suffixes:
    """The suffixes of a part that are at least a window long, the different ones among them sorted."""

    def __init__(self, part: P.Part, window: int, short: int, middle: int):
        self.s, self.e, self.counts = part.spans()
        x = T.word_hashes(part.buf, self.s, self.e)
        self.at = T.window_starts(self.counts, window)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)[self.at]
        self.doc = np.where(part.nulls & 1, _NO_ID, part.ids)[owner]
        self.start = self.at - (np.cumsum(self.counts) - self.counts)[owner]
        whole, head = T.windows(x, window), T.windows(x, short)
        self.whole, self.head = (whole[self.at], head[self.at]) if len(self.at) else (whole[:0], head[:0])
        ascending = bool((self.doc[1:] > self.doc[:-1]).sum() + (owner[1:] == owner[:-1]).sum() == max(0, len(owner) - 1))
        early = np.arange(len(owner)) if ascending else np.lexsort((self.start, self.doc))
        order = early[np.argsort(self.whole[early], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = self.whole[order[1:]] != self.whole[order[:-1]]
        first = order[new]  # of each class the earliest suffix
        by_head = np.argsort(self.head[first], kind="stable")
        self.first = first[by_head]  # classes sorted by head
        place = np.empty(len(first), np.int64)
        place[by_head] = np.arange(len(first))
        self.cls = np.empty(len(order), np.int64)
        self.cls[order] = place[np.cumsum(new) - 1]
        self.middle = T.windows(x, middle)
        self.label = x.astype(np.uint8)

    def labels(self, suffixes: np.ndarray, short: int, window: int) -> np.ndarray:
        """Of each suffix the labels of the words below its shortest prefix, a byte each."""
        return self.label[self.at[suffixes][:, None] + np.arange(short, window)]


def _codes(payloads: list[bytes], limits: tuple[int, int]) -> list[bytes]:
    """For each prefix 0: one suffix, 1: few, 2: many, 3: very many."""
    got = []
    for b in payloads:
        keys, at = P.get_sorted(b)
        got.append((keys, P.unplanes(b, at)[0]))
    keys, back = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
    total = np.bincount(back, np.concatenate([n for _, n in got]).astype(np.float64), len(keys))
    code = (total >= 2).astype(np.uint8) + (total > limits[0]) + (total > limits[1])
    out = np.split(code[back], np.cumsum([len(k) for k, _ in got])[:-1])
    return [np.packbits(np.stack([c & 1, c >> 1])).tobytes() + len(c).to_bytes(8, "little") for c in out]


def _read_codes(replies: list[bytes]) -> np.ndarray:
    out = [np.zeros(0, np.uint8)]
    for b in replies:
        n = int.from_bytes(b[-8:], "little")
        x = np.unpackbits(np.frombuffer(b[:-8], np.uint8))[: 2 * n].reshape(2, n)
        out.append(x[0] + 2 * x[1])
    return np.concatenate(out)


class Subtrees:
    """The suffix trees of a group: leaves in the order of their labels, and the longest common prefix of each with the one before.

    key: fingerprint of the prefix, whose first ``short`` words count as one edge; labels: a row of bytes for each
    suffix, up to ``window`` words in all; tail: fingerprint of the whole window, the last label of a leaf.
    """

    def __init__(self, key: np.ndarray, labels: np.ndarray, tail: np.ndarray, doc: np.ndarray, start: np.ndarray, short: int, window: int):
        rows, depth = labels.shape
        wide = np.zeros((rows, -(-depth // 8) * 8), np.uint8)
        wide[:, :depth] = labels
        edges = wide.view(">u8").astype(np.uint64)
        self.leaves = np.lexsort((start, doc, tail, *edges.T[::-1], key))
        up, low = self.leaves[:-1], self.leaves[1:]
        common = np.zeros(max(0, rows - 1), np.int64)
        same = key[up] == key[low]
        for k in range(depth):
            common[same] += 1
            same &= labels[up, k] == labels[low, k]
        # where all labels are equal the windows must be
        full = same & (tail[up] == tail[low])
        self.lcp = np.where(common > 0, short + common - 1, 0)
        self.lcp[full] = window

    def internal_nodes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first leaf, last leaf, depth) of the nodes at this depth or deeper, as places among the leaves."""
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for d in np.unique(self.lcp[self.lcp >= least]).tolist():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (self.lcp >= d).astype(np.int8), [0]])))
            a, z = edge[::2], edge[1::2]
            here = np.minimum.reduceat(np.append(self.lcp, 1 << 40), np.stack([a, z], axis=1).reshape(-1))[::2] == d
            for c, v in zip(out, (a[here], z[here], np.full(int(here.sum()), d)), strict=True):
                c.append(v)
        return tuple(np.concatenate(c) for c in out)


def _repeats(payloads: list[bytes], short: int, window: int) -> list[bytes]:
    """Tells of each suffix of a group whether an earlier one has the same window."""
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    for b in payloads:
        key, at = P.get_sorted(b)
        size = len(key) * (window - short)
        labels = np.frombuffer(b, np.uint8, size, at).reshape(window - short, len(key)).T
        tail, at = P.unplanes(b, at + size)
        doc, at = P.get_ids(b, at)
        start, at = P.unplanes(b, at)
        for c, v in zip(cols, (key, labels, tail, doc, start), strict=True):
            c.append(v)
    sizes = [len(k) for k in cols[0]]
    key, labels, tail, doc, start = (np.concatenate(c) for c in cols)
    tree = Subtrees(key, labels, tail, doc, start, short, window)
    first, last, _ = tree.internal_nodes(window)
    below = last - first + 1
    leaf = tree.leaves[np.repeat(first - (np.cumsum(below) - below), below) + np.arange(int(below.sum()))]
    original = np.repeat(tree.leaves[first], below)
    later = np.zeros(len(key), bool)
    later[leaf] = (doc[leaf] != doc[original]) | (start[leaf] != start[original])
    return [np.packbits(x).tobytes() + len(x).to_bytes(8, "little") for x in np.split(later, np.cumsum(sizes)[:-1])]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP, part_bytes: int = P.PART_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_text (kept words joined by one space),
    removed (ranges of word indexes, end exclusive).

    Removed is each word covered by a run of ``window`` words that also starts earlier: in a smaller
    doc_id, or in the same document before. Runs are judged on the input, not on what is left.
    Null or empty texts have no words and an empty kept_text. A null doc_id counts as larger than all
    others. Rows that repeat a doc_id are one place: the same run at the same start of both isn't
    earlier, so neither loses it. Texts shorter than a window keep everything. Other columns are ignored.
    An empty table gives no rows.
    """
    short, middle = max(1, window * 2 // 5), max(1, window * 7 // 10)
    size = P.text_bytes(docs, text_col)
    tokens = max(1, size // 6)
    bits = min(64, -(-(int(tokens).bit_length() + 14) // 8) * 8)
    drop = np.uint64(64 - bits)
    buckets = max(12, -(-tokens // P.ENTRIES))
    packed = P.pack(docs, id_col, text_col, part_bytes=part_bytes).repartition("part")

    def heads(x: _Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shortened prefixes, the suffixes below each, and each class's prefix."""
        cut = x.head[x.first] >> drop  # sorted, as the classes are
        new = np.ones(len(cut), bool)
        new[1:] = cut[1:] != cut[:-1]
        at = np.flatnonzero(new)
        return cut[at], np.diff(np.append(at, len(cut))), np.cumsum(new) - 1

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, p in P.parts_of(b):
                keys, n, _ = heads(_Suffixes(p, window, short, middle))
                cut = P.bucket_edges(keys << drop, buckets)
                yield P.send(part, {k: P.put_sorted(keys[i:j]) + P.planes(n[i:j]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i})

    def chosen(x: _Suffixes, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes that are sent on, and the fingerprints of the prefixes by which they are dealt."""
        by = code[heads(x)[2]] if len(x.first) else np.zeros(0, np.uint8)
        left = np.flatnonzero(by)
        at, by = x.first[left], by[left]
        key = np.where(by == 1, x.head[at], x.whole[at])
        if len(at):
            key = np.where(by == 2, x.middle[x.at[at]], key)
        order = np.argsort(key, kind="stable")
        return left[order], key[order]

    def suffixes(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for part, _, p in P.parts_of(left):
            x = _Suffixes(p, window, short, middle)
            cls, keys = chosen(x, _read_codes(P.replied(right)))
            at = x.first[cls]
            labels = x.labels(at, short, window)
            cut = P.bucket_edges(keys, buckets)
            out.append(P.send(part, {k: P.put_sorted(keys[i:j]) + labels[i:j].T.tobytes() + P.planes(x.whole[at[i:j]]) + P.put_ids(x.doc[at[i:j]]) + P.planes(x.start[at[i:j]]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i}))
        return pa.Table.from_batches(out, P.SENT_SCHEMA)

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = np.array(right.column("kind").to_pylist(), dtype=np.int64)
        tables = []
        for _, _, p in P.parts_of(left):
            x = _Suffixes(p, window, short, middle)
            cls, _ = chosen(x, _read_codes(P.replied(right.filter(pa.array(kinds == 0)))))
            flags = [np.zeros(0, bool)]
            for b in P.replied(right.filter(pa.array(kinds == 1))):
                flags.append(np.unpackbits(np.frombuffer(b[:-8], np.uint8))[: int.from_bytes(b[-8:], "little")].astype(bool))
            later = np.zeros(len(x.first), bool)
            later[cls] = np.concatenate(flags)
            lead = x.first[x.cls]
            again = later[x.cls] | (x.doc != x.doc[lead]) | (x.start != x.start[lead])
            tables.append(_cut(p, x, x.at[again], window))
        return pa.concat_tables(tables) if tables else RESULT_SCHEMA.empty_table()

    from pyspark.sql import functions as F

    limits = (group, 20 * group)
    codes = P.meet(packed.mapInArrow(census, P.SENT), lambda b: _codes(b, limits))
    flags = P.meet(packed.groupBy("part").cogroup(codes.groupBy("part")).applyInArrow(suffixes, P.SENT), lambda b: _repeats(b, short, window))
    both = codes.withColumn("kind", F.lit(0)).unionByName(flags.withColumn("kind", F.lit(1)))
    return packed.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(remove, RESULT)


def _cut(part: P.Part, x: _Suffixes, at: np.ndarray, window: int) -> pa.Table:
    """Documents of a part without the words that windows at these word indexes cover."""
    n = len(x.s)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    ends = np.cumsum(x.counts)
    owner = np.repeat(np.arange(len(x.counts)), x.counts)
    keep = ~gone
    mask = np.zeros(len(part.buf) + 2, np.int8)
    mask[x.s[keep]] += 1
    mask[x.e[keep] + 1] -= 1  # with the byte after the word, which becomes the space
    buf = np.append(part.buf, np.uint8(10))
    buf[x.e] = 32
    out = buf[np.cumsum(mask[: len(buf)]).astype(bool)]
    sizes = np.bincount(owner[keep], (x.e - x.s + 1)[keep], len(x.counts)).astype(np.int64)
    to = np.cumsum(sizes)
    raw = out.tobytes()
    texts = [raw[a : max(a, b - 1)] for a, b in zip((to - sizes).tolist(), to.tolist(), strict=True)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    runs: list[list[dict]] = [[] for _ in x.counts]
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):  # a run may pass from one document into the next
        while a < b:
            d = int(owner[a])
            c = min(b, int(ends[d]))
            base = int(ends[d] - x.counts[d])
            runs[d].append({"start": a - base, "end": c - base})
            a = c
    ids = pa.array(part.ids, mask=(part.nulls & 1).astype(bool))
    return pa.table([ids, pa.array(x.counts), pa.array(np.bincount(owner[gone], minlength=len(x.counts))), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(runs, RESULT_SCHEMA.field("removed").type)], schema=RESULT_SCHEMA)
