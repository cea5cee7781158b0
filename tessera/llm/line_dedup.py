"""Line dedup by an exact set-similarity join (All-Pairs and PPJoin: Bayardo et al. 2007, Xiao et al. 2008).

Two lines match if the Jaccard similarity of their sets of lower-cased words reaches the threshold; a line
goes if a line before it, in the order of doc_id and place, matches it.

1. Equal sets are one class; a census of set fingerprints finds each class's first line, which alone joins.
   The same census counts in how many lines each word occurs, which gives the order of rarity.
2. Each first line sends its prefix, the rarest words of which matching lines must share one, to the words'
   hash ranges: size, position and a bitmap of the set. There the length, positional and bitmap filters
   run over each word's lines, and each sender learns only which of its words left a candidate.
3. Lines send their whole sets for these words, and pairs are verified exactly: intersections come from
   matrix products over blocks of a word's lines, and a pair counts at the rarest word that it shares.
   Back comes, for each line, its number of matches and whether one of them stands earlier.

Pairs are never rows: what travels is proportional to lines, also within large groups of variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _pack as P
from tessera.llm import _text as T

SIMILARITY = (4, 5)
LEAST_WORDS = 1
BLOCK = 1024
#: Lines of a word up to this number are verified pair by pair, more by matrix products.
FEW = 48
BITS = 128
MAPS = -(-BITS // 64)
_TOKEN = 40
_RESULT = "doc_id long, n_lines long, n_removed long, n_links long, class_id long, kept_text string"
_RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_lines", "n_removed", "n_links", "class_id")), ("kept_text", pa.string())])
_NO_ID = np.iinfo(np.int64).max
#: Lines of a part up to which a line's number and a word fit one number.
_PACKED = 1 << (64 - _TOKEN)


def _sets(line: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines and their different tokens, sorted by both."""
    if not len(line):
        return line.astype(np.int64), token
    if line.max() < _PACKED:
        key = np.sort((line.astype(np.uint64) << np.uint64(_TOKEN)) | token)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        return (key >> np.uint64(_TOKEN)).astype(np.int64), key & np.uint64((1 << _TOKEN) - 1)
    order = np.lexsort((token, line))
    line, token = line[order].astype(np.int64), token[order]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (token[1:] != token[:-1])])
    return line[new], token[new]


class Lines:
    """The lines of a part: bytes, place, and the set of words of those with enough words."""

    def __init__(self, part: P.Part, least: int):
        feeds = np.flatnonzero(part.buf == 10)
        start = np.concatenate([[0], feeds[:-1] + 1]) if len(feeds) else feeds
        s, e, _ = part.spans()
        first = np.searchsorted(s, start)
        words = np.diff(np.append(first, len(s)))
        line = np.repeat(np.arange(len(start)), words)
        x = T.word_hashes(T.LOWER[part.buf], s, e) >> np.uint64(64 - _TOKEN)
        full = words > 0
        self.start, self.end = start[full], feeds[full]
        new = np.cumsum(full) - 1
        self.line, self.token = _sets(new[line], x)
        self.size = np.bincount(self.line, minlength=len(self.start))
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.doc_row = np.searchsorted(part.starts, self.start, "right") - 1
        self.doc = np.where(part.nulls & 1, _NO_ID, part.ids)[self.doc_row]
        self.place = self.start - part.starts[self.doc_row]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(self.token + np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)])
        self.print = T.mix(sums[self.off[1:]] - sums[self.off[:-1]] + self.size.astype(np.uint64))
        self.joins = words[full] >= least
        order = np.lexsort((self.start, self.place, self.doc, self.print))
        order = order[self.joins[order]]
        head = np.ones(len(order), bool)
        head[1:] = self.print[order[1:]] != self.print[order[:-1]]
        self.lead = order[head]  # of each class of the part the first line; classes sorted by fingerprint
        self.cls = np.full(len(self.start), -1)
        self.cls[order] = np.cumsum(head) - 1
        # documents with the same lines, as sets and each as often, are one class of documents
        rows = len(part.ids)
        total = np.zeros(rows, np.uint64)
        np.add.at(total, self.doc_row, T.mix(self.print ^ np.uint64(0x452821E638D01377)))
        self.doc_print = T.mix(total)
        self.doc_id = np.where(part.nulls & 1, _NO_ID, part.ids)
        self.doc_keys, self.doc_cls = np.unique(self.doc_print, return_inverse=True)
        self.doc_least = np.full(len(self.doc_keys), _NO_ID)
        np.minimum.at(self.doc_least, self.doc_cls, self.doc_id)


def _prefix(n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    return n - -(-n * similarity[0] // similarity[1]) + 1


def _overlap(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Least intersection of matching sets of these sizes."""
    num, den = similarity
    return -(-num * (a + b) // (num + den))


def _count(payloads: list[bytes]) -> list[bytes]:
    """Of each class whether it is the first of all parts, the order of rarity of each word, the smallest document of each class."""
    fps, docs, places, words, counts, prints, least = [], [], [], [], [], [], []
    for b in payloads:
        x, at = P.get_sorted(b)
        d, at = P.get_ids(b, at)
        p, at = P.unplanes(b, at)
        w, at = P.get_sorted(b, at)
        n, at = P.unplanes(b, at)
        k, at = P.get_sorted(b, at)
        m, at = P.get_ids(b, at)
        for c, v in zip((fps, docs, places, words, counts, prints, least), (x, d, p, w, n, k, m), strict=True):
            c.append(v)
    src = np.repeat(np.arange(len(payloads)), [len(x) for x in fps])
    f, d, p = (np.concatenate(c) for c in (fps, docs, places))
    order = np.lexsort((src, p, d, f))
    first = np.zeros(len(f), bool)
    first[order] = np.concatenate([[True], f[order[1:]] != f[order[:-1]]]) if len(f) else False
    w, back = np.unique(np.concatenate(words), return_inverse=True)
    df = np.bincount(back, np.concatenate(counts).astype(float), len(w)).astype(np.uint64)[back]
    heads = np.split(first, np.cumsum([len(x) for x in fps])[:-1])
    dfs = np.split(df, np.cumsum([len(x) for x in words])[:-1])
    k, back = np.unique(np.concatenate(prints), return_inverse=True)
    small = np.full(len(k), _NO_ID)
    np.minimum.at(small, back, np.concatenate(least))
    small = np.split(small[back], np.cumsum([len(x) for x in prints])[:-1])
    return [P.planes(h.astype(np.uint64)) + P.planes(n) + P.put_ids(m) for h, n, m in zip(heads, dfs, small, strict=True)]


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1], [True]])) if len(sorted_values) else np.zeros(1, np.int64)
    return edge[:-1], edge[1:]


def _neighbours(word: np.ndarray, n: np.ndarray, similarity: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one word whose sizes fit, as arrays: those at distance 1, 2, ... in rows sorted by word, then size."""
    num, den = similarity
    a, step = np.arange(len(word)), 0
    while True:
        step += 1
        a = a[a + step < len(word)]
        b = a + step
        # sizes ascend within a word: where a distance is too far, so are all larger ones
        a = a[(word[b] == word[a]) & (n[b] * num <= n[a] * den)]
        if not len(a):
            return
        yield a, a + step


def _candidates(payloads: list[bytes], similarity: tuple[int, int]) -> list[bytes]:
    """The entries (line, position of the word) of which the word has a line that passes the filters."""
    cols: list[list[np.ndarray]] = [[] for _ in range(4 + MAPS)]
    for b in payloads:
        x, at = P.get_sorted(b)
        cols[0].append(x)
        for c in cols[1:]:
            x, at = P.unplanes(b, at)
            c.append(x)
    sizes = [len(x) for x in cols[0]]
    word, n, pos, line = (np.concatenate(c).astype(np.int64) for c in cols[:4])
    maps = np.stack([np.concatenate(c) for c in cols[4:]], axis=1) if sizes else np.zeros((0, MAPS), np.uint64)
    live = np.zeros(len(word), bool)
    order = np.lexsort((n, word))
    at = pos
    word, n, pos, maps = word[order], n[order], pos[order], maps[order]
    for a, b in _neighbours(word, n, similarity):
        need = _overlap(n[a], n[b], similarity)
        ok = (pos[a] <= n[a] - need) & (pos[b] <= n[b] - need)
        a, b, need = a[ok], b[ok], need[ok]
        ok = n[a] - np.bitwise_count(maps[a] & ~maps[b]).sum(axis=1) >= need
        ok &= n[b] - np.bitwise_count(maps[b] & ~maps[a]).sum(axis=1) >= need
        live[order[a[ok]]] = True
        live[order[b[ok]]] = True
    cut = np.cumsum(sizes)[:-1]
    return [P.planes(k[x].astype(np.uint64)) + P.planes(q[x].astype(np.uint64)) for x, k, q in zip(np.split(live, cut), np.split(line, cut), np.split(at, cut), strict=True)]


def _matches(payloads: list[bytes], similarity: tuple[int, int]) -> list[bytes]:
    """For each line with verified matches that count at a word: the line, how many, and whether one of them stands earlier."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    sets: list[np.ndarray] = []
    for b in payloads:
        b = zstandard.ZstdDecompressor().decompress(b)
        x, at = P.get_sorted(b)
        cols[0].append(x)
        for k, c in enumerate(cols[1:], 1):
            x, at = P.get_ids(b, at) if k == 3 else P.unplanes(b, at)
            c.append(x)
        sets.append(P.unplanes(b, at)[0])
    sizes = [len(x) for x in cols[0]]
    src = np.repeat(np.arange(len(payloads)), sizes)
    word, n, pos, doc, place, line = (np.concatenate(c).astype(np.int64) for c in cols)
    token = np.concatenate(sets)
    off = np.cumsum(n) - n
    links, early = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
    order = np.lexsort((n, word))

    def members(rows: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(upto)
        return np.repeat(np.arange(len(rows)), upto), token[np.repeat(off[rows] - (ends - upto), upto) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def count(a: np.ndarray, b: np.ndarray) -> None:
        """Matches that count here: of each pair the later line has one that stands earlier."""
        np.add.at(links, a, 1)
        np.add.at(links, b, 1)
        first, same = np.zeros(len(a), bool), np.ones(len(a), bool)
        for x in (doc, place, src, line):
            first |= same & (x[a] < x[b])
            same &= x[a] == x[b]
        early[b[first]] = True
        early[a[~first]] = True

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        """Verifies pairs of lines by merging their sets."""
        need = _overlap(n[a], n[b], similarity)
        ok = (pos[a] <= n[a] - need) & (pos[b] <= n[b] - need)
        a, b, need = a[ok], b[ok], need[ok]
        if not len(a):
            return
        rows = np.concatenate([a, b])
        owner, t = members(rows, n[rows])
        ends = np.cumsum(n[rows])
        soon = np.arange(len(t)) - (ends - n[rows])[owner] < pos[rows][owner]  # rarer than the word
        key = ((owner % len(a)).astype(np.uint64) << np.uint64(_TOKEN + 1)) | (t.astype(np.uint64) << np.uint64(1)) | soon.astype(np.uint64)
        key.sort()
        both = key[:-1] >> np.uint64(1) == key[1:] >> np.uint64(1)
        pair = (key[:-1][both] >> np.uint64(_TOKEN + 1)).astype(np.int64)
        inter = np.bincount(pair, minlength=len(a))
        before = np.bincount(pair, key[:-1][both] & key[1:][both] & np.uint64(1), len(a))
        ok = (inter >= need) & (before == 0)
        count(a[ok], b[ok])

    def products(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray) -> np.ndarray:
        (ra, ta), (rb, tb) = members(a, ua), members(b, ub)
        out = np.zeros((len(a), len(b)), np.float32)
        both = np.intersect1d(ta, tb)
        for lo in range(0, len(both), 2048):
            part = both[lo : lo + 2048]
            ms = []
            for rows, r, t in ((a, ra, ta), (b, rb, tb)):
                c = np.searchsorted(part, t)
                c[c == len(part)] = 0
                hit = part[c] == t
                m = np.zeros((len(rows), len(part)), np.float32)
                m[r[hit], c[hit]] = 1
                ms.append(m)
            out += ms[0] @ ms[1].T
        return out

    begin, end = _runs(word[order])
    few = np.repeat(end - begin <= FEW, end - begin)
    some = order[few]
    for i, j in _neighbours(word[some], n[some], similarity):
        for k in range(0, len(i), 1 << 14):
            settle(some[i[k : k + (1 << 14)]], some[j[k : k + (1 << 14)]])
    large = end - begin > FEW
    for i, j in zip(begin[large], end[large], strict=True):
        at = order[i:j]
        for k in range(0, len(at), BLOCK):
            a = at[k : k + BLOCK]
            for m in range(k, len(at), BLOCK):
                b = at[m : m + BLOCK]
                if n[a].max() * similarity[1] < n[b].min() * similarity[0]:
                    break
                inter = products(a, b, n[a], n[b])
                ok = inter >= _overlap(n[a][:, None], n[b][None, :], similarity)
                if m == k:
                    ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
                r, c = np.nonzero(ok)
                if not len(r):
                    continue
                before = products(a, b, pos[a], pos[b])[r, c]
                count(a[r[before == 0]], b[c[before == 0]])
    out = []
    for i, j in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
        hit = i + np.flatnonzero(links[i:j])
        out.append(b"".join(P.planes(x[hit].astype(np.uint64)) for x in (line, links, early)))
    return out


def _columns(replies: list[bytes], width: int, ids: int = -1) -> list[np.ndarray]:
    """Columns of all replies; the one of number ``ids`` is signed."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64 if k == ids else np.uint64)] for k in range(width)]
    for b in replies:
        at = 0
        for k, c in enumerate(out):
            x, at = P.get_ids(b, at) if k == ids else P.unplanes(b, at)
            c.append(x)
    return [np.concatenate(c) for c in out]


class _Work:
    """What the stages of the join recompute for a part from the census: its first lines, and their words by rarity."""

    def __init__(self, part: P.Part, least: int, counted: list[bytes]):
        self.x = x = Lines(part, least)
        first, self.rank, least_doc = _columns(counted, 3, 2)
        self.class_id = least_doc[x.doc_cls]
        self.lines = x.lead[first.astype(bool)]

    def by_rarity(self, some: np.ndarray) -> None:
        """Sets of some of the first lines, as token, rarity, owner (an index of some), with sizes n and offsets."""
        x = self.x
        words = P.distinct(x.token[_of(x, x.lead)])
        order = np.lexsort((words, self.rank))
        spot = np.empty(len(words), np.uint64)
        spot[order] = np.arange(len(words), dtype=np.uint64)
        lines = self.lines[some]
        self.owner = np.repeat(np.arange(len(lines)), x.size[lines])
        key = (self.owner.astype(np.uint64) << np.uint64(32)) | spot[_place(words, x.token[_of(x, lines)])]
        key.sort()
        by = order[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)] if len(key) else np.zeros(0, np.int64)
        self.token, self.rarity = words[by], self.rank[by]
        self.n = x.size[lines]
        self.off = np.cumsum(self.n) - self.n


def _place(words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Indexes of tokens in words, which are sorted and hold them all: by their leading bits, then step by step."""
    bits = max(1, len(words).bit_length())
    shift = np.uint64(_TOKEN - bits)
    begin = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << shift)
    at = begin[(tokens >> shift).astype(np.int64)]
    left = np.flatnonzero(words[at] < tokens)
    while len(left):
        at[left] += 1
        left = left[words[at[left]] < tokens[left]]
    return at


def _of(x: Lines, lines: np.ndarray) -> np.ndarray:
    """Indexes of the words of these lines."""
    n = x.size[lines]
    ends = np.cumsum(n)
    return np.repeat(x.off[lines] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (lines that aren't blank), n_removed, n_links, class_id, kept_text.

    n_links: matches of the document's lines with other sets, counted for each set at its first line.
    class_id: the smallest doc_id with the same lines, as sets of words, each as often and in any order; documents without
    lines are such a class too. kept_text: kept lines, whole, joined by line feeds; blank lines go.
    Lines of fewer than ``least_words`` words are kept and match nothing. Null and empty texts have no lines.
    A null doc_id is larger than all others. Lines of rows that repeat a doc_id are ordered by their place in
    their rows; those at the same place by the order of the input's parts, within a part by fingerprint. Other
    columns are ignored; an empty table gives no rows.
    """
    tokens = max(1, P.text_bytes(docs, text_col) // 6)
    buckets = max(12, -(-tokens // P.ENTRIES))
    packed = P.pack(docs, id_col, text_col).repartition("part")
    shift = np.uint64(64 - _TOKEN)
    bounds = lambda keys: P.bucket_edges(keys << shift, buckets)

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, p in P.parts_of(b):
                x = Lines(p, least_words)
                fps = x.print[x.lead]
                words, n = np.unique(x.token[_of(x, x.lead)], return_counts=True)
                one, two, three = P.bucket_edges(fps, buckets), bounds(words), P.bucket_edges(x.doc_keys, buckets)
                doc, place = x.doc[x.lead], x.place[x.lead]
                yield P.send(part, {k: P.put_sorted(fps[i:j]) + P.put_ids(doc[i:j]) + P.planes(place[i:j]) + P.put_sorted(words[g:h]) + P.planes(n[g:h]) + P.put_sorted(x.doc_keys[u:v]) + P.put_ids(x.doc_least[u:v]) for k, (i, j, g, h, u, v) in enumerate(zip(one[:-1], one[1:], two[:-1], two[1:], three[:-1], three[1:], strict=True)) if j > i or h > g or v > u})

    def prefixes(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for part, _, p in P.parts_of(left):
            w = _Work(p, least_words, P.replied(right))
            w.by_rarity(np.arange(len(w.lines)))
            bit = (T.mix(w.token) % np.uint64(BITS)).astype(np.int64)
            dense = np.zeros((len(w.lines), MAPS * 64), np.uint8)
            dense[w.owner, bit] = 1
            maps = np.packbits(dense, axis=1, bitorder="little").view(np.uint64).reshape(len(w.lines), MAPS)
            pos = np.arange(len(w.token)) - np.repeat(w.off, w.n)
            entry = np.flatnonzero((pos < _prefix(w.n, similarity)[w.owner]) & (w.rarity > 1))
            entry = entry[np.argsort(w.token[entry])]
            own = w.owner[entry]
            cols = [w.n[own], pos[entry], own, *maps[own].T]
            cut = bounds(w.token[entry])
            out.append(P.send(part, {k: P.put_sorted(w.token[entry[i:j]]) + b"".join(P.planes(c[i:j]) for c in cols) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i}))
        return pa.Table.from_batches(out, P.SENT_SCHEMA)

    def whole(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for part, _, p in P.parts_of(left):
            counted, live = _replies(right, 2)
            w = _Work(p, least_words, counted)
            line, pos = (c.astype(np.int64) for c in _columns(live, 2))
            some, own = np.unique(line, return_inverse=True)
            w.by_rarity(some)
            token = w.token[w.off[own] + pos] if len(own) else w.token[:0]
            order = np.argsort(token)
            token, own, pos = token[order], own[order], pos[order]
            place = w.lines[some][own]
            cols = [w.n[own], pos, w.x.doc[place], w.x.place[place], some[own]]
            cut = bounds(token)
            press = zstandard.ZstdCompressor(level=1).compress

            def body(i: int, j: int, w: _Work = w, own: np.ndarray = own, token: np.ndarray = token, cols: list = cols) -> bytes:
                n = w.n[own[i:j]]
                ends = np.cumsum(n)
                sets = w.token[np.repeat(w.off[own[i:j]] - (ends - n), n) + np.arange(int(ends[-1]))]
                return press(P.put_sorted(token[i:j]) + b"".join((P.put_ids if k == 2 else P.planes)(c[i:j]) for k, c in enumerate(cols)) + P.planes(sets))

            out.append(P.send(part, {k: body(i, j) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i}))
        return pa.Table.from_batches(out, P.SENT_SCHEMA)

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for _, _, p in P.parts_of(left):
            counted, got = _replies(right, 2)
            w = _Work(p, least_words, counted)
            line, links, early = (c.astype(np.int64) for c in _columns(got, 3))
            n_links = np.bincount(line, links, len(w.lines))
            x = w.x
            gone = x.joins.copy()  # all but those shown to be the first of their class
            gone[w.lines] = np.bincount(line, early, len(w.lines)) > 0
            tables.append(_rest(p, w, gone, np.bincount(x.doc_row[w.lines], n_links, len(p.ids)).astype(np.int64)))
        return pa.concat_tables(tables) if tables else _RESULT_SCHEMA.empty_table()

    step = packed.groupBy("part")
    # dealt by part at once, so that each reply is made once and its exchange is reused
    codes = P.meet(packed.mapInArrow(census, P.SENT), _count).repartition("part")
    one = codes.withColumn("kind", F.lit(0))
    live = P.meet(step.cogroup(codes.groupBy("part")).applyInArrow(prefixes, P.SENT), lambda b: _candidates(b, similarity)).repartition("part")
    two = one.unionByName(live.withColumn("kind", F.lit(1)))
    found = P.meet(step.cogroup(two.groupBy("part")).applyInArrow(whole, P.SENT), lambda b: _matches(b, similarity))
    three = one.unionByName(found.withColumn("kind", F.lit(1)))
    return step.cogroup(three.groupBy("part")).applyInArrow(remove, _RESULT)


def _replies(right: pa.Table, kinds: int) -> list[list[bytes]]:
    kind = right.column("kind").to_numpy()
    return [P.replied(right.filter(pa.array(kind == k))) for k in range(kinds)]


def _rest(part: P.Part, w: _Work, gone: np.ndarray, links: np.ndarray) -> pa.Table:
    """Documents of a part without these lines."""
    x = w.x
    keep = ~gone
    mask = np.zeros(len(part.buf) + 1, np.int8)
    mask[x.start[keep]] += 1
    mask[x.end[keep] + 1] -= 1
    raw = part.buf[np.cumsum(mask[:-1]).astype(bool)].tobytes()
    rows = len(part.ids)
    size = np.bincount(x.doc_row[keep], (x.end - x.start + 1)[keep], rows).astype(np.int64)
    to = np.cumsum(size)
    texts = [raw[a : max(a, b - 1)] for a, b in zip((to - size).tolist(), to.tolist(), strict=True)]
    ids = pa.array(part.ids, mask=(part.nulls & 1).astype(bool))
    return pa.table([ids, pa.array(np.bincount(x.doc_row, minlength=rows)), pa.array(np.bincount(x.doc_row[gone], minlength=rows)), pa.array(links), pa.array(w.class_id, mask=w.class_id == _NO_ID), pa.array(texts, pa.binary()).cast(pa.string())], schema=_RESULT_SCHEMA)
