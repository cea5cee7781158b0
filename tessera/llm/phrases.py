"""Phrase collocations by pivot partitioning (after Miliaraki et al. 2013, MG-FSM) for contiguous phrases.

Words are ordered by how rare they are in their language; a phrase belongs to its rarest word, the pivot (the
first of equal ones).

1. A census counts words by language and tells each part the counts of its own words, and which part spells a word out.
2. Each part rewrites its text for every pivot that it holds: an occurrence becomes the fragment of at most two
   words to either side, cut at the piece's end, at words too rare to be in a candidate and at words that
   come before the pivot in order (they own what lies beyond). Equal fragments are combined, with their
   number, and sent to the pivot's group. A pivot of very many occurrences has several groups, and a part
   always uses the same of them.
3. A group mines its fragments by itself: all phrases in them that hold the pivot's place, and nothing else.
   Counts of pivots with one group are final; those of the others are added up.
4. DataFrames score candidates, drop those inside longer ones and take each language's first.

Words are compared by 64-bit fingerprints that hold their language; phrases by the fingerprints of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _pack as P
from tessera.llm import _text as T

LEAST = 10
FIRST = 2000
#: A candidate goes if a longer one around it has at least this share of its occurrences, in hundredths.
INSIDE = 50
#: Words of text for each group of pivots.
ENTRIES = 1_000_000
#: Occurrences of a pivot for each of its groups.
HOT = 500_000
#: Characters of a row; longer texts are cut at the ends of pieces.
ROW = 1_000_000

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LANG = np.uint64(0x9E3779B97F4A7C15)
_VOCABULARY = "lang long, word long, text string, f long"
_VOCABULARY_SCHEMA = pa.schema([("lang", pa.int64()), ("word", pa.int64()), ("text", pa.string()), ("f", pa.int64())])
_MINED = "lang long, w1 long, w2 long, w3 long, f1 long, f2 long, f3 long, a long"
_MINED_SCHEMA = pa.schema([(c, pa.int64()) for c in ("lang", "w1", "w2", "w3", "f1", "f2", "f3", "a")])
_PACKABLE = 1 << 21


class _Words:
    """The words of a part: spans, each's place among the part's different words, and whether the next word follows in the same piece."""

    def __init__(self, part: P.Part):
        self.buf = T.LOWER[part.buf]
        edge = np.flatnonzero(np.diff(_GAP[self.buf], prepend=True, append=True))
        self.s, self.e = edge[::2], edge[1::2]
        doc = np.searchsorted(part.starts, self.s, "right") - 1
        piece = np.cumsum(_BREAK[self.buf])[self.s] if len(self.s) else np.zeros(0, np.int64)
        # a line feed stands between documents, so that pieces end with them
        self.follows = piece[1:] == piece[:-1]
        lang = part.ids.view(np.uint64)
        h = T.mix(T.word_hashes(self.buf, self.s, self.e) + T.mix(lang + _LANG)[doc])
        self.keys, self.first, self.at, self.counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.lang = part.ids[doc[self.first]]
        self.langs, n = np.unique(part.ids[doc], return_counts=True)
        self.n = n

    def text(self, k: int) -> str:
        i = self.first[k]
        return self.buf[self.s[i] : self.e[i]].tobytes().decode("utf-8", "replace")


def _totals(payloads: list[bytes]) -> list[bytes]:
    """For each word of each part its count over all parts, and whether this part is the first that holds it."""
    got = []
    for b in payloads:
        keys, at = P.get_sorted(b)
        got.append((keys, P.get_counts(b, at)[0]))
    every = np.concatenate([k for k, _ in got])
    keys, first, back = np.unique(every, return_index=True, return_inverse=True)
    total = np.zeros(len(keys), np.uint64)
    np.add.at(total, back, np.concatenate([n for _, n in got]))
    lead = np.zeros(len(every), np.uint8)
    lead[first] = 1
    cut = np.cumsum([len(k) for k, _ in got])[:-1]
    return [P.put_counts(t) + np.packbits(f).tobytes() for t, f in zip(np.split(total[back], cut), np.split(lead, cut), strict=True)]


def _read_totals(replies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    totals, leads = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for b in replies:
        t, at = P.get_counts(b)
        totals.append(t)
        leads.append(np.unpackbits(np.frombuffer(b, np.uint8, -(-len(t) // 8), at))[: len(t)])
    return np.concatenate(totals).astype(np.int64), np.concatenate(leads).astype(bool)


def _grouped(cols: list[np.ndarray], n: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of up to six columns of numbers below size, from -1 on, as one with the sum of n."""
    if size < _PACKABLE - 1 and len(n):
        keys = []
        for k in range(0, len(cols), 3):
            key = np.zeros(len(n), np.int64)
            for c in cols[k : k + 3]:
                key = key << 21 | (c.astype(np.int64) + 1)
            keys.append(key)
    else:
        keys = cols
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    start = np.flatnonzero(new)
    return [c[order[start]] for c in cols], np.add.reduceat(n[order], start) if len(start) else n[:0]


def _fragments(x: _Words, f: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The part's fragments, equal ones once: places (two before the pivot, one before, pivot, one after, two after; -1: none), number."""
    rare = np.empty(len(f), np.int64)
    rare[np.lexsort((x.keys, -f))] = np.arange(len(f))  # the larger, the rarer; the same order in all parts
    n = len(x.at)
    w = np.concatenate([[-1, -1], x.at, [-1, -1]])
    r = np.concatenate([[n, n], rare[x.at], [n, n]])
    ok = f[x.at] >= least
    near = np.zeros(n + 3, bool)  # whether the words at i - 1 and i of w, without its two first, follow each other
    near[2 : n + 1] = x.follows & ok[1:] & ok[:-1]
    i = np.arange(2, n + 2)
    before = near[i - 1] & (r[i - 1] < r[i])
    after = near[i] & (r[i + 1] <= r[i])
    before2 = before & near[i - 2] & (r[i - 2] < r[i])
    after2 = after & near[np.minimum(i + 1, n + 2)] & (r[i + 2] <= r[i])
    has = np.flatnonzero(before | after)
    pick = lambda yes, step: np.where(yes[has], w[has + 2 + step], -1)
    cols = [pick(before2, -2), pick(before, -1), w[has + 2], pick(after, 1), pick(after2, 2)]
    return _grouped([cols[2], cols[0], cols[1], cols[3], cols[4]], np.ones(len(has), np.int64), len(f))


def _message(x: _Words, f: np.ndarray, cols: list[np.ndarray], n: np.ndarray) -> bytes:
    used = np.unique(np.concatenate(cols))
    used = used[used >= 0]
    langs, lang = np.unique(x.lang[used], return_inverse=True)
    at = np.full(len(f) + 1, -1, np.int64)
    at[used] = np.arange(len(used))
    body = P.put_sorted(x.keys[used]) + P.put_counts(f[used]) + P.put_ids(langs) + P.put_counts(lang)
    return body + b"".join(P.put_counts(at[c] + 1) for c in cols) + P.put_counts(n)


def _read_message(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    keys, at = P.get_sorted(b)
    f, at = P.get_counts(b, at)
    langs, at = P.get_ids(b, at)
    lang, at = P.get_counts(b, at)
    cols = []
    for _ in range(5):
        c, at = P.get_counts(b, at)
        cols.append(c.astype(np.int64) - 1)
    n, _ = P.get_counts(b, at)
    return keys, f.astype(np.int64), langs[lang.astype(np.int64)], cols, n.astype(np.int64)


def _mine(payloads: list[bytes], least: int) -> pa.Table:
    """Phrases of two and three words of a group's fragments that hold the pivot's place, with at least so many occurrences."""
    got = [_read_message(b) for b in payloads]
    keys, first, back = np.unique(np.concatenate([g[0] for g in got]), return_index=True, return_inverse=True)
    f, lang = (np.concatenate([g[k] for g in got])[first] for k in (1, 2))
    offset = np.cumsum([0, *(len(g[0]) for g in got)])
    cols = []
    for k in range(5):
        own = [np.where(g[3][k] < 0, -1, back[np.minimum(g[3][k], len(g[0]) - 1) + o]) for g, o in zip(got, offset[:-1], strict=True)]
        cols.append(np.concatenate(own))
    n = np.concatenate([g[4] for g in got])
    (p, b2, b1, a1, a2), n = _grouped(cols, n, len(keys))
    parts = []
    for row in ((b1, p), (p, a1), (b2, b1, p), (b1, p, a1), (p, a1, a2)):
        here = np.flatnonzero(np.all([c >= 0 for c in row], axis=0))
        parts.append(([c[here] for c in row] + [np.full(len(here), -1)] * (3 - len(row)), n[here]))
    words, a = _grouped([np.concatenate([q[0][k] for q in parts]) for k in range(3)], np.concatenate([q[1] for q in parts]), len(keys))
    enough = a >= least
    words, a = [w[enough] for w in words], a[enough]
    signed = keys.view(np.int64)
    three = words[2] >= 0
    out = [lang[words[0]], *(signed[w] for w in words), *(f[w] for w in words), a]
    return pa.table([pa.array(c, pa.int64(), mask=~three if k in (3, 6) else None) for k, c in enumerate(out)], schema=_MINED_SCHEMA)


def _rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, a fingerprint of it, and text, in rows of a bounded size: cut behind marks that end a piece, if a text is long."""
    ends = r"[.,;:!?\x0A-\x0D]"
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    text = F.col(text_col).cast("string")
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{ROW}}}(?:{ends}|\z)|[^.,;:!?\x0A-\x0D]+(?:{ends}|\z)"), F.lit(0))
    rows = docs.select(lang.alias("lang"), F.explode(F.when(F.length(text) > ROW, cut).otherwise(F.array(text))).alias("text"))
    return rows.select("lang", F.xxhash64("lang").alias("key"), "text")


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, entries: int = ENTRIES, hot: int = HOT, part_bytes: int = P.PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases, vocabulary): lang, w1, w2, w3 (null: two words), the words' counts f1, f2, f3 and the phrase's a; and of
    each word of at least ``least`` occurrences lang, word, text, f, with one row of word null for some share of a language's words.

    lang and words are fingerprints."""
    rows = _rows(docs, lang_col, text_col)
    groups = max(12, -(-P.text_bytes(rows, "text") // (6 * entries)))
    packed = P.pack(rows, "key", "text", part_bytes=part_bytes).repartition("part")

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, p in P.parts_of(b):
                x = _Words(p)
                cut = P.bucket_edges(x.keys, groups)
                yield P.send(part, {k: P.put_sorted(x.keys[i:j]) + P.put_counts(x.counts[i:j]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i})

    def spelled(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for _, _, p in P.parts_of(left):
            x = _Words(p)
            f, lead = _read_totals(P.replied(right))
            at = np.flatnonzero(lead & (f >= least))
            out.append(pa.table([pa.array(x.lang[at]), pa.array(x.keys[at].view(np.int64)), pa.array([x.text(k) for k in at.tolist()], pa.string()), pa.array(f[at])], schema=_VOCABULARY_SCHEMA))
            none = [None] * len(x.langs)
            out.append(pa.table([pa.array(x.langs), pa.array(none, pa.int64()), pa.array(none, pa.string()), pa.array(x.n)], schema=_VOCABULARY_SCHEMA))
        return pa.concat_tables(out)

    def sent(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for part, _, p in P.parts_of(left):
            x = _Words(p)
            f, _ = _read_totals(P.replied(right))
            cols, n = _fragments(x, f, least)
            pivot = cols[0]
            split = -(-f[pivot] // hot)
            own = (T.mix(np.array([part], np.int64).view(np.uint64))[0] % np.maximum(split, 1).astype(np.uint64)).astype(np.uint64)
            route = T.mix(x.keys[pivot] + own * _LANG)
            # groups of pivots that are spread out are numbered from ``groups`` on
            order = np.lexsort((route, split > 1))
            some = int((split <= 1).sum())
            edges = [P.bucket_edges(route[order[:some]], groups), some + P.bucket_edges(route[order[some:]], groups)]
            bodies = {}
            for base, cut in zip((0, groups), edges, strict=True):
                for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if j > i:
                        bodies[base + k] = _message(x, f, [c[order[i:j]] for c in cols], n[order[i:j]])
            out.append(P.send(part, bodies))
        return pa.Table.from_batches(out, P.SENT_SCHEMA)

    def mined(key: tuple, t: pa.Table) -> pa.Table:
        return _mine(t.column("payload").to_pylist(), least if key[0].as_py() < groups else 1)

    totals = P.meet(packed.mapInArrow(census, P.SENT), _totals)
    both = packed.groupBy("part").cogroup(totals.groupBy("part"))
    found = both.applyInArrow(sent, P.SENT).groupBy("bucket").applyInArrow(mined, _MINED)
    phrases = found.groupBy(*_MINED_SCHEMA.names[:-1]).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return phrases, both.applyInArrow(spelled, _VOCABULARY)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, first: int = FIRST, inside: int = INSIDE, **options: int) -> DataFrame:
    """Each language's first phrases of two or three words: lang, rank (from 1), phrase, a (occurrences), l and r
    (those of its parts before and behind the lowest-scoring cut), n (words of the language), score
    (floor(10^6 a a / (l r)), exact).

    ASCII letters are lowered; ``.,;:!?`` and line ends part the text into pieces, blanks and tabs pieces into words. A null lang
    is ``und``; a null text has no words. Candidates have at least ``least`` occurrences within pieces, overlaps
    included; one goes if a longer candidate holds it and has ``inside`` hundredths of its occurrences or more. Order: score,
    a (both descending), phrase (by bytes). Rows that repeat count each time. Other columns are ignored. An empty table gives no rows.
    """
    phrases, vocabulary = count_phrases(docs, lang_col, text_col, least, **options)
    phrases, vocabulary = P.written(phrases, "phrases"), P.written(vocabulary, "vocabulary")
    two, three = phrases.where("w3 is null"), phrases.where("w3 is not null")
    known = two.select(F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("a").alias("f"))
    halves = three.join(known.toDF("w1", "w2", "f12"), ["w1", "w2"]).join(known.toDF("w2", "w3", "f23"), ["w2", "w3"])
    around = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("around"))
    two = two.join(around, ["w1", "w2"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside * F.col("a")))

    def score(left: str, right: str) -> str:
        return f"(1000000 * cast(a as decimal(15)) * cast(a as decimal(15))) div (cast({left} as decimal(18)) * cast({right} as decimal(18)))"

    two = two.select("lang", "w1", "w2", "w3", "a", F.col("f1").alias("l"), F.col("f2").alias("r"), F.expr(score("f1", "f2")).alias("score"))
    cuts = halves.withColumns({"s1": F.expr(score("f1", "f23")), "s2": F.expr(score("f12", "f3"))})
    early = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", "w1", "w2", "w3", "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    # texts are looked up only for what can be among the first
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    top = two.unionByName(three).withColumn("place", F.rank().over(by)).where(F.col("place") <= first).drop("place")
    word = vocabulary.where("word is not null").select("word", "text")
    spelled = top
    for k in (1, 2, 3):
        spelled = spelled.join(word.toDF(f"w{k}", f"t{k}"), f"w{k}", "left")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    n = vocabulary.where("word is null").groupBy("lang").agg(F.sum("f").alias("n"))
    names = _rows(docs, lang_col, text_col).select(F.col("key").alias("lang"), F.col("lang").alias("name")).distinct()
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= first)
    return ranked.join(n, "lang").join(names, "lang").select(F.col("name").alias("lang"), "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
