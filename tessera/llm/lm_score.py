"""Language-model scores by deleted interpolation (Jelinek and Mercer 1980).

A token's probability mixes maximum-likelihood estimates of three orders and the uniform one:

    P(w | u v) = l3 c(uvw)/c(uv) + (1 - l3) (l2 c(vw)/c(v) + (1 - l2) (l1 c(w)/N + (1 - l1) / (V + 1)))

l3 and l2 depend on how often the context occurs: contexts with a frequency between two powers of two
share a weight; an unseen context has weight 0. The weights maximise the likelihood of a part of the
training documents (the tuning fold) under counts from which that part is deleted, by
expectation-maximisation; the scores then use the counts of all training documents.

Counts come from two censuses (see ``_pack``). In the first every part sends its distinct words, as 64-bit
fingerprints, and only the leading bits of those of its pairs and triples; back come the words' corpus
counts, and for each pair and triple whether another part holds one with the same leading bits. Where none
does, the corpus count is the part's own. For the others a second census gets the rest of the 64 bits and
adds up the counts of equal fingerprints. So counts are those of whole fingerprints, while most triples, which occur
in one part only, never travel as a whole. The text travels once, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _pack as P
from tessera.llm import _text as T

ORDERS = 3
BUCKETS = 40
ROUNDS = 30
TOLERANCE = 1e-3
TEST, TUNE, TRAIN = 0, 1, 2
_BEGIN, _END = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_COUNTED = "part long, fold int, ids binary, nulls binary, lens binary, seen binary, kept binary, totals array<long>"
_COUNTED_SCHEMA = pa.schema([("part", pa.int64()), ("fold", pa.int32()), *((c, pa.binary()) for c in ("ids", "nulls", "lens", "seen", "kept")), ("totals", pa.list_(pa.int64()))])
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Weights:
    """Weights of the orders: l1, and l2 and l3 by the context's bucket; tokens and types they hold for."""

    l1: float
    l2: tuple[float, ...]
    l3: tuple[float, ...]

    @staticmethod
    def even() -> Weights:
        half = (0.0, *[0.5] * (BUCKETS - 1))
        return Weights(0.5, half, half)


def _ngrams(part: P.Part) -> tuple[list[np.ndarray], np.ndarray]:
    """Fingerprints of the n-grams of each order that end at each token, and the tokens of each document."""
    low = T.LOWER[part.buf]
    s, e, counts = part.spans()
    size = counts + 1
    base = np.cumsum(size + 2) - (size + 2)
    y = np.full(int((size + 2).sum()), _BEGIN)
    y[np.repeat(base + 2 - (np.cumsum(counts) - counts), counts) + np.arange(len(s))] = T.word_hashes(low, s, e)
    y[base + 2 + counts] = _END
    at = np.repeat(base + 2 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    pair = T.mix(y[:-1] * np.uint64(0xD6E8FEB86659FD93) + y[1:])
    two = pair[at - 1]
    three = T.mix(pair[at - 2] * np.uint64(0xCA5A826395121157) + y[at])
    return [y[at], two, three], size


def _distinct(grams: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [np.unique(h, return_inverse=True, return_counts=True) for h in grams]


def _sums(keys: list[np.ndarray], counts: list[np.ndarray], fold: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct keys the counts in all training parts and without the tuning fold, and where each entry's key is."""
    uniq, back = np.unique(np.concatenate(keys), return_inverse=True)
    rest = np.bincount(back, np.concatenate([n * (f == TRAIN) for n, f in zip(counts, fold, strict=True)]), len(uniq))
    every = rest + np.bincount(back, np.concatenate([n * (f == TUNE) for n, f in zip(counts, fold, strict=True)]), len(uniq))
    return every.astype(np.uint64), rest.astype(np.uint64), back


def _spread(every: np.ndarray, rest: np.ndarray, back: np.ndarray, keys: list[np.ndarray], fold: list[int]) -> list[bytes]:
    """For each part the sums of its entries; of the tuning fold both kinds."""
    ends = np.cumsum([len(x) for x in keys])
    return [P.put_counts(every[back[i:j]]) + (P.put_counts(rest[back[i:j]]) if f == TUNE else b"") for i, j, f in zip(ends - [len(x) for x in keys], ends, fold, strict=True)]


def _first_payloads(sent: list[bytes]) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[list[np.ndarray]]]:
    """Folds, words, counts of words, and leading bits by order of what parts sent to the first census."""
    fold, words, counts, leads = [], [], [], [[], []]
    for b in sent:
        fold.append(b[0])
        x, at = P.get_sorted(b, 1)
        n, at = P.get_counts(b, at)
        words.append(x)
        counts.append(n.astype(np.float64))
        for c in leads:
            x, at = P.get_sorted(b, at)
            c.append(x)
    return fold, words, counts, leads


def _met(lead: list[np.ndarray]) -> list[np.ndarray]:
    """For each part, which of its entries share their leading bits with another entry of any part."""
    _, back, n = np.unique(np.concatenate(lead), return_inverse=True, return_counts=True)
    return np.split(n[back] > 1, np.cumsum([len(x) for x in lead])[:-1])


def _flags(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + np.packbits(x).tobytes()


def _unflags(b: bytes, at: int) -> tuple[np.ndarray, int]:
    n = int.from_bytes(b[at : at + 8], "little")
    return np.unpackbits(np.frombuffer(b, np.uint8, -(-n // 8), at + 8))[:n].astype(bool), at + 8 + -(-n // 8)


def _first_census(key: tuple, t: pa.Table) -> pa.Table:
    """Replies of a hash range: counts of words, flags of pairs and triples that met; and a row of totals."""
    fold, words, counts, leads = _first_payloads(t.column("payload").to_pylist())
    every, rest, back = _sums(words, counts, fold)
    out = _spread(every, rest, back, words, fold)
    for lead in leads:
        out = [x + _flags(m) for x, m in zip(out, _met(lead), strict=True)]
    totals = [int((every > 0).sum()), int(every.sum()), int((rest > 0).sum()), int(rest.sum())]
    return P.replies([*zip(t.column("part").to_pylist(), out, strict=True), (-1, np.array(totals, np.int64).tobytes())], key[0].as_py())


def _second_census(key: tuple, left: pa.Table, right: pa.Table, lead_bits: int) -> pa.Table:
    """Replies of a hash range: counts of the pairs and triples that met, by their whole fingerprints."""
    rest_of = dict(zip(right.column("part").to_pylist(), right.column("payload").to_pylist(), strict=True))
    parts = left.column("part").to_pylist()
    fold, _, _, leads = _first_payloads(left.column("payload").to_pylist())
    at, out = [0] * len(parts), [b""] * len(parts)
    for lead in leads:
        keys, counts = [], []
        for k, (x, m) in enumerate(zip(lead, _met(lead), strict=True)):
            b = rest_of[parts[k]]
            tail, at[k] = P.get_bits(b, at[k], int(m.sum()), 64 - lead_bits)
            n, at[k] = P.get_counts(b, at[k])
            keys.append((x[m] << np.uint64(64 - lead_bits)) | tail)
            counts.append(n.astype(np.float64))
        out = [a + b for a, b in zip(out, _spread(*_sums(keys, counts, fold), keys, fold), strict=True)]
    return P.replies(list(zip(parts, out, strict=True)), key[0].as_py())


def _press(grams: list[np.ndarray], back: list[np.ndarray]) -> bytes:
    """Counts of the n-grams at each token; those of words as ranks among the different counts, the most frequent first."""
    counts, at = np.unique(grams[0], return_inverse=True)
    order = np.argsort(-np.bincount(at[back[0]], minlength=len(counts)), kind="stable")
    rank = np.empty(len(counts), np.uint64)
    rank[order] = np.arange(len(counts), dtype=np.uint64)
    columns = [counts[order], rank[at][back[0]], *(c[b] for c, b in zip(grams[1:], back[1:], strict=True))]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(P.planes(c) for c in columns))


def _unpress(b: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(b), 0, []
    while at < len(raw):
        x, at = P.unplanes(raw, at)
        out.append(x)
    return [out[0][out[1].astype(np.int64)], *out[2:]]


def counted(docs: DataFrame, id_col: str, text_col: str, fold: Column) -> DataFrame:
    """For each part the counts of the n-grams that end at each token, in all training documents (seen) and, for
    parts of the tuning fold, without that fold (kept). Rows of fold -1 hold totals by hash range."""
    tokens = max(1, P.text_bytes(docs, text_col) // 6)
    buckets = max(12, -(-tokens * 2 // P.ENTRIES))
    lead_bits = min(60, int(tokens).bit_length() + 4)
    lead = np.uint64(64 - lead_bits)
    packed = P.pack(docs, id_col, text_col, fold).repartition("part")

    def cut(keys: np.ndarray) -> list[tuple[int, int]]:
        edges = P.bucket_edges(keys, buckets)
        return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, f, p in P.parts_of(b):
                grams, _ = _ngrams(p)
                words, n = np.unique(grams[0], return_counts=True)
                n = n if f != TEST else np.zeros(len(n))
                bodies = [bytes([f]) + P.put_sorted(words[i:j]) + P.put_counts(n[i:j]) for i, j in cut(words)]
                for keys in map(P.distinct, grams[1:]):
                    bodies = [x + P.put_sorted(keys[i:j] >> lead) for x, (i, j) in zip(bodies, cut(keys), strict=True)]
                yield P.send(part, dict(enumerate(bodies)))

    def met(replies: list[bytes], f: int) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
        """Of the first census the words' counts of either kind, and the flags of pairs and triples."""
        counts: list[list[np.ndarray]] = [[], []]
        flags: list[list[np.ndarray]] = [[], []]
        for b in replies:
            at = 0
            for kind in range(1 + (f == TUNE)):
                x, at = P.get_counts(b, at)
                counts[kind].append(x)
            for c in flags:
                x, at = _unflags(b, at)
                c.append(x)
        return counts, [np.concatenate(c) for c in flags]

    def tell_more(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for part, f, p in P.parts_of(left):
            flags = met(P.replied(right), f)[1]
            bodies = [b""] * buckets
            for h, m in zip(_ngrams(p)[0][1:], flags, strict=True):
                keys, n = np.unique(h, return_counts=True)
                keys, n = keys[m], n[m] if f != TEST else np.zeros(int(m.sum()))
                bodies = [x + P.put_bits(keys[i:j], 64 - lead_bits) + P.put_counts(n[i:j]) for x, (i, j) in zip(bodies, cut(keys), strict=True)]
            out.append(P.send(part, dict(enumerate(bodies))))
        return pa.Table.from_batches(out, P.SENT_SCHEMA)

    def take(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if not left.num_rows:
            rows = [[-1, -1, b"", b"", b"", b"", b"", np.frombuffer(x.as_py(), np.int64).tolist()] for x in right.column("payload")]
        for part, f, p in P.parts_of(left):
            grams, size = _ngrams(p)
            kind = right.column("kind").to_numpy()
            words, flags = met(P.replied(right.filter(pa.array(kind == 0))), f)
            found: list[list[list[np.ndarray]]] = [[[], []], [[], []]]
            for b in P.replied(right.filter(pa.array(kind == 1))):
                at = 0
                for order in range(2):
                    for k in range(1 + (f == TUNE)):
                        x, at = P.get_counts(b, at)
                        found[k][order].append(x)
            uniq = _distinct(grams)
            pressed = [b"", b""]
            for k in range(1 + (f == TUNE)):
                each = [np.concatenate(words[k])]
                for (_, _, n), m, got in zip(uniq[1:], flags, found[k], strict=True):
                    # what no other part holds occurs here only: not at all in what is held out or without the tuning fold
                    own = n.astype(np.uint64) if f != TEST and k == 0 else np.zeros(len(n), np.uint64)
                    own[m] = np.concatenate(got)
                    each.append(own)
                pressed[k] = _press(each, [u[1] for u in uniq])
            rows.append([part, f, p.ids.tobytes(), p.nulls.tobytes(), size.tobytes(), *pressed, []])
        return pa.table([pa.array(c, y.type) for c, y in zip(zip(*rows, strict=True), _COUNTED_SCHEMA, strict=True)], schema=_COUNTED_SCHEMA)

    step = packed.groupBy("part")
    sent = packed.mapInArrow(tell, P.SENT)
    first = sent.groupBy("bucket").applyInArrow(_first_census, P.SENT).repartition("part")
    more = step.cogroup(first.groupBy("part")).applyInArrow(tell_more, P.SENT)
    second = sent.groupBy("bucket").cogroup(more.groupBy("bucket")).applyInArrow(lambda k, a, b: _second_census(k, a, b, lead_bits), P.SENT)
    both = first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)))
    return P.written(step.cogroup(both.groupBy("part")).applyInArrow(take, _COUNTED), "counted", by="fold")


def _levels(counts: list[np.ndarray], size: np.ndarray, n: int, types: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token the estimates of orders 3, 2, 1 and 0, and the buckets of its two contexts."""
    c1, c2, c3 = (c.astype(np.float64) for c in counts)
    first = np.cumsum(size) - size
    docs = c1[first + size - 1]  # each document ends once: the end's count is the number of documents
    h1, h2 = np.empty_like(c1), np.empty_like(c2)
    h1[1:], h2[1:] = c1[:-1], c2[:-1]
    h1[first], h2[first] = docs, docs
    with np.errstate(divide="ignore", invalid="ignore"):
        p3, p2 = np.where(h2 > 0, c3 / h2, 0), np.where(h1 > 0, c2 / h1, 0)
    bucket = [np.where(h > 0, np.minimum(np.frexp(h)[1], BUCKETS - 1), 0) for h in (h2, h1)]
    return [p3, p2, c1 / max(n, 1), np.full(len(c1), 1 / (types + 1))], bucket


def _mixture(w: Weights, p: list[np.ndarray], bucket: list[np.ndarray]) -> list[np.ndarray]:
    l3, l2 = np.array(w.l3)[bucket[0]], np.array(w.l2)[bucket[1]]
    return [l3 * p[0], (1 - l3) * l2 * p[1], (1 - l3) * (1 - l2) * w.l1 * p[2], (1 - l3) * (1 - l2) * (1 - w.l1) * p[3]]


def learn_weights(table: DataFrame, n: int, types: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Weights:
    """Expectation-maximisation over the tuning fold's counts; n, types: tokens and types without that fold."""
    tuning = table.where(F.col("fold") == TUNE).select("lens", "kept")
    w = Weights.even()
    if n == 0 or tuning.isEmpty():
        return w
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], w: Weights = w) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, 2, BUCKETS))
            for b in batches:
                for lens, kept in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    p, bucket = _levels(_unpress(kept), np.frombuffer(lens, np.int64), n, types)
                    m = _mixture(w, p, bucket)
                    total = sum(m)
                    r = [x / total for x in m]
                    one = np.zeros(len(total), np.int64)
                    for k, (at, mine, base) in enumerate(((bucket[0], r[0], 1.0), (bucket[1], r[1], 1 - r[0]), (one, r[2], r[2] + r[3]))):
                        sums[k, 0] += np.bincount(at, mine, BUCKETS)
                        sums[k, 1] += np.bincount(at, base * np.ones(len(total)), BUCKETS)
            flat = sums.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["k", "x"])

        got = dict(tuning.mapInArrow(expect, "k int, x double").groupBy("k").agg(F.sum("x")).collect())
        s = np.array([got.get(k, 0.0) for k in range(6 * BUCKETS)]).reshape(3, 2, BUCKETS)
        new = np.where(s[:, 1] > 0, s[:, 0] / np.maximum(s[:, 1], 1e-300), 0.5)
        new[:2, 0] = 0
        before, w = w, Weights(float(new[2, 0]), tuple(new[1].tolist()), tuple(new[0].tolist()))
        if max(abs(a - b) for a, b in zip((before.l1, *before.l2, *before.l3), (w.l1, *w.l2, *w.l3), strict=True)) < tolerance:
            break
    return w


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, tuning: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out, tuning: boolean Columns; by default crc32 of doc_id as text (a null doc_id: empty), modulo 10, is
    0 or 1. The model learns from documents that aren't held out and scores all. Tokens are lower-cased
    words, then one end. base_score is the unigram model with 0.1 added to each count, score the mixture's
    log10 probability; it is 0 where nothing was learnt, as the vocabulary then is one unknown token.
    Null and empty texts have the end as their only token. Rows that repeat count and are scored each for
    itself. Other columns are ignored; an empty table gives no rows.
    """
    part = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))) % 10
    out = F.coalesce(part == 0 if held_out is None else held_out, F.lit(False))
    fold = F.when(out, TEST).when(F.coalesce(part == 1 if tuning is None else tuning, F.lit(False)), TUNE).otherwise(TRAIN)
    table = counted(docs, id_col, text_col, fold)
    sums = table.where("fold = -1").agg(*(F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)) for k in range(4))).first()
    types, n, kept_types, kept_n = (int(x) for x in sums)
    w = learn_weights(table, kept_n, kept_types)
    if not n:
        w = Weights(0.0, w.l2, w.l3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fold, ids, nulls, lens, seen in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                size, counts = np.frombuffer(lens, np.int64), _unpress(seen)
                first = np.cumsum(size) - size
                p, bucket = _levels(counts, size, n, types)
                c = counts[0].astype(np.float64)
                base = np.log10((c + 0.1) / (n + 0.1 * (types + 1)))
                with np.errstate(divide="ignore"):
                    each = np.log10(sum(_mixture(w, p, bucket)))
                sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, each)]
                doc = pa.array(np.frombuffer(ids, np.int64), mask=(np.frombuffer(nulls, np.uint8) & 1).astype(bool))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.full(len(size), fold == TEST)), pa.array(size), *map(pa.array, sums)], schema=_RESULT_SCHEMA)

    rows = table.where("fold >= 0").select("fold", "ids", "nulls", "lens", "seen").mapInArrow(run, _RESULT)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
