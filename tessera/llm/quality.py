"""Quality classifier from weak labels.

Heuristic labellers vote on each text: bad, good or nothing. They overlap and err, so nobody's vote is
taken for the truth: a model with one hidden class per document (good, junk, repetitive or abusive) and, for each
labeller, the chances of its votes in each class is fitted by expectation-maximisation to the counts of vote patterns (of which
there are at most 3 ** labellers, however large the corpus). The posterior class of each pattern then
labels a bounded sample of documents, on which a linear scorer over hashed features is trained; it sees
words and word shapes, not the votes, and scores every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T

#: Different texts that the scorer is trained on, those with the smallest hashes.
SAMPLE = 8000
FEATURES = 1 << 15
THRESHOLD = 0.5
LABELLERS = ("symbols", "endings", "shouting", "exclaiming", "bars", "stutter", "sameness", "abuse", "prose", "sentences")
#: Hidden classes, and the labellers that look for the bad ones.
CLASSES = {"good": (), "junk": ("symbols", "endings", "shouting", "exclaiming", "bars", "prose"), "repetitive": ("stutter", "sameness", "sentences"), "abusive": ("abuse",)}
MOST_WRONG = 0.01
# Common insults.
INSULTS = ("clown", "disgusting", "dumb", "idiot", "idiotic", "imbecile", "loser", "moron", "moronic", "pathetic", "scum", "stupid", "trash", "worthless")

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 common mark, 5 symbol, 6 part of a longer character
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[list(b".,;:?!'\"()-")] = 4
_CLASS[list(b"#$%&*|<>{}[]\\^~`@+=_/")] = 5


class Texts:
    """Words of some texts and what labellers and features need of them."""

    def __init__(self, texts: list[bytes | None]):
        raw = [t or b"" for t in texts]
        self.buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        lens = np.array([len(t) + 1 for t in raw], np.int64)
        starts = np.cumsum(lens) - lens
        self.s, self.e = T.word_spans(self.buf)
        self.cut = np.searchsorted(self.s, np.append(starts, len(self.buf)))
        self.n = np.diff(self.cut)
        self.owner = np.repeat(np.arange(len(raw)), self.n)
        self.word = T.word_hashes(T.LOWER[self.buf], self.s, self.e)
        cls = _CLASS[self.buf]
        self.starts = starts
        self.per_doc = [self.sums(cls == k) for k in range(1, 7)]
        self.first, self.last = cls[self.s], cls[self.e - 1]
        self.size = self.e - self.s
        capitals = np.concatenate([[0], np.cumsum(cls == 2, dtype=np.int32)])
        self.upper = (capitals[self.e] - capitals[self.s]) > 1
        self.same = np.zeros(len(self.s), bool)
        self.same[1:] = (self.word[1:] == self.word[:-1]) & (self.owner[1:] == self.owner[:-1])

    def count(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, flag, len(self.n))

    def sums(self, flag: np.ndarray) -> np.ndarray:
        """Of each text the bytes with the flag."""
        return np.add.reduceat(flag.view(np.uint8), self.starts, dtype=np.int64) if len(self.starts) else np.zeros(0, np.int64)

    def votes(self) -> np.ndarray:
        """documents x labellers: -1 bad, 1 good, 0 no vote. Texts without words get no vote."""
        lower, upper, digit, mark, symbol, longer = self.per_doc
        n = np.maximum(self.n, 1)
        letters = np.maximum(lower + upper, 1)
        chars = np.maximum(lower + upper + digit + mark + symbol + longer, 1)
        new = np.ones(len(self.word), bool)
        order = np.lexsort((self.word, self.owner))
        new[order[1:]] = (self.word[order[1:]] != self.word[order[:-1]]) | (self.owner[order[1:]] != self.owner[order[:-1]])
        insult = np.isin(self.word, _insults())
        odd = self.last == 5
        bad = [symbol >= 0.05 * chars, self.count(odd) >= 0.2 * n, (upper >= 0.5 * letters) & (upper >= 10), self.sums(self.buf == 33) >= 0.2 * n, self.sums(self.buf == 124) >= 0.1 * n, (self.count(self.same) >= 0.2 * n) & (self.n >= 10), (self.count(new) < 0.35 * n) & (self.n >= 20) & (self.n < 400), self.count(insult) > 0]
        out = np.stack([-x.astype(np.int8) for x in bad], axis=1)
        prose = np.where(lower + longer >= 0.8 * chars, 1, np.where(lower + longer < 0.5 * chars, -1, 0))
        stops = self.count((self.buf[self.e - 1] == 46) if len(self.e) else np.zeros(0))
        sentences = np.where((stops > 0) & (self.n >= 3 * stops) & (self.n <= 60 * stops) & (self.count(odd) == 0), 1, np.where((self.n >= 30) & (self.n > 100 * stops), -1, 0))
        votes = np.column_stack([out, prose, sentences]).astype(np.int8)
        votes[self.n == 0] = 0
        return votes

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) without repeats: hashed words, and hashed shapes with the share of words that have them."""
        shape = self.first.astype(np.uint64) + self.last.astype(np.uint64) * np.uint64(8) + self.upper.astype(np.uint64) * np.uint64(64) + self.same.astype(np.uint64) * np.uint64(128)
        per = np.bincount((self.owner * 256 + shape.astype(np.int64)), minlength=256 * len(self.n)).reshape(-1, 256)
        doc, kind = np.nonzero(per)
        share = np.frexp(per[doc, kind] / np.maximum(self.n[doc], 1))[1] + 16
        shapes = T.mix((kind * 64 + share + 1).astype(np.uint64))
        d, f = np.concatenate([self.owner, doc]), np.concatenate([self.word, shapes]) & np.uint64(FEATURES - 1)
        both = np.unique(d.astype(np.int64) * FEATURES + f.astype(np.int64))
        return both // FEATURES, both % FEATURES


def _insults() -> np.ndarray:
    buf = np.frombuffer(" ".join(INSULTS).encode(), np.uint8)
    plain = T.word_hashes(buf, *T.word_spans(buf))
    marked = np.frombuffer(" ".join(w + m for w in INSULTS for m in ".,;:!?").encode(), np.uint8)
    return np.concatenate([plain, T.word_hashes(marked, *T.word_spans(marked))])


@dataclass
class LabelModel:
    """chance[labeller, class, vote + 1] and the share of each class of CLASSES."""

    chance: np.ndarray
    share: np.ndarray

    @staticmethod
    def fit(votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
        """Labellers are taken to vote bad on at most a hundredth of good documents, and the kinds of bad documents start
        from the labellers that look for them; that settles what the classes mean. All else is learnt."""
        good, bad = np.array([0.02, 0.5, 0.48]), np.array([0.6, 0.3, 0.1])
        chance = np.array([[bad if name in looks else good for looks in CLASSES.values()] for name in LABELLERS])
        share, before = np.array([0.85, *[0.15 / (len(CLASSES) - 1)] * (len(CLASSES) - 1)]), None
        for _ in range(rounds):
            p = LabelModel(chance, share).classes(votes)
            w = p * count
            chance = np.stack([((votes == v - 1).T.astype(float) @ w.T + 0.01) / (w.sum(axis=1) + 0.03) for v in range(3)], axis=2)
            over = chance[:, 0, 0] > MOST_WRONG
            chance[over, 0, 1:] *= ((1 - MOST_WRONG) / chance[over, 0, 1:].sum(axis=1))[:, None]
            chance[over, 0, 0] = MOST_WRONG
            share = (w.sum(axis=1) + 1) / (count.sum() + len(share))
            if before is not None and np.abs(p - before).max(initial=0) < 1e-9:
                break
            before = p
        return LabelModel(chance, share)

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Chance of each class (rows) for each row of votes."""
        logs, at = np.log(self.chance), votes.astype(np.int64) + 1
        like = np.stack([logs[np.arange(votes.shape[1]), c, at].sum(axis=1) + np.log(self.share[c]) for c in range(len(self.share))])
        like = np.exp(like - like.max(axis=0, initial=-np.inf))
        return like / like.sum(axis=0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that the text isn't good, for each row of votes."""
        return 1 - self.classes(votes)[0] if len(votes) else np.zeros(0)

    def accuracies(self) -> dict[str, float]:
        """For each labeller the chance that a vote is right."""
        bad, good = (self.share[1:, None] * self.chance[:, 1:, :].transpose(1, 0, 2).reshape(len(self.share) - 1, -1)).sum(axis=0).reshape(-1, 3), self.share[0] * self.chance[:, 0]
        right, wrong = bad[:, 0] + good[:, 2], bad[:, 2] + good[:, 0]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist(), strict=True))


def train(rows: list[tuple[float, bytes]], epochs: int = 60, rate: float = 0.5, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels (chance of bad, features as int32 bytes), by AdaGrad over mini-batches."""
    w, g2, bias, b2 = np.zeros(FEATURES), np.full(FEATURES, 1e-6), 0.0, 1e-6
    y = np.array([r[0] for r in rows])
    x = [np.frombuffer(r[1], np.int32) for r in rows]
    order = np.random.default_rng(7)
    for _ in range(epochs if rows else 0):
        for part in np.array_split(order.permutation(len(x)), max(1, len(x) // 256)):
            n = np.array([len(x[i]) for i in part])
            idx, owner = np.concatenate([x[i] for i in part]), np.repeat(np.arange(len(part)), n)
            scale = 1 / np.sqrt(np.maximum(n, 1))
            z = np.bincount(owner, w[idx] * scale[owner], len(part)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            g = np.bincount(idx, err[owner] * scale[owner], FEATURES) + l2 * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            b2 += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(b2)
    return w, float(bias)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def bad(self, t: Texts) -> np.ndarray:
        doc, f = t.features()
        n = np.maximum(np.bincount(doc, minlength=len(t.n)), 1)
        z = np.bincount(doc, self.weights[f], len(t.n)) / np.sqrt(n) + self.bias
        return np.where(t.n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1.0)


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, int, int, Texts]]:
    for b in batches:
        for i, j, t in T.slices(b.column(at).cast(pa.string())):
            yield b, i, j, Texts(t)


def sample_bound(sample: int, rows: int) -> int:
    """A signed 64-bit hash up to which about ``sample`` of these rows lie; with a margin, so that as many texts lie
    there if all differ."""
    sample += 8 * math.isqrt(sample)
    return -(1 << 63) + min(1 << 64, (sample << 64) // max(1, rows)) - 1 if sample > 0 else -(1 << 63)


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Label model from the vote patterns of all documents, scorer from ``sample`` different texts (fewer, where texts
    repeat): a text counts once, however many rows hold it, so that copies can't fill the sample."""
    m = len(LABELLERS)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, t in _texts(batches, 0):
            code, n = np.unique(((t.votes() + 1) * 3 ** np.arange(m)).sum(axis=1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    text = docs.select(F.col(text_col).cast("string"))
    found = text.mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n")).collect()
    codes, count = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.float64)
    votes = (codes[:, None] // 3 ** np.arange(m) % 3 - 1).astype(np.int8) if len(codes) else np.zeros((0, m), np.int8)
    labels = LabelModel.fit(votes, count)
    last = sample_bound(sample, int(count.sum())) if sample > 0 else -(1 << 63)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, t in _texts(batches, 0):
            doc, f = t.features()
            ends = np.cumsum(np.bincount(doc, minlength=len(t.n)))[:-1]
            xs = [x.astype(np.int32).tobytes() for x in np.split(f, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(labels.posterior(t.votes())), pa.array(xs, pa.binary())], names=["y", "x"])

    own = text.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col), F.lit(11)).alias("hash"))
    chosen = own.where(F.col("hash") <= F.lit(last).cast("long")).distinct().orderBy("hash").limit(max(0, sample)).select("text")
    rows = sorted((r["y"], bytes(r["x"])) for r in chosen.mapInArrow(labelled, "y double, x binary").collect())
    if len(codes) and not rows:
        raise ValueError(f"none of {int(count.sum())} texts is in the scorer's sample")
    return QualityModel(labels, *train(rows))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: QualityModel | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, label_bad (posterior of its votes), score (the scorer's chance that
    it is good), kept (score > 1 - threshold).

    Null and empty texts, and texts without words, have score 0 and aren't kept. Repeated rows get equal
    scores. A null doc_id stays null. Other columns are ignored; an empty table gives no rows.
    """
    model = model or fit_quality(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, t in _texts(batches, 1):
            good = 1 - model.bad(t)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(model.labels.posterior(t.votes())), pa.array(good), pa.array(good > 1 - threshold)], names=["doc_id", "label_bad", "score", "kept"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, label_bad double, score double, kept boolean")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: QualityModel | None = None) -> DataFrame:
    """The rows of docs, all columns, that classify keeps."""
    model = model or fit_quality(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, t in _texts(batches, at):
            yield b.slice(i, j - i).filter(pa.array(1 - model.bad(t) > 1 - threshold))

    return docs.mapInArrow(run, docs.schema)
