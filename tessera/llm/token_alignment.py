"""Tokens of two tokenizers aligned by the bytes that they cover.

Texts are tokenised once, in tasks over Arrow batches; everything after that is done by Spark's
higher-order functions and DataFrames:

1. Texts are cut into words where a single space stands between two others than white space. Tokens of both
   tokenizers begin there, so a text's tokens are those of its words in a row. A few megabytes of documents are one
   row: their different words, each with the ids of both tokenizers (A, then B) and the number of its shape, the shapes (the
   byte offsets at which the tokens of either end: all that an alignment depends on), and each document as numbers of its words.
2. array_intersect of the two arrays of ends gives the cuts of a shape. transform and sequence make groups of tokens from
   the cuts' places among the ends. In a long word a cut's place follows from the sorted union of both arrays: of the
   j-th number that stands there twice, at place k, it is k - j. Words of one shape share this; each takes its
   ids from the shape's groups.
3. The links of a group are all pairs of an A and a B token of it. A group with many pairs counts the different ids
   of either side first, by runs in a sorted array, and multiplies. A document's groups and links are those of its words.
4. Documents are counted by id pair, each A id's highest count is found, and both come back to the documents by a
   join: of a broadcast table of pairs while it is small, shuffled beyond.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _pack as P
from tessera.llm import _text as T

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a worker process remembers, by 64-bit fingerprints.
WORDS = 600_000
#: Bytes of text whose documents share a row.
BLOCK = 3 << 20
#: Bytes of new words that are tokenised in one run.
RUN = 1 << 13
#: Tokens of either side up to which a cut is looked for from the first end on.
SHORT = 64
#: Pairs of one group beyond which its ids are counted before they are paired.
DENSE = 64
#: Rows of the table of id pairs up to which it is broadcast: about 100 MB in an executor.
PAIRS = 1_000_000

# Bytes that begin or end a character that is no white space. Those of some characters are left out, as they can also be white
# space's: a space beside them cuts nothing, which only makes longer words.
_BEGINS = np.zeros(256, bool)
_BEGINS[[*range(0x21, 0x7F), *range(0xC3, 0xE0)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[0x21:0x7F] = True
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True
_BLOCK = "docs array<struct<doc_id:long,n_a:long,n_b:long,words:array<int>>>, of array<int>, ids array<array<long>>, marked array<array<int>>, shapes array<struct<a_ends:array<int>,b_ends:array<int>>>"
_PRODUCTS = "array<struct<pair:bigint,n:bigint>>"
_INTS = pa.list_(pa.int32())
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("words", _INTS)]))
_SHAPES = pa.list_(pa.struct([("a_ends", _INTS), ("b_ends", _INTS)]))


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers from their files' contents, and the bytes of each id."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would only keep memory
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        table = byte_table()
        by_id = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(table[c] for c in t) if set(t) <= set(table) else t.encode() for t in (by_id.get(i, "") for i in range(max(by_id) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of both for space + text; none where the bytes of either differ from that."""
        ours = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for t, x, theirs in zip(texts, ours, self.b.encode(texts, num_threads=1), strict=True):
            raw = b" " + t.encode()
            yes = b"".join(map(self.a_bytes.__getitem__, x.ids)) == raw == b"".join(map(self.b_bytes.__getitem__, theirs))
            yield (x.ids, theirs) if yes else None


def _ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many numbers from each of firsts on, one range after the other."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Pool:
    """Numbers of words one after the other, as arrays that double when they are full."""

    def __init__(self):
        self.ids, self.first, self.words, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words + len(counts) >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.first[self.words + 1 : self.words + 1 + len(counts)] = self.size + np.cumsum(counts)
        self.size, self.words = self.size + len(ids), self.words + len(counts)

    def counts(self, words: np.ndarray) -> np.ndarray:
        return self.first[words + 1] - self.first[words]

    def take(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.ids[_ranges(self.first[words], counts)]


def word_cuts(buf: np.ndarray) -> np.ndarray:
    """Single spaces between two others than white space."""
    at = np.flatnonzero(buf == 0x20)
    at = at[(at > 1) & (at < len(buf) - 1)]
    before = buf[at - 1]
    return at[_BEGINS[buf[at + 1]] & (_ENDS[before] | ((before >= 0x80) & _TWO[buf[at - 2]]))]


class Words:
    """Words that were tokenised, each with a number, or -1 if it doesn't come back as it was."""

    def __init__(self, both: Tokenizers):
        self.both, self.clear = both, True

    def learn(self, new: list[str], sizes: np.ndarray) -> np.ndarray:
        """Numbers for new words of ``sizes`` bytes; those that begin and end without white space are tokenised in runs, as their texts are."""
        out = np.full(len(new), -1, np.int64)
        plain = [k for k, w in enumerate(new) if not (w[0].isspace() or w[-1].isspace())]
        runs = np.cumsum(sizes[plain]) // RUN
        cuts = [*np.flatnonzero(np.diff(runs, prepend=-1)).tolist(), len(plain)]
        for i, j in itertools.pairwise(cuts):
            self.learn_run(new, plain[i:j], sizes, out)
        rest = np.flatnonzero(out < 0).tolist()
        for k, x in zip(rest, self.both.encode([new[k] for k in rest]), strict=True):
            if x:
                out[k] = self.a.words
                for pool, ids in zip((self.a, self.b), x, strict=True):
                    pool.add(np.array(ids, np.int32), np.array([len(ids)]))
        return out

    def learn_run(self, new: list[str], run: list[int], sizes: np.ndarray, out: np.ndarray) -> None:
        whole = next(self.both.encode([" ".join([new[k] for k in run])]))
        if whole is None:
            return
        out[run] = np.arange(self.a.words, self.a.words + len(run))
        ends = np.cumsum(1 + sizes[run])
        for pool, ids, size in zip((self.a, self.b), whole, (self.both.a_len, self.both.b_len), strict=True):
            x = np.array(ids, np.int32)
            pool.add(x, np.diff(np.searchsorted(np.cumsum(size[x], dtype=np.int64), ends) + 1, prepend=0))

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """The words of each text; none if one of them doesn't come back as it was."""
        if self.clear:
            self.a, self.b, self.clear = _Pool(), _Pool(), False
            self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        full = [t for t in texts if t]
        if not full:
            return [none] * len(texts)
        raw = b"\n".join(full)
        buf = np.frombuffer(raw, np.uint8)
        last = np.cumsum([len(t) + 1 for t in full]) - 1
        cuts = word_cuts(buf)
        ends = np.sort(np.concatenate([cuts, last]))
        starts = np.concatenate([[0], ends[:-1] + 1])
        words, first, at = np.unique(T.word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, words)
        new = np.ones(len(words), bool)
        near = place < len(self.known)
        new[near] = self.known[place[near]] != words[near]
        if new.any():
            begin, end = starts[first[new]], ends[first[new]]
            got = self.learn([raw[i:j].decode() for i, j in zip(begin.tolist(), end.tolist(), strict=True)], end - begin)
            self.known, self.number = np.insert(self.known, place[new], words[new]), np.insert(self.number, place[new], got)
        self.clear = len(self.known) > WORDS
        of = self.number[np.searchsorted(self.known, words)][at]
        each = iter(np.split(of, np.searchsorted(ends, last)[:-1] + 1))
        got = [next(each) if t else none for t in texts]
        return [x if len(x) and x.min() >= 0 else none for x in got]


def _give_back() -> None:
    """Returns freed memory to the system: an executor's share is small, and what numpy and the tokenizers free stays with the process."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError, OSError):  # a C library that has no such call
            ctypes.CDLL(None).malloc_trim(0)


def _lists(values: np.ndarray, firsts: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:  # noqa: B008
    return pa.ListArray.from_arrays(pa.array(np.append(firsts, len(values)), pa.int32()), pa.array(values, kind))


def _one(values: pa.Array) -> pa.Array:
    """A list array of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(words: Words, ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
    """Documents as numbers of their different words, and these words' tokens."""
    every = np.concatenate([*rows, np.zeros(0, np.int64)])
    held = np.zeros(words.a.words, bool)
    held[every] = True
    known, at = np.flatnonzero(held), (np.cumsum(held, dtype=np.int32) - 1)[every]
    first = np.cumsum([0, *map(len, rows)])
    counts = [pool.counts(known) for pool in (words.a, words.b)]
    of_docs = [np.diff(np.append(0, np.cumsum(n[at]))[first]) for n in counts]
    begin = np.cumsum(counts[0] + counts[1]) - counts[0] - counts[1]
    tokens, sums, sides = np.empty(int(sum(n.sum() for n in counts)), np.int64), np.zeros(len(known), np.uint64), []
    marked = np.empty((len(tokens), 2), np.int32)  # a token's id and a digit: 1 where one of its side follows in its group, else 2 (A), 3 (B)
    for k, (pool, n, size) in enumerate(zip((words.a, words.b), counts, (words.both.a_len, words.both.b_len), strict=True)):
        x = pool.take(known, n)
        to = _ranges(begin + k * counts[0], n)
        tokens[to] = x if k else x.astype(np.int64) << 32
        marked[to] = 10 * x[:, None] + np.array([1, 2 + k], np.int32)
        start = np.cumsum(n) - n
        ends = np.cumsum(size[x], dtype=np.int64)
        ends -= np.repeat(np.append(0, ends)[start], n)
        total = np.append(np.uint64(0), np.cumsum(T.mix((2 * ends + k).astype(np.uint64)), dtype=np.uint64))
        sums += total[start + n] - total[start]
        sides.append((start, n, ends))
        del x, to, total  # a block's arrays are large beside an executor's memory
    _, one, of = np.unique(sums, return_index=True, return_inverse=True)  # a shape's fingerprint: the sum over its ends
    cols = [_lists(ends[_ranges(start[one], n[one])], np.cumsum(n[one]) - n[one]) for start, n, ends in sides]
    docs = pa.StructArray.from_arrays([ids, pa.array(of_docs[0]), pa.array(of_docs[1]), _lists(at, first[:-1])], ["doc_id", "n_a", "n_b", "words"])
    shapes = pa.StructArray.from_arrays(cols, ["a_ends", "b_ends"])
    cols = [_one(docs).cast(_DOCS), _one(pa.array(of, pa.int32())), _one(_lists(tokens, begin, pa.int64())), _one(_lists(marked.ravel(), 2 * begin)), _one(shapes).cast(_SHAPES)]
    return pa.RecordBatch.from_arrays(cols, ["docs", "of", "ids", "marked", "shapes"])


_made: dict[int, Words] = {}


def tokenised(docs: DataFrame, id_col: str, text_col: str, a: str, b: str) -> DataFrame:
    """Blocks of rows: docs (doc_id, numbers of tokens, words); of these words the numbers of their shapes (of), the ids (A's times
    2^32, then B's) and marked, of each id 10 times it plus either digit that _written knows; the shapes."""
    with open(a, "rb") as f, open(b, "rb") as g:  # on the driver, which sends the vocabularies to the tasks
        files = f.read(), g.read()

    def valid(raw: bytes | None) -> bytes:
        try:
            return raw if raw and raw.decode() else b""
        except UnicodeDecodeError:
            return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(files)
        if key not in _made:
            _made[key] = Words(Tokenizers(*files))
        words = _made[key]  # a worker process remembers words from task to task
        for batch in batches:
            first, held, size = 0, [], 0
            for _, j, raw in T.slices(batch.column(1)):  # words are looked up a megabyte at a time
                if words.clear and held:
                    yield _block(words, batch.column(0).slice(first, len(held)), held)
                    first, held, size = first + len(held), [], 0
                held += words.numbers(list(map(valid, raw)))
                size += sum(len(x) for x in raw if x)
                if size >= BLOCK or j == len(batch.column(1)):
                    yield _block(words, batch.column(0).slice(first, len(held)), held)
                    first, held, size = first + len(held), [], 0
                    _give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _BLOCK)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def places(ends: Column, cuts: Column, short: int = SHORT) -> Column:
    """Where in ``ends`` each of ``cuts`` stands, from 0; both ascend, and all cuts are ends."""
    twice = lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 2), lambda k: m[k] == m[k + 1])
    long = let(F.sort_array(F.concat(ends, cuts)), lambda m: F.transform(twice(m), lambda k, j: k - j))
    return F.when(F.size(ends) <= short, F.transform(cuts, lambda c: F.array_position(ends, c).cast("int") - 1)).otherwise(long)


def _part(ids: Column, before: Column, last: Column) -> Column:
    """The ids after one place up to another. slice() costs far more than an access, and most parts are one id."""
    return F.when(last - before == 1, F.array(ids[last])).otherwise(F.slice(ids, before + 2, last - before))


def token_groups(w: Column, short: int = SHORT) -> Column:
    """The groups of a word: struct<a,b> of the ids on either side."""

    def made(at: Column) -> Column:
        p, q = at["p"], at["q"]
        before = lambda x, g: F.when(g == 0, F.lit(-1)).otherwise(x[g - 1])
        return F.transform(p, lambda x, g: F.struct(_part(w["a_ids"], before(p, g), x).alias("a"), _part(w["b_ids"], before(q, g), q[g]).alias("b")))

    both = lambda c: F.struct(places(w["a_ends"], c, short).alias("p"), places(w["b_ends"], c, short).alias("q"))
    return let(let(F.array_intersect(w["a_ends"], w["b_ends"]), both), made)  # let copies what body gives: the groups once


def _runs(values: Column) -> Column:
    """The different values, ascending, each with how often it occurs: struct<v,n>."""

    def made(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda k: (k == 0) | (m[k] != F.get(m, k - 1)))
        counted = lambda s: F.transform(s, lambda k, j: F.struct(m[k].alias("v"), (F.coalesce(F.get(s, j + 1), F.size(m)) - k).cast("long").alias("n")))
        return let(starts, counted)

    return let(F.sort_array(values), made)


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def _product(x: Column) -> Column:
    """A group's different id pairs, each with the number of its links."""
    return F.flatten(F.transform(_runs(x["a"]), lambda y: F.transform(_runs(x["b"]), lambda z: F.struct(y["v"].bitwiseOR(z["v"]).alias("pair"), (y["n"] * z["n"]).alias("n")))))


def _shape(s: Column, dense: int, short: int) -> Column:
    """Of a shape, with tokens as places in a word's ids: n_groups, the places in a word's marked ids that its text takes (order), the
    two sides (left, right) of the links of groups of up to ``dense`` pairs, and the other groups (wide)."""
    a, b = F.size(s["a_ends"]), F.size(s["b_ends"])
    numbered = F.struct(F.sequence(F.lit(0), a - 1).alias("a_ids"), s["a_ends"], F.sequence(a, a + b - 1).alias("b_ids"), s["b_ends"])
    many = lambda x: F.size(x["a"]).cast("long") * F.size(x["b"]) > dense
    behind = lambda x: F.transform(x, lambda y, k: 2 * y + (k == F.size(x) - 1).cast("int"))

    # The links of a group: each A token as often as it has B tokens, beside these as often as it has A tokens.
    lefts = lambda x: F.when(F.size(x["b"]) == 1, x["a"]).otherwise(F.flatten(F.transform(x["a"], lambda y: F.array_repeat(y, F.size(x["b"])))))
    rights = lambda x: F.when(F.size(x["a"]) == 1, x["b"]).otherwise(F.flatten(F.array_repeat(x["b"], F.size(x["a"]))))
    few = a.cast("long") * b <= dense

    def made(g: Column) -> Column:
        order = F.flatten(F.transform(g, lambda x: F.concat(behind(x["a"]), behind(x["b"]))))
        kept = F.when(few, g).otherwise(F.filter(g, lambda x: ~many(x)))
        left, right = (F.flatten(F.transform(kept, side)) for side in (lefts, rights))
        wide = F.when(few, F.array().cast("array<struct<a:array<int>,b:array<int>>>")).otherwise(F.filter(g, many))
        return F.struct(F.size(g).alias("n_groups"), order.alias("order"), left.alias("left"), right.alias("right"), wide.alias("wide"))

    return let(token_groups(numbered, short), made)


def _taken(ids: Column, places: Column) -> Column:
    return F.transform(places, lambda k: ids[k])


def _wide(s: Column, ids: Column) -> Column:
    """Of a word of shape ``s``: the links of its groups of many pairs, by id pair and number."""
    products = F.transform(s["wide"], lambda x: let(F.struct(_taken(ids, x["a"]).alias("a"), _taken(ids, x["b"]).alias("b")), _product))
    return F.when(F.size(s["wide"]) > 0, F.flatten(products)).otherwise(F.array().cast(_PRODUCTS))


def _written(marked: Column) -> Column:
    """Groups as ``a1,a2|b1;a3|b2,b3``, from how Spark writes an array of numbers whose last digit tells what comes behind them."""
    x = marked.cast("string")
    for digit, mark in ((1, ","), (2, "|"), (3, ";")):
        x = F.replace(x, F.lit(f"{digit}, "), F.lit(mark))
    return F.substr(x, F.lit(2), F.length(x) - 3)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, dense: int = DENSE, short: int = SHORT) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, groups (the text ``a1,a2|b1;a3|b2,b3``), links (of
    groups of up to ``dense`` pairs, each link: a's id times 2^32 plus b's), wide (of other groups, each id pair with the
    number ``n`` of its links).

    Tokenised is a space and the text, by the files ``a`` (a byte-level one) and ``b`` (pieces, which adds the space
    itself), without special tokens. Texts that are null, empty, no UTF-8, or whose tokens' bytes don't join to
    the space and the text (those with U+2581) have no tokens: zeros, '' and no links. Null and repeated ids are rows each
    for itself. Other columns are ignored. An empty table gives no rows.
    """
    blocks = tokenised(docs, id_col, text_col, a, b)
    # Columns, not lets: a block's aligned words are laid out as bytes once, not as objects that each let copies. Arithmetic and
    # structs are kept out of what is done for each token or word: Spark interprets lambdas, and these cost the most.
    blocks = blocks.select("docs", "of", "ids", "marked", F.transform("shapes", lambda s: _shape(s, dense, short)).alias("shapes"))
    shape = lambda k: F.col("shapes")[k]
    texts = F.zip_with("of", "marked", lambda k, marked: _written(_taken(marked, shape(k)["order"])))
    links = F.zip_with("of", "ids", lambda k, ids: F.zip_with(shape(k)["left"], shape(k)["right"], lambda x, y: ids[x].bitwiseOR(ids[y])))
    wide = F.when(F.exists("shapes", lambda s: F.size(s["wide"]) > 0), F.zip_with("of", "ids", lambda k, ids: _wide(shape(k), ids)))
    blocks = blocks.select("docs", F.transform("of", lambda k: shape(k)["n_groups"]).alias("n_groups"), texts.alias("texts"), links.alias("links"), wide.alias("wide"))

    def document(d: Column) -> Column:
        of = lambda col: F.transform(d["words"], lambda k: F.col(col)[k])
        n_groups = F.aggregate(d["words"], F.lit(0).cast("long"), lambda acc, k: acc + F.col("n_groups")[k])
        wide = F.when(F.col("wide").isNotNull(), F.flatten(of("wide"))).otherwise(F.array().cast(_PRODUCTS))
        return F.struct(d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), n_groups.alias("n_groups"), F.array_join(of("texts"), ";").alias("groups"), F.flatten(of("links")).alias("links"), wide.alias("wide"))

    rows = blocks.select(F.explode(F.transform("docs", document)).alias("d")).select("d.*")
    return rows.withColumn("n_links", F.size("links") + F.aggregate("wide", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))


def _ids(pair: Column) -> list[Column]:
    return [F.shiftright(pair, 32).cast("int").alias("a"), pair.bitwiseAND((1 << 32) - 1).cast("int").alias("b")]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, docs (how many rows hold the pair linked), best (no pair of the same a is in more)."""
    held = F.array_distinct(F.concat("links", F.transform("wide", lambda x: x["pair"])))
    pairs = aligned.select(F.explode(held).alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    pairs = P.written(pairs.select("pair", *_ids(F.col("pair")), "docs"), "token_pairs")
    top = pairs.groupBy("a").agg(F.max("docs").alias("top"))
    return pairs.join(top, "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))


def with_counts(aligned: DataFrame, key: str, pairs_at_most: int = PAIRS) -> DataFrame:
    """``aligned``, whose rows ``key`` tells apart, with n_best (links whose pair is a best one) and count_sum (counts of
    all links' pairs) instead of links. ``aligned`` should be a written table, as it is read several times."""
    pairs = P.written(pair_counts(aligned).select("pair", "docs", "best"), "token_counts")
    each = aligned.select(key, F.explode("links").alias("pair")).withColumn("n", F.lit(1).cast("long"))
    wide = aligned.where(F.size("wide") > 0).select(key, F.explode("wide").alias("x")).select(key, "x.pair", "x.n")
    small = pairs.count() <= pairs_at_most
    found = each.unionByName(wide).join(F.broadcast(pairs) if small else pairs.hint("merge"), "pair")
    sums = found.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    rest = [c for c in aligned.columns if c not in ("links", "wide")]
    return aligned.select(*rest).join(sums, key, "left").select(*rest, *filled)


def alignment_digests(docs: DataFrame, pairs_at_most: int = PAIRS, **options) -> DataFrame:
    """Of each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 ('' without tokens).

    Options are those of align_tokens, whose rows these are."""
    rows = align_tokens(docs, **options)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links", "wide")
    return with_counts(P.written(rows, "aligned"), "row", pairs_at_most).drop("row")
