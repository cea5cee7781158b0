"""Documents packed into parts, and counts over all parts that return aligned to each part.

A part holds a few megabytes of consecutive documents of one input split, compressed. A part knows
the sorted distinct fingerprints of what it holds (words, n-grams, prefixes of suffixes). A census
sends them, dealt into hash ranges, to where the same range of all parts meets, and returns for each
part one answer per entry in the part's own order: neither the fingerprints nor their positions
travel back. Equal entries of a part are combined before they travel, so a frequent entry costs one
row for each part and a hot key never fills a task.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 4 << 20
ENTRIES = 2_000_000
PACKED = "part long, fold int, ids binary, nulls binary, lens binary, body binary"
PART_SCHEMA = pa.schema([("part", pa.int64()), ("fold", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lens", pa.binary()), ("body", pa.binary())])
SENT = "bucket int, part long, payload binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("payload", pa.binary())])

_ZIP, _UNZIP = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


class Part:
    """ids, nulls (1: the id is null, 2: the text is null), starts and lens in bytes, buf: the texts, each followed by a line feed."""

    def __init__(self, ids: bytes, nulls: bytes, lens: bytes, body: bytes):
        self.ids, self.nulls, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(nulls, np.uint8), np.frombuffer(lens, np.int64)
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(body) if body else b"", np.uint8)
        self.starts = np.cumsum(self.lens + 1) - (self.lens + 1)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of words of each document."""
        from tessera.llm._text import word_spans

        s, e = word_spans(self.buf)
        return s, e, np.diff(np.searchsorted(s, np.append(self.starts, len(self.buf))))


def parts_of(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, Part]]:
    for r in range(table.num_rows):
        x = [table.column(c)[r].as_py() for c in ("part", "fold", "ids", "nulls", "lens", "body")]
        yield x[0], x[1], Part(*x[2:])


def pack(docs: DataFrame, id_col: str, text_col: str, fold: object = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Parts of docs, in the order of the input splits. fold: a Column of int; the documents of a part share it.

    The input must be replayable (a scan, or cut by a checkpoint): a part is named by its split and place.
    """
    one = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), (F.lit(0) if fold is None else fold).cast("int").alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, made, held = TaskContext.get().partitionId() << 32, {}, {}
        press = zstandard.ZstdCompressor(level=6)

        def out(f: int) -> pa.RecordBatch:
            ids, nulls, texts, _ = held.pop(f)
            made[f] = made.get(f, 0) + 1
            lens = np.array([len(t) for t in texts], np.int64)
            texts.append(b"")
            row = [split + (f << 28) + made[f], f, np.array(ids, np.int64).tobytes(), bytes(nulls), lens.tobytes(), press.compress(b"\n".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([x], y.type) for x, y in zip(row, PART_SCHEMA, strict=True)], schema=PART_SCHEMA)

        for b in batches:
            for i, t, f in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids, nulls, texts, size = held.setdefault(f or 0, ([], bytearray(), [], [0]))
                ids.append(i or 0)
                nulls.append((i is None) + 2 * (t is None))
                texts.append(t or b"")
                size[0] += len(t or b"") + 32
                if size[0] >= part_bytes:
                    yield out(f or 0)
        for f in sorted(held):
            yield out(f)

    return one.mapInArrow(run, PACKED)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: the one figure from which the number of hash ranges follows."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, lowest first, as many as the largest needs; planes of zeros compress to nothing."""
    x = np.ascontiguousarray(x, np.uint64)
    n = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return struct.pack("<QB", len(x), n) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplanes(b: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    count, n = struct.unpack_from("<QB", b, at)
    at += 9
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8, count * n, at).reshape(n, count).T
    return out.view(np.uint64).reshape(-1), at + count * n


def put_bits(x: np.ndarray, bits: int) -> bytes:
    """The lowest bits of numbers: whole bytes as planes, the rest bit by bit."""
    full, rest = divmod(bits, 8)
    out = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :full].T).tobytes()
    if rest:
        top = (x >> np.uint64(8 * full)).astype(np.uint8)
        out += np.packbits((top[:, None] >> np.arange(rest, dtype=np.uint8)) & np.uint8(1)).tobytes()
    return out


def get_bits(b: bytes, at: int, count: int, bits: int) -> tuple[np.ndarray, int]:
    full, rest = divmod(bits, 8)
    out = np.zeros((count, 8), np.uint8)
    out[:, :full] = np.frombuffer(b, np.uint8, count * full, at).reshape(full, count).T
    at += count * full
    if rest:
        size = -(-count * rest // 8)
        flags = np.unpackbits(np.frombuffer(b, np.uint8, size, at))[: count * rest].reshape(count, rest)
        out[:, full] = (flags << np.arange(rest, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
        at += size
    return out.view(np.uint64).reshape(-1), at


def put_counts(x: np.ndarray) -> bytes:
    """Numbers most of which are small: byte planes, each compressed by itself, as each has its own distribution."""
    x = np.ascontiguousarray(x, np.uint64)
    n = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 0
    each = [_ZIP.compress(plane.tobytes()) for plane in x.view(np.uint8).reshape(-1, 8)[:, :n].T]
    return struct.pack("<QB", len(x), n) + b"".join(struct.pack("<I", len(p)) + p for p in each)


def get_counts(b: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    count, n = struct.unpack_from("<QB", b, at)
    at += 9
    out = np.zeros((count, 8), np.uint8)
    for k in range(n):
        (size,) = struct.unpack_from("<I", b, at)
        out[:, k] = np.frombuffer(_UNZIP.decompress(b[at + 4 : at + 4 + size]), np.uint8)
        at += 4 + size
    return out.view(np.uint64).reshape(-1), at


def put_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by Rice's code of their differences: of evenly spread ones the shortest but for a few hundredths of a bit each."""
    x = np.ascontiguousarray(x, np.uint64)
    if not len(x):
        return struct.pack("<Q", 0)
    d = np.diff(x)
    span = int(x[-1] - x[0])
    low = round(math.log2(max(1.0, 0.69 * span / max(1, len(d)))))
    ones = np.cumsum((d >> np.uint64(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    unary[ones] = 1
    return struct.pack("<QQBQ", len(x), int(x[0]), low, len(unary)) + put_bits(d, low) + np.packbits(unary).tobytes()


def get_sorted(b: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    (count,) = struct.unpack_from("<Q", b, at)
    if not count:
        return np.zeros(0, np.uint64), at + 8
    _, first, low, size = struct.unpack_from("<QQBQ", b, at)
    d, at = get_bits(b, at + 25, count - 1, low)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, -(-size // 8), at))[:size])
    d |= (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), d]), dtype=np.uint64), at + -(-size // 8)


def put_ids(x: np.ndarray) -> bytes:
    """Signed numbers, as planes above the smallest of them."""
    low = x.min() if len(x) else np.int64(0)
    return struct.pack("<q", int(low)) + planes(x.view(np.uint64) - np.asarray(low).view(np.uint64))


def get_ids(b: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    low = np.frombuffer(b, np.int64, 1, at).view(np.uint64)
    x, at = unplanes(b, at + 8)
    return (x + low).view(np.int64), at


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of x, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal hash ranges begins and ends in a sorted array."""
    first = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, first), [len(sorted_hashes)]]).astype(np.int64)


def send(part: int, bodies: dict[int, bytes]) -> pa.RecordBatch:
    keys = sorted(bodies)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([part] * len(keys), pa.int64()), pa.array([bodies[k] for k in keys], pa.binary())], schema=SENT_SCHEMA)


def replies(rows: list[tuple[int, bytes]], bucket: int) -> pa.Table:
    return pa.table([pa.array([bucket] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=SENT_SCHEMA)


def meet(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """For each bucket, answer(payloads of all parts, in the order of parts) gives one reply for each; the result is keyed by part."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("part").to_numpy(), kind="stable")))
        parts = t.column("part").to_pylist()
        got = answer(t.column("payload").to_pylist())
        return replies(list(zip(parts, got, strict=True)), key[0].as_py())

    return sent.groupBy("bucket").applyInArrow(run, SENT)


def replied(t: pa.Table) -> list[bytes]:
    """The replies to one part in the order of buckets."""
    at = np.argsort(t.column("bucket").to_numpy())
    x = t.column("payload")
    return [x[int(i)].as_py() for i in at]


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, whatever their letters' case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one under the warehouse, in local mode only: a cluster's
    executors needn't share the warehouse's default folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return base.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs read it, whichever executor made it is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
