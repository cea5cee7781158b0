"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

1. Every document's set of word shingles gets a sketch (rounds of hashed bin placement, see ``_sketch``)
   and a 128-bit fingerprint. Documents with equal sets are one class from here on, so a group of copies
   costs one row.
2. Banding: classes that agree in all coordinates of a band share a bucket. The number of bands follows
   from the similarity, so that a linked pair shares no bucket with a chance below 1e-9. Each member of a
   bucket is a candidate with the bucket's smallest document, its pivot: a row for each member, never a
   row for each pair.
3. Candidates are verified on full sets, streaming past their pivot; a hot pivot is salted.
4. Members of a bucket may be linked though they aren't both linked with its pivot. Where a pivot has
   such members they are compared with all its members on full sets, in blocks of bounded size by matrix
   products; only a spanning set of the links found leaves the block.
5. Connected components of all links.

Joins with tables of sets, texts and buckets are sort-merge joins by hint, so that the plan measured on
small tables is the plan of large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._graph import connected_components
from tessera.llm._pack import written
from tessera.llm._sketch import band_keys, bands_for, sketch

ROWS = 5
#: Members, and bytes of their sets, of a block of a pivot's members, on average; a task compares two blocks.
BLOCK = 1000
BLOCK_BYTES = 16 << 20
SALT = 500
_SIG = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
_SIG_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = "doc long, n long, els binary"
_SETS_SCHEMA = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("els", pa.binary())])
_LINKS_SCHEMA = pa.schema([("pivot", pa.int64()), ("doc", pa.int64()), ("linked", pa.bool_())])


def shingles_of(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (fingerprints) of lower-cased texts: values and offsets."""
    raw = [t or b"" for t in texts]
    buf = T.LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    lens = np.array([len(t) + 1 for t in raw], np.int64)
    starts = np.cumsum(lens) - lens
    s, e = T.word_spans(buf)
    counts = np.diff(np.searchsorted(s, np.append(starts, len(buf))))
    return T.shingle_sets(T.word_hashes(buf, s, e), counts, width)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in T.slices(b.column(1)):
                h, off = shingles_of(texts, width)
                n = np.diff(off)
                keys = band_keys(sketch(h, off, rows * bands), rows).view(np.int64)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(T.mix(h ^ np.uint64(k)), dtype=np.uint64)]) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                f = [(s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums]
                full = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]), pa.int32()), pa.array(keys[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(f[0]), pa.array(f[1]), lists], schema=_SIG_SCHEMA)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SIG)


def shingle_table(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, width: int) -> DataFrame:
    """(doc, n, els) for the documents named in ids (column doc); els: n sorted 64-bit shingle fingerprints."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).join(ids.select("doc").hint("merge"), "doc", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in T.slices(b.column(1)):
                h, off = shingles_of(t, width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off)), pa.array([h[a:z].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)], pa.binary())], schema=_SETS_SCHEMA)

    return texts.mapInArrow(run, _SETS)


def _passes(inter: np.ndarray | int, na: np.ndarray | int, nb: np.ndarray | int, similarity: tuple[int, int]):
    return similarity[1] * inter >= similarity[0] * (na + nb - inter)


def _verify(edges: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(pivot, doc, linked) for candidates (doc, pivot): members stream past their pivot's set."""
    salts = edges.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("salts"))
    heads = salts.join(sets.select(F.col("doc").alias("pivot"), "els").hint("merge"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("pivot").alias("doc"), "els")
    members = edges.join(salts, "pivot").select("doc", "pivot", F.expr("cast(pmod(xxhash64(doc), salts) as int)").alias("salt")).join(sets.select("doc", "els").hint("merge"), "doc").select("pivot", "salt", F.lit(1).alias("role"), "doc", "els")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            out: list[tuple] = []
            for pivot, salt, role, doc, els in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if at != (pivot, salt):
                    at, held = (pivot, salt), []
                x = np.frombuffer(els, np.uint64)
                if role == 0:
                    held.append(x)
                    continue
                linked = False
                for p in held:
                    spot = np.searchsorted(p, x)
                    spot[spot == len(p)] = 0
                    linked |= bool(_passes(int((p[spot] == x).sum()), len(x), len(p), similarity))
                out.append((pivot, doc, linked))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LINKS_SCHEMA, strict=True)], schema=_LINKS_SCHEMA)

    dealt = heads.unionByName(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return dealt.mapInArrow(run, "pivot long, doc long, linked boolean")


def block_links(docs: np.ndarray, sets: list[np.ndarray], open_: np.ndarray, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning set of the links between open rows and all rows; open_: rows whose links aren't known yet."""
    sizes = np.array([len(s) for s in sets], np.int64)
    els, back = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.empty(0), np.empty(0, np.int64))
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(back, minlength=len(els)) > 1
    shared = np.bincount(owner, often[back], len(sets)).astype(np.int64)
    # elements that no other row has are in no intersection
    able = similarity[1] * shared >= similarity[0] * sizes
    rows, cols = np.flatnonzero(open_ & able), np.flatnonzero(able)
    if not len(rows) or len(cols) < 2:
        return []
    use = often[back] & able[owner]
    owner, code = owner[use], np.cumsum(often)[back[use]] - 1
    place, order = np.full(len(sets), -1), np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    place[cols] = np.arange(len(cols))
    inter = np.zeros((len(rows), len(cols)), np.float32)
    step = 2048
    for lo in range(0, int(often.sum()), step):
        i, j = np.searchsorted(code, (lo, lo + step))
        m = np.zeros((len(cols), step), np.float32)
        m[place[owner[i:j]], code[i:j] - lo] = 1
        inter += m[place[rows]] @ m.T
    ok = _passes(inter.astype(np.int64), sizes[rows][:, None], sizes[cols][None, :], similarity)
    root = {int(d): int(d) for d in docs}

    def find(d: int) -> int:
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        a, b = int(docs[rows[i]]), int(docs[cols[j]])
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _complete(found: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (pivot, doc) between members of one pivot of which one at least isn't linked with it."""
    sized = found.join(sets.select("doc", (8 * F.col("n")).alias("bytes")).hint("merge"), "doc")
    groups = sized.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(~F.col("linked")).alias("free")).where("n > 1 and free > 0")
    of = groups.select("pivot", F.ceil(F.greatest(F.col("n") / F.lit(BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    rows = found.join(of, "pivot").withColumn("block", F.expr("cast(pmod(xxhash64(doc, 1), blocks) as int)"))
    # block k meets each block from k on: a row goes to every pair of blocks that holds its own
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rows.select("*", other.alias("o")).select("pivot", "doc", (~F.col("linked")).alias("free"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    full = pairs.join(sets.select("doc", "els").hint("merge"), "doc").select("pivot", "i", "j", "doc", "free", "els")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        docs = t.column("doc").to_numpy()
        links = block_links(docs, [np.frombuffer(x, np.uint64) for x in t.column("els").to_pylist()], t.column("free").to_numpy(), similarity)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=pa.schema([("pivot", pa.int64()), ("doc", pa.int64())]))

    return full.groupBy("pivot", "i", "j").applyInArrow(run, "pivot long, doc long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100), rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    The set of a text is its distinct runs of ``width`` words after A-Z are lowered; with fewer words the
    whole sequence; none without words. Texts are linked if intersection / union >= similarity, confirmed on
    full sets. component_id is the smallest doc_id that links reach, kept is doc_id = component_id.
    Null and empty texts are linked with nothing and kept. Rows with a null doc_id are linked with nothing;
    their component_id is null and kept is true. Rows that repeat a doc_id are one node, which has the links
    of all its texts. Other columns are ignored; an empty table gives no rows.
    """
    bands = bands_for(similarity[0] / similarity[1], rows)
    sig = written(signatures(docs, id_col, text_col, width, rows, bands), "signatures")
    named = sig.where("doc_id is not null and n_shingles > 0")
    classes = written(named.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    pivots = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot <> last").select("key", "pivot")
    edges = written(keys.join(pivots.hint("merge"), "key").where("rep <> pivot").select(F.col("rep").alias("doc"), "pivot").distinct(), "candidates")
    ids = edges.select("doc").unionByName(edges.select(F.col("pivot").alias("doc"))).distinct()
    sets = written(shingle_table(docs, id_col, text_col, ids, width), "sets")
    found = written(_verify(edges, sets, similarity).groupBy("pivot", "doc").agg(F.max("linked").alias("linked")), "verified")
    links = found.where("linked").select("pivot", "doc").unionByName(_complete(found, sets, similarity))
    # a doc_id with several texts is the same node in each of their classes
    same = named.join(classes.select("n_shingles", "f1", "f2", "rep"), ["n_shingles", "f1", "f2"]).where("doc_id <> rep").select(F.col("rep").alias("pivot"), F.col("doc_id").alias("doc"))
    twice = named.groupBy("doc_id").agg(F.count_distinct("n_shingles", "f1", "f2").alias("n")).where("n > 1").select(F.col("doc_id").alias("doc"))
    links = links.unionByName(same.join(twice, "doc", "left_semi"))
    comp = connected_components(links, "pivot", "doc")
    reps = classes.select("n_shingles", "f1", "f2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("c"))
    out = sig.drop("bands").join(reps, ["n_shingles", "f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("c")), F.col("doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
