"""Each operator against a brute-force version, on tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, lm_score, mixing, near_dedup, quality, queries, sharding, substring_dedup, token_packing, topk_search
from tessera.llm._graph import connected_components
from tessera.llm._sketch import bands_for, sketch

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, rep long, key string, shard string, slot int, fold int, doc long, mix_keep double"


def words(text, lower=True):
    t = text or ""
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def made_texts(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)] + ["Über", "naïve,", "Ωmega"]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(1, 80))) for _ in range(n)]
    for k in range(0, n, 5):
        t = texts[k].split(" ")
        t[len(t) // 2] = "edited"
        texts.append(" ".join(t))
        texts.append(texts[k])
    texts += ["\n".join(" ".join(r.choices(vocabulary, k=9)) for _ in range(6)) + "\n" + texts[1], "line one is here\nline one is here\n\nLINE one is here now", "same same same " * 30, "x", "", None, " \t\n ", "a b c d", "y " * 30000]
    return texts


def table(spark, texts, ids=None):
    rows = [((i if ids is None else ids[i]), t, None if i % 11 == 3 else ("en", "de")[i % 2], None if i % 13 == 4 else f"s{i % 3}", None, 7, 7, "k", "z", 7, 7, 7, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, made_texts()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_all_take_an_empty_table(spark, empty):
    assert sharding.assign_shards(empty).count() == 0
    assert lm_score.score_documents(empty).count() == 0
    assert decontaminate.contaminated_pairs(empty, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert token_packing.pack_tokens(empty).count() == 0
    assert quality.classify(empty).count() == 0
    assert mixing.mixed(empty).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk_search.top_k(vectors, vectors["vec_id"] % 2 == 0).count() == 0


def test_codes_round_trip():
    from tessera.llm import _pack as P

    r = np.random.default_rng(5)
    for n in (0, 1, 2, 9, 1000):
        for top in (1, 2, 5, 2**20, 2**40, 2**64 - 1):
            x = np.sort(r.integers(0, top, n, np.uint64, endpoint=True))
            got, at = P.get_sorted(b"zz" + P.put_sorted(x) + b"q", 2)
            assert got.tolist() == x.tolist() and at == 2 + len(P.put_sorted(x))
            x = r.integers(0, top, n, np.uint64, endpoint=True)
            got, at = P.get_counts(b"z" + P.put_counts(x) + b"q", 1)
            assert got.tolist() == x.tolist() and at == 1 + len(P.put_counts(x))
            ids = r.integers(-(top // 2) - 1, top // 2, n)
            got, at = P.get_ids(b"z" + P.put_ids(ids), 1)
            assert got.tolist() == ids.tolist() and at == 1 + len(P.put_ids(ids))
    x = np.sort(r.integers(0, 2**40, 50_000, np.uint64))
    assert 8 * len(P.put_sorted(x)) < 50_000 * (40 - np.log2(50_000) + 1.6)


# 1 sharding


def test_table_is_filled_in_turns():
    names, slots = ["a", "b", "c"], 13
    got = sharding.fill_table(names, slots)
    orders = []
    for n in names:
        o, s = sharding._number(n, "offset") % slots, sharding._number(n, "stride") % (slots - 1) + 1
        orders.append([(o + j * s) % slots for j in range(slots)])
    want = [None] * slots
    k = 0
    while None in want:
        want[next(x for x in orders[k % 3] if want[x] is None)] = k % 3
        k += 1
    assert got == want


def test_shards_are_even_and_stable():
    many = [f"n{k}" for k in range(16)]
    a = sharding.fill_table(many, 4099)
    assert max(Counter(a).values()) - min(Counter(a).values()) <= 1
    b = sharding.fill_table(many[:-1], 4099)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 15)
    assert moved < 0.15 * 4099
    for bad in ([], ["a", "a"], ["a"] * 1), :
        with pytest.raises(ValueError):
            sharding.fill_table(bad[0], 13)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 12)


def test_sharding_rows(spark, docs):
    ids = [None, 5, 5, 6]
    x = table(spark, ["a", "b", "c", None], ids)
    rows = sharding.assign_shards(x).collect()
    t = sharding.fill_table(sharding.SHARDS)
    for r in rows:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:12], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, t[slot])
    assert len(rows) == 4 and set(sharding.assign_shards(x).columns) == set(x.columns)
    odd = sharding.assign_shards(x.selectExpr("*", "'mine' as at", "'mine' as __at", "1 as __slot", "2 as __shard", "3 as __SLOT2")).collect()
    assert {(r["at"], r["__at"], r["__slot"], r["__shard"]) for r in odd} == {("mine", "mine", 1, 2)} and sorted((r["slot"], r["shard"]) for r in odd) == sorted((r["slot"], r["shard"]) for r in rows)
    assert "Python" not in sharding.assign_shards(docs)._jdf.queryExecution().toString()


# 2 language model


def test_lm_scores(spark, docs):
    rows = {r["doc_id"]: r for r in lm_score.score_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    toks = {i: [*words(t), None] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in texts}

    def counts(use):
        c = [Counter(), Counter(), Counter()]
        for i in use:
            s = ["<", "<", *toks[i]]
            for k in range(2, len(s)):
                c[0][s[k]] += 1
                c[1][tuple(s[k - 1 : k + 1])] += 1
                c[2][tuple(s[k - 2 : k + 1])] += 1
        return c

    c = counts([i for i in texts if fold[i]])
    n, v, d = sum(c[0].values()), len(c[0]), c[0][None]
    kept = counts([i for i in texts if fold[i] > 1])

    def levels(s, k, c, n, v, d):
        h2 = d if k == 2 else c[1][tuple(s[k - 2 : k])]
        h1 = d if k == 2 else c[0][s[k - 1]]
        b = [min(math.frexp(h)[1], lm_score.BUCKETS - 1) if h else 0 for h in (h2, h1)]
        return [c[2][tuple(s[k - 2 : k + 1])] / h2 if h2 else 0, c[1][tuple(s[k - 1 : k + 1])] / h1 if h1 else 0, c[0][s[k]] / n, 1 / (v + 1)], b

    w = lm_score.Weights.even()
    kn, kv, kd = sum(kept[0].values()), len(kept[0]), kept[0][None]
    tune = []
    for i in texts:
        if fold[i] == 1:
            s = ["<", "<", *toks[i]]
            tune += [levels(s, k, kept, kn, kv, kd) for k in range(2, len(s))]
    l1, l2, l3 = w.l1, list(w.l2), list(w.l3)
    for _ in range(lm_score.ROUNDS):
        s = np.zeros((3, 2, lm_score.BUCKETS))
        for p, b in tune:
            m = [l3[b[0]] * p[0], (1 - l3[b[0]]) * l2[b[1]] * p[1], (1 - l3[b[0]]) * (1 - l2[b[1]]) * l1 * p[2], (1 - l3[b[0]]) * (1 - l2[b[1]]) * (1 - l1) * p[3]]
            r = [x / sum(m) for x in m]
            for k, (at, mine, base) in enumerate(((b[0], r[0], 1), (b[1], r[1], 1 - r[0]), (0, r[2], r[2] + r[3]))):
                s[k, 0, at] += mine
                s[k, 1, at] += base
        new = np.where(s[:, 1] > 0, s[:, 0] / np.maximum(s[:, 1], 1e-300), 0.5)
        new[:2, 0] = 0
        off = max(abs(new[2, 0] - l1), np.abs(new[1] - l2).max(), np.abs(new[0] - l3).max())
        l1, l2, l3 = new[2, 0], list(new[1]), list(new[0])
        if off < lm_score.TOLERANCE:
            break
    for i, r in rows.items():
        t = toks[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[i] == 0, len(t), sum(c[0][x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[0][x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel=1e-9)
        if len(t) < 500 or i % 10 == 0:
            want, s = 0, ["<", "<", *t]
            for k in range(2, len(s)):
                p, b = levels(s, k, c, n, v, d)
                want += math.log10(l3[b[0]] * p[0] + (1 - l3[b[0]]) * (l2[b[1]] * p[1] + (1 - l2[b[1]]) * (l1 * p[2] + (1 - l1) * p[3])))
            assert r["score"] == pytest.approx(want, rel=1e-6)


def test_lm_rows_of_repeated_and_nameless_documents(spark):
    rows = lm_score.score_documents(table(spark, ["a b c", "a b c", None, "d e", ""], [None, 5, 5, 5, None])).collect()
    fold = {None: zlib.crc32(b"") % 10, 5: zlib.crc32(b"5") % 10}
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["held_out"]) for r in rows) == sorted((str(i), n, fold[i] == 0) for i, n in ((None, 4), (5, 4), (5, 1), (5, 3), (None, 1)))
    assert {r["train_tokens"] for r in rows} == {sum(n for i, n in ((None, 4), (5, 4), (5, 1), (5, 3), (None, 1)) if fold[i])}


def test_lm_beats_its_base_on_held_out_text(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.score_documents(d).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]


def test_lm_counts_no_other_ngram(spark):
    grams = [np.array([(5 << 40) + 1, (5 << 40) + 2, (5 << 40) + 2], np.uint64)] * lm_score.ORDERS
    assert [(len(keys), n.tolist()) for keys, _, n in lm_score._distinct(grams)] == [(2, [1, 2])] * 3
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(200)) for _ in range(300)]
    sent = lm_score.counted(table(spark, texts), "doc_id", "text", F.lit(lm_score.TRAIN)).where("fold >= 0")
    got, want = Counter(), Counter()
    for x in sent.select("lens", "seen").collect():
        got.update(lm_score._unpress(x["seen"])[2].tolist())
    c = Counter()
    for t in texts:
        s = ["<", "<", *t.split(" "), None]
        c.update(tuple(s[k - 2 : k + 1]) for k in range(2, len(s)))
    for n in c.values():
        want[n] += n
    assert got == want


# 3 decontamination


def test_contained_items(spark):
    r = random.Random(5)
    v = [f"v{k}" for k in range(400)]
    items = [" ".join(r.choices(v, k=k)) for k in (3, 4, 5, 6, 12, 40, 90, 300)] + [None, "", "one"]
    texts = [" ".join(r.choices(v, k=n)) for n in (0, 3, 50, 900, 20000)]
    for t in items[:8]:
        w = t.split(" ")
        texts += [" ".join(r.choices(v, k=n)) + " " + t.upper() + " " + " ".join(r.choices(v, k=n)) for n in (1, 2000)]
        texts += [" ".join(w[: len(w) * 9 // 10]), " ".join(w[: len(w) // 2]), t]
    texts += [None, items[0]]
    one = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = sorted((x["doc_id"], x["item_id"], x["shared"], x["n_item"]) for x in decontaminate.contaminated_pairs(table(spark, texts), one).collect())

    def sh(t):
        w = words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    want = sorted((d, i, len(sh(a) & sh(b)), len(sh(b))) for d, a in enumerate(texts) for i, b in enumerate(items) if sh(b) and 5 * len(sh(a) & sh(b)) >= 4 * len(sh(b)))
    assert got == want and len(want) > 20
    left = {x["doc_id"] for x in decontaminate.drop_contaminated(table(spark, texts), one).collect()}
    assert left == set(range(len(texts))) - {d for d, *_ in want}


def test_contained_items_of_repeated_and_nameless_rows(spark, monkeypatch):
    item = " ".join(f"q{k}" for k in range(30))
    d = table(spark, [item, item, "x " + item, item, "plain words"], [1, 1, 1, None, 2])
    b = spark.createDataFrame([(None, item), (4, item), (4, item), (5, "zz")], "item_id long, text string")
    for limit in (decontaminate.BLOCK_BYTES, 150):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        for parts in (1, 3):
            got = [tuple(x) for x in decontaminate.contaminated_pairs(d.repartition(parts), b).collect()]
            assert sorted(got, key=str) == sorted([(i, k, 26, 26) for i in (1, None) for k in (4, None)], key=str)
            assert [x["doc_id"] for x in decontaminate.drop_contaminated(d, b.where("item_id is null")).collect()] == [2]


# 4 top-k


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(160)]
    rows += [(200 + i, rows[5][1]) for i in range(12)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, rows[0][1]), (310, [0.5]), (320, []), (330, [0.0] * 8), (50, rows[7][1])]
    # wide ones: components whose scaled squares no long holds, and numbers that lose their last bits when scaled
    rows += [(340, [3e30] * 8), (341, [-1e300, 0.5]), (342, [1e7, 1.0]), (350, [1e7, -1e300, 2.0]), (351, [5000.00390625] * 3), (352, [float(2**52 + 1)])]
    v = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, block int, rank string").repartition(5)
    got = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk_search.top_k(v, v["vec_id"] % 10 == 0).collect()]
    ok = [(i, e, [math.floor(Fraction(x) * 256) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q in sorted({i for i, _, _ in ok if i % 10 == 0}):
        e = min((raw, e) for i, raw, e in ok if i == q)[1]
        s = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), i) for i, _, f in ok if i != q)[:5]
        want += [(q, k + 1, i, max(-(2**63) + 1, min(2**63 - 1, -x))) for k, (x, i) in enumerate(s)]
    assert sorted(got) == sorted(want) and max(x[3] for x in got) == 2**63 - 1


def test_top_k_keeps_large_components(spark):
    v = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e7, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk_search.top_k(v, v["vec_id"] == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 256 * 2560000000 + 65536), (0, 2, 2, 65536)]


def test_bit_slices():
    r = np.random.default_rng(0)
    m, q = r.integers(-300, 300, (500, 7)), r.integers(-300, 300, 7)
    low, width, slices = topk_search.build_slices(m)
    score, constant = topk_search.add_slices(q, low, width, slices)
    assert (topk_search.score_of(score, np.arange(500), constant) == m @ q).all()
    for a in range(-70, 70):
        assert sum(d << p for p, d in topk_search.signed_digits(a)) == a


# 5 substrings


def test_substrings(spark, docs):
    ids = None
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs, group=3, part_bytes=4000).collect()}
    first = {}
    split = {i: words(t, False) for i, t in texts.items()}
    for i in sorted(split):
        w = split[i]
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    removed = 0
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone[k : k + 20] = [True] * 20
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), sum(gone))
        assert r["kept_text"] == " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert [k for x in r["removed"] for k in range(x["start"], x["end"])] == [k for k, g in enumerate(gone) if g]
        removed += sum(gone)
    assert removed > 1000 and ids is None


def test_substrings_of_repeated_and_nameless_rows(spark):
    t = " ".join(f"q{k}" for k in range(25))
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.dedup_substrings(table(spark, [t, t, t, t, t], [None, 4, 4, 9, None])).collect())
    assert got == [("4", 0), ("4", 0), ("9", 25), ("None", 25), ("None", 25)]


def test_substrings_of_negative_ids(spark):
    t = " ".join(f"q{k}" for k in range(25))
    for parts in (1, 2, 4):
        d = table(spark, [t, t, t, "few words"], [3, -5, -4, -9]).repartition(parts)
        got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(d).collect()}
        assert got == {-9: 0, -5: 0, -4: 25, 3: 25}


def test_internal_nodes_of_subtrees():
    r = random.Random(12)
    text = [r.randrange(3) for _ in range(160)]
    text += text[20:50] + [0] + text[25:45] + [1] * 20
    short, window = 2, 13
    at = list(range(len(text) - window + 1))
    key = np.array([hash(tuple(text[i : i + short])) % 2**60 for i in at], np.uint64)
    labels = np.array([text[i + short : i + window] for i in at], np.uint8)
    tail = np.array([hash(tuple(text[i : i + window])) % 2**60 for i in at], np.uint64)
    tree = substring_dedup.Subtrees(key, labels, tail, np.zeros(len(at), np.int64), np.array(at), short, window)
    for least in (short, 5, window):
        got = {(d, tuple(sorted(at[k] for k in tree.leaves[a : z + 1]))) for a, z, d in zip(*(c.tolist() for c in tree.internal_nodes(least)), strict=True)}
        want = set()  # runs that occur more than once and can't be made longer to the right without losing one
        for d in range(least, window + 1):
            of = defaultdict(list)
            for i in at:
                of[tuple(text[i : i + d])].append(i)
            want |= {(d, tuple(v)) for v in of.values() if len(v) > 1 and (d == window or len({text[i + d] for i in v}) > 1)}
        assert got == want and len(want) > 3


# 6 near duplicates


def sets(texts, width):
    out = {}
    for i, t in texts.items():
        w = words(t)
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def components(s, num, den):
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in s if s[i])
    for a in ids:
        for b in ids:
            if a < b and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in s}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "SALT", 5)
    r = random.Random(8)
    v = [f"t{k}" for k in range(3000)]
    texts = made_texts(8, 40)
    base = r.choices(v, k=70)
    for _ in range(60):  # copies with up to eight edits, some of them copies of copies
        t = list(base)
        for _ in range(r.randint(0, 8)):
            t[r.randrange(len(t))] = r.choice(v)
        texts.append(" ".join(t))
        base = t if r.random() < 0.1 else base
    for width, num in ((3, 85), (5, 80)):
        got = {x["doc_id"]: x for x in near_dedup.near_duplicates(table(spark, texts), width=width, similarity=(num, 100)).collect()}
        s = sets(dict(enumerate(texts)), width)
        want = components(s, num, 100)
        assert {i: x["component_id"] for i, x in got.items()} == want
        assert all(x["n_shingles"] == len(s[i]) and x["kept"] == (want[i] == i) for i, x in got.items())


def test_near_duplicates_of_odd_rows(spark):
    t = " ".join(f"q{k}" for k in range(30))
    got = sorted((str(x["doc_id"]), str(x["component_id"]), x["kept"]) for x in near_dedup.near_duplicates(table(spark, [t, t, t, "other words here", "", None], [7, 3, 3, 3, 8, None])).collect())
    assert got == [("3", "3", True)] * 3 + [("7", "3", False), ("8", "8", True), ("None", "None", True)]


def test_sketches_estimate_and_fill():
    r = np.random.default_rng(4)
    a = r.integers(0, 2**63, 900, dtype=np.uint64)
    both = np.concatenate([np.sort(a[:600]), np.sort(a[150:750]), a[:1]])
    s = sketch(both, np.array([0, 600, 1200, 1201, 1201]), 400)
    assert abs((s[0] == s[1]).mean() - 450 / 750) < 0.1
    assert (s[:3] != 2**64 - 1).all() and (s[3] == 2**64 - 1).all()
    assert (1 - 0.85**5) ** bands_for(0.85, 5) <= 1e-9


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: y for x, y in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


# 7 lines


def test_lines(spark):
    r = random.Random(9)
    v = [f"u{k}" for k in range(200)]
    lines = [" ".join(r.choices(v, k=r.randint(1, 25))) for _ in range(60)]
    texts = []
    for _ in range(50):
        own = []
        for _ in range(r.randint(0, 8)):
            w = r.choice(lines).split(" ")
            if r.random() < 0.6:
                w[r.randrange(len(w))] = r.choice(v)
            own.append(("  " if r.random() < 0.1 else "") + " ".join(w))
        texts.append("\n".join(own))
    texts += [None, "", "\n\n \n", texts[3], "A b c d e\na B c d e\nA b c d f"]
    got = {x["doc_id"] + 20: x for x in line_dedup.dedup_lines(table(spark, texts, [i - 20 for i in range(len(texts))])).collect()}
    rows = [(i, ln, frozenset(words(ln)), len(words(ln))) for i, t in enumerate(texts) for ln in (t or "").split("\n") if words(ln)]
    first, links, early = {}, Counter(), set()
    for k, (_, _, s, n) in enumerate(rows):
        first.setdefault(s, k)
    kinds = sorted(first, key=first.get)
    for a in range(len(kinds)):
        for b in range(a):
            if 5 * len(kinds[a] & kinds[b]) >= 4 * len(kinds[a] | kinds[b]):
                links[kinds[a]] += 1
                links[kinds[b]] += 1
                early.add(kinds[a])
    want = defaultdict(lambda: [0, 0, 0, []])
    for k, (i, ln, s, n) in enumerate(rows):
        e = want[i]
        e[0] += 1
        gone = first[s] != k or s in early
        e[1] += gone
        e[2] += links[s] if first[s] == k else 0
        if not gone:
            e[3].append(ln)
    same = defaultdict(list)
    for i in range(len(texts)):
        same[tuple(sorted(tuple(sorted(s)) for j, _, s, _ in rows if j == i))].append(i)
    least = {i: min(g) for g in same.values() for i in g}
    for i in range(len(texts)):
        x, e = got[i], want[i]
        assert (x["n_lines"], x["n_removed"], x["n_links"], x["kept_text"], x["class_id"] + 20) == (e[0], e[1], e[2], "\n".join(e[3]), least[i])
    assert sum(links.values()) > 20


def test_lines_of_repeated_and_nameless_rows(spark):
    a, b = "the first line stands here", "another one is below"
    for parts in (1, 3):
        d = table(spark, [a, a, f"{b}\n{a}", b, b, a], [None, 4, 4, -7, None, -8]).repartition(parts)
        got = [(x["doc_id"], x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(d).collect()]
        assert sorted(got, key=str) == sorted([(-8, 1, 0), (-7, 1, 0), (4, 1, 1), (4, 2, 2), (None, 1, 1), (None, 1, 1)], key=str)


def test_short_lines_join_in_the_query(spark, tmp_path):
    r = random.Random(4)
    v = [f"u{k}" for k in range(12)]
    texts = ["\n".join(" ".join(r.choices(v, k=r.choice((1, 1, 2, 2, 3, 4, 5, 6)))) for _ in range(r.randint(0, 6))) for _ in range(60)] + [None, "", "Menu\nread more\nMENU", "menu\nmore read\nread"]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    rows = [(i, ln, frozenset(words(ln))) for i, t in enumerate(texts) for ln in (t or "").split("\n") if words(ln)]
    first, links, early = {}, Counter(), set()
    for k, (_, _, s) in enumerate(rows):
        first.setdefault(s, k)
    kinds = sorted(first, key=first.get)
    for a in range(len(kinds)):
        for b in range(a):
            if 5 * len(kinds[a] & kinds[b]) >= 4 * len(kinds[a] | kinds[b]):
                links[kinds[a]] += 1
                links[kinds[b]] += 1
                early.add(kinds[a])
    want = {i: [0, 0, 0, []] for i in range(len(texts))}
    for k, (i, ln, s) in enumerate(rows):
        gone = first[s] != k or s in early
        want[i][0] += 1
        want[i][1] += gone
        want[i][2] += links[s] if first[s] == k else 0
        want[i][3] += [] if gone else [ln]
    for i, (lines, removed, n_links, kept) in want.items():
        x = got[i]
        assert (x["n_lines"], x["n_removed"], x["n_links"], x["kept_sha256"]) == (lines, removed, n_links, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert got[62]["n_removed"] == 1 and got[63]["n_removed"] == 2


# 8 packing


def test_packing_round_trip(spark, docs, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = token_packing.pack_tokens(docs, length=64, run_tokens=3000).collect()
    enc = token_packing.encoder(open(token_packing.RANKS, "rb").read())
    pieces = defaultdict(dict)
    for r in rows:
        ids, pos = (np.frombuffer(r[c], "<u4") for c in ("input_ids", "position_ids"))
        assert len(ids) == 64 and r["n_tokens"] == r["cu_seqlens"][-1] and r["n_segments"] == len(r["doc_ids"])
        for d, k, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            pieces[d][k] = ids[a:b]
            assert (pos[a:b] == np.arange(b - a)).all()
    assert set(pieces) == {i for i, t in texts.items() if t}
    for i, p in pieces.items():
        t = np.concatenate([p[k] for k in range(len(p))]).tolist()
        assert t[-1] == 50256 and t[:-1] == enc.encode_ordinary(texts[i]) and enc.decode(t[:-1]) == texts[i]
    monkeypatch.setattr(token_packing, "_SLICE", 40)
    for t in list(texts.values())[:60]:
        assert token_packing.encode(t or "", enc).tolist() == enc.encode_ordinary(t or "")


def test_best_fit_decreasing():
    r = random.Random(0)
    for _ in range(200):
        length = r.randint(1, 40)
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 40))]
        rows, room = token_packing.best_fit(sizes, length), []
        for s in sorted(sizes, reverse=True):
            fits = [c for c in room if c >= s]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - s)
            else:
                room.append(length - s)
        assert sorted(length - sum(sizes[i] for i in x) for x in rows) == sorted(room)
        assert sorted(i for x in rows for i in x) == list(range(len(sizes)))


# 9 quality


def test_quality_against_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = quality.classify(d).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in x if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in x if r["quality"] == 0]
    assert sum(clean) / len(clean) > 0.97 and sum(bad) / len(bad) < 0.05


def test_quality_rows(spark, docs):
    rows = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        if not words(r["text"]):
            assert rows[r["doc_id"]]["score"] == 0 and not rows[r["doc_id"]]["kept"]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}
    nameless = quality.classify(table(spark, ["Some plain words are here.", "Some plain words are here."], [None, None])).collect()
    assert nameless[0]["score"] == nameless[1]["score"] and nameless[0]["doc_id"] is None


def test_label_model_learns_accuracies():
    r = np.random.default_rng(3)
    n, m = 4000, len(quality.LABELLERS)
    bad = r.random(n) < 0.3
    right = np.linspace(0.6, 0.95, 6)
    votes = np.zeros((n, m), np.int8)
    for k in range(6):
        said = np.where(bad, r.random(n) < right[k], r.random(n) < 0.005)
        votes[:, k] = np.where(said, -1, 1 if k == 5 else 0)
    codes, back, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.LabelModel.fit(codes, count.astype(float))
    p = model.posterior(codes)[back.reshape(-1)]
    assert ((p > 0.5) == bad).mean() > 0.98


def test_quality_sample_of_any_size(spark, docs):
    for rows in (10**4, 16 * 10**9, 10**13):
        share = (quality.sample_bound(quality.SAMPLE, rows) + 2**63 + 1) / 2**64
        assert min(1, quality.SAMPLE / rows) <= share <= min(1, 1.1 * quality.SAMPLE / rows)
    assert quality.sample_bound(quality.SAMPLE, 10) == 2**63 - 1
    with pytest.raises(ValueError):
        quality.fit_quality(docs, sample=0)


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows: seen.append(rows) or (np.zeros(quality.FEATURES), 0.0))
    texts = ["The same words again."] * 400 + [f"Here stand the words number {k}." for k in range(300)]
    quality.fit_quality(table(spark, texts, [7] * len(texts)), sample=100)
    assert 0 < len(seen[0]) <= 100 and max(Counter(seen[0]).values()) == 1


# 10 mixing


def test_raking_meets_the_targets(spark):
    r = random.Random(2)
    cells = [(f"s{a}", f"l{b}", f"t{c}", r.randint(1, 5000)) for a in range(5) for b in range(3) for c in range(3) if r.random() < 0.8]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goal = {"source": {f"s{k}": (k + 1) / 15 for k in range(5)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}
    rows = mixing.rake(df, goal).collect()
    total = sum(x["tokens"] * x["keep"] for x in rows)
    for d, want in goal.items():
        have = Counter()
        for x in rows:
            have[x[d]] += x["tokens"] * x["keep"] / total
        assert all(have[k] == pytest.approx(v, rel=1e-6) for k, v in want.items())
    assert max(x["keep"] for x in rows) == pytest.approx(1)


def test_raking_tells_of_targets_out_of_reach(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SWEEPS", 2)
    df = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 30)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="2 sweeps"):
        assert mixing.rake(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}).count() == 2


def test_mixing_rows(spark, docs):
    x = mixing.mixed(docs)
    rows = x.collect()
    assert len(rows) == docs.count() and x.columns.count("mix_keep") == 1
    for r in rows:
        u = int(hashlib.md5(f"{r['doc_id']}:mix".encode()).hexdigest()[:12], 16) / 2**48
        assert r["mix_kept"] == (u < r["mix_keep"]) and 0 <= r["mix_keep"] <= 1
        assert r["mix_tokens"] == len(words(r["text"])) and r["mix_source"] == (r["source"] or "") and r["mix_lang"] == (r["lang"] or "")
    assert "Python" not in x._jdf.queryExecution().toString()


def test_hot_words_take_products_and_others_merge(monkeypatch):
    import zstandard

    from tessera.llm import _pack as P

    r = random.Random(6)
    base = sorted(r.sample(range(5000), 30))
    lines = sorted({tuple(sorted(set(base) - set(r.sample(base, r.randint(0, 3))) | set(r.sample(range(5000), r.randint(0, 3))))) for _ in range(150)})
    sim, entries = (4, 5), []
    for i, t in enumerate(lines):  # the smaller the token, the rarer
        for pos in range(len(t) - -(-len(t) * 4 // 5) + 1):
            entries.append((t[pos], len(t), pos, i, 0, i, t))
    entries.sort()
    cols = [np.array([e[k] for e in entries], np.uint64) for k in range(6)]
    body = zstandard.ZstdCompressor().compress(P.put_sorted(cols[0]) + b"".join((P.put_ids(c.astype(np.int64)) if k == 2 else P.planes(c)) for k, c in enumerate(cols[1:])) + P.planes(np.array([x for e in entries for x in e[6]], np.uint64)))
    seen = []
    for few in (0, 5, 10**9):
        monkeypatch.setattr(line_dedup, "FEW", few)
        monkeypatch.setattr(line_dedup, "BLOCK", 20)
        by, first = Counter(), set()
        for i, n, y in zip(*(c.tolist() for c in line_dedup._columns(line_dedup._matches([body], sim), 3)), strict=True):
            by[i] += n
            if y:
                first.add(i)
        seen.append((by, first))
    want, late = Counter(), set()
    for a in range(len(lines)):
        for b in range(a):
            x, y = set(lines[a]), set(lines[b])
            if 5 * len(x & y) >= 4 * len(x | y):
                want[a] += 1
                want[b] += 1
                late.add(a)
    for by, first in seen:
        assert {k: v for k, v in by.items() if v} == want and first == late
