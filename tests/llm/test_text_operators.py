"""Phrases, chat formatting and token alignment against brute-force versions, on tables with odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import chat_format, phrases, token_alignment
from tessera.llm._template import Template, TemplateError, guard, guard_line, unguard, unguard_line

DOCS = "doc_id long, text string, lang string, word long, a long, n string, row long, docs int"
TURNS = "conv_id long, turn long, role string, text string, piece int, n string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_phrases(rows, least, first, inside=50):
    one, grams = defaultdict(Counter), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            one[lang].update(w)
            for k in (2, 3):
                grams[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, words in one.items():
        n, f, found = sum(words.values()), grams[lang], []
        f.update({(w,): c for w, c in words.items()})
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            if any(len(h) > len(g) and b >= least and 100 * b >= inside * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in f.items()):
                continue
            score, _, cut = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:first])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"hot": 3, "entries": 20, "part_bytes": 2000}])
def test_phrases(spark, options, monkeypatch):
    r = random.Random(5)
    vocabulary = ["the", "of", "Red", "red", "fox", "naïve", "x", "Ωmega", "y\tz"]
    rows = [(k, " ".join(r.choices(vocabulary, weights=[9, 7, 5, 3, 3, 2, 2, 1, 1], k=r.randint(0, 40))) + r.choice([".", ", the of", "\nfox red red red", "; x x x x"]), r.choice(["en", "de", None, "und"]), 1, 2, "n", 3, 4) for k in range(150)]
    rows += [(7, None, "en", 1, 1, "", 1, 1), (7, "", "fr", 1, 1, "", 1, 1), (8, "...", None, 1, 1, "", 1, 1), (None, "the of red " * 3000, "en", 1, 1, "", 1, 1), (9, ".the of", "en", 1, 1, "", 1, 1), (9, ".the of", "en", 1, 1, "", 1, 1)]
    if options:
        monkeypatch.setattr(phrases, "ROW", 50)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(map(tuple, phrases.collocations(docs, least=4, first=9, **options).collect()))
    assert got == brute_phrases([(x[2], x[1]) for x in rows], 4, 9)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, 1, "", 1, 1)], DOCS)).count() == 0


def test_escapes_come_back():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choices("<|\\n\na>im_start", k=r.randint(0, 12)))
        assert unguard(guard(t)) == t and "<|" not in guard(t)
        assert unguard_line(guard_line(t)) == t and "<|" not in guard_line(t) and "\n" not in guard_line(t)


def test_template_language():
    messages = [{"role": "user", "text": " a "}, {"role": "assistant", "text": "b"}]
    cases = {
        "{{ 1 + 2 * 3 }}{{ -(4 - 1) }}{{ 7 // 2 ~ 7 % 2 }}": "7-331",
        "{% for m in messages %}{{ loop.index0 }}{{ m.role|upper }}{{ ',' if not loop.last }}{% else %}none{% endfor %}": "0USER,1ASSISTANT",
        "{% for m in [] %}x{% else %}none{% endfor %}": "none",
        "{{ messages[0]['text']|trim }}{{ messages[-1].text }}{{ messages[1:]|length }}{{ messages[:1]|length }}": "ab11",
        "{{ messages[0].nope|default('d') }}{{ 'y' if messages[0].nope is undefined and 1 is defined }}": "dy",
        "{% if messages|length > 2 %}A{% elif 'a' in messages[0].text %}B{% else %}C{% endif %}": "B",
        "a  {%- if true -%}  b  {%- endif -%}  c{# {{ no }} #}": "abc",
        "{% set x = ['p', 'q'] %}\n{{ x|join('-') }}{{ '}}%}' }}": "p-q}}%}",
        "{{ 'x'.upper() }}{{ 'abc'.startswith('a') }}{{ 1 == 1.0 and not false or 1 / 0 }}": "Xtruetrue",
        "{{ none }}{{ 2 not in [1] }}{{ messages[0]|tojson }}": 'nonetrue{"role": "user", "text": " a "}',
    }
    for source, want in cases.items():
        assert Template(source).render(messages)[0] == want, source
    text, spans = Template("{% for m in messages %}[{% generation %}{{ m.text }}{% endgeneration %}]{% endfor %}").render(messages)
    assert [text[a:b] for a, b in spans] == [" a ", "b"]


def test_template_folds_constants():
    t = Template("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}{{ messages }}{% else %}c{% endif %}{{ 'd' if true else messages }}")
    assert [x.text for x in t.tree] == ["ab2cd"]
    assert Template("{% for m in messages %}{{ m.text }}{{ loop.last }}{% endfor %}").streams
    assert not Template("{% for m in messages %}{{ loop.length }}{% endfor %}").streams and not Template("{{ messages[0].text }}").streams


@pytest.mark.parametrize("source", ["{{ a }}", "{% if %}", "{{ messages.copy() }}", "{% for x in messages %}", "{{ 'abc }}", "{{ messages|eval }}", "{{ 1 1 }}", "{% endfor %}", "{{ __import__('os') }}"])
def test_template_refuses(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ 'x' * 3 }}", "{{ messages.__class__ }}", "{{ raise_exception('no') }}", "{{ messages + 1 }}", "{% for x in 'abc' %}{% endfor %}", "{{ 1 // 0 }}"])
def test_template_fails_in_rendering(source):
    with pytest.raises(TemplateError):
        Template(source).render([{"role": "user", "text": "a"}])


def brute_chat(rows):
    out = []
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r))), key=lambda r: r[0]):
        own = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in own if role == "assistant")
        size = sum(24 + len(guard_line(a)) + len(guard(b)) for a, b in own)
        out.append((conv, len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [chat_format.PIECE, 40])
def test_chat_comes_back(spark, piece):
    marks = ["<|im_end|>\n", "<|im_start|>assistant ok", "<\\|", "<", "|im_end|>", "\\", "é\n", " ", "\n<|im_end|>"]
    r = random.Random(9)
    rows = [(k // 5, k % 5, r.choice(["user", "assistant", "system", None, "a\nb<|im_end|>\\"]), "".join(r.choices(marks, k=r.randint(0, 5))) if k % 7 else None, 1, "n") for k in range(120)]
    rows += [(3, 2, "assistant", "x", 1, ""), (3, None, "assistant", "y", 1, ""), (None, 1, "user", "z", 1, ""), (None, 0, None, None, 1, ""), (90, 0, "assistant", "<|x " * 30000, 1, ""), *[(91, k, "user", "same", 1, "") for k in range(2000)], *[(92, 0, "assistant", "tie", 1, "")] * 3]
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    formatted = chat_format.format_conversations(table, piece=piece)
    got = sorted(map(tuple, chat_format.read_back(formatted).collect()), key=str)
    assert got == brute_chat(rows)
    if piece == 40:
        one = formatted.where("conv_id = 91").orderBy("piece").collect()
        assert len(one) > 100 and [x.piece for x in one] == list(range(len(one)))


def test_chat_masks_only_assistants(spark):
    rows = [(1, 0, "user", "q <|im_end|>", 1, ""), (1, 1, "assistant", "<|im_end|>a", 1, ""), (1, 2, "user", "r", 1, "")]
    x = chat_format.format_conversations(spark.createDataFrame(rows, TURNS)).first()
    assert [x.formatted[s.start : s.end] for s in x.loss] == ["<\\|im_end|>a"] and x.formatted.count("<|im_end|>") == 3
    assert chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], TURNS))).count() == 0
    hostile = chat_format.with_hostile(spark.createDataFrame([], TURNS))
    assert chat_format.read_back(chat_format.format_conversations(hostile)).select("conv_id", "n_turns", "loss_chars").collect() == [(-1, 2, 34)]


def both_tokenizers():
    with open(token_alignment.TOKENIZER_A, "rb") as a, open(token_alignment.TOKENIZER_B, "rb") as b:
        return token_alignment.Tokenizers(a.read(), b.read())


def brute_alignment(rows, both):
    per, counts = [], Counter()
    for i, text in rows:
        got = next(both.encode([text])) if text else None
        groups, links = [], Counter()
        if got:
            ends = [list(itertools.accumulate(int(size[x]) for x in ids)) for ids, size in zip(got, (both.a_len, both.b_len), strict=True)]
            at = [0, 0]
            for cut in sorted(set(ends[0]) & set(ends[1])):
                group = []
                for k in (0, 1):
                    to = at[k]
                    while to < len(ends[k]) and ends[k][to] <= cut:
                        to += 1
                    group.append(got[k][at[k] : to])
                    at[k] = to
                groups.append(group)
                links.update(itertools.product(*group))
        per.append((i, got or ([], []), groups, links))
        counts.update(links.keys())
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for i, (a, b), groups, links in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for k, n in links.items() if counts[k] == top[k[0]])
        out.append((i, len(a), len(b), len(groups), sum(links.values()), best, sum(n * counts[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def aligned_rows():
    texts = [None, "", " ", "\n", " a", "a ", "a  b", "a\n b \n\n c", "<|endoftext|> <s></s> <unk>", "<0x41> ▁ x", "x▁y", "naïve Ωmega 日本語 🙂🙂 é", "abababab" * 40, "0" * 300 + " " * 90 + "1", "tab\tand space wide", "word " * 3000, "aé" * 200, "Ein Wort, zwei Wörter.", "Ein Wort, zwei Wörter.", "é́ é", "🙂" * 60]
    r = random.Random(4)
    texts += ["".join(r.choices(["the ", "un", "believ", "able ", "  ", "ß", "\n", "42", "日", "."], k=r.randint(1, 200))) for _ in range(40)]
    return [(None if k == 5 else 3 if k == 6 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"short": 2, "dense": 1, "pairs_at_most": 0}])
def test_alignment(spark, aligned_rows, options):
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "n", 3, 4) for i, t in aligned_rows], DOCS).repartition(3)
    got = sorted(map(tuple, token_alignment.alignment_digests(docs, **options).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    assert got == brute_alignment(aligned_rows, both_tokenizers())


def test_alignment_of_nothing(spark):
    assert token_alignment.alignment_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_words_of_one_shape_are_aligned_once(spark):
    """Words whose tokens end at the same bytes share a shape, whatever their ids."""
    docs = spark.createDataFrame([(1, "the and for"), (2, "was not hethed, the"), (3, None)], "doc_id long, text string").coalesce(1)
    (block,) = token_alignment.tokenised(docs, "doc_id", "text", token_alignment.TOKENIZER_A, token_alignment.TOKENIZER_B).collect()
    ends = [(tuple(block.shapes[k].a_ends), tuple(block.shapes[k].b_ends)) for k in block.of]
    assert len(block.ids) == 6 and len(block.shapes) == len(set(ends)) == 2 and [len(d.words) for d in block.docs] == [3, 4, 0]
    both = both_tokenizers()
    for ids, marked, (a_ends, b_ends) in zip(block.ids, block.marked, ends, strict=True):
        a, b = [x >> 32 for x in ids[: len(a_ends)]], ids[len(a_ends) :]
        assert list(itertools.accumulate(int(both.a_len[x]) for x in a)) == list(a_ends) and list(itertools.accumulate(int(both.b_len[x]) for x in b)) == list(b_ends)
        assert marked == [y for x, end in [*((x, 2) for x in a), *((x, 3) for x in b)] for y in (10 * x + 1, 10 * x + end)]


def test_words_are_texts_tokens(spark, sf):
    """Words tokenised one by one give the tokens of the whole text."""
    both = both_tokenizers()
    words = token_alignment.Words(both)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    for t, got in zip(texts, words.numbers([t.encode() for t in texts]), strict=True):
        a, b = next(both.encode([t]))
        assert words.a.take(got, words.a.counts(got)).tolist() == list(a) and words.b.take(got, words.b.counts(got)).tolist() == list(b)


def test_line_sets_beyond_packed_numbers(monkeypatch):
    import numpy as np

    from tessera.llm import line_dedup

    r = np.random.default_rng(1)
    line, token = np.sort(r.integers(0, 50, 4000)), r.integers(0, 30, 4000).astype(np.uint64)
    want = line_dedup._sets(line, token)
    monkeypatch.setattr(line_dedup, "_PACKED", 4)
    got = line_dedup._sets(line, token)
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(set(zip(*(x.tolist() for x in got), strict=True))) == len(got[0])


def test_mixing_leaves_names_alone(spark):
    import corpus_pipeline
    from tessera.llm.mixing import mixed

    rows = [(k, f"some words {k}", f"s{k % 2}", "en", "mine", k, "dot") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, MIX_KEEP string, mix_tokens long, `a.b` string")
    assert [c for c in mixed(docs).columns if c.lower() == "mix_keep"] == ["mix_keep"] and "a.b" in mixed(docs).columns
    kept = corpus_pipeline.mixing(spark, docs, "")
    assert kept.columns == docs.columns and 0 < kept.count() <= 30
    assert all(r["MIX_KEEP"] == "mine" and r["mix_tokens"] == r["doc_id"] and r["a.b"] == "dot" for r in kept.collect())
