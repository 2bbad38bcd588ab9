"""Personal spans, collocations and token alignment against plain definitions."""

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.llm import collocations, private_spans, queries, token_alignment

DOCS = "doc_id long, text string, lang string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    rows = [(1, "a b c d, e f g", "en"), (1, "a b c d, e f g", "en"), (2, None, "en"), (3, "", None), (None, "null id mail x@y.zz", "fr"), (None, None, None), (4, " \t\n ", "fr"), (5, long, "en"), (6, "x" * 100_000, None), (7, "漢字 é▁ \U0001f600 ೩", "und")]
    return docs(spark, rows)


CALLS = {
    "spans": lambda d: private_spans.counted(private_spans.private_spans(d)),
    "phrases": lambda d: collocations.collocations(d, least=2),
    "tokens": token_alignment.aligned_tokens,
}


@pytest.mark.parametrize("name", list(CALLS))
def test_odd_rows_and_empty_tables(spark, name):
    rows = odd(spark)
    for c in ["spans", "n_email", "phrase", "rank", "n", "chunk", "id", "f", "n_a", "n_best", "groups_sha256", "code", "__x"]:
        rows = rows.withColumn(c, F.lit("taken"))
    out = CALLS[name](rows)
    if name == "phrases":
        assert {r.lang for r in out.collect()} == {"en"}
    else:
        assert out.count() == rows.count()
    assert CALLS[name](docs(spark, [])).count() == 0


# ---- personal data ----


def by_patterns(text):
    found = {}
    for kind, p in private_spans.PATTERNS.items():
        found[kind] = [(m.end(1), m.end()) for m in re.finditer(p, text, re.ASCII) if private_spans.valid(kind, text[m.end(1) : m.end()])]
    found["address"] = [s for s in found["address"] if s not in found["email"]]
    return found


PIECES = ["a", "é", "Ü", "@", ".", "-", "+", " ", "  ", "(", ")", "0", "1", "255", "256", "4111 1111", "4111111111111111", "x.y", "://", "http://", "u:p@", "IBAN", "iban: ", "DE89370400440532013000", "account no. ", "SSN", "\n", "x@y.zz", "127.0.0.1", "+49 30", "_", "%", "東"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24).map("".join))
def test_anchored_spans_equal_patterns_over_whole_texts(text):
    assert private_spans.spans_of(text) == by_patterns(text)


def test_numbers_are_validated():
    spans = lambda t: {k: [t[s:e] for s, e in v] for k, v in private_spans.spans_of(t).items() if v}
    assert spans("pay 4111 1111 1111 1111 4111 1111 1111 1112") == {}  # one chain of 32 digits
    assert spans("pay 4111 1111 1111 1111, not 4111 1111 1111 1112") == {"card": ["4111 1111 1111 1111"]}
    assert spans("at 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5.6.7.8") == {"ip": ["10.0.0.255", "1.2.3.4", "5.6.7.8"]}
    assert spans("call +1 (017) 555-7713 or +12") == {"phone": ["+1 (017) 555-7713"]}
    assert spans("josé.garcía@correo.es") == {"email": ["a@correo.es"], "address": ["josé.garcía@correo.es"]}
    assert spans("IBAN: DE89 3704 0044 0532 0130 00 thanks") == {"iban": ["DE89 3704 0044 0532 0130 00"]}
    assert spans("IBAN: DE89 3704 0044 0532 0130 01 thanks") == {}
    assert spans("ftp://me:secret@host.example/x") == {"login": ["me:secret@"], "email": ["secret@host.example"]}
    assert "login" in spans("ftp://me:secret@host/x")
    assert spans("account number 12345678, the account of 2024") == {"account": ["12345678"]}


def test_very_long_runs_take_linear_time():
    for t in ("9" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "@a" * 150_000, "+1" * 150_000, "://a" * 80_000, "4 " * 150_000, "account " * 40_000):
        private_spans.spans_of(t)


# ---- collocations ----


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang or "und"] += len(w)
            f.update((lang or "und", w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    inside = set()
    for (lang, g), a in often.items():
        for k in range(2, len(g)):
            inside |= {(lang, g[i : i + k]) for i in range(len(g) - k + 1) if 100 * a >= 100 * f[lang, g[i : i + k]]}
    found = {}
    for (lang, g), a in often.items():
        if (lang, g) not in inside:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in found.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


@pytest.mark.parametrize("seed,least,chunk,bits,longest,few", [(1, 3, 400_000, 10, 5, 10**6), (2, 5, 300, 2, 5, 0), (3, 2, 50, 1, 4, 10**6), (4, 4, 1, 3, 2, 0)])
def test_phrases_equal_definition(spark, monkeypatch, seed, least, chunk, bits, longest, few):
    monkeypatch.setattr(collocations, "FEW_WORDS", few)
    monkeypatch.setattr(collocations, "FEW_CODES", few)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "TILE_BITS", bits)
    monkeypatch.setattr(collocations, "DENSE", 1 << bits)
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "új", "x", "A-b", "東", "o'er", "z9", "(q"]
    rows = []
    for _ in range(60):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else "New York City Hall" for _ in range(rng.randint(0, 30))]
        rows.append((0, "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for w in words), rng.choice(["en", "de", None])))
    rows += [(0, None, "en"), (0, "a a a a a a a a a a", "en")]
    got = collocations.collocations(docs(spark, rows).repartition(3), least=least, longest=longest).collect()
    assert {tuple(r) for r in got} == brute([(t, lang) for _, t, lang in rows], least, longest)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**15 + 7
    df = spark.createDataFrame([(big, big + 2, 3, 999_999_937)], "a long, n long, l long, r long")
    got = df.select(collocations.score(F.col("a"), F.col("n"), F.col("l"), F.col("r") * 10**6).alias("s")).first().s
    assert got == 1000 * big * (big + 2) // (3 * 999_999_937 * 10**6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3000)), max_size=300))
def test_tiles_equal_counting(pairs):
    left, right = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    codes, counts, number = collocations.pair_tiles(left, right)
    assert {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(n) for c, n in zip(codes, counts, strict=True)} == dict(Counter(pairs))
    assert (codes[number] == (left << 32 | right)).all() if len(pairs) else True


# ---- token alignment ----


def alignments(rows):
    """Whole texts, decoded bytes only."""
    t = token_alignment.loaded(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)
    table, out, links = Counter(), [], []
    for text in rows:
        a = t.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
            a, b = [], []
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((t.a_bytes, a), (t.b_bytes, b))]
        both = sorted(set(ends[0]) & set(ends[1]))
        cut = lambda ids, en: [",".join(map(str, ids[bisect_right(en, low) : bisect_right(en, high)])) for low, high in zip([0, *both], both, strict=False)]  # noqa: B023, E731
        groups = ";".join(map("|".join, zip(cut(a, ends[0]), cut(b, ends[1]), strict=True)))
        pairs, j0 = [], 0
        for i, e in enumerate(ends[0]):
            s = ends[0][i - 1] if i else 0
            while j0 < len(b) and ends[1][j0] <= s:
                j0 += 1
            j = j0
            while j < len(b) and (ends[1][j - 1] if j else 0) < e:
                pairs.append((a[i], b[j]))
                j += 1
        links.append(pairs)
        table.update(pairs)
        out.append((len(a), len(b), len(both), len(pairs), hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    top = {}
    for (_, b), n in table.items():
        top[b] = max(top.get(b, 0), n)
    return [(*o, sum(table[p] == top[p[1]] for p in ps), sum(table[p] for p in ps)) for o, ps in zip(out, links, strict=True)]


def rows_of(df):
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum)) for r in df.orderBy("doc_id").collect()]


TEXTS = ["", None, " ", "  ", "a", " lead", "trail ", "two  spaces", "don't can't 'tis", "漢字 かな 漢", "\U0001f600 \U0001f469‍\U0001f52c x", "é ﬁ ǅ", "tab\tnew\nline\r\n end", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "a ▁ b c", "x" * 3000, "12345 67 8,9.0", " nb sp 　 ideo", "ctrl\x00\x01\x1c \x1d y", "end para z", "ಕನ್ನಡ ೩ 𝒳𝒴", "a b c a b c a b c", "﻿bom", "q\x85r \x85 s"]


@pytest.mark.parametrize("rows,chars", [(2_000, 3_000_000), (3, 100)])
def test_alignment_equals_definition(spark, monkeypatch, rows, chars):
    monkeypatch.setattr(token_alignment, "CHUNK_ROWS", rows)
    monkeypatch.setattr(token_alignment, "CHUNK_CHARS", chars)
    rng = random.Random(5)
    letters = "ab é漢\U0001f600'▁ \n\t .9́"
    texts = [*TEXTS, *("".join(rng.choice(letters[:-3] if rng.random() < 0.9 else letters) for _ in range(rng.randint(1, 60))) for _ in range(150))]
    df = docs(spark, [(i, t, None) for i, t in enumerate(texts)]).repartition(2)
    assert rows_of(token_alignment.aligned_tokens(df)) == list(enumerate(alignments(texts)))


def test_alignment_of_the_test_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = alignments([r.text for r in rows])
    got = dict(rows_of(queries.op13_token_alignment(spark, sf)))
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_a_license_template_without_mandatory_words():
    from quillframe.llm import license_scan

    a = license_scan.compiled("x", "<<opt>>mit license<<end>>")
    assert [a.longest(w.encode().split(), 0) for w in ("mit license", "mit", "other")] == [2, None, None]
    assert license_scan.compiled("y", "").longest([b"a"], 0) is None
