"""Small cases against brute force, and the cases that must not crash: nulls, empty and very long texts, ties, repeats, clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.llm import backoff_lm, chat_format, latent_leaks, license_scan, line_dedup, mixing, ngram_jaccard, quality_rules, sharding, substring_dedup

DOCS = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls in every column, empty, blank, repeated and very long rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    return docs(spark, [(1, "a b c d e f g h i j k l", "s"), (1, "a b c d e f g h i j k l", "s"), (2, None, "s"), (3, "", None), (None, "n u l l id one two three four five six", "s"), (None, None, None), (4, " \t\n ", "t"), (5, long, "t"), (6, long, None)])


def clash(df, names):
    for n in names:
        df = df.withColumn(n, F.lit("taken"))
    return df


CALLS = {
    "license": lambda d: license_scan.license_labels(license_scan.license_spans(d)),
    "mix": mixing.poisson_mix,
    "lm": backoff_lm.backoff_scores,
    "jaccard": ngram_jaccard.jaccard_components,
    "keep_one": ngram_jaccard.keep_one,
    "quality": quality_rules.host_quality,
    "keep_good": quality_rules.keep_good,
    "repeats": substring_dedup.remove_repeats,
    "lines": line_dedup.drop_spread_lines,
    "shards": sharding.feistel_shards,
    "drop_leaking": lambda d: latent_leaks.drop_leaking(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id < 3")),
    "lm3": lambda d: backoff_lm.backoff_scores(d, order=3),
    "lm_train": lambda d: backoff_lm.backoff_scores(d, d.select("text")),
    "leaks": lambda d: latent_leaks.find_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id < 3")),
}


@pytest.mark.parametrize("name", list(CALLS))
def test_odd_rows_and_empty_tables(spark, name):
    rows = odd(spark)
    out = CALLS[name](clash(rows, ["n_words", "kept", "shard", "copy", "n_copies", "spans", "kept_text", "n_shingles", "log_score", "rate", "n_lines", "__x"]))
    if name not in ("mix", "keep_one", "keep_good", "leaks", "drop_leaking"):
        assert out.count() == rows.count()
    else:
        out.count()
    assert CALLS[name](docs(spark, [])).count() == 0


# ---- license scan ----


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("licensed under the apache license version 2 0 mit terms of released cc by sa 4 all rights reserved copyright c x".split()), max_size=25))
def test_automata_equal_regular_expressions(words):
    raw = [w.encode() for w in words]
    text = "".join(" " + w for w in words) + " "
    for label, template in (license_scan.PHRASES | license_scan.TEMPLATES).items():
        a = license_scan.compiled(label, template)
        got = [(i, a.longest(raw, i)) for i in range(len(raw)) if raw[i] in a.first_words() and a.longest(raw, i) is not None]
        starts = [i for i, m in enumerate(re.finditer(r" (?=[^ ])", text)) if re.compile(license_scan.template_regex(template) + " ").match(text, m.start())]
        assert [i for i, _ in got] == starts


def test_mandatory_words_must_match(spark):
    rows = [(1, "Licensed under the Apache License", ""), (2, "licensed under an apache license", ""), (3, "Copyright (c) 2020 Some One. All rights reserved.", ""), (4, "CC-BY 4.0", "")]
    got = {r.doc_id: (r.labels, r.score) for r in CALLS["license"](docs(spark, rows)).collect()}
    assert got == {1: ("apache-2.0", 1.0), 2: ("", 0.0), 3: ("reserved,reserved-by", 1.0), 4: ("cc-by,cc-by-4.0", 1.0)}


NOTICES = {
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n    http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}


def test_standard_notices_are_known_and_one_changed_word_is_not(spark):
    rows = [(i, t, "") for i, t in enumerate(NOTICES.values())] + [(100 + i, t.replace("software", "sofware", 1), "") for i, t in enumerate(NOTICES.values()) if "software" in t]
    got = {r.doc_id: r.labels.split(",") for r in CALLS["license"](docs(spark, rows)).collect()}
    for i, name in enumerate(NOTICES):
        assert name in got[i] and name not in got.get(100 + i, [])


# ---- mixing ----


def test_mix_reaches_the_targets_and_repeats_itself(spark):
    d = docs(spark, [(i, "t", "big" if i % 10 else "small") for i in range(6000)])
    weights = {"big": 0.5, "small": 0.5}
    a = {(r.doc_id, r.copy) for r in mixing.poisson_mix(d, weights).collect()}
    b = {(r.doc_id, r.copy) for r in mixing.poisson_mix(d.repartition(7), weights).collect()}
    assert a == b
    small = sum(1 for i, _ in a if i % 10 == 0)
    assert abs(small - 3000) < 300 and abs(len(a) - 6000) < 400


def test_large_rates_have_poisson_spread(spark):
    """Mean and variance are both the rate, below and above where the sum no longer begins at 0."""
    for rate in (350, 2000):
        d = docs(spark, [(i, "t", "a") for i in range(60)])
        mixed = mixing.poisson_mix(d, {"a": 1.0}, total=60 * rate).groupBy("doc_id").count().collect()
        n = [r["count"] for r in mixed]
        mean = sum(n) / 60
        var = sum((x - mean) ** 2 for x in n) / 59
        assert abs(mean - rate) < 5 * (rate / 60) ** 0.5 and 0.5 * rate < var < 1.8 * rate


def test_distribution_equals_definition(spark):
    import math

    for rate in (0.3, 7.0, 399.0, 401.0, 5000.0):
        first, cdf = spark.range(1).select(mixing.distribution(F.lit(rate)).alias("d")).select("d.*").first()
        for i in range(0, len(cdf), max(1, len(cdf) // 20)):
            k = first + i
            want = sum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(k + 1))
            assert abs(cdf[i] - want) < 1e-9


def test_a_null_source_is_apart_from_an_empty_one(spark):
    d = docs(spark, [(i, "t", None) for i in range(3)] + [(10 + i, "t", "") for i in range(3)] + [(20 + i, "t", "x") for i in range(6)])
    got = {r["__source"]: (r["rows"], round(r["rate"], 3)) for r in mixing.rates(d, weights={None: 1.0, "x": 1.0}).collect()}
    assert got == {"n": (3, 2.0), "s": (3, 0.0), "sx": (6, 1.0)}


# ---- language model ----


def backoff(texts, train, order, least=2):
    """Scores by definition: at each word the longest n-gram seen often enough."""
    import math

    counts, n = {}, sum(len(t.split()) for t in train)
    for t in train:
        w = t.lower().split()
        for i in range(len(w)):
            for k in range(1, order + 1):
                if i + k <= len(w):
                    counts[tuple(w[i : i + k])] = counts.get(tuple(w[i : i + k]), 0) + 1

    def word(w, i):
        for k in range(min(order, i + 1), 1, -1):
            g = tuple(w[i - k + 1 : i + 1])
            if counts.get(g, 0) >= least:
                return math.log(0.4 ** (order - k) * counts[g] / counts[g[:-1]])
        c = counts.get((w[i],), 0)
        return math.log(0.4 ** (order - 1) * (c if c >= least else 0.5) / n)

    return [sum(word(t.lower().split(), i) for i in range(len(t.split()))) for t in texts]


@pytest.mark.parametrize("order,frequent,common", [(2, 100_000, 1000), (2, 3, 2), (2, 0, 1), (3, 5, 3), (4, 100_000, 1000)])
@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("hot", [1 / 2000, 2.0])
def test_backoff_equals_definition(spark, monkeypatch, order, frequent, common, own, hot):
    """With many n-grams salted (a share of 1 / 2000 of these few rows) and with none."""
    monkeypatch.setattr(backoff_lm, "COMMON", common)
    monkeypatch.setattr(backoff_lm, "HOT_SHARE", hot)
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    texts += [texts[3], "Aa bb zzz", "qqq"]
    d = docs(spark, [(i, t, "") for i, t in enumerate(texts)] + [(3, texts[3], "")])
    train = texts + [texts[3]] if own else texts[:20]
    want = backoff(texts, train, order)
    got = backoff_lm.backoff_scores(d, None if own else d.where("doc_id < 20").dropDuplicates(), order=order, frequent=frequent).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if texts[r.doc_id]:
            assert r.n_words == len(texts[r.doc_id].split()) and abs(r.log_score - want[r.doc_id]) < 1e-8
        else:
            assert r.log_score is None and r.n_words == 0


def test_hot_ngrams_are_dealt_over_many_tasks(spark):
    """The rows of a passage that all documents share do not share a salt; other rows have none."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(["p q r"] * 99 + ["s t u"])], ["__key", "__text"])
    words = backoff_lm.Words(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    gram = backoff_lm.Texts(batch).runs(3)[:1]
    rows = pa.Table.from_batches(list(backoff_lm._exploded(iter([batch]), words, 3, False, gram))).to_pylist()
    salts = [r["salt"] for r in rows if r["gram"] == gram[0]]
    assert len(salts) == 99 and len(set(salts)) == backoff_lm.SALTS and min(salts) == 1
    assert [r["salt"] for r in rows if r["gram"] != gram[0]] == [0]


def test_documents_that_occur_twice_score_apart(spark):
    rng = random.Random(5)
    once = [" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(60)]
    d = docs(spark, [(i, t, "") for i, t in enumerate(once)] + [(100 + i, t, "") for i, t in enumerate(once[:20])])
    got = {r.doc_id: r.mean_log_score for r in backoff_lm.backoff_scores(d).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 60))


def test_own_model_moves_few_bytes_a_word(spark):
    """A chunk names a distinct n-gram once: rows for each occurrence took over 20 bytes a word for each order."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 20000}" for _ in range(200)) for _ in range(2000)]
    d = docs(spark, [(i, t, "") for i, t in enumerate(texts)]).repartition(2).cache()
    d.count()
    before = shuffled()
    assert backoff_lm.backoff_scores(d).where("n_words = 200").count() == 2000
    assert shuffled() - before < 20 * 200 * 2000


def test_chunks_hold_whole_texts(monkeypatch):
    import types

    import pyarrow as pa

    monkeypatch.setattr(backoff_lm, "CHUNK", 50)
    monkeypatch.setattr(backoff_lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(7)
    sizes = [0, 20, 30, 1, 120, 0, 49, 2, 50, 51, 0] + [rng.randrange(40) for _ in range(300)]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) or None for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["__key", "__text"])
    rows = [r for b in backoff_lm._chunked(iter([batch])) for r in b.to_pylist()]
    assert [r["chunk"] for r in rows] == [(3 << 32) + i for i in range(len(rows))]
    chunks = [backoff_lm.Chunk(r) for r in rows]
    assert np.concatenate([c.keys for c in chunks]).tolist() == list(range(len(texts)))
    assert np.concatenate([c.lengths for c in chunks]).tolist() == sizes
    assert all(r["words"] == c.lengths.sum() and (r["words"] <= 50 or (c.lengths > 0).sum() == 1) for r, c in zip(rows, chunks, strict=True))
    assert np.concatenate([c.dictionary[c.places] for c in chunks]).tolist() == backoff_lm.Texts(batch).digests.tolist()


# ---- Jaccard join ----


def components(texts, n, percent):
    sets = {}
    for d, t in texts.items():
        w = t.lower().split()
        if w:
            sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets.get(d, ())), root(d)) for d in texts}


def near_copies(seed, groups=12, size=14):
    """Groups of copies with a few words changed, chains of copies of copies, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    passage = [word() for _ in range(30)]
    out, k = {}, 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.4:
                base = text
            if rng.random() < 0.3:
                text = text + passage
            out[k] = " ".join(text)
            k += 1
    return out


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, percent):
    monkeypatch.setattr(ngram_jaccard, "HOT_LIST", 3)
    texts = near_copies(seed)
    d = docs(spark, [(i, t, "") for i, t in texts.items()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(d, n, percent).collect()}
    assert got == components(texts, n, percent)
    monkeypatch.setattr(ngram_jaccard, "PICKED_IDS", 0)
    monkeypatch.setattr(ngram_jaccard, "FEW_TOKENS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(d, n, percent).collect()}
    assert got == components(texts, n, percent)


def test_long_chain_of_links(spark):
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for k in range(12):
        base = base[1:] + [f"n{k}"]
        texts[50 - k] = " ".join(base)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs(spark, [(i, t, "") for i, t in texts.items()])).collect()}
    assert got == {i: c for i, (_, c) in components(texts, 3, 90).items()} and set(got.values()) == {39}


# ---- quality ----


def test_counts_equal_definition(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab#c|") for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\na b\na b\n\n\na b"]) for _ in range(80)]
    got = {r.doc_id: r for r in quality_rules.host_quality(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        covered = {j + x for j, g in enumerate(grams) if grams.count(g) > 1 for x in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_a_bad_host_goes_and_a_good_one_stays(spark):
    fine = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short", "bad") for i in range(90)] + [(100 + i, fine, "bad") for i in range(10)] + [(200 + i, fine, "good") for i in range(50)]
    got = {r.doc_id: r.kept for r in quality_rules.host_quality(docs(spark, rows)).collect()}
    assert not any(got[i] for i in range(110) if i in got) and all(got[200 + i] for i in range(50))


def test_prior_takes_chance_apart_from_differences(spark):
    """Hosts of five documents that all fail half the time by chance shrink to the mean; hosts that differ do not."""
    rng = random.Random(3)
    share = [sum(rng.random() < 0.5 for _ in range(5)) / 5 for _ in range(400)]
    m = sum(share) / 400
    mean, strength = quality_rules.beta_prior(m, sum((x - m) ** 2 for x in share) / 399, 0.2)
    assert strength > 10
    apart = quality_rules.beta_prior(0.5, 0.24, 0.2)[1]
    assert apart < 1 and quality_rules.beta_prior(None, None, None) == (0.0, quality_rules.PRIOR_DOCUMENTS)
    # A beta-binomial of known strength 8 gives it back.
    p = [rng.betavariate(4, 4) for _ in range(20000)]
    share = [sum(rng.random() < x for _ in range(6)) / 6 for x in p]
    m = sum(share) / len(share)
    assert 6.5 < quality_rules.beta_prior(m, sum((x - m) ** 2 for x in share) / (len(share) - 1), 1 / 6)[1] < 10


# ---- long repeats ----


def removed(texts, window):
    w = {d: t.split() for d, t in texts.items()}
    first = {}
    for d in sorted(w):
        for i in range(len(w[d]) - window + 1):
            first.setdefault(tuple(w[d][i : i + window]), d)
    out = {}
    for d, x in w.items():
        gone = set()
        for i in range(len(x) - window + 1):
            if first[tuple(x[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(v for i, v in enumerate(x) if i not in gone)
        out[d] = (len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,window,ids", [(1, 50, 10**6), (2, 24, 10**6), (3, 24, 0)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, window, ids):
    monkeypatch.setattr(substring_dedup, "PICKED_IDS", ids)
    rng = random.Random(seed)
    parts = [[rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.randrange(10, 90))] for _ in range(6)]
    texts = {}
    for d in range(40):
        words = []
        for _ in range(rng.randrange(0, 5)):
            p = list(rng.choice(parts)) if rng.random() < 0.7 else [f"u{rng.randrange(999)}" for _ in range(20)]
            cut = rng.randrange(len(p))
            words += p[cut:] if rng.random() < 0.3 else p
            if rng.random() < 0.3:
                words += ["same"] * rng.randrange(60)
        texts[d] = " ".join(words)
    cut = substring_dedup.remove_repeats(docs(spark, [(i, t, "") for i, t in texts.items()]), window)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in cut.collect()}
    assert got == removed(texts, window)


def test_null_ids_come_last(spark):
    t = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(spark, [(5, t, ""), (None, t, ""), (7, t + " x", "")])).collect()}
    assert got == {5: 0, None: 60, 7: 60}


# ---- lines ----


def test_lines_on_many_sites_go(spark):
    rows = [(i, f"own line number {i}\nshared by ten sites\nshared by nine sites" if i < 9 else f"own line number {i}\nshared by ten sites", f"s{i}") for i in range(10)]
    rows.append((99, "often on one site\n" * 40, "s0"))
    for many in (True, False):
        line_dedup.FEW_LINES = 100_000 if many else 0
        got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.drop_spread_lines(docs(spark, rows)).collect()}
        assert got[0] == (1, "own line number 0\nshared by nine sites") and got[99][0] == 0
    line_dedup.FEW_LINES = 100_000


# ---- chats ----


def test_prefixes_and_copies_collapse(spark):
    say = lambda c, n, end="": [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}{end if i == n - 1 else ''}") for i in range(n)]
    rows = say(1, 2) + say(2, 4) + say(3, 4) + say(4, 3, "other") + [(5, 0, None, None), (6, 0, "user", "<|im_end|>"), (6, 0, "user", "<|im_end|>")]
    got = {r.conv_id: r.rendered for r in chat_format.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 4, 5, 6}
    assert got[5] == "<|im_start|>unknown\n<|im_end|>\n" and got[6] == "<|im_start|>user\n<| im_end|><|im_end|>\n"
    assert chat_format.maximal_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_odd_turns(spark):
    """Rows without conversation, turn, role or text, very long and repeated turns, and columns called like results."""
    kind = "conv_id long, turn long, role string, text string, n_turns string, rendered string"
    long = "x y " * 100_000
    rows = [(None, 0, "user", "a"), (None, 1, "user", "b"), (1, None, None, None), (2, 0, "user", long), (2, 1, "assistant", ""), (3, 0, "user", long), (3, 0, "user", long), (4, 0, "user", ""), (5, 0, "user", None)]
    found = chat_format.maximal_conversations(spark.createDataFrame([(*r, "t", "t") for r in rows], kind)).collect()
    assert sorted(r.rendered for r in found if r.conv_id is None) == [f"<|im_start|>user\n{x}<|im_end|>\n" for x in "ab"]
    got = {r.conv_id: (r.n_turns, len(r.rendered)) for r in found}
    assert set(got) == {None, 1, 2, 4, 5} and got[None][0] == 1 and got[2][0] == 2 and got[2][1] > len(long) and got[4] == got[5]


# ---- sharding ----


def test_shards_are_written_in_slot_order(spark, tmp_path):
    d = docs(spark, [(i, f"text {i}", "s") for i in range(500)])
    sharding.write_shards(sharding.feistel_shards(d, 4), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 500 and sorted(p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()) == [f"shard={i}" for i in range(4)]
    slots = [r.slot for r in spark.read.parquet(str(tmp_path / "shards/shard=1")).orderBy("slot").collect()]
    assert slots == list(range(125))


# ---- leaks ----


def test_paraphrase_is_found_and_clean_text_is_not(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [[word() for _ in range(30)] for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(x) + ".") for i, x in enumerate(items)], "item_id long, text string")
    rows = []
    for i, x in enumerate(items):
        y = [w if rng.random() > 0.2 else word() for w in x]
        rows.append((i, " ".join([word() for _ in range(200)] + y + [word() for _ in range(150)]), ""))
        rows.append((100 + i, " ".join(word() for _ in range(380)), ""))
    got = {(r.doc_id, r.item_id) for r in latent_leaks.find_leaks(docs(spark, rows), bench).collect()}
    assert len({(i, i) for i in range(40)} & got) >= 36 and not any(d >= 100 for d, _ in got)


@pytest.mark.parametrize("n", [200, 1000, 5000])
def test_recall_in_benchmarks_of_every_size(spark, n):
    """More passages than latent directions, and than one pass takes: copies and paraphrases (a fifth of the words new) are found."""
    rng = random.Random(n)
    word = lambda: f"t{rng.randrange(8000)}"
    items = [[word() for _ in range(rng.randrange(12, 60))] for _ in range(n)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    held = rng.sample(range(n), 100)
    near = {i: [word() if rng.random() < 0.2 else w for w in items[i]] if k % 2 else items[i] for k, i in enumerate(held)}
    rows = [(i, " ".join([word() for _ in range(rng.randrange(80))] + x + [word() for _ in range(60)]), "") for i, x in near.items()]
    rows += [(10_000 + i, " ".join(word() for _ in range(150)), "") for i in range(100)]
    got = {(r.doc_id, r.item_id) for r in latent_leaks.find_leaks(docs(spark, rows), bench).collect()}
    assert all((i, i) in got for k, i in enumerate(held) if k % 2 == 0)
    assert sum((i, i) in got for i in held) >= 95 and not any(d >= 10_000 for d, _ in got)


@pytest.mark.parametrize("percent", [1, 5, 50])
def test_an_item_in_many_documents_is_found_in_all_of_them(spark, percent):
    rng = random.Random(percent)
    word = lambda: f"t{rng.randrange(100000)}"
    items = [[word() for _ in range(30)] for _ in range(20)]
    near = lambda: [word() if i % 6 == 5 else w for i, w in enumerate(items[0])]
    rows = [(i, " ".join([word() for _ in range(60)] + (near() if i < 4 * percent else []) + [word() for _ in range(60)]), "") for i in range(400)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in latent_leaks.find_leaks(docs(spark, rows), bench).collect())
    assert got == [(i, 0) for i in range(4 * percent)]


def test_synonyms_are_found_through_the_latent_space(spark):
    """Every rare word of an item gives way to a word of like company elsewhere in the benchmark; only common words stay."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(30)]
    frame = lambda: [rng.choice(common) for _ in range(14)]
    fill = lambda words, rare: [w for i in range(14) for w in ([words[i], rare[i]] if i < 8 else [words[i]])]
    items, rows = [], []
    for k in range(40):
        one, two, mine = [f"a{k}x{i}" for i in range(8)], [f"b{k}x{i}" for i in range(8)], frame()
        both = one[::2] + two[1::2]
        items += [fill(mine, one), fill(frame(), two), fill(frame(), both), fill(frame(), two[::2] + one[1::2])]
        rows.append((k, " ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(50)] + fill(mine, two) + [f"u{rng.randrange(10**6)}" for _ in range(50)]), ""))
    rows += [(1000 + i, " ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(120)]), "") for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.cosine for r in latent_leaks.find_leaks(docs(spark, rows), bench).collect()}
    found = [got[k, 4 * k] for k in range(40) if (k, 4 * k) in got]
    # Over all terms these cosines lie under 0.2, so only the latent space can have found them.
    assert len(found) >= 36 and min(found) >= latent_leaks.LATENT_COSINE and not any(d >= 1000 for d, _ in got)


def test_one_passage_of_a_long_item_and_both_texts_of_an_id(spark):
    """Any 64 words of a long item are a leak, wherever they begin; texts that share an id are searched for each."""
    rng = random.Random(4)
    word = lambda: f"t{rng.randrange(100000)}"
    long, one, two = [[word() for _ in range(n)] for n in (300, 30, 30)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(one)), (2, " ".join(two))], "item_id long, text string")
    around = lambda words: " ".join([word() for _ in range(90)] + words + [word() for _ in range(70)])
    rows = [(at, around(long[at : at + 64]), "") for at in range(0, 237, 59)] + [(1000, around(one), ""), (1001, around(two), ""), (1002, around([]), "")]
    got = sorted((r.doc_id, r.item_id) for r in latent_leaks.find_leaks(docs(spark, rows), bench).collect())
    assert got == [(at, 1) for at in range(0, 237, 59)] + [(1000, 2), (1001, 2)]


def test_a_decoy_does_not_hide_a_paraphrase(spark):
    """A shuffled copy has the better cosine, the paraphrase elsewhere in the text the longer common subsequence."""
    rng = random.Random(6)
    word = lambda: f"t{rng.randrange(100000)}"
    item = [word() for _ in range(20)]
    decoy = item[:16][::-1]
    near = [word() if i % 4 == 3 else w for i, w in enumerate(item)]
    filler = lambda: [word() for _ in range(300)]
    rows = [(0, " ".join(filler() + decoy + filler() + near + filler()), ""), (1, " ".join(filler() + decoy + filler()), "")]
    rows += [(2 + i, " ".join(filler()), "") for i in range(60)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.lcs_share) for r in latent_leaks.find_leaks(docs(spark, rows), bench).collect()]
    assert got == [(0, 7, 0.75)]


def test_items_of_common_words_and_items_in_many_documents(spark):
    """No item is exempt: one that half of the documents hold, one of words that nearly all hold, copied or a little changed."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(24)]
    word = lambda: f"t{rng.randrange(100000)}"
    filler = lambda n: [w for _ in range(n // 4) for w in (word(), word(), word(), rng.choice(common))]
    spread, frequent = [word() for _ in range(24)], common[:]
    near = [word() if i % 6 == 5 else w for i, w in enumerate(spread)]
    rows = [(i, " ".join(filler(200) + (spread if i < 60 else []) + filler(200)), "") for i in range(120)]
    rows += [(200, " ".join(filler(200) + frequent + filler(200)), ""), (201, " ".join(filler(200) + near + filler(200)), "")]
    bench = spark.createDataFrame([(1, " ".join(spread)), (2, " ".join(frequent))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in latent_leaks.find_leaks(docs(spark, rows), bench).collect())
    assert got == [(i, 1) for i in range(60)] + [(200, 2), (201, 1)]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert latent_leaks.lcs(latent_leaks.places_of(a), len(a), b) == table[-1][-1]


def test_bounds_pass_windows_over_and_lose_none(spark, monkeypatch):
    """What windows are near is the same as when all are multiplied, and not all of them are."""
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 5000}"
    items = [" ".join(word() for _ in range(rng.choice([6, 12, 30, 60]))) for _ in range(40)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    found = latent_leaks.passages(bench)
    index = latent_leaks.Index(found, latent_leaks.latent_basis(found, 10), 10, found.count())
    words = [word() for _ in range(6000)]
    for i, t in enumerate(items):
        words[i * 140 : i * 140 + len(t.split())] = [w if rng.random() < 0.8 else word() for w in t.split()]
    at = np.array([index.places.get(w.encode(), 0) for w in words], dtype=np.int32)
    multiplied, able = [], latent_leaks.Index._able

    def counting(starts, *args):
        for some, length in able(starts, *args):
            multiplied.append(len(some))
            yield some, length

    def near():
        return sorted((int(lo), int(hi), int(p), float(c)) for found in index._near_windows(at) for lo, hi, p, c in zip(*found, strict=True))

    monkeypatch.setattr(latent_leaks.Index, "_able", staticmethod(counting))
    got, few = near(), sum(multiplied)
    multiplied.clear()
    monkeypatch.setattr(latent_leaks, "SLACK", 10.0)  # no window is passed over
    every = near()
    assert [x[:3] for x in every] == [x[:3] for x in got] and len(got) > 40
    assert max(abs(x[3] - y[3]) for x, y in zip(every, got, strict=True)) < 1e-4
    assert few < sum(multiplied)


@pytest.mark.parametrize("seed", range(20))
def test_common_places_bound_the_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefghijkl") for _ in range(n)] for n in (rng.randrange(1, 30), rng.randrange(60)))
    places = latent_leaks.places_of(a)
    hits = [places[x] for x in b if x in places]
    assert latent_leaks.lcs(places, len(a), b) <= latent_leaks.most_common(hits) == sum((collections.Counter(a) & collections.Counter(b)).values())
