"""The registered queries against DuckDB, and brute force where SQL cannot express them."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quillframe.llm import latent_leaks, queries, sharding

NAMES = list(queries.ORACLE)


def tidy(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(str([tidy(r[c]) for c in cols]) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert rows == sorted(str([tidy(r[names.index(c)]) for c in cols]) for r in result.fetchall())


def test_sharding(spark, sf):
    rows = queries.op9_feistel_shards(spark, sf).collect()
    n = len(rows)
    per = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    order = sorted(r.doc_id for r in rows)  # ids are unique here
    places = sharding.permute(np.arange(n), n, 20_240_601)
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(d, p % 24, p // 24) for d, p in zip(order, places.tolist(), strict=True)}


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 4097])
def test_permutation_and_its_inverse(n):
    places = sharding.permute(np.arange(n), n, 7)
    assert sorted(places) == list(range(n))
    assert (sharding.unpermute(places, n, 7) == np.arange(n)).all()


def test_leaks_against_containment(spark, sf):
    """Recall over all pairs whose item stands in the document as it is; nothing far from an item is reported."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    truth = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    got = {(r.doc_id, r.item_id) for r in queries.op10_latent_leaks(spark, sf).collect()}
    assert len(truth & got) >= 0.9 * len(truth)
    for d, i in got - truth:
        words = latent_leaks.tokens(items[i])
        assert latent_leaks.lcs(latent_leaks.places_of(words), len(words), latent_leaks.tokens(docs[d])) >= 0.4 * len(words)


def test_pipeline_against_its_stages(spark, sf):
    """The pipeline's rows are what the stages' own queries say, worked out by hand."""
    import corpus_pipeline

    from quillframe.llm import mixing, ngram_jaccard, quality_rules

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.host_quality(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[max(root(a), root(b))] = min(root(a), root(b))
    firsts = {d for d in ids if root(d) == d}
    assert {r.doc_id for r in ngram_jaccard.keep_one(docs.where(docs.doc_id.isin(list(kept)))).collect()} == firsts
    leaking = {r.doc_id for r in queries.op10_latent_leaks(spark, sf).collect()}
    clean = docs.where(docs.doc_id.isin(list(firsts - leaking)))
    copies = sorted(r.doc_id for r in mixing.poisson_mix(clean).collect())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == copies
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c", None, None, None), (2, "a b c", None, None, None), (3, "w " * 50_000, "en", "s", 1)]])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item of seven words or so")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out.columns)
    assert out.count() <= 10 * max(1, len(rows))


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    names = ["__d", "__h", "__key", "__id", "__x", "own", "keys", "copy", "n_copies", "rate", "shuffle_key", "k", "__bd", "__th", "kept", "n_words"]
    spark.createDataFrame([(1, "an item of seven words or so")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 9) + tuple(f"{n}{i}" for n in names) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) <= set(out.columns)
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
