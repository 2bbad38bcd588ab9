"""Exact Jaccard join of word n-gram sets, reduced to components, with set-relation skipping.

Two relations between sets save work. Among the entries of an index list, sorted by size and position, only the blocks of
sizes that can still link are looked at, and each of them only up to the position from which too few n-grams follow (index
skipping). And a set that is highly similar to another one takes over that set's answers: it joins its component at once,
and from then on only pairs of sets from different components are compared (answer skipping). So a group of thousands of
near copies costs a star of comparisons, not all pairs.

Steps: one pass describes each text (set digest, size, parity bitmap, min-hash keys, prefix of n-grams). Equal sets become
one class. Classes that share a min-hash key are compared with the key's least class only; what links forms the first
components. Then the prefix index: two sets that link share an n-gram among their first s - ceil(T s / 100) + 1 in one
global order (long n-grams first, since these are rare; n-grams in very many lists last). Pairs from different components
pass a size, position and bitmap bound, all exact, before their whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, appended, beside, written
from .words import U, Prefix, mix, signed, split, word_digests

BITMAP_WORDS = 8
KEYS = 8
#: An n-gram that stands in the lists of more components than this goes to the end of the order.
HOT_LIST = 128
#: At most so many n-grams are demoted by a broadcast; with more, the limit above doubles until they fit.
HOT_MOST = 500_000
DEMOTIONS = 2
#: Up to this many n-grams are broadcast (one long each) to pick their entries.
FEW_TOKENS = 1_000_000
#: Up to this many ids a broadcast picks their texts; beyond it they are joined.
PICKED_IDS = 200_000
MAPS = [f"m{i}" for i in range(BITMAP_WORDS)]


def _ordered(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram digests of a text, sorted, and the byte length of each."""
    words = split(text, lower=True)
    if not words:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    k = min(n, len(words))
    ends = np.cumsum([len(w) for w in words])
    lengths = ends[k - 1 :] - np.append(0, ends[:-k])
    tokens, at = np.unique(Prefix(word_digests(words), 1).windows(k), return_index=True)
    return tokens, lengths[at]


def prefix_size(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def _prefix(tokens: np.ndarray, lengths: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """The first n-grams in the global order: not hot, long, small digest first."""
    late = np.isin(tokens, hot, assume_unique=True) if len(hot) else np.zeros(len(tokens), dtype=bool)
    return tokens[np.lexsort((tokens, -lengths, late))[: prefix_size(len(tokens), percent)]]


def _parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bit i tells whether an odd number of n-grams falls on i: sets with d n-grams not in common differ in at most d bits."""
    odd = np.bincount((tokens >> U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide_bits(s: int) -> int:
    return max(64 * BITMAP_WORDS, 1 << (2 * max(s, 1) - 1).bit_length())


def _smallest_linking(percent: int) -> int:
    """Sets below this size link with equal sets only."""
    return next(s for s in range(1, 10_000) if 100 * s >= percent * (s + 1))


DESCRIBED = "n_shingles long, c1 long, c2 long, keys array<long>, maps array<long>, wide binary, prefix array<long>"


def _describe(batch: pa.RecordBatch, n: int, percent: int, hot: np.ndarray) -> dict[str, pa.Array]:
    least = _smallest_linking(percent)
    seeds = mix(np.arange(1, KEYS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    rows = []
    for text in batch.column("__text").to_pylist():
        tokens, lengths = _ordered(text, n)
        c1, c2 = (int(signed(mix(mix(tokens + s)).sum(keepdims=True))[0]) for s in (seeds[0], seeds[1]))
        if len(tokens) < least:
            rows.append((len(tokens), c1, c2, None, None, None, None))
            continue
        keys = np.array([mix(tokens ^ s).min() for s in seeds], dtype=U)
        rows.append((len(tokens), c1, c2, signed(keys), _parity(tokens, 64 * BITMAP_WORDS), _parity(tokens, _wide_bits(len(tokens))).tobytes(), signed(_prefix(tokens, lengths, percent, hot))))
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary(), pa.list_(pa.int64())]
    return {f.split()[0]: pa.array([r[i] for r in rows], k) for i, (f, k) in enumerate(zip(DESCRIBED.split(", "), kinds, strict=True))}


def described_texts(rows: DataFrame, n: int, percent: int, hot=None) -> DataFrame:
    """hot: a broadcast array of n-grams that go last in the order."""
    return appended(rows, ["__text"], DESCRIBED, lambda b: _describe(b, n, percent, np.zeros(0, dtype=U) if hot is None else hot.value))


def _popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).astype(U)).sum(axis=1, dtype=np.int64)  # unsigned: the count of a negative number is another one


def _list_pairs(sizes, places, comps, maps, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list's entries, sorted by (size, place), that may link and lie in different components.

    Entries of one size are a block in order of place. An entry and one of a block share at most one n-gram more than what
    the later place leaves, so from each block only the part before a place is read, or nothing where the entry's own place
    leaves too little; what lies beyond is skipped unread.
    """
    lefts, rights = [], []
    block_sizes, starts = np.unique(sizes, return_index=True)
    ends = np.append(starts[1:], len(sizes))
    codes = sizes * (1 << 32) + places
    first_block = np.searchsorted(block_sizes, sizes)
    last_block = np.searchsorted(block_sizes, sizes * 100 // percent, side="right")
    for i in range(len(sizes) - 1):
        blocks = slice(first_block[i], last_block[i])  # of sizes that are not too large
        size = block_sizes[blocks]
        need = -(-percent * (size + sizes[i]) // (100 + percent)) - 1  # n-grams to share after this one
        open_ = need <= sizes[i] - places[i]
        size, need = size[open_], need[open_]
        lo = np.maximum(starts[blocks][open_], i + 1)
        hi = np.minimum(np.searchsorted(codes, size * (1 << 32) + np.maximum(size - need, -1), side="right"), ends[blocks][open_])
        n = np.maximum(hi - lo, 0)
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        at = at[comps[at] != comps[i]]
        if len(at):
            both = sizes[at] + sizes[i]
            at = at[_popcounts(maps[at], maps[i]) * (100 + percent) <= both * (100 - percent)]
            lefts.append(np.full(len(at), i))
            rights.append(at)
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (np.zeros(0, int), np.zeros(0, int))


def _candidates(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Entries come sorted by (token, size, place); a list that goes on in the next batch is carried over."""
    rest = None

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, ids = pdf["token"].to_numpy(), pdf["cid"].to_numpy()
        sizes, places, comps = (pdf[c].to_numpy() for c in ("n_shingles", "place", "comp"))
        maps = pdf[MAPS].to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])), len(tokens))
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            i, j = _list_pairs(sizes[lo:hi], places[lo:hi], comps[lo:hi], maps[lo:hi], percent)
            a.append(ids[lo + i])
            b.append(ids[lo + j])
        out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
        return pd.DataFrame({"a": out.min(axis=1), "b": out.max(axis=1)}).drop_duplicates()

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf])
        last = pdf["token"].to_numpy() == pdf["token"].iloc[-1]
        rest, ready = pdf[last], pdf[~last]
        if len(ready):
            yield pairs(ready)
    if rest is not None and len(rest):
        yield pairs(rest)


def _bounded(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs whose wide bitmaps still allow a link; the larger bitmap folds to the size of the smaller one."""
    for pdf in batches:
        keep = np.zeros(len(pdf), dtype=bool)
        for r, (wa, wb, na, nb) in enumerate(zip(pdf["wa"], pdf["wb"], pdf["na"], pdf["nb"], strict=True)):
            x, y = np.frombuffer(wa, np.uint8), np.frombuffer(wb, np.uint8)
            size = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
            keep[r] = int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (100 + percent) <= (na + nb) * (100 - percent)
        yield pdf.loc[keep, ["a", "b"]]


def _sets(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["__key"], "set": [_ordered(t, n)[0].tobytes() for t in pdf["__text"]]})


def _linked(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = np.zeros(len(pdf), dtype=bool)
        for r, (sa, sb) in enumerate(zip(pdf["sa"], pdf["sb"], strict=True)):
            x, y = np.frombuffer(sa, U), np.frombuffer(sb, U)
            common = len(x) + len(y) - len(np.union1d(x, y))
            keep[r] = 100 * common >= percent * (len(x) + len(y) - common)
        yield pdf.loc[keep, ["a", "b"]]


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids asked for."""
    few = ids.count() <= PICKED_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["__key"] == ids["id"], "left_semi")


def verified(pairs: DataFrame, described: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets link: first the bitmaps' bound, then the sets."""
    sizes = described.select("cid", "n_shingles", "wide")
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("cid").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("wide").alias(f"w{side}")), side)
    able = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    near = scratch.write(pairs.where(able).mapInPandas(lambda it: _bounded(it, percent), "a long, b long").distinct(), "near")
    ids = scratch.write(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "ids")
    sets = scratch.write(_texts_of(docs, ids).mapInPandas(lambda it: _sets(it, n), "id long, set binary"), "sets")
    for side in "ab":
        near = near.join(sets.select(F.col("id").alias(side), F.col("set").alias(f"s{side}")), side)
    return scratch.write(near.mapInPandas(lambda it: _linked(it, percent), "a long, b long").distinct(), "links")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (its component's least node) for every node of the links (a, b): least labels with pointer jumping."""
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "both-ways")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("__b")).select("node", F.least("node", "__b").alias("comp")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        fresh = scratch.write(lower.join(jump, "comp", "left").select("node", "old", F.coalesce("next", "comp").alias("comp")), "labels")
        labels = fresh.select("node", "comp")
        if fresh.where("old <> comp").isEmpty():
            return labels


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents whose word n-gram sets have a Jaccard similarity of at least percent / 100.

    Words are lower-cased (A-Z) runs between blanks; a text of fewer than n words is one n-gram; null or empty texts have
    none and stand alone. Returns one row for each input row: the id, __th (digest of the text), n_shingles, component_id
    (least id reachable by links, the document's own included) and stays (true for one node of each component: the one with
    the least id). Other columns are not looked at. Rows that share an id but not the text are nodes of their own. Rows with
    a null id take part; component_id is null when no document of the component has an id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    narrow = docs.select(ident.alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__th"), text.alias("__text"))
    narrow = narrow.withColumn("__key", F.coalesce("__id", "__th"))
    described = scratch.write(described_texts(narrow, n, percent), "described")
    several = scratch.write(described.where("__id is not null").groupBy("__id").agg(F.min("__th").alias("x"), F.max("__th").alias("y")).where("x <> y").select("__id"), "several")
    if not several.isEmpty():  # an id with several texts: its rows go by their texts
        flagged = several.withColumn("__many", F.lit(True))
        narrow, described = (
            d.join(flagged, "__id", "left").withColumn("__key", F.when(F.col("__many"), F.col("__th")).otherwise(F.col("__key"))).drop("__many") for d in (narrow, described)
        )

    # Classes: equal sets; empty ones stay apart. firsts: one row for each class of sets that can link with others.
    plain = F.when(F.col("__key") == F.col("__id"), F.col("__id"))
    classes = described.where("n_shingles > 0").groupBy("c1", "c2").agg(F.coalesce(F.min(plain), F.min("__key")).alias("cid"), F.min("__id").alias("least_id"))
    classes = scratch.write(classes, "classes")
    linking = described.where("keys is not null")
    others = scratch.write(linking.select("__key", "c1", "c2").join(classes, ["c1", "c2"]).where("__key <> cid").select("__key").distinct(), "others")
    firsts = linking.join(F.broadcast(others) if others.count() <= PICKED_IDS else others, "__key", "left_anti")
    firsts = firsts.select(F.col("__key").alias("cid"), "n_shingles", "keys", "wide", "prefix", *[F.get("maps", i).alias(m) for i, m in enumerate(MAPS)])
    if not firsts.groupBy("cid").count().where("count > 1").isEmpty():
        firsts = scratch.write(firsts.dropDuplicates(["cid"]), "firsts")

    # Stars: each class with the least class of each of its keys.
    keyed = firsts.select("cid", F.explode("keys").alias("key"))
    stars = keyed.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("__most")).where("a < __most").select("key", "a")
    stars = keyed.join(stars, "key").where("a < cid").select("a", F.col("cid").alias("b")).distinct()
    links = verified(stars, firsts, narrow, n, percent, scratch)
    first_comps = components(links, scratch).withColumnRenamed("node", "cid")
    first_comps = F.broadcast(first_comps) if first_comps.count() <= PICKED_IDS else first_comps

    # The prefix index. N-grams in the lists of more than HOT_LIST components go last in the order.
    index = firsts.select("cid", "n_shingles", "prefix").join(first_comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    hot, most = np.zeros(0, dtype=U), HOT_LIST
    lists = scratch.write(_lists(index), "lists")
    for _ in range(DEMOTIONS):
        large = lists.where(F.col("n") > most).select("token")
        spread = _entries(index).join(_few(large, FEW_TOKENS), "token").select("token", "comp").distinct().groupBy("token").count().where(F.col("count") > most)
        spread = scratch.write(spread, "hot-lists")
        while (count := spread.where(F.col("count") > most).count()) + len(hot) > HOT_MOST:
            most *= 2
        if not count:
            break
        fresh = spread.where(F.col("count") > most).select("token")
        hot = np.union1d(hot, fresh.toPandas()["token"].to_numpy().view(U))
        shared = spark.sparkContext.broadcast(hot)
        touched = scratch.write(_entries(index).join(_few(fresh, FEW_TOKENS), "token", "left_semi").select(F.col("cid").alias("id")).distinct(), "touched")
        again = described_texts(_texts_of(narrow, touched), n, percent, shared).where("keys is not null")
        again = scratch.write(again.select(F.col("__key").alias("cid"), "n_shingles", "prefix").dropDuplicates(["cid"]), "again")
        again = again.join(first_comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        index = index.join(_few(touched.withColumnRenamed("id", "cid"), PICKED_IDS), "cid", "left_anti").unionByName(again)
        lists = scratch.write(_lists(index), "lists")
    listed = scratch.write(_entries(index).join(_few(lists.where("mixed").select("token"), FEW_TOKENS), "token"), "entries").join(firsts.select("cid", *MAPS), "cid")
    dealt = listed.repartition("token").sortWithinPartitions("token", "n_shingles", "place")
    pairs = scratch.write(dealt.mapInPandas(lambda it: _candidates(it, percent), "a long, b long").distinct(), "pairs")
    final = components(links.union(verified(pairs, firsts, narrow, n, percent, scratch)), scratch)

    # A component's id is its least document id; rows take it from their class.
    members = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    members = scratch.write(members.select("c1", "c2", "cid", "comp", "least_id"), "members")
    least = members.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.min(F.struct(F.col("least_id").isNull(), "least_id", "cid"))["cid"].alias("first_cid"))
    by_class = members.join(least, "comp").select("c1", "c2", "component_id", "first_cid")
    out = described.select("__id", "__th", "__key", "n_shingles", "c1", "c2").join(by_class, ["c1", "c2"], "left")
    empty = F.col("n_shingles") == 0
    out = out.select(
        F.col("__id").alias(id_col), "__th", "n_shingles", F.when(empty, F.col("__id")).otherwise(F.col("component_id")).alias("component_id"),
        (empty | (F.col("__key") == F.col("first_cid"))).alias("stays"),
    )
    return scratch.result(out, "components")


def _few(keys: DataFrame, most: int) -> DataFrame:
    """A table of keys, to be broadcast when it is counted and small."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _lists(index: DataFrame) -> DataFrame:
    """token, n, mixed (entries of several components) for every n-gram with two entries or more."""
    lists = _entries(index).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("__a"), F.max("comp").alias("__b"))
    return lists.where("n > 1").select("token", "n", (F.col("__a") < F.col("__b")).alias("mixed"))


def _entries(index: DataFrame) -> DataFrame:
    return index.select("cid", "comp", "n_shingles", F.posexplode("prefix").alias("place", "token"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id. Rows with the same id and text count once.

    Documents without words stay. All input columns stay as they are, whatever their names; an empty table gives no rows.
    """
    judged = jaccard_components(docs, n, percent, id_col, text_col).select(F.col(id_col).alias("__id"), "__th", "stays")
    again = not judged.groupBy("__id", "__th").count().where("count > 1").isEmpty()
    go = judged.where("not stays").select("__id", "__th").distinct()
    few = go.count() <= PICKED_IDS
    held = beside(docs, {"__d": F.col(f"`{id_col}`").cast("long"), "__h": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    out = held.join(F.broadcast(go) if few else go, F.col("keys.__d").eqNullSafe(F.col("__id")) & (F.col("keys.__h") == F.col("__th")), "left_anti")
    return (out.dropDuplicates(["keys"]) if again else out).select("own.*")
