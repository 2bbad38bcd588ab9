"""Stupid-backoff language-model scores, computed relationally.

A word after some others scores the count of the longest n-gram that ends with it and was seen, over the count of that
n-gram without the word; each shorter n-gram costs a factor ALPHA. Seen means LEAST occurrences or more: the texts that are
scored train the model too, so that every n-gram occurs once for certain.

Documents that train their own model go in chunks. A chunk keeps its words as numbers and names each distinct n-gram once, with
its count: rows of one range of digests meet in a group, which adds the counts up and answers each chunk, for an n-gram that
is seen, with the count of the whole corpus. An n-gram of three words or more is asked for only where both n-grams of a word
less are seen, since no n-gram is more frequent than its parts. An n-gram has one entry a chunk however often it stands there,
so none is hot. A chunk's answers meet its words in a cogroup, which gives each word its value and each document its sum.

What follows holds for a model that another table trains.

In logarithms, the score of a document is a sum over its words of what the words alone are worth, plus, for every seen
n-gram of two words or more that it holds, the gain over the n-gram without its first word. So there is one table of values
for each order. Documents are exploded to n-grams, dealt by hash; the count table of an order is an aggregate over that
exchange, is given its values by joins with the table of the order below, and is joined to the same exchange again; the
values are summed by document.

Very frequent n-grams would make hot keys: the counts of up to FREQUENT words and of all pairs of the COMMON most frequent
words are added up inside the tasks and broadcast, which changes no score. Other n-grams that a sample of documents shows to
be hot (a passage that many documents share) are dealt over SALTS tasks, counted in two steps and answered on each of them;
the sample decides on places only, so that it changes no score either.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, written
from .words import U, Prefix, signed, split, word_digests

ALPHA = 0.4
ORDER = 3
#: Rarer words and n-grams count as unseen; an unseen word counts as seen half a time.
LEAST = 2
UNSEEN = 0.5
#: Words whose counts are broadcast, and words of the square table of pairs: bounds, whatever the corpus.
FREQUENT = 400_000
COMMON = 1000
#: Texts whose words are taken up together.
SLICE = 200
#: In place of the second word of a pair: a word by itself.
ALONE = -(1 << 62)
#: An n-gram with this share of its sample's rows is hot; about so many documents are sampled for it.
HOT_SHARE = 1 / 2000
HOT_SAMPLE = 2000
SALTS = 32
#: More than the places of frequent words.
PLACES = 1 << 20
#: Words of a chunk (a longer text is a chunk of its own), and of the texts of one range of digests; small corpora have so many ranges.
CHUNK = 2_000_000
RANGE = 2_000_000
RANGES, LEAST_RANGE = 64, 100_000
CHUNKS = "chunk long, words long, keys binary, lengths binary, dictionary binary, places binary"
ASKED = "chunk long, k int, part int, grams binary, counts binary"
ANSWERS = "chunk long, k int, part int, counts binary"


class Words:
    """Values of the frequent words, and which of them are common (their rank, else -1)."""

    def __init__(self, words: np.ndarray, values: np.ndarray, common: np.ndarray):
        self.words, self.values, self.side = words, values, COMMON
        self.rank = np.full(len(words) + 1, -1, dtype=np.int64)  # the last one for words outside the table
        self.rank[common] = np.arange(len(common))

    def of(self, digests: np.ndarray) -> np.ndarray:
        """Places in the table, -1 for other words."""
        if not len(self.words):
            return np.full(len(digests), -1)
        at = np.minimum(np.searchsorted(self.words, digests), len(self.words) - 1)
        return np.where(self.words[at] == digests, at, -1)

    def cells(self, at: np.ndarray) -> np.ndarray:
        """Of the pairs of neighbours: their cell of the square table, -1 unless both words are common."""
        rank = self.rank[at]
        return np.where((rank[:-1] >= 0) & (rank[1:] >= 0), rank[:-1] * self.side + rank[1:], -1)


class Texts:
    """The words of a slice of texts in one row: their digests and the text that each belongs to."""

    def __init__(self, batch: pa.RecordBatch):
        lists = [split(t, lower=True) for t in batch.column("__text").to_pylist()]
        self.lengths = np.array([len(x) for x in lists], dtype=np.int64)
        self.digests = signed(word_digests(list(itertools.chain.from_iterable(lists))))
        self.owner = np.repeat(np.arange(len(lists)), self.lengths)

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each one on belong to one text."""
        return self.owner[: max(0, len(self.owner) - k + 1)] == self.owner[k - 1 :]

    def runs(self, k: int) -> np.ndarray:
        """Digests of the k words from each one on."""
        return signed(Prefix(self.digests.view(U), 1).windows(k)) if len(self.digests) >= k else np.zeros(0, np.int64)


def _counted(values: np.ndarray, name: str) -> pa.RecordBatch:
    keys, n = np.unique(values, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], [name, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, SLICE):
        yield _counted(Texts(b).digests, "word")


def _count_cells(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, SLICE):
        t = Texts(b)
        cells = words.cells(words.of(t.digests))
        yield _counted(cells[t.inside(2) & (cells >= 0)], "cell")


def _totals(batches: Iterator[pa.RecordBatch], words: Words, gains: np.ndarray, unseen: float) -> Iterator[pa.RecordBatch]:
    """A row for each text: its number of words and its value as far as the broadcast tables tell; other words count as unseen here."""
    for b in sliced(batches, SLICE):
        t = Texts(b)
        at = words.of(t.digests)
        sums = np.bincount(t.owner, weights=np.where(at >= 0, np.append(words.values, unseen)[at], unseen), minlength=len(b)).astype(np.float64)
        cells = words.cells(at)
        pick = t.inside(2) & (cells >= 0)
        sums += np.bincount(t.owner[:-1][pick], weights=gains[cells[pick]], minlength=len(b)) if pick.any() else 0.0
        ones = np.ones(len(b), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([b.column("__key"), pa.array(sums, pa.float64()), pa.array(ones), pa.array(t.lengths)], ["__key", "s", "copies", "n"])


def _exploded(batches: Iterator[pa.RecordBatch], words: Words, k: int, frequent: bool, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each occurrence of a k-gram: its first and its last k - 1 words, its own digest, the text's key and a salt.

    The salt is 1 to SALTS in turn for the hot (sorted digests), 0 for others.

    Pairs come in two lots, without those of the square table: frequent, both words by their places in one number (head),
    and all others, with the words outside the broadcast table by themselves (tail: ALONE).
    """
    for b in sliced(batches, SLICE):
        t = Texts(b)
        pick, own = t.inside(k), t.runs(k)
        if k == 2:
            at = words.of(t.digests)
            shorter = np.where(at >= 0, at, t.digests)
            both = (at[:-1] >= 0) & (at[1:] >= 0)
            pick &= both & (words.cells(at) < 0) if frequent else ~both
        else:
            shorter = t.runs(k - 1)
        head, tail, gram, owner = shorter[:-1][pick], shorter[1:][pick], own[pick], t.owner[: len(pick)][pick]
        if k == 2 and frequent:
            head = head * PLACES + tail
        elif k == 2:
            alone = at < 0
            head, gram = np.append(head, t.digests[alone]), np.append(gram, np.zeros(alone.sum(), np.int64))
            tail, owner = np.append(tail, np.full(alone.sum(), ALONE)), np.append(owner, t.owner[alone])
            order = np.argsort(owner, kind="stable")  # a text's rows together: keys that repeat travel well
            head, tail, gram, owner = head[order], tail[order], gram[order], owner[order]
        keys = b.column("__key").to_numpy()[owner]
        salt = np.where(np.isin(gram, hot), np.arange(len(gram)) % SALTS + 1, 0) if len(hot) else np.zeros(len(gram), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (head, tail, gram, keys, salt)], ["head", "tail", "gram", "__key", "salt"])


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as compressed planes of the bytes that the greatest needs."""
    x = np.ascontiguousarray(x).view(U)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), raw[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(raw[9:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.int64)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of texts: their keys and lengths, the distinct words' digests (frequent ones first) and each word's place among them."""
    number = TaskContext.get().partitionId() << 32
    keys, lengths, digests, held = [], [], [], 0

    def chunk() -> pa.RecordBatch:
        nonlocal keys, lengths, digests, held, number
        words, at, n = np.unique(np.concatenate(digests), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = [number, held, np.concatenate(keys).tobytes(), _packed(np.concatenate(lengths)), words[order].tobytes(), _packed(rank[at])]
        keys, lengths, digests, held, number = [], [], [], 0, number + 1
        return pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in CHUNKS.split(", ")), row, strict=True))], SCHEMAS["chunks"])

    for b in sliced(batches, SLICE):
        t, own, start = Texts(b), b.column("__key").to_numpy(), 0
        ends = np.cumsum(t.lengths)
        while start < len(b):
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + CHUNK - held, "right"))
            if stop == start and not held:  # a text longer than a chunk
                stop += 1
            if stop > start:
                keys.append(own[start:stop])
                lengths.append(t.lengths[start:stop])
                digests.append(t.digests[before : int(ends[stop - 1])])
                held += int(ends[stop - 1]) - before
                start = stop
            if start < len(b):
                yield chunk()
    if keys:
        yield chunk()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


SCORED = "__key long, log_score double, n_words long"
SCHEMAS = {"chunks": _schema(CHUNKS), "asked": _schema(ASKED), "answers": _schema(ANSWERS), "scored": _schema(SCORED)}


def _begin(part: int, ranges: int) -> U:
    """The least digest of a range."""
    return U(-(-(part << 32) // ranges) << 32)


class Chunk:
    """The words of a chunk, and the counts of its n-grams as far as they are answered (0: not seen)."""

    def __init__(self, row: dict, answers: pa.Table | None = None):
        self.id, self.keys, self.lengths = row["chunk"], np.frombuffer(row["keys"], np.int64), _unpacked(row["lengths"])
        self.dictionary, self.places = np.frombuffer(row["dictionary"], np.int64), _unpacked(row["places"])
        self.owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.prefix = Prefix(self.dictionary[self.places].view(U), 1)
        self.counts: list[np.ndarray] = []
        lists: dict[int, list] = {}
        if answers is not None:
            for r in sorted(answers.to_pylist(), key=lambda r: (r["k"], r["part"])):
                lists.setdefault(r["k"], []).append(_unpacked(r["counts"]))
        for k in range(1, len(lists) + 1):
            n = np.concatenate(lists[k])
            if k == 1:
                of_word = np.empty(len(n), np.int64)
                of_word[np.argsort(self.dictionary.view(U), kind="stable")] = n
                self.counts.append(of_word[self.places])
            else:
                pick, grams = self.grams(k)
                own = np.zeros(max(0, len(self.places) - k + 1), np.int64)
                own[pick] = n[np.unique(grams, return_inverse=True)[1]]
                self.counts.append(own)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of k words that may be seen begin, and their digests."""
        if len(self.places) < k or k > 2 and len(self.counts) < k - 1:
            return np.zeros(0, np.int64), np.zeros(0, U)
        may = self.owner[: len(self.owner) - k + 1] == self.owner[k - 1 :]
        if k > 2:
            below = self.counts[k - 2] > 0
            may &= below[:-1] & below[1:]
        pick = np.flatnonzero(may)
        return pick, self.prefix.windows(k)[pick]

    def asked(self, k: int, ranges: int) -> Iterator[pa.RecordBatch]:
        """A row for each range that has distinct n-grams of k words: their digests in order, as differences from the one before (the first from the range's begin), and their counts here."""
        if k == 1:
            order = np.argsort(self.dictionary.view(U), kind="stable")
            grams, n = self.dictionary.view(U)[order], np.bincount(self.places, minlength=len(self.dictionary))[order]
        else:
            grams, n = np.unique(self.grams(k)[1], return_counts=True)
        ends = np.searchsorted((grams >> U(32)) * U(ranges) >> U(32), np.arange(ranges + 1, dtype=U))
        rows = [
            {"chunk": self.id, "k": k, "part": i, "grams": _packed(np.diff(grams[lo:hi], prepend=_begin(i, ranges))), "counts": _packed(n[lo:hi])}
            for i, (lo, hi) in enumerate(itertools.pairwise(ends.tolist())) if lo < hi
        ]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMAS["asked"])

    def scored(self, order: int, total: int) -> pa.Table:
        """A row for each text: the sum of its words' values."""
        seen = self.counts[0] if self.counts else np.zeros(0, np.int64)
        value = np.log(ALPHA ** (order - 1) * np.where(seen > 0, seen, UNSEEN) / max(total, 1))
        for k in range(2, len(self.counts) + 1):
            at = np.flatnonzero(self.counts[k - 1])
            value[at + k - 1] = np.log(ALPHA ** (order - k) * self.counts[k - 1][at] / self.counts[k - 2][at])
        sums = np.bincount(self.owner, weights=value, minlength=len(self.keys)).astype(np.float64)
        return pa.Table.from_arrays([pa.array(self.keys), pa.array(sums), pa.array(self.lengths)], schema=SCHEMAS["scored"])


def _answered(rows: pa.Table, least: int, ranges: int) -> pa.Table:
    """For each chunk the counts that its n-grams of one range have in all of them, 0 below least."""
    begin = _begin(rows.column("part")[0].as_py(), ranges)
    grams = [begin + np.cumsum(_unpacked(x).view(U), dtype=U) for x in rows.column("grams").to_pylist()]
    n = np.concatenate([_unpacked(x) for x in rows.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, weights=n).astype(np.int64)
    found = np.where(total >= least, total, 0)[at]
    parts = np.split(found, np.cumsum([len(g) for g in grams])[:-1])
    own = rows.select(["chunk", "k", "part"])
    return pa.Table.from_arrays([*own.columns, pa.array([_packed(p) for p in parts], pa.binary())], schema=SCHEMAS["answers"])


def _chunk_scores(texts: DataFrame, order: int, least: int) -> tuple[DataFrame, int]:
    """__key, log_score and n_words of texts that train their own model, and the number of all words."""
    chunks = written(texts.mapInArrow(_chunked, CHUNKS), "chunks")
    total = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    ranges = max(-(-total // RANGE), min(RANGES, -(-total // LEAST_RANGE)), 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                for k in range(1, min(order, 2) + 1):
                    yield from c.asked(k, ranges)

    def counted(asked: DataFrame) -> DataFrame:
        return asked.groupBy("k", "part").applyInArrow(lambda rows: _answered(rows, least, ranges), ANSWERS)

    def met(answers: DataFrame, made, fields: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda own, found: made(Chunk(own.to_pylist()[0], found)), fields)

    answers = written(counted(chunks.mapInArrow(first, ASKED)), "answers")
    for k in range(3, order + 1):
        more = met(answers, lambda c, k=k: pa.Table.from_batches(c.asked(k, ranges), SCHEMAS["asked"]), ASKED)
        answers = answers.unionByName(written(counted(more), "answers"))
    scores = met(answers, lambda c: c.scored(order, total), SCORED)
    return scores.groupBy("__key").agg(F.max("log_score").alias("log_score"), F.max("n_words").alias("n_words")), total


def _word_value(n: Column, total: int, order: int) -> Column:
    return F.log(F.lit(ALPHA ** (order - 1) / max(total, 1)) * n)


def frequent_bin(counts: DataFrame, most: int = FREQUENT) -> int:
    """Words of this bin of counts (eighths of powers of two) and above are the frequent ones, as many as fit the bound."""
    histogram = sorted((r["b"], r["w"]) for r in counts.groupBy(_bin("n").alias("b")).agg(F.count(F.lit(1)).alias("w")).collect())
    least, held = 1 << 30, 0
    for b, w in reversed(histogram):
        if held + w > most:
            break
        least, held = b, held + w
    return least


def _bin(n: str) -> Column:
    return F.floor(8 * F.log2(n)).cast("int")


def backoff_scores(docs: DataFrame, train: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", order: int = ORDER, least: int = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """docs (without the text) with n_words, log_score and mean_log_score (natural logarithms) under the model of train (docs itself by default).

    Words are lower-cased runs between blanks. Input columns of the results' names are replaced. Null and empty texts have
    no words and null scores; without any training word all scores are null. Repeated rows get the same scores; a row is
    known by its id (which may be null or missing) and text. Very long texts are scored whole. An empty table gives no rows.
    """
    results = ("n_words", "log_score", "mean_log_score")
    cols = [c for c in docs.columns if c != text_col and c.lower() not in results]
    text = F.col(f"`{text_col}`")
    ident = F.col(f"`{id_col}`").cast("string") if id_col in docs.columns else F.lit("")
    keyed = docs.select(*[F.col(f"`{c}`") for c in cols], F.xxhash64(F.coalesce(ident, F.lit("")), F.coalesce(text, F.lit(""))).alias("__key"), text.alias("__text"))
    texts = keyed.select("__key", "__text")
    if train is None:
        sums, total = _chunk_scores(texts, order, least)
        return _finished(keyed, sums, cols, total)
    learnt = train.select(F.lit(0).cast("long").alias("__key"), text.alias("__text"))

    every = written(learnt.select("__text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = every.where(F.col("n") >= least)
    values = counts.select("word", "n", _word_value(F.col("n"), total, order).alias("value"))
    least_bin = frequent_bin(values, frequent)
    table = values.where(_bin("n") >= least_bin).toArrow().sort_by("word")
    known = {c: table[c].to_numpy() for c in ("word", "n", "value")}
    common = np.sort(np.argsort(-known["n"], kind="stable")[:COMMON])
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(Words(known["word"], known["value"], common))

    # The square of the common words: at most COMMON * COMMON sums come to the driver.
    cells = np.zeros(COMMON * COMMON)
    if order >= 2:
        pairs = learnt.mapInArrow(lambda it: _count_cells(it, words.value), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
        cell, n = pairs["cell"].to_numpy(), pairs["n"].to_numpy()
        if len(cell):
            cells[cell] = np.log(ALPHA ** (order - 2) * n / known["n"][common][cell // COMMON]) - known["value"][common][cell % COMMON]
    square = spark.sparkContext.broadcast(cells)

    unseen = float(np.log(ALPHA ** (order - 1) * UNSEEN / max(total, 1)))
    parts = [texts.mapInArrow(lambda it: _totals(it, words.value, square.value, unseen), "__key long, s double, copies long, n long")]
    none = F.lit(0).cast("long")
    others = values.where(_bin("n") < least_bin)
    alone = others.select(F.col("word").alias("head"), F.lit(ALONE).alias("tail"), (F.col("value") - unseen).alias("gain"), F.lit(False).alias("hot"))

    # below: gram, n and value of every seen n-gram of the order below; frequent words go by their places.
    table = values_table(spark, known)
    places = table.select(F.col("place").alias("gram"), "n", "value")
    below = others.select(F.col("word").alias("gram"), "n", "value").unionByName(places)
    fields = T.StructType([T.StructField(c, T.LongType(), False) for c in ("head", "tail", "gram", "__key", "salt")])
    nothing = np.zeros(0, np.int64)
    every_so_many = {id(t): max(1, t.count() // HOT_SAMPLE) for t in (texts, learnt)}

    def exploded(rows: DataFrame, k: int, frequent: bool, hot: np.ndarray) -> DataFrame:
        return rows.mapInArrow(lambda it: _exploded(it, words.value, k, frequent, hot), fields)

    def hot_grams(k: int, frequent: bool) -> np.ndarray:
        """Sorted digests, at most 1 / HOT_SHARE for each of the two texts' tables."""
        found = [nothing]
        for t in (texts, learnt):
            few = t.where(F.pmod(F.xxhash64("__key", "__text"), F.lit(every_so_many[id(t)])) == 0)
            grams = exploded(few, k, frequent, nothing).where(F.col("tail") != ALONE).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            rows = written(grams, "sampled-ngrams")
            all_rows = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            found.append(rows.where((F.col("n") > 1) & (F.col("n") >= HOT_SHARE * all_rows)).select("gram").toArrow()["gram"].to_numpy())
        return np.unique(np.concatenate(found))

    def dealt(rows: DataFrame, k: int, frequent: bool, hot: np.ndarray) -> DataFrame:
        # The top order's own digests are not needed, so they stay out of the exchange; so does the salt where nothing is hot.
        by = keys_of(frequent, hot)
        return exploded(rows, k, frequent, hot).select(*by, *(["gram"] if k < order else []), "__key").repartition(*by)

    def keys_of(frequent: bool, hot: np.ndarray) -> list[str]:
        return (["head"] if frequent else ["head", "tail"]) + (["salt"] if len(hot) else [])

    def counted(rows: DataFrame, asked: DataFrame, k: int, frequent: bool, hot: np.ndarray) -> DataFrame:
        """One row for each seen n-gram: its key columns, n, gram (below the top order) and whether it is hot."""
        # Both uses of an exchange read the same rows and columns, so that Spark runs it once: the count looks at the keys too
        # (any key passes), and conditions on the tail and the salt are bound to the count and so not pushed below the exchange.
        own = [F.min("gram").alias("gram")] if k < order else []
        by = ["head"] if frequent else ["head", "tail"]
        seen = dealt(rows, k, frequent, hot).groupBy(*keys_of(frequent, hot)).agg(F.count(F.lit(1)).alias("n"), F.max("__key").alias("__most"), *own)
        n = F.col("n") if frequent else F.when(F.col("tail") != ALONE, F.col("n")).otherwise(0)
        any_key = F.col("__most") >= -(1 << 63)
        if not len(hot):
            return seen.where((n >= least) & any_key).withColumn("hot", F.lit(False))
        cold = seen.where((F.when(F.col("salt") == 0, n).otherwise(0) >= least) & any_key).withColumn("hot", F.lit(False))
        salted = seen.where((F.when(F.col("salt") > 0, n).otherwise(0) >= 1) & any_key)
        whole = salted.groupBy(*by).agg(F.sum("n").alias("n"), *own).where(F.col("n") >= least).withColumn("hot", F.lit(True))
        return cold.drop("salt", "__most").unionByName(whole)

    def answered(asked: DataFrame, gains: DataFrame, by: list[str], k: int) -> DataFrame:
        if "salt" in by:
            salts = F.when(F.col("hot"), F.sequence(F.lit(1).cast("long"), F.lit(SALTS).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
            gains = gains.withColumn("salt", F.explode(salts))
        joined = asked.join(gains.drop("hot"), by)
        if k < order:  # here too the exchange is the counts' own: it keeps the n-grams' digests
            joined = joined.where(F.when(F.col("gain").isNotNull(), F.col("gram")).otherwise(0) >= -(1 << 63))
        return joined.select("__key", F.col("gain").alias("s"), none.alias("copies"), none.alias("n"))

    if order >= 2:
        hot = hot_grams(2, True)
        asked = dealt(texts, 2, True, hot)
        # One broadcast serves both words: a word's value tells its count.
        of = lambda p, v: F.broadcast(table.select(F.col("place").alias(p), F.col("value").alias(v)))
        h, v = of("__hp", "__hv"), of("__vp", "__v")
        seen = counted(learnt, asked, 2, True, hot)
        seen = seen.join(h, F.shiftright("head", 20) == F.col("__hp")).join(v, F.col("head").bitwiseAND(PLACES - 1) == F.col("__vp"))
        value = F.log(F.lit(ALPHA ** (order - 2) * ALPHA ** (order - 1) / max(total, 1)) * F.col("n")) - F.col("__hv")
        pairs_seen = seen.select("head", "hot", "n", value.alias("value"), (value - F.col("__v")).alias("gain"), *(["gram"] if order > 2 else []))
        if order > 2:
            pairs_seen = written(pairs_seen, "pair-values")
        parts.append(answered(asked, pairs_seen.select("head", "hot", "gain"), keys_of(True, hot), 2))
    for k in range(2, max(order, 2) + 1):
        hot = hot_grams(k, False) if k <= order else nothing
        asked = dealt(texts, k, False, hot)
        seen = counted(learnt, asked, k, False, hot)
        seen = seen.join(below.select(F.col("gram").alias("head"), F.col("n").alias("__h")), "head").join(below.select(F.col("gram").alias("tail"), F.col("value").alias("__v")), "tail")
        value = F.log(F.lit(ALPHA ** (order - k)) * F.col("n") / F.col("__h"))
        seen = seen.select("head", "tail", "hot", "n", value.alias("value"), (value - F.col("__v")).alias("gain"), *(["gram"] if k < order else []))
        if k < order:
            seen = written(seen, "ngram-values")
            below = seen.select("gram", "n", "value")
            if k == 2:  # and the pairs of frequent words and of the square
                below = below.unionByName(pairs_seen.select("gram", "n", "value")).unionByName(_square_rows(spark, known, common, pairs, order))
        gains = alone if order < 2 else seen.select("head", "tail", "hot", "gain")
        parts.append(answered(asked, gains.unionByName(alone) if k == 2 <= order else gains, keys_of(False, hot), k))
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    # Equal rows were each asked for: their sum is divided by their number.
    sums = sums.groupBy("__key").agg((F.sum("s") / F.sum("copies")).alias("log_score"), F.max("n").alias("n_words"))
    return _finished(keyed, sums, cols, total)


def _finished(keyed: DataFrame, sums: DataFrame, cols: list[str], total: int) -> DataFrame:
    out = keyed.drop("__text").join(sums, "__key").drop("__key")
    score = F.when((F.col("n_words") > 0) & F.lit(total > 0), F.col("log_score"))
    return out.select(*[F.col(f"`{c}`") for c in cols], "n_words", score.alias("log_score"), (score / F.col("n_words")).alias("mean_log_score"))


def values_table(spark, known: dict[str, np.ndarray]) -> DataFrame:
    """place, n, value of the frequent words."""
    return spark.createDataFrame(pa.table({
        "place": pa.array(np.arange(len(known["word"])), pa.int64()), "n": pa.array(known["n"], pa.int64()), "value": pa.array(known["value"], pa.float64()),
    }))


def _square_rows(spark, known: dict[str, np.ndarray], common: np.ndarray, pairs: pa.Table, order: int) -> DataFrame:
    """gram, n, value of the seen pairs of the square table."""
    cell, n = pairs["cell"].to_numpy(), pairs["n"].to_numpy()
    head, tail = known["word"][common][cell // COMMON], known["word"][common][cell % COMMON]
    grams = [int(signed(Prefix(np.array([h, t], dtype=np.int64).view(U), 1).windows(2))[0]) for h, t in zip(head, tail, strict=True)]
    value = np.log(ALPHA ** (order - 2) * n / known["n"][common][cell // COMMON]) if len(cell) else np.zeros(0)
    return spark.createDataFrame(pa.table({"gram": pa.array(grams, pa.int64()), "n": pa.array(n, pa.int64()), "value": pa.array(value, pa.float64())}))
