"""Benchmark decontamination by latent semantic retrieval, then word checks.

The benchmark's passages, weighted by TF-IDF, are factored by a distributed randomised SVD. Every window of every document is
folded into the latent space and compared with the passages there by cosine, in products of matrices. The latent space has
RANK directions for any number of passages, so two ways stand beside it that lose nothing: the cosine over all terms, and
runs of words that a passage has too. Candidates are then checked on the words: the longest common subsequence with the
passage, and for middling values whether the passage's answer (its last sentence) stands there too.
"""

from __future__ import annotations

import collections
import itertools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, written
from .words import U, Prefix, mix, signed, word_digests

#: Latent directions: one for four passages, since a space with a direction for each passage would merge nothing, and so many at most.
PASSAGES_A_DIRECTION = 4
RANK = 128
SPARE = 16
#: Passages of one matrix, and of one pass over the documents.
SLICE = 256
PASS = 4096
#: A long item is cut into passages of so many words, each half a passage after the one before.
PASSAGE_WORDS = 64
#: Window lengths, each with the least and most words of the passages that it is compared with; a window moves by half its length.
FITS = {8: (1, 23), 16: (6, 47), 32: (17, PASSAGE_WORDS), 64: (33, PASSAGE_WORDS)}
#: Words of windows multiplied at once, and texts searched together.
BLOCK = 8192
TEXTS = 100
#: Runs of so many words (a shorter passage's all) that a text shares with a passage are checked whatever the words weigh.
RUN = 8
#: Candidates: a window's cosine with a passage over all terms; or in the latent space, for windows that keep a share of their length there.
COSINE = 0.4
LATENT_COSINE = 0.7
INSIDE = 0.4
SLACK = 1e-3
LCS_SURE = 0.6
LCS_MAYBE = 0.4
ANSWER = 0.8
_MARKS = b".,;:!?\"'()[]"
_CLEAN = bytes(32 if b in _MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; punctuation marks separate words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def answer_start(text: str | None, words: list[bytes]) -> int:
    """Where the last sentence of a text begins, in words; half-way in a text of one sentence."""
    head = (text or "").rstrip().rstrip(".!?").rpartition(".")[0]
    n = len(tokens(head))
    return n if 0 < n < len(words) else len(words) // 2


def covered(windows: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Windows that meet, joined; each range with its best cosine."""
    out: list[tuple[int, int, float]] = []
    for lo, hi, cosine in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi), max(out[-1][2], cosine))
        else:
            out.append((lo, hi, cosine))
    return out


def passage_starts(n: int) -> list[int]:
    """Where the passages of an item of n words begin; the last one ends with the item."""
    if n <= PASSAGE_WORDS:
        return [0] if n else []
    return [*range(0, n - PASSAGE_WORDS, PASSAGE_WORDS // 2), n - PASSAGE_WORDS]


def places_of(a: list) -> dict:
    """For each word a mask of its places."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def lcs(a: dict, n: int, b: list) -> int:
    """Length of the longest common subsequence of n words, given by their places, and b."""
    return lcs_of_places(n, [hit for y in b if (hit := a.get(y))])


def lcs_of_places(n: int, hits: list[int]) -> int:
    """The same, by the places of b's words that are among the n: one integer operation for each."""
    full = (1 << n) - 1
    rows = full
    for hit in hits:
        hit &= rows
        rows = ((rows + hit) | (rows - hit)) & full
    return n - rows.bit_count()


def most_common(hits: list[int]) -> int:
    """No common subsequence is longer: a word counts as often as both sides have it."""
    return sum(min(k, hit.bit_count()) for hit, k in collections.Counter(hits).items())


def _normals(terms: np.ndarray, rank: int) -> np.ndarray:
    """The random matrix's rows, each from its term's digest, so that no task needs the whole matrix."""
    seeds = mix(terms[:, None] ^ mix(np.arange(1, 2 * rank + 1, dtype=U) * U(0x9E3779B97F4A7C15))[None, :])
    unit = (seeds >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    return np.sqrt(-2 * np.log(unit[:, :rank])) * np.cos(2 * np.pi * unit[:, rank:])


def passages(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """pid, item, part (pass over the documents), terms, weights, idfs, text (its words), answer (where its answer begins): the benchmark's passages and their TF-IDF vectors.

    Texts that share an id are passages of their own. A passage's answer is its part of the item's answer; a half where it has none.
    A term's weight comes from the number of passages that hold it. The documents have no say in it: a passage that has leaked
    into many of them would weigh itself down. It is over zero even for a term of all passages.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = tokens(text)
                for at in passage_starts(len(words)):
                    own = words[at : at + PASSAGE_WORDS]
                    part = collections.Counter(own)
                    answer = answer_start(text, words) - at
                    rows.append((item, b" ".join(own), answer if 0 < answer < len(own) else len(own) // 2, signed(word_digests(list(part))), list(part), list(part.values())))
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["item", "text", "answer", "terms", "words", "counts"])

    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").alias("text")).where("item is not null").dropDuplicates()
    cuts = rows.mapInArrow(cut, "item long, text binary, answer int, terms array<long>, words array<binary>, counts array<long>")
    cuts = written(cuts.dropDuplicates(["item", "text", "answer"]).withColumn("pid", F.xxhash64("item", "text", "answer")), "passages")
    each = cuts.select("pid", F.explode(F.arrays_zip("terms", "words", "counts")).alias("t")).select("pid", F.col("t.terms").alias("term"), F.col("t.words").alias("word"), F.col("t.counts").alias("tf"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = cuts.count()
    idf = F.log(F.lit(size + 2.0) / (F.col("df") + 1))
    weighed = each.join(df, "term").select("pid", "term", (F.col("tf") * idf).alias("w"), idf.alias("idf"))
    lists = weighed.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("term", "w", "idf"))).alias("l"))
    # Dealt by digest, three quarters full; all passages of an item are in one pass.
    part = F.pmod(F.xxhash64("item"), F.lit(1 if size <= PASS else -(-size * 4 // (PASS * 3))))
    return written(
        cuts.select("pid", "item", "text", "answer").join(lists, "pid").select(
            "pid", "item", part.cast("int").alias("part"),
            F.col("l.term").alias("terms"), F.col("l.w").alias("weights"), F.col("l.idf").alias("idfs"), "text", "answer",
        ),
        "tfidf",
    )


def _rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for t, w in zip(b.column("terms").to_pylist(), b.column("weights").to_pylist(), strict=True):
        w = np.array(w)
        yield np.array(t, dtype=np.int64), w / np.linalg.norm(w)


def _gram(tall: DataFrame, rank: int) -> np.ndarray:
    """The inner products of the columns of a table of vectors (rank by rank, whatever the number of rows)."""

    def partial(batches):
        total = np.zeros((rank, rank))
        for b in batches:
            m = np.array([np.frombuffer(v) for v in b.column("v").to_pylist()]).reshape(-1, rank)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(rank), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    sums = tall.mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((rank, rank))
    out[sums["i"], sums["j"]] = sums["x"]
    return out


def _root_inverse(gram: np.ndarray) -> np.ndarray:
    """A matrix that makes columns with these inner products orthonormal; columns without own length become zero."""
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(initial=0.0), 1e-300) * 1e-10
    return vectors[:, ::-1] * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0.0)[::-1]


def latent_basis(index: DataFrame, rank: int = RANK) -> DataFrame:
    """term, v: the right singular vectors of the passages' matrix, found by a randomised SVD over its partitions.

    The range is sampled with a random matrix, refined by one power iteration, and made orthonormal through rank-by-rank
    inner products; nothing larger than rank by rank comes to the driver. SPARE directions more than asked for are sampled and
    dropped at the end, since the last sampled ones are the least exact.
    """
    keep, rank = rank, rank + SPARE

    def times_random(batches):
        for b in batches:
            ys = [(w @ _normals(t.view(U), rank)).tobytes() for t, w in _rows(b)]
            yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("terms"), b.column("weights"), pa.array(ys, pa.binary())], ["pid", "terms", "weights", "v"])

    def to_terms(y: DataFrame, q: np.ndarray) -> DataFrame:
        def spread(batches):
            for b in batches:
                sums: dict[int, np.ndarray] = {}
                for (t, w), v in zip(_rows(b), b.column("v").to_pylist(), strict=True):
                    row = np.frombuffer(v) @ q
                    for term, x in zip(t.tolist(), w.tolist(), strict=True):
                        sums[term] = sums[term] + x * row if term in sums else x * row
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["term", "v"])

        def add(batches):
            key, total = None, None
            for b in batches:
                terms, out = b.column("term").to_pylist(), []
                for t, v in zip(terms, b.column("v").to_pylist(), strict=True):
                    v = np.frombuffer(v)
                    if t == key:
                        total = total + v
                    else:
                        if key is not None:
                            out.append((key, total.tobytes()))
                        key, total = t, v
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["term", "v"])
            if key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["term", "v"])

        parts = y.mapInArrow(spread, "term long, v binary")
        return written(parts.repartition("term").sortWithinPartitions("term").mapInArrow(add, "term long, v binary"), "term-vectors")

    def to_passages(z: DataFrame, w: np.ndarray) -> DataFrame:
        each = index.select("pid", F.explode(F.arrays_zip("terms", "weights")).alias("t"), F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x).alias("l"))
        joined = each.select("pid", "l", F.col("t.terms").alias("term"), F.col("t.weights").alias("w")).join(z, "term")

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum((x / np.sqrt(n)) * np.frombuffer(v) for x, n, v in zip(pdf["w"], pdf["l"], pdf["v"], strict=True)) @ w
            return pd.DataFrame({"pid": [pdf["pid"].iloc[0]], "v": [total.tobytes()]})

        vectors = joined.groupBy("pid").applyInPandas(add, "pid long, v binary")
        return written(index.select("pid", "terms", "weights").join(vectors, "pid"), "passage-vectors")

    y = written(index.mapInArrow(times_random, "pid long, terms array<long>, weights array<double>, v binary"), "range")
    z = to_terms(y, _root_inverse(_gram(y, rank)))
    y = to_passages(z, _root_inverse(_gram(z, rank)))
    z = to_terms(y, _root_inverse(_gram(y, rank)))
    w = _root_inverse(_gram(z, rank))[:, :keep]

    def rotate(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("term"), pa.array([(np.frombuffer(v) @ w).astype(np.float32).tobytes() for v in b.column("v").to_pylist()], pa.binary())], ["term", "v"])

    return written(z.mapInArrow(rotate, "term long, v binary"), "basis")


class Slice:
    """Up to SLICE passages of like length: their TF-IDF vectors as a matrix, term by passage."""

    def __init__(self, first: int, lengths: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], size: int):
        """vectors: rows of the vocabulary and their share in the dot product of each passage; size: rows of the vocabulary."""
        terms = np.unique(np.concatenate([rows for rows, _ in vectors]))
        self.row_of = np.zeros(size, dtype=np.int32)
        self.row_of[terms] = np.arange(1, len(terms) + 1)
        whole = np.zeros((len(terms) + 1, len(vectors)), dtype=np.float32)
        for p, (rows, share) in enumerate(vectors):
            whole[self.row_of[rows], p] = share
        # For each window length the passages it suits (a run of columns, since they are sorted by length), and each term's greatest share there.
        self.by_window = {}
        for window, (least, most) in FITS.items():
            lo, hi = np.searchsorted(lengths, least), np.searchsorted(lengths, most, "right")
            if lo < hi:
                self.by_window[window] = first + lo, np.ascontiguousarray(whole[:, lo:hi]), whole[:, lo:hi].max(axis=1)


class Index:
    """The passages of one pass, at most PASS by construction: what a task needs to search."""

    def __init__(self, index: DataFrame, basis: DataFrame, rank: int, size: int):
        """size: passages of the whole benchmark."""
        vectors = basis.toPandas()
        rows = index.toPandas()
        rows = rows.assign(n=[len(t.split()) for t in rows["text"]]).sort_values(["n", "pid"])
        terms = np.sort(vectors["term"].to_numpy(dtype=np.int64))
        self.items, self.answers = rows["item"].to_numpy(), rows["answer"].to_numpy()
        self.words = [t.split() for t in rows["text"]]
        self.masks = [(places_of(w), places_of(w[a:]), len(w[a:])) for w, a in zip(self.words, self.answers, strict=True)]
        lengths = rows["n"].to_numpy()
        # Row 0 stands for a word that no passage has, the last row for the space between texts.
        vocabulary = sorted(set(itertools.chain.from_iterable(self.words)))
        at = np.searchsorted(terms, signed(word_digests(vocabulary)))
        self.places = {w: int(p) + 1 for w, p in zip(vocabulary, at, strict=True)}
        self.blank = len(terms) + 1
        idf = np.zeros(len(terms) + 2)
        own = []
        for t, w, i in zip(rows["terms"], rows["weights"], rows["idfs"], strict=True):
            at, w = np.searchsorted(terms, t) + 1, np.asarray(w)
            idf[at] = i
            own.append((at, w / np.linalg.norm(w)))
        self.square = idf**2
        self.square[0] = np.log(size + 2.0) ** 2  # a word of no passage
        self.slices = [
            Slice(k, lengths[k : k + SLICE], [(at, idf[at] * w) for at, w in own[k : k + SLICE]], len(idf)) for k in range(0, len(own), SLICE)
        ]
        self.basis = np.zeros((len(idf), rank), dtype=np.float32)
        self.basis[np.searchsorted(terms, vectors["term"]) + 1] = np.array([np.frombuffer(v, np.float32) for v in vectors["v"]]).reshape(-1, rank)
        latent = np.array([w.astype(np.float32) @ self.basis[at] for at, w in own])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        self.basis *= idf[:, None].astype(np.float32)
        self.norms = np.linalg.norm(self.basis, axis=1)
        self.latent = {}
        for window, (least, most) in FITS.items():
            lo, hi = np.searchsorted(lengths, least), np.searchsorted(lengths, most, "right")
            if lo < hi:
                self.latent[window] = lo, latent[lo:hi].T.copy()
        runs = [(self._runs(np.array([self.places[w] for w in words]), k := min(RUN, len(words))), k, p) for p, words in enumerate(self.words)]
        self.runs = {}
        for size in sorted({k for _, k, _ in runs}):
            mine = [(x, np.full(len(x), p)) for x, k, p in runs if k == size]
            keys, who = np.concatenate([x for x, _ in mine]), np.concatenate([p for _, p in mine])
            order = np.argsort(keys, kind="stable")
            self.runs[size] = keys[order], who[order]

    @staticmethod
    def _runs(at: np.ndarray, size: int) -> np.ndarray:
        """Digests of the runs of so many words, by their places."""
        return Prefix(mix((at + 2).astype(U)), 1).windows(size) if len(at) >= size else np.zeros(0, dtype=U)

    def _shared_runs(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """start, end, passage, cosine: runs of words that stand in a passage too, whatever they weigh."""
        foreign = np.append(0, np.cumsum((at == 0) | (at == self.blank)))
        for size, (keys, who) in self.runs.items():
            starts = np.flatnonzero(foreign[size:] == foreign[:-size]) if len(at) >= size else np.zeros(0, int)
            if not len(starts):
                continue
            asked = self._runs(at, size)[starts]
            first, last = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
            n = last - first
            pick = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            starts = np.repeat(starts, n)
            yield starts, starts + size, who[pick], np.zeros(len(starts))

    def _near_windows(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """start, end, passage, cosine: windows near a passage, by the TF-IDF vectors themselves or in the latent space.

        A window is multiplied with all passages that suit its length. Neither cosine can reach its bound where less than
        COSINE ** 2 of the window's squared weight lies on words that the benchmark has: such windows are passed over. So are
        those whose words' greatest shares in any passage, or norms in the latent space, do not add up to the bound.
        """
        square = self.square[at]
        whole = np.append(0.0, np.cumsum(square))
        known = np.append(0.0, np.cumsum(np.where(at > 0, square, 0.0)))
        for window in self.latent:
            starts = np.arange(0, len(at) - window + 1, window // 2)
            total = whole[starts + window] - whole[starts]
            starts = starts[(known[starts + window] - known[starts] >= COSINE**2 * total) & (total > 0)]
            for s in self.slices:
                if window in s.by_window:
                    first, matrix, most = s.by_window[window]
                    rows = s.row_of[at]
                    for some, length in self._able(starts, window, whole, most[rows], COSINE):
                        cosine = matrix[rows[some[:, None] + np.arange(window)]].sum(axis=1) / length[:, None]
                        i, p = np.nonzero(cosine >= COSINE)
                        yield some[i], some[i] + window, first + p, cosine[i, p]
            first, passages = self.latent[window]
            for some, length in self._able(starts, window, whole, self.norms[at], INSIDE):
                folded = self.basis[at[some[:, None] + np.arange(window)]].sum(axis=1)
                inside = np.linalg.norm(folded, axis=1)
                able = np.flatnonzero(inside >= INSIDE * length)
                if len(able):
                    cosine = (folded[able] / inside[able, None]) @ passages
                    i, p = np.nonzero(cosine >= LATENT_COSINE)
                    yield some[able[i]], some[able[i]] + window, first + p, cosine[i, p]

    @staticmethod
    def _able(starts: np.ndarray, window: int, whole: np.ndarray, most: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of the windows whose words' most add up to a share of their length, with the lengths; SLACK is for rounding."""
        sums = np.append(0.0, np.cumsum(most, dtype=np.float64))
        length = np.sqrt(whole[starts + window] - whole[starts])
        pick = sums[starts + window] - sums[starts] >= (share - SLACK) * length
        starts, length = starts[pick], length[pick]
        for i in range(0, len(starts), BLOCK // window):
            yield starts[i : i + BLOCK // window], length[i : i + BLOCK // window]

    def candidates(self, texts: list[list[bytes]]) -> list[dict[int, list[tuple[int, int, float]]]]:
        """For each text, place of a passage: the ranges of the text that its near windows and shared runs cover, each with its best cosine."""
        step = max(FITS) // 2  # texts begin where every window length begins
        firsts = np.append(0, np.cumsum([-(-len(words) // step) * step for words in texts]))
        at = np.full(int(firsts[-1]) + max(FITS), self.blank, dtype=np.int32)
        for words, first in zip(texts, firsts.tolist()):
            at[first : first + len(words)] = np.fromiter(map(self.places.get, words, itertools.repeat(0)), np.int32, len(words))
        found: list[dict[int, list]] = [{} for _ in texts]
        for starts, ends, passages, cosines in itertools.chain(self._shared_runs(at), self._near_windows(at)):
            owner = np.searchsorted(firsts, starts, "right") - 1
            for d, lo, hi, p, cosine in zip(owner.tolist(), starts.tolist(), ends.tolist(), passages.tolist(), cosines.tolist(), strict=True):
                lo, hi = lo - int(firsts[d]), min(hi - int(firsts[d]), len(texts[d]))
                if lo < hi:
                    found[d].setdefault(p, []).append((lo, hi, cosine))
        return [{p: covered(windows) for p, windows in f.items()} for f in found]

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float, bool]]]:
        """The items that each text holds: item, cosine, share of the longest common subsequence, whether the answer is there."""
        tokenised = [tokens(t) for t in texts]
        out = []
        for words, found in zip(tokenised, self.candidates(tokenised), strict=True):
            hits = [h for p in sorted(found) for lo, hi, cosine in found[p] if (h := self._checked(words, p, lo, hi, cosine))]
            out.append(merged(hits))
        return out

    def _checked(self, words: list[bytes], p: int, lo: int, hi: int, cosine: float) -> tuple[int, float, float, bool] | None:
        """The hit, if the words near a range of a text bear it out."""
        passage, answer, long = self.masks[p]
        n = len(self.words[p])
        near = words[max(0, lo - n) : hi + n]
        hits, at = [], []
        for i, hit in enumerate(map(passage.get, near)):
            if hit:
                hits.append(hit)
                at.append(i)
        # Windows are passed over where their bound tells that they change nothing.
        if len(hits) < LCS_MAYBE * n:
            return None
        best = 0
        for i in range(0, max(1, len(near) - n), max(1, n // 2)):
            own = hits[bisect_left(at, i) : bisect_left(at, i + 2 * n)]
            if len(own) > best and len(own) / n >= LCS_MAYBE and (most := most_common(own)) > best and most / n >= LCS_MAYBE:
                best = max(best, lcs_of_places(n, own))
        share = best / n
        if share < LCS_MAYBE:
            return None
        says = max(lcs(answer, long, near[i : i + 3 * n + max(FITS)]) for i in range(0, max(1, len(near) - 2 * n - max(FITS)), n)) >= ANSWER * long
        return (int(self.items[p]), round(cosine, 4), round(share, 4), says) if share >= LCS_SURE or says else None


def merged(hits: list[tuple[int, float, float, bool]]) -> list[tuple[int, float, float, bool]]:
    """One hit for each item, which may have several passages and places: the one of the greatest share."""
    best: dict[int, tuple[int, float, float, bool]] = {}
    for h in hits:
        best[h[0]] = max(best.get(h[0], h), h, key=lambda x: (x[2], x[1], x[3]))
    return [best[i] for i in sorted(best)]


LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("has_answer", pa.bool_())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, has_answer: one row for each benchmark item that a document holds.

    Every window of every text is multiplied with the passages that suit its length; what comes near one, over all terms or in
    the latent space, and every run of 8 words shared with one goes to the word checks. Null or empty texts and items match
    nothing; an item whose words are all common, or that most documents hold, is searched like any other; rows without item id are left
    out. Repeated document rows repeat their rows, repeated items count once. Very long texts are searched window by window.
    Extra columns are not looked at.
    """
    index = passages(benchmark, item_col, item_text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))
    spark, found = docs.sparkSession, None
    size = index.count()
    rank = max(1, min(rank, size // PASSAGES_A_DIRECTION))
    basis = latent_basis(index, rank) if size else None
    for part in sorted(r["part"] for r in index.select("part").distinct().collect()):
        own = index.where(F.col("part") == part)
        held = own.select(F.explode("terms").alias("term")).distinct()
        shared = spark.sparkContext.broadcast(Index(own, basis.join(held, "term"), rank, size))

        def search(batches, shared=shared):
            names = ("item_id", "cosine", "lcs_share", "has_answer")
            for whole in batches:
                for at in range(0, len(whole), TEXTS):
                    b = whole.slice(at, TEXTS)
                    hits = shared.value.leaks(b.column("__text").to_pylist())
                    found = pa.array([[dict(zip(names, h, strict=True)) for h in x] for x in hits], LEAKS)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], ["doc_id", "__leaks"])

        part_rows = rows.mapInArrow(search, "doc_id long, __leaks array<struct<item_id long, cosine double, lcs_share double, has_answer boolean>>").where(F.size("__leaks") > 0)
        found = part_rows if found is None else found.unionByName(part_rows)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, has_answer boolean")
    return found.select("doc_id", F.explode("__leaks").alias("l")).select("doc_id", "l.*")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item, with their own columns.

    A row is judged by its id and text, so repeated rows go or stay together, and rows without an id, or that share one, are
    judged by their texts. Null and empty texts stay. An empty table or an empty benchmark drops nothing.
    """
    key = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bad = written(find_leaks(rows, benchmark).select(F.col("doc_id").alias("__key")).distinct(), "leaking")
    few = bad.count() <= 200_000
    held = beside(docs, {"k": key})
    return held.join(F.broadcast(bad) if few else bad, F.col("keys.k") == F.col("__key"), "left_anti").select("own.*")
