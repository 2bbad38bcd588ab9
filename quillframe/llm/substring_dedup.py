"""Removal of long word runs that a document with a smaller id also has.

The runs form a sparse de Bruijn graph. Its edges are token k-mers: of the 31 k-mers of 20 words inside each window of 50
words, the one with the least digest. Equal windows choose the same k-mer, so a window's copies meet at one edge, and a
document sends one row for each k-mer chosen (about one for 16 words) rather than one for each window. The consecutive
windows that choose one occurrence of a k-mer form a segment, a stretch of the text with its own 128-bit digest.

An edge whose occurrences all have the same segment does not branch: its windows compact to that one segment, and joining
the segments to their least document decides them together. Where an edge branches, one document for each distinct segment
spells out its windows (its source coordinates), and their least document is found window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, without, written
from .words import U, Prefix, mix, signed, split, word_digests

WINDOW = 50
KMER = 20
#: Up to this many ids of branching documents are broadcast to pick their texts; beyond it they are joined.
PICKED_IDS = 200_000
LAST = (1 << 63) - 1


class Segments:
    """The segments of one text."""

    def __init__(self, words: list[bytes], window: int = WINDOW, kmer: int = KMER):
        values = word_digests(words)
        self.lanes = Prefix(values, 1), Prefix(mix(values ^ U(0x5851F42D4C957F2D)), 2)
        kmers = self.lanes[0].windows(kmer)
        chosen = np.lib.stride_tricks.sliding_window_view(kmers, window - kmer + 1).argmin(1) + np.arange(len(words) - window + 1)
        cuts = np.flatnonzero(np.diff(chosen)) + 1
        self.first = np.append(0, cuts)
        self.last = np.append(cuts, len(chosen)) - 1
        self.kmers = kmers[chosen[self.first]]
        self.digests = [lane.runs(self.first, self.last + window) for lane in self.lanes]


def _edges(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = []
        for key, last, text in zip(pdf["__key"], pdf["__last"], pdf["__text"], strict=True):
            if len(words := split(text)) >= window:
                s = Segments(words, window)
                parts.append(pd.DataFrame({"kmer": signed(s.kmers), "s1": signed(s.digests[0]), "s2": signed(s.digests[1]), "key": key, "last": last}))
        if parts:
            yield pd.concat(parts).drop_duplicates()


def _windows(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """The digests of all windows of the segments asked for."""
    for pdf in batches:
        for key, last, text, w1s, w2s in zip(pdf["__key"], pdf["__last"], pdf["__text"], pdf["w1s"], pdf["w2s"], strict=True):
            if len(words := split(text)) < window:
                continue
            s = Segments(words, window)
            own, wanted = [signed(d) for d in s.digests], set(zip(w1s, w2s, strict=True))
            at = np.flatnonzero([x in wanted for x in zip(own[0].tolist(), own[1].tolist(), strict=True)])
            if not len(at):
                continue
            counts = s.last[at] - s.first[at] + 1
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = np.repeat(s.first[at], counts) + offset
            w1, w2 = (signed(lane.runs(starts, starts + window)) for lane in s.lanes)
            yield pd.DataFrame({"w1": w1, "w2": w2, "key": key, "last": last, "s1": np.repeat(own[0][at], counts), "s2": np.repeat(own[1][at], counts), "offset": offset.astype(np.int32)}).drop_duplicates()


def _cut(batch: pa.RecordBatch, window: int) -> dict[str, pa.Array]:
    kept, n_words, n_removed = [], [], []
    for text, s1, s2, masks in zip(*(batch.column(c).to_pylist() for c in ("__text", "__s1", "__s2", "__masks")), strict=True):
        words = split(text)
        n_words.append(len(words))
        if s1 is None or len(words) < window:
            n_removed.append(0)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            continue
        s = Segments(words, window)
        of: dict[tuple[int, int], int] = {}
        for a, b, m in zip(s1, s2, masks, strict=True):
            of[a, b] = of.get((a, b), 0) | int(m)
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for a, b, first, last in zip(*(signed(d).tolist() for d in s.digests), s.first.tolist(), s.last.tolist(), strict=True):
            mask = of.get((a, b), 0)
            if mask < 0:
                change[first] += 1
                change[last + window] -= 1
            elif mask:
                starts = [first + i for i in range(last - first + 1) if mask >> i & 1]
                np.add.at(change, starts, 1)
                np.add.at(change, [x + window for x in starts], -1)
        stays = np.cumsum(change[:-1]) == 0
        n_removed.append(int(len(words) - stays.sum()))
        kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]).decode("utf-8", "surrogatepass"))
    return {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Drop each word covered by a window of 50 words that also starts in a document with a smaller id.

    Returns ``carry`` (all columns but the text by default) with n_words, n_removed and kept_text (kept words joined by one
    space); input columns of these names are replaced. All windows are judged on the input. Null or empty texts have no
    words; texts under 50 words stay. A null id counts as larger than any other, and null ids are not smaller than each
    other; rows that share an id do not remove each other's words. An empty table gives no rows. Digests have 128 bits.
    """
    if not KMER < window <= KMER + 62:
        raise ValueError("window must lie between 21 and 82 words")
    results = ["n_words", "n_removed", "kept_text"]
    base = without(docs, results)
    cols = [c for c in (base.columns if carry is None else carry) if carry is not None or c != text_col]
    ident = F.col(f"`{id_col}`")
    text = F.col(f"`{text_col}`")
    # __key joins a document to its findings; a null id goes by its text. __last: no id, so after all others.
    keyed = base.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(ident.cast("long"), F.xxhash64(text)).alias("__key"), ident.isNull().alias("__last"), text.alias("__text"))
    narrow = keyed.select("__key", "__last", "__text")
    edges = written(
        narrow.mapInPandas(lambda it: _edges(it, window), "kmer long, s1 long, s2 long, key long, last boolean"), "edges"
    ).withColumn("ord", F.when(F.col("last"), F.lit(LAST)).otherwise(F.col("key")))

    # Edges that at least two documents have; one segment or several.
    shared = (
        edges.groupBy("kmer")
        .agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.min(F.struct("s1", "s2")).alias("__a"), F.max(F.struct("s1", "s2")).alias("__b"))
        .where("least < most")
        .select("kmer", "least", (F.col("__a") != F.col("__b")).alias("branches"))
    )
    met = written(edges.join(shared, "kmer"), "shared-edges")
    straight = met.where("not branches and ord > least").select("key", "s1", "s2", F.lit(-1).cast("long").alias("mask"))

    # Branching edges: the least document of each segment, then of each of its windows.
    branching = met.where("branches")
    segments = written(branching.groupBy("s1", "s2").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")), "segments")
    repeated = segments.where("first_ord < last_ord").select("s1", "s2", "first_ord")
    later = branching.join(repeated, ["s1", "s2"]).where("ord > first_ord").select("key", "s1", "s2", F.lit(-1).cast("long").alias("mask"))
    firsts = branching.select("s1", "s2", "key", "ord").join(segments.select("s1", "s2", "first_ord"), ["s1", "s2"]).where("ord = first_ord")
    asked = written(firsts.groupBy("key").agg(F.collect_set(F.struct("s1", "s2")).alias("w")).select("key", F.col("w.s1").alias("w1s"), F.col("w.s2").alias("w2s")), "asked")
    few = asked.count() <= PICKED_IDS
    picked = narrow.join(F.broadcast(asked.select("key")), narrow["__key"] == F.col("key"), "left_semi") if few else narrow
    spelled = written(
        picked.join(asked, picked["__key"] == asked["key"]).select("__key", "__last", "__text", "w1s", "w2s")
        .mapInPandas(lambda it: _windows(it, window), "w1 long, w2 long, key long, last boolean, s1 long, s2 long, offset int"),
        "windows",
    ).withColumn("ord", F.when(F.col("last"), F.lit(LAST)).otherwise(F.col("key")))
    least = spelled.groupBy("w1", "w2").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").select("w1", "w2", "least")
    single = (
        spelled.join(least, ["w1", "w2"]).where("ord > least")
        .select("key", "s1", "s2", "offset").distinct()
        .groupBy("key", "s1", "s2").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("offset"))).alias("mask"))
    )
    found = straight.unionByName(later).unionByName(single)
    found = found.groupBy("key").agg(F.collect_set(F.struct("s1", "s2", "mask")).alias("__f"))
    found = found.select(F.col("key").alias("__k"), F.col("__f.s1").alias("__s1"), F.col("__f.s2").alias("__s2"), F.col("__f.mask").alias("__masks"))
    joined = keyed.join(found, F.col("__key") == F.col("__k"), "left").drop("__k")
    return appended(joined, ["__key", "__last", "__text", "__s1", "__s2", "__masks"], "n_words long, n_removed long, kept_text string", lambda b: _cut(b, window))
