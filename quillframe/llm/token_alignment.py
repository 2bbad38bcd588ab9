"""Alignment of two tokenizers' tokens over the same bytes, and how usual each aligned pair is."""

from __future__ import annotations

import hashlib
import os
import re
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, packed, unpacked, without

#: Where the tokenizers' files lie on every machine.
FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.json"
PIECE_BPE = f"{FOLDER}/piece_bpe_32k.model"
#: A code is a's id times PAIR plus b's id.
PAIR = 1 << 20
CHUNK_ROWS, CHUNK_CHARS = 2_000, 3_000_000
#: Segments up to so many characters are kept, so many in a turn; those of the turn before are forgotten at its end.
KEPT_CHARS, KEPT = 48, 150_000
#: So many new segments are encoded as one text.
JOINED = 2_000

#: A single space between two others than spaces: both tokenizers begin a token there whatever stands around it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK = "▁"
_RAW_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers of a worker: ids and where each token ends, in bytes of space + text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [self._decoded(self.a.id_to_token(i), letters) for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        raw = [_RAW_PIECE.fullmatch(p) for p in pieces]
        self.b_raw = np.array([m is not None for m in raw])
        self.b_bytes = [bytes([int(m[1], 16)]) if m else p.replace(_BLANK, " ").encode() for p, m in zip(pieces, raw, strict=True)]
        self.a_lens, self.b_lens = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.names = {side + end: np.array([f"{i}{end}" for i in range(len(t))], object) for side, end, t in (("a", ",", self.a_bytes), ("a", "|", self.a_bytes), ("b", ",", self.b_bytes), ("b", ";", self.b_bytes), ("b", "", self.b_bytes))}
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    @staticmethod
    def _decoded(token: str | None, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in token) if token and all(c in letters for c in token) else (token or "").encode()

    def a_ends(self, text: str, encoding) -> tuple[np.ndarray, np.ndarray]:
        """Character offsets are coarse cuts; where a character's bytes belong to several tokens the decoded bytes cut it."""
        ids = np.array(encoding.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        if text.isascii():  # a character is a byte
            return ids, spans[:, 1]
        coarse = np.concatenate([[0], np.cumsum(_width(text))])[spans[:, 1]]
        split = np.append(spans[1:, 0] < spans[:-1, 1], False)
        whole = np.maximum.accumulate(np.where(split, -1, np.arange(len(ids))))  # the last token before that ends with a character
        read = np.cumsum(self.a_lens[ids])
        return ids, np.where(split, np.where(whole < 0, 0, coarse[whole] - read[whole]) + read, coarse)

    def b_ends(self, proto) -> tuple[np.ndarray, np.ndarray]:
        """The proto's spans count the text's bytes without the leading space; single-byte pieces stand at their character's end."""
        pieces = proto.pieces
        ids = np.array([p.id for p in pieces], np.int64)
        coarse = np.array([p.end for p in pieces], np.int64) + 1
        raw = self.b_raw[ids]
        whole = np.maximum.accumulate(np.where(raw, -1, np.arange(len(ids))))
        read = np.cumsum(self.b_lens[ids])
        return ids, np.where(raw, np.where(whole < 0, 0, coarse[whole] - read[whole]) + read, coarse)

    @staticmethod
    def holds(raw: bytes, ids: np.ndarray, ends: np.ndarray, table: list[bytes], lens: np.ndarray) -> bool:
        """Whether the cuts give the tokens' own bytes and together the text."""
        return bool((np.cumsum(lens[ids]) == ends).all()) and b"".join(map(table.__getitem__, ids.tolist())) == raw

    def links(self, spaced: str, encoding, proto, cuts: list[int]) -> list[tuple] | None:
        """What ``linked`` says up to each cut; None where the bytes differ."""
        raw = spaced.encode()
        a, b = self.a_ends(spaced, encoding), self.b_ends(proto)
        good = self.holds(raw, *a, self.a_bytes, self.a_lens) and self.holds(raw, *b, self.b_bytes, self.b_lens)
        return linked(*a, *b, np.array(cuts, np.int64), self.names) if good else None

    def aligned(self, texts: list[str]) -> list[tuple | None]:
        """Of each text: its groups, codes of its links, and counts of tokens and groups; None where the bytes differ."""
        spaced = [" " + t for t in texts]
        both = zip(spaced, self.a.encode_batch(spaced, add_special_tokens=False), self.b.encode(texts, return_type="proto", num_threads=1), strict=True)
        return [(self.links(t, e, p, [len(t.encode())]) or [None])[0] for t, e, p in both]

    def aligned_words(self, words: list[str]) -> list[tuple | None]:
        """The same for texts without a space at either end, many at a time as one text in which they follow each other."""
        out = []
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            text = " ".join(some)
            got = self.links(" " + text, self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text, return_type="proto"), list(accumulate(len(w.encode()) + 1 for w in some)))
            out += self.aligned(some) if got is None else got
        return out

    def segments(self, texts: list[str]) -> list[tuple | None]:
        """The same, short texts from memory: what was seen since the last turn, or in the turn before."""
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        new, words = [], []
        for t in texts:
            if t not in self.known:
                if t in self.older:
                    self.known[t] = self.older[t]
                else:
                    (words if len(t) <= KEPT_CHARS and t == t.strip() and t and _BLANK not in t else new).append(t)
        got = dict(zip(words, self.aligned_words(words), strict=True))
        self.known.update(got)
        for i in range(0, len(new), 200):
            got.update(zip(new[i : i + 200], self.aligned(new[i : i + 200]), strict=True))
        return [got[t] if t in got else self.known[t] for t in texts]


def _width(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def linked(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, cuts: np.ndarray, names: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray, int, int, int]]:
    """For each stretch up to a cut, at which tokens of both end: its groups, its links, and counts of tokens and groups.

    Groups lie between common ends. A link is a pair of tokens that share bytes: for a token of A, those of B from the first
    that ends after its start to the first that ends with it or after it.
    """
    first = np.searchsorted(b_ends, np.concatenate([[0], a_ends[:-1]]), "right")
    n = np.searchsorted(b_ends, a_ends, "left") - first + 1
    upto = np.cumsum(n)
    codes = np.repeat(a * PAIR, n) + b[np.arange(int(n.sum())) + np.repeat(first - upto + n, n)]
    common = np.intersect1d(a_ends, b_ends)
    a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    groups = np.arange(len(common) + 1)
    written = np.empty(len(a) + len(b), object)  # a group's tokens of A, then its tokens of B
    written[np.arange(len(a)) + np.searchsorted(b_group, groups)[a_group]] = np.where(common[a_group] == a_ends, names["a|"][a], names["a,"][a])
    last = np.isin(b_ends, cuts)
    tail = np.where(last, names["b"][b], np.where(common[b_group] == b_ends, names["b;"][b], names["b,"][b]))
    written[np.arange(len(b)) + np.searchsorted(a_group, groups, "right")[b_group]] = tail
    written = written.tolist()
    at_a, at_b, at_g = (np.searchsorted(x, cuts, "right").tolist() for x in (a_ends, b_ends, common))
    at_l = np.concatenate([[0], upto])[at_a].tolist()
    out, i, j, g, k = [], 0, 0, 0, 0
    for i2, j2, g2, k2 in zip(at_a, at_b, at_g, at_l, strict=True):
        out.append(("".join(written[i + j : i2 + j2]), codes[k:k2].copy(), i2 - i, j2 - j, g2 - g))
        i, j, g, k = i2, j2, g2, k2
    return out


@cache
def loaded(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


MADE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
HELD = "__chunk long, __parts binary, __lens binary, __all binary, __codes array<long>, __counts array<long>"


def _slices(batches):
    """Rows in slices of bounded text; a row of a longer text is a slice of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.utf8_length(b.column("__text")), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > CHUNK_CHARS or i - start >= CHUNK_ROWS):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(b) > start:
            yield b.slice(start)


class Numbers(dict):
    """Numbers for keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _chunk(t: Tokenizers, texts: list[str | None], number: int) -> dict[str, pa.Array]:
    """A slice's rows: their own counts and, for what needs the whole corpus, the numbers of their segments."""
    place = Numbers()
    whole: set[int] = set()
    parts = []
    for d, text in enumerate(texts):
        if text and _BLANK in text:
            whole.add(d)
        own = ((text,) if d in whole else _CUT.split(text)) if text else ()
        parts.append(np.fromiter(map(place.__getitem__, own), np.int32, len(own)))
    found = t.segments(list(place))
    bad = np.array([x is None for x in found], bool)
    for d, row in enumerate(parts):
        if bad[row].any():
            if d not in whole and len(row) > 1:  # a segment whose bytes differ decides nothing about the text around it
                again = t.aligned([texts[d]])
                parts[d] = np.array([len(found)] if again[0] else [], np.int32)
                found += again
            else:
                parts[d] = np.zeros(0, np.int32)
    one = [x or ("", np.zeros(0, np.int64), 0, 0, 0) for x in found]
    sums = np.array([[x[2], x[3], x[4], len(x[1])] for x in one], np.int64).reshape(-1, 4)
    lens = sums[:, 3]
    flat = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in one]])
    times = np.bincount(np.concatenate([np.zeros(0, np.int32), *parts]), minlength=len(one))
    codes, at = np.unique(flat, return_inverse=True)
    counts = np.bincount(at, weights=np.repeat(times, lens), minlength=len(codes)).astype(np.int64)
    made = np.array([sums[r].sum(0) for r in parts], np.int64).reshape(-1, 4)
    groups = [x[0] for x in one]
    digest = [hashlib.sha256(";".join(map(groups.__getitem__, r.tolist())).encode()).hexdigest() if len(r) else "" for r in parts]
    first = lambda x: [x] + [None] * (len(texts) - 1)
    columns = [*made.T, digest, [number] * len(texts), [packed(p) for p in parts], first(packed(lens)), first(packed(at)), first(codes), first(counts)]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in f"{MADE}, {HELD}".split(", ")]
    return {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}


def _summed(rows: pa.Table, known: pa.Table) -> pa.Table:
    """A chunk's rows with the corpus-wide counts of their links."""
    if not rows.num_rows:
        return _finished(rows, [], [])
    head = next(i for i, x in enumerate(rows.column("__lens").is_valid().to_pylist()) if x)
    starts = np.concatenate([[0], np.cumsum(unpacked(rows.column("__lens")[head].as_py()))])
    links = unpacked(rows.column("__all")[head].as_py())
    places, size = known.column("at").to_numpy(), int(links.max()) + 1 if len(links) else 0
    sums = []
    for name in ("best", "n"):
        of_code = np.zeros(size, np.int64)  # codes of texts without tokens have none
        of_code[places] = known.column(name).to_numpy(zero_copy_only=False)
        sums.append(np.diff(np.concatenate([[0], np.cumsum(of_code[links])])[starts]))
    parts = [unpacked(p) for p in rows.column("__parts").to_pylist()]
    return _finished(rows, *[[int(s[p].sum()) for p in parts] for s in sums])


def _finished(rows: pa.Table, best: list[int], total: list[int]) -> pa.Table:
    out = rows.select([n for n in rows.column_names if not n.startswith("__")])
    return out.append_column("n_best", pa.array(best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def aligned_tokens(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """How the tokens of a byte-level BPE (A) and of a sentencepiece model (B) lie over each text.

    Both encode space + text (B adds the space). Tokens are cut at their offsets: A's in characters, B's in the bytes of the
    returned proto (the installed library's successor of the immutable one); tokens that split a character and byte pieces
    are cut by their decoded bytes, and every cut is checked against those. Ends common to both make groups; a link is a
    pair of an A and a B token that share bytes. Texts are aligned in segments between single spaces, where both tokenizers
    begin a token; texts with U+2581, or with a segment whose bytes differ, are aligned whole.

    Returns ``carry`` (all columns but the text by default) with n_a, n_b, n_groups, n_links, groups_sha256, n_best (links
    whose pair is its B id's most frequent of all documents, ties included) and count_sum (the sum of the pairs' counts over
    the links). Input columns of these names, and those that begin with two underscores, are not carried. Null and empty
    texts, and texts that either tokenizer does not give back byte by byte, have zeros and an empty digest; very long texts
    are taken whole; repeated rows count each time; an empty table gives no rows.

    A chunk of documents names a pair once, so counts move as a row for each chunk and pair; the chunk's rows wait for them
    as segment numbers. B's highest counts are broadcast: at most a row for each of B's ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    made = [*T.StructType.fromDDL(MADE).names, "n_best", "count_sum"]
    base = without(docs, made)
    cols = [c for c in (base.columns if carry is None else carry) if not c.startswith("__") and (carry is not None or c != text_col)]
    rows = base.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text_col}`").alias("__text"))
    kept = T.StructType([f for f in rows.schema.fields if f.name != "__text"])

    def align(batches):
        t, part, number = loaded(a_path, b_path), TaskContext.get().partitionId() << 32, 0
        for b in _slices(batches):
            new = _chunk(t, b.column("__text").to_pylist(), part + number)
            number += 1
            names = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + list(new.values()), names + list(new))

    chunks = scratch.write(rows.mapInArrow(align, T.StructType(kept.fields + T.StructType.fromDDL(f"{MADE}, {HELD}").fields)), "aligned")
    pairs = chunks.where("__codes is not null").select("__chunk", F.posexplode(F.arrays_zip("__codes", "__counts")).alias("at", "u")).select("__chunk", "at", F.col("u.__codes").alias("code"), F.col("u.__counts").alias("c")).where("c > 0")
    counts = scratch.write(pairs.groupBy("code").agg(F.sum("c").alias("n")).withColumn("b", F.col("code").bitwiseAND(PAIR - 1)), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    judged = counts.join(F.broadcast(top), "b").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    known = pairs.select(F.col("__chunk").alias("of_chunk"), "at", "code").join(judged, "code").select("of_chunk", "at", "n", "best")
    out = T.StructType(kept.fields + T.StructType.fromDDL(f"{MADE}, n_best long, count_sum long").fields)
    result = chunks.drop("__codes", "__counts").groupBy("__chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_summed, out)
    return scratch.result(result, "aligned-tokens")
