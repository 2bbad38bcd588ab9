"""Phrases whose words stand together more often than by chance, mined length by length over frequency-ranked ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, packed, unpacked
from .sharding import numbered

LONGEST = 5
LEAST = 100
TOP = 2_000
#: A chunk closes with the text that fills it.
CHUNK_WORDS = 400_000
#: Side of a tile of id pairs; a tile with more occurrences than a 16th of its cells is counted densely.
TILE_BITS = 10
DENSE = 1 << (2 * TILE_BITS - 4)
#: Ids stand in 32 bits: so many phrases of one length may be frequent.
MOST_IDS = 1 << 31
SALTS = 64
#: Frequent words, and frequent phrases of one longer length, up to which a broadcast table holds them (some 30 MB each).
FEW_WORDS, FEW_CODES = 200_000, 2_000_000

_BREAK = b"\xff"  # in no UTF-8 text
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))

CHUNK = "chunk long, lang string, keys binary, codes array<long>, counts array<long>, words array<binary>"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; a break stands wherever a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).replace(_BREAK, b" \xff ").split(b" ")


def pair_tiles(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs as codes (left in the upper 32 bits), their counts, and the number of each occurrence's pair.

    Ids are frequency ranks, so that pairs of common ids share few square tiles: a full tile is counted by the addresses of
    its cells; the pairs of all other tiles are sorted.
    """
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = (1 << TILE_BITS) - 1
    tiles, of, sizes = np.unique((left >> TILE_BITS) << 32 | right >> TILE_BITS, return_inverse=True, return_counts=True)
    codes, counts, number, done = [], [], np.full(len(left), -1), 0
    for t in np.flatnonzero(sizes > DENSE):
        at = np.flatnonzero(of == t)
        cells = (left[at] & low) << TILE_BITS | right[at] & low
        filled = np.bincount(cells, minlength=1 << 2 * TILE_BITS)
        have = np.flatnonzero(filled)
        place = np.zeros(len(filled), np.int64)
        place[have] = done + np.arange(len(have))
        number[at] = place[cells]
        up, across = (int(tiles[t]) >> 32) << TILE_BITS, (int(tiles[t]) & 0xFFFFFFFF) << TILE_BITS
        codes.append((up + (have >> TILE_BITS)) << 32 | across + (have & low))
        counts.append(filled[have])
        done += len(have)
    at = np.flatnonzero(number < 0)
    pairs, own, n = np.unique(left[at] << 32 | right[at], return_inverse=True, return_counts=True)
    number[at] = done + own
    return np.concatenate([*codes, pairs]), np.concatenate([*counts, n]), number


def _chunks(batches):
    """Rows (lang, text) as chunks of one language: each position's number in the chunk's own word list, -1 at breaks."""
    part, made, open_ = TaskContext.get().partitionId() << 32, 0, {}

    def closed(lang):
        nonlocal made
        words, keys = open_.pop(lang)
        keys = np.concatenate(keys)
        counts = np.bincount(keys[keys >= 0], minlength=len(words) - 1)
        row = {"chunk": part + made, "lang": lang, "keys": packed(keys), "codes": range(len(counts)), "counts": counts, "words": list(words)[1:]}
        made += 1
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):  # one text at a time
            lang, got = lang.as_py(), tokens(text.as_py())
            words, keys = open_.setdefault(lang, ({_BREAK: -1}, []))
            keys.append(np.fromiter((words.setdefault(w, len(words) - 1) for w in got if w), np.int32))
            keys.append(np.array([-1], np.int32))
            if sum(map(len, keys)) >= CHUNK_WORDS:
                yield closed(lang)
    for lang in list(open_):
        yield closed(lang)


_ARROW = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("keys", pa.binary()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("words", pa.list_(pa.binary()))])


def _grown(chunk: int, keys: bytes, ids: np.ndarray) -> pa.RecordBatch:
    """A chunk's positions one word on, from the ids of its phrases (-1: not frequent; the last entry is that of no phrase)."""
    keys = unpacked(keys)
    now = ids[keys]
    both = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
    codes, counts, number = pair_tiles(now[both], now[both + 1])
    new = np.full(len(keys), -1, np.int32)
    new[both] = number
    row = {"chunk": chunk, "lang": None, "keys": packed(new), "codes": codes, "counts": counts, "words": None}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _joined(chunk: pa.Table, known: pa.Table) -> pa.Table:
    """A chunk with the ids that a join has found for its phrases."""
    if not chunk.num_rows:
        return _ARROW.empty_table()
    ids = np.full(len(chunk.column("codes")[0]) + 1, -1, np.int64)
    ids[known.column("at").to_numpy()] = known.column("id").to_numpy()
    return pa.Table.from_batches([_grown(chunk.column("chunk")[0].as_py(), chunk.column("keys")[0].as_py(), ids)])


def _looked_up(table: Broadcast):
    """Chunks with ids from a broadcast table: of words by language, or sorted codes with their ids."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                words = b.column("words")[i].as_py()
                if words is not None:
                    known = table.value.get(b.column("lang")[i].as_py(), {})
                    ids = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                else:
                    mine, (codes, own) = b.column("codes")[i].values.to_numpy(), table.value
                    place = np.minimum(np.searchsorted(codes, mine), max(len(codes) - 1, 0))
                    ids = np.where(codes[place] == mine, own[place], -1) if len(codes) else np.full(len(mine), -1)
                yield _grown(b.column("chunk")[i].as_py(), b.column("keys")[i].as_py(), np.append(ids, -1))

    return run


def _table(ranked: DataFrame, k: int) -> Broadcast:
    """The phrases of a length as a broadcast table; their number has been checked."""
    rows = ranked.toArrow()
    if k == 1:
        value: dict = {}
        for lang, word, i in zip(rows.column("lang").to_pylist(), rows.column("word").to_pylist(), rows.column("id").to_pylist(), strict=True):
            value.setdefault(lang, {})[word.encode()] = i
    else:
        codes, ids = rows.column("code").to_numpy(), rows.column("id").to_numpy()
        order = np.argsort(codes)
        value = codes[order], ids[order]
    return ranked.sparkSession.sparkContext.broadcast(value)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", scratch: Scratch | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Phrases of 1 to ``longest`` words with ``least`` occurrences or more, and the words of each language.

    Texts become chunks of one language: arrays of word numbers, which may be cut between texts only. For each length, a
    chunk's pairs of neighbouring ids are counted by tiles; counts are summed over chunks, pairs often enough are ranked by
    frequency, and their ranks are joined back to the chunks, where they are the ids of the next length. A phrase's code
    holds the ids of its first and of its last ``length - 1`` words. A chunk names a pair once, so a pair in a third of all
    places is a row for each chunk. Where a length has few enough frequent phrases (FEW_WORDS, FEW_CODES) their ranks come to
    the chunks as a broadcast table, and beyond by joins; both give the same rows. Returns a table (id, f, code or lang and word) for each length, and (lang, n).
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    chunks = scratch.write(rows.mapInArrow(_chunks, CHUNK), "chunks")
    path = scratch.paths[-1]
    lists = lambda c: c.select("chunk", "lang", F.posexplode(F.arrays_zip("codes", "counts")).alias("at", "u")).select("chunk", "lang", "at", F.col("u.codes").alias("code"), F.col("u.counts").alias("c"))
    worded = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "u")).select("chunk", "lang", "at", F.col("u.words").cast("string").alias("word"), F.col("u.counts").alias("c"))
    totals = scratch.write(worded.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    found = []
    for k in range(1, longest + 1):
        entries, keys = (worded, ["lang", "word"]) if k == 1 else (lists(chunks).drop("lang"), ["code"])
        often = entries.groupBy(*keys).agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        ranked, n = numbered(often, [F.desc("f"), *keys], "id")
        if n > MOST_IDS:
            raise ValueError(f"{n} phrases of {k} words are frequent: raise least; ids hold {MOST_IDS}")
        found.append(scratch.write(ranked, f"phrases{k}"))
        if k < longest:
            ranks = found[-1].select(*keys, "id")
            if n <= (FEW_WORDS if k == 1 else FEW_CODES):
                grown = chunks.mapInArrow(_looked_up(_table(ranks, k)), CHUNK)
            else:
                known = entries.join(ranks, keys).select(F.col("chunk").alias("of_chunk"), "at", "id")
                grown = chunks.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_joined, CHUNK)
            chunks, past = scratch.write(grown, f"chunks{k + 1}"), path
            path = scratch.paths[-1]
            scratch.drop(past)  # counts and ranks of its length are tables of their own
    return found, totals


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)), exact up to 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * big(a)).cast("decimal(22,0)") * big(n), big(l) * big(r))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The phrases of each language with the highest scores: lang, rank, phrase, a, l, r, n, score.

    Words are runs of everything but space and tab, lower-cased in A-Z, inside pieces between ``.,;:!?`` and line ends. A
    phrase of 2 to ``longest`` words that occurs a >= ``least`` times scores, at its worst cut into parts with l and r
    occurrences (the first such cut), floor(1000 a n / (l r)), n being the language's words; decimals of 38 digits are
    exact. A phrase inside a longer one that occurs as often goes. ``top`` by score, a, then phrase.

    Null languages count as ``und``, null and empty texts have no words, long texts are read whole, repeated rows count
    each time; an empty table gives no rows. Columns beyond text and language are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found, totals = frequent_phrases(docs, least, longest, text_col, lang_col, scratch)
    none = F.array().cast("array<long>")
    whole = found[0].select("id", "lang", "f", F.array("word").alias("words"), none.alias("heads"), none.alias("tails"))
    all_, shorter = [], whole
    for table in found[1:]:
        parts = table.select("id", "f", F.shiftright("code", 32).alias("first"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("second"))
        a = shorter.select(F.col("id").alias("first"), "lang", "words", F.concat("heads", F.array("f")).alias("heads"))
        b = shorter.select(F.col("id").alias("second"), F.slice("words", -1, 1).alias("ends"), F.concat("tails", F.array("f")).alias("tails"))
        shorter = scratch.write(
            parts.join(a, "first").join(b, "second").select("id", "lang", "f", F.concat("words", "ends").alias("words"), "heads", "tails", "first", "second"), "spelled"
        )
        all_.append(shorter)
    kept = []
    for i, spelled in enumerate(all_):
        here = spelled.drop("first", "second")
        if i + 1 < len(all_):  # a longer phrase that occurs as often as this one has one that is a word longer between them
            around = all_[i + 1].select(F.explode(F.array("first", "second")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("around"))
            here = here.join(around, "id", "left").where(F.coalesce(F.col("around") < F.col("f"), F.lit(True))).drop("around")
        kept.append(here)
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(F.broadcast(totals) if totals.count() <= 1_000 else totals, "lang")
    cut = lambda l, i: F.struct(score(F.col("f"), F.col("n"), l, F.get(F.reverse("tails"), i)).alias("score"), i.alias("i"), l.alias("l"), F.get(F.reverse("tails"), i).alias("r"))
    scored = rows.withColumn("best", F.array_min(F.transform("heads", cut)))
    flat = scored.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = flat.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("__r", F.row_number().over(W.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("__r") <= top)
    best = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return scratch.result(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


ORACLE = r"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda v: v <> '') as ws from p),
n as (select lang, sum(len(ws)) as n from w group by lang),
o as (select lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) as g from w),
f as (select lang, g, count(*) as f from o group by lang, g having count(*) >= 100),
c as (select lang, g, f as a from f where len(g) > 1),
k as (select lang, g, a, unnest(range(1, len(g))) as k from c),
s as (select k.lang, k.g, a, k, x.f as l, y.f as r, n, cast(cast(1000 as hugeint) * a * n // (cast(x.f as hugeint) * y.f) as bigint) as score
  from k join f x on x.lang = k.lang and x.g = k.g[1:k] join f y on y.lang = k.lang and y.g = k.g[k + 1:] join n on n.lang = k.lang),
b as (select *, row_number() over (partition by lang, g order by score, k) as place from s),
i as (select distinct lang, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda j: {'g': g[j:j + m - 1], 'a': a})))) as u from c where len(g) > 2),
d as (select distinct c.lang, c.g from c join i on i.lang = c.lang and i.u.g = c.g where 100 * i.u.a >= 100 * c.a),
q as (select b.*, array_to_string(b.g, ' ') as phrase from b anti join d on d.lang = b.lang and d.g = b.g where place = 1),
r as (select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from q)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, score from r where rank <= 2000"""
