"""Sharding by a keyed Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without, written

ROUNDS = 6
RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """Apply step until every value lies below n; the domain is under 4n, so a few steps are expected."""
    x = step(x.astype(np.uint64))
    while (far := x >= n).any():
        x[far] = step(x[far])
    return x.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number (0 to n - 1) in the shuffled order."""
    half, keys = np.uint64(_half_bits(n)), _keys(seed)
    mask = np.uint64((1 << int(half)) - 1)

    def step(x):
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << half) | right

    return _walk(rows, n, step)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number at each place: which row a shard's slot holds, without looking at the data."""
    half, keys = np.uint64(_half_bits(n)), _keys(seed)
    mask = np.uint64((1 << int(half)) - 1)

    def step(x):
        left, right = x >> half, x & mask
        for k in keys[::-1]:
            left, right = right ^ (_mix(left ^ k) & mask), left
        return (left << half) | right

    return _walk(places, n, step)


def numbered(df: DataFrame, order: list, name: str = "row_no") -> tuple[DataFrame, int]:
    """df with dense row numbers from 0 in the given order, and the number of rows.

    One range shuffle and a write; only the row counts of the partitions come to the driver.
    """
    placed = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright("__at", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__at"), total


def feistel_shards(docs: DataFrame, n_shards: int = 24, seed: int = 20_240_601, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Deal rows to shards in a reproducible random order (law ``rows``: counts at most one apart).

    Rows are numbered by (id, length and digest of the text); the Feistel permutation with cycle walking takes row
    number i of n to place p; shard = p mod n_shards, slot = p div n_shards. Both, and the way back, can be computed from i
    alone. Returns ``carry`` (all input columns by default) with size, text_crc32, law, shard, slot, grown_shard (null under
    this law); input columns of these names are replaced. A null id sorts first, a null text counts as empty; repeated rows get places of their own; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # The rows' own columns travel in one struct, where no name can clash with the keys'.
    own = F.struct(*[F.col(f"`{c}`") for c in (without(docs, RESULTS).columns if carry is None else carry)])
    base = docs.select(own.alias("own"), F.col(f"`{id_col}`").alias("__id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__tie"))
    rows, n = numbered(base, ["__id", "size", "__tie"])

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    at = rows.withColumn("__place", place("row_no"))
    return at.select(
        "own.*", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("__place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; its files hold its rows in slot order, file after file.

    Tasks take ranges of (shard, slot), so that a shard is written by as many tasks as its size asks for. An empty table
    writes no shard; all columns are written.
    """
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
