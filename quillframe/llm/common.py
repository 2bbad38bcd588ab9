"""What the training-data operators share: the shared folder, written intermediate tables, joins with a checked small side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of everything but space and \t \n \v \f \r.
BLANKS = r"[ \t\n\x0B\f\r]"
#: Below this many rows a narrow table is broadcast; above it the join is salted.
SMALL_ROWS = 20_000
SALTS = 64
SLICE_ROWS = 1_000
#: Rows of an Arrow batch while an intermediate table is written: texts of some kilobytes fill the usual 10,000 with tens of megabytes.
BATCH_ROWS = 1_000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; in local mode without that setting a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


@contextmanager
def small_batches(spark: SparkSession):
    """Small Arrow batches for the jobs that run inside; the session's own setting comes back after them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages start from files, not from lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator, removed from the shared folder once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        with small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        """Remove a table that nothing reads any more."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.remove(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Write df to stay, then remove all other tables."""
        out = written(df, name)
        for path in list(self.paths):
            self.drop(path)
        return out


def checked_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", rows: int = SMALL_ROWS) -> DataFrame:
    """Join a narrow per-key table to a table whose keys may be very uneven.

    small (one row for each key, materialised) is counted: up to ``rows`` rows it is broadcast, beyond that it is
    copied to SALTS salted keys, so that a hot key of big spreads over SALTS tasks.
    """
    if small.count() <= rows:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = big.withColumn("__salt", F.floor(F.rand(7) * SALTS).cast("int"))
    return dealt.join(salted, [key, "__salt"], how).drop("__salt")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a slice's Python objects and results stay small."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def packed(x: np.ndarray) -> bytes:
    """Small whole numbers, compressed: their count, then 32 bits each."""
    return len(x).to_bytes(8, "little") + pa.compress(x.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], 4 * n, codec="zstd"), np.int32)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def beside(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """own (a row of df) and keys (a struct of new columns): no name of df's can clash with a key's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.struct(*[v.alias(k) for k, v in keys.items()]).alias("keys"))


def without(df: DataFrame, names) -> DataFrame:
    """df without columns called like an operator's results: the results replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def appended(df: DataFrame, drop: list[str], fields: str, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """df without ``drop`` and with the columns (DDL ``fields``) that compute makes of each Arrow batch; others pass untouched."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in drop] + T.StructType.fromDDL(fields).fields)

    def run(batches):
        for b in sliced(batches):
            new = compute(b)
            names = [n for n in b.schema.names if n not in drop]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + list(new.values()), names + list(new))

    return df.mapInArrow(run, schema)
