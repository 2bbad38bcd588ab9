"""Quantiles of latencies from mergeable sketches, stored by window and merged, and exact ones found through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: Items a sketch keeps on its top level; RANK_ERROR bounds how far a quantile's rank lies off, with 99 % probability.
K = 400
RANK_ERROR = 0.01


def _number(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def sketches(df: DataFrame, keys: list, value: str, k: int = K) -> DataFrame:
    """A sketch for each key, of a few kilobytes however many values it has seen; nulls and NaN are left out.

    Keys whose values are all left out have a sketch of nothing. The keys may be windows: their sketches are stored and
    merged later, without the events.
    """
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(_number(value), k).alias("sketch"))


def merged(parts: DataFrame, keys: list, k: int = K) -> DataFrame:
    """One sketch for each coarser key from those of finer ones."""
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(parts: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """n_values and a column for each rank in place of the sketch; null where a sketch has seen nothing.

    A sketch of up to K values gives them exactly: the first value that a share of the values does not exceed.
    """
    n = F.kll_sketch_get_n_double("sketch")
    found = {name: F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))) for name, q in ranks.items()}
    return parts.withColumns({"n_values": n} | found).drop("sketch")


def exact_quantile(df: DataFrame, key: str, value: str, rank: float, k: int = K) -> DataFrame:
    """key, quantile: the first value that a share ``rank`` of a key's values does not exceed, exactly."""
    return exact_quantiles(df, [key], value, {"quantile": rank}, k=k).select(key, "quantile")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float], parts: DataFrame | None = None, k: int = K) -> DataFrame:
    """The keys, n_values and a column for each rank: the first value that this share of a key's values does not exceed, exactly.

    A key's sketch (from ``parts``, where they are stored, else made here) tells between which values a quantile lies; only
    the values in between are counted one by one, about two hundredths of a key's, and of those each distinct one is a row.
    Where the sketch was wrong, which the counts show, all values of the key are counted. Nulls and NaN are left out; a key
    without other values has null. Null keys are keys.
    """
    rows = df.select(F.struct(*keys).alias("__k"), _number(value).alias("__v"))
    parts = sketches(rows, ["__k"], "__v", k) if parts is None else parts.select(F.struct(*keys).alias("__k"), "sketch")
    probe = lambda q: F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, q)))))
    between = [F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("rank"), probe(q - 2 * RANK_ERROR).alias("lo"), probe(q + 2 * RANK_ERROR).alias("hi")) for n, q in ranks.items()]
    # written once: a sketch that is worked out again may keep other values
    edges = cut(parts.select("__k", F.explode(F.array(*between)).alias("e")).select("__k", "e.*"))
    below = F.coalesce(F.col("__v") < F.col("lo"), F.lit(False))
    inside = F.col("__v").isNotNull() & ~below & F.coalesce(F.col("__v") <= F.col("hi"), F.lit(True))
    same = lambda *cs: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cs]

    def picked(edges):
        """n, quantile and whether it lay between the bounds, for each key and name."""
        joined = edges.alias("a").join(rows.alias("b"), same("__k"), "left").select("a.*", "__v")
        totals = joined.groupBy("__k", "name", "rank").agg(F.count("__v").alias("n"), F.count(F.when(below, 1)).alias("below"), F.count(F.when(inside, 1)).alias("in_"))
        totals = totals.withColumn("at", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("rank") - 1e-9)) - F.col("below"))
        values = joined.where(inside).groupBy("__k", "name", "__v").count().withColumn("upto", F.sum("count").over(W.partitionBy("__k", "name").orderBy("__v")))
        found = totals.alias("a").join(values.alias("b"), [*same("__k", "name"), F.col("upto") >= F.col("at")], "left").groupBy("a.__k", "a.name", "n", "at", "in_").agg(F.min("__v").alias("quantile"))
        return found.select("__k", "name", "n", "quantile", ((F.col("n") == 0) | ((F.col("at") >= 1) & (F.col("at") <= F.col("in_")))).alias("good"))

    out = cut(picked(edges))
    missed = out.where("not good")
    if not missed.isEmpty():
        wide = edges.alias("a").join(missed.alias("b"), same("__k", "name"), "left_semi").withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
        out = out.where("good").unionByName(picked(wide))
    found = out.groupBy("__k").agg(F.max("n").alias("n_values"), *[F.max(F.when(F.col("name") == n, F.col("quantile"))).alias(n) for n in ranks])
    return found.select(*[F.col("__k")[c].alias(c) for c in keys], "n_values", *ranks)
