"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_join, let, without, written

#: Below this rate the distribution is summed up from 0. Above it e ** -rate vanishes, and the sum begins twelve standard
#: deviations below the mean, where less than 1e-30 has been passed over.
FROM_ZERO = 400


def _named(source_col: str) -> Column:
    """A source's name, so that null is apart from every text."""
    source = F.col(f"`{source_col}`").cast("string")
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series; for k from 100 on its error is under 1e-17."""
    return k * F.log(k) - k + F.log(2 * F.lit(math.pi) * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)


def distribution(rate: Column) -> Column:
    """(first, cdf): the Poisson distribution's sums from a number of copies on, one for each further copy."""
    wide = 12 * F.sqrt(rate) + 20
    first = F.when(rate < FROM_ZERO, F.lit(0)).otherwise(F.floor(rate - wide)).cast("long")
    start = F.when(first == 0, F.exp(-rate)).otherwise(F.exp(first * F.log(rate) - rate - _log_factorial(first.cast("double"))))
    steps = F.sequence(first + 1, F.ceil(rate + wide).cast("long"))

    def more(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    return F.struct(first.alias("first"), F.aggregate(steps, F.struct(start.alias("p"), F.array(start).alias("cdf")), more)["cdf"].alias("cdf"))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None) -> DataFrame:
    """One row for each source: its rows and its mean repetition rate.

    Target shares come from ``weights`` (sources not named get 0; None names the null source), else from rows ** power. A rate may be of any size. The rates lead to ``total``
    rows in the mean (as many as come in by default). A null source is a source of its own.
    """
    counts = docs.groupBy(_named(source_col).alias("__source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("rows", F.lit(power)))
    else:
        named = docs.sparkSession.createDataFrame([("n" if k is None else "s" + k, float(v)) for k, v in weights.items()], "__source string, weight double")
        counts = counts.join(named, "__source", "left").fillna(0.0, "weight")
    counts = written(counts, "source-counts")
    sums = counts.agg(F.sum("rows"), F.sum("weight")).first()
    n, w = (total or sums[0] or 0), (sums[1] or 1.0)
    return counts.withColumn("rate", F.lit(float(n)) * F.col("weight") / F.lit(float(w)) / F.col("rows"))


def poisson_mix(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """Repeat each document a Poisson number of times, with its source's rate as mean, and shuffle all copies.

    The uniform number of a document is a digest of its id and the seed, so reruns agree and new documents change only the
    rates. Adds copy (0 to n_copies - 1), n_copies, rate and shuffle_key (the global order; output is hash-partitioned and
    sorted by it); input columns of these names are replaced. Documents that draw 0 have no row. Repeated rows of one id
    draw the same number; a null id draws as 'null'; a null source is a source of its own; texts are not looked at.
    """
    base = without(docs, ["copy", "n_copies", "rate", "shuffle_key"])
    per = rates(base, source_col, weights, power, total)
    per = per.select("__source", "rate", distribution(F.col("rate")).alias("__d"))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    mixed = checked_join(base.withColumn("__source", _named(source_col)), per, "__source")
    mixed = mixed.withColumn("n_copies", (F.col("__d.first") + let(u, lambda x: F.size(F.filter("__d.cdf", lambda c: c <= x)))).cast("int"))
    mixed = mixed.drop("__source", "__d").where("n_copies > 0")
    mixed = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), ident, F.lit("/"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return mixed.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
