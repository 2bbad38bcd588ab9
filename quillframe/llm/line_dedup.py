"""Removal of lines that stand on many sites, by HyperLogLog sketches with exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without, written

MIN_SITES = 10
#: Shorter lines are too common by nature to tell boilerplate.
MIN_CHARS = 12
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: six standard errors of a sketch with 2 ** 12 cells.
BAND = 0.1
#: Up to this many boilerplate lines are broadcast.
FEW_LINES = 100_000


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digests(line):
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """h1, h2, sites of the lines that stand on at least min_sites distinct sites. A null site is a site of its own; a null text has no lines.

    Lines of fewer documents than min_sites go first. The others' sites are sketched and the sketches merged; only lines
    whose estimate lies near the threshold are counted exactly. sites: the estimate, or the exact count where one was made.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`").cast("string")), F.lit("none"))
    own = F.array_distinct(F.filter(_lines(F.col(f"`{text_col}`")), lambda x: F.length(x) >= min_chars))
    lines = docs.select(site.alias("site"), F.explode(own).alias("line")).select("site", *_digests(F.col("line")))
    often = written(
        lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("a"), F.max("site").alias("b")).where((F.col("n") >= min_sites) & (F.col("a") < F.col("b"))).select("h1", "h2"),
        "often",
    )
    seen = lines.join(F.broadcast(often) if often.count() <= FEW_LINES else often, ["h1", "h2"])
    sketches = seen.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    guessed = written(sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")), "estimates")
    near = guessed.where((F.col("sites") >= min_sites * (1 - BAND)) & (F.col("sites") <= min_sites * (1 + BAND))).select("h1", "h2")
    near = F.broadcast(near) if near.count() <= FEW_LINES else near
    exact = lines.join(near, ["h1", "h2"]).distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
    return guessed.where(F.col("sites") > min_sites * (1 + BAND)).union(exact.where(F.col("sites") >= min_sites))


def drop_spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, site_col: str = "source", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Documents without the lines that stand on at least min_sites sites.

    Returns ``carry`` (all columns but the text by default) with n_lines, n_removed and kept_text (the other lines, in
    order); input columns of these names are replaced. Lines are compared as they are; lines under min_chars characters stay.
    A null text counts as empty (one empty line). What happens to a text depends on the text alone, so repeated rows and
    null ids are treated like others. An empty table gives no rows.
    """
    base = without(docs, ["n_lines", "n_removed", "kept_text"])
    cols = [c for c in (base.columns if carry is None else carry) if carry is not None or c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bad = written(spread_lines(base, min_sites, min_chars, site_col, text_col).select("h1", "h2"), "boilerplate")
    keyed = base.select(*[F.col(f"`{c}`") for c in cols], text.alias("__text"), F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2"))
    placed = keyed.select("__k1", "__k2", F.posexplode(_lines(F.col("__text"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    placed = placed.select("__k1", "__k2", "pos", *_digests(F.col("line")))
    hits = placed.join(F.broadcast(bad) if bad.count() <= FEW_LINES else bad, ["h1", "h2"], "left_semi")
    hits = written(hits.groupBy("__k1", "__k2").agg(F.collect_set("pos").alias("__gone")), "line-hits")
    joined = keyed.join(hits, ["__k1", "__k2"], "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    lines = _lines(F.col("__text"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    joined = joined.withColumn("__lines", lines)
    kept = F.when(F.size("__gone") == 0, F.col("__text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get("__lines", i)), "\n"))
    return joined.select(*[F.col(f"`{c}`") for c in cols], F.size("__lines").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"), kept.alias("kept_text"))
