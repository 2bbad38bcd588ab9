"""Rendering of logged conversations after collapsing cumulative snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed markers of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _said(x):
    return F.coalesce(F.concat(F.lit("v"), F.length(x).cast("string"), F.lit(":"), x), F.lit("n"))


def conversations_with_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, __own, turns (in order), digests: digests[i] covers the first i + 1 turns, rolled from digests[i - 1].

    __own tells rows without conv_id apart: each is a conversation of its own, so that they do not gather in one group.
    """
    own = F.md5(F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("n")), F.lit("/"), _said(F.col("role")), _said(F.col("text"))))
    rows = turns.select("conv_id", F.when(F.col("conv_id").isNull(), own).alias("__own"), F.struct("turn", "role", "text").alias("t"))
    convs = rows.groupBy("conv_id", "__own").agg(F.sort_array(F.collect_set("t")).alias("turns"))

    def roll(seen, t):
        h = F.md5(F.concat(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("")), _said(t["role"]), _said(t["text"])))
        return F.array_append(seen, h)

    return convs.withColumn("digests", F.aggregate("turns", F.slice(F.array(F.lit("")), 1, 0), roll))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """The conversations that are not a prefix of a longer one, each of equal ones once, rendered.

    A conversation is its turns in order of (turn, role, text); turn numbers order the turns but do not count otherwise.
    Returns conv_id (the least of equal conversations), n_turns and rendered. Rows repeated in full count once; a null role
    is rendered as 'unknown', a null text as empty (though null and empty differ when compared); each row without
    conv_id is a conversation of one turn. Markers inside a text are broken up so that they cannot open or close a turn. Other columns are not
    looked at. An empty table gives no rows.
    """
    convs = written(conversations_with_prefixes(turns), "conversations").withColumn("__full", F.element_at("digests", -1))
    prefixes = convs.where(F.size("digests") > 1).select(F.explode(F.slice("digests", 1, F.size("digests") - 1)).alias("__full")).distinct()
    first = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "__own"))  # an id before none
    one = convs.groupBy("__full").agg(first.alias("c")).join(prefixes, "__full", "left_anti")
    kept = written(one.select(F.col("c.conv_id").alias("__id"), F.col("c.__own").alias("__who")), "maximal")
    safe = lambda x: F.replace(F.replace(x, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    form = F.transform(
        "turns", lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), safe(F.coalesce(t["text"], F.lit(""))), F.lit(CLOSE + "\n"))
    )
    chosen = convs.join(kept, convs["conv_id"].eqNullSafe(kept["__id"]) & convs["__own"].eqNullSafe(kept["__who"]), "left_semi")
    return chosen.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(form, "").alias("rendered"))
