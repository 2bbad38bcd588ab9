"""Tables of ink pixels (scene_id, y, x, v) and connected components (scene_id, comp_id, x, y, w, h, area).

Point-in-box joins meet on tiles, so that a large canvas does not pair every pixel with every box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64
DARK = 128


def _tiles(low, high):
    return F.sequence(F.floor(low / TILE).cast("int"), F.floor(high / TILE).cast("int"))


def in_boxes(pixels: DataFrame, boxes: DataFrame, key: str, margin: float = 0.0, scene: str = "scene_id") -> DataFrame:
    """Each pixel with each box (key) of its scene that holds it; borders count, boxes grow by a margin."""
    b = boxes.select(scene, key, *[(F.col(c) + m).alias(f"__{c}") for c, m in (("x0", -margin), ("y0", -margin), ("x1", margin), ("y1", margin))])
    b = b.select("*", F.explode(_tiles(F.col("__x0"), F.col("__x1"))).alias("__tx")).select("*", F.explode(_tiles(F.col("__y0"), F.col("__y1"))).alias("__ty"))
    p = pixels.withColumns({"__tx": F.floor(F.col("x") / TILE).cast("int"), "__ty": F.floor(F.col("y") / TILE).cast("int")})
    both = p.join(b, [scene, "__tx", "__ty"]).where("x >= __x0 and x <= __x1 and y >= __y0 and y <= __y1")
    return both.drop("__tx", "__ty", "__x0", "__y0", "__x1", "__y1")


def ink_shares(pixels: DataFrame, boxes: DataFrame, key: str, least: float = 0.10, least_area: float = 30.0, scene: str = "scene_id") -> DataFrame:
    """Share of dark pixels (under 128) among a box's pixels, and whether the box has enough ink and area."""
    share = in_boxes(pixels, boxes, key, scene=scene).groupBy(scene, key).agg(F.avg((F.col("v") < DARK).cast("double")).alias("ink"))
    df = boxes.join(share, [scene, key], "left").withColumn("ink", F.coalesce("ink", F.lit(0.0)))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return df.withColumn("enough", (F.col("ink") >= least) & (area >= least_area))


def outside(pixels: DataFrame, boxes: DataFrame, key: str, margin: float = 4.0, scene: str = "scene_id") -> DataFrame:
    """Pixels in none of the scene's grown boxes."""
    return pixels.join(in_boxes(pixels, boxes, key, margin, scene).select(scene, "y", "x").distinct(), [scene, "y", "x"], "left_anti")


def components_kept(comps: DataFrame, size: float = 512.0, pad: float = 4.0, least_area: float = 30.0, least_side: float = 4.0, aspect: float = 10.0) -> DataFrame:
    """Components large and square enough, as padded boxes inside the canvas."""
    long, short = F.greatest("w", "h"), F.least("w", "h")
    good = (F.col("area") >= least_area) & (long >= least_side) & (long <= aspect * short)
    low = lambda c: F.greatest(F.lit(0.0), F.col(c) - pad)
    high = lambda c, s: F.least(F.lit(size), F.col(c) + F.col(s) + pad)
    return comps.where(good).select("scene_id", "comp_id", low("x").alias("x0"), low("y").alias("y0"), high("x", "w").alias("x1"), high("y", "h").alias("y1"))


def source_quality(pixels: DataFrame, comps: DataFrame, key: str = "scene_id") -> DataFrame:
    """density, contrast and connectivity of each tile, and quality 0.4 / 0.3 / 0.3 of them."""
    ink = pixels.groupBy(key).agg(F.avg((F.col("v") < 200).cast("double")).alias("density"), ((F.max("v") - F.min("v")) / 255).alias("contrast"))
    solid = comps.groupBy(key).agg((F.max("area") / F.sum("area")).alias("connectivity"))
    df = ink.join(solid, key, "left").na.fill(0.0, ["connectivity"])
    return df.withColumn("quality", 0.4 * F.col("density") + 0.3 * F.col("contrast") + 0.3 * F.col("connectivity"))
