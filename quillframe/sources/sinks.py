"""Sinks: appends with a version guard, partitioned manifests, label exports, tensors, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables of up to so many classes are broadcast.
FEW_CLASSES = 10_000


def append_history(records: DataFrame, path: str, version: int) -> None:
    """Append run records as JSON lines; refuses a log written by another schema version."""
    spark = records.sparkSession
    out = records.withColumn("schema_version", F.lit(version))
    try:
        found = spark.read.schema("schema_version int").json(path).agg(F.min("schema_version"), F.max("schema_version")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = (None, None)
    if found[1] is not None and (found[0], found[1]) != (version, version):
        raise ValueError(f"the log has schema version {found[1]}, not {version}")
    out.write.mode("append").json(path)


def write_manifests(splits: DataFrame, path: str, fmt: str = "parquet", files: int = 64) -> None:
    """One folder for each split, each of at most ``files`` files: a split's rows are dealt to so many tasks by their digest."""
    dealt = splits.repartition("split", F.pmod(F.xxhash64(*splits.columns), F.lit(files)))
    writer = dealt.write.mode("overwrite").partitionBy("split")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def box_line(class_id: Column, x0: Column, y0: Column, x1: Column, y1: Column, size: float = 512.0, least: float = 1e-6) -> Column:
    """'class cx cy w h' with six decimals; sides are at least 1e-6 of the canvas."""
    side = lambda a, b: F.greatest(F.lit(least), (b - a) / size)
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id.cast("int"), (x0 + x1) / 2 / size, (y0 + y1) / 2 / size, side(x0, x1), side(y0, y1))


def write_box_lines(boxes: DataFrame, path: str, scene: str = "scene_id", buckets: int = 64) -> None:
    """Scenes' box-label texts as rows (scene, text) in folders of scene buckets: millions of scenes make few folders and files."""
    line = box_line(F.col("class_id"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    texts = boxes.groupBy(scene).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    texts.withColumn("bucket", F.pmod(F.xxhash64(scene), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def sidecar_json(scenes: DataFrame, symbols: DataFrame, key: str = "scene_id") -> DataFrame:
    """One JSON text for each scene; keys without a value are left out, and so are symbols where the scene has none recorded."""
    s = F.struct(F.col("label").alias("flattened"), F.array("x0", "y0", "x1", "y1").alias("bbox_px"))
    listed = symbols.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("gt_id", s.alias("s")))), lambda v: v["s"]).alias("symbols"))
    df = scenes.join(listed, key, "left")
    own = F.when(F.col("has_symbols"), F.coalesce("symbols", F.array().cast(dict(listed.dtypes)["symbols"])))
    fields = [F.lit(1).alias("schema_version"), F.col(key).cast("string").alias("sample"), F.col("equation_kind"), F.col("scene_case"), own.alias("symbols")]
    return df.select(key, F.to_json(F.struct(*fields)).alias("json"))


def tensors(pixels: DataFrame, classes: DataFrame, values: str = "px") -> DataFrame:
    """id, class_id and pixels over 255 as float arrays, for a Parquet export."""
    few = classes.count() <= FEW_CLASSES
    return pixels.join(F.broadcast(classes) if few else classes, "label").select("asset_id", "class_id", F.transform(values, lambda p: (p / 255.0).cast("float")).alias("pixels"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
