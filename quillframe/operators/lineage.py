"""Cutting the lineage of loops: each round starts from files that all executors see."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in spark.checkpoint.dir; where that is unset, beside the session's tables."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()
