"""Training runs and evaluation histories: latest records, pointers, early stopping, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key; nulls come first in the order. An aggregate: a key with many records sends one from each task."""
    last = F.max_by(F.struct(*[F.col(c) for c in records.columns]), F.struct(*order))
    return records.groupBy(F.col(key).alias("__k")).agg(last.alias("__l")).select("__l.*")


def latest_run(records: DataFrame, run_col: str = "run_id") -> DataFrame:
    """The rows of the last run by name; with run_col as partition column only that partition is read."""
    return records.where(F.col(run_col) == records.agg(F.max(run_col)).first()[0])


def active_run(runs: DataFrame, active: DataFrame) -> DataFrame:
    """For each stage the run that is marked active, else the one created last."""
    last = runs.groupBy("stage").agg(F.max_by("run_id", F.struct("created_utc", "run_id")).alias("last"))
    return last.join(active, "stage", "left").select("stage", F.coalesce("active_run", "last").alias("run_id"))


def loss_collapses(epochs: DataFrame, ratio: float = 50.0) -> DataFrame:
    """Epochs whose training loss fell by more than a ratio from the epoch before."""
    w = W.partitionBy("run_id").orderBy("epoch")
    df = epochs.withColumn("previous", F.lag("train_loss").over(w))
    return df.where((F.col("train_loss") > 0) & (F.col("previous") / F.greatest("train_loss", F.lit(1e-9)) > ratio))


def early_stops(epochs: DataFrame, patience: int = 8) -> DataFrame:
    """run_id, best_epoch, best_value, stop_epoch (null when the run was not stopped), trivial (>= 0.999 in the first two epochs).

    The counter starts anew at each strict improvement; the run stops at the first epoch where it reaches patience, and later
    epochs do not count. Epochs are numbered from 1.
    """
    w = W.partitionBy("run_id").orderBy("epoch")
    before = F.max("value").over(w.rowsBetween(W.unboundedPreceding, -1))
    df = epochs.withColumn("better", F.col("value") > F.coalesce(before, F.lit(float("-inf"))))
    df = df.withColumn("since", F.max(F.when(F.col("better"), F.col("epoch"))).over(w)).withColumn("counter", F.col("epoch") - F.col("since"))
    df = df.withColumn("stop", F.min(F.when(F.col("counter") >= patience, F.col("epoch"))).over(W.partitionBy("run_id")))
    df = df.where(F.col("stop").isNull() | (F.col("epoch") <= F.col("stop")))
    return df.groupBy("run_id").agg(F.max_by("epoch", F.struct("value", -F.col("epoch"))).alias("best_epoch"), F.max("value").alias("best_value"), F.max("stop").alias("stop_epoch"), F.coalesce(F.max((F.col("epoch") <= 2) & (F.col("value") >= 0.999)), F.lit(False)).alias("trivial"))


def promotable(runs: DataFrame, least_f1: float = 0.30, least_place: float = 0.20, least_classes: int = 12) -> DataFrame:
    """Runs with the reasons that keep them from promotion; an empty list lets them pass."""
    low = lambda c, x: ~F.coalesce(c >= x, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(low(F.col("macro_f1"), least_f1), "macro_f1"), F.when(low(F.col("row_acc") + F.col("col_acc"), least_place), "placement"), F.when(low(F.col("n_classes"), least_classes), "classes"),
    ))
    return runs.withColumn("blocked_by", F.array_join(reasons, ",")).withColumn("promote", F.size(reasons) == 0)


def regression_gate(history: DataFrame, least: float = 0.70) -> DataFrame:
    """The latest baseline of each configuration and whether it holds."""
    return latest(history.where("is_baseline"), "config_id", ["created", "record_id"]).withColumn("holds", F.coalesce(F.col("kind_acc") >= least, F.lit(False)))


def class_report(runs: DataFrame) -> DataFrame:
    """run_id, label, val, test from metric maps whose keys look like val/label."""
    long = runs.select("run_id", F.explode("metrics").alias("k", "v"))
    long = long.select("run_id", F.split_part("k", F.lit("/"), F.lit(1)).alias("part"), F.split_part("k", F.lit("/"), F.lit(2)).alias("label"), "v")
    return long.groupBy("run_id", "label").pivot("part", ["val", "test"]).agg(F.first("v"))


def combined_score(a, b):
    return 0.5 * a + 0.5 * b
