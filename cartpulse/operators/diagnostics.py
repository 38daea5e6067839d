"""Table profile and training-history diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_EXCELLENT = 0.02
GAP_GOOD = 0.05


def table_profile(lines: DataFrame) -> DataFrame:
    """Rows, distinct families, first and last day."""
    return lines.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count_distinct("family_id").cast("bigint").alias("families"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


def history_changes(history: DataFrame) -> DataFrame:
    """W6-W8 per epoch: change of each loss against epoch 1 (%), the
    train/validation gap with its band, and the training phase."""
    whole = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the history has at most ``epochs`` rows, so one ordered window is fine
    first_tr = F.first("train_loss").over(whole)
    first_va = F.first("val_loss").over(whole)
    last_epoch = F.max("epoch").over(whole)
    gap = F.abs(F.col("train_loss") - F.col("val_loss"))
    return (
        history.withColumn("train_change_pct", (first_tr - F.col("train_loss")) / first_tr * 100.0)
        .withColumn("val_change_pct", (first_va - F.col("val_loss")) / first_va * 100.0)
        .withColumn("gap", gap)
        .withColumn("gap_band", F.when(gap < GAP_EXCELLENT, "excellent").when(gap < GAP_GOOD, "good")
                    .when(gap.isNotNull(), "review"))
        .withColumn("phase", F.when(F.col("epoch") <= 10, "early").when(F.col("epoch") <= 30, "middle")
                    .otherwise("late"))
        .withColumn("last15", (F.col("epoch") > last_epoch - 15).cast("int"))
    )


def history_summary(history: DataFrame) -> DataFrame:
    """W9 + W7: epochs run, first/last/min losses and the final gap band.

    First and last are the losses of the first and last epoch, null where that epoch has none
    (a loss of an earlier epoch never stands in); then the gap and its band are null.
    """
    out = history.agg(
        F.count(F.lit(1)).cast("bigint").alias("epochs"),
        F.min_by("train_loss", "epoch").alias("train_loss_first"),
        F.max_by("train_loss", "epoch").alias("train_loss_last"),
        F.min_by("val_loss", "epoch").alias("val_loss_first"),
        F.max_by("val_loss", "epoch").alias("val_loss_last"),
        F.min("val_loss").alias("val_loss_best"),
    )
    gap = F.abs(F.col("train_loss_last") - F.col("val_loss_last"))
    return out.withColumn("gap_last", gap).withColumn(
        "gap_band", F.when(gap < GAP_EXCELLENT, "excellent").when(gap < GAP_GOOD, "good")
        .when(gap.isNotNull(), "review"))
