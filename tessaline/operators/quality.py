"""Quality masks, audits and summaries of the master table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.config import ALL23


def quality_mask(threshold: float | Column) -> Column:
    """Valid, corrected by at most ``threshold`` percent, and with all features; unknown counts as no."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ALL23])
    return F.coalesce(F.col("WindowValid") & (F.col("RR_CorrectedPercent") <= threshold) & whole, F.lit(False))


def quality_rows(master: DataFrame, threshold: float) -> DataFrame:
    return master.filter(quality_mask(threshold))


def stable_rows(master: DataFrame, threshold: float, edge: float) -> DataFrame:
    """Quality rows that keep ``edge`` seconds from both ends of their session."""
    inside = (F.col("StartTime_sec") >= edge) & (F.col("EndTime_sec") <= F.col("SessionDuration_sec") - edge)
    return quality_rows(master, threshold).filter(inside)


def thinned(rows: DataFrame, least: int = 100) -> DataFrame:
    """Windows that don't overlap; of a window length for which fewer than ``least`` would be left, all."""
    every = F.ceil(F.col("WindowLength_sec") / F.col("StepSize_sec"))
    marked = rows.withColumn("apart", F.pmod(F.col("WindowIndex"), every) == 0)
    # one row per window length
    enough = marked.groupBy("WindowLength_sec").agg((F.count_if("apart") >= least).alias("enough"))
    return marked.join(F.broadcast(enough), "WindowLength_sec").filter("apart or not enough").select(*rows.columns)


def feature_summary(master: DataFrame) -> DataFrame:
    """Windows by length, step, overlap and condition: how many, how many valid, and mean features."""
    return (
        master.groupBy("WindowLength_sec", "StepSize_sec", "OverlapPercent", "ConditionCode")
        .agg(
            F.count("*").alias("windows"),
            F.sum(F.col("WindowValid").cast("long")).alias("valid_windows"),
            F.countDistinct("Subject").alias("subjects"),
            F.countDistinct("Subject", "Session").alias("sessions"),
            *[F.avg(c).alias(f"mean_{c}") for c in ALL23],
        )
        .withColumn("invalid_windows", F.col("windows") - F.col("valid_windows"))
        .withColumn("valid_percent", 100.0 * F.col("valid_windows") / F.col("windows"))
    )


def configuration_audit(master: DataFrame) -> DataFrame:
    return master.groupBy("WindowLength_sec", "StepSize_sec").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("WindowValid").cast("long")).alias("valid"),
        F.countDistinct("Subject").alias("subjects"),
        F.countDistinct("Subject", "Session").alias("sessions"),
        F.avg("RR_CorrectedPercent").alias("mean_corrected"),
        F.median("RR_CorrectedPercent").alias("median_corrected"),
    )


def session_inventory(master: DataFrame) -> DataFrame:
    return master.groupBy("Subject", "Session").agg(
        F.min("ConditionCode").alias("ConditionCode"), F.min("SessionDuration_sec").alias("SessionDuration_sec")
    )


def duplicate_keys(master: DataFrame) -> DataFrame:
    """Keys that stand on more than one row; empty for a sound table."""
    return master.groupBy("Subject", "Session", "WindowLength_sec", "WindowIndex").agg(F.count("*").alias("copies")).filter("copies > 1")


def quality_by_threshold(master: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Pass rates and corrected percent by window length, threshold and condition."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    p = F.col("RR_CorrectedPercent")
    return (
        master.withColumn("RRThreshold", levels)
        .groupBy("WindowLength_sec", "RRThreshold", "ConditionCode")
        .agg(
            F.count("*").alias("windows"),
            F.sum(quality_mask(F.col("RRThreshold")).cast("long")).alias("passed"),
            F.avg(p).alias("mean_corrected"),
            F.median(p).alias("median_corrected"),
            F.percentile(p, 0.25).alias("q1_corrected"),
            F.percentile(p, 0.75).alias("q3_corrected"),
            *[F.count_if(p > t).alias(f"over_{t}") for t in (5, 10, 20)],
            F.sum("RR_Invalid").alias("invalid_rr"),
            F.sum("RR_HampelOutliers").alias("hampel_rr"),
        )
        .withColumn("passed_percent", 100.0 * F.col("passed") / F.col("windows"))
    )


def quality_by_subject(master: DataFrame, threshold: float) -> DataFrame:
    return master.groupBy("Subject", "WindowLength_sec").agg(
        F.count("*").alias("windows"), F.sum(quality_mask(threshold).cast("long")).alias("passed"), F.avg("RR_CorrectedPercent").alias("mean_corrected")
    )


def exclusion_reasons(master: DataFrame) -> DataFrame:
    reason = F.when(F.col("WindowFailureReason") == "", "none").otherwise(F.col("WindowFailureReason"))
    return master.groupBy("WindowLength_sec", reason.alias("reason")).agg(F.count("*").alias("windows"))
