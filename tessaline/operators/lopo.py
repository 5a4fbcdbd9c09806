"""Leave-one-participant-out: thresholds and penalties learned on the others are applied to the one left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.functions.order import left_out_quantile
from tessaline.operators.calibration import GROUP, choose_multiplier, one_per_block


def held_out_thresholds(expanded: DataFrame, fpr: float = 0.05) -> DataFrame:
    """For each participant the threshold from all other participants' blocks, by places within groups: no participant meets the others' rows."""
    pseudo = one_per_block(expanded, [*GROUP, "Subject"])
    who = pseudo.select("WindowLength_sec", "Subject").distinct()
    people = pseudo.groupBy(*GROUP).agg(F.countDistinct("Subject").alias("all"))
    holders = people.join(who, "WindowLength_sec").select(*GROUP, "Subject", "all")
    limits = left_out_quantile(pseudo, GROUP, "Subject", "Score", 1 - fpr, ["CandidateBlockID", "PseudoCondition"], holders.select(*GROUP, "Subject"))
    present = pseudo.select(*GROUP, "Subject").distinct().withColumn("here", F.lit(1))
    counted = holders.join(present, [*GROUP, "Subject"], "left").withColumn("TrainingSubjects", F.col("all") - F.coalesce("here", F.lit(0))).filter("TrainingSubjects > 0")
    return counted.join(limits, [*GROUP, "Subject"]).select(*GROUP, F.col("Subject").alias("HeldOut"), "Threshold", "TrainingSubjects")


def apply_held_out(real: DataFrame, expanded: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Detections of the participant left out, real and pseudo."""
    t = thresholds.withColumnRenamed("HeldOut", "Subject")
    keep = [*GROUP, "Subject", "BoundaryID", "BoundaryKind", "PseudoCondition", "Score", "Threshold", "Detected"]
    a = real.withColumn("BoundaryKind", F.lit("Real")).withColumn("PseudoCondition", F.lit(None).cast("string"))
    b = one_per_block(expanded, [*GROUP, "Subject"]).withColumn("BoundaryKind", F.lit("Pseudo")).withColumn("BoundaryID", F.col("CandidateID"))
    judged = [x.join(t, [*GROUP, "Subject"]).withColumn("Detected", F.col("Score") >= F.col("Threshold")).select(*keep) for x in (a, b)]
    return judged[0].unionByName(judged[1])


def summary(applied: DataFrame) -> DataFrame:
    """Detection by window, search, method, kind and condition; real rows keep their null condition."""
    return applied.groupBy("WindowLength_sec", "SearchWindow", "Method", "TransitionType", "BoundaryKind", "PseudoCondition").agg(
        F.countDistinct("Subject").alias("Participants"), F.count("*").alias("Rows"), F.sum(F.col("Detected").cast("long")).alias("Detections"), F.avg(F.col("Detected").cast("double")).alias("Rate"), F.median("Score").alias("MedianScore")
    )


def held_out_penalty(pelt: DataFrame, keys: list[str], target: float = 0.05) -> DataFrame:
    """For each participant the penalty multiplier that the others' pseudo detections choose; ``pelt(keys, Subject, Multiplier, Detected)``.

    Rates are sums: those of all less the participant's own.
    """
    sums = lambda by: pelt.groupBy(*by).agg(F.sum(F.col("Detected").cast("long")).alias("hits"), F.count("Detected").alias("rows"))
    own = sums([*keys, "Multiplier", "Subject"]).withColumnsRenamed({"Subject": "HeldOut", "hits": "own_hits", "rows": "own_rows"})
    who = pelt.select("WindowLength_sec", F.col("Subject").alias("HeldOut")).distinct()
    # a row for each group and multiplier: a few hundred, however many participants there are
    all_ = who.join(F.broadcast(sums([*keys, "Multiplier"])), "WindowLength_sec")
    left = all_.join(own, [*keys, "Multiplier", "HeldOut"], "left")
    rest = F.col("rows") - F.coalesce("own_rows", F.lit(0))
    rates = left.filter(rest > 0).withColumn("FPR", (F.col("hits") - F.coalesce("own_hits", F.lit(0))) / rest)
    return choose_multiplier(rates, [*keys, "HeldOut"], target)
