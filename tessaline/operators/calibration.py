"""Empirical calibration of scores by disjoint folds of matched pseudo-boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions.arrays import quantile_higher
from tessaline.functions.order import left_out_quantile
from tessaline.functions.scalars import calibrated_name
from tessaline.sources.shared import settle

GROUP = ["WindowLength_sec", "SearchWindow", "Method", "TransitionType"]


def expand_scores(matches: DataFrame, pseudo_scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Every match with all scores of its candidate; the match's own columns win. ``group`` may have further keys than ``GROUP``, as in all of this module."""
    scores = pseudo_scores.select("CandidateID", *[c for c in group if c != "TransitionType"], "Score", "CandidateLatency_sec")
    return matches.join(scores, ["CandidateID", "WindowLength_sec"])


def one_per_block(expanded: DataFrame, keys: list[str]) -> DataFrame:
    """The best matched row of each block, so that repeated matches carry no extra weight."""
    order = W.partitionBy(*keys, "CandidateBlockID", "PseudoCondition").orderBy("MatchScore", "MatchRank", "PseudoMatchID")
    return expanded.withColumn("turn", F.row_number().over(order)).filter("turn = 1").drop("turn")


def crossfit_thresholds(expanded: DataFrame, fpr: float = 0.05, group: list[str] = GROUP) -> DataFrame:
    """For each fold the threshold from all other folds (both conditions together) and its false-positive rate on the fold."""
    pseudo = settle(one_per_block(expanded, [*group, "PseudoFold"]).select(*group, "PseudoFold", "CandidateBlockID", "PseudoCondition", "Score"), "blocks")
    folds = pseudo.groupBy(*group, "PseudoFold").agg(F.countDistinct("CandidateBlockID").alias("own"))
    limits = left_out_quantile(pseudo, group, "PseudoFold", "Score", 1 - fpr, ["CandidateBlockID", "PseudoCondition"], folds.select(*group, "PseudoFold"))
    # a block is in one fold
    others = F.sum("own").over(W.partitionBy(*group)) - F.col("own")
    fitted = folds.withColumn("CalibrationBlocks", others).join(limits, [*group, "PseudoFold"]).select(*group, F.col("PseudoFold").alias("CalibrationFold"), "Threshold", "CalibrationBlocks")
    held = fitted.join(pseudo.withColumnRenamed("PseudoFold", "CalibrationFold"), [*group, "CalibrationFold"])
    rate = held.groupBy(*group, "CalibrationFold").agg(
        F.countDistinct("CandidateBlockID").alias("HeldoutBlocks"),
        F.avg(F.coalesce((F.col("Score") >= F.col("Threshold")).cast("double"), F.lit(0.0))).alias("HeldoutFPR"),
    )
    return fitted.join(rate, [*group, "CalibrationFold"], "left")


def _detected(df: DataFrame, threshold: Column) -> DataFrame:
    hit = F.coalesce(F.col("Score") >= threshold, F.lit(False))
    return df.withColumn("Threshold", threshold).withColumn("Detected", hit).withColumn("Latency_sec", F.when(hit, F.col("CandidateLatency_sec")))


RESULT = [
    "WindowLength_sec", "SearchWindow", "Method", "SourceMethod", "BoundaryKind", "BoundaryID", "MatchedRealBoundaryID", "Subject", "TransitionType", "BoundaryOrder",
    "PseudoCondition", "CandidateBlockID", "PseudoFold", "MatchScore", "Score", "Threshold", "Detected", "Latency_sec",
]


def apply_thresholds(real: DataFrame, expanded: DataFrame, thresholds: DataFrame, fixed: float = 6.0, group: list[str] = GROUP) -> DataFrame:
    """Detections: real boundaries by the median of the folds' thresholds, pseudo ones by their own fold's, and the legacy score by a fixed one."""
    none = lambda kind: F.lit(None).cast(kind)
    real_ = (
        real.withColumn("BoundaryKind", F.lit("Real"))
        .withColumn("MatchedRealBoundaryID", F.col("BoundaryID"))
        .withColumn("PseudoCondition", none("string"))
        .withColumn("CandidateBlockID", none("string"))
        .withColumn("PseudoFold", none("int"))
        .withColumn("MatchScore", none("double"))
    )
    pseudo = expanded.withColumn("BoundaryKind", F.lit("Pseudo")).withColumn("BoundaryID", F.col("PseudoMatchID"))
    medians = thresholds.groupBy(*group).agg(F.median("Threshold").alias("T"))
    own = thresholds.select(*group, F.col("CalibrationFold").alias("PseudoFold"), F.col("Threshold").alias("T"))
    named = lambda df, name: df.withColumn("SourceMethod", F.col("Method")).withColumn("Method", name).select(*RESULT, *[k for k in group if k not in RESULT])
    legacy = lambda df: named(_detected(df.filter(F.col("Method") == "LegacyBIC_fixed6"), F.lit(fixed)), F.lit("LegacyBIC_fixed6"))
    by_group = named(_detected(real_.join(medians, group), F.col("T")), calibrated_name(F.col("Method")))
    by_fold = named(_detected(pseudo.join(own, [*group, "PseudoFold"]), F.col("T")), calibrated_name(F.col("Method")))
    return by_group.unionByName(by_fold).unionByName(legacy(real_)).unionByName(legacy(pseudo))


def with_bh(df: DataFrame, p: str, keys: list[str], name: str) -> DataFrame:
    """Adds Benjamini-Hochberg q values of ``p`` within ``keys``; nulls stay null and don't count."""
    group = W.partitionBy(*keys, F.col(p).isNull())
    ranked = df.withColumn("_r", F.row_number().over(group.orderBy(p))).withColumn("_m", F.count(p).over(group))
    down = group.orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), q)).drop("_r", "_m")


def with_holm(df: DataFrame, p: str, keys: list[str], name: str) -> DataFrame:
    """Adds Holm-adjusted values of ``p`` within ``keys``; nulls stay null and don't count."""
    group = W.partitionBy(*keys, F.col(p).isNull())
    ranked = df.withColumn("_r", F.row_number().over(group.orderBy(p))).withColumn("_m", F.count(p).over(group))
    up = group.orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    adjusted = F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(up))
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), adjusted)).drop("_r", "_m")


def empirical_p_values(real: DataFrame, expanded: DataFrame) -> DataFrame:
    """(1 + pseudo scores at least as large) / (n + 1) per boundary and condition, with q values per group."""
    pseudo = one_per_block(expanded.filter("Score is not null"), [*GROUP, "MatchedRealBoundaryID"]).select(
        *GROUP, F.col("MatchedRealBoundaryID").alias("BoundaryID"), "PseudoCondition", F.col("Score").alias("ps")
    )
    every = real.withColumn("PseudoCondition", F.explode(F.array(F.lit("A"), F.lit("NA"))))
    keys = [*GROUP, "BoundaryID", "PseudoCondition"]
    got = every.join(pseudo, keys, "left").withColumnRenamed("Score", "RealScore").groupBy(*keys, "Subject", "BoundaryOrder", "RealScore").agg(
        F.count("ps").alias("PseudoControls"),
        F.median("ps").alias("PseudoMedianScore"),
        quantile_higher(F.col("ps"), 0.95).alias("PseudoQ95Score"),
        F.count_if(F.col("ps") >= F.col("RealScore")).alias("atleast"),
    )
    p = F.when((F.col("PseudoControls") > 0) & F.col("RealScore").isNotNull(), (1 + F.col("atleast")) / (F.col("PseudoControls") + 1))
    full = got.withColumn("EmpiricalPValue", p).withColumn("RealMinusPseudoMedian", F.col("RealScore") - F.col("PseudoMedianScore")).drop("atleast")
    return with_bh(full, "EmpiricalPValue", [*GROUP, "PseudoCondition"], "EmpiricalQValue_BH")


def choose_multiplier(rates: DataFrame, keys: list[str], target: float = 0.05) -> DataFrame:
    """Of ``keys, Multiplier, FPR``: the smallest multiplier with a rate within the target and closest to it; the largest if none is within."""
    fine = F.col("FPR") <= target
    best = F.min(F.when(fine, F.struct(F.round(F.abs(F.col("FPR") - target), 12).alias("off"), F.col("Multiplier").alias("m"))))
    return rates.groupBy(*keys).agg(best.alias("b"), F.max("Multiplier").alias("largest")).select(*keys, F.coalesce("b.m", "largest").alias("Multiplier"))


def nearest_grid_value(wanted: DataFrame, keys: list[str], grid: list[float], value: str = "wanted") -> DataFrame:
    """The grid value nearest to ``value``; the smaller of two equally near ones."""
    steps = F.array(*[F.lit(float(g)) for g in grid])
    ranked = F.array_sort(F.transform(steps, lambda g: F.struct(F.abs(g - F.col(value)).alias("off"), g.alias("g"))))
    return wanted.select(*keys, F.get(ranked, 0)["g"].alias("Multiplier"))


PELT_GROUP = ["WindowLength_sec", "SearchWindow", "Model", "TransitionType"]


def crossfit_multipliers(pseudo: DataFrame, target: float = 0.05) -> DataFrame:
    """For each fold the multiplier that all other folds choose, their rate at it, and the rate on the fold itself.

    pseudo: PELT_GROUP, CandidateBlockID, PseudoCondition, PseudoFold, MatchScore, MatchRank, PseudoMatchID, Multiplier, Detected.
    """
    one = one_per_block(pseudo, [*PELT_GROUP, "PseudoFold", "Multiplier"]).withColumn("hit", F.col("Detected").cast("double"))
    folds = one.select(*PELT_GROUP, F.col("PseudoFold").alias("CalibrationFold")).distinct()
    keys = [*PELT_GROUP, "CalibrationFold"]
    rates = folds.join(one, PELT_GROUP).filter("PseudoFold <> CalibrationFold").groupBy(*keys, "Multiplier").agg(F.avg("hit").alias("FPR"), F.countDistinct("CandidateBlockID").alias("CalibrationBlocks"))
    chosen = choose_multiplier(rates, keys, target).join(rates.withColumnRenamed("FPR", "CalibrationFPR"), [*keys, "Multiplier"])
    held = one.withColumnRenamed("PseudoFold", "CalibrationFold").groupBy(*keys, "Multiplier").agg(F.avg("hit").alias("HeldoutFPR"), F.countDistinct("CandidateBlockID").alias("HeldoutBlocks"))
    return chosen.join(held, [*keys, "Multiplier"], "left")


def apply_multipliers(real: DataFrame, pseudo: DataFrame, chosen: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """Detections: pseudo rows at their own fold's multiplier, real ones at the grid value nearest to the median over the folds."""
    columns = [*PELT_GROUP, "Method", "BoundaryKind", "BoundaryID", "Subject", "PseudoCondition", "Multiplier", "Detected", "Latency_sec"]
    method = F.format_string("PELT_%s_crossfit", F.upper("Model"))
    medians = chosen.groupBy(*PELT_GROUP).agg(F.median("Multiplier").alias("wanted"))
    of_real = real.join(nearest_grid_value(medians, PELT_GROUP, list(grid)), [*PELT_GROUP, "Multiplier"]).withColumns({"BoundaryKind": F.lit("Real"), "PseudoCondition": F.lit(None).cast("string")})
    one = one_per_block(pseudo, [*PELT_GROUP, "PseudoFold", "Multiplier"]).withColumn("CalibrationFold", F.col("PseudoFold"))
    of_pseudo = one.join(chosen.select(*PELT_GROUP, "CalibrationFold", "Multiplier"), [*PELT_GROUP, "CalibrationFold", "Multiplier"]).withColumns({"BoundaryKind": F.lit("Pseudo"), "BoundaryID": F.col("PseudoMatchID")})
    return of_real.withColumn("Method", method).select(*columns).unionByName(of_pseudo.withColumn("Method", method).select(*columns))
