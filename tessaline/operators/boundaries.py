"""Session boundaries and their observations; pseudo-boundaries inside stable sessions and their matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions.arrays import thin
from tessaline.functions.scalars import hash_mod, number_text
from tessaline.operators.quality import quality_rows

EPSILON = 1e-6


def boundary_inventory(sessions: DataFrame) -> DataFrame:
    """Junctions of directly following sessions n and n + 1 of a subject; gaps in numbering make none."""
    following = W.partitionBy("Subject").orderBy("Session")
    after = lambda c: F.lead(c).over(following)
    direction = F.concat("PreConditionCode", F.lit("_to_"), "PostConditionCode")
    return (
        sessions.select(
            "Subject",
            F.col("Session").alias("PreSession"),
            after("Session").alias("PostSession"),
            F.col("ConditionCode").alias("PreConditionCode"),
            after("ConditionCode").alias("PostConditionCode"),
            F.col("SessionDuration_sec").alias("PreDuration_sec"),
            after("SessionDuration_sec").alias("PostDuration_sec"),
        )
        .filter("PostSession = PreSession + 1 and PreConditionCode <> PostConditionCode")
        .withColumn("TransitionType", direction)
        .withColumn("BoundaryOrder", F.col("PreSession"))
        .withColumn("BoundaryID", F.concat("Subject", F.lit("_B"), F.col("PreSession").cast("string"), F.lit("_"), "TransitionType"))
    )


def boundary_observations(windows: DataFrame, inventory: DataFrame, threshold: float, pre: float = 60.0, post: float = 60.0) -> DataFrame:
    """Quality windows near each boundary with their centre relative to it; those before have negative times."""
    rows = quality_rows(windows, threshold)
    keys = ["BoundaryID", "TransitionType", "BoundaryOrder", "PreSession", "PostSession"]
    inv = inventory.select("Subject", *keys)
    before = (
        rows.join(inv.withColumn("Session", F.col("PreSession")), ["Subject", "Session"])
        .withColumn("RelativeCenter_sec", F.col("CenterTime_sec") - F.col("SessionDuration_sec"))
        .filter(F.col("RelativeCenter_sec") >= -pre - EPSILON)
        .withColumn("Side", F.lit("pre"))
    )
    after = (
        rows.join(inv.withColumn("Session", F.col("PostSession")), ["Subject", "Session"])
        .withColumn("RelativeCenter_sec", F.col("CenterTime_sec"))
        .filter(F.col("RelativeCenter_sec") <= post + EPSILON)
        .withColumn("Side", F.lit("post"))
    )
    return before.unionByName(after)


def boundary_eligibility(observations: DataFrame, inventory: DataFrame, lengths: tuple[int, ...], least: int = 5) -> DataFrame:
    """Counts of each side by boundary and length; a boundary without observations counts 0 and 0."""
    counts = observations.groupBy("BoundaryID", "WindowLength_sec").agg(
        F.count_if(F.col("Side") == "pre").alias("PreCount"), F.count_if(F.col("Side") == "post").alias("PostCount")
    )
    every = inventory.select("BoundaryID", "Subject", "TransitionType", "BoundaryOrder").withColumn(
        "WindowLength_sec", F.explode(F.array(*[F.lit(n) for n in lengths]))
    )
    return (
        every.join(counts, ["BoundaryID", "WindowLength_sec"], "left")
        .na.fill(0, ["PreCount", "PostCount"])
        .withColumn("Eligible", (F.col("PreCount") >= least) & (F.col("PostCount") >= least))
    )


def common_boundaries(eligibility: DataFrame) -> DataFrame:
    """Boundaries that are eligible at every length (relational division)."""
    need = eligibility.select("WindowLength_sec").distinct().agg(F.count("*").alias("need"))
    have = eligibility.filter("Eligible").groupBy("BoundaryID", "Subject").agg(F.countDistinct("WindowLength_sec").alias("have"))
    return have.join(F.broadcast(need), have["have"] == need["need"]).select("BoundaryID", "Subject")


def pseudo_candidates(windows: DataFrame, threshold: float, pre: float = 60.0, post: float = 60.0, least: int = 5, separation: float = 120.0) -> DataFrame:
    """Times inside a session that are both a window's start and one's end, with enough windows on both sides.

    Kept times lie so far apart that the raw signal under their windows doesn't overlap: a greedy pass in
    order of time within each session, on an array of at most as many times as the session has windows.
    """
    keys = ["Subject", "Session", "ConditionCode", "WindowLength_sec"]
    rows = quality_rows(windows, threshold).select(*keys, "StartTime_sec", "EndTime_sec", "CenterTime_sec", "SessionDuration_sec")
    starts = rows.select(*keys, F.bround("StartTime_sec", 6).alias("t0"))
    ends = rows.select(*keys, F.bround("EndTime_sec", 6).alias("t0"))
    times = starts.join(ends, [*keys, "t0"], "left_semi").distinct()
    before = (F.col("EndTime_sec") <= F.col("t0") + EPSILON) & (F.col("CenterTime_sec") >= F.col("t0") - pre - EPSILON)
    after = (F.col("StartTime_sec") >= F.col("t0") - EPSILON) & (F.col("CenterTime_sec") <= F.col("t0") + post + EPSILON)
    dense = (
        times.join(rows, keys)
        .filter(before | after)
        .groupBy(*keys, "t0", "SessionDuration_sec")
        .agg(F.count_if(before).alias("PreCount"), F.count_if(after).alias("PostCount"))
        .filter((F.col("PreCount") >= least) & (F.col("PostCount") >= least))
    )
    gap = F.greatest(F.lit(separation), F.lit(pre + post) + F.col("WindowLength_sec"))
    name = F.concat("Subject", F.lit("_S"), F.col("Session").cast("string"), F.lit("_"), "ConditionCode")
    return (
        dense.groupBy(*keys, "SessionDuration_sec")
        .agg(F.array_sort(F.collect_list(F.struct("t0", "PreCount", "PostCount"))).alias("dense"))
        .withColumn("kept", thin(F.transform("dense", lambda d: d["t0"]), gap))
        .withColumn("DenseCandidates", F.size("dense"))
        .withColumn("IndependentCandidates", F.size("kept"))
        .select(*keys, "SessionDuration_sec", "dense", "DenseCandidates", "IndependentCandidates", F.posexplode("kept").alias("BlockIndex", "PseudoTime_sec"))
        .withColumn("own", F.get(F.filter("dense", lambda d: d["t0"] == F.col("PseudoTime_sec")), 0))
        .withColumn("PreCount", F.col("own.PreCount"))
        .withColumn("PostCount", F.col("own.PostCount"))
        .withColumn("CandidateBlockID", F.format_string("%s_BLK%03d", name, "BlockIndex"))
        .withColumn("CandidateID", F.concat(name, F.lit("_T"), number_text(F.col("PseudoTime_sec"))))
        .withColumn("RelativeSessionPosition", F.col("PseudoTime_sec") / F.greatest("SessionDuration_sec", F.lit(1e-12)))
        .drop("dense", "own")
    )


def assign_folds(candidates: DataFrame, folds: int = 4, seed: int = 42) -> DataFrame:
    """Whole blocks go to folds in turn within subject and condition, from an offset that a hash gives."""
    turn = W.partitionBy("WindowLength_sec", "Subject", "ConditionCode").orderBy("Session", "BlockIndex")
    offset = hash_mod(F.concat("Subject", F.lit("|"), "ConditionCode"), folds, seed)
    return candidates.withColumn("PseudoFold", F.pmod(F.row_number().over(turn) - 1 + offset, F.lit(folds)).cast("int"))


def match_controls(eligibility: DataFrame, inventory: DataFrame, candidates: DataFrame, per_boundary: int = 50) -> DataFrame:
    """The best pseudo-boundaries of the same subject for each eligible boundary and condition.

    MatchScore = 100 * difference in counts + 3 * distance of sessions + distance from the session's middle. The best
    of each block, then the best ``per_boundary`` in all; ties go by session, time and id.
    """
    real = eligibility.filter("Eligible").join(
        inventory.select("BoundaryID", "PreSession", "PostSession", "PreConditionCode"), "BoundaryID"
    ).select(
        "Subject", "WindowLength_sec", F.col("BoundaryID").alias("MatchedRealBoundaryID"), "TransitionType", "BoundaryOrder", "PreSession", "PostSession", "PreConditionCode",
        F.col("PreCount").alias("TargetPreCount"), F.col("PostCount").alias("TargetPostCount"),
    )
    pool = assign_folds(candidates).withColumnsRenamed(
        {"ConditionCode": "PseudoCondition", "Session": "PseudoSession", "PreCount": "PseudoPreCount", "PostCount": "PseudoPostCount"}
    ).drop("SessionDuration_sec", "DenseCandidates", "IndependentCandidates")
    scored = (
        real.join(pool, ["Subject", "WindowLength_sec"])
        .withColumn("TargetSession", F.when(F.col("PreConditionCode") == F.col("PseudoCondition"), F.col("PreSession")).otherwise(F.col("PostSession")))
        .withColumn("CountMismatch", F.abs(F.col("PseudoPreCount") - F.col("TargetPreCount")) + F.abs(F.col("PseudoPostCount") - F.col("TargetPostCount")))
        .withColumn("SessionDistance", F.abs(F.col("PseudoSession") - F.col("TargetSession")))
        .withColumn("PositionDistance", F.abs(F.col("RelativeSessionPosition") - 0.5))
        .withColumn("MatchScore", F.bround(100.0 * F.col("CountMismatch") + 3.0 * F.col("SessionDistance") + F.col("PositionDistance"), 9))
    )
    boundary = ["WindowLength_sec", "MatchedRealBoundaryID", "PseudoCondition"]
    in_block = W.partitionBy(*boundary, "CandidateBlockID").orderBy("MatchScore", "CandidateID")
    overall = W.partitionBy(*boundary).orderBy("MatchScore", "PseudoSession", "PseudoTime_sec", "CandidateID")
    return (
        scored.withColumn("in_block", F.row_number().over(in_block))
        .filter("in_block = 1")
        .withColumn("MatchRank", F.row_number().over(overall))
        .filter(F.col("MatchRank") <= per_boundary)
        .withColumn("PseudoMatchID", F.concat_ws("__", "MatchedRealBoundaryID", "PseudoCondition", "CandidateID"))
        .drop("in_block", "PreSession", "PostSession", "PreConditionCode", "BlockIndex")
    )


def match_audit(eligibility: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """For each eligible boundary and condition how many blocks there were and how many were taken."""
    real = eligibility.filter("Eligible").select("WindowLength_sec", F.col("BoundaryID").alias("MatchedRealBoundaryID"), "Subject")
    real = real.withColumn("PseudoCondition", F.explode(F.array(F.lit("A"), F.lit("NA"))))
    pool = candidates.groupBy("WindowLength_sec", "Subject", F.col("ConditionCode").alias("PseudoCondition")).agg(F.countDistinct("CandidateBlockID").alias("AvailableBlocks"))
    chosen = matches.groupBy("WindowLength_sec", "MatchedRealBoundaryID", "PseudoCondition").agg(F.count("*").alias("SelectedControls"))
    return (
        real.join(pool, ["WindowLength_sec", "Subject", "PseudoCondition"], "left")
        .join(chosen, ["WindowLength_sec", "MatchedRealBoundaryID", "PseudoCondition"], "left")
        .na.fill(0, ["AvailableBlocks", "SelectedControls"])
    )


def pseudo_observations(windows: DataFrame, candidates: DataFrame, threshold: float, pre: float = 60.0, post: float = 60.0) -> DataFrame:
    """Quality windows around each pseudo-boundary with their centre relative to it."""
    keys = ["Subject", "Session", "ConditionCode", "WindowLength_sec"]
    t0 = F.col("PseudoTime_sec")
    before = (F.col("EndTime_sec") <= t0 + EPSILON) & (F.col("CenterTime_sec") >= t0 - pre - EPSILON)
    after = (F.col("StartTime_sec") >= t0 - EPSILON) & (F.col("CenterTime_sec") <= t0 + post + EPSILON)
    return (
        quality_rows(windows, threshold)
        .join(candidates.select(*keys, "CandidateID", "CandidateBlockID", "PseudoTime_sec"), keys)
        .filter(before | after)
        .withColumn("RelativeCenter_sec", F.col("CenterTime_sec") - t0)
        .withColumn("Side", F.when(before, "pre").otherwise("post"))
    )
