"""Queries over all configurations of a study, and over tables made from its results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.checks.ctes import GROUP, KINDKEYS, grid_sql
from tessaline.checks.more import magnitude
from tessaline.checks.queries import _CON, _DK, _FK, _MAGNITUDE, COMPARED, ORACLE, PV, RESULT, cols, flip_sql, query
from tessaline.config import SCORE_METHODS
from tessaline.operators import calibration as C
from tessaline.operators import inference as I
from tessaline.operators import reports
from tessaline.plans.study import Study


def grid_query(name: str, select: str, doubles: str, table: Callable[[Study], DataFrame]) -> None:
    """A table of the study in every configuration, and the SQL of each."""
    query(name)(lambda s: s.over(table))
    ORACLE[name] = grid_sql(select, doubles)


RATES = f"SELECT {KINDKEYS}, Participants, Boundaries, Detections, DetectionRate, MedianLatency, Q1Latency, Q3Latency, MedianScore FROM rates"
RATE_DOUBLES = "DetectionRate MedianLatency Q1Latency Q3Latency MedianScore"
PAIR_DOUBLES = "RealDetected RealScore RealLatency PseudoDetected PseudoScore PseudoLatency"
grid_query("cal2_by_configuration", "SELECT * FROM thresholds", "Threshold HeldoutFPR", lambda t: t.thresholds)
grid_query("cal3_by_configuration", f"SELECT {cols(*RESULT)} FROM results", "MatchScore Score Threshold Latency_sec", lambda t: t.results.select(*RESULT))
grid_query("cal5_by_configuration", f"SELECT {cols(*PV)} FROM p_values", "RealScore PseudoMedianScore PseudoQ95Score EmpiricalPValue RealMinusPseudoMedian EmpiricalQValue_BH", lambda t: t.p_values.select(*PV))
grid_query("agg8_by_configuration", RATES, RATE_DOUBLES, lambda t: I.detection_rates(t.results))
grid_query("jn8_by_configuration", "SELECT PseudoMatchID, WindowLength_sec, SearchWindow, Method, Score FROM expanded", "Score", lambda t: t.expanded.select("PseudoMatchID", "WindowLength_sec", "SearchWindow", "Method", "Score"))
grid_query("jn10_by_configuration", "SELECT * EXCLUDE (PseudoCondition) FROM pairs WHERE PseudoCondition = 'A'", PAIR_DOUBLES, lambda t: I.real_pseudo_pairs(t.results, "A"))


@query("rpt6_quality_sensitivity")
def sensitivity(s: Study):
    return reports.quality_sensitivity(s.over(lambda t: I.detection_rates(t.results)))


ORACLE["rpt6_quality_sensitivity"] = f"""SELECT RRThreshold, Representation, WindowLength_sec, round(try_cast(avg(DetectionRate) AS DECIMAL(38,9)), 6)::DOUBLE AS MeanRate, sum(Boundaries)::BIGINT AS Boundaries
FROM ({grid_sql('SELECT WindowLength_sec, BoundaryKind, DetectionRate, Boundaries FROM rates')}) WHERE BoundaryKind = 'Real' GROUP BY ALL"""

# ---- joins and aggregates of results

query(
    "jn9_pseudo_effects",
    """SELECT CandidateBlockID, PseudoCondition, TransitionType, Feature, WindowLength_sec, Subject, CandidateID, MatchedRealBoundaryID, MatchScore, ZChange FROM (
    SELECT *, row_number() OVER (PARTITION BY CandidateBlockID, PseudoCondition, TransitionType, Feature, WindowLength_sec ORDER BY MatchScore, MatchRank, PseudoMatchID) AS turn FROM matches m
    JOIN (SELECT CandidateID, WindowLength_sec, Feature, median(z) FILTER (RelativeCenter_sec >= 0) - median(z) FILTER (RelativeCenter_sec < 0) AS ZChange FROM long_pseudo GROUP BY ALL) e USING (CandidateID, WindowLength_sec)) WHERE turn = 1""",
    "MatchScore ZChange",
)(lambda s: I.pseudo_effects(s.matches, I.z_effects(s.long_pseudo, ["CandidateID"])))
query("agg7_z_effects", "SELECT BoundaryID, Subject, TransitionType, BoundaryOrder, WindowLength_sec, Feature, ZChange, abs(ZChange) AS AbsZChange FROM (SELECT BoundaryID, Subject, TransitionType, BoundaryOrder, WindowLength_sec, Feature, median(z) FILTER (RelativeCenter_sec >= 0) - median(z) FILTER (RelativeCenter_sec < 0) AS ZChange FROM long_real GROUP BY ALL)", "ZChange AbsZChange")(
    lambda s: I.z_effects(s.long_real, ["BoundaryID", "Subject", "TransitionType", "BoundaryOrder"])
)
_BLOCK = f"{GROUP}, PseudoFold, CandidateBlockID, PseudoCondition"
query(
    "agg10_first_known",
    f"SELECT {_BLOCK}, arg_min(Score, (MatchScore, MatchRank, PseudoMatchID)) FILTER (Score IS NOT NULL) AS Score, arg_min(Late, (MatchScore, MatchRank, PseudoMatchID)) FILTER (Late IS NOT NULL) AS Late FROM (SELECT *, CASE WHEN MatchRank % 2 = 0 THEN CandidateLatency_sec END AS Late FROM expanded) GROUP BY ALL",
    "Score Late",
)(
    lambda s: I.first_known(
        s.expanded.withColumn("Late", F.when(F.col("MatchRank") % 2 == 0, F.col("CandidateLatency_sec"))),
        [*C.GROUP, "PseudoFold", "CandidateBlockID", "PseudoCondition"],
        ["MatchScore", "MatchRank", "PseudoMatchID"],
        ["Score", "Late"],
    )
)
query("agg26_mode", f"SELECT {GROUP}, arg_max(SplitIndex, (n, -SplitIndex)) AS Mode, max(n) / sum(n)::DOUBLE AS ModeProbability FROM (SELECT {GROUP}, SplitIndex, count(*) AS n FROM real_scores GROUP BY ALL) GROUP BY ALL", "ModeProbability")(
    lambda s: I.mode_of(s.real_scores, C.GROUP, "SplitIndex")
)
query("jn17_common_subjects", "SELECT WindowLength_sec, Subject FROM long_real WHERE TransitionType = 'A_to_NA' INTERSECT SELECT WindowLength_sec, Subject FROM long_real WHERE TransitionType = 'NA_to_A'")(
    lambda s: s.long_real.filter("TransitionType = 'A_to_NA'").select("WindowLength_sec", "Subject").intersect(s.long_real.filter("TransitionType = 'NA_to_A'").select("WindowLength_sec", "Subject"))
)
_POINTS = f"SELECT WindowLength_sec, TransitionType, Subject, avg(MahalanobisMagnitude) AS MeanMagnitude, avg(MeanAbsChange) AS MeanAbsChange, count(*) AS Boundaries FROM ({_MAGNITUDE}) JOIN inventory USING (BoundaryID) GROUP BY ALL"
query("agg21_magnitude_points", _POINTS, "MeanMagnitude MeanAbsChange", primary=True)(lambda s: reports.magnitude_points(magnitude(s).join(s.inventory.select("BoundaryID", "TransitionType", "Subject"), "BoundaryID")))

# ---- reports

_MTEST = f"SELECT WindowLength_sec, Outcome, MeanDifference, PermutationP FROM ({flip_sql(_CON, _DK, 'direction')}) WHERE Method = 'CovIC_crossfit' AND SearchWindow = 'post_only' AND Outcome IN ('MahalanobisMagnitude', 'MeanAbsChange')"
query(
    "rpt13_magnitude_tests",
    f"""SELECT WindowLength_sec, Outcome, MeanDifference, PermutationP, least(1, max((m - r + 1) * PermutationP) OVER (PARTITION BY Outcome ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS P_Holm
    FROM (SELECT *, row_number() OVER (PARTITION BY Outcome ORDER BY PermutationP) AS r, count(*) OVER (PARTITION BY Outcome) AS m FROM ({_MTEST}))""",
    "MeanDifference PermutationP P_Holm",
    primary=True,
)(
    lambda s: reports.holm_over_windows(
        reports.primary(I.direction_contrast(s.results, magnitude(s)).filter("Outcome in ('MahalanobisMagnitude', 'MeanAbsChange')")).select("WindowLength_sec", "Outcome", "MeanDifference", "PermutationP"), "PermutationP", ["Outcome"]
    )
)
_EFFECT_COLUMNS = [*[c.strip() for c in _FK.split(",")], "RealRate", "PseudoRate", "RiskDifference", "Detected_P"]
query("rpt14_effect_table", f"SELECT {cols(*_EFFECT_COLUMNS)} FROM ({COMPARED}) WHERE Method = 'CovIC_crossfit' AND SearchWindow = 'post_only'", "RealRate PseudoRate RiskDifference Detected_P", primary=True)(
    lambda s: reports.primary(I.compare_real_pseudo(s.results)).select(*_EFFECT_COLUMNS)
)
_ORDER = " ".join(f"WHEN '{m.replace('_fixed6', '')}' THEN {i}" for i, m in enumerate(SCORE_METHODS))
query("srt5_method_order", f"SELECT DISTINCT Method, CASE regexp_replace(Method, '_(crossfit|fixed6)$', '') {_ORDER} ELSE {len(SCORE_METHODS)} END::INT AS MethodPlace FROM results")(
    lambda s: reports.in_method_order(s.results, [m.replace("_fixed6", "") for m in SCORE_METHODS]).select("Method", "MethodPlace").distinct()
)
query("rpt18_legacy_false_positives", "SELECT WindowLength_sec, SearchWindow, TransitionType, PseudoCondition, Boundaries, DetectionRate AS FalsePositiveRate FROM rates WHERE BoundaryKind = 'Pseudo' AND Method = 'LegacyBIC_fixed6'", "FalsePositiveRate")(
    lambda s: reports.legacy_false_positives(I.detection_rates(s.results))
)
query(
    "snk8_text_summary",
    """SELECT WindowLength_sec, TransitionType, BoundaryKind, c AS Condition, printf('%d s, %s, %s (%s): %d of %d detected (%.1f %%)', WindowLength_sec, TransitionType, BoundaryKind, c, Detections, Boundaries, round(100 * DetectionRate, 1)) AS Line
    FROM (SELECT *, coalesce(PseudoCondition, '-') AS c FROM rates WHERE Method = 'CovIC_crossfit' AND SearchWindow = 'post_only')""",
    primary=True,
)(lambda s: reports.text_summary(I.detection_rates(s.results)))
query("snk9_manifest")(lambda s: reports.manifest({"thresholds": s.thresholds, "results": s.results, "p_values": s.p_values}))
query(
    "agg28_duplicated_rows",
    "SELECT Subject, Session, WindowLength_sec, WindowIndex, count(*) AS copies FROM (SELECT * FROM master UNION ALL SELECT * FROM master WHERE WindowIndex % 3 = 0) GROUP BY ALL HAVING count(*) > 1",
)(lambda s: duplicated(s))


def duplicated(s: Study):
    """Every third window stands twice here, so that there is something to find."""
    from tessaline.operators.quality import duplicate_keys

    return duplicate_keys(s.master.unionByName(s.master.filter("WindowIndex % 3 = 0")))
