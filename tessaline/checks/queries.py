"""Queries of the session engine by name, each with the SQL that it must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.checks.ctes import GROUP, KINDKEYS, sql
from tessaline.config import ALL23, HEART_RATE
from tessaline.functions import arrays as A
from tessaline.functions.order import group_quantile
from tessaline.operators import boundaries as B
from tessaline.operators import calibration as C
from tessaline.operators import detectors as D
from tessaline.operators import inference as I
from tessaline.operators import normalize as N
from tessaline.operators import quality as Q
from tessaline.operators import windows as WN
from tessaline.plans.study import PRIMARY, THRESHOLD, Study, study
from tessaline.sources import sessions as SRC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, and to 3 from 1,000 on, so that sums taken in another order compare equal.

    Decimals do it, half up: first to 9 digits, where the last bits of a double no longer tell, then to the wanted ones.
    """
    short = lambda c: F.expr(f"cast(CASE WHEN abs({c}) < 1000 THEN round(try_cast({c} AS DECIMAL(38,9)), 6) ELSE round(try_cast({c} AS DECIMAL(38,9)), 3) END AS DOUBLE)")
    return df.select(*[short(f"`{c}`").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, select: str | None = None, doubles: str = "", primary: bool = False):
    """Registers a function of the study (or of the session and the folder) and its SQL; ``primary``: of the study's configuration that is reported first."""

    def register(fn: Callable) -> Callable:
        wants_study = fn.__code__.co_varnames[:1] == ("s",)
        of = lambda s: s.primary() if primary else s
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(of(study(spark, sf_dir))) if wants_study else fn(spark, sf_dir))
        if select is not None:
            ORACLE[name] = sql(select, doubles, *PRIMARY) if primary else sql(select, doubles)
        return fn

    return register


def cols(*names: str) -> str:
    return ", ".join(names)


MEANS = ", ".join(f"avg({c}) AS mean_{c}" for c in ALL23)
MEAN_NAMES = " ".join(f"mean_{c}" for c in ALL23)


# ---- windows, features, quality


@query(
    "agg1_feature_summary",
    f"""SELECT WindowLength_sec, StepSize_sec, OverlapPercent, ConditionCode, count(*) AS windows, sum(WindowValid::INT)::BIGINT AS valid_windows, count(DISTINCT Subject) AS subjects,
    count(DISTINCT (Subject, Session)) AS sessions, {MEANS}, (count(*) - sum(WindowValid::INT))::BIGINT AS invalid_windows, 100e0 * sum(WindowValid::INT) / count(*) AS valid_percent FROM master GROUP BY ALL""",
    f"OverlapPercent valid_percent {MEAN_NAMES}",
)
def feature_summary(s: Study):
    return Q.feature_summary(s.master)


MASTER_SHOWN = ["WindowID", "Subject", "Session", "ConditionCode", "WindowLength_sec", "WindowIndex", "StartTime_sec", "EndTime_sec", "CenterTime_sec", "Num_Samples", "Num_RR_Clean", "RR_Invalid", "RR_HampelOutliers", "RR_Corrected", "RR_CorrectedPercent", "WindowValid", "WindowFailureReason", *ALL23]


@query("fx12_master_table", f"SELECT {cols(*MASTER_SHOWN)} FROM master", f"StartTime_sec EndTime_sec CenterTime_sec RR_CorrectedPercent {' '.join(ALL23)}")
def master_table(s: Study):
    return s.master.select(*MASTER_SHOWN)


for _name, _features in (("fx1_amplitude", ALL23[:6]), ("fx5_heart_rate", HEART_RATE), ("fx6_time_domain", ALL23[11:18]), ("fx7_poincare", ALL23[18:])):
    query(_name, f"SELECT WindowID, {cols(*_features)} FROM master WHERE WindowLength_sec = 30", " ".join(_features))(
        lambda s, f=tuple(_features): s.master.filter("WindowLength_sec = 30").select("WindowID", *f)
    )

query("fx3_rr_cleaning", "SELECT WindowID, RR_Invalid, RR_HampelOutliers, RR_Corrected, RR_CorrectedPercent FROM master", "RR_CorrectedPercent")(
    lambda s: s.master.select("WindowID", "RR_Invalid", "RR_HampelOutliers", "RR_Corrected", "RR_CorrectedPercent")
)


@query(
    "win5_hampel_native",
    """SELECT Subject, Session, i::INT AS place, rr, odd AS outlier, nn AS clean FROM rr_clean WHERE WindowLength_sec = 60 AND WindowIndex = 0""",
    "rr clean",
)
def hampel_native(s: Study):
    """The same cleaning by higher-order functions alone, on each session's first window."""
    first = s.samples.filter("t < 60").groupBy("Subject", "Session").agg(F.array_sort(F.collect_list(F.struct("t", "x", "rr"))).alias("v"))
    rr = first.select("Subject", "Session", F.transform("v", lambda r: r["rr"]).alias("rr"))
    valid = F.transform("rr", lambda v: F.when((v >= 300) & (v <= 2000), v))
    flagged = rr.withColumn("valid", valid).withColumn("odd", A.hampel_outliers(F.col("valid")))
    clean = A.interpolate(F.zip_with("valid", "odd", lambda v, o: F.when(~o, v)))
    return flagged.withColumn("clean", clean).select("Subject", "Session", F.posexplode(F.arrays_zip("rr", "odd", "clean")).alias("i", "r")).select(
        "Subject", "Session", (F.col("i") + 1).alias("place"), "r.rr", F.col("r.odd").alias("outlier"), "r.clean"
    )


query("win1_assign_windows", "SELECT Subject, Session, WindowLength_sec, WindowIndex, count(*) AS n, sum(x) AS total FROM assigned GROUP BY ALL", "total")(
    lambda s: WN.assign_windows(s.samples, (30, 45, 60), 5, 360.0).groupBy("Subject", "Session", "WindowLength_sec", "WindowIndex").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
)
query(
    "win2_window_count",
    "SELECT o_orderkey, CASE WHEN o_orderkey < 30 * 2 THEN 0 ELSE 1 + (o_orderkey - 60) // 10 END::BIGINT AS windows FROM orders",
)(lambda spark, d: SRC.read(spark, d, "orders").select("o_orderkey", WN.window_count(F.col("o_orderkey"), 2.0, 30, 5).alias("windows")))
query(
    "win3_multi_resolution_grid",
    "SELECT Subject, Session, WindowLength_sec, count(*) AS windows, max(EndTime_sec) AS last_end FROM master GROUP BY ALL",
    "last_end",
)(lambda s: s.master.groupBy("Subject", "Session", "WindowLength_sec").agg(F.count("*").alias("windows"), F.max("EndTime_sec").alias("last_end")))
query(
    "win4_successive_difference",
    "SELECT Subject, Session, t, rr - lag(rr) OVER (PARTITION BY Subject, Session ORDER BY t, x) AS step FROM samples",
    "t step",
)(lambda s: s.samples.select("Subject", "Session", "t", SRC.lag_step("rr").alias("step")))
query(
    "win6_running_sum",
    "SELECT Subject, Session, t, sum(x) OVER (PARTITION BY Subject, Session ORDER BY t, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM samples",
    "t total",
)(lambda s: s.samples.select("Subject", "Session", "t", SRC.running_sum("x").alias("total")))
query("src4_sampling_rate", "SELECT Subject, Session, 1 / median(d) AS rate FROM (SELECT *, t - lag(t) OVER (PARTITION BY Subject, Session ORDER BY t) AS d FROM samples) WHERE d > 0 GROUP BY ALL", "rate")(
    lambda s: SRC.sampling_rate(s.samples)
)
query(
    "agg2_configuration_audit",
    "SELECT WindowLength_sec, StepSize_sec, count(*) AS rows, sum(WindowValid::INT)::BIGINT AS valid, count(DISTINCT Subject) AS subjects, count(DISTINCT (Subject, Session)) AS sessions, avg(RR_CorrectedPercent) AS mean_corrected, median(RR_CorrectedPercent) AS median_corrected FROM master GROUP BY ALL",
    "mean_corrected median_corrected",
)(lambda s: Q.configuration_audit(s.master))
query("agg3_session_inventory", "SELECT * FROM sessions", "SessionDuration_sec")(lambda s: s.sessions)
_over = ", ".join(f"count(*) FILTER (RR_CorrectedPercent > {t}) AS over_{t}" for t in (5, 10, 20))
_whole = " AND ".join(f"{c} IS NOT NULL" for c in ALL23)
query(
    "agg4_quality_by_threshold",
    f"""SELECT WindowLength_sec, RRThreshold, ConditionCode, count(*) AS windows, sum(coalesce(WindowValid AND RR_CorrectedPercent <= RRThreshold AND {_whole}, false)::INT)::BIGINT AS passed,
    avg(RR_CorrectedPercent) AS mean_corrected, median(RR_CorrectedPercent) AS median_corrected, quantile_cont(RR_CorrectedPercent, 0.25) AS q1_corrected, quantile_cont(RR_CorrectedPercent, 0.75) AS q3_corrected,
    {_over}, sum(RR_Invalid)::BIGINT AS invalid_rr, sum(RR_HampelOutliers)::BIGINT AS hampel_rr, 100e0 * sum(coalesce(WindowValid AND RR_CorrectedPercent <= RRThreshold AND {_whole}, false)::INT) / count(*) AS passed_percent
    FROM master, (SELECT unnest([5e0, 10e0, 20e0]) AS RRThreshold) GROUP BY ALL""",
    "RRThreshold mean_corrected median_corrected q1_corrected q3_corrected passed_percent",
)(lambda s: Q.quality_by_threshold(s.master, (5.0, 10.0, 20.0)))
query(
    "agg5_quality_by_subject",
    f"SELECT Subject, WindowLength_sec, count(*) AS windows, sum(coalesce(WindowValid AND RR_CorrectedPercent <= 20 AND {_whole}, false)::INT)::BIGINT AS passed, avg(RR_CorrectedPercent) AS mean_corrected FROM master GROUP BY ALL",
    "mean_corrected",
)(lambda s: Q.quality_by_subject(s.master, THRESHOLD))
query("agg6_exclusion_reasons", "SELECT WindowLength_sec, CASE WHEN WindowFailureReason = '' THEN 'none' ELSE WindowFailureReason END AS reason, count(*) AS windows FROM master GROUP BY ALL")(
    lambda s: Q.exclusion_reasons(s.master)
)
query("agg28_duplicate_keys", "SELECT Subject, Session, WindowLength_sec, WindowIndex, count(*) AS copies FROM master GROUP BY ALL HAVING count(*) > 1")(lambda s: Q.duplicate_keys(s.master))
query("flt1_quality_mask", "SELECT WindowID FROM quality")(lambda s: Q.quality_rows(s.master, THRESHOLD).select("WindowID"))
query("flt2_stable_rows", "SELECT WindowID FROM quality WHERE StartTime_sec >= 60 AND EndTime_sec <= SessionDuration_sec - 60")(lambda s: Q.stable_rows(s.master, THRESHOLD, 60.0).select("WindowID"))
query("flt3_configuration_slice", "SELECT WindowID FROM master WHERE WindowLength_sec = 30 AND StepSize_sec = 5")(lambda s: s.master.filter("WindowLength_sec = 30 and StepSize_sec = 5").select("WindowID"))
query("flt4_thinned_windows", "SELECT WindowID FROM (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY WindowLength_sec) >= 100 AS enough FROM (SELECT *, WindowIndex % ceil(WindowLength_sec / StepSize_sec) = 0 AS apart FROM quality)) WHERE apart OR NOT enough")(lambda s: Q.thinned(Q.quality_rows(s.master, THRESHOLD)).select("WindowID"))
query("flt5_complete_cases", "SELECT WindowID FROM master WHERE SDNN IS NOT NULL AND CVI IS NOT NULL")(lambda s: s.master.dropna(subset=["SDNN", "CVI"]).select("WindowID"))
query("flt11_valid_only", "SELECT WindowID FROM master WHERE WindowValid")(lambda s: s.master.filter("WindowValid").select("WindowID"))
query("prj2_overlap_times", "SELECT WindowID, OverlapPercent, CenterTime_sec FROM master", "OverlapPercent CenterTime_sec")(lambda s: s.master.select("WindowID", "OverlapPercent", "CenterTime_sec"))
query("prj3_failure_reasons", "SELECT WindowID, WindowFailureReason FROM master WHERE WindowFailureReason <> ''")(lambda s: s.master.filter("WindowFailureReason <> ''").select("WindowID", "WindowFailureReason"))
query("prj4_unpivot", "SELECT WindowID, 'MeanRR' AS Feature, MeanRR AS value FROM master WHERE MeanRR IS NOT NULL UNION ALL SELECT WindowID, 'MeanHR', MeanHR FROM master WHERE MeanHR IS NOT NULL", "value")(
    lambda s: N.unpivot(s.master, ["WindowID"], ["MeanRR", "MeanHR"])
)
query("srt1_master_order", "SELECT WindowID, row_number() OVER (ORDER BY Subject, Session, WindowLength_sec, WindowIndex)::INT AS place FROM master WHERE WindowLength_sec = 60")(
    lambda s: SRC.placed(s.master.filter("WindowLength_sec = 60"), ["Subject", "Session", "WindowLength_sec", "WindowIndex"]).select("WindowID", "place")
)

# ---- boundaries and pseudo-boundaries

query("jn1_boundary_inventory", "SELECT * FROM inventory", "PreDuration_sec PostDuration_sec")(lambda s: s.inventory)
query("jn2_boundary_observations", "SELECT BoundaryID, WindowID, RelativeCenter_sec, Side FROM obs", "RelativeCenter_sec")(lambda s: s.observations.select("BoundaryID", "WindowID", "RelativeCenter_sec", "Side"))
query("bnd1_eligibility", "SELECT * FROM elig")(lambda s: s.eligibility)
query("agg18_common_boundaries", "SELECT BoundaryID, Subject FROM elig WHERE Eligible GROUP BY ALL HAVING count(DISTINCT WindowLength_sec) = 3")(lambda s: B.common_boundaries(s.eligibility))
query("bnd2_pseudo_candidates", "SELECT * FROM cand", "SessionDuration_sec PseudoTime_sec RelativeSessionPosition")(lambda s: s.candidates)
query(
    "jn4_candidate_times",
    "SELECT Subject, Session, ConditionCode, WindowLength_sec, round_even(StartTime_sec, 6) AS t0 FROM quality INTERSECT SELECT Subject, Session, ConditionCode, WindowLength_sec, round_even(EndTime_sec, 6) FROM quality",
    "t0",
)(lambda s: SRC.common_times(Q.quality_rows(s.master, THRESHOLD)))
query("win9_folds", "SELECT CandidateBlockID, CandidateID, WindowLength_sec, PseudoFold FROM folds")(lambda s: B.assign_folds(s.candidates).select("CandidateBlockID", "CandidateID", "WindowLength_sec", "PseudoFold"))
query("win10_greedy_thinning", "SELECT Subject, Session, WindowLength_sec, k::INT AS BlockIndex, t0 AS PseudoTime_sec FROM thin WHERE t0 IS NOT NULL", "PseudoTime_sec")(
    lambda s: s.candidates.select("Subject", "Session", "WindowLength_sec", "BlockIndex", "PseudoTime_sec")
)
MATCHED = ["WindowLength_sec", "MatchedRealBoundaryID", "PseudoCondition", "CandidateID", "PseudoFold", "TargetSession", "CountMismatch", "SessionDistance", "PositionDistance", "MatchScore", "MatchRank", "PseudoMatchID"]
query("bnd5_matches", f"SELECT {cols(*MATCHED)} FROM matches", "PositionDistance MatchScore")(lambda s: s.matches.select(*MATCHED))
query("jn6_best_match", "SELECT WindowLength_sec, MatchedRealBoundaryID, PseudoCondition, CandidateID, MatchScore FROM matches WHERE MatchRank = 1", "MatchScore")(
    lambda s: s.matches.filter("MatchRank = 1").select("WindowLength_sec", "MatchedRealBoundaryID", "PseudoCondition", "CandidateID", "MatchScore")
)
query(
    "bnd5_match_audit",
    """SELECT e.WindowLength_sec, e.BoundaryID AS MatchedRealBoundaryID, c.PseudoCondition, e.Subject, coalesce((SELECT count(DISTINCT CandidateBlockID) FROM cand x WHERE x.Subject = e.Subject AND x.WindowLength_sec = e.WindowLength_sec AND x.ConditionCode = c.PseudoCondition), 0) AS AvailableBlocks,
    coalesce((SELECT count(*) FROM matches m WHERE m.MatchedRealBoundaryID = e.BoundaryID AND m.WindowLength_sec = e.WindowLength_sec AND m.PseudoCondition = c.PseudoCondition), 0) AS SelectedControls
    FROM elig e, (SELECT unnest(['A', 'NA']) AS PseudoCondition) c WHERE e.Eligible""",
)(lambda s: B.match_audit(s.eligibility, s.candidates, s.matches))
query("bnd6_pseudo_observations", "SELECT CandidateID, WindowID, RelativeCenter_sec FROM pobs", "RelativeCenter_sec")(lambda s: s.pseudo_obs.select("CandidateID", "WindowID", "RelativeCenter_sec"))

# ---- normalisation

for _kind, _table in (("real", "norm_real"), ("pseudo", "norm_pseudo")):
    query(f"nrm4_parameters_{_kind}", f"SELECT * FROM norm_{_kind}", "centre scale")(lambda s, t=_table: getattr(s, t))
query(
    "nrm1_robust_scale",
    """SELECT event_type, n, centre, CASE WHEN md > 1e-12 THEN md WHEN iq > 1e-12 THEN iq WHEN sd > 1e-12 THEN sd ELSE 1 END AS scale, CASE WHEN md > 1e-12 THEN 'MAD' WHEN iq > 1e-12 THEN 'IQR' WHEN sd > 1e-12 THEN 'SD' ELSE 'constant_fallback' END AS method
    FROM (SELECT event_type, count(value) AS n, median(value) AS centre, 1.4826 * mad(value) AS md, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS iq, stddev_samp(value) AS sd FROM events GROUP BY ALL)""",
    "centre scale",
)(lambda spark, d: N.robust_scale(SRC.read(spark, d, "events"), ["event_type"]).select("event_type", "n", "centre", "scale", "method"))
query("nrm2_sources", "SELECT NormKey, WindowLength_sec, NormSource, count(*) AS rows FROM src_real GROUP BY ALL")(
    lambda s: N.normalisation_source(s.master, N.exclusion_keys_of_boundaries(s.inventory), THRESHOLD, 60.0).groupBy("NormKey", "WindowLength_sec", "NormSource").agg(F.count("*").alias("rows"))
)
query("nrm3_balanced_sample", "SELECT NormKey, WindowID FROM sample_real")(
    lambda s: N.balanced_sample(N.normalisation_source(s.master, N.exclusion_keys_of_boundaries(s.inventory), THRESHOLD, 60.0)).select("NormKey", "WindowID")
)
query("nrm5_z_scores", "SELECT BoundaryID, WindowLength_sec, RelativeCenter_sec, Feature, z FROM long_real", "RelativeCenter_sec z")(lambda s: s.long_real.select("BoundaryID", "WindowLength_sec", "RelativeCenter_sec", "Feature", "z"))
query("nrm6_crossfit_z", "SELECT CandidateID, WindowLength_sec, RelativeCenter_sec, Feature, z FROM long_pseudo", "RelativeCenter_sec z")(lambda s: s.long_pseudo.select("CandidateID", "WindowLength_sec", "RelativeCenter_sec", "Feature", "z"))

# ---- detectors

for _kind, _key in (("real", "BoundaryID"), ("pseudo", "CandidateID")):
    for _id, _method in (("cp2_legacy_bic", "LegacyBIC_fixed6"), ("cp4_binseg_l2", "BinSeg_L2"), ("cp6_cusum", "CUSUM"), ("cp7_mosum", "MOSUM")):
        query(f"{_id}_{_kind}", f"SELECT {_key}, WindowLength_sec, SearchWindow, Method, Score, SplitIndex, CandidateLatency_sec FROM scores_{_kind} WHERE Method = '{_method}'", "Score CandidateLatency_sec")(
            lambda s, t=f"{_kind}_scores", k=_key, m=_method: getattr(s, t).filter(F.col("Method") == m).select(k, "WindowLength_sec", "SearchWindow", "Method", "Score", "SplitIndex", "CandidateLatency_sec")
        )
query("cp1_pre_standardise", "SELECT BoundaryID, WindowLength_sec, Feature, idx::INT AS idx, z FROM std_real", "z")(
    lambda s: D.pre_standardised(D.index_series(s.long_real, ["BoundaryID", "WindowLength_sec"]), ["BoundaryID", "WindowLength_sec"]).select("BoundaryID", "WindowLength_sec", "Feature", "idx", "z")
)
query("flt6_candidate_splits", "SELECT BoundaryID, WindowLength_sec, SearchWindow, count(*) AS splits FROM cost_real GROUP BY ALL")(
    lambda s: D.candidate_splits(D.index_series(s.long_real, ["BoundaryID", "WindowLength_sec"]).filter("Feature = 'MeanRR'"), ["BoundaryID", "WindowLength_sec"], 5).groupBy("BoundaryID", "WindowLength_sec", "SearchWindow").agg(F.count("*").alias("splits"))
)
_SIZE = """SELECT BoundaryID, WindowLength_sec, sqrt(sum(d * d)) AS MahalanobisMagnitude FROM
    (SELECT BoundaryID, WindowLength_sec, Feature, avg(z) FILTER (t >= 0) - avg(z) FILTER (t < 0) AS d FROM white_real GROUP BY ALL) GROUP BY ALL"""
_SHIFT = """SELECT BoundaryID, WindowLength_sec, avg(abs(d)) AS MeanAbsChange, max(d) FILTER (k = 0) AS FirstChange FROM
    (SELECT BoundaryID, WindowLength_sec, k, avg(z) FILTER (RelativeCenter_sec >= 0) - avg(z) FILTER (RelativeCenter_sec < 0) AS d FROM long_real JOIN columns USING (Feature) GROUP BY ALL) GROUP BY ALL"""
query("rep7_boundary_magnitude", f"SELECT * FROM ({_SIZE}) JOIN ({_SHIFT}) USING (BoundaryID, WindowLength_sec)", "MahalanobisMagnitude MeanAbsChange FirstChange")(lambda s: s.magnitude)
for _kind, _key in (("real", "BoundaryID"), ("pseudo", "CandidateID")):
    query(f"cp3_cov_ic_{_kind}", f"SELECT {_key}, WindowLength_sec, SearchWindow, Method, Score, SplitIndex, CandidateLatency_sec FROM scores_{_kind} WHERE Method = 'CovIC'", "Score CandidateLatency_sec")(
        lambda s, t=f"{_kind}_scores", k=_key: getattr(s, t).filter("Method = 'CovIC'").select(k, "WindowLength_sec", "SearchWindow", "Method", "Score", "SplitIndex", "CandidateLatency_sec")
    )

# ---- calibration

query("cal1_quantile_higher", "SELECT event_type, list_sort(list(value))[ceil(0.95::DOUBLE * (count(value) - 1))::INT + 1] AS q95 FROM events GROUP BY ALL", "q95")(
    lambda spark, d: group_quantile(SRC.read(spark, d, "events").select("event_type", "value", "event_id"), ["event_type"], "value", 0.95, ["event_id"], "q95")
)
query("cal2_crossfit_thresholds", "SELECT * FROM thresholds", "Threshold HeldoutFPR")(lambda s: s.thresholds)
RESULT = [c for c in C.RESULT]
query("cal3_results", f"SELECT {cols(*RESULT)} FROM results", "MatchScore Score Threshold Latency_sec")(lambda s: s.results.select(*RESULT))
PV = ["WindowLength_sec", "SearchWindow", "Method", "TransitionType", "BoundaryID", "PseudoCondition", "RealScore", "PseudoControls", "PseudoMedianScore", "PseudoQ95Score", "EmpiricalPValue", "RealMinusPseudoMedian", "EmpiricalQValue_BH"]
query("cal5_empirical_p", f"SELECT {cols(*PV)} FROM p_values", "RealScore PseudoMedianScore PseudoQ95Score EmpiricalPValue RealMinusPseudoMedian EmpiricalQValue_BH")(lambda s: s.p_values.select(*PV))
_P = "SELECT doc_id, source, (n_chars % 1000 + 1) / 1001e0 AS p FROM documents"
query(
    "cal6_benjamini_hochberg",
    f"""SELECT doc_id, least(1, min(p * m / r) OVER (PARTITION BY source ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p) AS r, count(p) OVER (PARTITION BY source) AS m FROM ({_P}))""",
    "q",
)(lambda spark, d: C.with_bh(SRC.p_table(spark, d), "p", ["source"], "q").select("doc_id", "q"))
query(
    "cal7_holm",
    f"""SELECT doc_id, least(1, max((m - r + 1) * p) OVER (PARTITION BY source ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p) AS r, count(p) OVER (PARTITION BY source) AS m FROM ({_P}))""",
    "q",
)(lambda spark, d: C.with_holm(SRC.p_table(spark, d), "p", ["source"], "q").select("doc_id", "q"))
query("jn8_score_expansion", "SELECT PseudoMatchID, WindowLength_sec, SearchWindow, Method, Score FROM expanded", "Score")(lambda s: s.expanded.select("PseudoMatchID", "WindowLength_sec", "SearchWindow", "Method", "Score"))
query("agg17_p_summary", f"SELECT {GROUP}, PseudoCondition, count(*) AS Boundaries, median(EmpiricalPValue) AS MedianP, min(EmpiricalPValue) AS MinP, count(*) FILTER (EmpiricalPValue < 0.05) AS P_below_05, count(*) FILTER (EmpiricalQValue_BH < 0.05) AS Q_below_05, median(RealMinusPseudoMedian) AS MedianDifference FROM p_values GROUP BY ALL", "MedianP MinP MedianDifference")(
    lambda s: I.empirical_p_summary(s.p_values)
)

# ---- inference

query("agg8_detection_rates", f"SELECT {KINDKEYS}, Participants, Boundaries, Detections, DetectionRate, MedianLatency, Q1Latency, Q3Latency, MedianScore FROM rates", "DetectionRate MedianLatency Q1Latency Q3Latency MedianScore")(lambda s: I.detection_rates(s.results))
query("agg9_dedupe_for_rate", f"SELECT {KINDKEYS}, BoundaryID FROM dedup")(lambda s: I.dedupe_for_rate(s.results).select(*I.RATE_KEYS, "BoundaryID"))
for _c in ("A", "NA"):
    query(f"jn10_real_pseudo_pairs_{_c.lower()}", f"SELECT * EXCLUDE (PseudoCondition) FROM pairs WHERE PseudoCondition = '{_c}'", "RealDetected RealScore RealLatency PseudoDetected PseudoScore PseudoLatency")(lambda s, c=_c: I.real_pseudo_pairs(s.results, c))
query("agg11_boundary_order", "SELECT WindowLength_sec, SearchWindow, Method, BoundaryOrder, count(*) AS Boundaries, avg(Detected::INT) AS DetectionRate, median(Score) AS MedianScore, median(Latency_sec) AS MedianLatency FROM results WHERE BoundaryKind = 'Real' GROUP BY ALL", "DetectionRate MedianScore MedianLatency")(
    lambda s: I.boundary_order_summary(s.results)
)
_EFF = " UNION ALL ".join(f"SELECT BoundaryID, Subject, TransitionType, BoundaryOrder, WindowLength_sec, '{c}' AS Feature, median({c}) FILTER (Side = 'pre') AS PreMedian, median({c}) FILTER (Side = 'post') AS PostMedian FROM obs GROUP BY ALL" for c in ALL23)
_EFF2 = f"SELECT *, PostMedian - PreMedian AS Change, abs(PostMedian - PreMedian) AS AbsChange, CASE WHEN PostMedian - PreMedian IS NULL THEN 'undefined' WHEN PostMedian > PreMedian THEN 'increase' WHEN PostMedian < PreMedian THEN 'decrease' ELSE 'no_change' END AS Direction FROM ({_EFF})"
EFFECTS = _EFF2
query("agg7_feature_effects", _EFF2, "PreMedian PostMedian Change AbsChange")(lambda s: I.feature_effects(s.observations, ALL23))
query(
    "agg12_feature_effect_summary",
    f"SELECT WindowLength_sec, TransitionType, Feature, count(*) AS Boundaries, avg(Change) AS MeanChange, median(Change) AS MedianChange, median(AbsChange) AS MedianAbsChange, 100 * avg((Direction = 'increase')::INT) AS IncreasePercent, 100 * avg((Direction = 'decrease')::INT) AS DecreasePercent FROM ({_EFF2}) GROUP BY ALL",
    "MeanChange MedianChange MedianAbsChange IncreasePercent DecreasePercent",
)(lambda s: I.feature_effect_summary(I.feature_effects(s.observations, ALL23)))
_U = lambda stream, n: f"(SELECT rep, slot, ('0x' || substr(sha256('42|{stream}|' || rep || '|' || slot), 1, 16))::UBIGINT AS u FROM (SELECT unnest(range(0, {n})) AS rep), (SELECT unnest(range(0, (SELECT count(DISTINCT Subject) FROM results))) AS slot))"
_PER = f"SELECT {KINDKEYS}, Subject, sum(Detected::INT) AS s, count(*) AS c FROM dedup GROUP BY ALL"
query(
    "inf4_detection_summary",
    f"""SELECT r.*, b.CI_Lower, b.CI_Upper FROM rates r LEFT JOIN (
    SELECT {KINDKEYS}, quantile_cont(e, 0.025) AS CI_Lower, quantile_cont(e, 0.975) AS CI_Upper FROM (
      SELECT {', '.join('k.' + c.strip() for c in KINDKEYS.split(','))}, k.rep, sum(n.s) / sum(n.c)::DOUBLE AS e FROM (
        SELECT DISTINCT {', '.join('x.' + c.strip() for c in KINDKEYS.split(','))}, u.rep, u.slot AS pos, (u.u % x.m)::INT AS slot FROM (SELECT *, count(*) OVER (PARTITION BY {KINDKEYS}) AS m FROM ({_PER})) x JOIN {_U('rate', 200)} u ON u.slot < x.m) k
      JOIN (SELECT *, row_number() OVER (PARTITION BY {KINDKEYS} ORDER BY Subject) - 1 AS slot FROM ({_PER})) n
        ON {' AND '.join(f'k.{c.strip()} IS NOT DISTINCT FROM n.{c.strip()}' for c in KINDKEYS.split(','))} AND k.slot = n.slot GROUP BY ALL) GROUP BY ALL) b
    ON {' AND '.join(f'r.{c.strip()} IS NOT DISTINCT FROM b.{c.strip()}' for c in KINDKEYS.split(','))}""",
    "DetectionRate MedianLatency Q1Latency Q3Latency MedianScore CI_Lower CI_Upper",
)(lambda s: I.detection_summary(s.results, 200))
_FK = "PseudoCondition, WindowLength_sec, SearchWindow, Method"
query(
    "inf3_sign_flip",
    f"""SELECT {_FK}, MeanDifference, Participants, (1 + count(*) FILTER (abs(perm) >= abs(MeanDifference) * (1 - 1e-9) - 1e-12)) / 501e0 AS PermutationP FROM (
      SELECT {_FK}, rep, avg(CASE WHEN u % 2 = 1 THEN d ELSE -d END) AS perm FROM (SELECT *, row_number() OVER (PARTITION BY {_FK} ORDER BY Subject) - 1 AS slot FROM (SELECT {_FK}, Subject, avg(RealScore - PseudoScore) AS d FROM pairs GROUP BY ALL)) v JOIN {_U('flip', 500)} u USING (slot) GROUP BY ALL)
    JOIN (SELECT {_FK}, avg(d) AS MeanDifference, count(*) AS Participants FROM (SELECT {_FK}, Subject, avg(RealScore - PseudoScore) AS d FROM pairs GROUP BY ALL) GROUP BY ALL) USING ({_FK}) GROUP BY ALL""",
    "MeanDifference PermutationP",
)(lambda s: SRC.sign_flip_of_scores(s.results))


def boot_sql(per: str, keys: list[str], stream: str, value: str, names: dict[str, str]) -> str:
    """Quantiles of ``names`` (name -> expression over sums in ``n``) over 200 replicates; ``per`` has keys, Subject and what is summed."""
    k = ", ".join(keys)
    same = " AND ".join(f"k.{c} IS NOT DISTINCT FROM n.{c}" for c in keys)
    ends = ", ".join(f"quantile_cont({n}, 0.025) AS {n}_Lower, quantile_cont({n}, 0.975) AS {n}_Upper" for n in names)
    return f"""SELECT {k}, {ends} FROM (SELECT {k}, rep, {', '.join(f'{e} AS {n}' for n, e in names.items())} FROM (SELECT {', '.join(f'k.{c}' for c in keys)}, k.rep, {value} FROM (
      SELECT {', '.join(f'x.{c}' for c in keys)}, u.rep, u.slot AS pos, (u.u % x.m)::INT AS slot FROM (SELECT {k}, count(*) AS m FROM ({per}) GROUP BY ALL) x JOIN {_U(stream, 200)} u ON u.slot < x.m) k
      JOIN (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY Subject) - 1 AS slot FROM ({per})) n ON {same} AND k.slot = n.slot GROUP BY ALL)) GROUP BY ALL"""


def flip_sql(per: str, keys: list[str], stream: str, name: str = "MeanDifference", p: str = "PermutationP", more: str = ", Participants") -> str:
    """Mean of ``d`` over subjects and its sign-flip p value from 500 replicates."""
    k = ", ".join(keys)
    return f"""SELECT {k}, mean AS {name}, (1 + count(*) FILTER (abs(perm) >= abs(mean) * (1 - 1e-9) - 1e-12)) / 501e0 AS {p}{more} FROM (
      SELECT {k}, rep, avg(CASE WHEN u % 2 = 1 THEN d ELSE -d END) AS perm FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY Subject) - 1 AS slot FROM ({per}) WHERE d IS NOT NULL) v JOIN {_U(stream, 500)} u USING (slot) GROUP BY ALL)
    JOIN (SELECT {k}, avg(d) AS mean, count(d) AS Participants FROM ({per}) WHERE d IS NOT NULL GROUP BY ALL) USING ({k}) GROUP BY {k}, mean, Participants"""


_FKEYS = [c.strip() for c in _FK.split(",")]
_SUMS = f"SELECT {_FK}, Subject, sum(RealDetected) AS rs, sum(PseudoDetected) AS ps, count(*)::DOUBLE AS c FROM pairs GROUP BY ALL"
_EFFECT = {"RiskDifference": "rs / c - ps / c", "RiskRatio": "(rs / c + 0.5 / c) / (ps / c + 0.5 / c)", "OddsRatio": "((rs / c + 0.5 / c) / (1 - rs / c + 0.5 / c)) / ((ps / c + 0.5 / c) / (1 - ps / c + 0.5 / c))"}
_DIFF = lambda n: f"SELECT {_FK}, Subject, avg(Real{n} - Pseudo{n}) AS d FROM pairs GROUP BY ALL"
COMPARED = f"""SELECT * FROM (SELECT {_FK}, rs / c AS RealRate, ps / c AS PseudoRate, {', '.join(f'{e} AS {n}' for n, e in _EFFECT.items())} FROM (SELECT {_FK}, sum(rs) AS rs, sum(ps) AS ps, sum(c) AS c FROM ({_SUMS}) GROUP BY ALL))
  JOIN ({boot_sql(_SUMS, _FKEYS, 'pairs', 'sum(n.rs) AS rs, sum(n.ps) AS ps, sum(n.c) AS c', _EFFECT)}) USING ({_FK})
  {' '.join(f"LEFT JOIN ({flip_sql(_DIFF(n), _FKEYS, 'flip', n + 'Difference', n + '_P', '')}) USING ({_FK})" for n in ('Detected', 'Score', 'Latency'))}"""
_SHOWN = "RealRate PseudoRate " + " ".join(f"{n}{e}" for n in _EFFECT for e in ("", "_Lower", "_Upper")) + " " + " ".join(f"{n}Difference {n}_P" for n in ("Detected", "Score", "Latency"))
query("inf6_real_v_pseudo", COMPARED, _SHOWN)(lambda s: I.compare_real_pseudo(s.results))
query("inf5_paired_effects", f"SELECT {_FK}, RealRate, PseudoRate, {', '.join(f'{n}, {n}_Lower, {n}_Upper' for n in _EFFECT)} FROM ({COMPARED})", _SHOWN.split(" DetectedDifference")[0])(
    lambda s: I.compare_real_pseudo(s.results).select(*_FKEYS, "RealRate", "PseudoRate", *[f"{n}{e}" for n in _EFFECT for e in ("", "_Lower", "_Upper")])
)
_MAGNITUDE = f"SELECT BoundaryID, WindowLength_sec, MahalanobisMagnitude, MeanAbsChange FROM ({_SIZE}) JOIN ({_SHIFT}) USING (BoundaryID, WindowLength_sec)"
_DK = ["WindowLength_sec", "SearchWindow", "Method", "Outcome"]
_OUT = {"hit": "Detected::INT::DOUBLE", "Score": "Score", "Latency_sec": "Latency_sec", "MahalanobisMagnitude": "MahalanobisMagnitude", "MeanAbsChange": "MeanAbsChange"}
_SIZED = f"(SELECT * FROM results LEFT JOIN ({_MAGNITUDE}) g USING (BoundaryID, WindowLength_sec) WHERE BoundaryKind = 'Real')"
_CON = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT WindowLength_sec, SearchWindow, Method, '{n}' AS Outcome, Subject, avg({e}) FILTER (TransitionType = 'A_to_NA') - avg({e}) FILTER (TransitionType = 'NA_to_A') AS d FROM {_SIZED} GROUP BY ALL" for n, e in _OUT.items()
) + ") WHERE d IS NOT NULL"
query(
    "inf7_direction_contrast",
    f"SELECT {', '.join(_DK)}, MeanDifference, Participants, PermutationP, e_Lower AS CI_Lower, e_Upper AS CI_Upper FROM ({flip_sql(_CON, _DK, 'direction')}) LEFT JOIN ({boot_sql(_CON, _DK, 'contrast', 'sum(n.d) AS s, count(n.d) AS c', {'e': 's / c'})}) USING ({', '.join(_DK)})",
    "MeanDifference PermutationP CI_Lower CI_Upper",
)(lambda s: I.direction_contrast(s.results, s.magnitude))
query(
    "agg25_method_specificity",
    """SELECT *, RealRate - greatest(PseudoA, PseudoNA) AS Specificity FROM (SELECT WindowLength_sec, SearchWindow, Method, TransitionType, max(DetectionRate) FILTER (BoundaryKind = 'Real') AS RealRate,
    max(DetectionRate) FILTER (BoundaryKind = 'Pseudo' AND PseudoCondition = 'A') AS PseudoA, max(DetectionRate) FILTER (BoundaryKind = 'Pseudo' AND PseudoCondition = 'NA') AS PseudoNA FROM rates GROUP BY ALL)
    WHERE RealRate IS NOT NULL AND PseudoA IS NOT NULL AND PseudoNA IS NOT NULL""",
    "RealRate PseudoA PseudoNA Specificity",
)(lambda s: I.method_specificity(I.detection_rates(s.results)))
