"""Further queries: scalar functions, matrix detectors, timing, simulation, reports and streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.checks.ctes import KINDKEYS, WHOLE, sql
from tessaline.checks.queries import COMPARED, EFFECTS, ORACLE, query
from tessaline.config import ALL23, FAMILIES, FREQUENCY, NONLINEAR, PELT_MULTIPLIERS, REDUCED_CANDIDATES
from tessaline.functions import scalars as S
from tessaline.operators import calibration as C
from tessaline.operators import gee, lopo, matrix, refit, reports, signal, simulation, timing
from tessaline.operators import inference as I
from tessaline.operators.detectors import pelt_base_penalty
from tessaline.operators import normalize as N
from tessaline.operators import quality as Q
from tessaline.plans.study import Study
from tessaline.sources import sessions as SRC
from tessaline.streaming.windows import stream_windows

DOCS = lambda spark, d: SRC.read(spark, d, "documents")

# ---- scalar functions

query("sc1_safe_numeric", "SELECT event_id, try_cast(trim(props, '{}\"k: ') AS DOUBLE) AS number FROM events", "number")(
    lambda spark, d: SRC.read(spark, d, "events").select("event_id", S.safe_numeric(F.expr("trim(BOTH '{}\"k: ' FROM props)")).alias("number"))
)
query("sc2_parse_bool", "SELECT doc_id, coalesce(lower(trim(CASE doc_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN ' 1 ' WHEN 2 THEN '1.0' WHEN 3 THEN 'yes' END)) IN ('true', '1'), false) AS flag FROM documents")(
    lambda spark, d: DOCS(spark, d).select("doc_id", S.parse_bool(F.expr("CASE doc_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN ' 1 ' WHEN 2 THEN '1.0' WHEN 3 THEN 'yes' END")).alias("flag"))
)
query("sc3_log1p", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END AS v FROM customer", "v")(
    lambda spark, d: SRC.read(spark, d, "customer").select("c_custkey", S.log_feature("SDNN", "c_acctbal").alias("v"))
)
query("sc4_z_score", "SELECT p_partkey, (p_retailprice - 1000) / 50 AS z FROM part", "z")(
    lambda spark, d: SRC.read(spark, d, "part").select("p_partkey", S.z_score("p_retailprice", F.lit(1000.0), F.lit(50.0)).alias("z"))
)
query("sc6_half_even", "SELECT o_orderkey, round_even(o_totalprice / 7e0, 2) AS v FROM orders", "v")(
    lambda spark, d: SRC.read(spark, d, "orders").select("o_orderkey", S.half_even(F.col("o_totalprice") / 7.0, 2).alias("v"))
)
query("sc7_clip", "SELECT c_custkey, greatest(least(c_acctbal, 5000), 0) AS v FROM customer", "v")(
    lambda spark, d: SRC.read(spark, d, "customer").select("c_custkey", S.clip("c_acctbal", 0.0, 5000.0).alias("v"))
)
query("sc9_effective_size", "SELECT p_partkey, greatest(2, least(p_size, p_size * (1 - r) / (1 + r))) AS n_eff FROM (SELECT *, greatest(0, least(0.98, (p_partkey % 100) / 100e0)) AS r FROM part)", "n_eff")(
    lambda spark, d: SRC.read(spark, d, "part").select("p_partkey", S.effective_size("p_size", (F.col("p_partkey") % 100) / 100.0).alias("n_eff"))
)
query("sc10_number_text", "SELECT p_partkey, CASE WHEN v = floor(v) THEN floor(v)::BIGINT::VARCHAR ELSE v::VARCHAR END AS t FROM (SELECT p_partkey, p_size / 2e0 AS v FROM part)")(
    lambda spark, d: SRC.read(spark, d, "part").select("p_partkey", S.number_text(F.col("p_size") / 2.0).alias("t"))
)
query("sc11_stable_hash", "SELECT doc_id, (('0x' || substr(sha256('42|' || source), 1, 16))::UBIGINT % 4)::INT AS fold FROM documents")(
    lambda spark, d: DOCS(spark, d).select("doc_id", S.hash_mod(F.col("source"), 4).alias("fold"))
)
query("sc12_weak_hash", "SELECT doc_id, list_sum(list_transform(range(1, length(source) + 1), lambda i: i * ascii(source[i])))::INT AS h FROM documents")(
    lambda spark, d: DOCS(spark, d).select("doc_id", S.weak_hash(F.col("source")).alias("h"))
)
query("sc15_direction_label", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'increase' WHEN c_acctbal < 0 THEN 'decrease' ELSE 'no_change' END AS label FROM customer")(
    lambda spark, d: SRC.read(spark, d, "customer").select("c_custkey", S.direction_label(F.col("c_acctbal")).alias("label"))
)
query("sc16_bic", "SELECT p_partkey, p_size * ln(p_retailprice / p_size) + 3 * ln(p_size) AS v FROM part", "v")(
    lambda spark, d: SRC.read(spark, d, "part").select("p_partkey", S.bic(F.col("p_retailprice"), F.col("p_size"), F.lit(3)).alias("v"))
)
query("sc17_method_names", "SELECT DISTINCT Method, CASE WHEN Method = 'LegacyBIC_fixed6' THEN 'LegacyBIC_crossfit' ELSE Method || '_crossfit' END AS named FROM real_scores")(
    lambda s: s.real_scores.select("Method", S.calibrated_name(F.col("Method")).alias("named")).distinct()
)
query("src2_natural_sort", "SELECT p_partkey, row_number() OVER (ORDER BY lower(split_part(k, '#', 1)), split_part(k, '#', 2)::INT, p_partkey)::INT AS place FROM (SELECT p_partkey, 'Item' || '#' || (p_partkey % 120) AS k FROM part)")(
    lambda spark, d: SRC.placed(SRC.read(spark, d, "part").select("p_partkey", S.natural_key(F.concat(F.lit("Item"), (F.col("p_partkey") % 120).cast("string"))).alias("k")), ["k", "p_partkey"]).select("p_partkey", "place")
)
_STEM = "'A' || lpad((doc_id % 40)::VARCHAR, 3, '0') || CASE doc_id % 3 WHEN 0 THEN '_Session' ELSE '_session' END || (doc_id % 7) || CASE doc_id % 4 WHEN 0 THEN '_x' WHEN 1 THEN '_na' ELSE '_A' END"
_FITS = "regexp_full_match(stem, '(?i)(A\\d+)_session(\\d+)_(NA|A)')"
_PART = lambda i: f"CASE WHEN {_FITS} THEN regexp_extract(stem, '(?i)^(A\\d+)_session(\\d+)_(NA|A)$', {i}) END"
query(
    "src5_file_names",
    f"""SELECT doc_id, upper({_PART(1)}) AS Subject, {_PART(2)}::INT AS Session, upper({_PART(3)}) AS ConditionCode, upper({_PART(3)}) <> CASE WHEN {_PART(2)}::INT % 2 = 1 THEN 'A' ELSE 'NA' END AS LabelMismatch FROM (SELECT doc_id, {_STEM} AS stem FROM documents)""",
)(
    lambda spark, d: DOCS(spark, d)
    .select("doc_id", F.expr("concat('A', lpad(cast(doc_id % 40 as string), 3, '0'), CASE doc_id % 3 WHEN 0 THEN '_Session' ELSE '_session' END, cast(doc_id % 7 as string), CASE doc_id % 4 WHEN 0 THEN '_x' WHEN 1 THEN '_na' ELSE '_A' END)").alias("stem"))
    .withColumns(SRC.parse_file_name(F.col("stem")))
    .select("doc_id", "Subject", "Session", "ConditionCode", "LabelMismatch")
)
query("cp10_pelt_penalty", "SELECT p_partkey, (p_size + 1) * ln(p_partkey + 1) AS penalty FROM part", "penalty")(
    lambda spark, d: SRC.read(spark, d, "part").select("p_partkey", pelt_base_penalty(F.col("p_size"), (F.col("p_partkey") + 1).cast("double"), "l2").alias("penalty"))
)
query(
    "win11_lag1_correlation",
    "SELECT WindowLength_sec, Feature, greatest(0, least(0.98, median(r))) AS lag1_rho, count(*) AS sessions FROM lags GROUP BY ALL",
    "lag1_rho",
)(lambda s: N.pooled_correlation(s.session_lags, ["WindowLength_sec", "Feature"]))
query("nrm6_stable_z", "SELECT WindowID, Feature, z FROM crossfit JOIN cross_ids USING (WindowID, WindowLength_sec)", "z")(lambda s: s.crossfit.unpivot(["WindowID"], ALL23, "Feature", "z"))

# ---- matrix detectors

query("rep2_pruning")(lambda s: s.spark.createDataFrame(s.reduced()[1], "WindowLength_sec int, Feature string, Kept boolean, Representative string, AbsRho double"))
_RANKED = ", ".join(f"rank() OVER (PARTITION BY WindowLength_sec ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY WindowLength_sec, round({c}, 9)) - 1) / 2e0 AS {c}" for c in REDUCED_CANDIDATES)
_RHO = " UNION ALL ".join(f"SELECT WindowLength_sec, '{a}' AS A, '{b}' AS B, corr({a}, {b}) AS Rho FROM ranked GROUP BY ALL" for i, a in enumerate(REDUCED_CANDIDATES) for b in REDUCED_CANDIDATES[i + 1 :])
_WIDE = ", ".join(f"max(z) FILTER (Feature = '{c}') AS {c}" for c in REDUCED_CANDIDATES)
query("rep2_rank_correlations", f"SELECT * FROM (WITH ranked AS MATERIALIZED (SELECT WindowLength_sec, {_RANKED} FROM (SELECT WindowID, WindowLength_sec, {_WIDE} FROM crossfit JOIN rank_ids USING (WindowID, WindowLength_sec) GROUP BY ALL)) {_RHO})", "Rho")(
    lambda s: matrix.rank_correlations(s.rank_rows, REDUCED_CANDIDATES, "WindowLength_sec")
)
query("rep3_covariances", "SELECT WindowLength_sec, i::INT AS i, j::INT AS j, value FROM shrunk", "value")(lambda s: covariances(s, "heart_rate_rr"))
ORACLE["rep3_covariances_of_families"] = " UNION ALL ".join(f"SELECT *, '{f}' AS Representation FROM ({sql('SELECT WindowLength_sec, i::INT AS i, j::INT AS j, value FROM shrunk', 'value', 20, f)})" for f in FAMILIES)
query("rep3_covariances_of_families")(lambda s: reduce(DataFrame.unionByName, [covariances(s, f).withColumn("Representation", F.lit(f)) for f in FAMILIES]))


def covariances(s: Study, space: str):
    """Shrunk covariances of a space by window length."""
    rows = [(length, i, j, float(v)) for length, spaces in s.fits().items() for r in spaces if r.name == space for i, row in enumerate(r.covariance) for j, v in enumerate(row)]
    return s.spark.createDataFrame(rows, "WindowLength_sec int, i int, j int, value double")


query("rep4_spaces")(
    lambda s: s.spark.createDataFrame(
        [(length, r.name, list(r.columns), float(r.rho), len(r.covariance), float(r.covariance.trace())) for length, spaces in s.fits().items() for r in spaces],
        "WindowLength_sec int, Representation string, Columns array<string>, Rho double, Dimensions int, Trace double",
    )
)
query("cp3_cp5_matrix_scores")(lambda s: s.matrix_real_scores.select("BoundaryID", "WindowLength_sec", "Representation", "SearchWindow", "Method", "Score", "SplitIndex", "CandidateLatency_sec"))
query("cal2_matrix_thresholds")(lambda s: s.matrix_thresholds)
query("cal3_matrix_results")(lambda s: s.matrix_results)
query("flt10_primary_slice", f"SELECT {KINDKEYS}, Participants, Boundaries, Detections, DetectionRate, MedianLatency, Q1Latency, Q3Latency, MedianScore, 'reduced' AS Representation, 20e0 AS RRThreshold FROM rates WHERE Method = 'CovIC_crossfit' AND SearchWindow = 'post_only'", "DetectionRate MedianLatency Q1Latency Q3Latency MedianScore", primary=True)(
    lambda s: reports.primary(s.matrix_rates.withColumn("RRThreshold", F.lit(20.0)))
)
query("rep2_reduced_space", "SELECT Feature, k AS Place FROM columns", primary=True)(lambda s: s.spark.createDataFrame(list(zip(s.reduced()[0], range(100))), "Feature string, Place int"))
query("rep3_reduced_covariances", "SELECT WindowLength_sec, i::INT AS i, j::INT AS j, value FROM shrunk", "value", primary=True)(lambda s: covariances(s, "reduced"))
query("cp3_cp7_reduced_scores", "SELECT BoundaryID, WindowLength_sec, SearchWindow, Method, Score, SplitIndex, CandidateLatency_sec FROM scores_real", "Score CandidateLatency_sec", primary=True)(
    lambda s: s.real_scores.select("BoundaryID", "WindowLength_sec", "SearchWindow", "Method", "Score", "SplitIndex", "CandidateLatency_sec")
)
query("cp13_pelt_grid")(lambda s: s.pelt_real)
query("agg13_pelt_rates")(
    lambda s: s.pelt_expanded.groupBy(*C.PELT_GROUP, "Multiplier").agg(F.avg(F.col("Detected").cast("double")).alias("FPR"), F.countDistinct("CandidateBlockID").alias("Blocks"))
)
query("cal4_pelt_penalty")(lambda s: s.pelt_multipliers)
query("cal4_pelt_results")(lambda s: C.apply_multipliers(s.pelt_real, s.pelt_expanded, s.pelt_multipliers, PELT_MULTIPLIERS))
query("lopo2_held_out_penalty")(lambda s: lopo.held_out_penalty(s.pelt_expanded.filter("Model = 'l2'"), C.PELT_GROUP))


# ---- timing


_DEP = """SELECT BoundaryID, TransitionType, WindowLength_sec, Subject, RelativeCenter_sec, sqrt(sum(off * off)) AS value FROM (
  SELECT BoundaryID, TransitionType, WindowLength_sec, Subject, t AS RelativeCenter_sec, z - coalesce(avg(CASE WHEN t < 0 THEN z END) OVER g, avg(z) OVER g) AS off
  FROM white_real JOIN inventory USING (BoundaryID) WINDOW g AS (PARTITION BY BoundaryID, WindowLength_sec, Feature)) GROUP BY ALL"""
_TRACK = f"SELECT TransitionType, WindowLength_sec, Subject, RelativeCenter_sec, avg(value) AS value, count(*) AS boundaries FROM ({_DEP}) GROUP BY ALL"
KEYS = ["TransitionType", "WindowLength_sec", "Representation"]
REDUCED = lambda df: df.filter("Representation = 'reduced'").drop("Representation", "Coordinate")
# the columns of the SQL are those of the pruned space
query("tim4_participant_trajectory", _TRACK, "RelativeCenter_sec value", primary=True)(lambda s: REDUCED(s.timing().trajectory))
query("tim3_departure", _DEP, "RelativeCenter_sec value", primary=True)(lambda s: REDUCED(s.timing().values))
query("tim3_signed")(lambda s: s.timing("signed").trajectory)
query(
    "tim1_participant_weights",
    f"SELECT TransitionType, WindowLength_sec, Subject, RelativeCenter_sec, 1e0 / count(*) OVER (PARTITION BY TransitionType, WindowLength_sec, Subject) AS weight FROM (SELECT DISTINCT TransitionType, WindowLength_sec, Subject, RelativeCenter_sec FROM ({_DEP}))",
    "RelativeCenter_sec weight",
    primary=True,
)(lambda s: timing.participant_weights(REDUCED(s.timing().trajectory), ["TransitionType", "WindowLength_sec"]).select("TransitionType", "WindowLength_sec", "Subject", "RelativeCenter_sec", "weight"))
# products of trend, step and bend at each candidate time, added up over participants; three equations solved by determinants
_SUMS = f"""WITH track AS MATERIALIZED ({_TRACK}), mean AS (SELECT *, RelativeCenter_sec / 60 - avg(RelativeCenter_sec / 60) OVER p AS m, value - avg(value) OVER p AS y, count(*) OVER p AS n FROM track WINDOW p AS (PARTITION BY TransitionType, WindowLength_sec, Subject)),
grid AS (SELECT DISTINCT TransitionType, WindowLength_sec, RelativeCenter_sec AS c FROM track),
place AS (SELECT *, row_number() OVER (PARTITION BY TransitionType, WindowLength_sec ORDER BY c) - 1 AS before, count(*) OVER (PARTITION BY TransitionType, WindowLength_sec) AS times FROM grid),
part AS (SELECT r.*, c, before, times, (RelativeCenter_sec >= c)::INT - avg((RelativeCenter_sec >= c)::INT) OVER p AS s, greatest((RelativeCenter_sec - c) / 60, 0) - avg(greatest((RelativeCenter_sec - c) / 60, 0)) OVER p AS h
  FROM mean r JOIN place g USING (TransitionType, WindowLength_sec) WINDOW p AS (PARTITION BY TransitionType, WindowLength_sec, Subject, c)),
own AS (SELECT TransitionType, WindowLength_sec, c, before, times, count(DISTINCT Subject) AS people, sum(m * m / n) AS a, sum(m * s / n) AS b, sum(m * h / n) AS d, sum(s * s / n) AS e, sum(s * h / n) AS f, sum(h * h / n) AS g, sum(m * y / n) AS u, sum(s * y / n) AS v, sum(h * y / n) AS w FROM part GROUP BY ALL),
det AS (SELECT *, a * (e * g - f * f) - b * (b * g - f * d) + d * (b * f - e * d) AS t FROM own)
SELECT TransitionType, WindowLength_sec, SearchWindow, c AS CandidateTime_sec, people::INT AS Participants,
  ((u * u * (e * g - f * f) + v * v * (a * g - d * d) + w * w * (a * e - b * b) + 2 * u * v * (d * f - b * g) + 2 * u * w * (b * f - d * e) + 2 * v * w * (b * d - a * f)) / t - u * u / a) / people AS Score
FROM det, (SELECT 'post_only' AS SearchWindow, 0e0 AS low UNION ALL SELECT 'anticipatory', -30e0) WHERE c >= low AND c <= 60 AND before >= 3 AND times - before >= 3 AND people >= 10 AND abs(t) > 1e-9"""
query("tim2_group_profiles", f"SELECT * FROM ({_SUMS})", "CandidateTime_sec Score", primary=True)(
    lambda s: REDUCED(s.timing().profiles).select("TransitionType", "WindowLength_sec", "SearchWindow", "CandidateTime_sec", "Participants", "Score")
)
query("tim2_group_fits")(lambda s: s.timing().fits)
query("tim2_signed_fits")(lambda s: s.timing("signed").fits)
query("tim6_bootstrap_fits")(lambda s: s.timing().bootstrap)
query("tim9_leave_one_out")(lambda s: s.timing().left_out)
query("tim5_pseudo_draws")(lambda s: s.timing().null_fits)
query("tim5_scarcity")(lambda s: s.timing().scarcity)
query("tim7_dual_null")(lambda s: s.timing().summary)
query("tim7_signed_dual_null")(lambda s: s.timing("signed").summary)
query("tim8_null_bands")(lambda s: s.timing().bands)
query("tim10_paired_difference")(lambda s: s.timing().paired)
query("tim11_timing_power")(lambda s: s.timing().power)
query("agg24_lopo_timing")(lambda s: s.timing().left_out.groupBy(*KEYS, "SearchWindow").agg(F.min("CandidateTime_sec").alias("Earliest"), F.median("CandidateTime_sec").alias("Median"), F.max("CandidateTime_sec").alias("Latest"), F.count("*").alias("Fits")))
query("rpt9_timing_profiles")(lambda s: s.timing().profiles.join(s.timing().bands, [*KEYS, "SearchWindow", "CandidateTime_sec"], "left"))
query("rpt10_timing_across_windows")(lambda s: s.timing().fits.groupBy("TransitionType", "Representation", "SearchWindow").pivot("WindowLength_sec", [30, 45, 60]).agg(F.first("CandidateTime_sec")))
query("rpt15_dual_timing_tests")(lambda s: reports.dual_timing_tests(s.timing().summary))

# ---- simulation and leave-one-participant-out

def heart_rate_space(s: Study):
    return next(r for r in s.fits()[30] if r.name == "heart_rate_rr")


def sim_power(s: Study, replicates: int = 20):
    """All cells: shapes, sizes, shares of changed features, starts."""
    rep = heart_rate_space(s)
    cells = [(k, size, share, start) for k in simulation.SHAPES for size in simulation.SIZES for share in simulation.SHARES for start in simulation.STARTS]
    return simulation.power(simulation.simulate(s.spark, rep, replicates, cells), simulation.null_thresholds(simulation.simulate(s.spark, rep, 400)))


query("sim4_null_thresholds")(lambda s: simulation.null_thresholds(simulation.simulate(s.spark, heart_rate_space(s), 400)))
query("sim4_power")(lambda s: sim_power(s))
query("rpt4_power_curves")(lambda s: sim_power(s, 5).groupBy("Method", "shape", "size").agg(F.avg("Power").alias("MeanPower"), F.sum("Series").alias("Series")))


_LG = "WindowLength_sec, SearchWindow, Method, TransitionType"
_LB = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_LG}, Subject, CandidateBlockID, PseudoCondition ORDER BY MatchScore, MatchRank, PseudoMatchID) AS turn FROM expanded) WHERE turn = 1)"
query(
    "lopo1_held_out_thresholds",
    f"""SELECT b.WindowLength_sec, b.SearchWindow, b.Method, b.TransitionType, h.HeldOut, list_sort(list(b.Score))[ceil(0.95::DOUBLE * (count(b.Score) - 1))::INT + 1] AS Threshold, count(DISTINCT b.Subject) AS TrainingSubjects
    FROM {_LB} b JOIN (SELECT DISTINCT WindowLength_sec, Subject AS HeldOut FROM expanded) h ON b.WindowLength_sec = h.WindowLength_sec AND b.Subject <> h.HeldOut GROUP BY ALL""",
    "Threshold",
)(lambda s: lopo.held_out_thresholds(s.expanded))
_HELD = f"""SELECT b.WindowLength_sec, b.SearchWindow, b.Method, b.TransitionType, h.HeldOut, list_sort(list(b.Score))[ceil(0.95::DOUBLE * (count(b.Score) - 1))::INT + 1] AS T
    FROM {_LB} b JOIN (SELECT DISTINCT WindowLength_sec, Subject AS HeldOut FROM expanded) h ON b.WindowLength_sec = h.WindowLength_sec AND b.Subject <> h.HeldOut GROUP BY ALL"""
query(
    "agg16_lopo_summary",
    f"""SELECT {_LG}, BoundaryKind, PseudoCondition, count(DISTINCT Subject) AS Participants, count(*) AS Rows, sum((Score >= T)::INT)::BIGINT AS Detections, avg((Score >= T)::INT) AS Rate, median(Score) AS MedianScore FROM (
      SELECT {_LG}, Subject, 'Real' AS BoundaryKind, NULL::VARCHAR AS PseudoCondition, Score FROM real_scores UNION ALL SELECT {_LG}, Subject, 'Pseudo', PseudoCondition, Score FROM {_LB}) x
    JOIN (SELECT WindowLength_sec, SearchWindow, Method, TransitionType, HeldOut AS Subject, T FROM ({_HELD})) t USING ({_LG}, Subject) GROUP BY ALL""",
    "Rate MedianScore",
)(lambda s: lopo.summary(lopo.apply_held_out(s.real_scores, s.expanded, lopo.held_out_thresholds(s.expanded))))

query("lopo3_folds")(lambda s: s.fold_spaces.select("WindowLength_sec", "HeldOut", "Representation", F.concat_ws(";", "Features").alias("Features"), "Dimensions", "rho", "TrainingRows", "TrainingParticipants"))
query("lopo3_thresholds")(lambda s: s.fold_thresholds)
query("lopo3_penalties")(lambda s: s.fold_penalties)
query("lopo3_detections")(lambda s: s.fold_detections)
query("lopo3_summary")(lambda s: refit.held_out_summary(s.fold_detections))

# ---- regression, signals

def magnitude(s: Study):
    return s.magnitude


def sized_results(s: Study):
    return s.results.join(magnitude(s), ["BoundaryID", "WindowLength_sec"], "left")


def feature_fits(s: Study):
    return gee.feature_gee(I.z_effects(s.configured(20.0, "all23").long_real, ["BoundaryID", "Subject", "TransitionType", "BoundaryOrder"]))


query("inf8_gee_boundaries")(lambda s: gee.boundary_gee(sized_results(s), ["WindowLength_sec", "SearchWindow", "Method"]))
query("inf9_gee_features")(lambda s: feature_fits(s))
query("fx8_window_spectra")(lambda s: s.master.select("WindowID", *FREQUENCY, "FrequencyFeaturesComputed", "DFA_alpha1", "DFAFeatureComputed"))
_PAIRS = lambda k: " AND ".join(f"abs(a.v{j} - b.v{j}) <= 0.2 * a.sd" for j in range(k))
query(
    "fx10_sample_entropy",
    f"""SELECT WindowID, SampEn, SampEn IS NOT NULL AS EntropyFeatureComputed FROM (SELECT m.WindowID, CASE WHEN e.A > 0 AND e.B > 0 THEN -ln(e.A / e.B::DOUBLE) END AS SampEn FROM master m LEFT JOIN (
      SELECT a.Subject, a.Session, a.WindowLength_sec, a.WindowIndex, count(*) FILTER ({_PAIRS(2)}) AS B, count(*) FILTER ({_PAIRS(3)}) AS A
      FROM three a JOIN three b ON a.Subject = b.Subject AND a.Session = b.Session AND a.WindowLength_sec = b.WindowLength_sec AND a.WindowIndex = b.WindowIndex AND a.i < b.i GROUP BY ALL) e USING (Subject, Session, WindowLength_sec, WindowIndex))""".replace(
        "three",
        "(SELECT * FROM (SELECT *, nn AS v0, lead(nn) OVER w AS v1, lead(nn, 2) OVER w AS v2, count(*) OVER g AS n, stddev_pop(nn) OVER g AS sd FROM rr_clean WHERE nn IS NOT NULL WINDOW w AS (PARTITION BY Subject, Session, WindowLength_sec, WindowIndex ORDER BY i), g AS (PARTITION BY Subject, Session, WindowLength_sec, WindowIndex)) WHERE n >= 20 AND v2 IS NOT NULL)",
    ),
    "SampEn",
)(lambda s: s.master.select("WindowID", "SampEn", "EntropyFeatureComputed"))
query(
    "jn16_peaks_in_windows",
    """SELECT Subject, Session, WindowLength_sec, WindowIndex, count(*) AS peaks, sum(p - WindowIndex * 500)::BIGINT AS places FROM (SELECT *, unnest(range(greatest(0, floor((p / 100e0 - WindowLength_sec) / 5e0)::INT + 1), least(floor(p / 500e0), floor((360 - WindowLength_sec) / 5e0))::INT + 1))::INT AS WindowIndex
    FROM (SELECT Subject, Session, floor(t * 100)::BIGINT AS p FROM samples) CROSS JOIN lengths) GROUP BY ALL""",
)(
    lambda s: signal.windowed_peaks(s.samples.select("Subject", "Session", F.floor(F.col("t") * 100).cast("long").alias("peak_idx")), 100.0, (30, 45, 60), 5, 360.0)
    .groupBy("Subject", "Session", "WindowLength_sec", "WindowIndex")
    .agg(F.count("*").alias("peaks"), F.sum("peak_in_window").alias("places"))
)

# ---- reports

_RATES = "SELECT WindowLength_sec, SearchWindow, Method, BoundaryKind, TransitionType, PseudoCondition, DetectionRate FROM rates"
query("rpt1_rates_by_window", f"SELECT WindowLength_sec, BoundaryKind, TransitionType, PseudoCondition, DetectionRate FROM ({_RATES}) WHERE Method = 'CovIC_crossfit' AND SearchWindow = 'post_only'", "DetectionRate", primary=True)(lambda s: reports.rates_by_window(I.detection_rates(s.results)))
query("rpt2_method_comparison", f"SELECT Method, SearchWindow, avg(DetectionRate) AS MeanRate, max(DetectionRate) AS MaxRate FROM ({_RATES}) WHERE BoundaryKind = 'Real' GROUP BY ALL", "MeanRate MaxRate")(lambda s: reports.method_comparison(I.detection_rates(s.results)))
query("rpt3_risk_differences", f"SELECT PseudoCondition, WindowLength_sec, SearchWindow, Method, RiskDifference, RiskDifference_Lower, RiskDifference_Upper FROM ({COMPARED})", "RiskDifference RiskDifference_Lower RiskDifference_Upper")(lambda s: I.compare_real_pseudo(s.results).select("PseudoCondition", "WindowLength_sec", "SearchWindow", "Method", "RiskDifference", "RiskDifference_Lower", "RiskDifference_Upper"))
query(
    "rpt7_top_features",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY WindowLength_sec ORDER BY Largest DESC, Feature)::INT AS place FROM (
      SELECT WindowLength_sec, Feature, max(MedianAbsChange) AS Largest, max(MedianChange) FILTER (TransitionType = 'A_to_NA') AS A_to_NA, max(MedianChange) FILTER (TransitionType = 'NA_to_A') AS NA_to_A
      FROM (SELECT WindowLength_sec, TransitionType, Feature, median(Change) AS MedianChange, median(AbsChange) AS MedianAbsChange FROM ({EFFECTS}) GROUP BY ALL) GROUP BY ALL)) WHERE place <= 10""",
    "Largest A_to_NA NA_to_A",
)(lambda s: reports.top_features(I.feature_effect_summary(I.feature_effects(s.observations, ALL23))))
query("rpt8_p_histogram", "SELECT Method, PseudoCondition, least(floor(EmpiricalPValue * 10), 9)::INT AS bin, count(*) AS n FROM p_values WHERE EmpiricalPValue IS NOT NULL GROUP BY ALL")(lambda s: reports.p_histogram(s.p_values))
query(
    "rpt12_study_inventory",
    "SELECT 'participants' AS item, count(DISTINCT Subject) AS value FROM master UNION ALL SELECT 'sessions', count(DISTINCT (Subject, Session)) FROM master UNION ALL SELECT 'windows', count(*) FROM master UNION ALL SELECT 'boundaries', count(*) FROM inventory UNION ALL SELECT 'pseudo_blocks', count(DISTINCT CandidateBlockID) FROM cand",
)(lambda s: reports.study_inventory(s.master, s.inventory, s.candidates))
query(
    "rpt12_quality_retention",
    f"""SELECT q.*, e.boundaries, e.eligible, 100e0 * passed / windows AS retained_percent FROM (SELECT WindowLength_sec, t AS RRThreshold, count(*) AS windows, sum(coalesce(WindowValid AND RR_CorrectedPercent <= t AND {WHOLE}, false)::INT)::BIGINT AS passed FROM master, (SELECT unnest([5e0, 10e0, 20e0]) AS t) GROUP BY ALL) q
    LEFT JOIN (SELECT WindowLength_sec, count(*) AS boundaries, sum(Eligible::INT)::BIGINT AS eligible FROM elig GROUP BY ALL) e USING (WindowLength_sec)""",
    "retained_percent",
)(lambda s: reports.quality_retention(Q.quality_by_threshold(s.master, (5.0, 10.0, 20.0)), s.eligibility))
query("rpt17_feature_directions")(lambda s: reports.feature_directions(feature_fits(s)))

# ---- streaming operator on a batch

query(
    "str1_event_windows",
    """SELECT start, start + INTERVAL 10 MINUTE AS "end", user_id, count(*) AS n, avg(value) AS ECG_Mean, stddev_pop(value) AS ECG_STD, avg(60000 / (600 + 4 * value)) AS MeanHR, avg(600 + 4 * value) AS MeanRR, stddev_samp(600 + 4 * value) AS SDNN
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP) - k * INTERVAL 5 MINUTE AS start FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL""",
    "ECG_Mean ECG_STD MeanHR MeanRR SDNN",
)(lambda spark, d: stream_windows(SRC.read(spark, d, "events")))
