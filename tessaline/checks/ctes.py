"""DuckDB common table expressions that rebuild the study's tables, independently of the Spark plans."""

from __future__ import annotations

import re

from tessaline.config import ALL23, FAMILIES, LOG1P, REDUCED_CANDIDATES
from tessaline.plans.study import CONFIGURATIONS

LONG = lambda src, ids, feats: " UNION ALL ".join(
    f"SELECT {ids}, '{f}' AS Feature, " + (f"CASE WHEN {f} >= 0 THEN ln(1 + {f}) END" if f in LOG1P else f) + f" AS value FROM {src}" for f in feats
)
WHOLE = " AND ".join(f"{f} IS NOT NULL" for f in ALL23)
GROUP = "WindowLength_sec, SearchWindow, Method, TransitionType"

CTES: dict[str, str] = {}
CTES["samples"] = """
SELECT printf('P%02d', (user_id % (SELECT greatest(10, count(DISTINCT user_id) // 50) FROM events))::INT) AS Subject, (us // 259200000000 + 1)::INT AS Session,
  CASE WHEN (us // 259200000000 + 1) % 2 = 1 THEN 'A' ELSE 'NA' END AS ConditionCode,
  (us % 259200000000)::DOUBLE / 720e6 AS t, value AS x, 600 + 4 * value AS rr
FROM (SELECT *, epoch_us(ts::TIMESTAMP) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"""
CTES["lengths"] = "SELECT unnest([30, 45, 60]) AS WindowLength_sec"
CTES["assigned"] = """
SELECT Subject, Session, WindowLength_sec, t, x, rr,
  unnest(range(greatest(0, floor((t - WindowLength_sec) / 5e0)::INT + 1), least(floor(t / 5e0), floor((360 - WindowLength_sec) / 5e0))::INT + 1))::INT AS WindowIndex
FROM samples, lengths"""
CTES["rr_rows"] = """
SELECT *, row_number() OVER w AS i, CASE WHEN rr >= 300 AND rr <= 2000 THEN rr END AS valid
FROM assigned WINDOW w AS (PARTITION BY Subject, Session, WindowLength_sec, WindowIndex ORDER BY t, x, rr)"""
CTES["rr_near"] = """
SELECT *, list_filter(list(valid) OVER (PARTITION BY Subject, Session, WindowLength_sec, WindowIndex ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), lambda v: v IS NOT NULL) AS near
FROM rr_rows"""
CTES["rr_mid"] = "SELECT *, list_aggregate(near, 'median') AS m FROM rr_near"
CTES["rr_flag"] = """
SELECT *, coalesce(len(near) >= 3 AND d > 0 AND abs(valid - m) > 3 * 1.4826 * d, false) AS odd
FROM (SELECT *, list_aggregate(list_transform(near, lambda v: abs(v - m)), 'median') AS d FROM rr_mid)"""
CTES["rr_clean"] = """
SELECT *, coalesce(h, pv + (nv - pv) * (i - pi) / (ni - pi)::DOUBLE, pv, nv) AS nn FROM (
  SELECT *, last_value(h IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN h IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
    first_value(h IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN h IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni
  FROM (SELECT *, CASE WHEN NOT odd THEN valid END AS h FROM rr_flag)
  WINDOW a AS (PARTITION BY Subject, Session, WindowLength_sec, WindowIndex ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY Subject, Session, WindowLength_sec, WindowIndex ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
CTES["feats"] = """
SELECT Subject, Session, WindowLength_sec, WindowIndex, count(*) AS n, count(nn) AS Num_RR_Clean,
  sum(CASE WHEN valid IS NULL THEN 1 ELSE 0 END)::INT AS RR_Invalid, sum(odd::INT)::INT AS RR_HampelOutliers,
  avg(x) AS ECG_Mean, stddev_pop(x) AS ECG_STD, var_pop(x) AS ECG_VAR, sqrt(avg(x * x)) AS ECG_RMS,
  CASE WHEN count(*) >= 3 AND var_pop(x) > 0 THEN skewness(x) END AS ECG_Skew, CASE WHEN count(*) >= 4 AND var_pop(x) > 0 THEN kurtosis(x) END AS ECG_Kurtosis,
  avg(60000 / nn) AS MeanHR, stddev_pop(60000 / nn) AS StdHR, min(60000 / nn) AS MinHR, max(60000 / nn) AS MaxHR, avg(nn) AS MeanRR,
  CASE WHEN count(nn) >= 2 THEN stddev_samp(nn) END AS SDNN, sqrt(avg(df * df)) AS RMSSD, CASE WHEN count(df) >= 2 THEN stddev_samp(df) END AS SDSD,
  CASE WHEN count(nn) >= 2 THEN median(nn) END AS MedianNN, CASE WHEN count(nn) >= 2 THEN mad(nn) END AS MADNN,
  100 * avg((abs(df) > 20)::INT) AS pNN20, 100 * avg((abs(df) > 50)::INT) AS pNN50
FROM (SELECT *, nn - lag(nn) OVER (PARTITION BY Subject, Session, WindowLength_sec, WindowIndex ORDER BY i) AS df FROM rr_clean) GROUP BY ALL"""
CTES["feats2"] = """
SELECT *, CASE WHEN SD2 > 1e-9 THEN SD1 / SD2 END AS SD1_SD2, CASE WHEN SD1 > 1e-9 THEN SD2 / SD1 END AS CSI, CASE WHEN SD1 > 1e-9 AND SD2 > 1e-9 THEN log10(16 * SD1 * SD2) END AS CVI
FROM (SELECT *, CASE WHEN Num_RR_Clean >= 3 THEN SDSD / sqrt(2e0) END AS SD1,
  CASE WHEN Num_RR_Clean >= 3 AND SDSD IS NOT NULL THEN sqrt(greatest(0, 2 * SDNN * SDNN - 0.5 * SDSD * SDSD)) END AS SD2 FROM feats)"""
CTES["master"] = f"""
SELECT *, WindowFailureReason = '' AS WindowValid FROM (
  SELECT printf('%s_S%02d_L%d_W%06d', g.Subject, g.Session, g.WindowLength_sec, g.WindowIndex) AS WindowID, g.Subject, g.Session, g.ConditionCode, g.WindowLength_sec, 5 AS StepSize_sec,
    100e0 * (g.WindowLength_sec - 5) / g.WindowLength_sec AS OverlapPercent, g.WindowIndex, g.WindowIndex * 5e0 AS StartTime_sec, g.WindowIndex * 5e0 + g.WindowLength_sec AS EndTime_sec,
    g.WindowIndex * 5e0 + g.WindowLength_sec / 2e0 AS CenterTime_sec, 360e0 AS SessionDuration_sec, coalesce(n, 0)::INT AS Num_Samples, Num_RR_Clean::INT AS Num_RR_Clean, RR_Invalid, RR_HampelOutliers,
    RR_Invalid + RR_HampelOutliers AS RR_Corrected, 100e0 * (RR_Invalid + RR_HampelOutliers) / n AS RR_CorrectedPercent,
    concat_ws(';', CASE WHEN coalesce(n, 0) = 0 THEN 'no_samples' END, CASE WHEN n > 0 AND n < 4 THEN 'few_samples' END, CASE WHEN n > 0 AND ECG_VAR <= 0 THEN 'flat_signal' END,
      CASE WHEN n > 0 AND Num_RR_Clean < 3 THEN 'few_rr_intervals' END, CASE WHEN 100e0 * (RR_Invalid + RR_HampelOutliers) / n > 20 THEN 'rr_corrected_percent' END) AS WindowFailureReason,
    {", ".join(ALL23)}
  FROM (SELECT s.*, WindowLength_sec, unnest(range(0, floor((360 - WindowLength_sec) / 5e0)::INT + 1))::INT AS WindowIndex
        FROM (SELECT DISTINCT Subject, Session, ConditionCode FROM samples) s, lengths) g
  LEFT JOIN feats2 f ON g.Subject = f.Subject AND g.Session = f.Session AND g.WindowLength_sec = f.WindowLength_sec AND g.WindowIndex = f.WindowIndex)"""
CTES["sessions"] = "SELECT Subject, Session, min(ConditionCode) AS ConditionCode, min(SessionDuration_sec) AS SessionDuration_sec FROM master GROUP BY ALL"
CTES["inventory"] = """
SELECT a.Subject, a.Session AS PreSession, b.Session AS PostSession, a.ConditionCode AS PreConditionCode, b.ConditionCode AS PostConditionCode,
  a.SessionDuration_sec AS PreDuration_sec, b.SessionDuration_sec AS PostDuration_sec, a.ConditionCode || '_to_' || b.ConditionCode AS TransitionType, a.Session AS BoundaryOrder,
  a.Subject || '_B' || a.Session || '_' || a.ConditionCode || '_to_' || b.ConditionCode AS BoundaryID
FROM sessions a JOIN sessions b ON a.Subject = b.Subject AND b.Session = a.Session + 1 WHERE a.ConditionCode <> b.ConditionCode"""
CTES["obs"] = """
SELECT i.BoundaryID, i.TransitionType, i.BoundaryOrder, q.*, q.CenterTime_sec - q.SessionDuration_sec AS RelativeCenter_sec, 'pre' AS Side
FROM quality q JOIN inventory i ON q.Subject = i.Subject AND q.Session = i.PreSession WHERE q.CenterTime_sec - q.SessionDuration_sec >= -60.000001
UNION ALL
SELECT i.BoundaryID, i.TransitionType, i.BoundaryOrder, q.*, q.CenterTime_sec, 'post'
FROM quality q JOIN inventory i ON q.Subject = i.Subject AND q.Session = i.PostSession WHERE q.CenterTime_sec <= 60.000001"""
CTES["elig"] = """
SELECT i.BoundaryID, i.Subject, i.TransitionType, i.BoundaryOrder, l.WindowLength_sec, count(o.BoundaryID) FILTER (Side = 'pre') AS PreCount, count(o.BoundaryID) FILTER (Side = 'post') AS PostCount,
  count(o.BoundaryID) FILTER (Side = 'pre') >= 5 AND count(o.BoundaryID) FILTER (Side = 'post') >= 5 AS Eligible
FROM inventory i CROSS JOIN lengths l LEFT JOIN obs o ON o.BoundaryID = i.BoundaryID AND o.WindowLength_sec = l.WindowLength_sec
GROUP BY i.BoundaryID, i.Subject, i.TransitionType, i.BoundaryOrder, l.WindowLength_sec"""
CTES["dense"] = """
SELECT t.Subject, t.Session, t.ConditionCode, t.WindowLength_sec, t0, min(q.SessionDuration_sec) AS SessionDuration_sec,
  count(*) FILTER (q.EndTime_sec <= t0 + 1e-6 AND q.CenterTime_sec >= t0 - 60 - 1e-6) AS PreCount, count(*) FILTER (q.StartTime_sec >= t0 - 1e-6 AND q.CenterTime_sec <= t0 + 60 + 1e-6) AS PostCount
FROM (SELECT Subject, Session, ConditionCode, WindowLength_sec, round_even(StartTime_sec, 6) AS t0 FROM quality
      INTERSECT SELECT Subject, Session, ConditionCode, WindowLength_sec, round_even(EndTime_sec, 6) FROM quality) t
JOIN quality q ON q.Subject = t.Subject AND q.Session = t.Session AND q.WindowLength_sec = t.WindowLength_sec
GROUP BY t.Subject, t.Session, t.ConditionCode, t.WindowLength_sec, t0 HAVING PreCount >= 5 AND PostCount >= 5"""
CTES["thin"] = """
SELECT Subject, Session, WindowLength_sec, 0 AS k, min(t0) AS t0 FROM dense GROUP BY ALL
UNION ALL
SELECT h.Subject, h.Session, h.WindowLength_sec, h.k + 1, (SELECT min(d.t0) FROM dense d WHERE d.Subject = h.Subject AND d.Session = h.Session AND d.WindowLength_sec = h.WindowLength_sec
  AND d.t0 >= h.t0 + greatest(120, 120 + h.WindowLength_sec) - 1e-6) AS nt FROM thin h WHERE nt IS NOT NULL"""
CTES["cand"] = """
SELECT d.Subject, d.Session, d.ConditionCode, d.WindowLength_sec, d.SessionDuration_sec, h.k AS BlockIndex, h.t0 AS PseudoTime_sec, d.PreCount, d.PostCount,
  count(*) OVER (PARTITION BY d.Subject, d.Session, d.WindowLength_sec) AS IndependentCandidates,
  (SELECT count(*) FROM dense e WHERE e.Subject = d.Subject AND e.Session = d.Session AND e.WindowLength_sec = d.WindowLength_sec) AS DenseCandidates,
  printf('%s_S%d_%s_BLK%03d', d.Subject, d.Session, d.ConditionCode, h.k) AS CandidateBlockID, printf('%s_S%d_%s_T%d', d.Subject, d.Session, d.ConditionCode, h.t0::INT) AS CandidateID,
  h.t0 / d.SessionDuration_sec AS RelativeSessionPosition
FROM thin h JOIN dense d ON h.Subject = d.Subject AND h.Session = d.Session AND h.WindowLength_sec = d.WindowLength_sec AND h.t0 = d.t0"""
CTES["folds"] = """
SELECT *, ((row_number() OVER (PARTITION BY WindowLength_sec, Subject, ConditionCode ORDER BY Session, BlockIndex) - 1
  + (('0x' || substr(sha256('42|' || Subject || '|' || ConditionCode), 1, 16))::UBIGINT % 4)::INT) % 4)::INT AS PseudoFold FROM cand"""
CTES["matches"] = """
SELECT * EXCLUDE (in_block) FROM (
  SELECT *, row_number() OVER (PARTITION BY WindowLength_sec, MatchedRealBoundaryID, PseudoCondition ORDER BY MatchScore, PseudoSession, PseudoTime_sec, CandidateID)::INT AS MatchRank,
    MatchedRealBoundaryID || '__' || PseudoCondition || '__' || CandidateID AS PseudoMatchID
  FROM (SELECT *, row_number() OVER (PARTITION BY WindowLength_sec, MatchedRealBoundaryID, PseudoCondition, CandidateBlockID ORDER BY MatchScore, CandidateID) AS in_block FROM (
    SELECT e.Subject, e.WindowLength_sec, e.BoundaryID AS MatchedRealBoundaryID, e.TransitionType, e.BoundaryOrder, c.ConditionCode AS PseudoCondition, c.CandidateID, c.CandidateBlockID, c.PseudoFold, c.Session AS PseudoSession, c.PseudoTime_sec,
      CASE WHEN i.PreConditionCode = c.ConditionCode THEN i.PreSession ELSE i.PostSession END AS TargetSession, e.PreCount AS TargetPreCount, e.PostCount AS TargetPostCount,
      abs(c.PreCount - e.PreCount) + abs(c.PostCount - e.PostCount) AS CountMismatch, abs(c.Session - CASE WHEN i.PreConditionCode = c.ConditionCode THEN i.PreSession ELSE i.PostSession END) AS SessionDistance,
      abs(c.RelativeSessionPosition - 0.5) AS PositionDistance,
      round_even(100e0 * (abs(c.PreCount - e.PreCount) + abs(c.PostCount - e.PostCount)) + 3e0 * abs(c.Session - CASE WHEN i.PreConditionCode = c.ConditionCode THEN i.PreSession ELSE i.PostSession END) + abs(c.RelativeSessionPosition - 0.5), 9) AS MatchScore
    FROM elig e JOIN inventory i ON e.BoundaryID = i.BoundaryID JOIN folds c ON c.Subject = e.Subject AND c.WindowLength_sec = e.WindowLength_sec WHERE e.Eligible)) WHERE in_block = 1) WHERE MatchRank <= 50"""
CTES["pobs"] = """
SELECT c.CandidateID, c.CandidateBlockID, c.PseudoTime_sec, q.*, q.CenterTime_sec - c.PseudoTime_sec AS RelativeCenter_sec
FROM quality q JOIN cand c ON q.Subject = c.Subject AND q.Session = c.Session AND q.WindowLength_sec = c.WindowLength_sec
WHERE (q.EndTime_sec <= c.PseudoTime_sec + 1e-6 AND q.CenterTime_sec >= c.PseudoTime_sec - 60 - 1e-6) OR (q.StartTime_sec >= c.PseudoTime_sec - 1e-6 AND q.CenterTime_sec <= c.PseudoTime_sec + 60 + 1e-6)"""
for kind, keys in (("real", "SELECT Subject, BoundaryID AS NormKey, [PreSession, PostSession] AS excluded FROM inventory"), ("pseudo", "SELECT Subject, Subject || '_S' || Session AS NormKey, [Session] AS excluded FROM sessions")):
    CTES[f"src_{kind}"] = f"""
SELECT * FROM (SELECT *, CASE WHEN sa >= 5 AND sna >= 5 THEN 'stable_balanced' WHEN qa >= 5 AND qna >= 5 THEN 'quality_balanced' WHEN qa + qna >= 10 THEN 'quality_unbalanced' WHEN sa + sna >= 10 THEN 'stable_unbalanced' END AS NormSource
  FROM (SELECT *, count(*) FILTER (ConditionCode = 'A' AND stable) OVER g AS sa, count(*) FILTER (ConditionCode = 'NA' AND stable) OVER g AS sna, count(*) FILTER (ConditionCode = 'A') OVER g AS qa, count(*) FILTER (ConditionCode = 'NA') OVER g AS qna
    FROM (SELECT q.*, k.NormKey, q.StartTime_sec >= 60 AND q.EndTime_sec <= q.SessionDuration_sec - 60 AS stable FROM quality q JOIN ({keys}) k ON q.Subject = k.Subject WHERE NOT list_contains(k.excluded, q.Session))
    WINDOW g AS (PARTITION BY NormKey, WindowLength_sec))) WHERE NormSource IS NOT NULL AND (NormSource LIKE 'quality%' OR stable)"""
    CTES[f"sample_{kind}"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY NormKey, WindowLength_sec, ConditionCode ORDER BY ('0x' || substr(sha256('42|' || NormKey || '|' || WindowID), 1, 16))::UBIGINT, WindowID) AS turn,
  CASE WHEN NormSource LIKE '%\\_balanced' ESCAPE '\\' THEN least(count(*) FILTER (ConditionCode = 'A') OVER g, count(*) FILTER (ConditionCode = 'NA') OVER g) ELSE count(*) OVER g END AS most
  FROM src_{kind} WINDOW g AS (PARTITION BY NormKey, WindowLength_sec)) WHERE turn <= most"""
    CTES[f"norm_{kind}"] = f"""
SELECT NormKey, WindowLength_sec, NormSource, Feature, n, centre, CASE WHEN md > 1e-12 THEN md WHEN iq > 1e-12 THEN iq WHEN sd > 1e-12 THEN sd ELSE 1 END AS scale,
  CASE WHEN md > 1e-12 THEN 'MAD' WHEN iq > 1e-12 THEN 'IQR' WHEN sd > 1e-12 THEN 'SD' ELSE 'constant_fallback' END AS method
FROM (SELECT NormKey, WindowLength_sec, NormSource, Feature, count(*) AS n, median(value) AS centre, 1.4826 * mad(value) AS md, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS iq, stddev_samp(value) AS sd
  FROM ({LONG(f"sample_{kind}", "NormKey, WindowLength_sec, NormSource", ALL23)}) WHERE value IS NOT NULL GROUP BY ALL)"""
# stable windows on the series' scale, and from them covariances, their shrinkage, and by elimination a root of their inverse
HASHED = "('0x' || substr(sha256('42|' || WindowID), 1, 16))::UBIGINT"
CTES["stable"] = "SELECT * FROM quality WHERE StartTime_sec >= 60 AND EndTime_sec <= SessionDuration_sec - 60"
CTES["crossfit"] = f"""
SELECT l.WindowID, l.Subject, l.Session, l.ConditionCode, l.WindowIndex, l.WindowLength_sec, l.Feature, (l.value - p.centre) / p.scale AS z
FROM ({LONG("stable", "WindowID, Subject, Session, ConditionCode, WindowIndex, WindowLength_sec", ALL23)}) l
JOIN norm_pseudo p ON p.NormKey = l.Subject || '_S' || l.Session AND p.WindowLength_sec = l.WindowLength_sec AND p.Feature = l.Feature WHERE l.value IS NOT NULL"""
CTES["cross_ids"] = f"SELECT WindowID, Subject, ConditionCode, WindowIndex, WindowLength_sec FROM crossfit GROUP BY ALL HAVING count(*) = {len(ALL23)}"
CTES["fit_ids"] = f"""
SELECT WindowID, WindowLength_sec FROM (SELECT *, row_number() OVER (PARTITION BY WindowLength_sec, Subject, ConditionCode ORDER BY {HASHED}, WindowID) AS turn FROM (
  SELECT *, count(*) FILTER (apart) OVER (PARTITION BY WindowLength_sec) >= 100 AS enough FROM (SELECT *, WindowIndex % ceil(WindowLength_sec / 5e0) = 0 AS apart FROM cross_ids)) WHERE apart OR NOT enough) WHERE turn <= 40"""
CTES["rank_ids"] = f"SELECT WindowID, WindowLength_sec FROM (SELECT *, row_number() OVER (PARTITION BY WindowLength_sec, Subject, ConditionCode ORDER BY {HASHED}, WindowID) AS turn FROM cross_ids WHERE WindowLength_sec = 30) WHERE turn <= 50"
# the pruned space: candidates in order, each kept if no kept one has an absolute rank correlation of 0.9 or more with it
CTES["wanted"] = f"SELECT unnest({REDUCED_CANDIDATES}) AS Feature, unnest(range({len(REDUCED_CANDIDATES)}))::INT AS k"
CTES["rank_long"] = """
SELECT WindowID, k, Feature, rank() OVER (PARTITION BY Feature ORDER BY round(z, 9)) + (count(*) OVER (PARTITION BY Feature, round(z, 9)) - 1) / 2e0 AS r
FROM crossfit JOIN rank_ids USING (WindowID, WindowLength_sec) JOIN wanted USING (Feature)"""
CTES["rank_rho"] = "SELECT a.Feature AS A, b.Feature AS B, b.k, corr(a.r, b.r) AS Rho FROM rank_long a JOIN rank_long b ON a.WindowID = b.WindowID AND a.k < b.k GROUP BY ALL"
CTES["conflicts"] = "SELECT w.k, w.Feature, coalesce(list(q.A) FILTER (abs(q.Rho) >= 0.9), []) AS bad FROM wanted w LEFT JOIN rank_rho q ON q.B = w.Feature GROUP BY ALL"
CTES["keep"] = """
SELECT 0 AS k, []::VARCHAR[] AS kept UNION ALL
SELECT n.k + 1, CASE WHEN len(list_intersect(n.kept, c.bad)) = 0 THEN list_append(n.kept, c.Feature) ELSE n.kept END FROM keep n JOIN conflicts c ON c.k = n.k"""
CTES["lags"] = """
SELECT Subject, Session, WindowLength_sec, Feature, r FROM (
  SELECT Subject, Session, WindowLength_sec, Feature, CASE WHEN count(*) >= 4 AND stddev_pop(z) > 1e-12 AND stddev_pop(before) > 1e-12 THEN corr(z, before) END AS r FROM (
    SELECT *, lag(z) OVER (PARTITION BY Subject, Session, WindowLength_sec, Feature ORDER BY WindowIndex) AS before FROM crossfit c JOIN cross_ids USING (WindowID, WindowLength_sec, Subject, ConditionCode, WindowIndex))
  WHERE before IS NOT NULL GROUP BY ALL) WHERE r IS NOT NULL"""
CTES["rho"] = "SELECT WindowLength_sec, greatest(0, least(0.98, median(r))) AS lag1_rho FROM lags JOIN columns USING (Feature) GROUP BY ALL"
CTES["fitted"] = "SELECT c.WindowLength_sec, c.WindowID, k, p, z AS v FROM crossfit c JOIN fit_ids f ON f.WindowID = c.WindowID AND f.WindowLength_sec = c.WindowLength_sec JOIN columns USING (Feature)"
CTES["shrunk"] = """
SELECT WindowLength_sec, p, i, j, (1 - share) * c + CASE WHEN i = j THEN share * mu ELSE 0 END AS value FROM (
  SELECT *, CASE WHEN spread > 0 THEN greatest(0, least(spread, (fourth - square) / (p * n))) / spread ELSE 0 END AS share FROM (
    SELECT *, sum(c * c) OVER w AS square, sum(CASE WHEN i = j THEN c END) OVER w / p AS mu, (sum(c * c) OVER w - p * (sum(CASE WHEN i = j THEN c END) OVER w / p) ** 2) / p AS spread
    FROM (SELECT a.WindowLength_sec, a.p, a.k AS i, b.k AS j, covar_pop(a.v, b.v) AS c, count(*) AS n FROM fitted a JOIN fitted b ON a.WindowID = b.WindowID AND a.WindowLength_sec = b.WindowLength_sec GROUP BY ALL)
      JOIN (SELECT WindowLength_sec, avg(l * l) AS fourth FROM (SELECT WindowLength_sec, WindowID, sum(d * d) AS l FROM (SELECT *, v - avg(v) OVER (PARTITION BY WindowLength_sec, k) AS d FROM fitted) GROUP BY ALL) GROUP BY ALL) USING (WindowLength_sec)
    WINDOW w AS (PARTITION BY WindowLength_sec)))"""
CTES["elim"] = """
SELECT WindowLength_sec, p, 0 AS k, i, j, value AS v FROM shrunk UNION ALL SELECT WindowLength_sec, p, 0, i, j + p, CASE WHEN i = j THEN 1e0 ELSE 0e0 END FROM shrunk
UNION ALL
SELECT WindowLength_sec, p, k + 1, i, j, CASE WHEN i > k THEN v - own / top * above ELSE v END FROM (
  SELECT *, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY WindowLength_sec, i) AS own, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY WindowLength_sec, j) AS above,
    max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY WindowLength_sec) AS top FROM elim WHERE k < p - 1)"""
CTES["whitening"] = """
SELECT WindowLength_sec, i AS dim, Feature, m.v / sqrt(top) AS w FROM (SELECT *, max(CASE WHEN i = j THEN v END) OVER (PARTITION BY WindowLength_sec, i) AS top FROM elim e WHERE e.k = e.p - 1) m JOIN columns c ON m.j = c.k + c.p"""
SEARCHES = "(SELECT 'post_only' AS SearchWindow, 0e0 AS sa, 60e0 AS sb UNION ALL SELECT 'anticipatory', -30e0, 60e0)"
for kind, key in (("real", "BoundaryID"), ("pseudo", "CandidateID")):
    s = f"{key}, WindowLength_sec"
    CTES[f"idx_{kind}"] = f"SELECT {s}, Feature, RelativeCenter_sec AS t, z, row_number() OVER (PARTITION BY {s}, Feature ORDER BY RelativeCenter_sec) - 1 AS idx, count(*) OVER (PARTITION BY {s}, Feature) AS n FROM long_{kind}"
    CTES[f"std_{kind}"] = f"""
SELECT i.* REPLACE (CASE WHEN f.m IS NULL THEN i.z ELSE (i.z - f.m) / CASE WHEN f.md > 1e-12 THEN f.md WHEN f.sd > 1e-12 THEN f.sd ELSE 1 END END AS z) FROM idx_{kind} i
LEFT JOIN (SELECT {s}, Feature, median(z) AS m, 1.4826 * mad(z) AS md, stddev_samp(z) AS sd FROM idx_{kind} WHERE t < 0 GROUP BY ALL HAVING count(*) >= 2) f USING ({s}, Feature)"""
    CTES[f"cost_{kind}"] = f"""
SELECT {s}, SearchWindow, idx, t, n, sum(qq - sz * sz / n) AS sse0, sum(l * l / idx + (sz - l) * (sz - l) / (n - idx) - sz * sz / n) AS gain, count(*) AS d
FROM (SELECT *, sum(z) OVER w AS sz, sum(z * z) OVER w AS qq, sum(z) OVER (PARTITION BY {s}, Feature ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
  FROM std_{kind} WINDOW w AS (PARTITION BY {s}, Feature)), {SEARCHES} WHERE idx >= 5 AND idx <= n - 5 AND t >= sa AND t <= sb GROUP BY {s}, SearchWindow, idx, t, n"""
    CTES[f"white_{kind}"] = f"""
SELECT *, row_number() OVER (PARTITION BY {s}, Feature ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY {s}, Feature) AS n FROM (
  SELECT l.{key}, l.WindowLength_sec, w.dim AS Feature, l.RelativeCenter_sec AS t, sum(l.z * w.w) AS z FROM long_{kind} l JOIN whitening w ON w.WindowLength_sec = l.WindowLength_sec AND w.Feature = l.Feature GROUP BY ALL)"""
    CTES[f"ic_{kind}"] = f"""
SELECT {s}, SearchWindow, idx, t, sum(l * l / idx + (sz - l) * (sz - l) / (n - idx) - sz * sz / n) - (count(*) + 1) * ln(greatest(2e0, least(n, n * (1 - lag1_rho) / (1 + lag1_rho)))) AS score
FROM (SELECT *, sum(z) OVER w AS sz, sum(z) OVER (PARTITION BY {s}, Feature ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
  FROM white_{kind} JOIN rho USING (WindowLength_sec) WINDOW w AS (PARTITION BY {s}, Feature)), {SEARCHES} WHERE idx >= 5 AND idx <= n - 5 AND t >= sa AND t <= sb GROUP BY {s}, SearchWindow, idx, t, n, lag1_rho"""
    CTES[f"bridge_{kind}"] = f"""
SELECT {s}, SearchWindow, idx, t, sqrt(sum(v * v)) AS score FROM (
  SELECT *, (lc - idx / n::DOUBLE * ac) / sqrt(idx * (n - idx) / n::DOUBLE) AS v FROM (
    SELECT *, sum(c) OVER (PARTITION BY {s}, Feature ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc, sum(c) OVER (PARTITION BY {s}, Feature) AS ac FROM (
      SELECT *, z - coalesce(avg(CASE WHEN t < 0 THEN z END) OVER w, avg(z) OVER w) AS c FROM white_{kind} WINDOW w AS (PARTITION BY {s}, Feature))) WHERE idx > 0), {SEARCHES}
WHERE idx >= 5 AND idx <= n - 5 AND t >= sa AND t <= sb GROUP BY {s}, SearchWindow, idx, t"""
    CTES[f"moving_{kind}"] = f"""
SELECT {s}, SearchWindow, idx, t, sqrt(2.5e0) * sqrt(sum(v * v)) AS score FROM (
  SELECT *, avg(z) OVER (PARTITION BY {s}, Feature ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) - avg(z) OVER (PARTITION BY {s}, Feature ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS v FROM white_{kind}), {SEARCHES}
WHERE idx >= 5 AND idx <= n - 5 AND t >= sa AND t <= sb GROUP BY {s}, SearchWindow, idx, t"""
    bic = lambda e, k: f"(n * d * ln(greatest({e}, 2.2250738585072014e-308) / (n * d)) + {k} * ln(n * d))"
    CTES[f"scores_{kind}"] = f"""
SELECT {s}, SearchWindow, Method, Score, idx::INT AS SplitIndex, t AS CandidateLatency_sec FROM (
  SELECT *, row_number() OVER (PARTITION BY {s}, SearchWindow, Method ORDER BY Score DESC, idx) AS turn FROM (
    SELECT {s}, SearchWindow, idx, t, 'BinSeg_L2' AS Method, round(gain, 9) AS Score FROM cost_{kind}
    UNION ALL SELECT {s}, SearchWindow, idx, t, 'LegacyBIC_fixed6', round({bic("sse0", "d")} - {bic("sse0 - gain", "(2 * d + 1)")}, 9) FROM cost_{kind}
    UNION ALL SELECT {s}, SearchWindow, idx, t, 'CovIC', round(score, 9) FROM ic_{kind}
    UNION ALL SELECT {s}, SearchWindow, idx, t, 'CUSUM', round(score, 9) FROM bridge_{kind}
    UNION ALL SELECT {s}, SearchWindow, idx, t, 'MOSUM', round(score, 9) FROM moving_{kind})) WHERE turn = 1"""
CTES["real_scores"] = "SELECT s.*, i.Subject, i.TransitionType, i.BoundaryOrder FROM scores_real s JOIN inventory i USING (BoundaryID)"
CTES["expanded"] = "SELECT m.*, s.SearchWindow, s.Method, s.Score, s.CandidateLatency_sec FROM matches m JOIN scores_pseudo s ON m.CandidateID = s.CandidateID AND m.WindowLength_sec = s.WindowLength_sec"
CTES["blocks"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP}, PseudoFold, CandidateBlockID, PseudoCondition ORDER BY MatchScore, MatchRank, PseudoMatchID) AS turn FROM expanded) WHERE turn = 1"""
CTES["thresholds"] = f"""
SELECT f.WindowLength_sec, f.SearchWindow, f.Method, f.TransitionType, f.fold AS CalibrationFold, f.Threshold, f.CalibrationBlocks, count(DISTINCT h.CandidateBlockID) AS HeldoutBlocks,
  avg(coalesce((h.Score >= f.Threshold)::INT, 0)) AS HeldoutFPR
FROM (SELECT b.WindowLength_sec, b.SearchWindow, b.Method, b.TransitionType, d.fold, list_sort(list(b.Score) FILTER (b.PseudoFold <> d.fold))[ceil(0.95::DOUBLE * (count(*) FILTER (b.PseudoFold <> d.fold) - 1))::INT + 1] AS Threshold,
    count(DISTINCT b.CandidateBlockID) FILTER (b.PseudoFold <> d.fold) AS CalibrationBlocks
  FROM (SELECT DISTINCT {GROUP}, PseudoFold AS fold FROM blocks) d JOIN blocks b USING ({GROUP}) GROUP BY ALL) f
LEFT JOIN blocks h ON h.WindowLength_sec = f.WindowLength_sec AND h.SearchWindow = f.SearchWindow AND h.Method = f.Method AND h.TransitionType = f.TransitionType AND h.PseudoFold = f.fold GROUP BY ALL"""
NAME = "CASE WHEN Method = 'LegacyBIC_fixed6' THEN 'LegacyBIC_crossfit' ELSE Method || '_crossfit' END"
SHOWN = "WindowLength_sec, SearchWindow, {m} AS Method, Method AS SourceMethod, BoundaryKind, BoundaryID, MatchedRealBoundaryID, Subject, TransitionType, BoundaryOrder, PseudoCondition, CandidateBlockID, PseudoFold, MatchScore, Score, {t} AS Threshold, coalesce(Score >= {t}, false) AS Detected, CASE WHEN Score >= {t} THEN CandidateLatency_sec END AS Latency_sec"
CTES["rp"] = "SELECT *, 'Real' AS BoundaryKind, BoundaryID AS MatchedRealBoundaryID, NULL::VARCHAR AS PseudoCondition, NULL::VARCHAR AS CandidateBlockID, NULL::INT AS PseudoFold, NULL::DOUBLE AS MatchScore FROM real_scores"
CTES["pp"] = "SELECT *, 'Pseudo' AS BoundaryKind, PseudoMatchID AS BoundaryID FROM expanded"
CTES["results"] = f"""
SELECT {SHOWN.format(m=NAME, t="T")} FROM rp JOIN (SELECT {GROUP}, median(Threshold) AS T FROM thresholds GROUP BY ALL) USING ({GROUP})
UNION ALL SELECT {SHOWN.format(m=NAME, t="T")} FROM pp JOIN (SELECT {GROUP}, CalibrationFold AS PseudoFold, Threshold AS T FROM thresholds) USING ({GROUP}, PseudoFold)
UNION ALL SELECT {SHOWN.format(m="'LegacyBIC_fixed6'", t="6e0")} FROM rp WHERE Method = 'LegacyBIC_fixed6'
UNION ALL SELECT {SHOWN.format(m="'LegacyBIC_fixed6'", t="6e0")} FROM pp WHERE Method = 'LegacyBIC_fixed6'"""
CTES["p_raw"] = f"""
SELECT r.WindowLength_sec, r.SearchWindow, r.Method, r.TransitionType, r.BoundaryID, c.PseudoCondition, r.Subject, r.BoundaryOrder, r.Score AS RealScore, count(b.Score) AS PseudoControls, median(b.Score) AS PseudoMedianScore,
  list_sort(list(b.Score) FILTER (b.Score IS NOT NULL))[ceil(0.95::DOUBLE * (count(b.Score) - 1))::INT + 1] AS PseudoQ95Score,
  CASE WHEN count(b.Score) > 0 THEN (1 + count(*) FILTER (b.Score >= r.Score)) / (count(b.Score) + 1)::DOUBLE END AS EmpiricalPValue
FROM real_scores r CROSS JOIN (SELECT unnest(['A', 'NA']) AS PseudoCondition) c
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP}, MatchedRealBoundaryID, CandidateBlockID, PseudoCondition ORDER BY MatchScore, MatchRank, PseudoMatchID) AS turn FROM expanded) WHERE turn = 1) b
  ON b.WindowLength_sec = r.WindowLength_sec AND b.SearchWindow = r.SearchWindow AND b.Method = r.Method AND b.TransitionType = r.TransitionType AND b.MatchedRealBoundaryID = r.BoundaryID AND b.PseudoCondition = c.PseudoCondition
GROUP BY ALL"""
CTES["p_values"] = f"""
SELECT * EXCLUDE (r, m), RealScore - PseudoMedianScore AS RealMinusPseudoMedian,
  CASE WHEN EmpiricalPValue IS NOT NULL THEN least(1, min(EmpiricalPValue * m / r) OVER (PARTITION BY {GROUP}, PseudoCondition, EmpiricalPValue IS NULL ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS EmpiricalQValue_BH
FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP}, PseudoCondition, EmpiricalPValue IS NULL ORDER BY EmpiricalPValue) AS r, count(EmpiricalPValue) OVER (PARTITION BY {GROUP}, PseudoCondition, EmpiricalPValue IS NULL) AS m FROM p_raw)"""
KINDKEYS = "WindowLength_sec, SearchWindow, Method, BoundaryKind, TransitionType, PseudoCondition"
CTES["dedup"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KINDKEYS}, CASE WHEN BoundaryKind = 'Real' THEN BoundaryID ELSE CandidateBlockID END ORDER BY MatchScore NULLS FIRST, BoundaryID) AS turn FROM results) WHERE turn = 1"""
CTES["rates"] = f"""
SELECT {KINDKEYS}, count(DISTINCT Subject) AS Participants, count(*) AS Boundaries, sum(Detected::INT)::BIGINT AS Detections, avg(Detected::INT) AS DetectionRate, median(Latency_sec) AS MedianLatency,
  quantile_cont(Latency_sec, 0.25) AS Q1Latency, quantile_cont(Latency_sec, 0.75) AS Q3Latency, median(Score) AS MedianScore FROM dedup GROUP BY ALL"""
PAIR = "MatchedRealBoundaryID, Subject, TransitionType, BoundaryOrder, WindowLength_sec, SearchWindow, Method"
CTES["pairs"] = f"""
SELECT r.*, p.* EXCLUDE ({PAIR}) FROM (SELECT {PAIR}, avg(Detected::INT) AS RealDetected, avg(Score) AS RealScore, avg(Latency_sec) AS RealLatency FROM results WHERE BoundaryKind = 'Real' GROUP BY ALL) r
JOIN (SELECT {PAIR}, PseudoCondition, avg(Detected::INT) AS PseudoDetected, avg(Score) AS PseudoScore, avg(Latency_sec) AS PseudoLatency, count(DISTINCT CandidateBlockID) AS PseudoControls FROM results WHERE BoundaryKind = 'Pseudo' GROUP BY ALL) p USING ({PAIR})"""


def configured(corrected: float, space: str) -> dict[str, str]:
    """The expressions that hang on a configuration. The pruned space's columns are those that SQL keeps itself."""
    pruned, features = space == "reduced", REDUCED_CANDIDATES if space == "reduced" else FAMILIES[space]
    kept = "JOIN columns USING (Feature)" if pruned else ""
    named = " UNION ALL ".join(f"SELECT '{f}' AS Feature, {k} AS k, {len(features)} AS p" for k, f in enumerate(features))
    return {
        "quality": f"SELECT * FROM master WHERE WindowValid AND RR_CorrectedPercent <= {corrected:g} AND {WHOLE}",
        "columns": f"SELECT unnest(kept) AS Feature, unnest(range(len(kept)))::INT AS k, len(kept)::INT AS p FROM keep n WHERE n.k = {len(features)}" if pruned else named,
        "long_real": f"""
SELECT l.BoundaryID, l.Subject, l.TransitionType, l.BoundaryOrder, l.RelativeCenter_sec, l.WindowLength_sec, l.Feature, (l.value - p.centre) / p.scale AS z
FROM ({LONG("obs", "BoundaryID, Subject, TransitionType, BoundaryOrder, RelativeCenter_sec, WindowLength_sec", features)}) l {kept}
JOIN norm_real p ON p.NormKey = l.BoundaryID AND p.WindowLength_sec = l.WindowLength_sec AND p.Feature = l.Feature
JOIN elig e ON e.BoundaryID = l.BoundaryID AND e.WindowLength_sec = l.WindowLength_sec AND e.Eligible WHERE l.value IS NOT NULL""",
        "long_pseudo": f"""
SELECT l.CandidateID, l.RelativeCenter_sec, l.WindowLength_sec, l.Feature, (l.value - p.centre) / p.scale AS z
FROM ({LONG("pobs", "CandidateID, Subject || '_S' || Session AS NormKey, RelativeCenter_sec, WindowLength_sec", features)}) l {kept}
JOIN norm_pseudo p ON p.NormKey = l.NormKey AND p.WindowLength_sec = l.WindowLength_sec AND p.Feature = l.Feature WHERE l.value IS NOT NULL""",
    }


CTES |= configured(20, "heart_rate_rr")


def grid_sql(select: str, doubles: str = "") -> str:
    """``select`` in every configuration."""
    return " UNION ALL ".join(f"SELECT *, {c:g}e0 AS RRThreshold, '{space}' AS Representation FROM ({sql(select, doubles, c, space)})" for c, space in CONFIGURATIONS)


def sql(select: str, doubles: str = "", corrected: float = 20, space: str = "heart_rate_rr") -> str:
    """``select`` with the expressions that it needs in front; the columns named in ``doubles`` are rounded."""
    needed: list[str] = []
    known = CTES | configured(corrected, space)

    def visit(text: str, own: str = "") -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN|,)\s+\(?([a-z_0-9]+)\b", text)):
            if word in known and word != own and word not in needed:
                visit(known[word], word)
                needed.append(word)

    visit(select)
    body = select
    if doubles:
        short = lambda c: f"CASE WHEN abs({c}) < 1000 THEN round(try_cast({c} AS DECIMAL(38,9)), 6)::DOUBLE ELSE round(try_cast({c} AS DECIMAL(38,9)), 3)::DOUBLE END AS {c}"
        body = f"SELECT * REPLACE ({', '.join(map(short, doubles.split()))}) FROM ({select})"
    with_ = ", ".join(f"{n} AS {'' if n in ('thin', 'elim', 'keep') else 'MATERIALIZED '}({known[n]})" for n in needed)
    return f"WITH RECURSIVE {with_} {body}" if needed else body
