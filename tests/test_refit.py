"""Leave-one-participant-out folds from sums against plain refits, and their scores against the detectors of one space."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessaline.operators import detectors as D
from tessaline.operators import matrix as M
from tessaline.operators import normalize as N
from tessaline.operators import refit as R

FEATURES = ["f0", "f1", "f2", "f3", "f4"]


@pytest.fixture(scope="module")
def windows(spark):
    """Six participants of two lengths; f4 is nearly f0, and one participant has other correlations than the rest."""
    rng = np.random.default_rng(8)
    parts = []
    for who in range(6):
        mix = rng.normal(size=(5, 5)) if who == 2 else np.eye(5) + 0.3 * np.triu(np.ones((5, 5)), 1)
        for session in range(1, 4):
            for length in (30, 60):
                x = rng.normal(size=(40 if who else 7, 5)).cumsum(0) * 0.3 @ mix + rng.normal(size=5)
                x[:, 4] = x[:, 0] + 0.05 * rng.normal(size=len(x))
                part = pd.DataFrame(x, columns=FEATURES).assign(Subject=f"P{who}", Session=session, WindowLength_sec=length, WindowIndex=range(len(x)), StepSize_sec=5, ConditionCode="A" if session % 2 else "NA")
                parts.append(part)
    frame = pd.concat(parts, ignore_index=True)
    frame["WindowID"] = [f"w{i}" for i in range(len(frame))]
    return frame, spark.createDataFrame(frame).withColumns({c: F.col(c).cast("int") for c in ("Session", "WindowLength_sec", "WindowIndex", "StepSize_sec")})


def test_folds_equal_plain_refits(spark, windows):
    """Every fold's pruning, covariance, components and autocorrelation are those of a fit on the other participants' windows."""
    frame, df = windows
    got = {(r["WindowLength_sec"], r["HeldOut"], r["Representation"]): r for r in R.fit_folds(df, FEATURES, FEATURES, least_apart=60).collect()}
    assert len(got) == 2 * 6 * 2
    for who in ("P0", "P2", "P5"):
        rest = df.filter(F.col("Subject") != who)
        apart = rest.filter("WindowIndex % ceil(WindowLength_sec / StepSize_sec) = 0")
        for length in (30, 60):
            own = apart if apart.filter(f"WindowLength_sec = {length}").count() >= 60 else rest
            sample = M.balanced_rows(own.filter(f"WindowLength_sec = {length}"), FEATURES)
            kept = M.pruned(M.balanced_rows(rest.filter(f"WindowLength_sec = {length}"), FEATURES, 50), FEATURES, "WindowLength_sec")[length][0]
            spaces, _ = M.fit_representations(sample, FEATURES, {"all": FEATURES}, {}, reduced=kept, whole=FEATURES)
            plain = {s.name: s for s in spaces[length]}
            long = rest.filter(f"WindowLength_sec = {length}").unpivot(["Subject", "Session", "WindowLength_sec", "WindowIndex"], FEATURES, "Feature", "z")
            loadings = spark.createDataFrame(M.loadings_of(spaces), "WindowLength_sec int, Feature string, Component int, centre double, weight double")
            turned = N.pooled_correlation(N.session_correlations(M.components_scores(long, loadings)), ["WindowLength_sec"]).first()["lag1_rho"]
            direct = N.pooled_correlation(N.session_correlations(long.filter(F.col("Feature").isin(kept))), ["WindowLength_sec"]).first()["lag1_rho"]
            for name, rho in (("reduced", direct), ("independent_pca", turned)):
                fold = got[length, who, name]
                assert fold["Features"] == list(plain[name].columns) and fold["TrainingParticipants"] == 5 and fold["rho"] == pytest.approx(rho, abs=1e-9)
                assert fold["TrainingRows"] == sample.count()
                table = {r["Representation"]: r for r in M.space_table(spark, spaces, FEATURES).collect()}[name]
                # a root of the inverse covariance is compared by the distances that it gives
                a, b = np.array(fold["white"]), np.array(table["white"])
                assert np.allclose(a.T @ a, b.T @ b, rtol=1e-8, atol=1e-8) and np.allclose(np.abs(fold["white_offset"]), np.abs(table["white_offset"]), atol=1e-7)
    assert "f4" not in got[30, "P5", "reduced"]["Features"]


def test_scores_in_folds_equal_those_of_one_space(spark, windows):
    frame, df = windows
    folds = R.fit_folds(df, FEATURES, FEATURES)
    rng = np.random.default_rng(3)
    t = np.arange(-60, 61, 5.0)
    rows = [(f"B{i}", length, t.tolist(), (rng.normal(size=(len(t), 5)) + np.outer(t >= 10 * (i % 3), rng.normal(size=5)) * 2).tolist()) for i in range(3) for length in (30, 60)]
    series = spark.createDataFrame(rows, "BoundaryID string, WindowLength_sec int, t array<double>, x array<array<double>>")
    got = R.score_folds(series, ["BoundaryID", "WindowLength_sec"], folds, (0.5, 4.0), folds_at_once=4).toPandas()
    assert set(got["HeldOut"]) == {f"P{i}" for i in range(6)}
    one = folds.filter("HeldOut = 'P3'").toPandas()
    spaces = folds.filter("HeldOut = 'P3'").withColumns({"plain": F.col("white"), "plain_offset": F.col("white_offset")})
    native = D.score_spaces(series, ["BoundaryID", "WindowLength_sec"], spaces).filter("Method in ('CovIC', 'CUSUM', 'MOSUM')").toPandas()
    keys = ["BoundaryID", "WindowLength_sec", "Representation", "SearchWindow", "Method"]
    both = native.merge(got[got["HeldOut"] == "P3"], on=keys, suffixes=("", "_fold"))
    assert len(both) == len(native) == 3 * 2 * 2 * 2 * 3
    assert np.allclose(both["Score"], both["Score_fold"], atol=1e-7) and (both["SplitIndex"] == both["SplitIndex_fold"]).all()
    for (name, length), part in one.groupby(["Representation", "WindowLength_sec"]):
        w, rho = np.vstack(part["white"].iloc[0]), float(part["rho"].iloc[0])
        rep = M.Representation(name, tuple(f"y{i}" for i in range(len(w))), np.eye(len(w)), rho)
        for boundary, n, at, x in rows:
            if n != length:
                continue
            y = np.array(x) @ w.T - np.array(part["white_offset"].iloc[0])
            mine = got[(got["HeldOut"] == "P3") & (got["BoundaryID"] == boundary) & (got["WindowLength_sec"] == n) & (got["Representation"] == name)]
            trend = mine[(mine["Method"] == "SegmentedTrend") & (mine["SearchWindow"] == "post_only")].iloc[0]
            score, k = M.segmented_trend(t, y, rep, 5, (0.0, 60.0))
            assert trend["Score"] == pytest.approx(score, abs=1e-6) and trend["SplitIndex"] == k
            if name == "reduced":
                costs = M.segment_costs(y, "l2")
                for m in (0.5, 4.0):
                    hit, late = M.pelt(t, y, costs, "l2", m, rho, 5, (-30.0, 60.0))
                    row = mine[(mine["Method"] == "PELT_L2") & (mine["SearchWindow"] == "anticipatory") & (mine["Multiplier"] == m)].iloc[0]
                    assert row["Detected"] == hit and (not hit or row["CandidateLatency_sec"] == late)


def test_thresholds_leave_the_participant_out(spark):
    rows = [(30, "post_only", "CovIC", "A_to_NA", "reduced", held, who, f"{who}_{b}", "A", float(b), 1, f"{who}_{b}_{held}", None, float(10 * int(who[1]) + b), None, 5.0) for held in ("P0", "P1", "P2") for who in ("P0", "P1", "P2") for b in range(5)]
    shape = "WindowLength_sec int, SearchWindow string, Method string, TransitionType string, Representation string, HeldOut string, Subject string, CandidateBlockID string, PseudoCondition string, MatchScore double, MatchRank int, PseudoMatchID string, Multiplier double, Score double, Detected boolean, CandidateLatency_sec double"
    expanded = spark.createDataFrame(rows, shape)
    got = {r["HeldOut"]: r for r in R.training_thresholds(expanded, 0.2).collect()}
    # ten blocks of the two others: rank ceil(0.8 * 9) = 8 of 0 ... 9
    assert {k: r["Threshold"] for k, r in got.items()} == {"P0": 23.0, "P1": 23.0, "P2": 13.0} and all(r["TrainingParticipants"] == 2 and r["TrainingPseudoBlocks"] == 10 and r["TrainingFPR"] == pytest.approx(0.2) for r in got.values())
    grid = spark.createDataFrame([r[:5] + (r[5], r[6], r[7], r[8], r[9], r[10], r[11], m, None, bool(r[13] >= 20 + m), 5.0) for r in rows for m in (1.0, 4.0, 9.0)], shape)
    chosen = {r["HeldOut"]: r for r in R.training_penalties(grid, 0.2).collect()}
    # without P0 or P1 four of ten blocks pass at 1 and one at 4; without P2 none does at either, and the smallest is as near as the others
    assert {k: r["Multiplier"] for k, r in chosen.items()} == {"P0": 4.0, "P1": 4.0, "P2": 1.0}
    real = expanded.filter("Subject = 'P2' and MatchRank = 1").withColumn("BoundaryID", F.col("CandidateBlockID"))
    found = R.held_out_detections(real, expanded, R.training_thresholds(expanded, 0.2), R.training_penalties(grid, 0.2)).filter("BoundaryKind = 'Real'")
    assert {r["DetectionRate"] for r in R.held_out_summary(found).collect()} == {1.0}
    found = found.collect()
    assert len(found) == 5 and all(r["HeldOut"] == "P2" and r["Threshold"] == 13.0 and r["Detected"] for r in found)
