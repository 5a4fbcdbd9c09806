"""Fits from distributed sums, regressions, calibration and timing against plain numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessaline.operators import calibration as C
from tessaline.operators import gee, matrix, signal, timing


@pytest.fixture
def rng():
    return np.random.default_rng(4)


@pytest.fixture
def wide(spark, rng):
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4))
    x[:, 3] = np.round(x[:, 3])  # ties
    frame = pd.DataFrame(x, columns=list("abcd")).assign(WindowID=[f"w{i}" for i in range(120)], WindowLength_sec=[30, 45] * 60)
    return frame, spark.createDataFrame(frame)


def test_covariance_from_sums(wide):
    frame, df = wide
    for r in matrix.moments(df, list("abcd"), "WindowLength_sec").collect():
        x = frame[frame["WindowLength_sec"] == r["WindowLength_sec"]][list("abcd")].to_numpy()
        c = x - x.mean(0)
        plain, fourth = c.T @ c / len(c), ((c**2).sum(1) ** 2).mean()
        assert np.allclose(matrix.covariance_of(r, 4), plain) and r["fourth"] == pytest.approx(fourth) and r["n"] == 60
        got, mu = matrix.shrunk(plain, fourth, 60), np.trace(plain) / 4
        # shrinkage keeps the trace and brings all eigenvalues nearer to their mean
        assert np.trace(got) == pytest.approx(4 * mu) and np.ptp(np.linalg.eigvalsh(got)) <= np.ptp(np.linalg.eigvalsh(plain))


def test_rank_correlations_and_pruning(wide):
    frame, df = wide
    got = {(r["WindowLength_sec"], r["A"], r["B"]): r["Rho"] for r in matrix.rank_correlations(df, list("abcd"), "WindowLength_sec").collect()}
    for length, part in frame.groupby("WindowLength_sec"):
        want = part[list("abcd")].corr("spearman")
        assert all(got[length, a, b] == pytest.approx(want.loc[a, b]) for a, b in ("ab", "ac", "ad", "bc", "bd", "cd"))
    kept, audit = matrix.prune_by_rank_correlation({("a", "b"): -0.95, ("a", "c"): 0.2, ("b", "c"): 0.99}, ["a", "b", "c"])
    assert kept == ["a", "c"] and audit[1] == {"Feature": "b", "Kept": False, "Representative": "a", "AbsRho": 0.95}


def test_spaces_are_fitted_by_length(wide):
    frame, df = wide
    spaces, audit = matrix.fit_representations(df, ["a", "b", "c"], {"all": list("abcd")}, {(30, "a"): 0.4, (30, "b"): 0.4, (30, "c"): 0.4, (30, "d"): 0.4})
    assert sorted(spaces) == [30, 45] and [r.name for r in spaces[30]] == ["all", "reduced", "independent_pca"] and spaces[30][0].rho == pytest.approx(0.4)
    last = spaces[45][-1]
    x = frame[frame["WindowLength_sec"] == 45][list(last.columns)].to_numpy()
    scores = last.transform(x)
    off = np.corrcoef(scores, rowvar=False) - np.eye(scores.shape[1])
    assert np.abs(off).max() < 1e-6 and len(audit) == 6


def boundaries(rng, many=30):
    rows = []
    for s in range(many):
        own = rng.normal(0, 0.5)
        for k in range(6):
            up = k % 2
            rows.append((30, f"P{s:02d}", "A_to_NA" if up else "NA_to_A", k + 1, bool(rng.random() < 0.3 + 0.4 * up), 2.0 + own + 0.8 * up + rng.normal(0, 0.3), float(rng.normal(20 + 5 * up, 3)), "Real"))
    return pd.DataFrame(rows, columns=["WindowLength_sec", "Subject", "TransitionType", "BoundaryOrder", "Detected", "MahalanobisMagnitude", "Latency_sec", "BoundaryKind"])


def test_gee_of_boundaries(spark, rng):
    frame = boundaries(rng)
    got = {(r["Outcome"], r["Term"]): r for r in gee.boundary_gee(spark.createDataFrame(frame), ["WindowLength_sec"]).collect()}
    assert abs(got["MahalanobisMagnitude", "A_to_NA"]["Estimate"] - 0.8) < 0.2 and got["MahalanobisMagnitude", "A_to_NA"]["Q"] < 0.01
    # order less its mean: the intercept is the other direction's mean
    down = frame[frame["TransitionType"] == "NA_to_A"]["MahalanobisMagnitude"].mean()
    assert got["MahalanobisMagnitude", "Intercept"]["Estimate"] == pytest.approx(down, abs=0.15)
    assert {o for o, _ in got} == {"Detected", "MahalanobisMagnitude", "Latency_sec"} and got["Detected", "A_to_NA"]["Estimate"] > 0.5
    never = frame.assign(Detected=frame["TransitionType"] == "A_to_NA")
    only = {(r["Outcome"], r["Term"]): r for r in gee.boundary_gee(spark.createDataFrame(never), ["WindowLength_sec"]).collect()}
    assert only["Detected", "not_estimable"]["Reason"] and ("Detected", "A_to_NA") not in only


def test_multipliers_are_crossfitted(spark):
    rows = [(30, "post_only", "l2", "A_to_NA", f"B{b}", "A", b % 4, float(b), 1, f"m{b}", m, b < limit) for b in range(40) for m, limit in ((1.0, 20), (2.0, 2), (4.0, 0))]
    names = "WindowLength_sec int, SearchWindow string, Model string, TransitionType string, CandidateBlockID string, PseudoCondition string, PseudoFold int, MatchScore double, MatchRank int, PseudoMatchID string, Multiplier double, Detected boolean"
    pseudo = spark.createDataFrame(rows, names)
    chosen = {r["CalibrationFold"]: r for r in C.crossfit_multipliers(pseudo).collect()}
    # blocks 0 and 1 are detected at 2: folds 2 and 3 see both of them among 30 others, 6.7 %; folds 0 and 1 see one, 3.3 %
    assert {k: r["Multiplier"] for k, r in chosen.items()} == {0: 2.0, 1: 2.0, 2: 4.0, 3: 4.0} and chosen[0]["HeldoutFPR"] == pytest.approx(0.1) and chosen[2]["HeldoutFPR"] == 0
    real = spark.createDataFrame([(30, "post_only", "l2", "A_to_NA", "R1", "P1", m, True, 5.0) for m in (1.0, 2.0, 4.0)], "WindowLength_sec int, SearchWindow string, Model string, TransitionType string, BoundaryID string, Subject string, Multiplier double, Detected boolean, Latency_sec double")
    full = pseudo.withColumns({"Subject": F.lit("P1"), "Latency_sec": F.lit(1.0)})
    out = C.apply_multipliers(real, full, C.crossfit_multipliers(pseudo), (1.0, 2.0, 4.0)).collect()
    assert [r["Multiplier"] for r in out if r["BoundaryKind"] == "Real"] == [2.0] and len([r for r in out if r["BoundaryKind"] == "Pseudo"]) == 40


def test_entropy_equals_plain_count(rng):
    x = rng.normal(800, 40, 700)
    r, n, counts = 0.2 * x.std(), len(x) - 2, [0, 0]
    for i in range(n):
        for j in range(i + 1, n):
            if max(abs(x[i] - x[j]), abs(x[i + 1] - x[j + 1])) <= r:
                counts[0] += 1
                counts[1] += abs(x[i + 2] - x[j + 2]) <= r
    assert signal.sample_entropy(x) == pytest.approx(-np.log(counts[1] / counts[0]))
    assert np.isnan(signal.sample_entropy(x[:19])) and np.isnan(signal.sample_entropy(np.full(50, 800.0)))


def test_spectrum_of_windows():
    t = np.cumsum(np.full(90, 800.0)) / 1000
    nn = 800 + 30 * np.sin(2 * np.pi * 0.1 * t)
    found = signal.frequency_features(nn, 60.0)
    assert found["LF"] > 10 * found["HF"] and found["LFnu"] + found["HFnu"] == pytest.approx(100)
    assert all(np.isnan(v) for v in signal.frequency_features(nn, 45.0).values()) and all(np.isnan(v) for v in signal.frequency_features(nn[:29], 60.0).values())


def test_peaks_of_samples_in_windows(spark):
    """From samples to intervals: a pulse a second, found in the signal itself, gives intervals of 1,000 ms in every window that holds two."""
    i = np.arange(4000)
    pulses = np.exp(-((((i % 100) - 50) / 4.0) ** 2))
    samples = spark.createDataFrame(pd.DataFrame({"Subject": "P1", "Session": 1, "i": i, "x": pulses}))
    windowed = signal.windowed_peaks(signal.detect_peaks(samples.withColumn("Session", F.col("Session").cast("int")), 100.0), 100.0, (30,), 5, 40.0)
    got = signal.window_intervals(windowed, 100.0).groupBy("WindowIndex").agg(F.count("*").alias("n"), F.min("rr").alias("low"), F.max("rr").alias("high")).collect()
    assert {r["WindowIndex"] for r in got} == {0, 1, 2} and all(r["n"] == 29 and r["low"] == r["high"] == 1000 for r in got)


def test_timing_differences_and_bands(spark):
    fits = spark.createDataFrame([(60, d, "post_only", r, float(t)) for r in range(20) for d, t in (("A_to_NA", 20 + r % 2), ("NA_to_A", 10))], "WindowLength_sec int, TransitionType string, SearchWindow string, rep int, CandidateTime_sec double")
    one = timing.paired_differences(fits, ["WindowLength_sec"]).first()
    assert (one["MedianDifference"], one["CI_Lower"], one["CI_Upper"], one["ShareLater"], one["Replicates"]) == (10.5, 10, 11, 1.0, 20)
    band = timing.null_bands(spark.createDataFrame([("g", 5.0, float(s)) for s in range(1, 21)], "g string, CandidateTime_sec double, Score double"), ["g"]).first()
    assert (band["NullMedian"], band["NullQ95"], band["Draws"]) == (10.5, 20, 20)


def test_windows_of_a_stream(spark, tmp_path):
    """The same windows from a stream of files as from the batch; events later than the watermark are left out."""
    from tessaline.streaming.windows import stream_windows

    shape = "user_id long, ts timestamp, value double"
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    parts = [[(1, at(m), float(m)) for m in range(0, 30, 3)], [(1, at(m), float(m)) for m in range(30, 60, 3)], [(2, at(600), 1.0)], [(1, at(1), 5.0), (3, at(2000), 1.0)], [(3, at(4000), 1.0)]]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = stream_windows(stream).writeStream.format("memory").queryName("windows_of_a_stream").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r["user_id"], r["start"]): r["n"] for r in spark.table("windows_of_a_stream").collect()}
    batch = {(r["user_id"], r["start"]): r["n"] for r in stream_windows(spark.createDataFrame([x for p in parts[:3] for x in p], shape)).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {k: v for k, v in batch.items() if k[0] == 1} and (2, at(600)) in got


def test_windows_cut_from_blocks_of_any_length(spark, rng):
    """Blocks as short as the longest window and of 600 s give the same features, also where samples lie on the borders of windows."""
    from tessaline.operators.windows import assign_windows, window_features

    t = np.sort(np.r_[rng.uniform(0, 360, 300), np.arange(0, 360, 5.0)])
    frame = pd.DataFrame({"Subject": "P1", "Session": 1, "ConditionCode": "A", "t": t, "x": rng.normal(size=len(t)), "rr": rng.normal(800, 50, len(t))})
    samples = spark.createDataFrame(frame).withColumn("Session", F.col("Session").cast("int"))
    long, short = ({r["WindowID"]: r for r in window_features(samples, block_seconds=b).collect()} for b in (600.0, 1.0))
    close = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-9, abs=1e-9)
    assert long.keys() == short.keys() and all(close(x, y) for k in long for x, y in zip(long[k], short[k], strict=True)) and len(long) == sum((360 - n) // 5 + 1 for n in (30, 45, 60))
    counts = {(r["WindowLength_sec"], r["WindowIndex"]): r["count"] for r in assign_windows(samples, (30, 45, 60), 5, 360.0).groupBy("WindowLength_sec", "WindowIndex").count().collect()}
    assert {(r["WindowLength_sec"], r["WindowIndex"]): r["Num_Samples"] for r in long.values()} == counts
