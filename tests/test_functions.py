import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.config import Settings
from tessaline.functions import arrays as A
from tessaline.functions import ragged as R
from tessaline.functions import scalars as S
from tessaline.operators import matrix, normalize, signal, timing

RR = [800.0, 810.0, 790.0, 2500.0, 805.0, 795.0, 1200.0, 800.0]


def test_cleaning_of_intervals():
    clean, invalid, odd = R.clean(np.array(RR), np.array([8]))
    assert clean.tolist() == [800, 810, 790, 797.5, 805, 795, 797.5, 800]
    assert (invalid[0], odd[0]) == (1, 1)


def test_ragged_series_keep_apart():
    clean, _, _ = R.clean(np.array([5000.0, 800, 900, 5000.0, 5000.0]), np.array([2, 0, 2, 1]))
    assert clean[:4].tolist() == [800, 800, 900, 900] and np.isnan(clean[4])


def test_time_domain_features():
    f = R.time_features(np.array([800.0, 810, 790, 805, 795]), np.array([5]))
    assert [round(float(f[k][0]), 6) for k in ("SDNN", "RMSSD", "SDSD", "MedianNN", "MADNN", "pNN20", "pNN50")] == [7.905694, 14.361407, 16.520190, 800, 5, 0, 0]
    p = R.poincare_features(np.array([26.832816]), np.array([6.454972]), np.array([5]))
    assert p["SD1"][0] == pytest.approx(4.564355, abs=1e-5)


def test_native_hampel_equals_numpy(spark):
    df = spark.createDataFrame([(RR,)], "a array<double>")
    valid = F.transform("a", lambda v: F.when((v >= 300) & (v <= 2000), v))
    got = df.select(A.hampel_outliers(valid).alias("o")).first()["o"]
    assert got == [False] * 6 + [True, False]


@pytest.mark.parametrize("values,centre,scale,method", [([1, 2, 3, 4, 100], 3, 1.4826, "MAD"), ([1, 1, 1, 1, 5], 1, 1.788854, "SD"), ([7, 7, 7], 7, 1.0, "constant_fallback")])
def test_robust_scale_ladder(spark, values, centre, scale, method):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, value double")
    r = normalize.robust_scale(df, ["k"]).first()
    assert (r["centre"], round(r["scale"], 6), r["method"]) == (centre, scale, method)


def test_quantile_higher_thinning_hash(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert df.agg(A.quantile_higher(F.col("v"), 0.95).alias("q")).first()["q"] == 20
    times = spark.createDataFrame([([10.0, 50.0, 125.0, 140.0, 260.0, 300.0, 390.0],)], "t array<double>")
    assert times.select(A.thin(F.col("t"), 120.0).alias("k")).first()["k"] == [10, 140, 260, 390]
    h = spark.range(1).select(S.hash64(F.lit("A101|NA")).alias("h"), S.hash_mod(F.lit("A101|NA"), 4).alias("m")).first()
    assert (int(h["h"]), h["m"]) == (1485663586330508850, 2)


def test_settings_are_validated():
    with pytest.raises(ValueError, match="lengths"):
        Settings(lengths=(31,))
    with pytest.raises(ValueError, match="no such"):
        Settings.read({"colour": "red"})
    assert Settings.read({"lengths": "60, 30,30", "edge": "30", "corrected": ""}) == Settings(lengths=(30, 60), edge=30.0)


def test_resampling_takes_all_subjects(spark):
    """200 subjects in one group, 3 in another: every replicate draws as many as there are, and flips all."""
    from tessaline.operators import inference as I

    rows = [("a", f"P{i:03d}", float(i)) for i in range(200)] + [("b", f"P{i}", float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, Subject string, v double").withColumn("one", F.lit(1.0))
    boot = I.bootstrap_sums(df, ["g"], ["one", "v"], 100, "t").groupBy("g").agg(F.min("one").alias("low"), F.max("one").alias("high"), F.avg("v").alias("mean"), F.stddev(F.col("v") / F.col("one")).alias("sd")).collect()
    got = {r["g"]: r for r in boot}
    assert (got["a"]["low"], got["a"]["high"], got["b"]["low"], got["b"]["high"]) == (200, 200, 3, 3)
    # the standard error of a mean of 200 values of 0 to 199 is 57.7 / sqrt(200)
    assert abs(got["a"]["mean"] / 200 - 99.5) < 3 and 2.7 < got["a"]["sd"] < 5.5
    signs = I.sign_flip(df.withColumn("v", F.col("v") - 99.5), ["g"], "v", 200).filter("g = 'a'").first()
    assert signs["Participants"] == 200 and abs(signs["MeanDifference"]) < 1e-9 and signs["PermutationP"] > 0.9
    mean = I.bootstrap_mean(df, ["g"], "v", 100, "t").filter("g = 'a'").first()
    some = I.bootstrap_statistic(df, ["g"], F.avg("v"), 100, "t").filter("g = 'a'").first()
    assert abs(mean["CI_Lower"] - some["CI_Lower"]) < 1e-9 and abs(mean["CI_Upper"] - some["CI_Upper"]) < 1e-9


def test_whitened_cost_and_partition():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(25, 3))
    x[12:] += 4
    t = np.arange(-60.0, 61, 5)
    rep = matrix.Representation("r", ("a", "b", "c"), np.cov(x, rowvar=False))
    score, k = matrix.cov_ic(t, x, rep, 5, (0.0, 60.0))
    inv = rep.inverse
    cost = lambda v: np.einsum("ij,jk,ik->", v - v.mean(0), inv, v - v.mean(0))
    assert k == 12 and score == pytest.approx(cost(x) - cost(x[:12]) - cost(x[12:]) - 4 * np.log(25))
    assert matrix.partition(matrix.segment_costs(x, "l2"), 20.0, 5) == [12, 25]


def test_shared_change_is_recovered():
    import pandas as pd

    rng = np.random.default_rng(1)
    t, rows = np.arange(-60.0, 61, 5), []
    for s in range(19):
        base, slope = rng.normal(0, 0.4, 3), rng.normal(0, 0.05, 3)
        for u in t:
            v = base + slope * u / 60 + (u >= 20) * np.array([0.8, -0.5, 0.6]) + max(u - 20, 0) / 60 * np.array([0.4, 0.2, -0.3]) + rng.normal(0, 0.15, 3)
            rows.append((f"P{s:02d}", u, *v))
    f = timing.fit(pd.DataFrame(rows, columns=["Subject", "RelativeCenter_sec", "V1", "V2", "V3"]), ["V1", "V2", "V3"], (0.0, 60.0))
    assert abs(f["CandidateTime_sec"] - 20) <= 5 and f["Participants"] == 19


def test_spectrum_finds_its_frequency():
    t = np.arange(0, 120, 0.25)
    f, p = signal.welch(np.sin(2 * np.pi * 0.25 * t), 4.0)
    assert abs(f[p.argmax()] - 0.25) < 0.02
    assert len(signal.r_peaks(np.exp(-(((np.arange(1000) % 100 - 50) / 4.0) ** 2)), 100.0)) == 10
