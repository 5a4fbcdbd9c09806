"""Recordings to master: peaks don't hang on where a recording is cut, and files give windows and features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessaline.operators import signal
from tessaline.plans import recordings

RATE = 100.0


def pulse_train(seconds, rng, rate=RATE):
    """Pulses some 0.8 s apart, with noise, a flat stretch, and pairs of pulses too near to be two beats."""
    n, x = int(seconds * rate), np.zeros(int(seconds * rate))
    at = np.cumsum(rng.normal(0.8, 0.05, int(seconds))) + 0.3
    at = at[(at < seconds - 0.2) & ~((at > seconds * 0.4) & (at < seconds * 0.45))]
    i = np.arange(n) / rate
    for k, t in enumerate(at):
        x += np.exp(-(((i - t) / 0.015) ** 2)) * (1 + 0.2 * rng.random())
        if k % 9 == 4:
            x += 0.8 * np.exp(-(((i - t - 0.15) / 0.015) ** 2))
    return x + 0.01 * rng.normal(size=n), at


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(6)
    made = {(f"A10{k}", k + 1): pulse_train(seconds, rng)[0] for k, seconds in enumerate((95, 61.37, 2.5, 0.02))}
    rows = [(who, s, "A" if s % 2 else "NA", i, float(v)) for (who, s), x in made.items() for i, v in enumerate(x)]
    return made, spark.createDataFrame(rows, "Subject string, Session int, ConditionCode string, i long, x double").repartition(6)


@pytest.mark.parametrize("block", [3.0, 10.0, 1000.0])
def test_peaks_are_the_same_wherever_a_recording_is_cut(signals, block):
    made, df = signals
    got = signal.detect_peaks(df, RATE, block).toPandas()
    for (who, s), x in made.items():
        assert sorted(got[(got["Subject"] == who) & (got["Session"] == s)]["peak_idx"]) == signal.r_peaks(x, RATE).tolist()
    assert len(got) > 150


def test_features_come_from_peaks(signals):
    made, df = signals
    one, other = (recordings.master_of_signals(df, RATE, (30, 60), 5, block_seconds=b).toPandas().sort_values("WindowID").reset_index(drop=True) for b in (60.0, 200.0))
    pd.testing.assert_frame_equal(one, other, check_exact=False, rtol=1e-9)
    # complete windows of 95 and 61.37 s; the short recordings have none
    assert one.groupby(["Subject", "WindowLength_sec"]).size().to_dict() == {("A100", 30): 14, ("A100", 60): 8, ("A101", 30): 7, ("A101", 60): 1}
    peaks, x = signal.r_peaks(made["A100", 1], RATE), made["A100", 1]
    for _, r in one[one["Subject"] == "A100"].iterrows():
        low, high = int(r["StartTime_sec"] * RATE), int(r["EndTime_sec"] * RATE)
        own = peaks[(peaks >= low) & (peaks < high)]
        rr = np.diff(own) / RATE * 1000
        assert r["Num_Samples"] == high - low and r["ECG_Mean"] == pytest.approx(x[low:high].mean()) and r["RR_Invalid"] == ((rr < 300) | (rr > 2000)).sum()
        assert r["RR_CorrectedPercent"] == pytest.approx(100 * r["RR_Corrected"] / len(rr))
        if r["RR_Corrected"] == 0:
            assert r["MeanRR"] == pytest.approx(rr.mean()) and r["SDNN"] == pytest.approx(rr.std(ddof=1))


def test_folder_of_csvs(spark, tmp_path):
    rng = np.random.default_rng(9)
    for name, seconds, text in (("A101_session1_A", 70, "{:.5f}"), ("A101_session2_NA", 40, "{:.5f}"), ("A102_session1_A", 40, ""), ("notes", 3, "{:.5f}")):
        x = pulse_train(seconds, rng)[0]
        (tmp_path / f"{name}.csv").write_text("Time_seconds,ECG_filtered\n" + "\n".join(f"{i / RATE}," + (text.format(v) if text else "") for i, v in enumerate(x)) + "\n")
    master, files = recordings.master_of_folder(spark, str(tmp_path), RATE, (30, 60))
    by = {r["stem"]: r for r in files.collect()}
    assert {k: r["status"] for k, r in by.items()} == {"A101_session1_A": "processed", "A101_session2_NA": "processed", "A102_session1_A": "failed", "notes": "skipped_bad_filename"}
    assert (by["A101_session1_A"]["NumSamples"], by["A101_session1_A"]["Duration_sec"], by["A101_session1_A"]["TotalWindows"]) == (7000, 70.0, 9 + 3)
    assert by["A101_session2_NA"]["TotalWindows"] == 3 and by["A101_session1_A"]["NumRPeaks"] > 60 and by["notes"]["TotalWindows"] == 0
    assert by["A101_session1_A"]["ValidWindows"] == master.filter("Session = 1 and WindowValid").count() > 0 and len(master.columns) == 57
    assert set(master.select("ConditionCode").distinct().toPandas()["ConditionCode"]) == {"A", "NA"} and master.filter(F.col("MeanRR").between(700, 900)).count() > 10
