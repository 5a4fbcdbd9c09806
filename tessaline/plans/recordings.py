"""From session recordings to the master table: files, signals, peaks, windows, features, and a status row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.operators.signal import detect_peaks
from tessaline.operators.windows import window_features
from tessaline.sources.sessions import read_session_csvs
from tessaline.sources.shared import settle


def master_of_signals(samples: DataFrame, rate: float, lengths: tuple[int, ...] = (30, 45, 60), step: int = 5, block_seconds: float = 120.0, peaks: DataFrame | None = None) -> DataFrame:
    """Windows and features of recordings ``Subject, Session, ConditionCode, i, x`` of ``rate`` samples a second.

    Peaks are found once in each whole recording (or given as ``Subject, Session, peak_idx``), and a window's intervals are those between the peaks inside it. A recording's own
    length decides how many windows it has. Recordings are cut into blocks throughout, so their length doesn't matter.
    """
    found = (peaks if peaks is not None else detect_peaks(samples, rate, block_seconds)).select("Subject", "Session", F.col("peak_idx").alias("i"), F.col("peak_idx").cast("double").alias("rr"))
    long = samples.groupBy("Subject", "Session").agg((F.count("*") / rate).alias("SessionDuration_sec"))
    # a row per session
    timed = samples.join(found, ["Subject", "Session", "i"], "left").join(F.broadcast(long), ["Subject", "Session"])
    timed = timed.select("Subject", "Session", "ConditionCode", "SessionDuration_sec", (F.col("i") / rate).alias("t"), "x", "rr")
    return window_features(timed, lengths, step, None, block_seconds=block_seconds, peaks_rate=rate)


def master_of_folder(spark: SparkSession, folder: str, rate: float = 500.0, lengths: tuple[int, ...] = (30, 45, 60), step: int = 5) -> tuple[DataFrame, DataFrame]:
    """(master, files) of a folder of session CSVs. files: a row for each, with its status and how many samples, seconds, peaks, windows and valid windows it gave."""
    samples, files = read_session_csvs(spark, folder, rate=rate)
    samples = settle(samples, "recordings")
    peaks = settle(detect_peaks(samples, rate), "peaks")
    master = settle(master_of_signals(samples, rate, lengths, step, peaks=peaks), "recording-master")
    of = ["Subject", "Session"]
    counts = samples.groupBy(*of).agg(F.count("*").alias("NumSamples"), (F.count("*") / rate).alias("Duration_sec"))
    counts = counts.join(peaks.groupBy(*of).agg(F.count("*").alias("NumRPeaks")), of, "left")
    counts = counts.join(master.groupBy(*of).agg(F.count("*").alias("TotalWindows"), F.count_if("WindowValid").alias("ValidWindows")), of, "left")
    filled = files.join(counts, of, "left").na.fill(0, ["NumRPeaks", "TotalWindows", "ValidWindows"])
    return master, filled
