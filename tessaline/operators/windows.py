"""Sliding windows over recordings and their features; one shuffle on (subject, session, block of time)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.config import ALL23, ALL32, FREQUENCY, NONLINEAR
from tessaline.functions import arrays as A
from tessaline.functions import ragged as R
from tessaline.operators.signal import interval_features, sample_entropies
from tessaline.sources.shared import tasks_of

SHORTEST_RR, LONGEST_RR = 300.0, 2000.0
KEYS = ["Subject", "Session", "WindowLength_sec", "WindowIndex"]


def window_count(samples: Column, rate: float, length: float, step: float) -> Column:
    """Complete windows in a recording: 1 + (N - L) // S, or none."""
    size, hop = round(length * rate), round(step * rate)
    return F.when(samples < size, 0).otherwise(1 + F.floor((samples - size) / hop)).cast("long")


def window_grid(sessions: DataFrame, lengths: tuple[int, ...], step: int, duration: float | None) -> DataFrame:
    """All complete windows of every session, for each length. Without one ``duration`` for all, a session has its own in ``SessionDuration_sec``."""
    sizes = F.explode(F.array(*[F.lit(n) for n in lengths]))
    whole = F.lit(duration) if duration is not None else F.col("SessionDuration_sec")
    last = F.floor((whole - F.col("WindowLength_sec")) / step + 1e-9).cast("int")
    return (
        sessions.withColumn("WindowLength_sec", sizes)
        .filter(last >= 0)
        .withColumn("WindowIndex", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("StepSize_sec", F.lit(step))
        .withColumn("StartTime_sec", (F.col("WindowIndex") * step).cast("double"))
        .withColumn("EndTime_sec", F.col("StartTime_sec") + F.col("WindowLength_sec"))
        .withColumn("CenterTime_sec", (F.col("StartTime_sec") + F.col("EndTime_sec")) / 2)
        .withColumn("SessionDuration_sec", whole)
    )


def assign_windows(samples: DataFrame, lengths: tuple[int, ...], step: int, duration: float) -> DataFrame:
    """Each sample with every window that holds it (start <= t < end), by arithmetic instead of a range join."""
    size = F.col("WindowLength_sec")
    low = F.greatest(F.lit(0), (F.floor((F.col("t") - size) / step) + 1).cast("int"))
    high = F.least(F.floor(F.col("t") / step), F.floor((F.lit(duration) - size) / step)).cast("int")
    return (
        samples.withColumn("WindowLength_sec", F.explode(F.array(*[F.lit(n) for n in lengths])))
        .filter(low <= high)
        .withColumn("WindowIndex", F.explode(F.sequence(low, high)))
    )


def clean_rr(rr: Column) -> dict[str, Column]:
    """Invalid intervals, then Hampel outliers among the rest, are taken out and filled in linearly."""
    valid = F.transform(rr, lambda v: F.when((v >= SHORTEST_RR) & (v <= LONGEST_RR), v))
    outliers = A.hampel_outliers(valid)
    holed = F.zip_with(valid, outliers, lambda v, o: F.when(~o, v))
    n = F.size(rr)
    invalid = F.size(F.filter(valid, lambda v: v.isNull()))
    odd = F.size(F.filter(outliers, lambda o: o))
    return {
        "RR_Invalid": invalid,
        "RR_HampelOutliers": odd,
        "RR_Corrected": invalid + odd,
        "RR_CorrectedPercent": F.when(n > 0, 100.0 * (invalid + odd) / n),
        "clean": A.interpolate(holed),
    }


COUNTS = ["n", "Num_RR_Clean", "RR_Invalid", "RR_HampelOutliers", "RR_Corrected"]
FEATURE_SCHEMA = ", ".join(
    ["Subject string", "Session int", "WindowLength_sec int", "WindowIndex int", *(f"{c} int" for c in COUNTS), "RR_CorrectedPercent double", *(f"{c} double" for c in ALL32)]
)


def _described(keys: list[tuple], n: np.ndarray, x: np.ndarray, rr: np.ndarray, m: np.ndarray | None = None) -> pa.RecordBatch:
    """Features of windows given as flat value arrays with the length of each window; ``m`` intervals each, where these are fewer than the samples."""
    m = n if m is None else m
    cleaned, invalid, odd = R.clean(rr, m)
    known = ~np.isnan(cleaned)
    nn, k = cleaned[known], R.sums(known.astype(float), m).astype(np.int64)
    times = R.time_features(nn, k)
    found = R.amplitude_features(x, n) | R.rate_features(nn, k) | times | R.poincare_features(times["SDNN"], times["SDSD"], k)
    ends = np.cumsum(k)
    more = np.array([interval_features(nn[e - m : e], float(key[2])) for key, e, m in zip(keys, ends, k, strict=True)]).reshape(len(n), -1)
    more = np.column_stack([more[:, : len(FREQUENCY)], sample_entropies(nn, k), more[:, len(FREQUENCY) :]])
    found |= dict(zip(FREQUENCY + NONLINEAR, more.T, strict=True))
    counts = [n, k, invalid, odd, invalid + odd]
    percent = R.ratio(100.0 * (invalid + odd), m.astype(float))
    values = [pa.array(v, pa.float64(), from_pandas=True) for v in (percent, *(found[c] for c in ALL32))]
    of = [pa.array(v, t) for v, t in zip(zip(*keys, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
    return pa.RecordBatch.from_arrays(of + [pa.array(v.astype(np.int32)) for v in counts] + values, names=[*KEYS, *COUNTS, "RR_CorrectedPercent", *ALL32])


def between_peaks(places: np.ndarray, n: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Intervals in ms between neighbouring peaks of each window, and how many each has. places: of samples that are peaks, else NaN, in windows of ``n`` samples."""
    peak = ~np.isnan(places)
    owner, at = np.repeat(np.arange(len(n)), n)[peak], places[peak]
    same = owner[1:] == owner[:-1]
    return np.diff(at)[same] / rate * 1000.0, np.bincount(owner[1:][same], minlength=len(n))


def _windows_of_blocks(lengths: tuple[int, ...], step: int, duration: float, block: int, rate: float | None = None, at_once: int = 500_000):
    """Batches of blocks of samples in order of time -> features of the windows that begin in each block. With ``rate``, ``rr`` holds the places of samples that are peaks."""

    def described(keys: list[tuple], n: np.ndarray, x: np.ndarray, rr: np.ndarray) -> pa.RecordBatch:
        return _described(keys, n, x, rr) if rate is None else _described(keys, n, x, *between_peaks(rr, n, rate))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, xs, rrs, size = [], [], [], [], 0
        for b in batches:
            for subject, session, place, s in zip(*(b.column(c) for c in ("Subject", "Session", "block", "s")), strict=True):
                t, x, rr = (s.values.field(c).to_numpy(zero_copy_only=False) for c in ("t", "x", "rr"))
                first = place.as_py() * block // step
                for length in lengths:
                    index = np.arange(first, min(first + block // step - 1, (duration - length) // step) + 1).astype(np.int64)
                    low, high = np.searchsorted(t, index * step, "left"), np.searchsorted(t, index * step + length, "left")
                    n = high - low
                    index, low, n = index[n > 0], low[n > 0], n[n > 0]
                    at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
                    keys += [(subject.as_py(), session.as_py(), length, int(i)) for i in index]
                    ns.append(n)
                    xs.append(x[at])
                    rrs.append(rr[at])
                    size += len(at)
                if size >= at_once:
                    yield described(keys, np.concatenate(ns), np.concatenate(xs), np.concatenate(rrs))
                    keys, ns, xs, rrs, size = [], [], [], [], 0
        if keys:
            yield described(keys, np.concatenate(ns), np.concatenate(xs), np.concatenate(rrs))

    return cut


def window_features(
    samples: DataFrame, lengths: tuple[int, ...] = (30, 45, 60), step: int = 5, duration: float | None = 360.0, least_samples: int = 4, most_corrected: float = 20.0, block_seconds: float = 600.0, peaks_rate: float | None = None
) -> DataFrame:
    """The master table: one row per window with quality columns and 32 features.

    Frequency features need windows of 60 s and 30 intervals, entropy 20 and scaling 160 intervals; flags say which were computed.
    A window without samples keeps its row with null features. WindowFailureReason lists what is
    wrong, joined by ';'; WindowValid means nothing is. Samples are shuffled once, in blocks of ``block_seconds`` of a session (and little
    more, for windows that reach into the next block), not once per window that holds them; a block is what a task holds at least.
    With ``peaks_rate``, samples per second, ``rr`` isn't an interval per sample but the place of each sample that is a peak (else null), and a window's intervals are those between its own
    peaks. Without ``duration``, samples have ``SessionDuration_sec``.
    Windows are cut from the blocks, cleaned and described in numpy over whole batches, as nested higher-order functions took ten times as long.
    """
    block = -int(-max(block_seconds, *lengths) // step) * step  # no window reaches further than the next block
    own = F.floor(F.col("t") / block).cast("int")
    # windows that begin in a block reach into the next one, so its first seconds go to both
    reached = F.when((F.col("t") - own * block < max(lengths)) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    held = samples.filter((F.col("t") >= 0) & (F.col("t") < (F.lit(duration) if duration is not None else F.col("SessionDuration_sec")))).withColumn("block", F.explode(reached))
    held = held.select("Subject", "Session", "block", "t", "x", "rr").repartition(tasks_of(samples.sparkSession), "Subject", "Session", "block").groupBy("Subject", "Session", "block").agg(F.array_sort(F.collect_list(F.struct("t", "x", "rr"))).alias("s"))
    made = held.mapInArrow(_windows_of_blocks(lengths, step, float("inf") if duration is None else duration, block, peaks_rate), FEATURE_SCHEMA)
    reasons = F.concat_ws(
        ";",
        F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "no_samples"),
        F.when((F.col("n") > 0) & (F.col("n") < least_samples), "few_samples"),
        F.when((F.col("n") > 0) & (F.col("ECG_VAR") <= 0), "flat_signal"),
        F.when((F.col("n") > 0) & (F.col("Num_RR_Clean") < 3), "few_rr_intervals"),
        F.when(F.col("RR_CorrectedPercent") > most_corrected, "rr_corrected_percent"),
    )
    sessions = samples.select("Subject", "Session", "ConditionCode", *(["SessionDuration_sec"] if duration is None else [])).distinct()
    master = (
        window_grid(sessions, lengths, step, duration)
        .join(made, KEYS, "left")
        .withColumn("Num_Samples", F.coalesce("n", F.lit(0)))
        .withColumn("WindowFailureReason", reasons)
        .withColumn("WindowValid", F.col("WindowFailureReason") == "")
        .withColumn("WindowID", F.format_string("%s_S%02d_L%d_W%06d", "Subject", "Session", "WindowLength_sec", "WindowIndex"))
        .withColumn("Condition", F.when(F.col("ConditionCode") == "A", "Anxiety").otherwise("Non_Anxiety"))
        .withColumn("Overlap_sec", F.greatest(F.lit(0), F.col("WindowLength_sec") - F.col("StepSize_sec")))
        .withColumn("OverlapPercent", 100.0 * F.col("Overlap_sec") / F.col("WindowLength_sec"))
        .withColumn("FrequencyFeaturesComputed", F.col("TotalPower").isNotNull())
        .withColumn("EntropyFeatureComputed", F.col("SampEn").isNotNull())
        .withColumn("DFAFeatureComputed", F.col("DFA_alpha1").isNotNull())
        .drop("n")
    )
    front = ["WindowID", "Subject", "Session", "ConditionCode", "Condition", "WindowLength_sec", "StepSize_sec", "Overlap_sec", "OverlapPercent", "WindowIndex", "StartTime_sec", "EndTime_sec", "CenterTime_sec", "SessionDuration_sec", "Num_Samples", "Num_RR_Clean", "RR_Invalid", "RR_HampelOutliers", "RR_Corrected", "RR_CorrectedPercent", "WindowValid", "WindowFailureReason"]
    return master.select(*front, *ALL32, "FrequencyFeaturesComputed", "EntropyFeatureComputed", "DFAFeatureComputed")
