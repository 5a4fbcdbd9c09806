"""Peaks, spectra, entropy and scaling of recordings: numpy on one recording or window at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.config import FREQUENCY

# Frequency bands in Hz, lower end included.
BANDS = {"VLF": (0.0033, 0.04), "LF": (0.04, 0.15), "HF": (0.15, 0.40)}


REFRACTORY, HALO = 0.25, 1.0  # fixed values, in seconds: the least distance of two peaks; what the detector sees around a sample, 0.05 + 0.75 and the slope's neighbours


def high_runs(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs in which the squared slope, averaged over 100 ms, is high for its surroundings of 1.5 s."""
    if len(x) < 3:
        return np.zeros(0, int), np.zeros(0, int)
    smooth = lambda v, s: np.convolve(v, np.ones(max(1, int(s * rate))) / max(1, int(s * rate)), "same")[: len(v)]
    energy = smooth(np.gradient(x) ** 2, 0.1)
    edges = np.flatnonzero(np.diff(np.r_[0, (energy > 1.5 * smooth(energy, 1.5)).astype(int), 0]))
    return edges[::2], edges[1::2]


def r_peaks(x: np.ndarray, rate: float, refractory: float = REFRACTORY) -> np.ndarray:
    """Places of R peaks of a whole signal: the maximum of each high run, the larger one of two that are too near.

    A plain energy detector; it doesn't reproduce any library's peaks exactly. Where peaks are known they can be given instead.
    """
    peaks: list[int] = []
    for a, b in zip(*high_runs(x, rate), strict=True):
        p = a + int(np.argmax(x[a:b]))
        if not peaks or p - peaks[-1] >= refractory * rate:
            peaks.append(p)
        elif x[p] > x[peaks[-1]]:
            peaks[-1] = p
    return np.array(sorted(set(peaks)), int)


def welch(x: np.ndarray, rate: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power density by averaged periodograms: periodic Hann, half overlap, each segment without its mean."""
    n = min(size, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, len(x) - n + 1, n - n // 2)
    power = np.mean([np.abs(np.fft.rfft((x[s : s + n] - x[s : s + n].mean()) * window)) ** 2 for s in starts], 0) / (rate * (window**2).sum())
    power[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power


def band_power(f: np.ndarray, p: np.ndarray, low: float, high: float) -> float:
    """Trapezoid over low <= f < high; NaN with fewer than two bins."""
    use = (f >= low) & (f < high)
    return float(np.trapezoid(p[use], f[use])) if use.sum() >= 2 else np.nan


def frequency_features(rr: np.ndarray, duration: float, rate: float = 4.0, least_seconds: float = 60.0, least_intervals: int = 30) -> dict[str, float]:
    """Band powers of cleaned intervals in ms, resampled evenly from each interval's start to half a step past the last one; NaN where too short."""
    out = dict.fromkeys(FREQUENCY, np.nan)
    at = np.r_[0.0, np.cumsum(rr)[:-1]] / 1000
    if duration < least_seconds or len(rr) < least_intervals or at[-1] <= 0:
        return out
    grid = np.arange(0.0, at[-1] + 0.5 / rate, 1 / rate)
    if len(grid) < 8:
        return out
    even = np.interp(grid, at, rr)
    f, p = welch(even - even.mean(), rate)
    out |= {k: band_power(f, p, *b) for k, b in BANDS.items()}
    lf, hf = out["LF"], out["HF"]
    out["TotalPower"] = band_power(f, p, BANDS["VLF"][0], BANDS["HF"][1])
    if np.isfinite(lf) and np.isfinite(hf):
        out["LFHF"] = lf / hf if hf > 0 else np.nan
        out["LFnu"], out["HFnu"] = (100 * lf / (lf + hf), 100 * hf / (lf + hf)) if lf + hf > 0 else (np.nan, np.nan)
    return out


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, least: int = 20, at_once: int = 512) -> float:
    """-log of the share of pairs of m close values that stay close for one more; NaN under ``least`` values or without such pairs.

    Pairs are counted in blocks of rows, so memory grows with the length and not with its square.
    """
    if len(x) < least or x.std() == 0:
        return np.nan
    tolerance, n = r * x.std(), len(x) - m
    counts = np.zeros(2, np.int64)
    for a in range(0, n, at_once):
        rows = np.arange(a, min(a + at_once, n))
        later = np.arange(n)[None, :] > rows[:, None]
        near = later & (np.abs(x[rows][:, None] - x[:n][None, :]) <= tolerance)
        for k in range(1, m + 1):
            if k == m:
                counts[0] += near.sum()
            near &= np.abs(x[rows + k][:, None] - x[k : n + k][None, :]) <= tolerance
        counts[1] += near.sum()
    return float(-np.log(counts[1] / counts[0])) if counts.all() else np.nan


def sample_entropies(nn: np.ndarray, lengths: np.ndarray, m: int = 2, r: float = 0.2, least: int = 20, longest: int = 400, at_once: int = 4_000_000) -> np.ndarray:
    """``sample_entropy`` of many short series at once: flat values with the length of each series. Series of equal length are compared together."""
    out, begins = np.full(len(lengths), np.nan), np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths >= least]):
        rows = np.flatnonzero(lengths == size)
        if size > longest:
            out[rows] = [sample_entropy(nn[begins[i] : begins[i] + size], m, r, least) for i in rows]
            continue
        n, step = size - m, max(1, at_once // size**2)
        first, second = np.triu_indices(n, 1)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            x = nn[begins[some][:, None] + np.arange(size)]
            spread = x.std(1)
            near = np.ones((len(some), len(first)), bool)
            counts = []
            for k in range(m + 1):
                near &= np.abs(x[:, first + k] - x[:, second + k]) <= (r * spread)[:, None]
                counts.append(near.sum(1))
            known = (spread > 0) & (counts[m - 1] > 0) & (counts[m] > 0)
            out[some[known]] = -np.log(counts[m][known] / counts[m - 1][known])
    return out


def dfa_alpha1(x: np.ndarray, scales: range = range(4, 17), least: int = 160) -> float:
    """Slope of the log fluctuation over the log scale of the summed series, linearly detrended in half-overlapping boxes."""
    if len(x) < least:
        return np.nan
    y, points = np.cumsum(x - x.mean()), []
    for s in scales:
        boxes = np.lib.stride_tricks.sliding_window_view(y, s)[:: max(1, s // 2)]
        line = np.column_stack([np.ones(s), np.arange(s)])
        rest = boxes.T - line @ np.linalg.lstsq(line, boxes.T, rcond=None)[0]
        points.append((np.log(s), 0.5 * np.log((rest**2).mean())))
    return float(np.polyfit(*np.array(points).T, 1)[0])


def interval_features(nn: np.ndarray, duration: float) -> list[float]:
    """Frequency and scaling features of one window's cleaned intervals, in the order of FREQUENCY."""
    found = frequency_features(nn, duration) if len(nn) else dict.fromkeys(FREQUENCY, np.nan)
    return [*found.values(), dfa_alpha1(nn)]


def detect_peaks(samples: DataFrame, rate: float, block_seconds: float = 60.0, refractory: float = REFRACTORY) -> DataFrame:
    """``Subject, Session, peak_idx`` of recordings (``Subject, Session, i, x``), as ``r_peaks`` finds them in the whole signal, wherever it is cut.

    A recording is dealt in blocks; each has a second more on either side, which is as far as the detector sees. A block gives its part of every high run;
    parts that meet at a block's edge are one run. Peaks nearer than ``refractory`` seconds form chains, and a chain is settled by itself: after a
    longer gap nothing before matters. So a task holds a block, and of a session only runs meet, a few for each second.
    """
    size, halo = max(1, round(block_seconds * rate)), int(HALO * rate) + 2
    own = F.floor(F.col("i") / size).cast("long")
    near = F.array_compact(F.array(own, F.when((F.col("i") - own * size < halo) & (own > 0), own - 1), F.when((own + 1) * size - F.col("i") <= halo, own + 1)))
    of = ["Subject", "Session"]
    blocks = samples.select(*of, "i", "x").withColumn("block", F.explode(near))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        i, x, begin, end = frame["i"].to_numpy(), frame["x"].to_numpy(float), key[2] * size, (key[2] + 1) * size
        out = []
        for a, b in zip(*high_runs(x, rate), strict=True):
            a, b = max(a, int(np.searchsorted(i, begin))), min(b, int(np.searchsorted(i, end)))
            if a < b:
                p = a + int(np.argmax(x[a:b]))
                out.append((*key[:2], int(i[a]), int(i[b - 1]) + 1, int(i[p]), float(x[p])))
        return pd.DataFrame(out, columns=[*of, "begin", "stop", "p", "x"])

    parts = blocks.groupBy(*of, "block").applyInPandas(run, "Subject string, Session int, begin long, stop long, p long, x double")
    order = W.partitionBy(*of).orderBy("begin")
    whole = parts.withColumn("run", F.count_if(~F.coalesce(F.col("begin") == F.lag("stop").over(order), F.lit(False))).over(order))
    # the earliest of equal maxima
    tops = whole.groupBy(*of, "run").agg(F.max(F.struct("x", (-F.col("p")).alias("back"))).alias("m")).select(*of, (-F.col("m.back")).alias("p"), F.col("m.x").alias("x"))
    by_place = W.partitionBy(*of).orderBy("p")
    chains = tops.withColumn("chain", F.count_if(F.coalesce(F.col("p") - F.lag("p").over(by_place) >= refractory * rate, F.lit(True))).over(by_place))
    listed = chains.groupBy(*of, "chain").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c"))
    start = F.array().cast("array<struct<p:bigint,x:double>>")

    def add(kept, one):
        far = (F.size(kept) == 0) | (one["p"] - F.try_element_at(kept, F.lit(-1))["p"] >= refractory * rate)
        swap = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(one))
        return F.when(far, F.concat(kept, F.array(one))).when(one["x"] > F.try_element_at(kept, F.lit(-1))["x"], swap).otherwise(kept)

    return listed.select(*of, F.explode(F.aggregate("c", start, add)).alias("k")).select(*of, F.col("k.p").alias("peak_idx"))


def windowed_peaks(peaks: DataFrame, rate: float, lengths: tuple[int, ...], step: int, duration: float) -> DataFrame:
    """Each peak with every window that holds it (start <= peak < end): ``peak_in_window`` counts samples from the window's start.

    Windows are found by arithmetic, so no range join is needed.
    """
    from tessaline.operators.windows import assign_windows

    timed = peaks.withColumn("t", F.col("peak_idx") / float(rate))
    return assign_windows(timed, lengths, step, duration).withColumn("peak_in_window", F.col("peak_idx") - F.round(F.col("WindowIndex") * step * float(rate)).cast("long")).drop("t")


def window_intervals(windowed: DataFrame, rate: float) -> DataFrame:
    """Intervals in ms between neighbouring peaks of a window, at the time of the later one: ``..., t, rr``."""
    from pyspark.sql import Window as W

    order = W.partitionBy("Subject", "Session", "WindowLength_sec", "WindowIndex").orderBy("peak_idx")
    step = (F.col("peak_idx") - F.lag("peak_idx").over(order)) / float(rate) * 1000.0
    return windowed.withColumn("rr", step).withColumn("t", F.col("peak_idx") / float(rate)).filter("rr is not null")
