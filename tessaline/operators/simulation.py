"""Simulated series with known changes: thresholds under no change and power under changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.operators.matrix import Representation, cov_ic, legal_splits, segmented_trend
from tessaline.operators.timing import inject

SHAPES, SIZES, SHARES, STARTS = ("abrupt", "ramp"), (0.0, 0.5, 1.0, 1.5, 2.0), (0.25, 0.5, 1.0), (10.0, 20.0, 30.0)


def psd_root(covariance: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(covariance)
    return vectors @ np.diag(np.sqrt(np.maximum(values, 1e-8))) @ vectors.T


def ar1(n: int, root: np.ndarray, rho: float, rng: np.random.Generator) -> np.ndarray:
    """n correlated rows, each rho times the one before plus noise, with the covariance root @ root."""
    noise = rng.standard_normal((n, len(root))) @ root
    out = np.empty_like(noise)
    out[0] = noise[0]
    for i in range(1, n):
        out[i] = rho * out[i - 1] + np.sqrt(1 - rho**2) * noise[i]
    return out


def score_all(t: np.ndarray, x: np.ndarray, rep: Representation, least: int, search: tuple[float, float]) -> dict[str, float]:
    """The six scores of one series; NaN without a legal split."""
    w = x @ rep.whitening
    splits, n, d = legal_splits(t, least, search), len(x), x.shape[1]
    sse = lambda v: float(((v - v.mean(0)) ** 2).sum())
    pre = t < 0
    m = np.median(x[pre], 0)
    s = 1.4826 * np.median(np.abs(x[pre] - m), 0)
    z = (x - m) / np.where(s > 1e-12, s, 1.0)
    gains = [sse(z) - sse(z[:k]) - sse(z[k:]) for k in splits]
    bic = lambda e, k: n * d * np.log(max(e, 1e-300) / (n * d)) + k * np.log(n * d)
    c = w - w[pre].mean(0)
    run, h = np.cumsum(c, 0), least
    top = lambda v: max(v, default=np.nan)
    return {
        "LegacyBIC_fixed6": top([bic(sse(z), d) - bic(sse(z) - g, 2 * d + 1) for g in gains]),
        "CovIC": cov_ic(t, x, rep, least, search)[0],
        "BinSeg_L2": top(gains),
        "SegmentedTrend": segmented_trend(t, x, rep, least, search)[0],
        "CUSUM": top([float(np.linalg.norm((run[k - 1] - k / n * run[-1]) / np.sqrt(k * (n - k) / n))) for k in splits]),
        "MOSUM": top([float(np.sqrt(h / 2) * np.linalg.norm(w[k : k + h].mean(0) - w[k - h : k].mean(0))) for k in splits if k - h >= 0 and k + h <= n]),
    }


def simulate(spark: SparkSession, rep: Representation, replicates: int, cells: list[tuple[str, float, float, float]] | None = None, least: int = 5, seed: int = 42) -> DataFrame:
    """Scores of simulated series: ``rep, shape, size, share, start, Method, Score``. Every replicate seeds its own generator, so order and place don't matter."""
    cells = cells if cells is not None else [("none", 0.0, 0.0, 0.0)]
    t, search = np.arange(-60.0, 61.0, 5.0), (0.0, 60.0)

    def run(batches):
        root = psd_root(rep.covariance)
        for b in batches:
            out = []
            for i in b["id"]:
                for c, (shape, size, share, start) in enumerate(cells):
                    rng = np.random.default_rng([seed, int(i), c])
                    x = ar1(len(t), root, rep.rho, rng)
                    k = max(1, round(share * x.shape[1])) if share else 0
                    scale = np.sqrt(np.diag(rep.covariance))
                    for j in range(k):
                        x[:, j] = inject(x[:, j], t, start, size * scale[j], shape)
                    out += [(int(i), shape, size, share, start, m, None if np.isnan(s) else s) for m, s in score_all(t, x, rep, least, search).items()]
            yield pd.DataFrame(out, columns=["rep", "shape", "size", "share", "start", "Method", "Score"])

    return spark.range(replicates).repartition(min(replicates, 64)).mapInPandas(run, "rep long, shape string, size double, share double, start double, Method string, Score double")


def null_thresholds(null: DataFrame, fpr: float = 0.05) -> DataFrame:
    from tessaline.functions.arrays import quantile_higher

    return null.groupBy("Method").agg(quantile_higher(F.col("Score"), 1 - fpr).alias("Threshold"), F.avg((F.col("Score") >= 6).cast("double")).alias("FixedSixFPR"))


def power(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Share of simulated series at or over the threshold, by cell and method."""
    hit = (F.col("Score") >= F.col("Threshold")).cast("double")
    return scores.join(F.broadcast(thresholds), "Method").groupBy("Method", "shape", "size", "share", "start").agg(F.count("*").alias("Series"), F.avg(hit).alias("Power"))
