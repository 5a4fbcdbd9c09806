"""Change-point scores as window expressions over long series ``series keys, idx, t, Feature, z``.

``project`` brings series of all features into the coordinates of linear spaces, plain or whitened: a product of each vector with
a matrix that a table holds by window length and space. All detectors then run over all spaces at once.

Shared contract: one row per series and search window with Score, SplitIndex and CandidateLatency_sec; a series
without a legal split has none of the three, and of equal scores the earliest split counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.config import SEARCH_WINDOWS
from tessaline.functions.scalars import bic, effective_size
from tessaline.sources.shared import spread

TINY, SMALLEST = 1e-12, 2.2250738585072014e-308


def index_series(long: DataFrame, series: list[str], time: str = "RelativeCenter_sec") -> DataFrame:
    """Adds ``idx`` (0, 1, ... in order of time) and ``n`` to every feature of a series, and renames the time to ``t``."""
    order, whole = W.partitionBy(*series, "Feature").orderBy("t"), W.partitionBy(*series, "Feature")
    return long.withColumnRenamed(time, "t").withColumn("idx", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))


def pre_standardised(indexed: DataFrame, series: list[str]) -> DataFrame:
    """Replaces z by its distance from the median before time 0 in 1.4826 MAD, else SD, else 1; needs 2 points before."""
    before = indexed.filter("t < 0").groupBy(*series, "Feature").agg(F.collect_list("z").alias("v"), F.median("z").alias("m"), F.stddev_samp("z").alias("sd"))
    off = F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("m"))))
    n = F.size("v")
    mad = 1.4826 * (F.get(off, ((n - 1) / 2).cast("int")) + F.get(off, (n / 2).cast("int"))) / 2
    scale = F.when(mad > TINY, mad).when(F.col("sd") > TINY, F.col("sd")).otherwise(1.0)
    fitted = before.filter(F.size("v") >= 2).select(*series, "Feature", "m", scale.alias("s"))
    return indexed.join(fitted, [*series, "Feature"], "left").withColumn("z", F.when(F.col("m").isNull(), F.col("z")).otherwise((F.col("z") - F.col("m")) / F.col("s"))).drop("m", "s")


def candidate_splits(indexed: DataFrame, series: list[str], least: int) -> DataFrame:
    """``series, Feature, idx, t, SearchWindow`` of all places where a legal right part may begin."""
    legal = indexed.filter((F.col("idx") >= least) & (F.col("idx") <= F.col("n") - least) & (F.col("idx") < F.col("n")))
    searches = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in SEARCH_WINDOWS.items()])
    return (
        legal.withColumn("s", F.explode(searches))
        .filter((F.col("t") >= F.col("s.a")) & (F.col("t") <= F.col("s.b")))
        .withColumn("SearchWindow", F.col("s.name"))
        .drop("s")
    )


def best_split(scored: DataFrame, series: list[str], method: str) -> DataFrame:
    """Of ``series, SearchWindow, idx, t, score`` the largest score, earliest first; scores are compared to 9 digits."""
    top = scored.groupBy(*series, "SearchWindow").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("idx")).alias("back"), "t")).alias("b"))
    return top.select(
        *series, "SearchWindow", F.lit(method).alias("Method"), F.col("b.score").alias("Score"), (-F.col("b.back")).cast("int").alias("SplitIndex"), F.col("b.t").alias("CandidateLatency_sec")
    )


def split_costs(indexed: DataFrame, series: list[str], least: int) -> DataFrame:
    """Squared errors without and with a change at each legal split, summed over features, from running sums."""
    order = W.partitionBy(*series, "Feature").orderBy("idx")
    whole, left = W.partitionBy(*series, "Feature"), order.rowsBetween(W.unboundedPreceding, -1)
    sums = (
        indexed.withColumn("all_z", F.sum("z").over(whole))
        .withColumn("all_zz", F.sum(F.col("z") * F.col("z")).over(whole))
        .withColumn("left_z", F.sum("z").over(left))
    )
    k, n = F.col("idx"), F.col("n")
    a, b = F.col("left_z"), F.col("all_z") - F.col("left_z")
    gain = a * a / k + b * b / (n - k) - F.col("all_z") * F.col("all_z") / n
    return (
        candidate_splits(sums, series, least)
        .groupBy(*series, "SearchWindow", "idx", "t", "n")
        .agg(F.sum(F.col("all_zz") - F.col("all_z") * F.col("all_z") / F.col("n")).alias("sse0"), F.sum(gain).alias("gain"), F.count("*").alias("d"))
    )


def binseg_l2(costs: DataFrame, series: list[str]) -> DataFrame:
    return best_split(costs.withColumn("score", F.col("gain")), series, "BinSeg_L2")


def legacy_bic(costs: DataFrame, series: list[str]) -> DataFrame:
    d, size = F.col("d"), F.col("n") * F.col("d")
    score = bic(F.col("sse0"), size, d) - bic(F.col("sse0") - F.col("gain"), size, 2 * d + 1)
    return best_split(costs.withColumn("score", score), series, "LegacyBIC_fixed6")


def cusum(indexed: DataFrame, series: list[str], least: int) -> DataFrame:
    """Norm of the bridge of running sums, centred on the mean before time 0."""
    whole, order = W.partitionBy(*series, "Feature"), W.partitionBy(*series, "Feature").orderBy("idx")
    centre = F.coalesce(F.avg(F.when(F.col("t") < 0, F.col("z"))).over(whole), F.avg("z").over(whole))
    centred = indexed.withColumn("c", F.col("z") - centre)
    sums = centred.withColumn("left_c", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("all_c", F.sum("c").over(whole))
    k, n = F.col("idx"), F.col("n")
    v = (F.col("left_c") - k / n * F.col("all_c")) / F.sqrt(k * (n - k) / n)
    norm = candidate_splits(sums.withColumn("v", v), series, least).groupBy(*series, "SearchWindow", "idx", "t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("score"))
    return best_split(norm, series, "CUSUM")


def mosum(indexed: DataFrame, series: list[str], least: int) -> DataFrame:
    """sqrt(h / 2) times the norm of the difference of the means of the h points after and before."""
    order = W.partitionBy(*series, "Feature").orderBy("idx")
    v = F.avg("z").over(order.rowsBetween(0, least - 1)) - F.avg("z").over(order.rowsBetween(-least, -1))
    norm = candidate_splits(indexed.withColumn("v", v), series, least).groupBy(*series, "SearchWindow", "idx", "t").agg(
        (F.sqrt(F.lit(least / 2.0)) * F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("score")
    )
    return best_split(norm, series, "MOSUM")


def project(series: DataFrame, keys: list[str], spaces: DataFrame, matrix: str) -> DataFrame:
    """``keys, t, x`` (one row per series, times in order) -> ``keys, Representation, rho, idx, n, t, Feature, z`` in each space's coordinates.

    spaces: ``WindowLength_sec, Representation, rho`` and, as ``matrix`` and ``matrix_offset``, rows to multiply each vector with and what is then taken off.
    A few rows per window length, broadcast. Feature is the coordinate's number.
    """
    product = lambda row, v: F.aggregate(F.zip_with(row, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    moved = lambda v: F.transform(F.col(matrix), lambda row, i: product(row, v) - F.get(F.col(f"{matrix}_offset"), i))
    both = series.join(F.broadcast(spaces.select("WindowLength_sec", "Representation", "rho", matrix, f"{matrix}_offset")), "WindowLength_sec")
    own = [*keys, "Representation", "rho"]
    points = both.select(*own, F.size("t").cast("long").alias("n"), F.posexplode(F.zip_with("t", F.transform("x", moved), lambda t, y: F.struct(t.alias("t"), y.alias("y")))).alias("idx", "p"))
    return points.select(*own, "idx", "n", F.col("p.t").alias("t"), F.posexplode("p.y").alias("Feature", "z"))


def cov_ic(costs: DataFrame, series: list[str]) -> DataFrame:
    """Gain of one mean change on whitened rows, less (d + 1) log n_eff; ``series`` holds ``rho``."""
    size = effective_size(F.col("n"), F.col("rho"))
    return best_split(costs.withColumn("score", F.col("gain") - (F.col("d") + 1) * F.log(size)), series, "CovIC")


def alike(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Series of one batch (``WindowLength_sec, t, x``) by length, number of times and number of times before 0: places, window length, times and vectors of each group."""
    t, x = (batch.column(batch.schema.get_field_index(c)) for c in "tx")
    n, lengths = t.value_lengths().to_numpy(), batch.column(batch.schema.get_field_index("WindowLength_sec")).to_numpy()
    times, vectors = t.flatten().to_numpy(), x.flatten().flatten().to_numpy().reshape(-1, features)
    begins = np.cumsum(n) - n
    before = np.bincount(np.repeat(np.arange(len(n)), n), times < 0, len(n)).astype(int)
    kinds = np.column_stack([lengths, n, before])
    for kind in np.unique(kinds, axis=0):
        rows = np.flatnonzero((kinds == kind).all(1))
        at = begins[rows][:, None] + np.arange(kind[1])
        yield rows, int(kind[0]), times[at], vectors[at]


def group_scores(t: np.ndarray, y: np.ndarray, w: np.ndarray, rho: float, least: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Places where a right part may begin, and by method the scores of all series there. t: series x times, as many before 0 in each; y, w: plain and whitened vectors."""
    n, d, before = t.shape[1], y.shape[2], int((t[0] < 0).sum())
    k = np.arange(least, min(n - least, n - 1) + 1)
    if not len(k):
        return k, {}
    square = lambda v: (v * v).sum(-1)

    def running(v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros_like(v[:, :1]), v.cumsum(1)], 1)

    def gains(s: np.ndarray) -> np.ndarray:
        left, whole = s[:, k], s[:, -1:]
        return (left * left / k[:, None] + (whole - left) ** 2 / (n - k)[:, None] - whole * whole / n).sum(-1)

    z = y
    if before >= 2:
        m = np.median(y[:, :before], 1, keepdims=True)
        mad, sd = 1.4826 * np.median(np.abs(y[:, :before] - m), 1, keepdims=True), y[:, :before].std(1, ddof=1, keepdims=True)
        z = (y - m) / np.where(mad > TINY, mad, np.where(sd > TINY, sd, 1.0))
    s = running(z)
    gain, sse0 = gains(s), ((z * z).sum(1) - s[:, -1] ** 2 / n).sum(-1)[:, None]
    size = float(n * d)
    cost = lambda sse, p: size * np.log(np.maximum(sse, SMALLEST) / size) + p * np.log(size)
    sw = running(w)
    centre = (w[:, :before] if before else w).mean(1, keepdims=True)
    c = running(w - centre)
    bridge = (c[:, k] - (k / n)[:, None] * c[:, -1:]) / np.sqrt(k * (n - k) / n)[:, None]
    moved = (sw[:, k + least] - sw[:, k]) / least - (sw[:, k] - sw[:, k - least]) / least
    r = min(max(rho, 0.0), 0.98)
    penalty = (d + 1) * np.log(max(2.0, min(n, n * (1 - r) / (1 + r))))
    return k, {
        "LegacyBIC_fixed6": cost(sse0, d) - cost(sse0 - gain, 2 * d + 1),
        "BinSeg_L2": gain,
        "CovIC": gains(sw) - penalty,
        "CUSUM": np.sqrt(square(bridge)),
        "MOSUM": np.sqrt(least / 2.0) * np.sqrt(square(moved)),
    }


def best_of(t: np.ndarray, k: np.ndarray, scores: np.ndarray, search: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Series with a legal split in the search window, their best scores to 9 digits, splits (the earliest of equal ones) and the times of these."""
    legal = (t[:, k] >= search[0]) & (t[:, k] <= search[1])
    rounded = np.where(legal, np.round(scores, 9), -np.inf)
    at = rounded.argmax(1)
    some = np.flatnonzero(legal.any(1))
    return some, rounded[some, at[some]], k[at[some]], t[some, k[at[some]]]


SCORED = ["Representation", "SearchWindow", "Method", "Score", "SplitIndex", "CandidateLatency_sec"]


def scored_batch(batch: pa.RecordBatch, keys: list[str], found: list[tuple]) -> pa.RecordBatch:
    """found: (places in the batch, space, search window, method, scores, splits, times) -> ``keys, SCORED``."""
    places = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
    own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(places)) for c in keys]
    text = lambda i: pa.array(np.repeat(np.array([f[i] for f in found], object), [len(f[0]) for f in found]), pa.string()) if found else pa.array([], pa.string())
    number = lambda i, kind: pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0), kind)
    return pa.RecordBatch.from_arrays([*own, text(1), text(2), text(3), number(4, pa.float64()), number(5, pa.int64()).cast(pa.int32()), number(6, pa.float64())], names=[*keys, *SCORED])


def score_shape(series: DataFrame, keys: list[str]) -> str:
    kinds = dict(series.dtypes)
    return ", ".join([f"{c} {kinds[c]}" for c in keys] + ["Representation string, SearchWindow string, Method string, Score double, SplitIndex int, CandidateLatency_sec double"])


def score_spaces(series: DataFrame, keys: list[str], spaces: DataFrame, least: int = 5, at_once: int = 2000) -> DataFrame:
    """``keys, Representation, SearchWindow, Method, Score, SplitIndex, CandidateLatency_sec`` of every series in every space.

    BinSeg and the legacy score take plain coordinates, standardised by the time before the boundary; CovIC, CUSUM and MOSUM whitened ones. The values equal those of the
    window expressions above; as a series is one row, it is scored where it lies, many series at once in numpy, and no coordinate is shuffled. spaces: a few rows per window length.
    """
    sent: dict[int, list] = {}
    for r in spaces.collect():  # window lengths x spaces
        matrices = [np.array(r[c], float) for c in ("plain", "plain_offset", "white", "white_offset")]
        sent.setdefault(r["WindowLength_sec"], []).append((r["Representation"], float(r["rho"]), matrices))
    width = next((m[0].shape[1] for found in sent.values() for _, _, m in found), 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), at_once):
                b, found = whole.slice(begin, at_once), []
                for rows, length, t, x in alike(b, width):
                    for name, rho, (plain, off, white, white_off) in sent.get(length, []):
                        k, scores = group_scores(t, x @ plain.T - off, x @ white.T - white_off, rho, least)
                        for method, v in scores.items():
                            for search, span in SEARCH_WINDOWS.items():
                                some, *best = best_of(t, k, v, span)
                                if len(some):
                                    found.append((rows[some], name, search, method, *best))
                yield scored_batch(b, keys, found)

    return spread(series, 2000).mapInArrow(score, score_shape(series, keys))


def boundary_magnitude(series: DataFrame, keys: list[str], spaces: DataFrame) -> DataFrame:
    """Of (mean after - mean before) in every space: the Mahalanobis distance, the mean absolute size and the first coordinate."""
    own = [*keys, "Representation"]

    def change(matrix: str) -> DataFrame:
        mean = lambda side: F.avg(F.when(side, F.col("z")))
        return project(series, keys, spaces, matrix).groupBy(*own, "Feature").agg((mean(F.col("t") >= 0) - mean(F.col("t") < 0)).alias("d"))

    far = change("white").groupBy(*own).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("MahalanobisMagnitude"))
    plain = change("plain").groupBy(*own).agg(F.avg(F.abs("d")).alias("MeanAbsChange"), F.min_by("d", "Feature").alias("FirstChange"))
    return far.join(plain, own)


def pelt_base_penalty(d: Column, n_eff: Column, model: str) -> Column:
    return F.log(n_eff) if model == "rbf" else (d + 1) * F.log(n_eff)
