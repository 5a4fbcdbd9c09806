"""Detectors and representations that solve small matrix problems: numpy within grouped or batched functions."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.config import PELT_MODELS, SEARCH_WINDOWS
from tessaline.functions.scalars import correlation
from tessaline.operators.detectors import alike, best_of, score_shape, scored_batch
from tessaline.sources.shared import spread

FLOOR = 1e-6  # fixed value: the least eigenvalue of a whitened space


@dataclass(frozen=True)
class Representation:
    """A linear feature space: columns, centre, covariance and the matrices made from it."""

    name: str
    columns: tuple[str, ...]
    covariance: np.ndarray
    rho: float = 0.0
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    components: np.ndarray | None = None

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.pinv(self.covariance)

    @property
    def whitening(self) -> np.ndarray:
        values, vectors = np.linalg.eigh(self.covariance)
        return vectors @ np.diag(1 / np.sqrt(np.maximum(values, FLOOR))) @ vectors.T

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Rows of features -> rows of the space."""
        if self.components is None:
            return x
        return ((x - self.centre) / self.scale) @ self.components.T


def shrunk(covariance: np.ndarray, fourth: float, n: int) -> np.ndarray:
    """Covariance pulled towards a multiple of the identity, as far as its own error asks for. ``fourth``: mean of the squared squared lengths of centred rows."""
    p = len(covariance)
    mu, square = np.trace(covariance) / p, float((covariance**2).sum())
    spread = (square - p * mu**2) / p
    error = min(spread, (fourth - square) / (p * n))
    share = max(0.0, error) / spread if spread > 0 else 0.0
    return (1 - share) * covariance + share * mu * np.eye(p)


def moments(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """One row per value of ``by``: ``n``, means ``m0, ...``, population covariances ``c0_0, c0_1, ...`` and ``fourth``. Sums only, combined before the shuffle."""
    centre = rows.groupBy(by).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)])
    length = sum(((F.col(c) - F.col(f"m{i}")) * (F.col(c) - F.col(f"m{i}")) for i, c in enumerate(columns)), F.lit(0.0))
    pairs = [F.covar_pop(a, b).alias(f"c{i}_{i + j}") for i, a in enumerate(columns) for j, b in enumerate(columns[i:])]
    means = [F.first(f"m{i}").alias(f"m{i}") for i in range(len(columns))]
    return rows.join(F.broadcast(centre), by).withColumn("length", length).groupBy(by).agg(F.count("*").alias("n"), *means, *pairs, F.avg(F.col("length") * F.col("length")).alias("fourth"))


def spread_of(rows: DataFrame, columns: list[str], by: str, images: dict[int, dict[str, np.ndarray]] | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray, dict[str, float]]]:
    """By value of ``by``: rows, means, population covariance, and for each linear image (a matrix over ``columns``) the mean of the squared squared length of centred rows; of all columns themselves without ``images``.

    Two passes of sums; a task gives one row per value of ``by``, which Spark adds up.
    """
    centre = {r[by]: np.array(r[1:], float) for r in rows.groupBy(by).agg(*[F.avg(c) for c in columns]).collect()}
    p = len(columns)
    of = {key: (images or {}).get(key, {"": np.eye(p)}) for key in centre}
    shape = f"{by} int, s array<double>"

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(by):
                x = part[columns].to_numpy(float) - centre[key]
                fourth = [((x @ m.T) ** 2).sum(1) @ ((x @ m.T) ** 2).sum(1) for m in of[key].values()]
                total[key] = total.get(key, 0.0) + np.concatenate([[len(x)], (x.T @ x).ravel(), fourth])
        yield pd.DataFrame({by: list(total), "s": list(total.values())})

    def together(part):
        return part.iloc[:1].assign(s=[np.vstack(part["s"].to_numpy()).sum(0)])

    out = {}
    for r in rows.select(by, *columns).mapInPandas(add, shape).groupBy(by).applyInPandas(together, shape).collect():
        s, key = np.array(r["s"]), r[by]
        out[key] = int(s[0]), centre[key], s[1 : 1 + p * p].reshape(p, p) / s[0], dict(zip(of[key], s[1 + p * p :] / s[0], strict=True))
    return out


def covariance_of(row, p: int) -> np.ndarray:
    out = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = row[f"c{i}_{j}"]
    return out


def rank_correlations(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """``by, A, B, Rho`` of all pairs of columns: correlation of ranks, equal values sharing the mean of theirs."""
    from pyspark.sql import Window as W

    long = rows.select("WindowID", by, *columns).unpivot(["WindowID", by], columns, "Feature", "value")
    long = long.withColumn("value", F.round("value", 9))  # values that differ in their last bits alone are equal
    place = W.partitionBy(by, "Feature").orderBy("value")
    rank = F.rank().over(place) + (F.count("*").over(W.partitionBy(by, "Feature", "value")) - 1) / 2.0
    wide = long.withColumn("r", rank).groupBy("WindowID", by).pivot("Feature", columns).agg(F.first("r"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    found = wide.groupBy(by).agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return found.unpivot(by, [f"`{a}|{b}`" for a, b in pairs], "pair", "Rho").select(by, F.split("pair", r"\|")[0].alias("A"), F.split("pair", r"\|")[1].alias("B"), "Rho")


def prune_by_rank_correlation(rho: dict[tuple[str, str], float], names: list[str], limit: float = 0.90) -> tuple[list[str], list[dict]]:
    """Keeps a candidate if no kept one has an absolute rank correlation of ``limit`` or more with it; and an audit."""
    kept, audit = [], []
    for name in names:
        size = lambda k: abs(rho.get((k, name), rho.get((name, k), 0.0)) or 0.0)  # noqa: B023, E731
        near = max(kept, key=size, default=None)
        keep = near is None or size(near) < limit
        audit.append({"Feature": name, "Kept": keep, "Representative": name if keep else near, "AbsRho": 0.0 if near is None else size(near)})
        if keep:
            kept.append(name)
    return kept, audit


def components_of(covariance: np.ndarray, share: float = 0.80, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, principal components of the standardised columns up to ``share`` of the variance, ``least`` at least, and their shares."""
    scale = np.sqrt(np.diag(covariance))
    scale = np.where(scale > 1e-12, scale, 1.0)
    values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    ratio = values / max(values.sum(), 1e-300)
    k = min(len(values), max(least, int(np.searchsorted(np.cumsum(ratio), share) + 1)))
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])  # an eigenvector's sign is free: its largest part is positive
    return scale, (vectors * sign[:, None])[:k], ratio[:k]


def effective_size(n: int, rho: float) -> float:
    r = min(max(rho, 0.0), 0.98)
    return float(min(max(n * (1 - r) / (1 + r), 2.0), n))


def legal_splits(t: np.ndarray, least: int, search: tuple[float, float]) -> list[int]:
    n = len(t)
    return [k for k in range(least, n - least + 1) if k < n and search[0] <= t[k] <= search[1]]


def best(scores: list[tuple[float, int]]) -> tuple[float, int]:
    """Largest score, the earliest of equal ones; (NaN, -1) for none."""
    top, at = np.nan, -1
    for s, k in scores:
        if at < 0 or s > top:
            top, at = s, k
    return top, at


def cov_ic(t: np.ndarray, x: np.ndarray, rep: Representation, least: int, search: tuple[float, float]) -> tuple[float, int]:
    """Gain in Mahalanobis cost of one mean change, less (d + 1) log n_eff: squared error on whitened rows."""
    w = x @ rep.whitening
    cost = lambda v: float(((v - v.mean(0)) ** 2).sum())
    penalty, whole = (x.shape[1] + 1) * np.log(effective_size(len(x), rep.rho)), cost(w)
    return best([(whole - cost(w[:k]) - cost(w[k:]) - penalty, k) for k in legal_splits(t, least, search)])


def segmented_trend(t: np.ndarray, x: np.ndarray, rep: Representation, least: int, search: tuple[float, float]) -> tuple[float, int]:
    """Gain of a level and a slope change over one line, less (2 d + 1) log n_eff."""
    w, m = x @ rep.whitening, t / 60.0

    def sse(design: np.ndarray) -> float:
        return float(((w - design @ np.linalg.lstsq(design, w, rcond=None)[0]) ** 2).sum())

    line = np.column_stack([np.ones(len(m)), m])
    whole, penalty = sse(line), (2 * x.shape[1] + 1) * np.log(effective_size(len(x), rep.rho))
    return best([(whole - sse(np.column_stack([line, m >= m[k], np.maximum(m - m[k], 0)])) - penalty, k) for k in legal_splits(t, least, search)])


def segment_costs(x: np.ndarray, model: str) -> np.ndarray:
    """[a, b]: cost of rows a to b - 1 as one segment; l2, l1 or rbf with the median heuristic."""
    n = len(x)
    out = np.full((n + 1, n + 1), np.inf)
    if model == "rbf":
        square = ((x[:, None] - x[None]) ** 2).sum(2)
        some = square[np.triu_indices(n, 1)]
        some = some[some > 0]
        gram = np.exp(-square / (np.median(some) if len(some) else 1.0))
        area = np.zeros((n + 1, n + 1))
        area[1:, 1:] = gram.cumsum(0).cumsum(1)
        for a in range(n):
            for b in range(a + 1, n + 1):
                out[a, b] = (b - a) - (area[b, b] - area[a, b] - area[b, a] + area[a, a]) / (b - a)
        return out
    for a in range(n):
        for b in range(a + 1, n + 1):
            part = x[a:b]
            out[a, b] = ((part - part.mean(0)) ** 2).sum() if model == "l2" else np.abs(part - np.median(part, 0)).sum()
    return out


def partition(costs: np.ndarray, penalty: float, least: int) -> list[int]:
    """Ends of the segments that minimise cost plus penalty per change (exact optimal partitioning)."""
    n = len(costs) - 1
    value, back = np.full(n + 1, np.inf), np.full(n + 1, -1)
    value[0] = -penalty
    for b in range(least, n + 1):
        for a in range(0, b - least + 1):
            v = value[a] + costs[a, b] + penalty
            if v < value[b] - 1e-12:
                value[b], back[b] = v, a
    ends, b = [], n
    while b > 0 and back[b] >= 0:
        ends.append(b)
        b = int(back[b])
    return ends[::-1]


def pelt(t: np.ndarray, x: np.ndarray, costs: np.ndarray, model: str, multiplier: float, rho: float, least: int, search: tuple[float, float]) -> tuple[bool, float]:
    """Whether a change lies within the search window, and the time of the first one."""
    size = np.log(effective_size(len(x), rho))
    ends = partition(costs, multiplier * (size if model == "rbf" else (x.shape[1] + 1) * size), least)
    inside = [t[e] for e in ends[:-1] if search[0] <= t[e] <= search[1]]
    return bool(inside), float(inside[0]) if inside else np.nan


def wide_series(long: DataFrame, series: list[str], features: list[str]) -> DataFrame:
    """One row per series: its times in order and the feature vectors at them."""
    at = long.groupBy(*series, "RelativeCenter_sec").agg(F.collect_list(F.struct("Feature", "z")).alias("v"))
    whole = at.filter(F.size("v") == len(features))  # a time counts if all features are known there
    vector = F.transform(F.array(*[F.lit(f) for f in features]), lambda f: F.get(F.filter("v", lambda e: e["Feature"] == f), 0)["z"])
    points = F.array_sort(F.collect_list(F.struct(F.col("RelativeCenter_sec").alias("t"), vector.alias("x"))))
    return whole.groupBy(*series).agg(points.alias("p")).select(*series, F.transform("p", lambda v: v["t"]).alias("t"), F.transform("p", lambda v: v["x"]).alias("x"))


def series_of(observations: DataFrame, series: list[str], features: list[str]) -> DataFrame:
    """``wide_series`` of observations with a column of z scores for each feature: one shuffle of them, none of single values."""
    vector = F.array(*features)
    known = observations.select(*series, F.col("RelativeCenter_sec").alias("t"), vector.alias("x")).filter(F.size(F.array_compact("x")) == len(features))
    points = F.array_sort(F.collect_list(F.struct("t", "x")))
    return known.groupBy(*series).agg(points.alias("p")).select(*series, F.transform("p", lambda v: v["t"]).alias("t"), F.transform("p", lambda v: v["x"]).alias("x"))


def trend_gains(t: np.ndarray, ys: list[np.ndarray], least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places where a right part may begin, and for vectors of each space how much a step and a bend there take off the squared error of a line. t: series x times."""
    n, m = t.shape[1], t / 60.0
    k = np.arange(least, min(n - least, n - 1) + 1)
    ones = np.ones_like(m)

    def fitted(columns: list[np.ndarray]) -> list[np.ndarray]:
        q, _ = np.linalg.qr(np.stack(columns, -1))
        return [(np.einsum("snq,snd->sqd", q, y) ** 2).sum((1, 2)) for y in ys]

    line = fitted([ones, m])
    bent = [fitted([ones, m, (m >= m[:, [i]]).astype(float), np.maximum(m - m[:, [i]], 0)]) for i in k]
    return k, [np.stack([b[j] - line[j] for b in bent], 1) if len(k) else np.zeros((len(t), 0)) for j in range(len(ys))]


def score_matrix(series: DataFrame, keys: list[str], features: list[str], spaces: dict[int, list[Representation]], least: int = 5, at_once: int = 2000) -> DataFrame:
    """SegmentedTrend of every series (``keys, t, x``, one row each, x in the order of ``features``) in the spaces fitted for its window length; many series at once."""
    sent = {length: [(r.name, [features.index(c) for c in r.columns], r.centre, r.scale, r.components, r.whitening, r.rho) for r in found] for length, found in spaces.items()}

    def score(batches):
        for whole in batches:
            for begin in range(0, len(whole), at_once):
                b, found = whole.slice(begin, at_once), []
                for rows, length, t, x in alike(b, len(features)):
                    own = sent.get(length, [])
                    ys = [(x[..., at] if parts is None else ((x[..., at] - centre) / scale) @ parts.T) @ white for _, at, centre, scale, parts, white, _ in own]
                    if not ys:
                        continue
                    k, gains = trend_gains(t, ys, least)
                    if not len(k):
                        continue
                    for (name, *_, rho), y, gain in zip(own, ys, gains, strict=True):
                        scores = gain - (2 * y.shape[2] + 1) * np.log(effective_size(t.shape[1], rho))
                        for search, span in SEARCH_WINDOWS.items():
                            some, *best = best_of(t, k, scores, span)
                            if len(some):
                                found.append((rows[some], name, search, "SegmentedTrend", *best))
                yield scored_batch(b, keys, found)

    return spread(series, 2000).mapInArrow(score, score_shape(series, keys))


def costs_together(x: np.ndarray, model: str) -> np.ndarray:
    """``segment_costs`` of many series of one size: series x (n + 1) x (n + 1)."""
    count, n, _ = x.shape
    out = np.full((count, n + 1, n + 1), np.inf)
    if model == "rbf":
        square = ((x[:, :, None] - x[:, None]) ** 2).sum(3)
        i, j = np.triu_indices(n, 1)
        some = square[:, i, j]
        known = np.sort(np.where(some > 0, some, np.inf), 1)
        many = (some > 0).sum(1)
        at = lambda k: known[np.arange(count), np.clip(k, 0, max(len(i) - 1, 0))] if len(i) else np.ones(count)
        middle = np.where(many > 0, (at((many - 1) // 2) + at(many // 2)) / 2, 1.0)
        area = np.zeros((count, n + 1, n + 1))
        area[:, 1:, 1:] = np.exp(-square / middle[:, None, None]).cumsum(1).cumsum(2)
        for a in range(n):
            b = np.arange(a + 1, n + 1)
            out[:, a, b] = (b - a) - (area[:, b, b] - area[:, a, b] - area[:, b, a] + area[:, a, [a]]) / (b - a)
        return out
    for a in range(n):
        for b in range(a + 1, n + 1):
            part = x[:, a:b]
            out[:, a, b] = ((part - part.mean(1, keepdims=True)) ** 2).sum((1, 2)) if model == "l2" else np.abs(part - np.median(part, 1, keepdims=True)).sum((1, 2))
    return out


def partitions_together(costs: np.ndarray, penalties: np.ndarray, least: int) -> np.ndarray:
    """``partition`` of many series and penalties: back[s, m, b], the begin of the last segment of the best partition of the first b rows; -1 for none."""
    count, n = len(costs), costs.shape[1] - 1
    value, back = np.full((n + 1, count, len(penalties)), np.inf), np.full((n + 1, count, len(penalties)), -1)
    value[0] = -penalties
    for b in range(least, n + 1):
        for a in range(0, b - least + 1):
            v = value[a] + costs[:, a, b][:, None] + penalties
            better = v < value[b] - 1e-12
            value[b], back[b] = np.where(better, v, value[b]), np.where(better, a, back[b])
    return np.moveaxis(back, 0, 2)


def first_inside(t: np.ndarray, back: np.ndarray, search: tuple[float, float]) -> np.ndarray:
    """Time of each series' and penalty's first change within the search window, NaN without one. A change is where a segment ends before the last row."""
    found = np.full(back.shape[:2], np.nan)
    s, m = np.indices(back.shape[:2])
    b = np.full(back.shape[:2], back.shape[2] - 1)
    for _ in range(back.shape[2]):
        b = np.where(b > 0, back[s, m, np.maximum(b, 0)], 0)
        if (b <= 0).all():
            break
        at = t[s, np.clip(b, 0, t.shape[1] - 1)]
        found = np.where((b > 0) & (at >= search[0]) & (at <= search[1]), at, found)  # from the last to the first
    return found


def score_pelt(
    series: DataFrame, keys: list[str], features: list[str], spaces: dict[int, list[Representation]], multipliers: tuple[float, ...], space: str = "reduced", least: int = 5, models: tuple[str, ...] = tuple(PELT_MODELS), at_once: int = 500
) -> DataFrame:
    """Detections of every series in one space over the grid of cost models and penalty multipliers; costs are computed once per model, for many series at once."""
    kinds = dict(series.dtypes)
    shape = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["Model string", "Multiplier double", "SearchWindow string", "Detected boolean", "Latency_sec double"])
    chosen = {length: next(s for s in found if s.name == space) for length, found in spaces.items()}

    def score(batches):
        for whole in batches:
            for begin in range(0, len(whole), at_once):
                b = whole.slice(begin, at_once)
                for rows, length, t, x in alike(b, len(features)):
                    rep = chosen.get(length)
                    if rep is None:
                        continue
                    x = rep.transform(x[..., [features.index(c) for c in rep.columns]]) @ rep.whitening
                    size = np.log(effective_size(t.shape[1], rep.rho))
                    for model in models:
                        back = partitions_together(costs_together(x, model), np.array(multipliers) * (size if model == "rbf" else (x.shape[2] + 1) * size), least)
                        for name, search in SEARCH_WINDOWS.items():
                            late = first_inside(t, back, search).ravel()
                            own = [b.column(b.schema.get_field_index(c)).take(pa.array(np.repeat(rows, len(multipliers)))) for c in keys]
                            text = lambda v: pa.array([v] * len(late), pa.string())  # noqa: B023, E731
                            yield pa.RecordBatch.from_arrays(
                                [*own, text(model), pa.array(np.tile(multipliers, len(rows)), pa.float64()), text(name), pa.array(~np.isnan(late)), pa.array(late, pa.float64(), from_pandas=True)],
                                names=[*keys, "Model", "Multiplier", "SearchWindow", "Detected", "Latency_sec"],
                            )

    return spread(series, 1000).mapInArrow(score, shape)


def balanced_rows(stable: DataFrame, features: list[str], most: int = 40, seed: int = 42) -> DataFrame:
    """At most ``most`` complete rows of each window length, subject and condition, picked by a hash: bounds what fits are made on."""
    from pyspark.sql import Window as W

    from tessaline.functions.scalars import hash64

    order = W.partitionBy("WindowLength_sec", "Subject", "ConditionCode").orderBy(hash64(F.col("WindowID"), seed), "WindowID")
    # one opaque condition: as many single ones the optimizer would combine endlessly
    whole = F.size(F.array_compact(F.array(*features))) == len(features)
    return stable.filter(whole).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).drop("turn")


def components_scores(long: DataFrame, loadings: DataFrame) -> DataFrame:
    """Long z scores -> the same with components for features; ``loadings(WindowLength_sec, Feature, Component, centre, weight)`` are a few hundred rows a length."""
    ids = [c for c in long.columns if c not in ("Feature", "z")]
    both = long.join(F.broadcast(loadings), ["WindowLength_sec", "Feature"])
    return both.groupBy(*ids, "Component").agg(F.sum((F.col("z") - F.col("centre")) * F.col("weight")).alias("z")).withColumnRenamed("Component", "Feature")


def pruned(rows: DataFrame, candidates: list[str], by: str, limit: float = 0.90) -> dict[int, tuple[list[str], list[dict]]]:
    """By value of ``by``, which candidates stay, and the audit."""
    pairs: dict[int, dict] = {r[by]: {} for r in rows.select(by).distinct().collect()}
    for r in rank_correlations(rows, candidates, by).collect():
        pairs[r[by]][r["A"], r["B"]] = r["Rho"]
    out = {}
    for key, found in sorted(pairs.items()):
        kept, audit = prune_by_rank_correlation(found, candidates, limit)
        out[key] = kept, [{by: key, **a} for a in audit]
    return out


def fit_representations(
    rows: DataFrame,
    candidates: list[str],
    families: dict[str, list[str]],
    rho: dict[tuple[int, str], float],
    by: str = "WindowLength_sec",
    limit: float = 0.90,
    share: float = 0.80,
    reduced: list[str] | None = None,
    whole: list[str] | None = None,
) -> tuple[dict[int, list[Representation]], list[dict]]:
    """For each window length the family spaces, the pruned space and principal components; and the audit of the pruning.

    rows: z scores of windows that don't overlap. Spark makes all sums; the driver gets one row of moments per length and space, and solves
    matrices of at most 23 columns. reduced: the columns of the pruned space, for all lengths; without them each length's rows are pruned. whole: the columns that
    components are made of, those of the largest family if not named. rho: lag-1 correlation by length and feature, whose median a space has until
    ``with_rho`` gives it the one of its own columns.
    """
    whole = whole or max(families.values(), key=len)
    own = {} if reduced is not None else pruned(rows, candidates, by, limit)

    every = list(dict.fromkeys([*whole, *candidates, *(c for columns in families.values() for c in columns)]))
    lengths = [r[by] for r in rows.select(by).distinct().collect()]
    kept = {length: reduced if reduced is not None else own[length][0] for length in lengths}
    sets = {length: families | {"reduced": kept[length]} for length in lengths}
    pick = lambda columns: np.eye(len(every))[[every.index(c) for c in columns]]
    sums = spread_of(rows, every, by, {length: {name: pick(columns) for name, columns in sets[length].items()} for length in lengths})
    mid = lambda length, columns: float(np.median([rho.get((length, c), 0.0) for c in columns]))
    out: dict[int, list[Representation]] = {}
    bases, turned, at = {}, {}, [every.index(c) for c in whole]
    for length in sorted(sums):
        n, mean, covariance, fourth = sums[length]
        for name, columns in sets[length].items():
            m = pick(columns)
            out.setdefault(length, []).append(Representation(name, tuple(columns), shrunk(m @ covariance @ m.T, fourth[name], n), mid(length, columns)))
        scale, parts, _ = components_of(covariance[np.ix_(at, at)], share)
        bases[length], turned[length] = (mean[at], scale, parts), {"independent_pca": (parts / scale) @ pick(whole)}
    for length, (n, _, covariance, fourth) in sorted(spread_of(rows, every, by, turned).items()):
        m, (centre, scale, parts) = turned[length]["independent_pca"], bases[length]
        out[length].append(Representation("independent_pca", tuple(whole), shrunk(m @ covariance @ m.T, fourth["independent_pca"], n), mid(length, whole), centre, scale, parts))
    return out, [a for _, audit in own.values() for a in audit]


def loadings_of(spaces: dict[int, list[Representation]]) -> list[tuple]:
    """Rows for ``components_scores``, of the spaces that have components."""
    return [
        (length, f, k, float(r.centre[j]), float(row[j] / r.scale[j])) for length, found in spaces.items() for r in found if r.components is not None for k, row in enumerate(r.components) for j, f in enumerate(r.columns)
    ]


def with_rho(spaces: dict[int, list[Representation]], rho: dict[tuple[int, str], float]) -> dict[int, list[Representation]]:
    """Spaces with their own lag-1 correlations, by length and name; 0 where none is known."""
    return {length: [replace(r, rho=rho.get((length, r.name), 0.0)) for r in found] for length, found in spaces.items()}


def space_table(spark, spaces: dict[int, list[Representation]], features: list[str]) -> DataFrame:
    """Spaces as rows for ``detectors.project``, over vectors of all ``features`` in their order."""
    rows = []
    for length, found in spaces.items():
        for r in found:
            plain, place = np.zeros((len(r.covariance), len(features))), [features.index(c) for c in r.columns]
            plain[:, place] = np.eye(len(place)) if r.components is None else r.components / r.scale
            offset = np.zeros(len(plain)) if r.components is None else (r.components / r.scale) @ r.centre
            white = r.whitening
            rows.append((length, r.name, float(r.rho), len(r.covariance), plain.tolist(), offset.tolist(), (white @ plain).tolist(), (white @ offset).tolist()))
    return spark.createDataFrame(
        rows, "WindowLength_sec int, Representation string, rho double, Dimensions int, plain array<array<double>>, plain_offset array<double>, white array<array<double>>, white_offset array<double>"
    )
