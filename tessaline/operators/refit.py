"""End-to-end leave-one-participant-out: features, components, covariances, autocorrelations, thresholds and penalties, all fitted without the one who is judged.

No fold rereads the others' windows. What a fold's covariances, components and shrinkage hang on are sums over windows of (1, features, products of
two features) times themselves: one matrix per window length holds all of them, also the fourth moments of any linear image. It is summed once over all participants; a
fold's matrix is that less the participant's own, which comes from the few windows that participant has in the sample. A fold is then a small eigenvalue problem, and folds are
groups of one job. Autocorrelations of any space follow from cross moments of each session's windows with their followers.

Every series is scored in the spaces of all folds at once, as this is what the method asks for: the others' pseudo-boundaries give a fold's thresholds, the
participant's own boundaries are judged by them. Folds go in blocks of bounded number, so what is sent to the tasks is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.config import SEARCH_WINDOWS
from tessaline.functions.scalars import hash64
from tessaline.operators.calibration import choose_multiplier, one_per_block
from tessaline.operators.matrix import FLOOR, balanced_rows, components_of, effective_size, legal_splits, prune_by_rank_correlation, shrunk

GROUP = ["WindowLength_sec", "SearchWindow", "Method", "TransitionType", "Representation"]
SPACES = "WindowLength_sec int, HeldOut string, Representation string, Features array<string>, rho double, Dimensions int, TrainingRows long, TrainingParticipants long, white array<array<double>>, white_offset array<double>"


# ---- fits from sums


def design(x: np.ndarray) -> np.ndarray:
    """Rows of features -> rows of (1, features, products of two features)."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def moment_matrices(sample: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """``sample(kind, WindowLength_sec, x)`` -> for each kind and length the sum of the design rows' outer products.

    A task sums its own rows; sums of tasks meet row of the matrix by row. The result, some 300 x 300 numbers for each of a few kinds and lengths, comes to the driver.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(["kind", "WindowLength_sec"]):
                d = design(np.vstack(part["x"].to_numpy()))
                total[key] = total.get(key, 0.0) + d.T @ d
        for (kind, length), m in total.items():
            yield pd.DataFrame({"kind": kind, "WindowLength_sec": length, "i": np.arange(len(m)), "v": list(m)})

    def together(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[:1].assign(v=[np.vstack(part["v"].to_numpy()).sum(0)])

    shape = "kind string, WindowLength_sec int, i int, v array<double>"
    rows = sample.select("kind", "WindowLength_sec", "x").mapInPandas(add, shape).groupBy("kind", "WindowLength_sec", "i").applyInPandas(together, shape).toPandas()
    return {key: np.vstack(part.sort_values("i")["v"].to_numpy()) for key, part in rows.groupby(["kind", "WindowLength_sec"])}


class Sums:
    """Means, covariance and fourth moments of windows, from the sum of their design rows' outer products."""

    def __init__(self, total: np.ndarray, p: int):
        self.total, self.n = total, float(total[0, 0])
        self.mean = total[0, 1 : p + 1] / self.n
        self.covariance = total[1 : p + 1, 1 : p + 1] / self.n - np.outer(self.mean, self.mean)

    def fourth(self, b: np.ndarray) -> float:
        """Mean of the squared squared length of b (x - mean)."""
        g = b.T @ b
        i, j = np.triu_indices(len(self.mean))
        w = np.concatenate([[self.mean @ g @ self.mean], -2 * g @ self.mean, np.where(i == j, 1.0, 2.0) * g[i, j]])
        return float(w @ self.total @ w) / self.n

    def shrunk(self, b: np.ndarray) -> np.ndarray:
        return shrunk(b @ self.covariance @ b.T, self.fourth(b), int(round(self.n)))


def whitening_of(covariance: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(covariance)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, FLOOR))) @ vectors.T


def spearman(x: np.ndarray) -> np.ndarray:
    ranks = pd.DataFrame(np.round(x, 9)).rank().to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.corrcoef(ranks, rowvar=False)) if len(x) > 1 else np.zeros((x.shape[1],) * 2)


# ---- cross moments of sessions


def lag_moments(crossfit: DataFrame, features: list[str], most_sessions: int, seed: int = 42) -> DataFrame:
    """``WindowLength_sec, Subject, Session, n, m``: sums over pairs of a window and the next one of a session, of 5 windows at least; at most ``most_sessions`` of each length, picked by a hash."""
    p = len(features)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("WindowIndex")[features].to_numpy()
        a, b = x[:-1], x[1:]
        m = np.concatenate([a.sum(0), b.sum(0), (a.T @ a).ravel(), (b.T @ b).ravel(), (a.T @ b).ravel()]) if len(a) else np.zeros(2 * p + 3 * p * p)
        return part.iloc[:1][["WindowLength_sec", "Subject", "Session"]].assign(n=len(a), m=[m])

    ids = ["WindowLength_sec", "Subject", "Session"]
    long_enough = crossfit.groupBy(*ids).agg(F.count("*").alias("rows")).filter("rows >= 5")
    order = W.partitionBy("WindowLength_sec").orderBy(hash64(F.concat_ws("|", "Subject", "Session"), seed), "Subject", "Session")
    some = long_enough.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most_sessions).select(*ids)
    return crossfit.join(some, ids, "left_semi").groupBy(*ids).applyInPandas(of, "WindowLength_sec int, Subject string, Session int, n int, m array<double>")


class Lags:
    """Sessions' cross moments of one window length."""

    def __init__(self, subjects: np.ndarray, n: np.ndarray, m: np.ndarray, p: int):
        cut = np.cumsum([p, p, p * p, p * p])
        a, b, aa, bb, ab = np.split(m / n[:, None], cut, axis=1)
        square = lambda v: v.reshape(-1, p, p)
        self.subjects = subjects
        self.aa = square(aa) - a[:, :, None] * a[:, None]
        self.bb = square(bb) - b[:, :, None] * b[:, None]
        self.ab = square(ab) - a[:, :, None] * b[:, None]

    def rho(self, b: np.ndarray, but: str | None) -> float:
        """Median, over sessions of all participants but one and rows of ``b``, of the lag-1 correlation of b x; within 0 and 0.98."""
        use = self.subjects != but
        over = lambda m: np.einsum("kp,spq,kq->sk", b, m[use], b)
        first, second, cross = over(self.aa), over(self.bb), over(self.ab)
        fine = (first > 1e-24) & (second > 1e-24)
        if not fine.any():
            return 0.0
        return float(np.clip(np.median(cross[fine] / np.sqrt(first[fine] * second[fine])), 0.0, 0.98))


# ---- folds


def fit_fold(own: dict[str, np.ndarray], total: dict[str, np.ndarray], apart: bool, ranks: tuple[np.ndarray, np.ndarray], lags: Lags | None, who: str, features: list[str], candidates: list[str]) -> list[tuple]:
    """The pruned and the component space without ``who``: (name, columns, rho, dimensions, rows, whitened rows, offset). Empty if nobody else is there."""
    kind, p = "apart" if apart else "all", len(features)
    if kind not in total:
        return []
    left = total[kind] - own.get(kind, 0.0)
    if left[0, 0] < 1.5:
        return []
    sums = Sums(left, p)
    rho = spearman(ranks[1][ranks[0] != who])
    kept, _ = prune_by_rank_correlation({(a, b): rho[i, j] for i, a in enumerate(candidates) for j, b in enumerate(candidates)}, candidates)
    plain = np.eye(p)[[features.index(c) for c in kept]]
    scale, parts, _ = components_of(sums.covariance)
    out = []
    for name, columns, b, centre in (("reduced", kept, plain, np.zeros(p)), ("independent_pca", features, parts / scale, sums.mean)):
        white = whitening_of(sums.shrunk(b)) @ b
        out.append((name, list(columns), lags.rho(b, who) if lags else 0.0, len(b), int(round(sums.n)), white.tolist(), (white @ centre).tolist()))
    return out


def fit_folds(crossfit: DataFrame, features: list[str], candidates: list[str], rank_rows: int = 100_000, lag_sessions: int = 1000, least_apart: int = 100, seed: int = 42) -> DataFrame:
    """The spaces of every fold: one row per window length, participant left out and space (``SPACES``).

    crossfit: ``WindowID, Subject, Session, ConditionCode, WindowLength_sec, WindowIndex, StepSize_sec`` and z scores. Covariances and components use up to 40 windows that
    don't overlap of each participant and condition (overlapping ones where fewer than ``least_apart`` would be left), the pruning up to 50 of any. Ranks and autocorrelations
    have no sums to subtract from: they are made of ``rank_rows`` windows and ``lag_sessions`` sessions of a length at most, picked by a hash; that is all of them up to about 1,000 participants.
    """
    spark = crossfit.sparkSession
    every = F.ceil(F.col("WindowLength_sec") / F.col("StepSize_sec"))
    apart = crossfit.filter(F.pmod(F.col("WindowIndex"), every) == 0)
    kinds = [balanced_rows(rows, features).withColumn("kind", F.lit(kind)) for kind, rows in (("apart", apart), ("all", crossfit))]
    sample = kinds[0].unionByName(kinds[1]).select("kind", "WindowLength_sec", F.col("Subject").alias("HeldOut"), F.array(*features).alias("x"))
    total = moment_matrices(sample)

    pick = W.partitionBy("WindowLength_sec").orderBy(hash64(F.col("WindowID"), seed), "WindowID")
    ranked = balanced_rows(crossfit, candidates, 50).withColumn("place", F.row_number().over(pick)).filter(F.col("place") <= rank_rows)
    ranked = ranked.select("WindowLength_sec", "Subject", *candidates).toPandas()
    moved = lag_moments(crossfit, features, lag_sessions, seed).toPandas()
    ranks = {length: (part["Subject"].to_numpy(), part[candidates].to_numpy()) for length, part in ranked.groupby("WindowLength_sec")}
    lags = {length: Lags(part["Subject"].to_numpy(), part["n"].to_numpy(float), np.vstack(part["m"].to_numpy()), len(features)) for length, part in moved.groupby("WindowLength_sec")}
    sent = spark.sparkContext.broadcast((total, ranks, lags))

    counts = apart.groupBy("WindowLength_sec", "Subject").agg(F.count("*").alias("apart"))
    per_length = crossfit.groupBy("WindowLength_sec").agg(F.countDistinct("Subject").alias("participants"))
    per_length = per_length.join(apart.groupBy("WindowLength_sec").agg(F.count("*").alias("all_apart")), "WindowLength_sec", "left")
    # a participant without stable windows of a length has a fold there as well
    lengths = F.array(*[F.lit(int(k)) for k in sorted(ranks)]).cast("array<int>")
    folds = crossfit.select("Subject").distinct().select("Subject", F.explode(lengths).alias("WindowLength_sec"))
    folds = folds.join(counts, ["WindowLength_sec", "Subject"], "left").join(F.broadcast(per_length), "WindowLength_sec")
    folds = folds.select("WindowLength_sec", F.col("Subject").alias("HeldOut"), (F.coalesce("all_apart", F.lit(0)) - F.coalesce("apart", F.lit(0)) >= least_apart).alias("enough"), "participants")

    def fit(fold: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        total, ranks, lags = sent.value
        columns = [c.split(" ")[0] for c in SPACES.split(", ")]
        if fold.empty:
            return pd.DataFrame(columns=columns)
        length, who, enough, people = fold.iloc[0][["WindowLength_sec", "HeldOut", "enough", "participants"]]
        mine = {kind: (d := design(np.vstack(part["x"].to_numpy()))).T @ d for kind, part in own.groupby("kind")}
        of = {kind: m for (kind, k), m in total.items() if k == length}
        rows = fit_fold(mine, of, bool(enough), ranks[length], lags.get(length), who, features, candidates)
        return pd.DataFrame([(length, who, name, cols, rho, d, n, people - 1, white, offset) for name, cols, rho, d, n, white, offset in rows], columns=columns)

    keys = ["WindowLength_sec", "HeldOut"]
    return folds.groupBy(*keys).cogroup(sample.groupBy(*keys)).applyInPandas(fit, SPACES)


# ---- scores in all folds


def trend_bases(t: np.ndarray, splits: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Orthonormal columns of a line, and for each split of a line with a step and a bend there."""
    m = t / 60.0

    def basis(columns: list[np.ndarray]) -> np.ndarray:
        u, s, _ = np.linalg.svd(np.column_stack(columns), full_matrices=False)
        return u[:, s > s[0] * 1e-12]

    line = [np.ones(len(m)), m]
    return basis(line), [basis([*line, (m >= m[k]).astype(float), np.maximum(m - m[k], 0)]) for k in splits]


def fold_scores(t: np.ndarray, y: np.ndarray, dims: np.ndarray, rho: np.ndarray, least: int, search: tuple[float, float]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """y: folds x times x whitened coordinates, those beyond ``dims`` zero. By method: best score of each fold, to 9 digits, and its split, earliest first; nothing without a legal split."""
    splits = legal_splits(t, least, search)
    if not splits:
        return {}
    n, k = len(t), np.array(splits)
    size = np.log([effective_size(n, r) for r in rho])
    s = np.concatenate([np.zeros_like(y[:, :1]), y.cumsum(1)], 1)
    square = lambda v: (v * v).sum(-1)
    left, whole = s[:, k], s[:, -1:]
    gain = square(left) / k + square(whole - left) / (n - k) - square(whole) / n
    before = t < 0
    centre = (y[:, before] if before.any() else y).mean(1, keepdims=True)
    c = np.concatenate([np.zeros_like(y[:, :1]), (y - centre).cumsum(1)], 1)
    bridge = np.sqrt(square(c[:, k] - (k / n)[None, :, None] * c[:, -1:]) / (k * (n - k) / n))
    moved = np.sqrt(least / 2.0) * np.sqrt(square((s[:, k + least] - s[:, k]) / least - (s[:, k] - s[:, k - least]) / least))
    line, bent = trend_bases(t, splits)
    fitted = lambda q: square(np.einsum("nk,fnd->fkd", q, y)).sum(1)
    base = fitted(line)
    trend = np.stack([fitted(q) - base for q in bent], 1)
    found = {"CovIC": gain - ((dims + 1) * size)[:, None], "SegmentedTrend": trend - ((2 * dims + 1) * size)[:, None], "CUSUM": bridge, "MOSUM": moved}
    out = {}
    for method, scores in found.items():
        scores = np.round(scores, 9)
        at = scores.argmax(1)
        out[method] = scores[np.arange(len(scores)), at], k[at]
    return out


def first_breaks(y: np.ndarray, penalties: np.ndarray, least: int) -> list[list[list[int]]]:
    """For each fold and penalty the breakpoints of the exact optimal partition by squared error, all folds and penalties at once."""
    folds, n, _ = y.shape
    s = np.concatenate([np.zeros_like(y[:, :1]), y.cumsum(1)], 1)
    q = np.concatenate([np.zeros((folds, 1)), (y * y).sum(2).cumsum(1)], 1)
    value = np.full((n + 1, *penalties.shape), np.inf)
    back = np.full((n + 1, *penalties.shape), -1)
    value[0] = -penalties
    for b in range(least, n + 1):
        for a in range(0, b - least + 1):
            d = s[:, b] - s[:, a]
            v = value[a] + (q[:, b] - q[:, a] - (d * d).sum(1) / (b - a))[:, None] + penalties
            better = v < value[b] - 1e-12
            value[b], back[b] = np.where(better, v, value[b]), np.where(better, a, back[b])
    out = []
    for f in range(folds):
        row = []
        for m in range(penalties.shape[1]):
            ends, b = [], n
            while b > 0 and back[b, f, m] > 0:
                b = int(back[b, f, m])
                ends.append(b)
            row.append(ends[::-1])
        out.append(row)
    return out


def score_folds(series: DataFrame, keys: list[str], spaces: DataFrame, multipliers: tuple[float, ...], least: int = 5, folds_at_once: int = 2000) -> DataFrame:
    """``keys, HeldOut, Representation, SearchWindow, Method, Multiplier, Score, Detected, SplitIndex, CandidateLatency_sec`` of every series in every fold's spaces.

    Score methods have no Multiplier; PELT_L2, in the pruned space, has a row for each with Detected in place of a score. Folds go to the tasks in
    blocks of ``folds_at_once`` participants, some 15 kB each.
    """
    kinds = dict(series.dtypes)
    shape = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["HeldOut string, Representation string, SearchWindow string, Method string, Multiplier double, Score double, Detected boolean, SplitIndex int, CandidateLatency_sec double"])
    who = sorted(r["HeldOut"] for r in spaces.select("HeldOut").distinct().collect())

    def block(some: list[str]) -> DataFrame:
        stacks: dict[tuple[int, str], tuple] = {}
        got = spaces.filter(F.col("HeldOut").isin(some)).toPandas()
        for key, part in got.groupby(["WindowLength_sec", "Representation"]):
            most = part["Dimensions"].max()
            w = np.zeros((len(part), most, len(part["white"].iloc[0][0])))
            o = np.zeros((len(part), most))
            for i, (m, off) in enumerate(zip(part["white"], part["white_offset"], strict=True)):
                w[i, : len(m)], o[i, : len(m)] = np.vstack(m), off
            stacks[key] = (part["HeldOut"].tolist(), part["rho"].to_numpy(), part["Dimensions"].to_numpy(), w, o)
        sent = series.sparkSession.sparkContext.broadcast(stacks)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [c.split(" ")[0] for c in shape.split(", ")]
            for b in batches:
                rows = []
                for r in b.itertuples(index=False):
                    t, x, own = np.array(r.t), np.vstack(r.x), tuple(getattr(r, c) for c in keys)
                    for (length, name), (held, rho, dims, w, o) in sent.value.items():
                        if length != r.WindowLength_sec:
                            continue
                        y = np.einsum("np,fkp->fnk", x, w) - o[:, None]
                        for search, span in SEARCH_WINDOWS.items():
                            for method, (best, at) in fold_scores(t, y, dims, rho, least, span).items():
                                rows += [(*own, h, name, search, method, None, float(v), None, int(k), float(t[k])) for h, v, k in zip(held, best, at, strict=True)]
                        if name == "reduced":
                            base = (dims + 1) * np.log([effective_size(len(t), v) for v in rho])
                            breaks = first_breaks(y, np.outer(base, multipliers), least)
                            for h, per in zip(held, breaks, strict=True):
                                for m, ends in zip(multipliers, per, strict=True):
                                    for search, (low, high) in SEARCH_WINDOWS.items():
                                        k = next((k for k in ends if low <= t[k] <= high), None)
                                        rows.append((*own, h, name, search, "PELT_L2", m, None, k is not None, k, None if k is None else float(t[k])))
                    if len(rows) > 50_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

        return series.mapInPandas(score, shape)

    out = block(who[:folds_at_once])
    for at in range(folds_at_once, len(who), folds_at_once):
        out = out.unionByName(block(who[at : at + folds_at_once]))
    return out


# ---- calibration of folds


def training_thresholds(expanded: DataFrame, fpr: float = 0.05) -> DataFrame:
    """``GROUP, HeldOut``: the threshold from the other participants' blocks, its rate on them, and how many there are.

    expanded: matches with the scores of their candidates in the folds' spaces. The threshold is the score at rank ceil((1 - fpr) (n - 1)), found by numbering rows, so no group is an array.
    """
    keys = [*GROUP, "HeldOut"]
    train = one_per_block(expanded.filter("Subject <> HeldOut and Score is not null"), keys)
    ranked = train.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("Score")) - 1).withColumn("n", F.count("*").over(W.partitionBy(*keys)))
    at = ranked.filter(F.col("place") == F.ceil((1 - fpr) * (F.col("n") - 1))).select(*keys, F.col("Score").alias("Threshold"))
    rate = train.join(at, keys).groupBy(*keys, "Threshold").agg(
        F.countDistinct("Subject").alias("TrainingParticipants"), F.countDistinct("CandidateBlockID").alias("TrainingPseudoBlocks"), F.avg((F.col("Score") >= F.col("Threshold")).cast("double")).alias("TrainingFPR")
    )
    return rate


def training_penalties(expanded: DataFrame, target: float = 0.05) -> DataFrame:
    """``GROUP, HeldOut, Multiplier, TrainingFPR``: the multiplier that the other participants' blocks choose."""
    keys = [*GROUP, "HeldOut"]
    train = one_per_block(expanded.filter("Subject <> HeldOut"), [*keys, "Multiplier"])
    rates = train.groupBy(*keys, "Multiplier").agg(F.avg(F.col("Detected").cast("double")).alias("FPR"), F.countDistinct("CandidateBlockID").alias("TrainingPseudoBlocks"))
    return choose_multiplier(rates, keys, target).join(rates.withColumnRenamed("FPR", "TrainingFPR"), [*keys, "Multiplier"])


def held_out_detections(real: DataFrame, pseudo: DataFrame, thresholds: DataFrame, penalties: DataFrame) -> DataFrame:
    """Each participant's own boundaries, real and matched pseudo ones, judged by the fold without that participant."""
    keep = [*GROUP, "HeldOut", "Subject", "BoundaryKind", "BoundaryID", "PseudoCondition", "CandidateBlockID", "Score", "Threshold", "Multiplier", "Detected", "Latency_sec"]
    none = F.lit(None).cast("string")
    own = [
        real.withColumns({"BoundaryKind": F.lit("Real"), "PseudoCondition": none, "CandidateBlockID": none}),
        pseudo.withColumns({"BoundaryKind": F.lit("Pseudo"), "BoundaryID": F.col("PseudoMatchID")}),
    ]
    parts = []
    for rows in own:
        rows, keys = rows.filter("Subject = HeldOut"), [*GROUP, "HeldOut"]
        scored = rows.filter("Multiplier is null").drop("Detected").join(thresholds.select(*keys, "Threshold"), keys)
        parts.append(scored.withColumn("Detected", F.coalesce(F.col("Score") >= F.col("Threshold"), F.lit(False))))
        parts.append(rows.join(penalties.select(*keys, "Multiplier"), [*keys, "Multiplier"]).withColumn("Threshold", F.lit(None).cast("double")))
    late = F.when(F.col("Detected"), F.col("CandidateLatency_sec"))
    done = [p.withColumn("Latency_sec", late).select(*keep) for p in parts]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def held_out_summary(detections: DataFrame) -> DataFrame:
    """Rates by group, kind and condition; real rows keep their null condition."""
    return detections.groupBy(*GROUP, "BoundaryKind", "PseudoCondition").agg(
        F.countDistinct("HeldOut").alias("HeldoutParticipants"),
        F.count("*").alias("BoundariesOrMatches"),
        F.sum(F.col("Detected").cast("long")).alias("Detections"),
        F.avg(F.col("Detected").cast("double")).alias("DetectionRate"),
        F.median("Latency_sec").alias("MedianLatencyDetected"),
    )
