"""Generalised estimating equations with exchangeable working correlation and robust errors."""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.config import NORMAL_975
from tessaline.operators.calibration import with_bh


def fit_gee(y: np.ndarray, x: np.ndarray, who: np.ndarray, family: str = "gaussian", most: int = 200, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, robust standard errors and the working correlation. Raises ValueError where there is nothing to fit.

    Clusters are taken whole; identity link for gaussian, logit for binomial.
    """
    if len(np.unique(who)) < 2 or np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("too few participants or collinear terms")
    if family == "binomial" and len(np.unique(y)) < 2:
        raise ValueError("outcome doesn't vary")
    groups = [np.flatnonzero(who == w) for w in np.unique(who)]
    beta, alpha = np.zeros(x.shape[1]), 0.0
    if family == "gaussian":
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(most):
        eta = x @ beta
        mu = eta if family == "gaussian" else 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        var = np.ones_like(mu) if family == "gaussian" else np.maximum(mu * (1 - mu), 1e-10)
        e = (y - mu) / np.sqrt(var)
        phi = float((e**2).sum() / max(1, len(y) - x.shape[1]))
        pairs = sum(len(g) * (len(g) - 1) / 2 for g in groups)
        cross = sum((e[g].sum() ** 2 - (e[g] ** 2).sum()) / 2 for g in groups)
        alpha = float(np.clip(cross / max(1.0, pairs - x.shape[1]) / max(phi, 1e-12), -0.99 / max(1, max(map(len, groups)) - 1), 0.99))
        bread, score, meat = np.zeros((x.shape[1],) * 2), np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
        for g in groups:
            a = np.sqrt(var[g])
            d = x[g] * (1.0 if family == "gaussian" else var[g][:, None])
            r = (1 - alpha) * np.eye(len(g)) + alpha
            inv = np.linalg.inv(r * np.outer(a, a) * max(phi, 1e-12))
            bread += d.T @ inv @ d
            u = d.T @ inv @ (y[g] - mu[g])
            score += u
            meat += np.outer(u, u)
        step = np.linalg.solve(bread, score)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
        if np.abs(beta).max() > 50:
            raise ValueError("separated outcome")
    inverse = np.linalg.inv(bread)
    return beta, np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0)), alpha


TERMS = ("Intercept", "A_to_NA", "BoundaryOrder")
SHAPE = "Outcome string, Term string, Estimate double, SE double, CI_Lower double, CI_Upper double, P double, Alpha double, N int, Participants int, Reason string"


def _model(data: pd.DataFrame, outcome: str, family: str) -> list[tuple]:
    """Rows of one model. The boundary's order is taken less the group's mean. What can't be fitted gives one row with its reason."""
    many = data["Subject"].nunique()
    failed = lambda term, why: [(outcome, term, *[None] * 6, len(data), many, why[:80])]
    if family == "binomial":
        events = data.groupby("TransitionType")["y"].agg(["sum", "count"])
        if data["y"].nunique() < 2 or ((events["sum"] == 0) | (events["sum"] == events["count"])).any():
            return failed("not_estimable", "a direction has no event, or nothing else")
    order = data["BoundaryOrder"].astype(float)
    x = np.column_stack([np.ones(len(data)), (data["TransitionType"] == "A_to_NA").astype(float), order - order.mean()]) if len(data) else np.zeros((0, 3))
    try:
        b, se, alpha = fit_gee(data["y"].to_numpy(float), x, data["Subject"].to_numpy(), family)
    except (ValueError, np.linalg.LinAlgError) as e:
        return failed("failed", str(e))
    p = [erfc(abs(bi / s) / sqrt(2)) if s > 0 else None for bi, s in zip(b, se, strict=True)]
    return [(outcome, t, bi, s, bi - NORMAL_975 * s, bi + NORMAL_975 * s, pi, alpha, len(data), many, None) for t, bi, s, pi in zip(TERMS, b, se, p, strict=True)]


def boundary_gee(results: DataFrame, keys: list[str], least_detected: int = 20) -> DataFrame:
    """Per group the effect of direction and boundary order on the real boundaries, clustered by participant: on detection (binomial), on
    ``MahalanobisMagnitude`` and, with ``least_detected`` detected ones in both directions, on their latency. q values are by outcome and term.
    """
    kinds = dict(results.dtypes)
    shape = ", ".join([f"{k} {kinds[k]}" for k in keys] + [SHAPE])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = _model(frame.assign(y=frame["Detected"].astype(float)), "Detected", "binomial")
        rows += _model(frame.assign(y=frame["MahalanobisMagnitude"]).dropna(subset=["y"]), "MahalanobisMagnitude", "gaussian")
        hit = frame[frame["Detected"].astype(bool)].assign(y=frame["Latency_sec"]).dropna(subset=["y"])
        if len(hit) >= least_detected and hit["TransitionType"].nunique() == 2:
            rows += _model(hit, "Latency_sec", "gaussian")
        return pd.DataFrame([(*key, *r) for r in rows], columns=[c.split()[0] for c in shape.split(", ")])

    real = results.filter("BoundaryKind = 'Real'").select(*keys, "Subject", "TransitionType", "BoundaryOrder", "Detected", "MahalanobisMagnitude", "Latency_sec")
    return with_bh(real.groupBy(*keys).applyInPandas(run, shape), "P", ["Outcome", "Term"], "Q")


def feature_gee(effects: DataFrame) -> DataFrame:
    """Per window length and feature the effect of direction on the change at a boundary (``ZChange``); q values by length and term."""
    keys = ["WindowLength_sec", "Feature"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = _model(frame.assign(y=frame["ZChange"]).dropna(subset=["y"]), "ZChange", "gaussian")
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, *[c.split()[0] for c in SHAPE.split(", ")]])

    fitted = effects.groupBy(*keys).applyInPandas(run, f"WindowLength_sec int, Feature string, {SHAPE}")
    return with_bh(fitted, "P", ["WindowLength_sec", "Term"], "Q")
