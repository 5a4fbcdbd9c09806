"""Robust normalisation per subject that never uses the sessions under analysis."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.config import ALLOWED_WINDOWS
from tessaline.functions.scalars import correlation, hash64, log_feature
from tessaline.operators.quality import quality_rows
from tessaline.sources.shared import tasks_of

TINY = 1e-12


def unpivot(rows: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Long form ``ids, Feature, value`` of the analysis scale, without missing values."""
    scaled = rows.select(*ids, *[log_feature(c, c).alias(c) for c in features])
    return scaled.unpivot(ids, features, "Feature", "value").filter("value is not null")


def robust_scale(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys, centre, scale, method``: the median, and the first usable of 1.4826 MAD, IQR / 1.349, SD and 1."""
    first = rows.groupBy(*keys).agg(
        F.median(value).alias("centre"),
        ((F.percentile(value, 0.75) - F.percentile(value, 0.25)) / 1.349).alias("iqr"),
        F.stddev_samp(value).alias("sd"),
        F.count(value).alias("n"),
    )
    off = rows.join(first.select(*keys, "centre"), keys).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("centre")))).alias("mad"))
    spread = first.join(off, keys)
    usable = lambda c: F.coalesce(F.col(c) > TINY, F.lit(False))
    return spread.select(
        *keys,
        "n",
        "centre",
        F.when(usable("mad"), F.col("mad")).when(usable("iqr"), F.col("iqr")).when(usable("sd"), F.col("sd")).otherwise(1.0).alias("scale"),
        F.when(usable("mad"), "MAD").when(usable("iqr"), "IQR").when(usable("sd"), "SD").otherwise("constant_fallback").alias("method"),
    )


def exclusion_keys_of_boundaries(inventory: DataFrame) -> DataFrame:
    """``Subject, NormKey, excluded``: both sessions of a boundary are left out."""
    return inventory.select("Subject", F.col("BoundaryID").alias("NormKey"), F.array("PreSession", "PostSession").alias("excluded"))


def exclusion_keys_of_sessions(sessions: DataFrame) -> DataFrame:
    """A pseudo-boundary leaves out its own session."""
    key = F.concat("Subject", F.lit("_S"), F.col("Session").cast("string"))
    return sessions.select("Subject", key.alias("NormKey"), F.array("Session").alias("excluded"))


def normalisation_source(windows: DataFrame, keys: DataFrame, threshold: float, edge: float) -> DataFrame:
    """Rows that each key is normalised by, with the name of the rule that chose them.

    Stable windows of other sessions with at least 5 of each condition; else quality windows under the same
    rule; else 10 quality windows; else 10 stable ones. A key that meets no rule gets no row.
    """
    quality = quality_rows(windows, threshold)
    inside = (F.col("StartTime_sec") >= edge) & (F.col("EndTime_sec") <= F.col("SessionDuration_sec") - edge)
    rows = quality.withColumn("stable", inside).join(keys, "Subject").filter(~F.array_contains("excluded", F.col("Session")))
    group = W.partitionBy("NormKey", "WindowLength_sec")
    is_a, is_na = F.col("ConditionCode") == "A", F.col("ConditionCode") == "NA"
    counted = (
        rows.withColumn("sa", F.count_if(is_a & F.col("stable")).over(group))
        .withColumn("sna", F.count_if(is_na & F.col("stable")).over(group))
        .withColumn("qa", F.count_if(is_a).over(group))
        .withColumn("qna", F.count_if(is_na).over(group))
    )
    rule = (
        F.when((F.col("sa") >= 5) & (F.col("sna") >= 5), "stable_balanced")
        .when((F.col("qa") >= 5) & (F.col("qna") >= 5), "quality_balanced")
        .when(F.col("qa") + F.col("qna") >= 10, "quality_unbalanced")
        .when(F.col("sa") + F.col("sna") >= 10, "stable_unbalanced")
    )
    return counted.withColumn("NormSource", rule).filter(
        F.col("NormSource").isNotNull() & (F.col("NormSource").startswith("quality") | F.col("stable"))
    ).drop("sa", "sna", "qa", "qna")


def balanced_sample(source: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows of one condition as of the other under balanced rules, picked by a hash of the window."""
    group = W.partitionBy("NormKey", "WindowLength_sec")
    order = W.partitionBy("NormKey", "WindowLength_sec", "ConditionCode").orderBy(hash64(F.concat_ws("|", "NormKey", "WindowID"), seed), "WindowID")
    n = F.least(F.count_if(F.col("ConditionCode") == "A").over(group), F.count_if(F.col("ConditionCode") == "NA").over(group))
    picked = source.withColumn("most", F.when(F.col("NormSource").endswith("_balanced"), n).otherwise(F.count("*").over(group)))
    return picked.withColumn("turn", F.row_number().over(order)).filter("turn <= most").drop("most", "turn")


PARAMETERS = "NormKey string, WindowLength_sec int, NormSource string, Feature string, n long, centre double, scale double, method string"


def chosen_rows(own: np.ndarray, is_a: np.ndarray, is_na: np.ndarray, stable: np.ndarray, ids: list[bytes], key: str, seed: int = 42) -> tuple[np.ndarray, str | None]:
    """Places of the rows that ``normalisation_source`` and ``balanced_sample`` pick for one key out of a subject's quality rows of one length, and the rule's name. own: rows of sessions that aren't left out."""
    count = lambda c: int((own & c).sum())
    sa, sna, qa, qna = count(is_a & stable), count(is_na & stable), count(is_a), count(is_na)
    if sa >= 5 and sna >= 5:
        rule = "stable_balanced"
    elif qa >= 5 and qna >= 5:
        rule = "quality_balanced"
    elif qa + qna >= 10:
        rule = "quality_unbalanced"
    elif sa + sna >= 10:
        rule = "stable_unbalanced"
    else:
        return np.zeros(0, int), None
    use = own if rule.startswith("quality") else own & stable
    if not rule.endswith("_balanced"):
        return np.flatnonzero(use), rule
    sides = [np.flatnonzero(use & c) for c in (is_a, is_na)]
    most = min(map(len, sides))
    begun, picked = hashlib.sha256(f"{seed}|{key}|".encode()), []
    for rows in sides:
        if len(rows) > most:
            order = []
            for i in rows.tolist():
                h = begun.copy()
                h.update(ids[i])
                order.append((h.digest()[:8], ids[i], i))
            rows = np.array([i for _, _, i in sorted(order)[:most]], int)
        picked.append(rows)
    return np.concatenate(picked), rule


def robust_scales(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns of values, NaN where missing -> n, centre, scale and method as ``robust_scale`` finds them."""
    n = (~np.isnan(v)).sum(0)
    centre, scale, method = np.full(v.shape[1], np.nan), np.ones(v.shape[1]), np.full(v.shape[1], "constant_fallback", object)
    for k in np.unique(n[n > 0]):
        columns = np.flatnonzero(n == k)
        x = np.sort(v[:, columns], 0)[:k]  # NaN last
        at = lambda s, q: s[int(q * (k - 1))] + (s[min(int(q * (k - 1)) + 1, k - 1)] - s[int(q * (k - 1))]) * (q * (k - 1) % 1)  # noqa: B023, E731
        centre[columns] = m = at(x, 0.5)
        spreads = {"MAD": 1.4826 * at(np.sort(np.abs(x - m), 0), 0.5), "IQR": (at(x, 0.75) - at(x, 0.25)) / 1.349, "SD": x.std(0, ddof=1) if k > 1 else np.zeros(len(columns))}
        for name, spread in reversed(spreads.items()):
            usable = columns[spread > TINY]
            scale[usable], method[usable] = spread[spread > TINY], name
    return n, centre, scale, method


def fit_normalisation(windows: DataFrame, keys: DataFrame, features: list[str], threshold: float = 20.0, edge: float = 60.0) -> DataFrame:
    """``NormKey, WindowLength_sec, NormSource, Feature, n, centre, scale, method``.

    Equals ``robust_scale`` of the ``balanced_sample`` of the ``normalisation_source``. A subject's rows of one length meet once, and all keys of the subject, about one a session,
    are fitted from them in numpy: no row is repeated for each key and feature. With more users there are more subjects, not larger ones.
    """
    names = PARAMETERS.split(", ")

    def fit(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(rows):
            session, condition, stable = rows["Session"].to_numpy(), rows["ConditionCode"].to_numpy(), rows["stable"].to_numpy(bool)
            is_a, is_na, ids, values = condition == "A", condition == "NA", [w.encode() for w in rows["WindowID"]], rows[features].to_numpy(float)
            for norm, excluded in zip(wanted["NormKey"], wanted["excluded"], strict=True):
                picked, rule = chosen_rows(~np.isin(session, excluded), is_a, is_na, stable, ids, norm)
                if rule is not None:
                    n, centre, scale, method = robust_scales(values[picked])
                    some = n > 0
                    parts.append(pd.DataFrame({"NormKey": norm, "WindowLength_sec": key[1], "NormSource": rule, "Feature": np.array(features)[some], "n": n[some], "centre": centre[some], "scale": scale[some], "method": method[some]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split(" ")[0] for c in names])

    of, tasks = ["Subject", "WindowLength_sec"], tasks_of(windows.sparkSession)
    inside = (F.col("StartTime_sec") >= edge) & (F.col("EndTime_sec") <= F.col("SessionDuration_sec") - edge)
    rows = quality_rows(windows, threshold).select(*of, "Session", "ConditionCode", "WindowID", inside.alias("stable"), *[log_feature(c, c).alias(c) for c in features]).repartition(tasks, *of)
    lengths = F.explode(F.array(*[F.lit(n) for n in ALLOWED_WINDOWS]))
    wanted = keys.select("Subject", lengths.alias("WindowLength_sec"), "NormKey", "excluded").repartition(tasks, *of)
    return rows.groupBy(*of).cogroup(wanted.groupBy(*of)).applyInPandas(fit, PARAMETERS)


def z_columns(observations: DataFrame, parameters: DataFrame, features: list[str], norm_key: Column) -> DataFrame:
    """``observations`` with z scores, null where a value or its parameters are missing, in place of the features. Parameters are found by ``norm_key``; an observation without any goes."""
    of = ["NormKey", "WindowLength_sec"]
    known = parameters.groupBy(*of).agg(F.map_from_entries(F.collect_list(F.struct("Feature", F.struct("centre", "scale")))).alias("m"))
    # by place, which is found at once
    wide = known.select(*of, F.transform(F.array(*[F.lit(c) for c in features]), lambda c: F.try_element_at("m", c)).alias("_p"))
    both = observations.withColumn("NormKey", norm_key).join(wide, of)
    z = {c: (log_feature(c, c) - F.get("_p", F.lit(i))["centre"]) / F.get("_p", F.lit(i))["scale"] for i, c in enumerate(features)}
    return both.withColumns(z).drop("_p", "NormKey")


def apply_normalisation(observations: DataFrame, parameters: DataFrame, ids: list[str], features: list[str], norm_key: Column) -> DataFrame:
    """Long form ``ids, Feature, z`` of observations; parameters are found by ``norm_key``."""
    ids = [*ids, "WindowLength_sec"]
    return z_columns(observations, parameters, features, norm_key).select(*ids, *features).unpivot(ids, features, "Feature", "z").filter("z is not null")


def crossfit_stable(stable: DataFrame, parameters: DataFrame, features: list[str]) -> DataFrame:
    """Stable windows with their features as z scores by the subject's other sessions. A window without parameters goes.

    parameters: those of pseudo-boundaries, each of which leaves out its own session.
    """
    ids = ["WindowID", "Subject", "Session", "ConditionCode", "WindowIndex", "StepSize_sec"]
    key = F.concat("Subject", F.lit("_S"), F.col("Session").cast("string"))
    return z_columns(stable, parameters, features, key).select(*ids, "WindowLength_sec", *features).na.drop(subset=features)


def session_correlations(long: DataFrame, value: str = "z") -> DataFrame:
    """``Subject, Session, WindowLength_sec, Feature, r``: lag-1 autocorrelation within each session, of 5 windows and 4 pairs at least."""
    of = ["Subject", "Session", "WindowLength_sec", "Feature"]
    pairs = long.withColumn("before", F.lag(value).over(W.partitionBy(*of).orderBy("WindowIndex"))).filter("before is not null")
    own = pairs.groupBy(*of).agg(F.when((F.count("*") >= 4) & (F.stddev_pop(value) > TINY) & (F.stddev_pop("before") > TINY), correlation(value, "before")).alias("r"))
    return own.filter("r is not null")


def pooled_correlation(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """Median of all sessions' and columns' correlations of each key together, within 0 and 0.98."""
    return correlations.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(0.98), F.median("r"))).alias("lag1_rho"), F.countDistinct("Subject", "Session").alias("sessions"))
