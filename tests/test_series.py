"""Work that is done where a series, a session or a subject lies: equal to the window expressions, and without shuffles of single values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.functions.resampling import with_draws
from tessaline.functions.scalars import hash64
from tessaline.operators import detectors as D
from tessaline.operators import inference as I
from tessaline.operators import matrix as M
from tessaline.operators import normalize as N
from tessaline.operators import signal
from tessaline.operators.windows import window_features

FEATURES = ["MeanHR", "StdHR", "SDNN"]
KEYS = ["BoundaryID", "WindowLength_sec"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def series(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(40):
        t = np.sort(rng.choice(np.arange(-60, 65, 5.0), 9 + i % 17, replace=False))
        x = rng.normal(size=(len(t), 3)) + np.outer(t >= 5 * (i % 4), rng.normal(size=3))
        x[t < 0] = x[t < 0][:1] if i % 10 == 0 and (t < 0).any() else x[t < 0]  # no spread before
        rows.append((f"B{i}", (30, 60)[i % 2], t.tolist(), x.tolist()))
    return spark.createDataFrame(rows, "BoundaryID string, WindowLength_sec int, t array<double>, x array<array<double>>")


@pytest.fixture
def spaces(spark):
    c = np.array([[2.0, 0.5, 0.1], [0.5, 1.0, 0.2], [0.1, 0.2, 0.5]])
    found = {n: [M.Representation("all", tuple(FEATURES), c, 0.3), M.Representation("two", tuple(FEATURES[:2]), c[:2, :2] * (1 + n / 60), 0.7)] for n in (30, 60)}
    return M.space_table(spark, found, FEATURES), found


def test_scores_equal_the_window_expressions_and_shuffle_no_coordinates(series, spaces):
    got = D.score_spaces(series, KEYS, spaces[0])
    plan = plan_of(got)
    assert "Generate" not in plan and "Window [" not in plan and plan.count("Exchange") == 1
    own = [*KEYS, "Representation", "rho"]
    plain, white = (D.project(series, KEYS, spaces[0], m) for m in ("plain", "white"))
    costs = D.split_costs(D.pre_standardised(plain, own), own, 5)
    wanted = D.legacy_bic(costs, own)
    for part in (D.binseg_l2(costs, own), D.cov_ic(D.split_costs(white, own, 5), own), D.cusum(white, own, 5), D.mosum(white, own, 5)):
        wanted = wanted.unionByName(part)
    columns = [*KEYS, "Representation", "SearchWindow", "Method"]
    a, b = (df.toPandas().set_index(columns).sort_index() for df in (got, wanted))
    assert a.index.equals(b.index) and len(a) > 500
    assert np.allclose(a["Score"], b["Score"], atol=1e-6) and (a["SplitIndex"] == b["SplitIndex"]).all() and (a["CandidateLatency_sec"] == b["CandidateLatency_sec"]).all()


def test_trends_and_penalised_partitions_equal_those_of_single_series(series, spaces):
    found = spaces[1]
    got = {tuple(r[:4]): r for r in M.score_matrix(series, KEYS, FEATURES, found).collect()}
    hits = {(r["BoundaryID"], r["Model"], r["Multiplier"], r["SearchWindow"]): r for r in M.score_pelt(series, KEYS, FEATURES, found, (0.25, 2.0), space="two").collect()}
    assert len(hits) == 40 * 3 * 2 * 2
    for r in series.collect():
        t, x = np.array(r["t"]), np.array(r["x"])
        for search, span in (("post_only", (0.0, 60.0)), ("anticipatory", (-30.0, 60.0))):
            for rep in found[r["WindowLength_sec"]]:
                score, k = M.segmented_trend(t, x[:, : len(rep.columns)], rep, 5, span)
                row = got.get((r["BoundaryID"], r["WindowLength_sec"], rep.name, search))
                assert (row is None) == (k < 0) and (k < 0 or (row["Score"] == pytest.approx(score, abs=1e-6) and row["SplitIndex"] == k))
            rep = found[r["WindowLength_sec"]][1]
            y = x[:, :2] @ rep.whitening
            for model in ("l2", "l1", "rbf"):
                costs = M.segment_costs(y, model)
                for m in (0.25, 2.0):
                    hit, late = M.pelt(t, y, costs, model, m, rep.rho, 5, span)
                    row = hits[r["BoundaryID"], model, m, search]
                    assert row["Detected"] == hit and (row["Latency_sec"] == late if hit else row["Latency_sec"] is None)


def windows_of(spark):
    rng, rows = np.random.default_rng(6), []
    for s in range(3):
        for session in range(1, 5):
            for w in range(20 if s else 4):
                v = [None if rng.random() < 0.05 else float(rng.normal(70, 5)) if s < 2 else 60.0, float(rng.normal(5, 1)), float(rng.normal(0, 40))]
                rows.append((f"w{s}_{session}_{w}", f"P{s}", session, "A" if session % 2 else "NA", 30, 5.0 * w, 5.0 * w + 30, 190.0, *v))
    shape = "WindowID string, Subject string, Session int, ConditionCode string, WindowLength_sec int, StartTime_sec double, EndTime_sec double, SessionDuration_sec double, MeanHR double, StdHR double, SDNN double"
    return spark.createDataFrame(rows, shape)


def test_parameters_equal_the_steps_and_no_row_is_repeated(spark, monkeypatch):
    monkeypatch.setattr(N, "quality_rows", lambda df, threshold: df)
    df = windows_of(spark)
    keys = N.exclusion_keys_of_sessions(df.select("Subject", "Session").distinct())
    got = N.fit_normalisation(df, keys, FEATURES)
    assert not any(word in plan_of(got) for word in ("Expand", "Generate [", "SortMergeJoin", "BroadcastHashJoin"))
    of = ["NormKey", "WindowLength_sec", "NormSource"]
    steps = N.robust_scale(N.unpivot(N.balanced_sample(N.normalisation_source(df, keys, 20.0, 60.0)), of, FEATURES), [*of, "Feature"])
    a, b = (x.toPandas().set_index([*of, "Feature"]).sort_index() for x in (got, steps.select(*got.columns)))
    assert a.index.equals(b.index) and {i[2] for i in a.index} >= {"stable_balanced"} and (a["n"] == b["n"]).all() and (a["method"] == b["method"]).all()
    assert np.allclose(a["centre"], b["centre"]) and np.allclose(a["scale"], b["scale"])


def test_windows_are_dealt_to_all_tasks(spark):
    """A few kilobytes of samples cost minutes of work, so they aren't merged into one task for being small."""
    rows = [(f"P{s}", 1, "A", float(t), float(t % 7), 800.0 + (t * 37 % 50)) for s in range(40) for t in range(0, 360, 3)]
    samples = spark.createDataFrame(rows, "Subject string, Session int, ConditionCode string, t double, x double, rr double").coalesce(1)
    plan = plan_of(window_features(samples))
    assert "REPARTITION_BY_NUM" in plan


def test_entropies_of_many_series(spark):
    rng = np.random.default_rng(7)
    parts = [np.round(rng.normal(800, 30, n), -1) for n in (5, 20, 33, 33, 60, 450)] + [np.full(30, 800.0)]
    got = signal.sample_entropies(np.concatenate(parts), np.array([len(p) for p in parts]))
    assert np.allclose(got, [signal.sample_entropy(p) for p in parts], equal_nan=True)


def test_sums_of_images(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3)) + 5
    df = spark.createDataFrame([(30 + i % 2, *map(float, v)) for i, v in enumerate(x)], "WindowLength_sec int, a double, b double, c double")
    image = rng.normal(size=(2, 3))
    for length, (n, mean, covariance, fourth) in M.spread_of(df, list("abc"), "WindowLength_sec", {k: {"two": image} for k in (30, 31)}).items():
        own = x[length - 30 :: 2]
        c = (own - own.mean(0)) @ image.T
        assert n == 30 and np.allclose(mean, own.mean(0)) and np.allclose(covariance, np.cov(own.T, bias=True)) and fourth["two"] == pytest.approx(((c**2).sum(1) ** 2).mean())


def test_draws_are_not_broadcast(spark):
    """Repeated rows look as small as those they were made of."""
    per = spark.createDataFrame([(g, f"P{i}", float(i), 1.0) for g in ("a", None) for i in range(6)], "g string, Subject string, s double, c double")
    numbered = I.number_subjects(per, ["g"])
    drawn = with_draws(numbered, 5, "x")
    wanted = numbered.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("u", hash64(F.concat_ws("|", F.lit("x"), F.col("rep").cast("string"), F.col("slot").cast("string"))))
    assert sorted(map(tuple, drawn.select(wanted.columns).collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    sums = I.bootstrap_sums(per, ["g"], ["s", "c"], 5, "x")
    assert "Broadcast" not in plan_of(drawn) + plan_of(sums)
    got = {(r["g"], r["rep"]): (r["s"], r["c"]) for r in sums.collect()}
    assert len(got) == 10 and all(c == 6 for _, c in got.values()) and all(got["a", k] == got[None, k] for k in range(5))
