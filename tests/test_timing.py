"""Timing from participants' sums against plain fits of whole frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessaline.operators import timing as T

KEYS = ["TransitionType"]


@pytest.fixture(scope="module")
def tracks(spark):
    """Twelve participants, two directions, two coordinates that change together at 15 s; times differ between participants."""
    rng = np.random.default_rng(5)
    rows = []
    for way in ("A_to_NA", "NA_to_A"):
        for who in range(12 if way == "A_to_NA" else 11):
            times = np.sort(rng.choice(np.arange(-60, 61, 5.0), 18, replace=False))
            for c in range(2):
                y = rng.normal() + 0.2 * times / 60 * rng.normal() + (0.8 - 1.4 * c) * (times >= 15) + rng.normal(0, 0.3, len(times))
                rows += [(way, f"P{who:02d}", float(t), c, float(v)) for t, v in zip(times, y)]
    rows.append(("A_to_NA", "P00", 2.5, 0, 9.0))  # a time without the other coordinate doesn't count
    frame = pd.DataFrame(rows, columns=["TransitionType", "Subject", "RelativeCenter_sec", "Coordinate", "value"])
    return frame, spark.createDataFrame(frame).withColumn("Coordinate", F.col("Coordinate").cast("int"))


def plain(frame, search=(0.0, 60.0), least=10):
    wide = frame.pivot_table(index=["Subject", "RelativeCenter_sec"], columns="Coordinate", values="value").dropna().reset_index()
    return T.fit(wide, [c for c in wide.columns if c in (0, 1)], search, least_participants=least)


def same(row, want):
    assert row["CandidateTime_sec"] == want["CandidateTime_sec"] and row["Score"] == pytest.approx(want["Score"], rel=1e-8) and (row["Participants"], row["Rows"]) == (want["Participants"], want["Rows"])
    assert row["Midpoint_sec"] == pytest.approx(want["Midpoint_sec"])


def test_fits_and_profiles(tracks):
    frame, df = tracks
    for source, part in ((df, frame), (df.filter("Coordinate = 0"), frame[frame["Coordinate"] == 0])):
        for r in T.group_fits(source.repartition(5), KEYS).collect():
            same(r, plain(part[part["TransitionType"] == r["TransitionType"]], T.SEARCH[r["SearchWindow"]]))
    points = T.group_profiles(df, KEYS).filter("SearchWindow = 'anticipatory' and TransitionType = 'A_to_NA'").collect()
    wide = frame[frame["TransitionType"] == "A_to_NA"].pivot_table(index=["Subject", "RelativeCenter_sec"], columns="Coordinate", values="value").dropna().reset_index()
    who, _ = pd.factorize(wide["Subject"], sort=True)
    want = {p["CandidateTime_sec"]: p for p in T.profile(who, wide["RelativeCenter_sec"].to_numpy(), wide[[0, 1]].to_numpy(), (-30.0, 60.0))}
    assert {r["CandidateTime_sec"] for r in points} == set(want)
    assert all(r[c] == pytest.approx(want[r["CandidateTime_sec"]][c], rel=1e-7) for r in points for c in ("Score", "Level", "Slope"))
    assert T.group_fits(df, KEYS, 12).select("TransitionType").distinct().count() == 1  # eleven are too few then


def test_resampled(tracks):
    frame, df = tracks
    own = frame[frame["TransitionType"] == "A_to_NA"]
    names = sorted(own["Subject"].unique())
    source = df.filter("TransitionType = 'A_to_NA'").repartition(4)
    boot = {r["rep"]: r for r in T.resampled_fits(source, KEYS, 5).filter("SearchWindow = 'post_only'").collect()}
    assert sorted(boot) == [0, 1, 2, 3, 4]
    for rep, r in boot.items():
        picks = [names[T.number("timing", rep, slot) % len(names)] for slot in range(len(names))]
        drawn = pd.concat([own[own["Subject"] == n].assign(Subject=f"{n}#{i}") for i, n in enumerate(picks)])
        same(r, plain(drawn))
    left = {r["rep"]: r for r in T.resampled_fits(source, KEYS, how="leave_one_out").filter("SearchWindow = 'anticipatory'").collect()}
    assert sorted(left) == list(range(12))
    for rep, r in left.items():
        same(r, plain(own[own["Subject"] != names[rep]], (-30.0, 60.0)))
    both = T.common_participants(df, [])
    assert {r["Subject"] for r in both.select("Subject").distinct().collect()} == set(names[:11])


def test_no_group_meets_in_one_task(tracks):
    """Rows of participants are summed where they are; only sums of tasks are shuffled by group."""
    _, df = tracks
    plan = T.group_fits(df, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    at = [line for line in plan.split("\n") if "FlatMapGroupsInPandas" in line]
    assert len(at) == 1 and plan.index("FlatMapGroupsInPandas") < plan.index("MapInPandas", plan.index("FlatMapGroupsInPandas"))


def test_draws_scarcity_and_power(spark, tracks):
    matches = spark.createDataFrame([("A_to_NA", 30, "P1", b, f"C{k}", f"K{k // 2}") for b in ("B1", "B2", "B3") for k in range(4)], "TransitionType string, WindowLength_sec int, Subject string, MatchedRealBoundaryID string, CandidateID string, CandidateBlockID string")
    keys = ["TransitionType", "WindowLength_sec"]
    choices = T.pseudo_choices(matches, keys, 6)
    got = choices.collect()
    # two blocks for three boundaries: one of them goes without, and no block is taken twice
    for rep in range(6):
        took = [r["CandidateID"] for r in got if r["rep"] == rep]
        assert len(took) == 3 and took.count(None) == 1 and {c[1:] for c in took if c} & {"0", "1"} and {c[1:] for c in took if c} & {"2", "3"}
    assert {(r["SelectedMatches"], r["SkippedForScarcity"], r["ParticipantsWithPseudoData"]) for r in T.scarcity(choices, keys).collect()} == {(2, 1, 1)}
    _, df = tracks
    rng = np.random.default_rng(1)
    null = spark.createDataFrame([("A_to_NA", "A", rep, f"P{w}", float(t), 0, float(rng.normal())) for rep in range(4) for w in range(10) for t in range(-60, 61, 5)], "TransitionType string, PseudoCondition string, rep int, Subject string, RelativeCenter_sec double, Coordinate int, value double")
    profiles = T.group_profiles(null.filter("rep = 0"), KEYS)
    times = sorted({r["CandidateTime_sec"] for r in profiles.filter("SearchWindow = 'post_only'").collect()})
    starts = {r["Position"]: r["start"] for r in T.change_times(profiles, KEYS).filter("SearchWindow = 'post_only'").collect()}
    assert starts == {"early": times[0], "middle": times[len(times) // 2], "late": times[-1]}
    changed = T.with_known_change(null, [*KEYS, "PseudoCondition"], T.change_times(profiles, KEYS).withColumn("PseudoCondition", F.lit("A")), (2.0,)).filter("SearchWindow = 'post_only' and Position = 'middle' and rep = 1 and Subject = 'P3'").toPandas()
    before = null.filter("rep = 1 and Subject = 'P3'").toPandas().set_index("RelativeCenter_sec")["value"]
    sd = null.filter("rep = 1 and RelativeCenter_sec < 0").agg(F.stddev_samp("value")).first()[0]
    for shape, part in changed.groupby("shape"):
        d = part.set_index("RelativeCenter_sec")["value"] - before
        m = starts["middle"]
        grow = [(t >= m) * 1.0 if shape == "abrupt" else min(max((t - m) / (60.0 - m), 0), 1) for t in d.index]
        assert np.allclose(d, 2 * sd * np.array(grow))
    limits = spark.createDataFrame([("A_to_NA", "post_only", 0.0), ("A_to_NA", "anticipatory", 1e9)], "TransitionType string, SearchWindow string, DualThreshold double")
    power = T.timing_power(null, limits, profiles, KEYS, ["PseudoCondition"], (3.0,)).collect()
    assert len(power) == 2 * 3 * 2 and all(r["Series"] == 4 and r["Power"] == (1.0 if r["SearchWindow"] == "post_only" else 0.0) for r in power)
