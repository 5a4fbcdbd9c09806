"""Order statistics by ranges, and those of a group without one of its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.functions import order as O
from tessaline.operators import lopo


def higher(values, q):
    v = sorted(values)
    return v[int(np.ceil(q * (len(v) - 1)))] if v else None


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group with a third of its rows equal, one of a single part, one row, and nulls."""
    rng = np.random.default_rng(2)
    made = [("hot", f"p{rng.integers(6)}", i, 5.0 if i % 3 == 0 else float(rng.normal())) for i in range(600)]
    made += [("one part", "p1", i, float(i)) for i in range(7)] + [("one row", "p2", 1, 3.5)] + [("hot", "p1", 9000 + i, None) for i in range(5)]
    return made, spark.createDataFrame(made, "g string, part string, i int, v double").repartition(5)


def test_places_and_quantiles(rows):
    made, df = rows
    got = O.ranked(df, ["g"], "v", ["i"]).collect()
    for g in {r[0] for r in made}:
        own = sorted((r["place"], r["v"], r["i"]) for r in got if r["g"] == g)
        assert [p for p, _, _ in own] == list(range(len(own))) and [x[1:] for x in own] == sorted((r[3], r[2]) for r in made if r[0] == g and r[3] is not None)
    for q in (0.0, 0.5, 0.95, 1.0):
        found = {r["g"]: r["quantile"] for r in O.group_quantile(df, ["g"], "v", q, ["i"]).collect()}
        assert found == {g: higher([r[3] for r in made if r[0] == g and r[3] is not None], q) for g in {r[0] for r in made}}
    assert O.group_quantile(df.limit(0), ["g"], "v", 0.5, ["i"]).collect() == []


def test_quantiles_without_a_part(rows):
    made, df = rows
    holders = df.select("g", "part").distinct().unionByName(df.sparkSession.createDataFrame([("hot", "absent")], "g string, part string"))
    for q in (0.0, 0.37, 0.95, 1.0):
        got = {(r["g"], r["part"]): r["Threshold"] for r in O.left_out_quantile(df, ["g"], "part", "v", q, ["i"], holders).collect()}
        assert len(got) == 9
        for (g, part), value in got.items():
            assert value == higher([r[3] for r in made if r[0] == g and r[1] != part and r[3] is not None], q)


def test_penalties_are_totals_less_own(spark):
    rows = [(30, who, m, bool((i * 7 + int(who[1])) % 10 < 4 / m)) for who in ("P0", "P1", "P2") for m in (1.0, 2.0, 4.0, 8.0) for i in range(20)]
    pelt = spark.createDataFrame(rows, "WindowLength_sec int, Subject string, Multiplier double, Detected boolean")
    got = {r["HeldOut"]: r["Multiplier"] for r in lopo.held_out_penalty(pelt, ["WindowLength_sec"], 0.15).collect()}
    for who, m in got.items():
        rate = {k: np.mean([r[3] for r in rows if r[1] != who and r[2] == k]) for k in (1.0, 2.0, 4.0, 8.0)}
        fine = [k for k in rate if rate[k] <= 0.15]
        assert m == (min(fine, key=lambda k: (round(abs(rate[k] - 0.15), 12), k)) if fine else 8.0)
    assert set(got) == {"P0", "P1", "P2"}
