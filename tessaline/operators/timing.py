"""Pooled change timing over participants, and its validation by pseudo draws, bootstrap and known changes.

A shared fit needs of each participant only sums: products of trend, step and bend, and of these with the values, at every candidate time, each
less the participant's mean and divided by the participant's rows. ``grams`` makes one row of them per participant. A group's fit is their sum, a bootstrap replicate
a sum weighted by how often each participant was drawn, a left-out one the total less the participant's own; tasks add up their own participants
first, and a fit solves three equations per candidate time. So no group of participants ever meets in one task, and no participant is copied.
``profile`` and ``fit`` do the same plainly on one frame.
""" 

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions.arrays import quantile_higher
from tessaline.functions.resampling import pick, with_draws
from tessaline.operators.inference import number_subjects


def number(*parts: object, seed: int = 42) -> int:
    """The first 64 bits of sha256('seed|a|b|...')."""
    return int(hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:16], 16)


def demean(v: np.ndarray, who: np.ndarray, m: int) -> np.ndarray:
    sums, n = np.zeros((m, v.shape[1])), np.bincount(who, minlength=m)
    np.add.at(sums, who, v)
    return v - (sums / np.maximum(n, 1)[:, None])[who]


def profile(who: np.ndarray, t: np.ndarray, y: np.ndarray, search: tuple[float, float], least: int = 3) -> list[dict]:
    """Score of each candidate time: the drop in participant-weighted squared error when all share a level and a slope
    change there, per participant. Every participant has an intercept of their own and weighs 1; demeaning removes the intercepts.
    """
    m = int(who.max()) + 1 if len(who) else 0
    if not m:
        return []
    weight = np.sqrt(1.0 / np.bincount(who, minlength=m))[who][:, None]
    minutes = t[:, None] / 60.0
    yw = demean(y, who, m) * weight
    base = demean(minutes, who, m) * weight

    def sse(design: np.ndarray) -> tuple[float, np.ndarray]:
        beta = np.linalg.lstsq(design, yw, rcond=None)[0]
        return float(((yw - design @ beta) ** 2).sum()), beta

    whole, _ = sse(base)
    times, out = np.unique(t), []
    for c in times:
        left, right = int((times < c).sum()), int((times >= c).sum())
        if not search[0] - 1e-9 <= c <= search[1] + 1e-9 or left < least or right < least:
            continue
        step = demean((t >= c).astype(float)[:, None], who, m) * weight
        hinge = demean(np.maximum(minutes - c / 60.0, 0), who, m) * weight
        part, beta = sse(np.column_stack([base, step, hinge]))
        before = times[times < c]
        out.append(
            {"CandidateTime_sec": float(c), "Score": (whole - part) / m, "Midpoint_sec": float((before.max() + c) / 2), "IntervalLeft_sec": float(before.max()), "Level": float(np.linalg.norm(beta[-2])), "Slope": float(np.linalg.norm(beta[-1])), "Participants": m, "Rows": len(t)}
        )
    return out


def fit(frame: pd.DataFrame, columns: list[str], search: tuple[float, float], least: int = 3, least_participants: int = 10) -> dict | None:
    """The candidate with the largest score, the earliest of equal ones; None with too few participants or no candidate."""
    data = frame.replace([np.inf, -np.inf], np.nan).dropna(subset=["RelativeCenter_sec", *columns])
    who, names = pd.factorize(data["Subject"], sort=True)
    if len(names) < least_participants:
        return None
    found = profile(who, data["RelativeCenter_sec"].to_numpy(float), data[columns].to_numpy(float), search, least)
    return max(found, key=lambda r: (round(r["Score"], 12), -r["CandidateTime_sec"])) if found else None


def participant_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("weight", 1.0 / F.count("*").over(W.partitionBy(*keys, "Subject")))


def departure(white: DataFrame, series: list[str]) -> DataFrame:
    """``series, Subject, RelativeCenter_sec, Coordinate, value``: distance from the series' own mean before time 0 in whitened coordinates (its whole mean if it has none before)."""
    own = W.partitionBy(*series, "Feature")
    before = F.coalesce(F.avg(F.when(F.col("t") < 0, F.col("z"))).over(own), F.avg("z").over(own))
    off = white.withColumn("off", F.col("z") - before)
    return off.groupBy(*series, "Subject", F.col("t").alias("RelativeCenter_sec"), F.lit(0).alias("Coordinate")).agg(F.sqrt(F.sum(F.col("off") * F.col("off"))).alias("value"))


def signed(white: DataFrame, series: list[str]) -> DataFrame:
    """The whitened coordinates themselves, in the columns of ``departure``: they keep directions, and share one change."""
    return white.select(*series, "Subject", F.col("t").alias("RelativeCenter_sec"), F.col("Feature").alias("Coordinate"), F.col("z").alias("value"))


def participant_trajectory(values: DataFrame, keys: list[str]) -> DataFrame:
    """Means over boundaries first, then one value per participant, time and coordinate."""
    at = [*keys, "Subject", "RelativeCenter_sec", "Coordinate"]
    per = values.groupBy(*at, "BoundaryID").agg(F.avg("value").alias("value"))
    return per.groupBy(*at).agg(F.avg("value").alias("value"), F.count("*").alias("boundaries"))


SEARCH = {"post_only": (0.0, 60.0), "anticipatory": (-30.0, 60.0)}
FIT = "Score double, CandidateTime_sec double, Midpoint_sec double, Participants int, Rows int"
POINT = "CandidateTime_sec double, Score double, Level double, Slope double, Participants int"


def gram(t: np.ndarray, y: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """A participant's sums: for each time of the grid whether it is there and the six products and 3 x d products with y; then y's own square, the rows and 1."""
    n, m = len(t), t / 60.0
    less = lambda v: v - v.mean(0)
    yc, trend = less(y), less(m)
    step, bend = less((t[:, None] >= grid).astype(float)), less(np.maximum(m[:, None] - grid / 60.0, 0))
    own = np.isin(grid, t).astype(float)
    pairs = [np.full(len(grid), trend @ trend), trend @ step, trend @ bend, (step * step).sum(0), (step * bend).sum(0), (bend * bend).sum(0)]
    with_y = np.concatenate([np.tile(trend @ yc, (len(grid), 1)), step.T @ yc, bend.T @ yc], axis=1)
    per_time = np.column_stack([*pairs, with_y]) / n
    return np.concatenate([np.column_stack([own, per_time]).ravel(), [(yc * yc).sum() / n, n, 1.0]])


def solved(v: np.ndarray, grid: np.ndarray, search: tuple[float, float], least: int = 3) -> list[dict]:
    """``profile`` from summed ``gram`` rows."""
    square, rows, people = v[-3:]
    if people <= 0:
        return []
    per = v[:-3].reshape(len(grid), -1)
    there, d = per[:, 0] > 0, (per.shape[1] - 7) // 3
    times, out = grid[there], []
    for k in np.flatnonzero(there):
        c = grid[k]
        left = int((times < c).sum())
        if not search[0] - 1e-9 <= c <= search[1] + 1e-9 or left < least or len(times) - left < least:
            continue
        a = np.empty((3, 3))
        a[np.triu_indices(3)] = per[k, 1:7]
        a = np.triu(a) + np.triu(a, 1).T
        b = per[k, 7:].reshape(3, d)
        beta = np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b
        trend = float((b[0] ** 2).sum() / a[0, 0]) if a[0, 0] > 1e-12 else 0.0
        before = float(times[times < c].max())
        out.append({"CandidateTime_sec": float(c), "Score": (float((b * beta).sum()) - trend) / people, "Midpoint_sec": (before + float(c)) / 2, "IntervalLeft_sec": before, "Level": float(np.linalg.norm(beta[1])), "Slope": float(np.linalg.norm(beta[2])), "Participants": int(round(people)), "Rows": int(round(rows))})
    return out


def grams(trajectory: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, Subject, grid, v``: one row of sums per participant; grid holds the times of the whole group. Times at which a coordinate is missing don't count."""
    kinds = dict(trajectory.dtypes)
    known = trajectory.filter("value is not null and not isnan(value) and RelativeCenter_sec is not null")
    per = known.groupBy(*keys, "Subject").agg(F.collect_list(F.struct("RelativeCenter_sec", "Coordinate", "value")).alias("points"))
    of = known.groupBy(*keys).agg(F.array_sort(F.collect_set("RelativeCenter_sec")).alias("grid"), F.countDistinct("Coordinate").cast("int").alias("d"))

    def make(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                grid, at = np.array(r.grid), {}
                for p in r.points:
                    at.setdefault(p["RelativeCenter_sec"], {})[p["Coordinate"]] = p["value"]
                t = np.array(sorted(k for k, y in at.items() if len(y) == r.d))
                if len(t):
                    y = np.array([[at[k][c] for c in sorted(at[k])] for k in t])
                    out.append((*[getattr(r, k) for k in keys], r.Subject, grid, gram(t, y, grid)))
            yield pd.DataFrame(out, columns=[*keys, "Subject", "grid", "v"])

    return per.join(of, keys).mapInPandas(make, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "Subject string, grid array<double>, v array<double>"]))


def totals(rows: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """``keys, [rep,] grid, v``: sums of ``grams`` rows; with ``weighted``, one for each place of the array ``w``, by it. A task adds up what it has before anything is sent."""
    kinds = dict(rows.dtypes)
    names = [*keys, "rep"] if weighted else keys
    shape = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(["rep int"] if weighted else []), "grid array<double>", "v array<double>"])

    def parts(held: dict):
        out = []
        for key, (grid, v) in held.items():
            out += [(*key, r, grid, x) for r, x in enumerate(v) if x[-1] > 0] if weighted else [(*key, grid, v[0])]
        return pd.DataFrame(out, columns=[*names, "grid", "v"])

    def add(batches):
        held, size = {}, 0
        for b in batches:
            for key, part in b.groupby(keys, sort=False):
                w = np.vstack(part["w"].to_numpy()).astype(float) if weighted else np.ones((len(part), 1))
                v = w.T @ np.vstack(part["v"].to_numpy())
                if key in held:
                    held[key][1][:] += v
                else:
                    held[key] = part["grid"].iloc[0], v
                    size += v.size
                if size > 5_000_000:
                    yield parts(held)
                    held, size = {}, 0
        yield parts(held)

    def together(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[:1].assign(v=[np.vstack(part["v"].to_numpy()).sum(0)])

    columns = [*keys, "grid", "v", "w"] if weighted else [*keys, "grid", "v"]
    return rows.select(*columns).mapInPandas(add, shape).groupBy(*names).applyInPandas(together, shape)


def fits_of(summed: DataFrame, keys: list[str], least_participants: int) -> DataFrame:
    """The candidate with the largest score, the earliest of equal ones, of every row of sums and search window; none with too few participants."""
    kinds, columns = dict(summed.dtypes), ["Score", "CandidateTime_sec", "Midpoint_sec", "Participants", "Rows"]

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if round(r.v[-1]) < least_participants:
                    continue
                for name, search in SEARCH.items():
                    found = solved(np.array(r.v), np.array(r.grid), search)
                    if found:
                        best = max(found, key=lambda x: (round(x["Score"], 12), -x["CandidateTime_sec"]))
                        out.append((*[getattr(r, k) for k in keys], name, *[best[c] for c in columns]))
            yield pd.DataFrame(out, columns=[*keys, "SearchWindow", *columns])

    return summed.select(*keys, "grid", "v").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "SearchWindow string", FIT]))


def group_fits(trajectory: DataFrame, keys: list[str], least_participants: int = 10) -> DataFrame:
    """The shared fit of each group of trajectories."""
    return fits_of(totals(grams(trajectory, keys), keys), keys, least_participants)


def group_profiles(trajectory: DataFrame, keys: list[str], least_participants: int = 10) -> DataFrame:
    """The score of every candidate time of each group of trajectories."""
    summed = totals(grams(trajectory, keys), keys)
    kinds, columns = dict(summed.dtypes), [c.split(" ")[0] for c in POINT.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if round(r.v[-1]) >= least_participants:
                    for name, search in SEARCH.items():
                        out += [(*[getattr(r, k) for k in keys], name, *[x[c] for c in columns]) for x in solved(np.array(r.v), np.array(r.grid), search)]
            yield pd.DataFrame(out, columns=[*keys, "SearchWindow", *columns])

    return summed.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "SearchWindow string", POINT]))


def resampled_fits(trajectory: DataFrame, keys: list[str], replicates: int = 0, how: str = "bootstrap", least_participants: int = 10) -> DataFrame:
    """Fits of resampled participants, by ``rep``: ``bootstrap`` draws as many as there are with replacement, ``replicates`` times; ``leave_one_out`` omits one each.

    A replicate is a weight per participant. Left-out fits take the participant's sums off the group's; their ``rep`` is the participant's place by name.
    """
    rows = grams(trajectory, keys)
    numbered = number_subjects(rows, keys)
    if how == "leave_one_out":
        whole = totals(rows, keys).select(*keys, F.col("v").alias("all"))
        left = numbered.join(whole, keys).withColumn("v", F.zip_with("all", "v", lambda a, b: a - b))
        # what isn't there in any other participant is a sum of zeros but for rounding
        return fits_of(left.withColumn("rep", F.col("slot").cast("int")), [*keys, "rep"], least_participants)
    drawn = with_draws(numbered.select(*keys, "slot", "m"), replicates, "timing").withColumn("slot", pick("u", "m"))
    times = drawn.groupBy(*keys, "slot", "rep").agg(F.count("*").alias("n"))
    per = times.groupBy(*keys, "slot").agg(F.map_from_entries(F.collect_list(F.struct("rep", "n"))).alias("n"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.coalesce(F.try_element_at("n", r), F.lit(0)).cast("int"))
    joined = numbered.join(per.select(*keys, "slot", weights.alias("w")), [*keys, "slot"])
    return fits_of(totals(joined, keys, weighted=True), [*keys, "rep"], least_participants)


def common_participants(trajectory: DataFrame, keys: list[str], direction: str = "TransitionType", ways: int = 2) -> DataFrame:
    """Trajectories of participants that have one in each of the ``ways`` directions, so that paired replicates draw the same ones."""
    both = trajectory.groupBy(*keys, "Subject").agg(F.countDistinct(direction).alias("ways")).filter(F.col("ways") == ways).select(*keys, "Subject")
    return trajectory.join(both, [*keys, "Subject"], "left_semi")


def pseudo_choices(matches: DataFrame, keys: list[str], draws: int) -> DataFrame:
    """``keys, rep, Subject, BoundaryID, CandidateID``: in every draw each real boundary takes one matched pseudo-boundary, and no block twice.

    Per draw, a subject's boundaries choose in an order and among candidates that hashes give; a boundary whose blocks are all taken has
    a null CandidateID, which ``scarcity`` counts. One subject's boundaries and candidates make a group.
    """
    options = matches.groupBy(*keys, "Subject").agg(F.collect_list(F.struct("MatchedRealBoundaryID", "CandidateID", "CandidateBlockID")).alias("options"))
    dealt = options.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    kinds = dict(matches.dtypes)

    def draw(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                by: dict[str, list] = {}
                for o in r.options:
                    by.setdefault(o["MatchedRealBoundaryID"], []).append((o["CandidateID"], o["CandidateBlockID"]))
                taken: set[str] = set()
                for boundary in sorted(by, key=lambda x: number("order", r.rep, x)):
                    free = [c for c in sorted(by[boundary]) if c[1] not in taken]
                    c = free[number("pick", r.rep, boundary) % len(free)] if free else (None, None)
                    taken.add(c[1])
                    out.append((*[getattr(r, k) for k in keys], r.rep, r.Subject, boundary, c[0]))
            yield pd.DataFrame(out, columns=[*keys, "rep", "Subject", "BoundaryID", "CandidateID"])

    drawn = dealt.mapInPandas(draw, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "rep int, Subject string, BoundaryID string, CandidateID string"]))
    return drawn


def scarcity(choices: DataFrame, keys: list[str]) -> DataFrame:
    """How many boundaries of each draw took a pseudo-boundary, how many found all blocks taken, and participants with one."""
    took = F.col("CandidateID").isNotNull()
    return choices.groupBy(*keys, "rep").agg(F.count_if(took).alias("SelectedMatches"), F.count_if(~took).alias("SkippedForScarcity"), F.countDistinct(F.when(took, F.col("Subject"))).alias("ParticipantsWithPseudoData"))


def pseudo_draws(pseudo: DataFrame, choices: DataFrame, keys: list[str], further: list[str]) -> DataFrame:
    """Null trajectories by ``keys, further, rep``. pseudo: ``CandidateID, WindowLength_sec, further, RelativeCenter_sec, Coordinate, value``."""
    drawn = choices.filter("CandidateID is not null").join(pseudo.drop("Subject"), ["CandidateID", "WindowLength_sec"])
    at = [*keys, *further, "rep", "Subject", "RelativeCenter_sec", "Coordinate"]
    return drawn.groupBy(*at).agg(F.avg("value").alias("value"))


def dual_status(real: DataFrame, null_a: DataFrame, null_na: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """p values of the real score against both nulls, the larger of the two, the nulls' thresholds (and the larger one), and a label."""
    out = real
    for name, null in (("A", null_a), ("NA", null_na)):
        n = null.select(*keys, F.col("Score").alias(f"null_{name}"))
        out = out.join(n, keys, "left").groupBy(*real.columns, *[c for c in out.columns if c not in real.columns]).agg(
            ((1 + F.count_if(F.col(f"null_{name}") >= F.col("Score"))) / (F.count(f"null_{name}") + 1)).alias(f"p_{name}"),
            quantile_higher(F.col(f"null_{name}"), 1 - alpha).alias(f"Threshold_{name}"),
        )
    low_a, low_na = F.col("p_A") < alpha, F.col("p_NA") < alpha
    status = F.when(low_a & low_na, "above_both").when(low_a, "above_A_only").when(low_na, "above_NA_only").otherwise("descriptive_only")
    return out.withColumn("p_dual", F.greatest("p_A", "p_NA")).withColumn("DualThreshold", F.greatest("Threshold_A", "Threshold_NA")).withColumn("Status", status)


def null_bands(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 95 % quantile of the null scores at each candidate time."""
    return profiles.groupBy(*keys, "CandidateTime_sec").agg(F.median("Score").alias("NullMedian"), quantile_higher(F.col("Score"), 0.95).alias("NullQ95"), F.count("*").alias("Draws"))


def paired_differences(fits: DataFrame, keys: list[str], direction: str = "TransitionType") -> DataFrame:
    """Difference of the two directions' times, replicate by replicate, and its interval; replicates draw the same participants in both."""
    wide = fits.groupBy(*keys, "SearchWindow", "rep").pivot(direction, ["A_to_NA", "NA_to_A"]).agg(F.first("CandidateTime_sec"))
    d = wide.withColumn("d", F.col("A_to_NA") - F.col("NA_to_A")).filter("d is not null")
    return d.groupBy(*keys, "SearchWindow").agg(
        F.median("d").alias("MedianDifference"), F.percentile("d", 0.025).alias("CI_Lower"), F.percentile("d", 0.975).alias("CI_Upper"), F.avg((F.col("d") > 0).cast("double")).alias("ShareLater"), F.count("*").alias("Replicates")
    )


def change_times(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, SearchWindow, Position, start``: the first, middle and last candidate time of each group's profile."""
    ordered = profiles.groupBy(*keys, "SearchWindow").agg(F.array_sort(F.collect_set("CandidateTime_sec")).alias("t"))
    places = [("early", F.lit(0)), ("middle", F.floor(F.size("t") / 2).cast("int")), ("late", F.size("t") - 1)]
    return ordered.select(*keys, "SearchWindow", F.explode(F.array(*[F.struct(F.lit(n).alias("Position"), F.get("t", k).alias("start")) for n, k in places])).alias("p")).select(*keys, "SearchWindow", "p.*")


def with_known_change(null: DataFrame, keys: list[str], starts: DataFrame, sizes: tuple[float, ...] = (0.5, 1.0, 1.5), shapes: tuple[str, ...] = ("abrupt", "ramp")) -> DataFrame:
    """Null trajectories (``keys, rep``) once per cell of ``starts(keys, SearchWindow, Position, start)``, size and shape, with a change added.

    A change is ``size`` standard deviations of the trajectory's values before the boundary (of all its values, else 1, where those don't vary); it comes at once at ``start``, or grows from there to the trajectory's end.
    """
    of = [*keys, "rep", "Coordinate"]
    spread = null.groupBy(*of).agg(F.stddev_samp(F.when(F.col("RelativeCenter_sec") < 0, F.col("value"))).alias("before"), F.stddev_samp("value").alias("every"), F.max("RelativeCenter_sec").alias("end"))
    usable = lambda c: F.coalesce(F.col(c) > 1e-8, F.lit(False))
    sd = F.when(usable("before"), F.col("before")).when(usable("every"), F.col("every")).otherwise(1.0)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), F.lit(float(z)).alias("size")) for k in shapes for z in sizes]))
    grid = starts.withColumn("cell", cells).select(*keys, "SearchWindow", "Position", "start", "cell.*")
    since = F.col("RelativeCenter_sec") - F.col("start")
    grow = F.when(F.col("shape") == "abrupt", (since >= 0).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), since / F.greatest(F.col("end") - F.col("start"), F.lit(1e-6)))))
    # a few dozen cells a group
    return null.join(spread.withColumn("sd", sd), of).join(F.broadcast(grid), keys).withColumn("value", F.col("value") + F.col("size") * F.col("sd") * grow).drop("sd", "before", "every", "end")


def timing_power(null: DataFrame, thresholds: DataFrame, profiles: DataFrame, keys: list[str], baseline: list[str], sizes: tuple[float, ...] = (0.5, 1.0, 1.5), near: float = 10.0) -> DataFrame:
    """By ``keys, baseline`` and cell: the share of null trajectories in which an added change reaches the threshold, and in which its time is found within ``near`` seconds.

    null: trajectories by ``keys, baseline, rep``; thresholds: ``keys, SearchWindow, DualThreshold``; profiles: those of the real trajectories, whose candidate times the changes take.
    """
    at = [*keys, *baseline]
    starts = null.select(*at).distinct().join(change_times(profiles, keys), keys)
    cell = [*at, "SearchWindow", "Position", "start", "shape", "size"]
    changed = with_known_change(null, at, starts, sizes).withColumnRenamed("SearchWindow", "Sought")
    own = ["Sought" if c == "SearchWindow" else c for c in cell]
    fits = group_fits(changed, [*own, "rep"]).filter("SearchWindow = Sought").drop("Sought").join(thresholds.select(*keys, "SearchWindow", "DualThreshold"), [*keys, "SearchWindow"])
    hit = (F.col("Score") >= F.col("DualThreshold")).cast("double")
    error = F.abs(F.col("CandidateTime_sec") - F.col("start"))
    return fits.groupBy(*cell).agg(F.avg(hit).alias("Power"), F.avg(hit * (error <= near).cast("double")).alias("LocatedPower"), F.median(error).alias("MedianError_sec"), F.count("*").alias("Series"))


def inject(values: np.ndarray, t: np.ndarray, at: float, size: float, shape: str, ramp: float = 30.0) -> np.ndarray:
    """Adds a change of ``size`` from time ``at`` on, at once or over ``ramp`` seconds."""
    grow = (t >= at).astype(float) if shape == "abrupt" else np.clip((t - at) / ramp, 0, 1)
    return values + size * grow
