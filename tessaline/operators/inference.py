"""Participant-level summaries, cluster bootstrap and sign-flip permutation.

Replicates are rows, not loops: the subjects of a group are numbered, and each row is repeated once per replicate with a
hashed draw that picks or flips a subject. A group may have any number of subjects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.functions.resampling import pick, with_draws
from tessaline.functions.scalars import direction_label

RATE_KEYS = ["WindowLength_sec", "SearchWindow", "Method", "BoundaryKind", "TransitionType", "PseudoCondition"]
PAIR_KEYS = ["MatchedRealBoundaryID", "Subject", "TransitionType", "BoundaryOrder", "WindowLength_sec", "SearchWindow", "Method"]


def dedupe_for_rate(results: DataFrame, keys: list[str] = RATE_KEYS) -> DataFrame:
    """Real rows once per boundary; pseudo rows once per block of a group, lowest MatchScore first."""
    unit = F.when(F.col("BoundaryKind") == "Real", F.col("BoundaryID")).otherwise(F.col("CandidateBlockID"))
    order = W.partitionBy(*keys, unit).orderBy(F.col("MatchScore").asc_nulls_first(), "BoundaryID")
    return results.withColumn("turn", F.row_number().over(order)).filter("turn = 1").drop("turn")


def detection_rates(results: DataFrame, keys: list[str] = RATE_KEYS) -> DataFrame:
    """Rates, latencies and scores of each group; groups without a condition keep their null key. ``keys`` may have further ones."""
    return dedupe_for_rate(results, keys).groupBy(*keys).agg(
        F.countDistinct("Subject").alias("Participants"),
        F.count("*").alias("Boundaries"),
        F.sum(F.col("Detected").cast("long")).alias("Detections"),
        F.avg(F.col("Detected").cast("double")).alias("DetectionRate"),
        F.median("Latency_sec").alias("MedianLatency"),
        F.percentile("Latency_sec", 0.25).alias("Q1Latency"),
        F.percentile("Latency_sec", 0.75).alias("Q3Latency"),
        F.median("Score").alias("MedianScore"),
    )


def number_subjects(per_subject: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``slot`` (0, 1, ... by subject) and ``m`` (subjects of the group)."""
    group = W.partitionBy(*keys)
    return per_subject.withColumn("slot", F.row_number().over(group.orderBy("Subject")) - 1).withColumn("m", F.count("*").over(group))


def bootstrap_sums(per_subject: DataFrame, keys: list[str], sums: list[str], replicates: int, stream: str) -> DataFrame:
    """``keys, rep`` and the sums over as many subjects as the group has, drawn with replacement."""
    numbered = number_subjects(per_subject, keys)
    chosen = with_draws(numbered.select(*keys, "slot", "m"), replicates, stream).withColumn("slot", pick("u", "m")).drop("u", "m")
    join = [chosen[k].eqNullSafe(numbered[k]) for k in keys] + [chosen["slot"] == numbered["slot"]]
    # draws look as small as the rows before they were repeated, and would be broadcast
    return chosen.hint("merge").join(numbered.hint("merge"), join).groupBy(*[chosen[k] for k in keys], chosen["rep"]).agg(*[F.sum(c).alias(c) for c in sums])


def bootstrap_mean(rows: DataFrame, keys: list[str], value: str, replicates: int = 200, stream: str = "mean") -> DataFrame:
    """Mean of ``value`` and its 95 % cluster-bootstrap interval, from sums and counts per subject."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(*keys, "Subject").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    point = per.groupBy(*keys).agg((F.sum("s") / F.sum("c")).alias("Estimate"), F.count("*").alias("Participants"))
    boot = bootstrap_sums(per, keys, ["s", "c"], replicates, stream).withColumn("e", F.col("s") / F.col("c"))
    limits = boot.groupBy(*keys).agg(F.percentile("e", 0.025).alias("CI_Lower"), F.percentile("e", 0.975).alias("CI_Upper"))
    join = [point[k].eqNullSafe(limits[k]) for k in keys]
    return point.join(limits, join, "left").select(*[point[k] for k in keys], "Estimate", "Participants", "CI_Lower", "CI_Upper")


def detection_summary(results: DataFrame, replicates: int = 200) -> DataFrame:
    """Detection rates with bootstrap intervals."""
    rates = detection_rates(results)
    rows = dedupe_for_rate(results).withColumn("hit", F.col("Detected").cast("double"))
    ci = bootstrap_mean(rows, RATE_KEYS, "hit", replicates, stream="rate").select(*RATE_KEYS, "CI_Lower", "CI_Upper")
    join = [rates[k].eqNullSafe(ci[k]) for k in RATE_KEYS]
    return rates.join(ci, join, "left").select(*[rates[c] for c in rates.columns], "CI_Lower", "CI_Upper")


def real_pseudo_pairs(results: DataFrame, condition: str) -> DataFrame:
    """One row per real boundary with the means of its matched pseudo-boundaries of a condition."""
    means = lambda p: [F.avg(F.col("Detected").cast("double")).alias(f"{p}Detected"), F.avg("Score").alias(f"{p}Score"), F.avg("Latency_sec").alias(f"{p}Latency")]
    real = results.filter("BoundaryKind = 'Real'").groupBy(*PAIR_KEYS).agg(*means("Real"))
    pseudo = results.filter((F.col("BoundaryKind") == "Pseudo") & (F.col("PseudoCondition") == condition)).groupBy(*PAIR_KEYS).agg(*means("Pseudo"), F.countDistinct("CandidateBlockID").alias("PseudoControls"))
    return real.join(pseudo, PAIR_KEYS)


def _effects(real, pseudo, count):
    a, b, half = real / count, pseudo / count, 0.5 / count
    odds = lambda p: (p + half) / (1.0 - p + half)
    return {"RealRate": a, "PseudoRate": b, "RiskDifference": a - b, "RiskRatio": (a + half) / (b + half), "OddsRatio": odds(a) / odds(b)}


def paired_effects(pairs: DataFrame, keys: list[str], replicates: int = 200) -> DataFrame:
    """Risk difference, risk ratio and odds ratio with bootstrap intervals over subjects."""
    per = pairs.groupBy(*keys, "Subject").agg(F.sum("RealDetected").alias("rs"), F.sum("PseudoDetected").alias("ps"), F.count("*").cast("double").alias("c"))
    total = per.groupBy(*keys).agg(F.sum("rs").alias("rs"), F.sum("ps").alias("ps"), F.sum("c").alias("c"))
    point = total.select(*keys, *[v.alias(k) for k, v in _effects(F.col("rs"), F.col("ps"), F.col("c")).items()])
    boot = bootstrap_sums(per, keys, ["rs", "ps", "c"], replicates, "pairs")
    drawn = boot.select(*keys, *[v.alias(k) for k, v in _effects(F.col("rs"), F.col("ps"), F.col("c")).items()])
    ends = [f(k) for k in ("RiskDifference", "RiskRatio", "OddsRatio") for f in (lambda k: F.percentile(k, 0.025).alias(f"{k}_Lower"), lambda k: F.percentile(k, 0.975).alias(f"{k}_Upper"))]
    return point.join(drawn.groupBy(*keys).agg(*ends), keys)


def sign_flip(per_subject: DataFrame, keys: list[str], value: str, permutations: int = 500, stream: str = "flip") -> DataFrame:
    """Mean over subjects and its two-sided sign-flip p value (1 + extreme) / (P + 1)."""
    known = number_subjects(per_subject.filter(F.col(value).isNotNull()).select(*keys, "Subject", F.col(value).alias("v")), keys)
    observed = known.groupBy(*keys).agg(F.avg("v").alias("MeanDifference"), F.count("*").alias("Participants"))
    flipped = with_draws(known, permutations, stream).groupBy(*keys, "rep").agg(F.avg(F.when(F.col("u") % 2 == 1, F.col("v")).otherwise(-F.col("v"))).alias("perm"))
    judged = flipped.join(observed, keys).groupBy(*keys, "MeanDifference", "Participants").agg(
        ((1 + F.count_if(F.abs("perm") >= F.abs("MeanDifference") * (1 - 1e-9) - 1e-12)) / (permutations + 1)).alias("PermutationP")
    )
    return judged


def compare_real_pseudo(results: DataFrame, replicates: int = 200, permutations: int = 500) -> DataFrame:
    """Paired effects and sign-flip tests of detection, score and latency, for each pseudo condition."""
    keys = ["PseudoCondition", "WindowLength_sec", "SearchWindow", "Method"]
    pairs = real_pseudo_pairs(results, "A").withColumn("PseudoCondition", F.lit("A")).unionByName(real_pseudo_pairs(results, "NA").withColumn("PseudoCondition", F.lit("NA")))
    out = paired_effects(pairs, keys, replicates)
    for name in ("Detected", "Score", "Latency"):
        per = pairs.groupBy(*keys, "Subject").agg(F.avg(F.col(f"Real{name}") - F.col(f"Pseudo{name}")).alias("d"))
        test = sign_flip(per, keys, "d", permutations).select(*keys, F.col("MeanDifference").alias(f"{name}Difference"), F.col("PermutationP").alias(f"{name}_P"))
        out = out.join(test, keys, "left")
    return out


def direction_contrast(results: DataFrame, magnitude: DataFrame | None = None, permutations: int = 500, replicates: int = 200) -> DataFrame:
    """Per subject the mean of A_to_NA less that of NA_to_A, with its bootstrap interval and a sign-flip test.

    Outcomes are detection, score, latency where detected and, with ``magnitude(BoundaryID, WindowLength_sec, ...)``, the size of the change
    at the boundary by distance and by mean absolute change; the last two repeat for every method and search.
    """
    keys = ["WindowLength_sec", "SearchWindow", "Method"]
    real = results.filter("BoundaryKind = 'Real'").withColumn("hit", F.col("Detected").cast("double"))
    outcomes = ["hit", "Score", "Latency_sec"]
    if magnitude is not None:
        sizes = ["MahalanobisMagnitude", "MeanAbsChange"]
        real, outcomes = real.join(magnitude.select("BoundaryID", "WindowLength_sec", *sizes), ["BoundaryID", "WindowLength_sec"], "left"), outcomes + sizes
    ids = [*keys, "Subject", "TransitionType"]
    long = real.select(*ids, *[F.col(o).cast("double").alias(o) for o in outcomes]).unpivot(ids, outcomes, "Outcome", "value")
    wide = long.groupBy(*keys, "Outcome", "Subject").pivot("TransitionType", ["A_to_NA", "NA_to_A"]).agg(F.avg("value"))
    per = wide.withColumn("d", F.col("A_to_NA") - F.col("NA_to_A")).filter("d is not null")
    test = sign_flip(per, [*keys, "Outcome"], "d", permutations, stream="direction")
    ci = bootstrap_mean(per, [*keys, "Outcome"], "d", replicates, stream="contrast").select(*keys, "Outcome", "CI_Lower", "CI_Upper")
    return test.join(ci, [*keys, "Outcome"], "left")


def bootstrap_statistic(rows: DataFrame, keys: list[str], statistic: Column, replicates: int = 200, stream: str = "statistic") -> DataFrame:
    """Any aggregate of ``rows`` with its 95 % interval over subjects drawn with replacement: ``keys, Estimate, CI_Lower, CI_Upper``.

    A subject's rows are taken whole, as often as it is drawn. Rows are repeated once per draw, so sums and counts go by ``bootstrap_mean``.
    """
    point = rows.groupBy(*keys).agg(statistic.alias("Estimate"))
    numbered = number_subjects(rows.select(*keys, "Subject").distinct(), keys)
    drawn = with_draws(numbered.select(*keys, "slot", "m"), replicates, stream).withColumn("slot", pick("u", "m")).select(*keys, "rep", "slot")
    chosen = drawn.join(numbered.select(*keys, "slot", "Subject"), [*keys, "slot"]).drop("slot")
    boot = chosen.join(rows, [*keys, "Subject"]).groupBy(*keys, "rep").agg(statistic.alias("e"))
    return point.join(boot.groupBy(*keys).agg(F.percentile("e", 0.025).alias("CI_Lower"), F.percentile("e", 0.975).alias("CI_Upper")), keys, "left")


def feature_effects(observations: DataFrame, features: list[str]) -> DataFrame:
    """Median before and after each boundary for every feature, their difference and its direction."""
    ids = ["BoundaryID", "Subject", "TransitionType", "BoundaryOrder", "WindowLength_sec", "Side"]
    long = observations.select(*ids, *features).unpivot(ids, features, "Feature", "value")
    keys = ids[:-1] + ["Feature"]
    med = long.groupBy(*keys).agg(
        F.median(F.when(F.col("Side") == "pre", F.col("value"))).alias("PreMedian"), F.median(F.when(F.col("Side") == "post", F.col("value"))).alias("PostMedian")
    )
    change = F.col("PostMedian") - F.col("PreMedian")
    return med.withColumn("Change", change).withColumn("AbsChange", F.abs(change)).withColumn("Direction", direction_label(change))


def z_effects(long: DataFrame, ids: list[str]) -> DataFrame:
    """Change of the median normalised value at each boundary, by feature: ``ids, WindowLength_sec, Feature, ZChange, AbsZChange``."""
    side = lambda before: F.median(F.when((F.col("RelativeCenter_sec") < 0) == F.lit(before), F.col("z")))
    found = long.groupBy(*ids, "WindowLength_sec", "Feature").agg((side(False) - side(True)).alias("ZChange"))
    return found.withColumn("AbsZChange", F.abs("ZChange"))


def pseudo_effects(matches: DataFrame, effects: DataFrame) -> DataFrame:
    """Effects of matched pseudo-boundaries, once per block, condition, direction, feature and length: that of the best match."""
    keys = ["CandidateBlockID", "PseudoCondition", "TransitionType", "Feature", "WindowLength_sec"]
    order = W.partitionBy(*keys).orderBy("MatchScore", "MatchRank", "PseudoMatchID")
    joined = matches.join(effects, ["CandidateID", "WindowLength_sec"])
    return joined.withColumn("turn", F.row_number().over(order)).filter("turn = 1").select(*keys, "Subject", "CandidateID", "MatchedRealBoundaryID", "MatchScore", "ZChange")


def first_known(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per group the first value of each column that isn't null, in the given order of rows."""
    place = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def mode_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones, and its share of the known ones."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct(F.col("n"), (-F.col(value)).alias("v"))).alias("b"), F.sum("n").alias("all"))
    return best.select(*keys, (-F.col("b.v")).alias("Mode"), (F.col("b.n") / F.col("all")).alias("ModeProbability"))


def feature_effect_summary(effects: DataFrame) -> DataFrame:
    return effects.groupBy("WindowLength_sec", "TransitionType", "Feature").agg(
        F.count("*").alias("Boundaries"),
        F.avg("Change").alias("MeanChange"),
        F.median("Change").alias("MedianChange"),
        F.median("AbsChange").alias("MedianAbsChange"),
        (100.0 * F.avg((F.col("Direction") == "increase").cast("double"))).alias("IncreasePercent"),
        (100.0 * F.avg((F.col("Direction") == "decrease").cast("double"))).alias("DecreasePercent"),
    )


def boundary_order_summary(results: DataFrame) -> DataFrame:
    return results.filter("BoundaryKind = 'Real'").groupBy("WindowLength_sec", "SearchWindow", "Method", "BoundaryOrder").agg(
        F.count("*").alias("Boundaries"), F.avg(F.col("Detected").cast("double")).alias("DetectionRate"), F.median("Score").alias("MedianScore"), F.median("Latency_sec").alias("MedianLatency")
    )


def empirical_p_summary(p_values: DataFrame) -> DataFrame:
    return p_values.groupBy("WindowLength_sec", "SearchWindow", "Method", "TransitionType", "PseudoCondition").agg(
        F.count("*").alias("Boundaries"),
        F.median("EmpiricalPValue").alias("MedianP"),
        F.min("EmpiricalPValue").alias("MinP"),
        F.count_if(F.col("EmpiricalPValue") < 0.05).alias("P_below_05"),
        F.count_if(F.col("EmpiricalQValue_BH") < 0.05).alias("Q_below_05"),
        F.median("RealMinusPseudoMedian").alias("MedianDifference"),
    )


def method_specificity(rates: DataFrame) -> DataFrame:
    """Real rate less the larger of the two pseudo rates; dropped if one of the three is missing."""
    keys = ["WindowLength_sec", "SearchWindow", "Method", "TransitionType"]
    rate = lambda kind, c: F.max(F.when((F.col("BoundaryKind") == kind) & F.col("PseudoCondition").eqNullSafe(F.lit(c)), F.col("DetectionRate")))
    wide = rates.groupBy(*keys).agg(rate("Real", None).alias("RealRate"), rate("Pseudo", "A").alias("PseudoA"), rate("Pseudo", "NA").alias("PseudoNA"))
    return wide.filter("RealRate is not null and PseudoA is not null and PseudoNA is not null").withColumn("Specificity", F.col("RealRate") - F.greatest("PseudoA", "PseudoNA"))
