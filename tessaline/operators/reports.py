"""Tables behind figures and papers, from results that are already small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.operators.calibration import with_bh, with_holm


def primary(rates: DataFrame, method: str = "CovIC_crossfit", search: str = "post_only", corrected: float = 20.0, space: str = "reduced") -> DataFrame:
    """The slice that is reported first. Tables of one configuration have no columns of it."""
    slice_ = (F.col("Method") == method) & (F.col("SearchWindow") == search)
    if "RRThreshold" in rates.columns:
        slice_ = slice_ & (F.col("RRThreshold") == corrected) & (F.col("Representation") == space)
    return rates.filter(slice_)


def rates_by_window(rates: DataFrame) -> DataFrame:
    return primary(rates).select("WindowLength_sec", "BoundaryKind", "TransitionType", "PseudoCondition", "DetectionRate")


def method_comparison(rates: DataFrame) -> DataFrame:
    return rates.filter("BoundaryKind = 'Real'").groupBy("Method", "SearchWindow").agg(F.avg("DetectionRate").alias("MeanRate"), F.max("DetectionRate").alias("MaxRate"))


def top_features(summary: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` features with the largest median absolute change of each window length, and both directions beside each other."""
    best = summary.groupBy("WindowLength_sec", "Feature").agg(
        F.max("MedianAbsChange").alias("Largest"),
        F.max(F.when(F.col("TransitionType") == "A_to_NA", F.col("MedianChange"))).alias("A_to_NA"),
        F.max(F.when(F.col("TransitionType") == "NA_to_A", F.col("MedianChange"))).alias("NA_to_A"),
    )
    order = W.partitionBy("WindowLength_sec").orderBy(F.col("Largest").desc(), "Feature")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def p_histogram(p_values: DataFrame, bins: int = 10) -> DataFrame:
    bin_ = F.least(F.floor(F.col("EmpiricalPValue") * bins), F.lit(bins - 1)).cast("int")
    return p_values.filter("EmpiricalPValue is not null").groupBy("Method", "PseudoCondition", bin_.alias("bin")).agg(F.count("*").alias("n"))


def study_inventory(master: DataFrame, inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    one = lambda df, item, value: df.agg(value.cast("long").alias("value")).select(F.lit(item).alias("item"), "value")
    parts = [
        one(master, "participants", F.countDistinct("Subject")),
        one(master, "sessions", F.countDistinct("Subject", "Session")),
        one(master, "windows", F.count("*")),
        one(inventory, "boundaries", F.count("*")),
        one(candidates, "pseudo_blocks", F.countDistinct("CandidateBlockID")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_retention(quality: DataFrame, eligibility: DataFrame) -> DataFrame:
    passed = quality.groupBy("WindowLength_sec", "RRThreshold").agg(F.sum("windows").alias("windows"), F.sum("passed").alias("passed"))
    able = eligibility.groupBy("WindowLength_sec").agg(F.count("*").alias("boundaries"), F.sum(F.col("Eligible").cast("long")).alias("eligible"))
    return passed.join(able, "WindowLength_sec", "left").withColumn("retained_percent", 100.0 * F.col("passed") / F.col("windows"))


def holm_over_windows(tests: DataFrame, p: str, family: list[str]) -> DataFrame:
    return with_holm(tests, p, family, "P_Holm")


def quality_sensitivity(rates: DataFrame) -> DataFrame:
    """Mean real detection rate by limit of corrected intervals and window length, of rates over several configurations."""
    return rates.filter("BoundaryKind = 'Real'").groupBy("RRThreshold", "Representation", "WindowLength_sec").agg(F.avg("DetectionRate").alias("MeanRate"), F.sum("Boundaries").alias("Boundaries"))


def magnitude_points(magnitude: DataFrame) -> DataFrame:
    """One point per participant, direction and length: means over its boundaries."""
    return magnitude.groupBy("WindowLength_sec", "TransitionType", "Subject").agg(F.avg("MahalanobisMagnitude").alias("MeanMagnitude"), F.avg("MeanAbsChange").alias("MeanAbsChange"), F.count("*").alias("Boundaries"))


def dual_timing_tests(timing: DataFrame) -> DataFrame:
    """Timing tests after the boundary by their larger p value, adjusted over all lengths, directions and spaces together."""
    after = timing.filter("SearchWindow = 'post_only'")
    return with_holm(after.withColumn("family", F.lit("timing")), "p_dual", ["family"], "P_Holm").drop("family").withColumn("Supported", F.coalesce(F.col("P_Holm") < 0.05, F.lit(False)))


def in_method_order(table: DataFrame, methods: list[str]) -> DataFrame:
    """``table`` with ``MethodPlace``: the method's place in a list, 0 first; methods outside come after all others, by name."""
    order = F.array(*[F.lit(m) for m in methods])
    place = F.array_position(order, F.regexp_replace("Method", "_(crossfit|fixed6)$", ""))
    return table.withColumn("MethodPlace", F.when(place > 0, place - 1).otherwise(len(methods)).cast("int"))


def feature_directions(fits: DataFrame, limit: float = 0.05) -> DataFrame:
    """The direction term of every feature's regression, with q values over all features and lengths together."""
    own = fits.filter("Term = 'A_to_NA'").withColumn("family", F.lit("features"))
    return with_bh(own, "P", ["family"], "Q_Global").drop("family").withColumn("Supported", F.coalesce(F.col("Q_Global") < limit, F.lit(False)))


def legacy_false_positives(rates: DataFrame) -> DataFrame:
    """Rates of the score with the fixed threshold on pseudo-boundaries."""
    return rates.filter("BoundaryKind = 'Pseudo' and Method = 'LegacyBIC_fixed6'").select("WindowLength_sec", "SearchWindow", "TransitionType", "PseudoCondition", "Boundaries", F.col("DetectionRate").alias("FalsePositiveRate"))


def text_summary(rates: DataFrame) -> DataFrame:
    """One sentence per row of the primary slice, in order."""
    named = primary(rates).withColumn("Condition", F.coalesce("PseudoCondition", F.lit("-")))
    line = F.format_string("%d s, %s, %s (%s): %d of %d detected (%.1f %%)", "WindowLength_sec", "TransitionType", "BoundaryKind", "Condition", "Detections", "Boundaries", F.round(100.0 * F.col("DetectionRate"), 1))
    return named.select("WindowLength_sec", "TransitionType", "BoundaryKind", "Condition", line.alias("Line"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, rows, columns and a digest of each table: which files a report was made from, and whether they are the same again."""
    parts = []
    for name, df in sorted(tables.items()):
        flat = F.xxhash64(*[F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        # a sum, so that a row that stands twice counts twice
        digest = F.coalesce(F.sum(flat.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")
        parts.append(df.agg(F.count("*").alias("rows"), digest).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"), "digest"))
    return reduce(DataFrame.unionByName, parts)


def paper_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Writes each named table as one CSV folder with a header; tables are small by then."""
    for name, df in tables.items():
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    return sorted(tables)
