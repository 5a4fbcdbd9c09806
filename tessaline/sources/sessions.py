"""Readers of session recordings and of the tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.functions.scalars import natural_key, parse_bool, safe_numeric
from tessaline.sources.shared import settle

FILE_NAME = r"(?i)^(A\d+)_session(\d+)_(NA|A)$"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_file_name(stem: Column) -> dict[str, Column]:
    """Subject, session and condition of a file stem; odd sessions are expected to be A. Null where the name doesn't fit."""
    fits = stem.rlike(FILE_NAME)
    part = lambda i: F.when(fits, F.regexp_extract(stem, FILE_NAME, i))
    session, code = part(2).cast("int"), F.upper(part(3))
    expected = F.when(session % 2 == 1, "A").when(session % 2 == 0, "NA")
    return {
        "Subject": F.upper(part(1)),
        "Session": session,
        "ConditionCode": code,
        "Condition": F.when(code == "A", "Anxiety").when(code == "NA", "Non_Anxiety"),
        "ExpectedConditionCode": expected,
        "LabelMismatch": code != expected,
    }


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per CSV file below a folder in natural order of names, with what its name says and a status."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.[cC][sS][vV]$", 1)
    named = listed.withColumn("stem", stem).withColumns(parse_file_name(F.col("stem")))
    status = F.when(F.col("Subject").isNull(), "skipped_bad_filename").otherwise("pending")
    relative = F.regexp_replace("path", "^.*?" + folder.rstrip("/").replace("\\", "/") + "/", "")
    return named.withColumn("RelativePath", relative).withColumn("status", status).orderBy(natural_key(F.col("stem")))


def read_session_csvs(spark: SparkSession, folder: str, signal: str = "ECG_filtered", time: str = "Time_seconds", rate: float = 500.0, most_missing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(samples, files). Samples of every well-named file; gaps are filled on the line between neighbours, ends held.

    A file with over ``most_missing`` percent of its signal missing has the status failed and gives no samples.
    Where the time column isn't wholly finite, the sample's place over ``rate`` stands in.
    """
    files = session_files(spark, folder)
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    t = safe_numeric(time) if time in raw.columns else F.lit(None).cast("double")
    x = safe_numeric(signal) if signal in raw.columns else F.lit(None).cast("double")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), t.alias("t"), x.alias("x"))
    per = W.partitionBy("file")
    order = per.orderBy("block", "line")
    placed = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("missing", 100.0 * F.count_if(F.col("x").isNull()).over(per) / F.count("*").over(per)).withColumn("timed", F.count("t").over(per) == F.count("*").over(per))
    up, down = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("x").isNotNull(), F.col("i"))
    filled = (
        placed.withColumn("pv", F.last("x", True).over(up)).withColumn("pi", F.last(at, True).over(up)).withColumn("nv", F.first("x", True).over(down)).withColumn("ni", F.first(at, True).over(down))
        .withColumn("x", F.coalesce("x", F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("i") - F.col("pi")) / (F.col("ni") - F.col("pi")), "pv", "nv"))
        .withColumn("t", F.when(F.col("timed"), F.col("t")).otherwise(F.col("i") / rate))
    )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    quality = placed.groupBy(plain(F.col("file")).alias("p")).agg(F.max("missing").alias("missing"))
    judged = files.withColumn("p", plain(F.col("path"))).join(quality, "p", "left")
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("missing").isNull() | (F.col("missing") > most_missing), "failed").otherwise("processed")
    judged = judged.withColumn("status", status)
    samples = filled.withColumn("p", plain(F.col("file"))).join(judged.filter("status = 'processed'").select("p", "Subject", "Session", "ConditionCode"), "p").select("Subject", "Session", "ConditionCode", "i", "t", "x")
    return samples, judged.drop("p")


def coerce_master(raw: DataFrame, required: list[str], numbers: list[str], keys: list[str] = ("Session", "WindowLength_sec", "WindowIndex")) -> DataFrame:
    """Typed master rows from text: keys must be whole numbers (an error if not), measures become null where they aren't numbers.

    'NA' is a condition, not a missing value; an empty condition is read from the Condition text. Missing columns raise ValueError.
    """
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    code = F.upper(F.trim(F.col("ConditionCode")))
    repaired = F.when(F.coalesce(code, F.lit("")).isin("", "NAN", "NONE"), F.when(F.lower("Condition").contains("non"), "NA").otherwise("A")).otherwise(code)
    made = {c: safe_numeric(c) for c in numbers if c in raw.columns} | {c: F.col(c).cast("double").cast("int") for c in keys if c in raw.columns}
    made |= {"ConditionCode": repaired} | ({"WindowValid": parse_bool("WindowValid")} if "WindowValid" in raw.columns else {})
    return raw.withColumns(made)


def sampling_rate(samples: DataFrame) -> DataFrame:
    """1 / median positive step of time of each session."""
    step = F.col("t") - F.lag("t").over(W.partitionBy("Subject", "Session").orderBy("t"))
    return samples.withColumn("d", step).filter("d > 0").groupBy("Subject", "Session").agg((1 / F.median("d")).alias("rate"))


def lag_step(name: str) -> Column:
    return F.col(name) - F.lag(name).over(W.partitionBy("Subject", "Session").orderBy("t", "x"))


def running_sum(name: str) -> Column:
    return F.sum(name).over(W.partitionBy("Subject", "Session").orderBy("t", "x").rowsBetween(W.unboundedPreceding, W.currentRow))


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the place of each row in the order of ``keys``, 1 first.

    Rows are dealt into ranges of the keys, numbered within each, and moved by the counts of the ranges before; equal keys are in one range.
    """
    ranged = settle(rows.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range_").agg(F.count("*").alias("n"))
    # one row per range
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = ranged.withColumn("within", F.row_number().over(W.partitionBy("range_").orderBy(*keys)))
    return within.join(F.broadcast(before), "range_").withColumn("place", (F.col("before") + F.col("within")).cast("int")).drop("range_", "before", "within")


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Those of ``columns`` that a CSV with a header has, in that order; the others aren't parsed."""
    table = spark.read.option("header", True).csv(path)
    return table.select(*[c for c in columns if c in table.columns])


def read_parts(spark: SparkSession, folder: str, pattern: str, combined: str) -> DataFrame:
    """All Parquet parts of ``folder`` whose names fit ``pattern``, or the table ``combined`` where there is none."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
    if parts.isEmpty():
        return spark.read.parquet(combined)
    return spark.read.option("mergeSchema", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder)


def read_plain_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV in which nothing marks a missing value: 'NA' and empty fields stay texts. Columns of ``numbers`` become null where they are no number."""
    table = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path).na.fill("")
    return table.withColumns({c: safe_numeric(c) for c in numbers if c in table.columns})


def common_times(rows: DataFrame) -> DataFrame:
    keys = ["Subject", "Session", "ConditionCode", "WindowLength_sec"]
    return rows.select(*keys, F.bround("StartTime_sec", 6).alias("t0")).intersect(rows.select(*keys, F.bround("EndTime_sec", 6).alias("t0")))


def p_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers between 0 and 1 as stand-ins for p values."""
    return read(spark, sf_dir, "documents").select("doc_id", "source", ((F.col("n_chars") % 1000 + 1) / 1001.0).alias("p"))


def sign_flip_of_scores(results: DataFrame) -> DataFrame:
    from tessaline.operators.inference import real_pseudo_pairs, sign_flip

    keys = ["PseudoCondition", "WindowLength_sec", "SearchWindow", "Method"]
    pairs = real_pseudo_pairs(results, "A").withColumn("PseudoCondition", F.lit("A")).unionByName(real_pseudo_pairs(results, "NA").withColumn("PseudoCondition", F.lit("NA")))
    per = pairs.groupBy(*keys, "Subject").agg(F.avg(F.col("RealScore") - F.col("PseudoScore")).alias("d"))
    return sign_flip(per, keys, "d", 500)
