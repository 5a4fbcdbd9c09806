"""Window statistics over a stream of samples: the batch windows' counts, means and spread, with a watermark for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_windows(events: DataFrame, length: str = "10 minutes", step: str = "5 minutes", late: str = "30 minutes", time: str = "ts", value: str = "value", key: str = "user_id") -> DataFrame:
    """One row per key and sliding window; rows later than ``late`` are left out. Works on a batch as well."""
    rr = 600 + 4 * F.col(value)
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, length, step), key)
        .agg(F.count("*").alias("n"), F.avg(value).alias("ECG_Mean"), F.stddev_pop(value).alias("ECG_STD"), F.avg(60000 / rr).alias("MeanHR"), F.avg(rr).alias("MeanRR"), F.stddev_samp(rr).alias("SDNN"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "ECG_Mean", "ECG_STD", "MeanHR", "MeanRR", "SDNN")
    )
