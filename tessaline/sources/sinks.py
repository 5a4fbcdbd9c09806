"""Writers of the study's tables and of its manifest."""

from __future__ import annotations

import json
import platform
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per configuration; a rerun replaces only the configurations it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_part(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False, compression: str | None = None) -> None:
    """CSV with a header, in order if asked for; ``single`` gives one file and is for tables of bounded size."""
    ordered = df.orderBy(*order) if order else df
    writer = (ordered.coalesce(1) if single else ordered).write.mode("overwrite").option("header", True)
    (writer.option("compression", compression) if compression else writer).csv(path)


def ordered_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Known columns in front in their order, all others behind."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file below a path, computed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(settings: dict, tables: dict[str, DataFrame]) -> str:
    """JSON of settings, versions and row counts."""
    versions = {p: metadata.version(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}
    return json.dumps({"settings": settings, "python": platform.python_version(), "versions": versions, "rows": {k: v.count() for k, v in tables.items()}}, indent=2, sort_keys=True, default=str)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one of that schema if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # Spark's class for a missing path lies behind its JVM error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
