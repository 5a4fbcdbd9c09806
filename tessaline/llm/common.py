"""Helpers shared by the corpus operators: shared-folder tables and fixed hashes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.sources.shared import Scratch, settle, shared_dir

__all__ = ["Scratch", "ascii_lower", "fitted", "join_by_key", "settle", "shared_dir", "small", "table", "with_row_key"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays.

    ``lower`` changes other letters as well. Kelvin's sign is the one character
    outside ASCII whose lower case is a single ASCII letter, so it is set aside; no
    other change can join, split or create ASCII words.
    """
    kelvin, aside = F.lit("\u212a"), F.lit("\ue000")
    return F.lower(F.replace(text, kelvin, aside))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, *columns: str, most: int = 300_000) -> DataFrame:
    """A settled table of a few fixed-width columns, or these of its columns, marked for broadcast if it has at most ``most`` rows."""
    few = df.count() <= most
    df = df.select(*columns) if columns else df
    return F.broadcast(df) if few else df


def fitted(df: DataFrame, rows: int, rows_per_task: int = 50_000) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than they need, 8 at least; a table of many rows stays as it is dealt."""
    return df.coalesce(max(8, -(-rows // rows_per_task)))


def join_by_key(rows: DataFrame, values: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row per ``key`` and in ``n`` the number of rows that hold it.

    A key that holds a thousandth of all rows or more may make one task as large. There are ``most`` such keys at most,
    so their values are broadcast; all others are joined by a shuffle. Both tables are settled ones; this ``n`` goes.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(values.filter(F.col("n") * most >= total).drop("n"))
    others = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(small(values.drop("n")), key))


def with_row_key(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """``columns`` of ``docs`` and ``row``: a key of each row that is never null and never repeats, in order of the id, null ids last.

    It holds the id and the row's place in its file, so equal rows differ as well and every run gives the same keys. A
    table that is no file, and so has no places, is first written to the shared folder. Ids may be numbers or text.
    """
    place = F.struct(
        F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(id_col), F.lit(0).cast(dict(docs.dtypes)[id_col])).alias("id"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )
    try:
        return docs.select(*columns, place.alias("row"))
    except AnalysisException:
        return settle(docs.select(*columns), "rows").select(*columns, place.alias("row"))
