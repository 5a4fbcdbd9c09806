"""Exact order statistics of groups of any size: rows are numbered by value over ranges, so no group is an array or one task's sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.sources.shared import settle


def ranked(rows: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """``rows`` with ``place``: 0, 1, ... in order of ``value`` within ``keys``. Rows without a value go.

    Rows are dealt by ranges of (keys, value, ties) and numbered within each range; counts of the ranges before are added. ``ties`` spread equal values over ranges.
    """
    dealt = rows.filter(F.col(value).isNotNull()).repartitionByRange(*[F.col(c) for c in [*keys, value, *ties]]).withColumn("range", F.spark_partition_id())
    # ranges are sampled anew whenever they are made, so they are written down once
    dealt = settle(dealt, "ranges")
    own = [*keys, "range"]
    upto = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy(*own).agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0))).drop("rows")
    within = F.row_number().over(W.partitionBy(*own).orderBy(value, *ties)) - 1
    return dealt.withColumn("within", within).join(before, own).withColumn("place", F.col("within") + F.col("before")).drop("within", "before", "range")


def group_quantile(rows: DataFrame, keys: list[str], value: str, q: float, ties: list[str], name: str = "quantile") -> DataFrame:
    """``keys, name``: the value at place ceil(q (n - 1)) of each group, null values left out."""
    placed = settle(ranked(rows, keys, value, ties).select(*keys, value, "place"), "placed")
    n = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = n.select(*keys, F.ceil(q * (F.col("n") - 1)).alias("place"))
    return placed.join(wanted, [*keys, "place"]).select(*keys, F.col(value).alias(name))


def left_out_quantile(rows: DataFrame, keys: list[str], part: str, value: str, q: float, ties: list[str], holders: DataFrame, name: str = "Threshold") -> DataFrame:
    """``keys, part, name`` for every row of ``holders(keys, part)``: the quantile of the group's rows of all other parts; null if there are none.

    Of the rows of a part, the one at place g of its group and at place o of its part has g - o other rows before it. So the other rows' place k is the group's place k
    plus the number of own rows with g - o <= k. Each row is numbered twice; no part is paired with the others' rows.
    """
    placed = settle(ranked(rows.select(*keys, part, value, *ties), keys, value, ties).select(*keys, part, value, "place"), "placed")
    own = placed.withColumn("others", F.col("place") - F.row_number().over(W.partitionBy(*keys, part).orderBy("place")) + 1)
    n, m = placed.groupBy(*keys).agg(F.count("*").alias("n")), placed.groupBy(*keys, part).agg(F.count("*").alias("m"))
    rest = F.col("n") - F.coalesce("m", F.lit(0))
    wanted = holders.join(n, keys, "left").join(m, [*keys, part], "left").select(*keys, part, F.when(rest > 0, F.ceil(q * (rest - 1))).alias("k"))
    late = wanted.join(own.select(*keys, part, "others"), [*keys, part], "left").groupBy(*keys, part, "k").agg(F.count_if(F.col("others") <= F.col("k")).alias("c"))
    at = late.withColumn("place", F.col("k") + F.col("c")).select(*keys, part, "place")
    return at.join(placed.select(*keys, "place", F.col(value).alias(name)), [*keys, "place"], "left").select(*keys, part, name)
