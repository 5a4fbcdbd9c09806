"""Statistics of arrays as native higher-order expressions; null for arrays that are too short."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas would compute it again for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def squares(a: Column) -> Column:
    """Sum of squared differences from the mean."""
    return let(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))


def std(a: Column, ddof: int) -> Column:
    return F.when(F.size(a) > ddof, F.sqrt(squares(a) / F.nullif(F.size(a) - ddof, F.lit(0))))


def median(a: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)

    return let(F.array_sort(a), middle)


def mad(a: Column) -> Column:
    """Median distance from the median, unscaled."""
    return let(median(a), lambda m: median(F.transform(a, lambda x: F.abs(x - m))))


def differences(a: Column) -> Column:
    """Each value less the one before."""
    return F.when(F.size(a) >= 2, F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda x, y: x - y)).otherwise(
        F.array().cast("array<double>")
    )


def quantile_higher(values: Column, q: float) -> Column:
    """Aggregate: the sorted finite values' element at ceil(q (n - 1)), counted from 0."""
    kept = F.array_sort(F.collect_list(values))
    return F.get(kept, F.ceil(q * (F.count(values) - 1)).cast("int"))


def hampel_outliers(a: Column, reach: int = 5, sigmas: float = 3.0) -> Column:
    """For each value whether it lies over ``sigmas`` robust deviations off the median of its neighbourhood.

    Nulls are skipped and never outliers. A neighbourhood needs three values and a spread.
    """

    def judge(x: Column, i: Column) -> Column:
        start = F.greatest(i - reach, F.lit(0))
        near = F.filter(F.slice(a, start + 1, i + reach + 1 - start), lambda v: v.isNotNull())

        def off(near: Column) -> Column:
            def beyond(m: Column) -> Column:
                spread = median(F.transform(near, lambda v: F.abs(v - m)))
                return let(spread, lambda d: (F.size(near) >= 3) & (d > 0) & (F.abs(x - m) > sigmas * 1.4826 * d))

            return let(median(near), beyond)

        return F.coalesce(let(near, off), F.lit(False))

    return F.transform(a, judge)


def interpolate(a: Column) -> Column:
    """Nulls filled on the line between their neighbours, ends held; all null if nothing is known."""

    def fill(x: Column, i: Column) -> Column:
        known = lambda part: F.filter(part, lambda j: F.get(a, j).isNotNull())
        ends = F.struct(F.array_max(known(F.sequence(F.lit(0), i))).alias("p"), F.array_min(known(F.sequence(i, F.size(a) - 1))).alias("q"))

        def blend(e: Column) -> Column:
            left, right = F.get(a, e["p"]), F.get(a, e["q"])
            return F.coalesce(left + (right - left) * (i - e["p"]) / (e["q"] - e["p"]), left, right)

        return F.when(x.isNotNull(), x).otherwise(let(ends, blend))

    return F.when(F.size(a) > 0, F.transform(a, fill)).otherwise(a)


def thin(times: Column, gap: Column | float) -> Column:
    """Greedy thinning of ascending times: each kept one is at least ``gap`` after the last kept."""
    gap = F.lit(gap) if not isinstance(gap, Column) else gap
    start = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<double>").alias("kept"))

    def step(state: Column, t: Column) -> Column:
        return F.when(t < state["last"] + gap - 1e-6, state).otherwise(
            F.struct(t.alias("last"), F.concat(state["kept"], F.array(t)).alias("kept"))
        )

    return F.aggregate(times, start, step, lambda s: s["kept"])
