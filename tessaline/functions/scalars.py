"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaline.config import LOG1P


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """Null for NaN and the infinities."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_numeric(x: Column | str) -> Column:
    """Number of a text or null; NaN and the infinities are null."""
    return finite(col(x).try_cast("double"))


def parse_bool(x: Column | str) -> Column:
    """True for 'true' and '1' in any case and with blanks around; false for all else."""
    return F.coalesce(F.lower(F.trim(col(x).cast("string"))).isin("true", "1"), F.lit(False))


def log_feature(name: str, x: Column | str) -> Column:
    """log(1 + x) for the features on a logarithmic scale, null for negative ones; others as they are."""
    x = col(x)
    return F.when(x >= 0, F.log1p(x)) if name in LOG1P else x


def z_score(x: Column | str, centre: Column | str, scale: Column | str) -> Column:
    return (col(x) - col(centre)) / F.nullif(col(scale), F.lit(0.0))


def half_even(x: Column | str, digits: int = 6) -> Column:
    return F.bround(col(x), digits)


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(high)), F.lit(low))


def effective_size(n: Column | str, rho: Column | str) -> Column:
    """n (1 - r) / (1 + r), within 2 and n; r is first brought within 0 and 0.98."""
    n, r = col(n).cast("double"), clip(rho, 0.0, 0.98)
    return F.greatest(F.lit(2.0), F.least(n, n * (1 - r) / (1 + r)))


def hash64(text: Column, seed: int = 42) -> Column:
    """The first 16 hex digits of sha256('seed|text') as a decimal number; equal in any engine."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), text), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def hash_mod(text: Column, n: int | Column, seed: int = 42) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return (hash64(text, seed) % n.cast("decimal(20,0)")).cast("int")


def weak_hash(text: Column) -> Column:
    """Sum of place times character code, places from 1."""
    chars = F.transform(F.split(text, ""), lambda c, i: (i + 1) * F.ascii(c))
    return F.aggregate(chars, F.lit(0), lambda s, x: s + x)


def number_text(x: Column) -> Column:
    """Shortest text of a number: no decimal point where it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def mean_interval(estimate: Column, error: Column, z: float) -> tuple[Column, Column]:
    return estimate - z * error, estimate + z * error


def bic(sse: Column, n: Column, k: Column) -> Column:
    """n log(sse / n) + k log(n), with sse held above the smallest normal number."""
    n = F.greatest(n.cast("double"), F.lit(1.0))
    return n * F.log(F.greatest(sse, F.lit(2.2250738585072014e-308)) / n) + k * F.log(n)


def direction_label(change: Column) -> Column:
    return F.when(change.isNull(), "undefined").when(change > 0, "increase").when(change < 0, "decrease").otherwise("no_change")


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers (of up to 12 digits) and letters without case."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def close_to(a: Column, b: Column) -> Column:
    """Equality within a relative 1e-5 and an absolute 1e-8."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def calibrated_name(method: Column) -> Column:
    return F.when(method == "LegacyBIC_fixed6", "LegacyBIC_crossfit").otherwise(F.concat(method, F.lit("_crossfit")))


def correlation(a: str, b: str) -> Column:
    """Aggregate: correlation of two columns without nulls; null where one of them doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
