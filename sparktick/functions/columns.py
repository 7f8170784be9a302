"""Small scalar expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: differences below this share of the reference value count as exactly zero.
REL_TOL = 1e-12
NS_PER_DAY = 86_400_000_000_000
NS_PER_HOUR = 3_600_000_000_000


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def zero_small(diff: Column, ref: Column) -> Column:
    """`diff`, or 0 where it is at rounding-noise level relative to `ref`."""
    return F.when(F.abs(diff) <= REL_TOL * F.abs(ref), 0.0).otherwise(diff)


def tolerant_sign(x: Column, scale: Column) -> Column:
    return F.signum(zero_small(x, scale)).cast("tinyint")


def idiv(x: Column, n: int) -> Column:
    """Exact integer division (`/` would go through doubles, which cannot hold ns timestamps)."""
    return F.call_function("div", x.cast("long"), F.lit(n).cast("long"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is 0 or missing."""
    return num / F.nullif(den, F.lit(0))


def share(condition: Column) -> Column:
    """Aggregate: share of rows (with a known condition) where it holds."""
    return F.avg(condition.cast("double"))


def day_start_ns(day: Column) -> Column:
    return F.unix_date(day).cast("long") * F.lit(NS_PER_DAY)


def to_ns(t: Column) -> Column:
    """Timestamp in ns from a ms / us / ns integer, told apart by magnitude."""
    t = t.cast("long")
    return (
        F.when(t < 100_000_000_000_000, t * 1_000_000)
        .when(t < 100_000_000_000_000_000, t * 1_000)
        .otherwise(t)
    )
