"""Mark functions g_k(m), mean 1 per event type on the fit window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("unmarked", "linear_normalized", "saturating")


def raw_mark(name: str, mark: Column, scale: Column) -> Column:
    """Mark before the final normalisation."""
    if name == "unmarked":
        return F.lit(1.0)
    if name == "linear_normalized":
        return mark / scale
    if name == "saturating":
        return 1.0 - F.exp(-mark / scale)
    raise ValueError(f"unknown mark function {name!r}")


def by_type(k: Column, up: Column, down: Column) -> Column:
    return F.when(k == 0, up).when(k == 1, down)


def mark_weight(name: str, mark: Column, k: Column) -> Column:
    """g_k(mark) from the theta columns mark_scale_* and mark_norm_*."""
    scale = by_type(k, F.col("mark_scale_u"), F.col("mark_scale_d"))
    norm = by_type(k, F.col("mark_norm_u"), F.col("mark_norm_d"))
    return raw_mark(name, mark, scale) / norm
