"""Exponential excitation kernel and the closed-form spectral radius of a 2x2 branching matrix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kernel(alpha: Column, beta: Column, lag: Column) -> Column:
    return F.when(lag >= 0, alpha * F.exp(-beta * lag)).otherwise(0.0)


def kernel_integral(alpha: Column, beta: Column, span: Column) -> Column:
    return alpha / beta * (1.0 - F.exp(-beta * F.greatest(span, F.lit(0.0))))


def spectral_radius(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    return 0.5 * (a11 + a22 + F.sqrt((a11 - a22) * (a11 - a22) + 4.0 * a12 * a21))


def spectral_radius_gradient(a11: Column, a12: Column, a21: Column, a22: Column) -> dict[str, Column]:
    """d(radius)/d(a_mk); NULL where the two eigenvalues coincide."""
    root = F.nullif(F.sqrt((a11 - a22) * (a11 - a22) + 4.0 * a12 * a21), F.lit(0.0))
    tilt = (a11 - a22) / root
    return {"g11": 0.5 * (1.0 + tilt), "g12": a21 / root, "g21": a12 / root, "g22": 0.5 * (1.0 - tilt)}
