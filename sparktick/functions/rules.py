"""Direction rules as Column builders over a bar window: +1 long, -1 short, 0 no trade."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from sparktick.functions.columns import REL_TOL, ratio, tolerant_sign

P = "vwap"


@dataclass(frozen=True)
class Rule:
    name: str
    history: int  # bars needed before the signal bar
    direction: Callable[[WindowSpec], Column]


def momentum(window: int = 3) -> Rule:
    """Opposite sign of (mean of the `window` bars before) - current."""

    def direction(w: WindowSpec) -> Column:
        mean = F.avg(P).over(w.rowsBetween(-window, -1))
        sign = -tolerant_sign(mean - F.col(P), F.col(P))
        return F.when(F.col("bar_idx") < window, 0).otherwise(sign)

    return Rule("momentum", window, direction)


def alexanders_filter(n: int = 1) -> Rule:
    """Sign of the percentage change over n bars."""

    def direction(w: WindowSpec) -> Column:
        change = (ratio(F.col(P), F.lag(P, n).over(w)) - 1.0) * 100.0
        return F.when(F.col("bar_idx") < n, 0).otherwise(tolerant_sign(change, F.lit(100.0)))

    return Rule("alexanders_filter", n, direction)


def stochastic_oscillator(n: int = 3) -> Rule:
    """Position of the price in the n-bar range, above or below its middle; a flat range gives no trade."""

    def direction(w: WindowSpec) -> Column:
        span = w.rowsBetween(-(n - 1), 0)
        low, high = F.min(P).over(span), F.max(P).over(span)
        flat = high - low <= REL_TOL * F.abs(P)
        k = (F.col(P) - low) / F.nullif(high - low, F.lit(0.0)) * 100.0
        sign = tolerant_sign(k - 50.0, F.lit(100.0))
        return F.when((F.col("bar_idx") < n - 1) | flat, 0).otherwise(sign)

    return Rule("stochastic_oscillator", n - 1, direction)


RULES: dict[str, Callable[..., Rule]] = {
    "momentum": momentum,
    "alexanders_filter": alexanders_filter,
    "stochastic_oscillator": stochastic_oscillator,
}


def make_rule(name: str, **params: int) -> Rule:
    if name not in RULES:
        raise ValueError(f"unknown direction rule {name!r}")
    return RULES[name](**params)


def default_rules() -> list[Rule]:
    return [make_rule(name) for name in RULES]
