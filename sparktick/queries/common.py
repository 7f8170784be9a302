"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktick.operators import bars as B
from sparktick.operators import excitation as H
from sparktick.operators import fit as FT
from sparktick.operators.quality import days_of
from sparktick.plans.backtest import walk_forward
from sparktick.queries import sql as S
from sparktick.session import materialise
from sparktick.sources.tables import event_trades


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return event_trades(spark, sf)


def typed_trades(spark: SparkSession, sf: str) -> DataFrame:
    """One symbol per event type."""
    return event_trades(spark, sf, F.col("event_type"))


def bars(spark: SparkSession, sf: str, **options) -> DataFrame:
    return B.vwap_bars(trades(spark, sf), S.NUM, **options)


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    return B.differences(bars(spark, sf))


def bar_table(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with differences as a written table: the shared input of deep plans (the bar store's role)."""
    return materialise(diffs(spark, sf), "bars")


def test_days(spark: SparkSession, sf: str) -> DataFrame:
    """Every day behind the first HISTORY days of the trades."""
    return days_of(trades(spark, sf), S.HISTORY)


def folds(spark: SparkSession, sf: str, *windows: int) -> DataFrame:
    return walk_forward(test_days(spark, sf), windows)


def theta_days(spark: SparkSession, sf: str) -> DataFrame:
    """Every day with a day before it."""
    return days_of(trades(spark, sf), 1)


def theta(
    spark: SparkSession, d: DataFrame, spans=(1,), quantile: float = S.QUANTILE, steps: int = S.EM_STEPS, day: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fit set, and theta of every day (or of `day` alone) after a few EM steps over its fit window; days whose window lacks a kind of
    event have none.

    The full fit (`operators.fit.fit_theta`) cannot be written in SQL; a few steps from fixed starting values can.
    """
    days = days_of(d, 1)
    if day is not None:
        days = days.filter(F.col("day") == F.to_date(F.lit(day)))
    fit_set, head = H.fit_events(d, H.fit_windows(days, spans), quantile, strict=False)
    start = H.given_theta(head, S.ALPHA, S.BETA)
    if not steps:
        return fit_set, materialise(start, "theta")
    fit_set = materialise(fit_set, "fit-set")
    return fit_set, materialise(FT.few_steps(fit_set, start, steps), "theta")


def intensities(spark: SparkSession, d: DataFrame, spans=(1,), day: str | None = None) -> DataFrame:
    """Intensities of every day with theta (or of `day` alone), as a written table. `d` should be a written table, too."""
    return materialise(H.intensities(d, theta(spark, d, spans, day=day)[1]), "intensities")
