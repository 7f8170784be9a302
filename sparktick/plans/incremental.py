"""Runs that reuse what earlier runs stored: bars, theta and results are computed for missing keys only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktick.operators.bars import differences, vwap_bars
from sparktick.operators.excitation import FIT, fit_events, theta_json
from sparktick.operators.fit import BETA_GRID, RHO_MOST, fit_theta
from sparktick.plans.backtest import Experiment, fit_days_needed
from sparktick.session import materialise
from sparktick.sources.keyed import KeyedStore


def fit_settings(
    quantile: float | None = 0.9, marks: str = "linear_normalized", axis: str = "bar_index", restarts: int = 5, max_iter: int = 500, **more,
) -> dict:
    """What a stored theta depends on besides its key: a change of any of it makes another settings id."""
    return {
        "quantile": quantile, "marks": marks, "axis": axis, "restarts": restarts, "max_iter": max_iter, "beta_grid": BETA_GRID,
        "rho_most": RHO_MOST, **more,
    }


def ensure_bars(store: KeyedStore, trades: DataFrame, num: int, days: DataFrame) -> int:
    """Bars with differences of the given (symbol, day), computed where the store has none; how many days were computed.

    A day without trades is finished without rows. Only trades of missing days are read and aggregated.
    """
    def compute(open_keys: DataFrame) -> Mapping[str, DataFrame]:
        some = trades.join(open_keys.select("symbol", "day"), ["symbol", "day"], "left_semi")
        return {"bars": differences(vwap_bars(some, num))}

    return store.ensure(days.select("symbol", F.lit(num).cast("long").alias("num"), "day"), compute)


def windows_of(keys: DataFrame) -> DataFrame:
    """(w_h, day, fit_day) of given theta keys: the w_h days before each day."""
    before = F.sequence(F.expr("date_sub(day, w_h)"), F.date_sub("day", 1))
    return keys.select("w_h", "day").distinct().select("w_h", "day", F.explode(before).alias("fit_day"))


def theta_keys(jobs: DataFrame, folds: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every (symbol, num, w_h, day) whose theta the jobs' folds use; `symbols(symbol, num)`."""
    return fit_days_needed(jobs, folds).crossJoin(symbols.select("symbol", "num").distinct()).select(*FIT)


def full_fit(restarts: int = 5, max_iter: int = 500) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda fit_set, head: fit_theta(fit_set, head, restarts, max_iter)


def ensure_theta(
    store: KeyedStore, diffs: DataFrame, wanted: DataFrame, quantile: float | None = 0.9, marks: str = "linear_normalized", axis: str = "bar_index",
    fit: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> int:
    """Theta of the wanted keys, fitted where the store has none; how many keys were fitted.

    `fit(fit_set, head)` returns a theta table; the default is the full fit. Keys without a kind of event, and keys the fit gives
    no parameters, are finished all the same, so they are not tried again. Only bars of the missing keys' fit days are read.
    """
    fit = fit or full_fit()

    def compute(open_keys: DataFrame) -> Mapping[str, DataFrame]:
        windows = materialise(windows_of(open_keys), "fit-windows")
        rows = diffs.join(windows.select(F.col("fit_day").alias("day")).distinct(), "day", "left_semi")
        fit_set, head = fit_events(rows, windows, quantile, marks, axis, strict=False)
        ours = lambda df: materialise(df.join(open_keys, FIT, "left_semi"), "fit-open")
        theta = fit(ours(fit_set), ours(head))
        return {"theta": theta.join(theta_json(theta, marks, axis), FIT)}

    return store.ensure(wanted, compute)


RESULTS = ("signals", "trades", "daily", "spike_metrics", "input_stats", "health", "performance")


def result_tables(x: Experiment, input_stats: DataFrame, name: str) -> dict[str, DataFrame]:
    """All results of an experiment, keyed by experiment and job; `input_stats` has a job column."""
    tables = {
        "signals": x.test, "trades": x.trades(), "daily": x.daily(), "spike_metrics": x.spike_days(), "input_stats": input_stats,
        "health": x.health(), "performance": x.strategy_rows(),
    }
    return {table: rows.withColumn("experiment", F.lit(name)) for table, rows in tables.items()}


def commit_results(store: KeyedStore, x: Experiment, input_stats: DataFrame, name: str) -> str:
    """Write all result tables of an experiment's jobs in one commit: readers see all of them or none."""
    return store.commit(result_tables(x, input_stats, name), x.jobs.select(F.lit(name).alias("experiment"), "job"))
