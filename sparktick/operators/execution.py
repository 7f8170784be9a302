"""Entry, exit and per-bar return surfaces of direction rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktick.functions.columns import ratio
from sparktick.functions.rules import Rule
from sparktick.operators.spread import first_at_or_after, over_bars
from sparktick.schemas import BAR, BAR_DAY


def directions(bars: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per (bar, rule) with the rule's direction."""
    wide = _with_directions(bars, rules)
    return wide.select(*BAR, F.explode("_rules").alias("_r")).select(
        *BAR, F.col("_r.rule").alias("rule"), F.col("_r.direction").alias("direction")
    )


def _rule_array(w, rules: Sequence[Rule]):
    return F.array(*[
        F.struct(F.lit(r.name).alias("rule"), r.direction(w).cast("tinyint").alias("direction")) for r in rules
    ])


def _with_directions(bars: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    back = max(r.history for r in rules)
    return over_bars(bars, BAR_DAY, back, 0, lambda w: {"_rules": _rule_array(w, rules)})


def _last_bars(bars: DataFrame) -> DataFrame:
    """Last bar and its price per day: one small row per day."""
    return bars.groupBy(*BAR_DAY).agg(F.max("bar_idx").alias("_last"), F.max_by("vwap", "bar_idx").alias("_close"))


def entries(bars: DataFrame, latencies_ms: Sequence[float], delay: int = 1) -> DataFrame:
    """Entry bar per (bar, latency): t + delay, or with a latency the first bar from there on whose first trade
    is at least that long after the signal bar's last trade. NULL if the day ends first."""
    n = bars.groupBy(*BAR_DAY).agg(F.max("bar_idx").alias("_last"))
    at = F.col("bar_idx") + delay
    out = None
    instant = [float(x) for x in latencies_ms if x == 0]
    delayed = [float(x) for x in latencies_ms if x > 0]
    if instant:
        out = bars.select(*BAR, F.lit(0.0).alias("latency_ms"), at.alias("_entry"))
    if delayed:
        waits = F.explode(F.array(*[
            F.struct(F.lit(x).alias("latency_ms"), F.lit(int(round(x * 1e6))).cast("long").alias("wait")) for x in delayed
        ]))
        targets = bars.select(*BAR, "ts_end_ns", waits.alias("_w")).select(
            *BAR, F.col("_w.latency_ms").alias("latency_ms"), (F.col("ts_end_ns") + F.col("_w.wait")).alias("_target")
        )
        found = first_at_or_after(bars, targets, BAR_DAY, "ts_start_ns", "bar_idx", "_target", "_found")
        late = found.select(*BAR, "latency_ms", F.when(F.col("_found").isNotNull(), F.greatest(at, "_found")).alias("_entry"))
        out = late if out is None else out.unionByName(late)
    return out.join(n, BAR_DAY).select(
        *BAR, "latency_ms", F.when(F.col("_entry") <= F.col("_last"), F.col("_entry")).alias("entry_bar")
    )


def return_surface(
    bars: DataFrame, rules: Sequence[Rule], latencies_ms: Sequence[float] = (0.0,), delay: int = 1, holding: int = 3,
    fee_rate: float = 0.0,
) -> DataFrame:
    """Trade of every (bar, rule, latency) that has a direction and an entry bar.

    Exit is `holding` bars after entry or at the day's last bar; net = direction * (exit / entry - 1) - 2 * fee.
    Any signal set is then an equi join on the bar.
    """
    back = max(r.history for r in rules)

    def columns(w):
        out = {"_rules": _rule_array(w, rules), "_out": F.lead("vwap", holding).over(w)}
        return out | {"_in0": F.lead("vwap", delay).over(w), "_out0": F.lead("vwap", delay + holding).over(w)}

    wide = over_bars(bars, BAR_DAY, back, delay + holding, columns).join(_last_bars(bars), BAR_DAY)
    wide = wide.withColumns({"_out": F.coalesce("_out", "_close"), "_out0": F.coalesce("_out0", "_close")})
    parts = []
    if any(x == 0 for x in latencies_ms):
        parts.append(wide.filter("_in0 is not null").select(
            *BAR, "_rules", "_last", F.lit(0.0).alias("latency_ms"), (F.col("bar_idx") + delay).alias("entry_bar"),
            F.col("_in0").alias("entry_price"), F.col("_out0").alias("exit_price"),
        ))
    late = [x for x in latencies_ms if x > 0]
    if late:
        entry = entries(bars, late, delay).filter("entry_bar is not null")
        prices = wide.select(
            *BAR_DAY, F.col("bar_idx").alias("entry_bar"), F.col("vwap").alias("entry_price"), F.col("_out").alias("exit_price")
        )
        parts.append(
            entry.join(prices, BAR_DAY + ["entry_bar"]).join(wide.select(*BAR, "_rules", "_last"), BAR).select(
                *BAR, "_rules", "_last", "latency_ms", "entry_bar", "entry_price", "exit_price"
            )
        )
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.select("*", F.explode("_rules").alias("_r")).filter(F.col("_r.direction") != 0)
    direction = F.col("_r.direction")
    gross = direction * (ratio(F.col("exit_price"), F.col("entry_price")) - 1.0)
    return rows.select(
        *BAR, F.col("_r.rule").alias("rule"), "latency_ms", "entry_bar",
        F.least(F.col("entry_bar") + holding, F.col("_last")).alias("exit_bar"), direction.alias("direction"),
        "entry_price", "exit_price", gross.alias("gross_return"), F.lit(2.0 * fee_rate).alias("fee"),
        (gross - 2.0 * fee_rate).alias("net_return"),
    )


def trades_of(signals: DataFrame, surface: DataFrame) -> DataFrame:
    """Trades of a signal table: one position per signal, notional 1, overlaps allowed."""
    return signals.join(surface, BAR)


def unmatched_signals(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Guard: signals on bars that do not exist in the bar table (must be empty)."""
    return signals.join(bars.select(*BAR), BAR, "left_anti")
