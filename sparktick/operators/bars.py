"""Trade-count bars and per-bar projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktick.functions.columns import day_start_ns, idiv, ratio
from sparktick.operators.spread import MINUTE_NS, number_rows, over_bars
from sparktick.schemas import BAR, BAR_DAY, DAY

TRADE_ORDER = ("ts_ns", "trade_id", "price", "qty", "is_buyer_maker")


def minute_slices() -> list[Column]:
    return [idiv(F.col("ts_ns"), MINUTE_NS)]


def tied_slices(width: int = 1 << 16) -> list[Column]:
    """For sources with few distinct times: slice by the time itself, then by ranges of the trade id."""
    return [F.col("ts_ns"), idiv(F.col("trade_id"), width)]


def numbered_trades(trades: DataFrame, slices: Sequence[Column] | None = None) -> DataFrame:
    return number_rows(trades, DAY, slices or minute_slices(), list(TRADE_ORDER), "seq")


def vwap_bars(
    trades: DataFrame, num: int | Sequence[int], slices: Sequence[Column] | None = None, flow: bool = False,
    close: bool = False,
) -> DataFrame:
    """Bars of `num` consecutive trades per symbol and day; the incomplete last group is dropped.

    vwap = sum(p q) / sum(q), or the mean price if the volume is 0. `flow` adds signed-volume and count
    imbalance (a buyer-maker trade is seller-initiated: -1), `close` the last trade price. Several values of
    `num` share one numbering pass.
    """
    nums = [num] if isinstance(num, int) else list(num)
    used = numbered_trades(trades.select(*DAY, *TRADE_ORDER), slices)
    if len(nums) == 1:
        used = used.withColumn("num", F.lit(nums[0]).cast("long"))
    else:
        used = used.withColumn("num", F.explode(F.array(*[F.lit(n).cast("long") for n in nums])))
    p, q = F.col("price"), F.col("qty")
    side = F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0)
    aggs = [
        F.min("ts_ns").alias("ts_start_ns"), F.max("ts_ns").alias("ts_end_ns"),
        F.coalesce(ratio(F.sum(p * q), F.sum(q)), F.avg(p)).alias("vwap"), F.sum(q).alias("volume"),
        F.count("*").alias("n_trades"),
    ]
    if flow:
        aggs += [ratio(F.sum(side * q), F.sum(q)).alias("ofi"), F.avg(side).alias("count_imb")]
    if close:
        aggs += [F.max_by(p, F.col("seq")).alias("close")]
    grouped = used.withColumn("bar_idx", F.call_function("div", F.col("seq"), F.col("num"))).groupBy(*BAR).agg(*aggs)
    return grouped.filter(F.col("n_trades") == F.col("num"))


def lag_diff(window, column: str = "vwap") -> Column:
    return F.col(column) - F.lag(column).over(window)


def differences(bars: DataFrame) -> DataFrame:
    """d = vwap change since the bar before (NULL at bar 0) and the channels x1 = d, x2 = -d."""
    out = over_bars(bars, BAR_DAY, 1, 0, lambda w: {"d": lag_diff(w)})
    return out.withColumns({"x1": F.col("d"), "x2": -F.col("d")})


def next_return(bars: DataFrame) -> DataFrame:
    """r = |next vwap / vwap - 1|, NULL at the last bar."""
    return over_bars(bars, BAR_DAY, 0, 1, lambda w: {"r": F.abs(ratio(F.lead("vwap").over(w), F.col("vwap")) - 1.0)})


def bar_time(axis: str) -> Column:
    """Event clock: the bar index, or seconds since UTC midnight of the bar's last trade."""
    if axis == "bar_index":
        return F.col("bar_idx").cast("double")
    if axis == "wallclock":
        return (F.col("ts_end_ns") - day_start_ns(F.col("day"))) / 1e9
    raise ValueError(f"unknown time axis {axis!r}")


def day_sizes(bars: DataFrame) -> DataFrame:
    """Bars per (symbol, day, num): one small row per day."""
    return bars.groupBy(*BAR_DAY).agg(F.count("*").alias("n_bars"))
