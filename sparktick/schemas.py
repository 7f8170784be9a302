"""Fixed table layouts. Times stay int64 ns: Spark timestamps only hold microseconds."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

TRADES = _struct(symbol=_S, day=T.DateType(), ts_ns=_L, price=_D, qty=_D, is_buyer_maker=_B, trade_id=_L)
BARS = _struct(
    symbol=_S, day=T.DateType(), num=_L, bar_idx=_L, ts_start_ns=_L, ts_end_ns=_L, vwap=_D, volume=_D, n_trades=_L
)
SIGNALS = _struct(
    model=_S, w_snn=T.IntegerType(), w_h=T.IntegerType(), seed=T.IntegerType(), symbol=_S, day=T.DateType(), num=_L, bar_idx=_L
)
TRADE_RETURNS = _struct(
    day=T.DateType(), latency_ms=_D, signal_bar=_L, entry_bar=_L, exit_bar=_L, direction=T.ByteType(), entry_price=_D,
    exit_price=_D, gross_return=_D, fee=_D, net_return=_D,
)
THETA = _struct(
    mu=T.ArrayType(_D), alpha=T.ArrayType(T.ArrayType(_D)), beta=T.ArrayType(T.ArrayType(_D)),
    marks=_struct(name=_S, scale=T.ArrayType(_D), norm=T.ArrayType(_D)),
    time_axis=_S, event_threshold=_D,
    fit=_struct(for_day=_S, fit_days=T.ArrayType(_S), w_h=_L, candidate_moves=_L, n_events=_L, loglik_per_event=_D, converged=_B),
)

# Column layouts of the two exchange trade files.
RAW_TRADES = ("id", "price", "qty", "quote_qty", "time", "is_buyer_maker")
RAW_AGG_TRADES = (
    "agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "is_buyer_maker"
)

DAY = ["symbol", "day"]
BAR_DAY = ["symbol", "day", "num"]
BAR = ["symbol", "day", "num", "bar_idx"]
