"""Bars and projections (B), direction rules and calendar-free bar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktick.operators import bars as B
from sparktick.queries import common as C
from sparktick.queries import sql as S
from sparktick.queries.registry import query, r, rs
from sparktick.schemas import BAR
from sparktick.sources.tables import lineitem_trades

_BASE = "symbol, day, num, bar_idx"


@query("b1_vwap_bars", S.chain() + f"SELECT {_BASE}, ts_start_ns, ts_end_ns, {rs('vwap', 'volume')}, n_trades FROM bars")
def b1(spark, sf):
    return C.bars(spark, sf).select(*BAR, "ts_start_ns", "ts_end_ns", "vwap", "volume", "n_trades")


@query(
    "b1_vwap_bars_by_symbol",
    S.chain(symbol="event_type", num=2) + f"SELECT {_BASE}, ts_start_ns, ts_end_ns, {rs('vwap', 'volume')}, n_trades FROM bars",
)
def b1_symbols(spark, sf):
    return B.vwap_bars(C.typed_trades(spark, sf), 2).select(*BAR, "ts_start_ns", "ts_end_ns", "vwap", "volume", "n_trades")


_TIED = f"""WITH lt AS (SELECT l_returnflag AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day, epoch_us(l_shipdate) * 1000 AS ts_ns,
  l_extendedprice / l_quantity AS price, l_quantity AS qty, l_linestatus = 'F' AS maker, l_orderkey * 8 + l_linenumber AS trade_id FROM lineitem),
s AS (SELECT *, (row_number() OVER (PARTITION BY symbol, day ORDER BY ts_ns, trade_id, price, qty, maker) - 1) // 10 AS bar_idx FROM lt)
SELECT symbol, day, CAST(10 AS BIGINT) AS num, bar_idx, min(ts_ns) AS ts_start_ns, max(ts_ns) AS ts_end_ns,
  round(sum(price * qty), 2) / sum(qty) AS vwap, {r('sum(qty)', 'volume')}, count(*) AS n_trades FROM s GROUP BY symbol, day, bar_idx HAVING count(*) = 10"""


# Notionals have two decimals and volumes many factors of 2, so vwap often is an exact half at any digit kept:
# the last bits of the sum are rounded away before the division instead, then both engines agree exactly.
@query("b1_vwap_bars_ties", _TIED, digits=15)
def b1_ties(spark, sf):
    rows = B.vwap_bars(lineitem_trades(spark, sf), 10, slices=B.tied_slices())
    vwap = F.round(F.col("vwap") * F.col("volume"), 2) / F.col("volume")
    return rows.select(*BAR, "ts_start_ns", "ts_end_ns", vwap.alias("vwap"), "volume", "n_trades")


@query("b2_order_flow_bars", S.chain() + f"SELECT {_BASE}, {rs('ofi', 'count_imb')} FROM bars")
def b2(spark, sf):
    return C.bars(spark, sf, flow=True).select(*BAR, "ofi", "count_imb")


@query("b3_bar_close", S.chain() + f"SELECT {_BASE}, {rs('close')} FROM bars")
def b3(spark, sf):
    return C.bars(spark, sf, close=True).select(*BAR, "close")


@query("b4_price_difference", S.chain() + f"SELECT {_BASE}, {rs('d')} FROM dd")
def b4(spark, sf):
    return C.diffs(spark, sf).select(*BAR, "d")


@query("b5_directional_channels", S.chain() + f"SELECT {_BASE}, {r('d', 'x1')}, {r('-d', 'x2')} FROM dd")
def b5(spark, sf):
    return C.diffs(spark, sf).select(*BAR, "x1", "x2")


@query("b6_next_return", S.chain(S.LABELS) + f"SELECT {_BASE}, {rs('r')} FROM lab")
def b6(spark, sf):
    return B.next_return(C.bars(spark, sf)).select(*BAR, "r")


@query(
    "b7_event_clock",
    S.chain() + f"SELECT {_BASE}, CAST(bar_idx AS DOUBLE) AS t_bar, {r('(ts_end_ns - epoch_us(CAST(day AS TIMESTAMP)) * 1000) / 1e9', 't_clock', 6)} FROM bars",
    digits=6,
)
def b7(spark, sf):
    return C.bars(spark, sf).select(*BAR, B.bar_time("bar_index").alias("t_bar"), B.bar_time("wallclock").alias("t_clock"))


@query(
    "a22_bar_sizes",
    "WITH " + S.trades() + """, ks AS (SELECT unnest([2, 4, 10]) AS k),
b AS (SELECT symbol, day, k, seq // k AS bar_idx, sum(price * qty) / sum(qty) AS vwap FROM seqd, ks GROUP BY ALL HAVING count(*) = k)
SELECT symbol, day, CAST(k AS BIGINT) AS num, count(*) AS n_bars, """ + r("avg(vwap)", "mean_vwap") + " FROM b GROUP BY ALL",
)
def bar_sizes(spark, sf):
    """Several bar sizes from one numbering pass."""
    rows = B.vwap_bars(C.trades(spark, sf), [2, 4, 10])
    return rows.groupBy("symbol", "day", "num").agg(F.count("*").alias("n_bars"), F.avg("vwap").alias("mean_vwap"))
