"""Direction rules (D) and execution (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktick.functions.rules import default_rules, make_rule
from sparktick.operators import execution as E
from sparktick.queries import common as C
from sparktick.queries import sql as S
from sparktick.queries.registry import query, r, rs
from sparktick.schemas import BAR

_B = "symbol, day, num, bar_idx"


def _rule_sql(name: str) -> str:
    return S.chain(S.RULES) + f"SELECT {_B}, CAST(direction AS INTEGER) AS direction FROM dirs WHERE rule = '{name}'"


def _rule(spark, sf, name):
    rows = E.directions(C.bars(spark, sf), [make_rule(name)])
    return rows.select(*BAR, F.col("direction").cast("int").alias("direction"))


@query("d1_momentum_rule", _rule_sql("momentum"))
def d1(spark, sf):
    return _rule(spark, sf, "momentum")


@query("d2_alexanders_filter", _rule_sql("alexanders_filter"))
def d2(spark, sf):
    return _rule(spark, sf, "alexanders_filter")


@query("d3_stochastic_oscillator", _rule_sql("stochastic_oscillator"))
def d3(spark, sf):
    return _rule(spark, sf, "stochastic_oscillator")


@query("d4_all_rules", S.chain(S.RULES) + f"SELECT {_B}, rule, CAST(direction AS INTEGER) AS direction FROM dirs")
def d4(spark, sf):
    return E.directions(C.bars(spark, sf), default_rules()).withColumn("direction", F.col("direction").cast("int"))


@query(
    "e1_entry_bars",
    S.chain(S.RULES, S.ENTRIES) + f"""SELECT d.symbol, d.day, d.num, d.bar_idx, l.latency_ms, e.e0 AS entry_bar
  FROM dd d CROSS JOIN (SELECT unnest([{', '.join(map(str, S.LATENCIES))}]::DOUBLE[]) AS latency_ms) l
  LEFT JOIN entries e ON e.symbol = d.symbol AND e.day = d.day AND e.num = d.num AND e.bar_idx = d.bar_idx AND e.latency_ms = l.latency_ms""",
)
def e1(spark, sf):
    return E.entries(C.bars(spark, sf), S.LATENCIES)


_FEE = 0.0005


@query(
    "e2_trades",
    S.chain(S.RULES, S.ENTRIES) + f"""SELECT symbol, day, num, bar_idx, rule, latency_ms, entry_bar, exit_bar, CAST(direction AS INTEGER) AS direction,
  {rs('entry_price', 'exit_price')}, {r('net_return', 'gross_return')}, {r('CAST(2.0 * 0.0005 AS DOUBLE)', 'fee')}, {r('net_return - 2.0 * 0.0005', 'net_return')} FROM surf""",
)
def e2(spark, sf):
    rows = E.return_surface(C.bars(spark, sf), default_rules(), S.LATENCIES, fee_rate=_FEE)
    return rows.withColumn("direction", F.col("direction").cast("int"))


@query(
    "e2_big_move_bar_trades",
    S.chain(S.RULES, S.ENTRIES) + f"""SELECT s.symbol, s.day, s.num, s.bar_idx, rule, entry_bar, exit_bar, {rs('net_return')}
  FROM (SELECT symbol, day, num, bar_idx FROM dd WHERE abs(d) > 20) s JOIN surf USING (symbol, day, num, bar_idx) WHERE latency_ms = 0""",
)
def e2_signals(spark, sf):
    d = C.diffs(spark, sf)
    surface = E.return_surface(d, default_rules())
    rows = E.trades_of(d.filter(F.abs("d") > 20).select(*BAR), surface)
    return rows.select(*BAR, "rule", "entry_bar", "exit_bar", "net_return")


@query(
    "e3_return_surface",
    S.chain(S.RULES, S.ENTRIES) + f"""SELECT symbol, day, rule, latency_ms, count(*) AS n_trades, {r('sum(net_return)', 'net_return')},
  {r('avg(CAST(net_return > 0 AS INTEGER))', 'win_rate')} FROM surf GROUP BY ALL""",
)
def e3(spark, sf):
    rows = E.return_surface(C.bars(spark, sf), default_rules(), S.LATENCIES)
    return rows.groupBy("symbol", "day", "rule", "latency_ms").agg(
        F.count("*").alias("n_trades"), F.sum("net_return").alias("net_return"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"),
    )


@query(
    "e4_unmatched_signals",
    S.chain() + """, sg AS (SELECT symbol, day, num, bar_idx * 2 AS bar_idx FROM bars)
SELECT sg.* FROM sg ANTI JOIN bars USING (symbol, day, num, bar_idx)""",
)
def e4(spark, sf):
    """Signals made on another bar series: doubled indices, most of which lie past the day's end."""
    b = C.bars(spark, sf)
    signals = b.select("symbol", "day", "num", (F.col("bar_idx") * 2).alias("bar_idx"))
    return E.unmatched_signals(signals, b)
