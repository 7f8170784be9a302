"""Standardisation, validation, coverage and calendar (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktick.operators import quality as Q
from sparktick.operators.bars import numbered_trades
from sparktick.queries import common as C
from sparktick.queries import sql as S
from sparktick.queries.registry import query, rs
from sparktick.sources.files import missing

# Every 9th trade is moved by 20 h, so some leave their day.
_MOVED = "WITH " + S.trades() + """, mv AS (SELECT symbol, day, ts_ns + CASE WHEN trade_id % 9 = 0 THEN 72000000000000 ELSE 0 END AS ts_ns, trade_id FROM tr),
st AS (SELECT *, ts_ns >= epoch_us(CAST(day AS TIMESTAMP)) * 1000 AND ts_ns < epoch_us(CAST(day AS TIMESTAMP)) * 1000 + 86400000000000 AS ok FROM mv)
"""


def _moved(spark, sf):
    shift = F.when(F.col("trade_id") % 9 == 0, 72_000_000_000_000).otherwise(0)
    return C.trades(spark, sf).withColumn("ts_ns", F.col("ts_ns") + shift)


@query("q1_standardise_day", _MOVED + "SELECT symbol, day, ts_ns, trade_id FROM st WHERE ok")
def q1(spark, sf):
    return Q.standardise(_moved(spark, sf)).select("symbol", "day", "ts_ns", "trade_id")


@query(
    "q1_outside_day_counts",
    _MOVED + "SELECT symbol, day, count(*) AS n_raw, count(*) FILTER (NOT ok) AS n_outside_day FROM st GROUP BY ALL",
)
def q1_counts(spark, sf):
    return Q.day_counts(_moved(spark, sf))


# Stored order = trade id within the day; moved times make some rows out of order.
_ORDER = _MOVED + """, p AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY trade_id) AS pos FROM st),
c AS (SELECT *, lag(ts_ns) OVER (PARTITION BY symbol, day ORDER BY pos) > ts_ns AS bad FROM p)
SELECT symbol, day, trade_id, coalesce(bad, false) AS unsorted, NOT ok AS outside FROM c WHERE coalesce(bad, false) OR NOT ok"""


@query("q2_frame_violations", _ORDER)
def q2(spark, sf):
    rows = C.trades(spark, sf)
    if Q.schema_violations(rows):
        raise ValueError(f"unexpected column types: {Q.schema_violations(rows)}")
    order = rows.withColumns({"_ts": F.col("ts_ns"), "ts_ns": F.col("trade_id")})  # number by trade id
    pos = numbered_trades(order, [F.floor(F.col("ts_ns") / 1000)]).withColumn("ts_ns", F.col("_ts"))
    shift = F.when(F.col("trade_id") % 9 == 0, 72_000_000_000_000).otherwise(0)
    return Q.order_violations(pos.withColumn("ts_ns", F.col("ts_ns") + shift), "seq").select(
        "symbol", "day", "trade_id", "unsorted", "outside"
    )


_COV = "WITH " + S.trades() + f""", days AS (SELECT 'ALL' AS symbol, CAST(unnest(generate_series(min(day) - 2, max(day) + 3, INTERVAL 1 DAY)) AS DATE) AS day FROM tr),
g AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY symbol, day ORDER BY ts_ns, trade_id) AS gap FROM tr),
pd AS (SELECT symbol, day, count(*) AS n_trades, min(ts_ns) AS a, max(ts_ns) AS b, max(gap) AS gap FROM g GROUP BY ALL),
cov AS (SELECT symbol, day, n_trades IS NOT NULL AS cached, n_trades, n_trades // {S.NUM} AS n_bars, a AS first_ts_ns, b AS last_ts_ns,
  (b - a) / 3.6e12 AS hours_covered, gap / 1e9 AS max_gap_s, CASE WHEN n_trades IS NOT NULL THEN 0 END AS n_outside_day
  FROM days LEFT JOIN pd USING (symbol, day))
"""


def _coverage(spark, sf):
    days = Q.days_of(C.trades(spark, sf), -2, 3).select(F.lit("ALL").alias("symbol"), "day")
    return Q.coverage(C.trades(spark, sf), days, S.NUM)


@query(
    "q3_coverage",
    _COV + f"""SELECT symbol, day, cached, n_trades, n_bars, first_ts_ns, last_ts_ns, {rs('hours_covered', 'max_gap_s', digits=6)},
  CAST(n_outside_day AS BIGINT) AS n_outside_day FROM cov""",
    digits=6,
)
def q3(spark, sf):
    return _coverage(spark, sf)


_PERIOD = """CASE WHEN day > (SELECT max(day) FROM tr) - 10 THEN 'test'
  WHEN day > (SELECT max(day) FROM tr) - 20 THEN 'validation' ELSE 'history' END"""
_SIZES = ", ".join(
    f"CAST(median({c}) AS DOUBLE) AS {c}_median, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in ("n_trades", "n_bars", "n_ticks")
)


@query(
    "q4_period_summary",
    _COV + f"""SELECT coalesce(period, 'all') AS period, count(*) AS days, {_SIZES}
  FROM (SELECT *, {_PERIOD} AS period, n_bars * 10 AS n_ticks FROM cov WHERE cached) GROUP BY ROLLUP (period)""",
)
def q4(spark, sf):
    last = C.trades(spark, sf).agg(F.max("day").alias("last"))  # one row
    cov = _coverage(spark, sf).crossJoin(F.broadcast(last))
    return Q.period_summary(cov, Q.period_of(F.col("day"), F.col("last"), 10, 10), 10)


@query(
    "q5_weekday_medians",
    _COV + """SELECT CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS kind, count(*) AS days,
  CAST(median(n_trades) AS DOUBLE) AS median_trades FROM cov WHERE cached GROUP BY 1""",
)
def q5(spark, sf):
    return Q.weekday_medians(_coverage(spark, sf))


@query(
    "q5_extreme_days",
    _COV + """(SELECT symbol, day, n_trades, 'busiest' AS kind FROM cov WHERE cached ORDER BY n_trades DESC, day LIMIT 3)
UNION ALL (SELECT symbol, day, n_trades, 'quietest' FROM cov WHERE cached ORDER BY n_trades, day LIMIT 3)""",
)
def q5_extremes(spark, sf):
    return Q.extreme_days(_coverage(spark, sf))


@query(
    "q5_gap_days",
    _COV + f"""SELECT symbol, day, n_trades, {rs('max_gap_s', 'hours_covered', digits=6)} FROM cov
  WHERE cached AND (max_gap_s > 1500.0 OR hours_covered < 23.9)""",
    digits=6,
)
def q5_gaps(spark, sf):
    return Q.gap_days(_coverage(spark, sf), max_gap_s=1500.0).select("symbol", "day", "n_trades", "max_gap_s", "hours_covered")


@query("q6_missing_days", _COV + "SELECT symbol, day FROM cov WHERE NOT cached")
def q6(spark, sf):
    wanted = Q.days_of(C.trades(spark, sf), -2, 3).select(F.lit("ALL").alias("symbol"), "day")
    return missing(wanted, C.trades(spark, sf), ["symbol", "day"])


@query(
    "q7_previous_days",
    """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT day, day - CAST(k AS INTEGER) AS prev_day FROM days, (SELECT unnest([1, 2, 3]) AS k)""",
)
def q7(spark, sf):
    return Q.previous_days(C.trades(spark, sf).select("day").distinct(), 3)


@query(
    "q7_calendar",
    """SELECT d.day, count(e.ts) AS n_trades FROM (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) + 4, INTERVAL 1 DAY)) AS DATE) AS day FROM events) d
LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY d.day""",
)
def q7_calendar(spark, sf):
    counts = C.trades(spark, sf).groupBy("day").agg(F.count("*").alias("n"))
    days = Q.days_of(C.trades(spark, sf), 0, 4)
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n_trades"))


