"""Labels, spike metrics, health and feature tables (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktick.operators import labels as L
from sparktick.operators import normalise as N
from sparktick.plans import reports as R
from sparktick.queries import common as C
from sparktick.queries import sql as S
from sparktick.queries.registry import query, r, rs
from sparktick.schemas import BAR, BAR_DAY
from sparktick.session import materialise

_B = "symbol, day, num, bar_idx"


@query("l1_day_pivot", S.chain(S.LABELS) + f"SELECT symbol, day, num, n_bars, {rs('r_pivot')} FROM base")
def l1(spark, sf):
    return L.day_base(L.bar_labels(C.bars(spark, sf))).select(*BAR_DAY, "n_bars", "r_pivot")


@query("l2_spike_strength", S.chain(S.LABELS) + f"SELECT {_B}, {rs('strength')} FROM lab")
def l2(spark, sf):
    return L.bar_labels(C.bars(spark, sf)).select(*BAR, "strength")


@query("l3_momentum_flag", S.chain(S.LABELS) + f"SELECT {_B}, {r('mom_rev_flag', 'mom_rev_flag', 6)} FROM lab", digits=6)
def l3(spark, sf):
    return L.bar_labels(C.bars(spark, sf)).select(*BAR, "mom_rev_flag")


@query("l4_bar_labels", S.chain(S.LABELS) + f"SELECT {_B}, evaluable, real, momentum FROM lab")
def l4(spark, sf):
    return L.bar_labels(C.bars(spark, sf)).select(*BAR, "evaluable", "real", "momentum")


@query(
    "l4_bar_labels_window1",
    S.chain() + f""", x AS (SELECT *, abs(lead(vwap, 2) OVER {S.W} / lead(vwap, 1) OVER {S.W} - 1) AS strength, abs(lead(vwap) OVER {S.W} / vwap - 1) AS r,
  lag(vwap) OVER {S.W} - vwap AS a, lead(vwap) OVER {S.W} - vwap AS b, bar_idx >= 1 AND bar_idx <= n - 3 AS evaluable FROM dd),
y AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY symbol, day, num) AS r_pivot FROM x)
SELECT {_B}, evaluable, evaluable AND strength > r_pivot AS real, evaluable AND NOT ({S.zsmall('a', 'vwap')} * {S.zsmall('b', 'vwap')} > 0) AS momentum FROM y""",
)
def l4_one(spark, sf):
    return L.bar_labels(C.bars(spark, sf), 1).select(*BAR, "evaluable", "real", "momentum")


@query(
    "l5_base_rates",
    S.chain(S.LABELS) + f"SELECT symbol, day, num, n_evaluable, {rs('base_accuracy', 'base_momentum_pct')} FROM base",
)
def l5(spark, sf):
    return L.day_base(L.bar_labels(C.bars(spark, sf))).select(*BAR_DAY, "n_evaluable", "base_accuracy", "base_momentum_pct")


# Signals: bars whose move is above 60, none on days whose number is a multiple of 7.
_SIG = "sg AS (SELECT symbol, day, num, bar_idx FROM dd WHERE abs(d) > 60 AND day(day) % 7 <> 0)"
_METRICS = """met AS (SELECT b.symbol, b.day, b.num, b.n_bars, count(s.bar_idx) AS n_signals, count(*) FILTER (s.evaluable) AS n_evaluated,
  count(s.bar_idx) - count(*) FILTER (s.evaluable) AS n_excluded, count(*) FILTER (s.real) AS n_real, count(*) FILTER (s.momentum) AS n_momentum,
  count(*) FILTER (s.real) / nullif(count(*) FILTER (s.evaluable), 0) AS accuracy,
  count(*) FILTER (s.momentum) / nullif(count(*) FILTER (s.evaluable), 0) AS momentum_pct,
  b.base_accuracy, b.base_momentum_pct, count(s.bar_idx) / b.n_bars AS signal_rate
  FROM base b LEFT JOIN (SELECT sg.*, evaluable, real, momentum FROM sg JOIN lab USING (symbol, day, num, bar_idx)) s USING (symbol, day, num)
  GROUP BY b.symbol, b.day, b.num, b.n_bars, b.base_accuracy, b.base_momentum_pct)"""
_MCOLS = "n_bars, n_signals, n_evaluated, n_excluded, n_real, n_momentum, " + rs(
    "accuracy", "momentum_pct", "base_accuracy", "base_momentum_pct", "signal_rate"
)


def _metrics(spark, sf):
    d = C.bar_table(spark, sf)
    labels = L.bar_labels(d)
    signals = d.filter((F.abs("d") > 60) & (F.dayofmonth("day") % 7 != 0)).withColumn("source", F.lit("fixed"))
    spine = L.day_base(labels).withColumn("source", F.lit("fixed"))
    return L.day_metrics(labels, signals, ["source"], spine).drop("source")


@query("l6_day_metrics", S.chain(S.LABELS, _SIG, _METRICS) + f"SELECT symbol, day, num, {_MCOLS} FROM met")
def l6(spark, sf):
    return _metrics(spark, sf)


@query(
    "l8_output_health",
    S.chain(S.LABELS, _SIG, _METRICS) + f"""SELECT symbol, day, num, {rs('signal_rate')},
  CASE WHEN signal_rate BETWEEN 0.001 AND 0.3 THEN '' ELSE 'output rate outside range' END AS warnings FROM met""",
)
def l8(spark, sf):
    return L.output_health(_metrics(spark, sf), high=0.3).select(*BAR_DAY, "signal_rate", "warnings")


def _counts_sql() -> str:
    u = S.uniform("'0'", "'test'", "symbol", "day", "'0'", "bar_idx", "tick", "'{}'")
    return f""", enc AS (SELECT z.*, CAST({u.format(1)} < p1 AS INTEGER) AS s1, CAST({u.format(2)} < p2 AS INTEGER) AS s2
  FROM zin z, (SELECT unnest(range(0, 10)) AS tick) WHERE split = 'test'),
cn AS (SELECT symbol, day, num, count(DISTINCT bar_idx) AS n_bars, unnest(['x1', 'x2', 'never']) AS counter,
  unnest([sum(s1), sum(s2), 0]) AS total FROM enc GROUP BY symbol, day, num)"""


@query(
    "l8_counter_health",
    S.chain(S.folds(1), S.ZSCORE) + _counts_sql() + f"""SELECT symbol, day, num, counter, CAST(total AS BIGINT) AS total, {r('total / (1 * n_bars)', 'rate')},
  CASE WHEN total = 0 THEN 'silent ' || counter WHEN total / (1 * n_bars) >= 0.4 * 10 / (1 + 1) THEN 'saturated ' || counter ELSE '' END AS warnings FROM cn""",
)
def l8_counters(spark, sf):
    inputs = N.zscore_inputs(C.diffs(spark, sf), C.folds(spark, sf, 1)).filter("split = 'test'")
    per_bar = N.spike_counts(N.encode(inputs, 10, 0), [*BAR_DAY, "bar_idx"])
    per_day = per_bar.groupBy(*BAR_DAY).agg(
        F.count("*").alias("n_bars"), F.sum("spikes_1").alias("x1"), F.sum("spikes_2").alias("x2"), F.lit(0).cast("long").alias("never")
    )
    long = per_day.unpivot([*BAR_DAY, "n_bars"], ["x1", "x2", "never"], "counter", "count")
    return L.counter_health(long, BAR_DAY, units=1, ticks=10, t_ref=1, saturation=0.4)


@query(
    "l9_warning_days",
    S.chain(S.LABELS, _SIG, _METRICS) + """SELECT split, count(*) FILTER (NOT signal_rate BETWEEN 0.001 AND 0.3) AS days_with_warnings
  FROM (SELECT *, CASE WHEN day < (SELECT min(day) FROM tr) + 10 THEN 'train' ELSE 'test' END AS split FROM met) GROUP BY split""",
)
def l9(spark, sf):
    health = L.output_health(_metrics(spark, sf), high=0.3)
    first = C.trades(spark, sf).agg(F.min("day").alias("first"))  # one row
    split = F.when(F.col("day") < F.date_add("first", S.HISTORY), "train").otherwise("test")
    return L.warning_days(health.crossJoin(F.broadcast(first)).withColumn("split", split))


@query(
    "l10_trade_label",
    S.chain(S.RULES, S.TRADE_LABEL) + f"SELECT {_B}, CAST(dir AS INTEGER) AS dir, {rs('ret')} FROM tl",
)
def l10(spark, sf):
    return L.trade_labels(C.bars(spark, sf)).select(*BAR, "dir", "ret")


_SINCE = f"""thr9 AS (SELECT symbol, num, day + 1 AS day, quantile_cont(abs(d), 0.9) AS thr FROM dd WHERE d IS NOT NULL GROUP BY ALL),
sb0 AS (SELECT dd.*, thr, max(CASE WHEN abs(coalesce(d, 0)) > thr THEN bar_idx END) OVER (PARTITION BY dd.symbol, dd.day, dd.num ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS last_big
  FROM dd JOIN thr9 USING (symbol, num, day)),
since AS (SELECT *, bar_idx - last_big AS lag_bars, CASE WHEN bar_idx - last_big <= 2 THEN CAST(bar_idx - last_big AS VARCHAR)
  WHEN bar_idx - last_big <= 5 THEN '3-5' ELSE '>5' END AS bucket FROM sb0)"""


@query("l11_since_big_move", S.chain(_SINCE) + f"SELECT {_B}, lag_bars, bucket FROM since")
def l11(spark, sf):
    return L.since_big_move(C.diffs(spark, sf)).select(*BAR, "lag_bars", "bucket")


_DECILE = """dec AS (SELECT symbol, day, num, bar_idx, CAST(least((row_number() OVER (PARTITION BY symbol, day, num ORDER BY abs(d), bar_idx) - 1) * 10 //
  count(*) OVER (PARTITION BY symbol, day, num), 9) AS INTEGER) AS decile FROM dd WHERE d IS NOT NULL)"""


@query("l12_move_deciles", S.chain(_DECILE) + f"SELECT {_B}, decile FROM dec")
def l12(spark, sf):
    return L.move_deciles(C.diffs(spark, sf)).select(*BAR, "decile")


_EVF = """ef AS (SELECT l.symbol, l.num, l.w_h, l.day, l.bar_idx, l.k, l.mom AS m, l.p_same, l.p_cross,
  CASE WHEN l.k = 0 THEN lam_u - lam_d ELSE lam_d - lam_u END / (lam_u + lam_d) AS asym, tl.dir, tl.ret, lab.evaluable, lab.momentum AS paper_mom
  FROM lam l JOIN tl USING (symbol, day, num, bar_idx) JOIN lab USING (symbol, day, num, bar_idx) WHERE l.k IS NOT NULL)"""
EVENT_FEATURES = [S.LABELS, S.RULES, S.TRADE_LABEL, S.events(), S.theta(), S.LAM, _EVF]


def event_features(spark, sf):
    d = C.bar_table(spark, sf)
    return R.event_features(C.intensities(spark, d), d)


@query(
    "l13_event_features",
    S.chain(*EVENT_FEATURES) + f"""SELECT symbol, num, w_h, day, bar_idx, k, {rs('m', 'p_same', 'p_cross', 'asym', 'ret')}, CAST(dir AS INTEGER) AS dir,
  evaluable, paper_mom FROM ef""",
)
def l13(spark, sf):
    return event_features(spark, sf)


@query(
    "l13_base_counts",
    S.chain(S.LABELS, S.RULES, S.TRADE_LABEL) + """SELECT symbol, day, num, count(*) FILTER (ret <> 0) AS decided_bars, count(*) FILTER (ret < 0) AS reversion_bars,
  count(*) FILTER (evaluable) AS eval_bars, count(*) FILTER (evaluable AND NOT momentum) AS eval_reversion_bars
  FROM tl JOIN (SELECT symbol, day, num, bar_idx, evaluable, momentum FROM lab) USING (symbol, day, num, bar_idx) GROUP BY ALL""",
)
def l13_base(spark, sf):
    return R.base_counts(C.bars(spark, sf))


_SCALE = """sc AS (SELECT symbol, num, day + 1 AS day, CASE WHEN quantile_cont(abs(d), 0.5) = 0 THEN 1.0 ELSE quantile_cont(abs(d), 0.5) END AS scale
  FROM dd WHERE d IS NOT NULL GROUP BY ALL)"""


def _lagged(k: int, c: str) -> str:
    return f"lag({c}, {k}) OVER w" if k else c


_ORIENTED = S.chain(S.RULES, S.TRADE_LABEL, S.events(), S.theta(), S.LAM, _SCALE) + f"""
, f AS (SELECT t.symbol, t.day, t.num, t.bar_idx, t.ret, t.dir, {', '.join(
    f"t.dir * coalesce({_lagged(k, 't.d')}, 0) / scale AS move_{k}, ln(1 + abs(coalesce({_lagged(k, 't.d')}, 0)) / scale) AS size_{k}, "
    f"CASE WHEN t.dir > 0 THEN {_lagged(k, 'l.lam_u')} - {_lagged(k, 'l.lam_d')} ELSE {_lagged(k, 'l.lam_d')} - {_lagged(k, 'l.lam_u')} END "
    f"/ ({_lagged(k, 'l.lam_u')} + {_lagged(k, 'l.lam_d')}) AS asym_{k}" for k in range(3))},
  ln(l.lam_u + l.lam_d) AS log_lam_total, CAST(t.ret > 0 AS DOUBLE) AS y
  FROM tl t JOIN lam l USING (symbol, day, num, bar_idx) JOIN sc USING (symbol, num, day) WINDOW w AS (PARTITION BY t.symbol, t.day, t.num ORDER BY t.bar_idx))
SELECT symbol, day, num, bar_idx, {rs('ret', 'y', *[f'{n}_{k}' for k in range(3) for n in ('move', 'size', 'asym')], 'log_lam_total')}
FROM f WHERE ret <> 0 AND bar_idx >= 3"""

ORIENTED = [f"{n}_{k}" for k in range(3) for n in ("move", "size", "asym")] + ["log_lam_total"]


def oriented(spark, sf):
    d = C.bar_table(spark, sf)
    lam = C.intensities(spark, d).select(*BAR, "d", "lam_u", "lam_d")
    rows = lam.join(L.trade_labels(d).select(*BAR, "dir", "ret"), BAR)
    return L.oriented_features(rows, L.train_day_quantile(d, 0.5, "scale"))


@query("l14_oriented_features", _ORIENTED)
def l14(spark, sf):
    return oriented(spark, sf).select(*BAR, "ret", "y", *ORIENTED)


_FLOW = S.chain(S.RULES, S.TRADE_LABEL, _SCALE) + f"""
, f AS (SELECT symbol, day, num, bar_idx, ret, CAST(ret > 0 AS DOUBLE) AS y, {', '.join(
    f"dir * coalesce({_lagged(k, 'd')}, 0) / scale AS move_{k}, ln(1 + abs(coalesce({_lagged(k, 'd')}, 0)) / scale) AS size_{k}" for k in range(3))},
  {', '.join(f"dir * {_lagged(k, 'ofi')} AS ofi_{k}" for k in range(5))},
  dir * sum(ofi) OVER (PARTITION BY symbol, day, num ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ofi_sum5,
  dir * sum(ofi) OVER (PARTITION BY symbol, day, num ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ofi_sum20,
  dir * count_imb AS count_imb_0 FROM tl JOIN sc USING (symbol, num, day) WINDOW w AS (PARTITION BY symbol, day, num ORDER BY bar_idx))
SELECT symbol, day, num, bar_idx, {rs('ret', 'y', *L.PRICE_FEATURES, *L.FLOW_FEATURES)} FROM f WHERE ret <> 0 AND bar_idx >= 20"""


def flow(spark, sf):
    return L.flow_features(materialise(C.bars(spark, sf, flow=True), "bars"))


@query("l15_flow_features", _FLOW)
def l15(spark, sf):
    return flow(spark, sf).select(*BAR, "ret", "y", *L.PRICE_FEATURES, *L.FLOW_FEATURES)


_REG = S.chain(S.LABELS, _SIG, _SCALE) + f"""
, f AS (SELECT symbol, day, num, bar_idx, evaluable, CAST(real AS DOUBLE) AS y, {', '.join(f"ln(1 + {_lagged(k, 'abs(coalesce(d, 0))')} / scale) AS d{k}" for k in range(3))},
  ln(1 + avg(abs(coalesce(d, 0))) OVER (PARTITION BY symbol, day, num ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / scale) AS vol
  FROM lab JOIN sc USING (symbol, num, day) WINDOW w AS (PARTITION BY symbol, day, num ORDER BY bar_idx))
SELECT f.symbol, f.day, f.num, f.bar_idx, {rs('y', 'd0', 'd1', 'd2', 'vol')}, CASE WHEN sg.bar_idx IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS sig_fixed
FROM f LEFT JOIN sg USING (symbol, day, num, bar_idx) WHERE evaluable AND f.bar_idx >= 2"""


def regression_rows(spark, sf):
    d = C.bar_table(spark, sf)
    signals = d.filter((F.abs("d") > 60) & (F.dayofmonth("day") % 7 != 0))
    return L.regression_rows(L.bar_labels(d), {"fixed": signals})


@query("l16_regression_rows", _REG)
def l16(spark, sf):
    return regression_rows(spark, sf)
