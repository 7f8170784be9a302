"""Walk-forward backtest (K), result tables and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktick.functions.rules import default_rules, momentum
from sparktick.operators import execution as E
from sparktick.operators import labels as L
from sparktick.operators import normalise as N
from sparktick.operators import signals as G
from sparktick.plans import backtest as K
from sparktick.plans import tuning as T
from sparktick.queries import common as C
from sparktick.queries import inputs as NQ
from sparktick.queries import signal_queries as GQ
from sparktick.queries import sql as S
from sparktick.queries.registry import query, r, rs
from sparktick.plans.incremental import commit_results
from sparktick.schemas import BAR
from sparktick.session import materialise, scratch_path
from sparktick.sources.keyed import result_store

RULES = ["momentum", "alexanders_filter", "stochastic_oscillator"]
MODELS = {"zscore": False, "excited": True}
SEEDS, REPS, RATE = (0, 1), 4, 0.1

# --------------------------------------------------------------------------- runs, jobs, folds

_RUNS = f"""days AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events),
runs AS (SELECT model, w_snn, CASE WHEN model = 'excited' THEN h END AS w_h, seed, rule FROM (SELECT unnest(['zscore', 'excited']) AS model),
  (SELECT unnest([1, 3]) AS w_snn), (SELECT unnest([1, 2]) AS h), (SELECT unnest([0, 1]) AS seed), (SELECT unnest({RULES}) AS rule) WHERE model = 'excited' OR h = 1),
rn AS (SELECT *, model || '__' || rule || '__Wsnn' || w_snn || CASE WHEN w_h IS NULL THEN '' ELSE '__Wh' || w_h END || '__seed' || seed AS run_id,
  model || '__Wsnn' || w_snn || CASE WHEN w_h IS NULL THEN '' ELSE '__Wh' || w_h END || '__seed' || seed AS job FROM runs)"""


def _runs(spark, sf):
    """Run grid with the number of days each run sees."""
    grid = K.run_grid(spark, MODELS, RULES, (1, 3), (1, 2), SEEDS)
    days = C.trades(spark, sf).agg(F.count_distinct("day").alias("n_days")).withColumn("_one", F.lit(1))
    return grid.withColumn("_one", F.lit(1)).join(F.broadcast(days), "_one").drop("_one")


@query("k1_run_grid", "WITH " + _RUNS + "SELECT model, w_snn, w_h, seed, rule, run_id, n_days FROM rn, days")
def k1(spark, sf):
    return _runs(spark, sf).drop("job")


@query(
    "k2_signal_jobs",
    "WITH " + _RUNS + "SELECT model, w_snn, w_h, seed, job, string_agg(rule, ',' ORDER BY rule) AS rules, max(n_days) AS n_days FROM rn, days GROUP BY ALL",
)
def k2(spark, sf):
    runs = _runs(spark, sf)
    jobs = K.signal_jobs(runs).withColumn("rules", F.array_join("rules", ","))
    return jobs.join(runs.groupBy("job").agg(F.max("n_days").alias("n_days")), "job")


@query(
    "k1_settings_id",
    S.chain() + """, z AS (SELECT symbol, CAST(num AS INTEGER) AS num, count(*) AS n FROM bars GROUP BY symbol, num)
SELECT symbol, n, substr(sha256('{"symbol":"' || symbol || '","num":' || num || ',"n":' || n || '}'), 1, 12) AS settings FROM z""",
)
def k1_settings(spark, sf):
    rows = C.bars(spark, sf).groupBy("symbol", F.col("num").cast("int").alias("num")).agg(F.count("*").alias("n"))
    return rows.select("symbol", "n", K.settings_id("symbol", "num", "n").alias("settings"))


@query(
    "k3_walk_forward_folds",
    S.chain(S.folds(1, 3, 5)) + """SELECT w_snn, test_day, train_day, count(*) AS train_bars FROM folds JOIN bars ON bars.day = train_day GROUP BY ALL""",
)
def k3(spark, sf):
    sizes = C.bars(spark, sf).groupBy(F.col("day").alias("train_day")).agg(F.count("*").alias("train_bars"))
    return C.folds(spark, sf, 1, 3, 5).join(sizes, "train_day").select("w_snn", "test_day", "train_day", "train_bars")


@query(
    "k4_fit_days_needed",
    S.chain(S.folds(1, 3)) + """SELECT DISTINCT w_h, x.day FROM (SELECT unnest([1, 2]) AS w_h),
  (SELECT train_day AS day FROM folds UNION SELECT test_day FROM folds) x ANTI JOIN (SELECT DISTINCT day FROM bars WHERE day(day) % 2 = 0) s ON s.day = x.day""",
)
def k4(spark, sf):
    """Theta days of all folds that are not stored yet (even days count as stored)."""
    jobs = K.signal_jobs(_runs(spark, sf))
    stored = C.bars(spark, sf).select("day").distinct().filter(F.dayofmonth("day") % 2 == 0)
    return K.fit_days_needed(jobs, C.folds(spark, sf, 1, 3)).join(stored, "day", "left_anti").select("w_h", "day")


# --------------------------------------------------------------------------- flagship: the rule at every bar

_FLAG = S.chain(S.RULES, S.ENTRIES) + """, days AS (SELECT DISTINCT day FROM tr),
tm AS (SELECT day, net_return AS x FROM surf WHERE rule = 'momentum' AND latency_ms = 0),
daily AS (SELECT days.day, coalesce(sum(x), 0) AS pnl, count(x) AS n_trades, count(*) FILTER (x > 0) AS n_pos, coalesce(sum(x) FILTER (x > 0), 0) AS sum_pos,
  count(*) FILTER (x < 0) AS n_neg, coalesce(sum(x) FILTER (x < 0), 0) AS sum_neg FROM days LEFT JOIN tm USING (day) GROUP BY days.day)
"""


def _perf(keys: str, source: str, extra: str = "") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""SELECT {head}sum(pnl) AS accumulated_return, stddev_samp(pnl) * sqrt(365) AS annualized_volatility,
  avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(365) AS sharpe, sum(n_pos) / nullif(sum(n_trades), 0) AS win_rate,
  (sum(sum_pos) / nullif(sum(n_pos), 0)) / nullif(abs(sum(sum_neg)) / nullif(sum(n_neg), 0), 0) AS profit_loss_ratio,
  sum(n_trades) / count(*) AS trades_per_day, avg(pnl) AS mean_daily_pnl, count(*) AS n_days, CAST(sum(n_trades) AS BIGINT) AS n_trades{extra} FROM {source} {group}"""


_DAILY = f"n_trades, n_pos, n_neg, {rs('pnl', 'sum_pos', 'sum_neg')}"
_PERF = rs(*K.PERFORMANCE, digits=6)


def _rule_daily(spark, sf):
    trades = E.return_surface(C.bars(spark, sf), [momentum(3)])
    days = C.trades(spark, sf).select("day").distinct().withColumn("rule", F.lit("momentum"))
    return K.daily_results(trades, ["rule"], days)


@query("k6_daily_results", _FLAG + f"SELECT day, {_DAILY} FROM daily")
def k6(spark, sf):
    return _rule_daily(spark, sf).drop("rule")


@query(
    "k7_performance",
    _FLAG + f"SELECT 'momentum' AS rule, {_PERF}, n_days, n_trades FROM ({_perf('', 'daily')})",
    digits=6,
)
def k7(spark, sf):
    """Flagship: daily results and performance of the momentum rule traded at every bar."""
    return K.performance(_rule_daily(spark, sf), ["rule"])


# --------------------------------------------------------------------------- the experiment

_JOBS = ", ".join(
    f"('{m}__Wsnn1{'__Wh1' if m == 'excited' else ''}__seed{s}', '{m}', 1, {1 if m == 'excited' else 'CAST(NULL AS INTEGER)'}, {s})"
    for m in MODELS for s in SEEDS
)
_MET = """count(bar_idx) AS n_signals, count(*) FILTER (evaluable) AS n_evaluated, count(bar_idx) - count(*) FILTER (evaluable) AS n_excluded,
  count(*) FILTER (real) AS n_real, count(*) FILTER (momentum) AS n_momentum, count(*) FILTER (real) / nullif(count(*) FILTER (evaluable), 0) AS accuracy,
  count(*) FILTER (momentum) / nullif(count(*) FILTER (evaluable), 0) AS momentum_pct, max(base_accuracy) AS base_accuracy,
  max(base_momentum_pct) AS base_momentum_pct, count(bar_idx) / max(base.n_bars) AS signal_rate"""


def _metrics_of(signals: str, spine: str, keys: str) -> str:
    on = " AND ".join(f"s.{k} = p.{k}" for k in keys.split(", ") + ["symbol", "day", "num"])
    named = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""SELECT {named}, p.symbol, p.day, p.num, {_MET} FROM {spine} p JOIN base USING (symbol, day, num)
  LEFT JOIN (SELECT q.*, evaluable, real, momentum FROM {signals} q JOIN lab USING (symbol, day, num, bar_idx)) s ON {on} GROUP BY {named}, p.symbol, p.day, p.num"""


_AGG = """coalesce(sum(x), 0) AS pnl, count(x) AS n_trades, count(*) FILTER (x > 0) AS n_pos, coalesce(sum(x) FILTER (x > 0), 0) AS sum_pos,
  count(*) FILTER (x < 0) AS n_neg, coalesce(sum(x) FILTER (x < 0), 0) AS sum_neg"""
_MN = "n_signals, n_evaluated, n_excluded, n_real, n_momentum, accuracy, momentum_pct, base_accuracy, base_momentum_pct, signal_rate"
_AVG = ", ".join(f"avg({c}) AS {c}" for c in K.METRICS)

_EXP_PARTS = [
    S.LABELS, S.RULES, S.ENTRIES, S.folds(1), S.SCOPED, S.ZSCORE_ONLY, S.events(), S.theta(), S.LAM, NQ.EXCITED_ONLY,
    GQ.encoded_sql("zin", "sgz", SEEDS, RATE), GQ.encoded_sql("lin", "sgl", SEEDS, RATE),
    f"""jobs AS (SELECT * FROM (VALUES {_JOBS}) t(job, model, w_snn, w_h, seed)),
sig AS (SELECT job, split, test_day, symbol, day, num, bar_idx FROM jobs JOIN sgz USING (w_snn, seed) WHERE model = 'zscore'
  UNION ALL SELECT job, split, test_day, symbol, day, num, bar_idx FROM jobs JOIN sgl USING (w_snn, seed) WHERE model = 'excited'),
stest AS (SELECT * FROM sig WHERE split = 'test'), strain AS (SELECT * FROM sig WHERE split = 'train'),
jd AS (SELECT job, w_snn, seed, symbol, day, num, n_bars FROM jobs JOIN (SELECT DISTINCT w_snn, test_day AS day FROM folds) USING (w_snn) JOIN base USING (day)),
rates AS (SELECT jd.*, count(s.bar_idx) AS n_signals FROM jd LEFT JOIN stest s USING (job, symbol, day, num) GROUP BY ALL),
pooled AS (SELECT f.w_snn, f.test_day, d.symbol, d.num, abs(d.d) AS a, row_number() OVER (PARTITION BY f.w_snn, f.test_day, d.symbol, d.num ORDER BY abs(d.d)) - 1 AS i,
  count(*) OVER (PARTITION BY f.w_snn, f.test_day, d.symbol, d.num) AS m FROM folds f JOIN dd d ON d.day = f.train_day WHERE d.d IS NOT NULL),
lim AS (SELECT q.job, q.symbol, q.day, q.num, max(a) FILTER (i = floor((m - 1) * (1 - n_signals / n_bars))) AS lo, max(a) FILTER (i = ceil((m - 1) * (1 - n_signals / n_bars))) AS hi,
  max((m - 1) * (1 - n_signals / n_bars)) AS pos FROM rates q JOIN pooled p ON p.w_snn = q.w_snn AND p.test_day = q.day AND p.symbol = q.symbol AND p.num = q.num
  WHERE n_signals > 0 GROUP BY q.job, q.symbol, q.day, q.num),
big AS (SELECT job, dd.symbol, dd.day, dd.num, dd.bar_idx FROM lim JOIN dd USING (symbol, day, num) WHERE abs(d) > lo + (hi - lo) * (pos - floor(pos))),
naive AS ({GQ.naive_sql('rates', 'day', REPS)}),
grid AS (SELECT jd.*, rule, latency_ms FROM jd, (SELECT unnest({RULES}) AS rule), (SELECT unnest([{', '.join(map(str, S.LATENCIES))}]::DOUBLE[]) AS latency_ms)),
rgrid AS (SELECT grid.*, rep FROM grid, (SELECT unnest(range(0, {REPS})) AS rep)),
own AS (SELECT 'model' AS source, job, symbol, day, num, bar_idx FROM stest UNION ALL SELECT 'big_move', job, symbol, day, num, bar_idx FROM big),
od AS (SELECT g.job, g.rule, g.latency_ms, s.source, g.day, {_AGG} FROM (SELECT grid.*, source FROM grid, (SELECT unnest(['model', 'big_move']) AS source)) g
  LEFT JOIN (SELECT o.*, rule, latency_ms, net_return AS x FROM own o JOIN surf USING (symbol, day, num, bar_idx)) t
    ON t.source = g.source AND t.job = g.job AND t.rule = g.rule AND t.latency_ms = g.latency_ms AND t.day = g.day
  JOIN (SELECT unnest(['model', 'big_move']) AS source) s ON s.source = g.source GROUP BY g.job, g.rule, g.latency_ms, s.source, g.day),
nd AS (SELECT g.job, g.rule, g.latency_ms, g.rep, g.day, {_AGG} FROM rgrid g
  LEFT JOIN (SELECT n.job, n.rule, n.rep, n.day, latency_ms, net_return AS x FROM naive n JOIN surf USING (symbol, day, num, bar_idx, rule)) t
    USING (job, rule, latency_ms, rep, day) GROUP BY g.job, g.rule, g.latency_ms, g.rep, g.day),
nmean AS (SELECT job, rule, latency_ms, 'naive_mean' AS source, day, avg(pnl) AS pnl, avg(n_trades) AS n_trades, avg(n_pos) AS n_pos, avg(sum_pos) AS sum_pos,
  avg(n_neg) AS n_neg, avg(sum_neg) AS sum_neg FROM nd GROUP BY ALL),
daily AS (SELECT job, rule, latency_ms, source, day, pnl, n_trades, n_pos, sum_pos, n_neg, sum_neg FROM od
  UNION ALL SELECT job, rule, latency_ms, source, day, pnl, n_trades, n_pos, sum_pos, n_neg, sum_neg FROM nmean),
nperf AS (SELECT job, rule, latency_ms, 'naive' AS source, {', '.join(f'avg({c}) AS {c}' for c in K.PERFORMANCE)},
  {', '.join(f'stddev_samp({c}) AS {c}_std' for c in K.PERFORMANCE)}, count(*) AS reps FROM ({_perf('job, rule, latency_ms, rep', 'nd')}) GROUP BY job, rule, latency_ms),
srows AS (SELECT job, rule, latency_ms, source, {', '.join(K.PERFORMANCE)} FROM ({_perf('job, rule, latency_ms, source', 'od')})
  UNION ALL SELECT job, rule, latency_ms, source, {', '.join(K.PERFORMANCE)} FROM nperf),
mm AS ({_metrics_of('stest', 'jd', 'job')}), mb AS ({_metrics_of('big', 'jd', 'job')}),
nrep AS (SELECT jd.*, rep FROM jd, (SELECT unnest(range(0, {REPS})) AS rep)), nfirst AS (SELECT * FROM naive WHERE rule = 'momentum'),
mn AS (SELECT job, symbol, day, num, {_AVG} FROM ({_metrics_of('nfirst', 'nrep', 'job, rep')}) GROUP BY job, symbol, day, num),
tsp AS (SELECT job, test_day, symbol, train_day AS day, num FROM jobs JOIN folds USING (w_snn) JOIN base ON base.day = train_day),
mt AS ({_metrics_of('strain', 'tsp', 'job, test_day')}),
sdays AS (SELECT job, 'test' AS split, 'model' AS source, day, day AS test_day, {_MN} FROM mm UNION ALL SELECT job, 'test', 'big_move', day, day, {_MN} FROM mb
  UNION ALL SELECT job, 'test', 'naive', day, day, {_MN} FROM mn UNION ALL SELECT job, 'train', 'model', day, test_day, {_MN} FROM mt),
spk AS (SELECT job, split, source, {_AVG} FROM sdays GROUP BY job, split, source)""",
]
EXPERIMENT = S.chain(*_EXP_PARTS) + "\n"


def _scored(spark, d, folds):
    """Encoded inputs of both models and all seeds, with their score, as one written table: draws do not depend on the model."""
    inputs = {"zscore": N.zscore_inputs(d, folds), "excited": N.intensity_inputs(C.intensities(spark, d), folds)}
    kept = [*GQ._SK.split(", "), "p1", "p2"]
    zscore, excited = (rows.select(F.lit(model).alias("model"), *kept) for model, rows in inputs.items())
    return GQ.seeded_scores(zscore.unionByName(excited), SEEDS, ["model"])


def experiment(spark, sf) -> K.Experiment:
    """Two models x two seeds, three rules, three latencies, four random repetitions, on all test days."""
    return _scored_experiment(spark, sf)[0]


def _scored_experiment(spark, sf):
    """The experiment, and the scores that its signals come from."""
    d = C.bar_table(spark, sf)
    folds = C.folds(spark, sf, 1)
    scored = _scored(spark, d, folds)
    runs = K.run_grid(spark, MODELS, RULES, (1,), (1,), SEEDS)
    jobs = K.signal_jobs(runs)
    fired = G.score_signals(scored, ["model", "seed"], RATE)
    signals = materialise(fired.join(jobs.select("job", "model", "seed", "w_snn"), ["model", "seed", "w_snn"]).select("job", "split", "test_day", *BAR), "signals")
    labels, surface = L.bar_labels(d), E.return_surface(d, default_rules(), S.LATENCIES)
    return K.Experiment(d, labels, surface, signals, jobs, folds, default_rules(), S.LATENCIES, REPS), scored


def job_input_stats(scored, jobs):
    """Realised input rates and mean probabilities of every job and test day."""
    stats = N.input_stats(scored.filter("split = 'test'"), ["model", "seed", "w_snn", "symbol", "day", "num"], GQ.TICKS)
    return stats.join(jobs.select("job", "model", "seed", "w_snn"), ["model", "seed", "w_snn"])


_RESULT_SQL = EXPERIMENT + f""", ins AS (SELECT model, seed, w_snn, symbol, day, num, sum(spikes_1) / (count(*) * {GQ.TICKS}) AS rate_x1 FROM (
  SELECT 'zscore' AS model, seed, w_snn, symbol, day, num, spikes_1 FROM sgz_all WHERE split = 'test' UNION ALL
  SELECT 'excited', seed, w_snn, symbol, day, num, spikes_1 FROM sgl_all WHERE split = 'test') GROUP BY ALL)
SELECT 'signals' AS result, count(*) AS n_rows, {r('sum(bar_idx)', 'total', 6)} FROM stest
UNION ALL SELECT 'trades', count(*), {r('sum(net_return)', 'total', 6)} FROM own JOIN surf USING (symbol, day, num, bar_idx)
UNION ALL SELECT 'daily', count(*), {r('sum(pnl)', 'total', 6)} FROM daily
UNION ALL SELECT 'spike_metrics', count(*), {r('sum(n_signals)', 'total', 6)} FROM sdays
UNION ALL SELECT 'input_stats', count(*), {r('sum(rate_x1)', 'total', 6)} FROM ins JOIN jobs USING (model, seed, w_snn)
UNION ALL SELECT 'health', count(*), {r('sum(n_signals)', 'total', 6)} FROM mm
UNION ALL SELECT 'performance', count(*), {r('sum(accumulated_return)', 'total', 6)} FROM srows"""


@query("s10_result_set", _RESULT_SQL, digits=6)
def s10_results(spark, sf):
    """All result tables of the experiment, written in one commit and read back: rows and a total of each."""
    x, scored = _scored_experiment(spark, sf)
    place = result_store(spark, scratch_path(spark, "results"))
    commit_results(place, x, job_input_stats(scored, x.jobs), "e1")
    totals = {
        "signals": "bar_idx", "trades": "net_return", "daily": "pnl", "spike_metrics": "n_signals", "input_stats": "rate_x1", "health": "n_signals",
        "performance": "accumulated_return",
    }
    out = None
    for table, column in totals.items():
        part = place.load(table).filter("experiment = 'e1'").agg(F.lit(table).alias("result"), F.count("*").alias("n_rows"), F.sum(F.col(column).cast("double")).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out.select("result", "n_rows", "total")


@query("k5_naive_daily", EXPERIMENT + f"SELECT job, rule, latency_ms, CAST(rep AS INTEGER) AS rep, day, {_DAILY} FROM nd")
def k5(spark, sf):
    return experiment(spark, sf).naive_daily()


@query(
    "k8_naive_performance",
    EXPERIMENT + f"SELECT job, rule, latency_ms, {_PERF}, {rs(*[c + '_std' for c in K.PERFORMANCE], digits=6)}, reps FROM nperf",
    digits=6,
)
def k8(spark, sf):
    return K.naive_performance(experiment(spark, sf).naive_daily(), ["job", "rule", "latency_ms"])


@query("k9_big_move_benchmark", EXPERIMENT + "SELECT job, symbol, day, num, bar_idx FROM big")
def k9(spark, sf):
    return experiment(spark, sf).big


_D8 = "n_trades, n_pos, n_neg, pnl, sum_pos, sum_neg".split(", ")


@query("k10_daily_by_source", EXPERIMENT + f"SELECT job, rule, latency_ms, source, day, {rs(*_D8)} FROM daily")
def k10_daily(spark, sf):
    rows = experiment(spark, sf).daily()
    return rows.withColumns({c: F.col(c).cast("double") for c in _D8})


@query("k10_strategy_rows", EXPERIMENT + f"SELECT job, model, w_snn, w_h, seed, rule, latency_ms, source, {_PERF} FROM srows JOIN jobs USING (job)", digits=6)
def k10_strategy(spark, sf):
    return experiment(spark, sf).strategy_rows()


_MR = rs(*K.METRICS)


@query("k10_spike_rows", EXPERIMENT + f"SELECT job, model, w_snn, w_h, seed, split, source, {_MR} FROM spk JOIN jobs USING (job)")
def k10_spikes(spark, sf):
    return experiment(spark, sf).spike_rows()


@query("l7_split_metrics", EXPERIMENT + f"SELECT job, split, source, day, test_day, {_MR} FROM sdays")
def l7(spark, sf):
    rows = experiment(spark, sf).spike_days()
    return rows.select("job", "split", "source", "day", "test_day", *[F.col(c).cast("double").alias(c) for c in K.METRICS])


_A1 = f"""SELECT model, w_snn, w_h, split, source, count(DISTINCT seed) AS seeds, {r('avg(accuracy)', 'spike_accuracy')}, {r('stddev_samp(accuracy)', 'spike_accuracy_std')},
  {r('avg(base_accuracy)', 'chance_level')}, {r('avg(momentum_pct)', 'momentum_pct')}, {r('avg(base_momentum_pct)', 'momentum_base_pct')},
  {r('avg(n_signals)', 'spikes_per_day')}, {r('avg(signal_rate)', 'signal_rate')} FROM spk JOIN jobs USING (job) GROUP BY model, w_snn, w_h, split, source"""


@query("a1_spike_table", EXPERIMENT + _A1)
def a1(spark, sf):
    return K.spike_table(experiment(spark, sf).spike_rows())


@query(
    "a2_strategy_table",
    EXPERIMENT + f"""SELECT model, w_snn, w_h, rule, latency_ms, source, count(DISTINCT seed) AS seeds, {', '.join(r(f'avg({c})', c, 6) for c in K.TABLE_METRICS)},
  {', '.join(r(f'stddev_samp({c})', c + '_std', 6) for c in K.TABLE_METRICS)} FROM srows JOIN jobs USING (job) GROUP BY model, w_snn, w_h, rule, latency_ms, source""",
    digits=6,
)
def a2(spark, sf):
    return K.strategy_table(experiment(spark, sf).strategy_rows())


@query(
    "a3_model_split_summary",
    EXPERIMENT + f"""SELECT model, split, count(DISTINCT day) AS days, {r('avg(accuracy)', 'spike_accuracy')}, {r('avg(base_accuracy)', 'chance_level')},
  {r('avg(momentum_pct)', 'momentum_pct')}, {r('avg(base_momentum_pct)', 'momentum_base_pct')}, {r('avg(n_signals)', 'spikes_per_day')},
  {r('avg(signal_rate)', 'signal_rate')}, count(*) FILTER (NOT signal_rate BETWEEN 0.05 AND 0.2) AS health_warnings
  FROM sdays JOIN jobs USING (job) WHERE source = 'model' GROUP BY model, split""",
)
def a3(spark, sf):
    x = experiment(spark, sf)
    rows = L.output_health(x.spike_days().filter("source = 'model'"), 0.05, 0.2).join(x.jobs, "job")
    return K.model_split_summary(rows)


@query(
    "a4_report_order",
    EXPERIMENT + f"""SELECT row_number() OVER (ORDER BY model, CASE source WHEN 'model' THEN 1 WHEN 'naive' THEN 2 ELSE 3 END) AS position, * FROM (
  SELECT model, source, {r('avg(accuracy)', 'accuracy')} FROM spk JOIN jobs USING (job) WHERE split = 'test' GROUP BY model, source)""",
)
def a4(spark, sf):
    rows = experiment(spark, sf).spike_rows().filter("split = 'test'").groupBy("model", "source").agg(F.avg("accuracy").alias("accuracy"))
    return K.in_report_order(rows, "model").select("model", "source", "accuracy", _position().alias("position"))


def _position():
    """Report position (six rows: models in name order, three sources each)."""
    from pyspark.sql.window import Window

    return F.row_number().over(Window.orderBy("model", K.source_rank()))


# --------------------------------------------------------------------------- tuning

_GRID = {"new_mean": (0.05, 0.1, 0.2, 0.3), "new_std": (0.05, 0.1, 0.2), "rate": (0.05, 0.1, 0.2)}
_TRIALS = f"""pts AS (SELECT (i * 3 + j) * 3 + k AS point, [0.05, 0.1, 0.2, 0.3][i + 1]::DOUBLE AS new_mean, [0.05, 0.1, 0.2][j + 1]::DOUBLE AS new_std, [0.05, 0.1, 0.2][k + 1]::DOUBLE AS rate
  FROM (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS i), (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS j), (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS k)),
drawn AS (SELECT * FROM pts ORDER BY {S.uniform("'trial'", "5", "point")}, point LIMIT 8),
trials AS (SELECT *, format('t{{:03d}}', row_number() OVER (ORDER BY point) - 1) AS trial FROM drawn)"""
_TT = S.chain(S.LABELS, S.folds(1), S.SCOPED, f"xs AS (SELECT *, d AS x1, -d AS x2 FROM dd), zst AS ({S.fold_stats(['x1', 'x2'], 'xs')})", _TRIALS) + """,
zi AS (SELECT t.trial, t.rate, x.symbol, x.day, x.num, x.bar_idx, s.test_day, s.split, round(
    CASE WHEN x1 IS NULL THEN 0.0 ELSE greatest(least((x1 - mean_x1) / std_x1 * new_std + new_mean, 1.0), 0.0) END +
    CASE WHEN x2 IS NULL THEN 0.0 ELSE greatest(least((x2 - mean_x2) / std_x2 * new_std + new_mean, 1.0), 0.0) END, 9) AS score
  FROM xs x JOIN scoped s USING (day) JOIN zst USING (symbol, num, w_snn, test_day), trials t),
rk AS (SELECT *, row_number() OVER (PARTITION BY trial, test_day, symbol, num ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY trial, test_day, symbol, num) AS m FROM zi WHERE split = 'train'),
lm AS (SELECT trial, test_day, symbol, num, max(score) FILTER (i = floor((m - 1) * (1 - rate))) AS lo, max(score) FILTER (i = ceil((m - 1) * (1 - rate))) AS hi,
  max((m - 1) * (1 - rate)) AS pos FROM rk GROUP BY ALL),
sg AS (SELECT zi.* FROM zi JOIN lm USING (trial, test_day, symbol, num) WHERE split = 'test' AND score > lo + (hi - lo) * (pos - floor(pos))),
dm AS (SELECT t.trial, b.day, max(base_accuracy) AS chance, count(l.bar_idx) / max(n_bars) AS rate, count(*) FILTER (real) / nullif(count(*) FILTER (evaluable), 0) AS accuracy
  FROM trials t CROSS JOIN (SELECT base.* FROM base JOIN (SELECT DISTINCT test_day FROM folds) ON test_day = base.day) b
  LEFT JOIN (SELECT sg.trial, lab.* FROM sg JOIN lab USING (symbol, day, num, bar_idx)) l ON l.trial = t.trial AND l.day = b.day GROUP BY t.trial, b.day),
tab AS (SELECT trials.*, accuracy, chance, signal_rate, unhealthy_share, folds, (accuracy - chance) * 100 AS edge_pp FROM trials JOIN (
  SELECT trial, avg(accuracy) AS accuracy, avg(chance) AS chance, avg(rate) AS signal_rate, avg(CAST(NOT rate BETWEEN 0.001 AND 0.5 AS INTEGER)) AS unhealthy_share, count(*) AS folds
  FROM dm GROUP BY trial) USING (trial))
"""
_TCOLS = f"trial, point, new_mean, new_std, rate, folds, {rs('accuracy', 'chance', 'signal_rate', 'unhealthy_share', 'edge_pp')}"


def _trials(spark):
    return T.sample_trials(T.grid_points(spark, _GRID), 8, 5)


def _table(spark, sf):
    d, folds, trials = C.bar_table(spark, sf), C.folds(spark, sf, 1), _trials(spark)
    return T.trial_table(L.bar_labels(d), T.trial_signals(d, folds, trials), trials, folds)


@query("k11_trial_signals", _TT + "SELECT trial, symbol, day, num, bar_idx, score FROM sg", digits=9)
def k11(spark, sf):
    """Sampled grid points and the signals each one gives on the test days."""
    signals = T.trial_signals(C.bar_table(spark, sf), C.folds(spark, sf, 1), _trials(spark))
    return signals.filter("split = 'test'").select("trial", *BAR, "score")


@query("k12_trial_table", _TT + f"SELECT {_TCOLS} FROM tab")
def k12(spark, sf):
    return _table(spark, sf)


@query("k12_best_trial", _TT + f"SELECT {_TCOLS} FROM (SELECT * FROM tab WHERE unhealthy_share <= 0.3 AND accuracy IS NOT NULL ORDER BY accuracy DESC, trial LIMIT 1)")
def k12_best(spark, sf):
    return T.best_trial(_table(spark, sf), 0.3)


@query(
    "k13_ranked_trials",
    _TT + f"SELECT {_TCOLS}, unhealthy_share <= 0.3 AS admissible FROM tab ORDER BY admissible DESC, accuracy DESC NULLS LAST, trial",
)
def k13(spark, sf):
    return T.ranked_trials(_table(spark, sf), 0.3)
