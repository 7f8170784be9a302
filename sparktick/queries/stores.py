"""Sources and sinks (S): files and tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktick.functions.columns import idiv, to_ns
from sparktick.operators import bars as B
from sparktick.operators import excitation as H
from sparktick.operators.quality import days_of
from sparktick.operators.fit import few_steps as few_em_steps
from sparktick.plans import backtest as K
from sparktick.plans.incremental import ensure_bars, ensure_theta, fit_settings, theta_keys
from sparktick.queries import backtests as BQ
from sparktick.queries import common as C
from sparktick.queries import sql as S
from sparktick.queries.registry import query, r, rs
from sparktick.schemas import BAR, DAY, RAW_AGG_TRADES, RAW_TRADES, THETA
from sparktick.session import materialise, scratch_path
from sparktick.sources import files, keyed, store
from sparktick.sources.synthetic import random_walk
from sparktick.sources.tables import table


def _csv_folder(spark, sf, dataset: str, header: bool) -> str:
    """The trades written as CSV folders named like the exchange's files, millisecond times."""
    t = C.trades(spark, sf)
    text = lambda c: F.col(c).cast("string")
    ms = idiv(F.col("ts_ns"), 1_000_000).cast("string")
    if dataset == "aggTrades":
        names, cols = RAW_AGG_TRADES, [text("trade_id"), text("price"), text("qty"), text("trade_id"), text("trade_id"), ms, text("is_buyer_maker")]
    else:
        maker = F.when(F.col("is_buyer_maker"), "True").otherwise("false")
        names, cols = RAW_TRADES, [text("trade_id"), text("price"), text("qty"), (F.col("price") * F.col("qty")).cast("string"), ms, maker]
    file = F.concat_ws("-", "symbol", F.lit(dataset), F.concat(F.col("day").cast("string"), F.lit(".csv")))
    path = scratch_path(spark, "csv")
    t.select(*[c.alias(n) for n, c in zip(names, cols)], file.alias("file")).write.partitionBy("file").csv(path, header=header)
    return path


_PARSED = "WITH " + S.trades() + f"SELECT symbol, day, ts_ns // 1000000 * 1000000 AS ts_ns, {rs('price', 'qty')}, maker AS is_buyer_maker, trade_id FROM tr"


@query("s1_parse_agg_trades", _PARSED)
def s1(spark, sf):
    return files.read_trade_csv(spark, _csv_folder(spark, sf, "aggTrades", True), "aggTrades")


@query("s1_parse_trades_no_header", _PARSED)
def s1_plain(spark, sf):
    return files.read_trade_csv(spark, _csv_folder(spark, sf, "trades", False), "trades")


@query("s2_timestamp_units", "WITH " + S.trades() + "SELECT trade_id, ts_ns // 1000000 * 1000000 AS from_ms, ts_ns // 1000 * 1000 AS from_us, ts_ns AS from_ns FROM tr")
def s2(spark, sf):
    ns = F.col("ts_ns")
    return C.trades(spark, sf).select(
        "trade_id", to_ns(idiv(ns, 1_000_000)).alias("from_ms"), to_ns(idiv(ns, 1_000)).alias("from_us"), to_ns(ns).alias("from_ns")
    )


@query(
    "s3_checksums",
    """SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha256, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS ok FROM documents""",
)
def s3(spark, sf):
    """Whole document texts as files; every fifth sum is wrong, every seventh is missing."""
    docs = table(spark, sf, "documents")
    content = docs.select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    lines = docs.filter("doc_id % 7 <> 0").select(F.concat_ws("  ", F.sha2(body, 256), F.col("doc_id").cast("string")).alias("text"))
    return files.verify_checksums(content, lines)


@query(
    "s4_local_files",
    "WITH " + S.trades() + "SELECT symbol, day, count(*) AS n_trades, min(ts_ns) // 1000000 * 1000000 AS first_ts_ns FROM tr GROUP BY ALL",
)
def s4(spark, sf):
    """Half of the days from CSV, half from parquet files, found by name."""
    t = files.read_trade_csv(spark, _csv_folder(spark, sf, "aggTrades", True), "aggTrades")
    path = scratch_path(spark, "parquet")
    odd = F.dayofmonth("day") % 2 == 1
    file = F.concat_ws("-", "symbol", F.lit("aggTrades"), F.concat(F.col("day").cast("string"), F.lit(".parquet")))
    t.filter(odd).withColumn("file", file).drop("symbol", "day").write.partitionBy("file").parquet(path)
    both = t.filter(~odd).unionByName(files.read_trade_parquet(spark, path, "aggTrades"))
    return both.groupBy(*DAY).agg(F.count("*").alias("n_trades"), F.min("ts_ns").alias("first_ts_ns"))


def _gauss(*keys: str) -> str:
    a, b = S.uniform(*keys, "'a'"), S.uniform(*keys, "'b'")
    return f"(sqrt(-2.0 * ln(1.0 - {a})) * cos(2.0 * pi() * {b}))"


_KEYS = ("'11'", "symbol", "day", "seq")
_WALK = "WITH " + S.trades() + f""", g AS (SELECT symbol, day, seq, ts_ns, 0.5 * {_gauss(*_KEYS, "'step'")} AS step, {S.uniform(*_KEYS, "'side'")} AS side,
  {_gauss(*_KEYS, "'size'")} AS size, {S.uniform(*_KEYS, "'maker'")} < 0.5 AS is_buyer_maker FROM seqd)
"""


@query(
    "s5_random_walk",
    _WALK + f"""SELECT symbol, day, ts_ns, {r('100000.0 + sum(step) OVER (PARTITION BY symbol, day ORDER BY seq) + CASE WHEN side < 0.5 THEN 0.05 ELSE -0.05 END', 'price', 6)},
  {r('exp(-3.0 + 1.5 * size)', 'qty', 6)}, is_buyer_maker, seq AS trade_id FROM g""",
    digits=6,
)
def s5(spark, sf):
    """A random walk with exactly the days, times and trade counts of the real trades."""
    slots = B.numbered_trades(C.trades(spark, sf)).select("symbol", "day", "seq", "ts_ns")
    return random_walk(slots, 11)


@query(
    "s6_trade_store",
    "WITH " + S.trades() + f"SELECT day, symbol, ts_ns, {rs('price', 'qty')}, maker AS is_buyer_maker, trade_id FROM tr",
)
def s6(spark, sf):
    """Written per venue / symbol / dataset / day; ten days are written again and replace only themselves."""
    path = scratch_path(spark, "trades")
    t = C.trades(spark, sf)
    store.save_trades(t, path, "venue", "aggTrades")
    store.save_trades(t.filter(F.dayofmonth("day") <= 10), path, "venue", "aggTrades")
    back = store.load(spark, path, "venue = 'venue' and dataset = 'aggTrades'")
    return back.select("day", "symbol", "ts_ns", "price", "qty", "is_buyer_maker", "trade_id")


@query("s7_bar_store", S.chain() + f"SELECT day, bar_idx, {rs('vwap')}, n_trades FROM bars")
def s7(spark, sf):
    path = scratch_path(spark, "bars")
    store.save_bars(C.bars(spark, sf), path)
    return store.load(spark, path, "symbol = 'ALL' and num = 4").select("day", "bar_idx", "vwap", "n_trades")


_SIG = "SELECT CAST(bar_idx % 2 AS INTEGER) AS seed, day, bar_idx FROM dd WHERE abs(d) > 60"


def _signals(spark, sf):
    d = C.diffs(spark, sf).filter(F.abs("d") > 60)
    return d.select(
        F.lit("fixed").alias("model"), F.lit(1).alias("w_snn"), F.lit(None).cast("int").alias("w_h"), (F.col("bar_idx") % 2).cast("int").alias("seed"), *BAR
    )


@query("s8_signal_store", S.chain() + _SIG)
def s8(spark, sf):
    path = scratch_path(spark, "signals")
    store.save_signals(_signals(spark, sf), path)
    return store.load(spark, path, "model = 'fixed'").select("seed", "day", "bar_idx")


_THETA = [*H.MU, *H.ALPHA, *H.BETA, "mark_scale_u", "mark_scale_d", "event_threshold"]


def few_steps(fit_set, head):
    return few_em_steps(fit_set, H.given_theta(head, S.ALPHA, S.BETA), S.EM_STEPS)


def stored_theta(spark, d, *wanted):
    """A theta store into which each frame of wanted keys was put in turn, and how many keys each of them still needed."""
    place = keyed.theta_store(spark, scratch_path(spark, "theta"), fit_settings(S.QUANTILE, em_steps=S.EM_STEPS))
    return place, [ensure_theta(place, d, keys, S.QUANTILE, fit=few_steps) for keys in wanted]


@query(
    "s9_theta_store",
    S.chain(S.events(), S.theta((1, 2))) + f"SELECT symbol, num, w_h, day, {rs(*_THETA)}, n_up + n_down AS n_events FROM theta",
)
def s9(spark, sf):
    """Theta by settings, window and day: one window's keys first, then both windows', of which only the new ones are fitted."""
    d = C.bar_table(spark, sf)
    keys = lambda *spans: H.fit_windows(C.theta_days(spark, sf), spans).join(d.select("symbol", "num").distinct()).select(*H.FIT)
    place, _ = stored_theta(spark, d, keys(1), keys(1, 2))
    return H.theta_from_json(place.load("theta").select(*H.FIT, "json"), THETA).select(*H.FIT, *_THETA, "n_events")


_SINK = S.chain(S.LABELS) + "SELECT 'e1' AS experiment, 'fixed__momentum__Wsnn1__seed0' AS run_id, "


def _day_rows(spark, sf):
    from sparktick.operators import labels as L

    base = L.day_base(L.bar_labels(C.bars(spark, sf))).select("day", "n_bars", F.round("base_accuracy", 8).alias("base_accuracy"))
    return base.withColumns({"experiment": F.lit("e1"), "run_id": F.lit("fixed__momentum__Wsnn1__seed0")})


def _sink(fmt: str):
    def run(spark, sf):
        path = scratch_path(spark, fmt)
        store.save_result(_day_rows(spark, sf), path, fmt)
        reader = spark.read.schema("day date, n_bars long, base_accuracy double, experiment string, run_id string")
        return (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(path)

    return run


for _fmt in ("parquet", "csv", "json"):
    query(f"s10_result_{_fmt}", _SINK + f"day, n_bars, {rs('base_accuracy')} FROM base")(_sink(_fmt))


@query(
    "s11_trades_to_keep",
    S.chain(S.RULES, S.ENTRIES) + """SELECT CAST(s.bar_idx % 2 AS INTEGER) AS seed, s.day, s.bar_idx, rule, entry_bar FROM dd s JOIN surf USING (symbol, day, num, bar_idx)
  WHERE abs(s.d) > 60 AND latency_ms = 0 AND rule = 'momentum' AND s.bar_idx % 2 = 0""",
)
def s11(spark, sf):
    from sparktick.functions.rules import momentum
    from sparktick.operators.execution import return_surface

    surface = return_surface(C.bars(spark, sf), [momentum()])
    trades = _signals(spark, sf).join(surface, BAR)
    return store.trades_to_keep(trades, "first_seed").select("seed", "day", "bar_idx", "rule", "entry_bar")



@query("s12_multi_run_scan", BQ.EXPERIMENT + f"SELECT 'e1' AS experiment, replace(job, '__Wsnn', '__' || rule || '__Wsnn') AS run_id, latency_ms, source, day, {rs('pnl')} FROM daily WHERE job LIKE 'zscore%' AND rule = 'momentum'")
def s12(spark, sf):
    """Daily results of all runs stored by run; one model and rule read back."""
    x = BQ.experiment(spark, sf)
    rows = x.daily().join(x.jobs, "job").withColumns({"experiment": F.lit("e1"), "run_id": K.run_id(F.col("rule"))})
    path = scratch_path(spark, "daily")
    store.save_result(rows.select("experiment", "run_id", "latency_ms", "source", "day", "pnl"), path)
    return store.model_results(spark, path, "zscore", "momentum").select("experiment", "run_id", "latency_ms", "source", "day", "pnl")


@query("s13_summary_csv", S.chain(S.LABELS) + f"SELECT symbol, count(*) AS days, {r('avg(base_accuracy)', 'base_accuracy')} FROM base GROUP BY symbol")
def s13(spark, sf):
    from sparktick.operators import labels as L

    base = L.day_base(L.bar_labels(C.bars(spark, sf)))
    rows = base.groupBy("symbol").agg(F.count("*").alias("days"), F.round(F.avg("base_accuracy"), 8).alias("base_accuracy"))
    path = scratch_path(spark, "summary")
    store.save_summary(rows, path)
    return spark.read.schema("symbol string, days long, base_accuracy double").csv(path, header=True)


# --------------------------------------------------------------------------- runs that go on where earlier ones stopped

_NEEDED = """need AS (SELECT DISTINCT w_h, w_snn, x.day FROM (SELECT unnest([1, 2]) AS w_h),
  (SELECT w_snn, train_day AS day FROM folds UNION SELECT w_snn, test_day FROM folds) x)"""


def _keys_of(spark, sf, d, spans, windows):
    jobs = K.signal_jobs(K.run_grid(spark, {"excited": True}, ["momentum"], windows, spans, [0]))
    return theta_keys(jobs, C.folds(spark, sf, *windows), d)


@query(
    "k4_theta_days_left",
    S.chain(S.folds(1, 3), _NEEDED) + "SELECT DISTINCT 'ALL' AS symbol, CAST(4 AS BIGINT) AS num, w_h, day FROM need WHERE (w_h, day) NOT IN (SELECT (w_h, day) FROM need WHERE w_h = 1 AND w_snn = 1)",
)
def k4_left(spark, sf):
    """After a run over one window: theta keys that a run over all windows still has to fit, read off the store."""
    d = C.bar_table(spark, sf)
    place, _ = stored_theta(spark, d, _keys_of(spark, sf, d, (1,), (1,)))
    return place.missing(_keys_of(spark, sf, d, (1, 2), (1, 3)))


@query(
    "q6_runs_go_on",
    S.chain(S.folds(1, 3), _NEEDED) + """, first_run AS (SELECT count(DISTINCT (w_h, day)) AS n FROM need WHERE w_h = 1 AND w_snn = 1),
all_runs AS (SELECT count(DISTINCT (w_h, day)) AS n FROM need)
SELECT CAST(1 AS INTEGER) AS run, n AS computed FROM first_run UNION ALL SELECT 2, a.n - f.n FROM all_runs a, first_run f UNION ALL SELECT 3, CAST(0 AS BIGINT) FROM all_runs""",
)
def q6_runs(spark, sf):
    """How many theta keys three runs compute: one window, all windows, all windows again."""
    d = C.bar_table(spark, sf)
    every = materialise(_keys_of(spark, sf, d, (1, 2), (1, 3)), "theta-keys")
    _, counts = stored_theta(spark, d, _keys_of(spark, sf, d, (1,), (1,)), every, every)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(counts)], "run int, computed long")


@query(
    "s7_bars_go_on",
    S.chain() + f"""
SELECT day, count(*) AS n_bars, {r('sum(vwap)', 'total', 6)}, {r('sum(d)', 'moved', 6)} FROM dd GROUP BY day""",
    digits=6,
)
def s7_go_on(spark, sf):
    """Bars of the test days of all folds, then of every day up to three days after the last: only missing days are aggregated."""
    place = keyed.bar_store(spark, scratch_path(spark, "bars"))
    t = C.trades(spark, sf)
    of_all = lambda days: days.select(F.lit("ALL").alias("symbol"), "day")
    ensure_bars(place, t, S.NUM, of_all(C.test_days(spark, sf)))
    ensure_bars(place, t, S.NUM, of_all(days_of(t, 0, 3)))
    return place.load("bars").groupBy("day").agg(F.count("*").alias("n_bars"), F.sum("vwap").alias("total"), F.sum("d").alias("moved"))
