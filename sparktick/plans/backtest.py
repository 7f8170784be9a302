"""Walk-forward backtest: runs, folds, signals, benchmarks, daily results and result tables.

Every stage is a table keyed by (job, day, ...), where a job is one (model, w_snn, w_h, seed). A job's signals are
computed once and shared by all rules and latencies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktick.functions.columns import ratio
from sparktick.functions.rules import Rule
from sparktick.operators.bars import day_sizes
from sparktick.operators.labels import METRICS, day_metrics, output_health
from sparktick.operators.signals import big_moves, dealt, random_bars, signal_rates
from sparktick.schemas import BAR, BAR_DAY
from sparktick.session import materialise

JOB = ["model", "w_snn", "w_h", "seed"]
DAILY = ["pnl", "n_trades", "n_pos", "sum_pos", "n_neg", "sum_neg"]
PERFORMANCE = [
    "accumulated_return", "annualized_volatility", "sharpe", "win_rate", "profit_loss_ratio", "trades_per_day", "mean_daily_pnl",
]


# --------------------------------------------------------------------------- runs, jobs, folds


def _each(values: Sequence, kind: str) -> Column:
    return F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))


def run_grid(
    spark: SparkSession, models: dict[str, bool], rules: Sequence[str], w_snn: Sequence[int], w_h: Sequence[int], seeds: Sequence[int]
) -> DataFrame:
    """All runs: models x rules x w_snn x (w_h where the model uses excitation, else NULL) x seeds, with ids."""
    rows = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(uses).alias("excited")) for m, uses in models.items()
    ])).alias("_m")).select("_m.*")
    rows = rows.withColumn("rule", _each(rules, "string")).withColumn("w_snn", _each(w_snn, "int"))
    spans = F.when(F.col("excited"), F.array(*[F.lit(w).cast("int") for w in w_h])).otherwise(F.array(F.lit(None).cast("int")))
    rows = rows.withColumn("w_h", F.explode(spans)).withColumn("seed", _each(seeds, "int"))
    return rows.select(*JOB, "rule", run_id(F.col("rule")).alias("run_id"), job_id().alias("job"))


def _windows() -> list[Column]:
    return [
        F.concat(F.lit("Wsnn"), F.col("w_snn").cast("string")), F.concat(F.lit("Wh"), F.col("w_h").cast("string")),
        F.concat(F.lit("seed"), F.col("seed").cast("string")),
    ]


def run_id(rule: Column) -> Column:
    """`model__rule__WsnnA[__WhB]__seedC`; the part for a NULL window is left out."""
    return F.concat_ws("__", F.col("model"), rule, *_windows())


def job_id() -> Column:
    return F.concat_ws("__", F.col("model"), *_windows())


def settings_id(*columns: str) -> Column:
    """Short stable hash of everything that determines the signals."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12)


def signal_jobs(runs: DataFrame) -> DataFrame:
    """Runs that differ only in the rule share one job."""
    return runs.groupBy(*JOB, "job").agg(F.sort_array(F.collect_list("rule")).alias("rules"))


def walk_forward(test_days: DataFrame, windows: Sequence[int]) -> DataFrame:
    """(w_snn, test_day, train_day): the w_snn days before each test day."""
    wide = test_days.select(F.col("day").alias("test_day"), _each(windows, "int").alias("w_snn"))
    before = F.sequence(F.expr("date_sub(test_day, w_snn)"), F.date_sub("test_day", 1))
    return wide.select("w_snn", "test_day", F.explode(before).alias("train_day"))


def fit_days_needed(jobs: DataFrame, folds: DataFrame) -> DataFrame:
    """Distinct (w_h, day) whose theta is needed: train and test days of all folds of excitation jobs."""
    used = jobs.filter("w_h is not null").select("w_h", "w_snn").distinct().join(folds, "w_snn")
    train = used.select("w_h", F.col("train_day").alias("day"))
    return train.unionByName(used.select("w_h", F.col("test_day").alias("day"))).distinct()


# --------------------------------------------------------------------------- benchmarks


def job_rates(signals: DataFrame, job_days: DataFrame, sizes: DataFrame) -> DataFrame:
    """Signal rate per (job, test day); `job_days(job, w_snn, seed, symbol, day, num)`."""
    rates = signal_rates(signals, ["job"], job_days, sizes)
    return rates.join(job_days.select("job", "w_snn", "seed").distinct(), "job")


def big_move_signals(diffs: DataFrame, folds: DataFrame, rates: DataFrame) -> DataFrame:
    """Big moves of each job's test day at the job's own rate that day."""
    return big_moves(diffs, folds, rates.withColumnRenamed("day", "test_day"), ["job"]).select("job", *BAR)


def naive_signals(rates: DataFrame, rules: Sequence[Rule], reps: int, delay: int = 1) -> DataFrame:
    """Random-timing samples (job, rule, rep, day, bar): as many as the job's signals that day.

    A sample depends on the seed, not on the job, so jobs of one seed share the draws of the one with most signals that day.
    """
    wants = rates.groupBy("seed", *BAR_DAY, "n_bars").agg(
        F.max("n_signals").alias("n_signals"), F.collect_list(F.struct("job", F.col("n_signals").alias("n"))).alias("_jobs")
    )
    wants = materialise(wants, "wants")
    drawn = random_bars(dealt(wants.drop("_jobs"), ()), ["seed", "n_bars"], reps, {r.name: r.history for r in rules}, delay, place="_place")
    each = wants.select("seed", *BAR_DAY, "n_bars", F.explode("_jobs").alias("_job"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"j.{c}")) for c in ("seed", *BAR_DAY, "n_bars")]
    taken = drawn.alias("d").join(each.alias("j"), [*same, F.col("d._place") < F.col("j._job.n")])
    return taken.select("j._job.job", "d.rule", "d.rep", *[f"d.{c}" for c in BAR])


# --------------------------------------------------------------------------- daily results and performance


def daily_results(trades: DataFrame, keys: Sequence[str], spine: DataFrame) -> DataFrame:
    """pnl and win / loss sums per (keys, day) over all symbols; `spine` lists every wanted (keys, day), empty days count as 0."""
    r = F.col("net_return")
    group = [*keys, "day"]
    sums = trades.groupBy(*group).agg(
        F.sum(r).alias("pnl"), F.count("*").alias("n_trades"), F.count_if(r > 0).alias("n_pos"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("sum_pos"), F.count_if(r < 0).alias("n_neg"),
        F.sum(F.when(r < 0, r).otherwise(0.0)).alias("sum_neg"),
    )
    return spine.select(*group).distinct().join(sums, group, "left").select(*group, *[F.coalesce(c, F.lit(0)).alias(c) for c in DAILY])


def performance(daily: DataFrame, keys: Sequence[str], days_per_year: int = 365) -> DataFrame:
    """Result metrics per group from daily rows; undefined ratios are NULL."""
    year = days_per_year**0.5
    std = F.stddev_samp("pnl")
    pos, neg, n = F.sum("n_pos"), F.sum("n_neg"), F.sum("n_trades")
    return daily.groupBy(*keys).agg(
        F.sum("pnl").alias("accumulated_return"), (std * year).alias("annualized_volatility"),
        (ratio(F.avg("pnl"), std) * year).alias("sharpe"), ratio(pos, n).alias("win_rate"),
        ratio(ratio(F.sum("sum_pos"), pos), ratio(F.abs(F.sum("sum_neg")), neg)).alias("profit_loss_ratio"),
        (n / F.count("*")).alias("trades_per_day"), F.avg("pnl").alias("mean_daily_pnl"), F.count("*").alias("n_days"),
        n.alias("n_trades"),
    )


def naive_performance(rep_daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics per repetition, then their mean and sample std over repetitions."""
    per_rep = performance(rep_daily, [*keys, "rep"])
    means = [F.avg(c).alias(c) for c in PERFORMANCE]
    return per_rep.groupBy(*keys).agg(*means, *[F.stddev_samp(c).alias(f"{c}_std") for c in PERFORMANCE], F.count("*").alias("reps"))


def mean_over_reps(rep_daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily rows of the average repetition."""
    return rep_daily.groupBy(*keys, "day").agg(*[F.avg(c).alias(c) for c in DAILY])


def with_reps(spine: DataFrame, reps: int) -> DataFrame:
    return spine.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def with_trading(job_days: DataFrame, rules: Sequence[Rule], latencies_ms: Sequence[float]) -> DataFrame:
    return job_days.withColumn("rule", _each([r.name for r in rules], "string")).withColumn(
        "latency_ms", _each(latencies_ms, "double")
    )


# --------------------------------------------------------------------------- summaries


def spike_summary(per_day: DataFrame) -> DataFrame:
    """One row per (job, split, source): means of the daily metrics over days."""
    return per_day.groupBy("job", "split", "source").agg(*[F.avg(c).alias(c) for c in METRICS])


def naive_metrics(labels: DataFrame, samples: DataFrame, spine: DataFrame, reps: int, rule: str) -> DataFrame:
    """Daily metrics of the random samples of one rule, averaged over repetitions."""
    one = samples.filter(F.col("rule") == rule)
    per_rep = day_metrics(labels, one, ["job", "rep"], with_reps(spine, reps))
    return per_rep.groupBy("job", *BAR_DAY).agg(*[F.avg(c).alias(c) for c in METRICS])


def spike_table(rows: DataFrame) -> DataFrame:
    """Means over seeds by (model, w_snn, w_h, split, source); NULL windows stay a group."""
    return rows.groupBy("model", "w_snn", "w_h", "split", "source").agg(
        F.count_distinct("seed").alias("seeds"), F.avg("accuracy").alias("spike_accuracy"),
        F.stddev_samp("accuracy").alias("spike_accuracy_std"), F.avg("base_accuracy").alias("chance_level"),
        F.avg("momentum_pct").alias("momentum_pct"), F.avg("base_momentum_pct").alias("momentum_base_pct"),
        F.avg("n_signals").alias("spikes_per_day"), F.avg("signal_rate").alias("signal_rate"),
    )


TABLE_METRICS = PERFORMANCE[:6]


def strategy_table(rows: DataFrame) -> DataFrame:
    """Mean and std over seeds of six metrics by (model, w_snn, w_h, rule, latency, source)."""
    return rows.groupBy("model", "w_snn", "w_h", "rule", "latency_ms", "source").agg(
        F.count_distinct("seed").alias("seeds"), *[F.avg(c).alias(c) for c in TABLE_METRICS],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in TABLE_METRICS],
    )


def model_split_summary(rows: DataFrame) -> DataFrame:
    """By (model, split): days, mean metrics and the number of warnings."""
    return rows.groupBy("model", "split").agg(
        F.count_distinct("day").alias("days"), F.avg("accuracy").alias("spike_accuracy"), F.avg("base_accuracy").alias("chance_level"),
        F.avg("momentum_pct").alias("momentum_pct"), F.avg("base_momentum_pct").alias("momentum_base_pct"),
        F.avg("n_signals").alias("spikes_per_day"), F.avg("signal_rate").alias("signal_rate"),
        F.count_if(F.col("warnings") != "").alias("health_warnings"),
    )


SOURCE_ORDER = ("model", "naive", "big_move")


def source_rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))


def in_report_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Sorted by `columns`, sources in report order (model, naive, big_move)."""
    return rows.orderBy(*columns, source_rank())


# --------------------------------------------------------------------------- the whole experiment


class Experiment:
    """Tables of one experiment, each a lazy DataFrame built from the shared ones.

    Labels, returns, rates, big moves, random samples and the samples' daily results are written once, when the first table needs them:
    a table that needs none of one does not make it.

    `diffs` are bars with d, `labels` their spike labels, `surface` the per-bar returns of all rules and latencies (plans, both),
    `signals(job, split, test_day, bar...)` the models' output (any external signal table fits), `jobs` the job list.
    """

    def __init__(self, diffs, labels, surface, signals, jobs, folds, rules, latencies_ms, reps, delay: int = 1):
        self.diffs, self._labels, self._surface, self.folds = diffs, labels, surface, folds
        self.rules, self.latencies, self.reps, self.delay = rules, latencies_ms, reps, delay
        self.jobs = jobs.select("job", *JOB)
        self.test = signals.filter("split = 'test'").select("job", *BAR)
        self.train = signals.filter("split = 'train'").select("job", "test_day", *BAR)
        days = folds.select("w_snn", F.col("test_day").alias("day")).distinct()
        self.sizes = day_sizes(diffs)
        self.job_days = self.jobs.join(days, "w_snn").join(self.sizes.drop("n_bars"), "day")

    @cached_property
    def labels(self) -> DataFrame:
        return materialise(self._labels, "labels")

    @cached_property
    def surface(self) -> DataFrame:
        return materialise(self._surface, "returns")

    @cached_property
    def rates(self) -> DataFrame:
        return materialise(job_rates(self.test, self.job_days, self.sizes), "rates")

    @cached_property
    def big(self) -> DataFrame:
        return materialise(big_move_signals(self.diffs, self.folds, self.rates), "big-moves")

    @cached_property
    def naive(self) -> DataFrame:
        return materialise(naive_signals(self.rates, self.rules, self.reps, self.delay), "naive")

    @cached_property
    def _naive_daily(self) -> DataFrame:
        keys = ["job", "rule", "latency_ms", "rep"]
        trades = self.naive.join(self.surface, [*BAR, "rule"])
        spine = with_reps(with_trading(self.job_days, self.rules, self.latencies), self.reps)
        return materialise(daily_results(trades, keys, spine), "naive-daily")

    def daily(self, sources: Sequence[str] = ("model", "big_move", "naive_mean")) -> DataFrame:
        """Daily results of model and big-move trades, and of the mean naive repetition; only the wanted sources are made."""
        keys = ["job", "rule", "latency_ms"]
        spine = with_trading(self.job_days, self.rules, self.latencies)
        parts = []
        for source in sources:
            if source == "naive_mean":
                rows = mean_over_reps(self.naive_daily(), keys)
            else:
                signals = {"model": lambda: self.test, "big_move": lambda: self.big}[source]()
                rows = daily_results(signals.join(self.surface, BAR), keys, spine)
            parts.append(rows.withColumn("source", F.lit(source)))
        return reduce(DataFrame.unionByName, parts)

    def trades(self) -> DataFrame:
        """Every trade of the models' and the big moves' signals: one row for each rule and latency that takes the signal."""
        own = self.test.withColumn("source", F.lit("model")).unionByName(self.big.withColumn("source", F.lit("big_move")))
        return own.join(self.surface, BAR)

    def health(self) -> DataFrame:
        """Output health of every job and test day."""
        return output_health(day_metrics(self.labels, self.test, ["job"], self.job_days))

    def naive_daily(self) -> DataFrame:
        """Daily results of every random repetition."""
        return self._naive_daily

    def strategy_rows(self) -> DataFrame:
        """Performance per (job, rule, latency, source)."""
        keys = ["job", "rule", "latency_ms"]
        own = performance(self.daily(("model", "big_move")), [*keys, "source"])
        naive = naive_performance(self.naive_daily(), keys).withColumn("source", F.lit("naive"))
        cols = [*keys, "source", *PERFORMANCE]
        return own.select(*cols).unionByName(naive.select(*cols)).join(self.jobs, "job")

    def spike_days(self) -> DataFrame:
        """Daily metrics of every source and split; chance level from the first rule's random samples."""
        test = [
            day_metrics(self.labels, self.test, ["job"], self.job_days).withColumn("source", F.lit("model")),
            day_metrics(self.labels, self.big, ["job"], self.job_days).withColumn("source", F.lit("big_move")),
            naive_metrics(self.labels, self.naive, self.job_days, self.reps, self.rules[0].name).withColumn("source", F.lit("naive")),
        ]
        cols = ["job", *BAR_DAY, "source", *METRICS]
        out = test[0].select(*cols)
        for t in test[1:]:
            out = out.unionByName(t.select(*cols))
        out = out.withColumns({"split": F.lit("test"), "test_day": F.col("day")})
        spine = self.jobs.join(self.folds.withColumnRenamed("train_day", "day"), "w_snn").join(self.sizes.drop("n_bars"), "day")
        train = day_metrics(self.labels, self.train, ["job", "test_day"], spine)
        train = train.withColumns({"source": F.lit("model"), "split": F.lit("train")})
        return out.unionByName(train.select(*cols, "split", "test_day"))

    def spike_rows(self) -> DataFrame:
        return spike_summary(self.spike_days()).join(self.jobs, "job")
