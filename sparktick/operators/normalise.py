"""Normalisation of bar channels to input probabilities, and their Bernoulli expansion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktick.functions.columns import clip, share
from sparktick.functions.keyed import uniform
from sparktick.operators.spread import over_bars
from sparktick.schemas import BAR_DAY

FOLD = ["symbol", "num", "w_snn", "test_day"]


def fold_stats(rows: DataFrame, folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pooled n, mean and population std of each column over a fold's training days.

    Bars are reduced to one row per day first; folds then pool those rows, so overlapping training windows
    never copy bars. One row per fold: `n_c`, `mean_c`, `std_c`.
    """
    day_aggs, fold_aggs = [], []
    for c in columns:
        day_aggs += [F.count(c).alias(f"_n_{c}"), F.avg(c).alias(f"_m_{c}"), F.var_pop(c).alias(f"_v_{c}")]
        n, m, v = F.col(f"_n_{c}"), F.col(f"_m_{c}"), F.col(f"_v_{c}")
        total = F.sum(n)
        mean = F.sum(n * m) / total
        var = F.sum(n * (v + m * m)) / total - mean * mean
        fold_aggs += [total.alias(f"n_{c}"), mean.alias(f"mean_{c}"), F.sqrt(F.greatest(var, F.lit(0.0))).alias(f"std_{c}")]
    per_day = rows.groupBy(*BAR_DAY).agg(*day_aggs)
    return per_day.join(folds.withColumnRenamed("train_day", "day"), "day").groupBy(*FOLD).agg(*fold_aggs)


def fold_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold's training days (`split` = train) and test day (`split` = test)."""
    train = folds.select("w_snn", "test_day", F.col("train_day").alias("day"), F.lit("train").alias("split"))
    test = folds.select("w_snn", "test_day", F.col("test_day").alias("day"), F.lit("test").alias("split")).distinct()
    return rows.join(train.unionByName(test), "day")


def _need(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def shifted_zscore(
    rows: DataFrame, stats: DataFrame, new_mean: float = 0.2, new_std: float = 0.1, keys: Sequence[str] = FOLD
) -> DataFrame:
    """p1, p2 = clip((x - mean) / std * new_std + new_mean, 0, 1); a bar without a difference gets 0.

    `stats` is keyed by `keys`: by fold (causal), or by day for the same-day option. Fewer than two bars or
    a zero std is an error.
    """
    out = rows.join(stats, list(keys))
    cols = {}
    for p, x in (("p1", "x1"), ("p2", "x2")):
        std = _need((F.col(f"n_{x}") >= 2) & (F.col(f"std_{x}") > 0), "channel without spread", F.col(f"std_{x}"))
        z = (F.col(x) - F.col(f"mean_{x}")) / std * new_std + new_mean
        cols[p] = F.when(F.col(x).isNull(), 0.0).otherwise(clip(z, 0.0, 1.0))
    return out.withColumns(cols).drop(*stats.columns[len(keys):])


def same_day_stats(rows: DataFrame) -> DataFrame:
    """Statistics of the day itself (uses the day's future: not causal)."""
    aggs = []
    for c in ("x1", "x2"):
        aggs += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return rows.groupBy(*BAR_DAY).agg(*aggs)


def intensity_rates(rows: DataFrame, stats: DataFrame, new_mean: float = 0.2, keys: Sequence[str] = FOLD) -> DataFrame:
    """p1, p2 = clip(lam * new_mean / mean_train(lam), 0, 1) for lam_u, lam_d."""
    out = rows.join(stats, list(keys))
    cols = {}
    for p, lam in (("p1", "lam_u"), ("p2", "lam_d")):
        mean = _need(F.col(f"mean_{lam}") > 0, "training intensity not positive", F.col(f"mean_{lam}"))
        cols[p] = clip(F.col(lam) * (new_mean / mean), 0.0, 1.0)
    return out.withColumns(cols).drop(*stats.columns[len(keys):])


def run_steps(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Ordered pipeline: each step sees the rows (training days included) as the earlier steps left them."""
    for step in steps:
        df = df.transform(step)
    return df


def zscore_inputs(diffs: DataFrame, folds: DataFrame, new_mean: float = 0.2, new_std: float = 0.1) -> DataFrame:
    """Fit on training days, apply to training and test days of every fold."""
    stats = fold_stats(diffs, folds, ["x1", "x2"])
    return run_steps(diffs, [
        lambda rows: fold_rows(rows, folds),
        lambda rows: shifted_zscore(rows, stats, new_mean, new_std),
    ])


def intensity_inputs(lam: DataFrame, folds: DataFrame, new_mean: float = 0.2) -> DataFrame:
    stats = fold_stats(lam, folds, ["lam_u", "lam_d"])
    return run_steps(lam, [lambda rows: fold_rows(rows, folds), lambda rows: intensity_rates(rows, stats, new_mean)])


def encode(inputs: DataFrame, ticks: int, seed: int, purpose: Column | str = "test", epoch: int = 0) -> DataFrame:
    """Bernoulli expansion: one row per (bar, tick) with s1, s2 in {0, 1}; p outside [0, 1] is an error.

    The draw is keyed by bar and tick, so the first bars of a day do not depend on the rest of it.
    """
    purpose = purpose if isinstance(purpose, Column) else F.lit(purpose)
    spread = inputs.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))))
    cols = {}
    for i, p in ((1, F.col("p1")), (2, F.col("p2"))):
        ok = p.isNotNull() & p.between(0.0, 1.0)
        u = uniform(seed, purpose, F.col("symbol"), F.col("day"), epoch, F.col("bar_idx"), F.col("tick"), i)
        cols[f"s{i}"] = (u < _need(ok, "probability outside [0, 1]", p)).cast("int")
    return spread.withColumns(cols)


def spike_counts(encoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return encoded.groupBy(*keys).agg(F.sum("s1").alias("spikes_1"), F.sum("s2").alias("spikes_2"))


def input_stats(counts: DataFrame, keys: Sequence[str], ticks: int) -> DataFrame:
    """Realised spike rate per tick and mean probability, per day and channel.

    `counts` has one row per bar: p1, p2, spikes_1, spikes_2.
    """
    n = F.count("*") * ticks
    return counts.groupBy(*keys).agg(
        (F.sum("spikes_1") / n).alias("rate_x1"), (F.sum("spikes_2") / n).alias("rate_x2"),
        F.avg("p1").alias("prob_x1"), F.avg("p2").alias("prob_x2"),
    )


def clipping_shares(inputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean inputs and the share of (bar, channel) values clipped at 1 or at 0."""
    both = inputs.select(*keys, "p1", "p2", F.explode(F.array("p1", "p2")).alias("p"))
    return both.groupBy(*keys).agg(
        F.avg("p1").alias("mean_p1"), F.avg("p2").alias("mean_p2"), share(F.col("p") >= 1).alias("at_1"),
        share(F.col("p") <= 0).alias("at_0"),
    )


def half_split(rows: DataFrame, days: DataFrame) -> DataFrame:
    """`fit_half`: the row's day lies in the first half of the range of `days.day`."""
    first, last = F.min("day"), F.max("day")
    middle = days.agg(F.date_add(first, F.floor((F.date_diff(last, first) + 1) / 2).cast("int")).alias("_middle"))  # one row
    return rows.crossJoin(F.broadcast(middle)).withColumn("fit_half", F.col("day") < F.col("_middle")).drop("_middle")


def standardise_features(rows: DataFrame, features: Sequence[str], limit: float = 10.0) -> DataFrame:
    """Features centred and scaled by the fit half's mean and sample std (0 becomes 1), clipped to +-limit."""
    aggs = []
    for c in features:
        std = F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"_m_{c}"), F.when(std == 0, 1.0).otherwise(std).alias(f"_s_{c}")]
    stats = rows.filter("fit_half").agg(*aggs).withColumn("_one", F.lit(1))  # a single row
    scaled = {c: clip((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"), -limit, limit) for c in features}
    out = rows.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one").withColumns(scaled)
    return out.drop("_one", *[f"_m_{c}" for c in features], *[f"_s_{c}" for c in features])


def lagged(bars: DataFrame, column: str, lags: Sequence[int]) -> DataFrame:
    """Extra columns `column_lagL`, NULL before the day's start."""
    return over_bars(bars, BAR_DAY, max(lags), 0, lambda w: {f"{column}_lag{k}": F.lag(column, k).over(w) for k in lags})

