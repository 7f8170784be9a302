"""Statistics over bars, days and runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparktick.functions.columns import ratio, share
from sparktick.operators.spread import auc, average_ranks, group_quantiles, number_rows, over_bars, value_cells
from sparktick.schemas import BAR_DAY


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Correlation over rows where both are known; NULL (not an error) where one side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def r_squared(x: str | Column, y: str | Column) -> Column:
    return F.pow(safe_corr(x, y), F.lit(2.0))


# Chebyshev coefficients of the complementary error function (fractional error below 1.2e-7).
_ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223,
    0.17087277,
)


def two_sided_p(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    poly = reduce(lambda acc, c: F.lit(c) + t * acc, reversed(_ERFC[:-1]), F.lit(_ERFC[-1]))
    return t * F.exp(-x * x + poly)


EXACT_PAIRS = 50  # up to so many untied pairs the distribution of the rank sum is counted out


def rank_sum_counts(n: Column) -> Column:
    """How many of the 2^n sign patterns of the ranks 1..n give each sum of positive ranks, as an array from sum 0 on.

    One rank more moves a copy of the counts up by its size: a fold over the ranks.
    """
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    with_rank = lambda acc, k: F.zip_with(F.concat(acc, zeros(k)), F.concat(zeros(k), acc), lambda a, b: a + b)
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.array(F.lit(1.0)), with_rank)


def signed_rank(pairs: DataFrame, keys: Sequence[str], diff: str) -> DataFrame:
    """Paired comparison per group: n, days ahead, mean difference, Wilcoxon signed-rank z and two-sided p.

    Zero differences are dropped from the ranking, ties share ranks. Without zeros and ties p is exact up to EXACT_PAIRS pairs
    (`exact` says so); otherwise it is that of the normal approximation with tie correction. Rows are days, so a group is bounded
    by the calendar.
    """
    keys = list(keys)
    d = F.col(diff)
    used = pairs.filter(d != 0).withColumn("_a", F.abs(d))
    by_size = Window.partitionBy(*keys).orderBy("_a")
    tied = Window.partitionBy(*keys, "_a")
    ranked = used.withColumns({"_low": F.rank().over(by_size), "_c": F.count("*").over(tied)})
    rank = F.col("_low") + (F.col("_c") - 1) / 2
    c = F.col("_c").cast("double")
    tests = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_used"), F.sum(F.when(d > 0, rank).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(d < 0, rank).otherwise(0.0)).alias("w_minus"), F.sum(c * c - 1.0).alias("_ties"),
    )
    n = F.col("n_used").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0)
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / F.nullif(spread, F.lit(0.0))
    totals = pairs.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.count(d).alias("_known"), F.count_if(d > 0).alias("days_ahead"), F.avg(d).alias("mean_diff")
    )
    out = totals.join(tests, keys, "left").withColumn("z", z)
    exact = F.coalesce((F.col("_ties") == 0) & (F.col("n_used") == F.col("_known")) & (F.col("n_used") <= EXACT_PAIRS), F.lit(False))
    out = out.withColumn("exact", exact)
    counts = rank_sum_counts(F.when(F.col("exact"), F.col("n_used")))
    below = F.aggregate(F.slice(counts, 1, F.least("w_plus", "w_minus").cast("int") + 1), F.lit(0.0), lambda a, b: a + b)
    counted = F.least(F.lit(1.0), 2.0 * below / F.pow(F.lit(2.0), n))
    return out.withColumn("p", F.when(F.col("exact"), counted).otherwise(two_sided_p(F.col("z")))).drop("_ties", "_known")


# --------------------------------------------------------------------------- rank statistics


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, control: str | None = None) -> DataFrame:
    """Spearman correlation per group and, with a control, the partial one given the control's ranks."""
    names = [x, y] + ([control] if control else [])
    rows = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in names])).select(*keys, *names)
    rows = average_ranks(rows.withColumns({c: F.col(c).cast("double") for c in names}), keys, {c: f"_r{i}" for i, c in enumerate(names)})
    aggs = [F.count("*").alias("n"), safe_corr("_r0", "_r1").alias("rho")]
    if control:
        aggs += [safe_corr("_r0", "_r2").alias("_xz"), safe_corr("_r1", "_r2").alias("_yz")]
    out = rows.groupBy(*keys).agg(*aggs)
    if not control:
        return out
    xz, yz = F.col("_xz"), F.col("_yz")
    return out.withColumn("partial", ratio(F.col("rho") - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))).drop("_xz", "_yz")


def feature_aucs(df: DataFrame, keys: Sequence[str], features: Sequence[str], positive: Column) -> DataFrame:
    """AUC of every feature: features become rows, then one grouped AUC."""
    long = df.withColumn("_y", positive).unpivot([*keys, "_y"], list(features), "feature", "_score")
    return auc(long, [*keys, "feature"], "_score", F.col("_y"))


def score_deciles(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], ret: str = "ret") -> DataFrame:
    """Per rank decile of the score: rows, score range, P(ret > 0), mean follow and fade return in bp."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = number_rows(df, keys, value_cells(F.col(score)), [score, *order], "_rn").join(sizes, keys)
    decile = F.greatest(F.lit(1), F.ceil(F.col("_rn") * 10 / F.greatest(F.col("_n") - 1, F.lit(1)))).cast("int")
    return ranked.groupBy(*keys, decile.alias("decile")).agg(
        F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), share(F.col(ret) > 0).alias("p_win"),
        (F.avg(ret) * 1e4).alias("follow_bp"), (-F.avg(ret) * 1e4).alias("fade_bp"),
    )


# --------------------------------------------------------------------------- autocorrelation, trend, profiles


def autocorrelation(diffs: DataFrame, lags: Sequence[int], keys: Sequence[str] = BAR_DAY) -> DataFrame:
    """Correlation of sign(d) and of |d| with their own lagged values, one row per (day, lag)."""
    rows = diffs.filter("d is not null").withColumns({"_s": F.signum("d"), "_a": F.abs("d")})
    shifted = over_bars(
        rows, keys, max(lags), 0,
        lambda w: {f"_{c}{k}": F.lag(f"_{c}", k).over(w) for c in "sa" for k in lags},
    )
    pairs = [c for k in lags for c in (safe_corr("_s", f"_s{k}").alias(f"s_{k}"), safe_corr("_a", f"_a{k}").alias(f"a_{k}"))]
    wide = shifted.groupBy(*keys).agg(*pairs)
    table = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s_{k}").alias("sign"), F.col(f"a_{k}").alias("abs")) for k in lags])
    return wide.select(*keys, F.explode(table).alias("_t")).select(
        *keys, "_t.lag", F.col("_t.sign").alias("ac_sign"), F.col("_t.abs").alias("ac_abs")
    )


def day_trends(bars: DataFrame) -> DataFrame:
    """Per day: move, drift of d against its spread, fit of d and of the level on time, lag-1 autocorrelations."""
    rows = over_bars(bars, BAR_DAY, 2, 0, lambda w: {
        "d": F.col("vwap") - F.lag("vwap").over(w), "_p": F.lag("vwap").over(w),
        "_pd": F.lag("vwap").over(w) - F.lag("vwap", 2).over(w),
    })
    ends = bars.groupBy(*BAR_DAY).agg(
        F.min_by("vwap", "bar_idx").alias("_first"), F.max_by("vwap", "bar_idx").alias("_last"),
        F.count("*").alias("_n"), F.avg("vwap").alias("_mean"),
    )
    line = F.col("_first") + (F.col("_last") - F.col("_first")) * F.col("bar_idx") / F.greatest(F.col("_n") - 1, F.lit(1))
    off = F.col("vwap") - line
    dev = F.col("vwap") - F.col("_mean")
    drift, std, var = F.avg("d"), F.stddev_pop("d"), F.var_pop("d")
    return rows.join(ends, BAR_DAY).groupBy(*BAR_DAY).agg(
        ((ratio(F.first("_last"), F.first("_first")) - 1) * 100).alias("move_pct"), drift.alias("drift"), std.alias("std_d"),
        ratio(F.abs(drift), std).alias("drift_over_std"), ratio(drift * drift, drift * drift + var).alias("drift_share"),
        r_squared("bar_idx", "d").alias("r2_d_time"), (1 - ratio(F.sum(off * off), F.sum(dev * dev))).alias("r2_level_line"),
        safe_corr("vwap", "_p").alias("ac1_level"), safe_corr("d", "_pd").alias("ac1_d"),
    )


def describe(df: DataFrame, columns: Sequence[str], name: str = "measure") -> DataFrame:
    """mean / min / max over rows, one row per column."""
    long = df.unpivot([], list(columns), name, "_v")
    return long.groupBy(name).agg(F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))


def hour_profile(rows: DataFrame) -> DataFrame:
    """By UTC hour: bars per day, mean |d| relative to its day's mean, mean input, signal rate.

    `rows` has d, hour, input and fired (0/1) per bar; bars without a difference are left out.
    """
    used = rows.filter("d is not null").withColumn("_a", F.abs("d"))
    day = used.groupBy(*BAR_DAY).agg(F.avg("_a").alias("_day"))
    days = used.agg(F.count_distinct("day").alias("_days")).withColumn("_one", F.lit(1))  # a single row
    out = used.join(day, BAR_DAY).groupBy("hour").agg(
        F.count("*").alias("_n"), F.avg(ratio(F.col("_a"), F.col("_day"))).alias("rel_abs_d"), F.avg("input").alias("input"),
        F.avg("fired").alias("signal_rate"),
    )
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(days), "_one")
    return out.select("hour", (F.col("_n") / F.col("_days")).alias("bars_per_day"), "rel_abs_d", "input", "signal_rate")


def profile_summary(profile: DataFrame) -> DataFrame:
    """Largest / smallest hour of each measure and the correlation of the |d| and signal profiles (24 rows in)."""
    spread = lambda c: ratio(F.max(c), F.min(c))
    return profile.agg(
        spread("bars_per_day").alias("bars_ratio"), spread("rel_abs_d").alias("abs_d_ratio"),
        spread("signal_rate").alias("signal_ratio"), safe_corr("rel_abs_d", "signal_rate").alias("profile_corr"),
    )


def bin_means(df: DataFrame, x: str, y: str, measure: Column, probs: Sequence[float]) -> DataFrame:
    """Mean of a measure over quantile bins of two columns; equal edges merge, bins are right-closed.

    Edges are a handful of numbers, joined as one row.
    """
    edges = []
    for c in (x, y):
        rows = group_quantiles(df.withColumn("_one", F.lit(1)), ["_one"], c, {f"_e{i}": p for i, p in enumerate(probs)}, one_group=True)
        edges.append(rows.select("_one", F.array_sort(F.array_distinct(F.array(*[f"_e{i}" for i in range(len(probs))]))).alias(f"_edges_{c}")))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(edges[0]), "_one").join(F.broadcast(edges[1]), "_one")

    def bin_of(c: str) -> Column:
        below = F.size(F.filter(f"_edges_{c}", lambda e: e < F.col(c)))
        return F.greatest(below, F.lit(1)).cast("int")

    return rows.groupBy(bin_of(x).alias("bin_x"), bin_of(y).alias("bin_y")).agg(
        F.count("*").alias("n"), F.avg(measure).alias("mean_measure")
    )


def working_value(m: Column) -> Column:
    """Lag-1 autocorrelation of first differences of block averages of a random walk, block length m."""
    return (m * m - 1) / (2 * (2 * m * m + 1))


# --------------------------------------------------------------------------- models


def logistic(df: DataFrame, features: Sequence[str], label: str = "y"):
    """Fitted binomial regression (distributed IRLS). Its summary has the deviance: the likelihood ratio of two
    nested fits is the difference of their deviances."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    return GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_x", labelCol=label, predictionCol="p", maxIter=50, tol=1e-9, regParam=0.0
    ).fit(ready)


def coefficient_table(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per term: coefficient, standard error and z (undefined for collinear features)."""
    errors = model.summary.coefficientStandardErrors
    terms = [*zip(features, model.coefficients.toArray(), errors[:-1]), ("intercept", model.intercept, errors[-1])]
    rows = [(name, float(c), float(e), float(c / e)) for name, c, e in terms]  # one row per term
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, z double")


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    return model.transform(ready).drop("_x")


def signal_effect(rows: DataFrame, base: Sequence[str], signal: str, label: str = "y") -> DataFrame:
    """What a signal adds to a base regression: coefficient, error, z, LR statistic, AUC without and with it."""
    small, big = logistic(rows, base, label), logistic(rows, [*base, signal], label)
    table = coefficient_table(big, rows, [*base, signal])
    lr = float(small.summary.deviance - big.summary.deviance)
    aucs = []
    for name, model, cols in (("auc_without", small, base), ("auc_with", big, [*base, signal])):
        scored = predict(model, rows, cols).withColumn("_one", F.lit(1))
        aucs.append(auc(scored, ["_one"], "p", F.col(label) > 0.5, name).select("_one", name))
    out = table.filter(F.col("term") == signal).withColumns({"lr": F.lit(lr), "_one": F.lit(1)})
    return out.join(aucs[0], "_one").join(aucs[1], "_one").drop("_one")


def half_split_fit(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (with `fit_half`, standardised features, y) plus p from a regression on the fit half only."""
    model = logistic(rows.filter("fit_half"), features)
    return predict(model, rows, features)


def typing_value(rows: DataFrame, p: str = "p", ret: str = "ret") -> DataFrame:
    """Mean return in bp and share faded: always follow, fade p < 0.5, fade the lowest 10 % of p, perfect oracle."""
    one = rows.select((F.col(ret) * 1e4).alias("_r"), F.col(p).alias("_p"), F.lit(1).alias("_one"))
    cut = group_quantiles(one, ["_one"], "_p", {"_cut": 0.1}, one_group=True)  # a single row
    r, q = F.col("_r"), F.col("_p")
    follow = {
        "follow": F.lit(True), "fade_below_half": q >= 0.5, "fade_lowest_tenth": q >= F.col("_cut"), "oracle": r >= 0,
    }
    plans = F.array(*[F.struct(F.lit(name).alias("strategy"), keep.alias("keep")) for name, keep in follow.items()])
    long = one.join(F.broadcast(cut), "_one").select("_r", F.explode(plans).alias("_s"))
    return long.groupBy(F.col("_s.strategy").alias("strategy")).agg(
        F.avg(F.when(F.col("_s.keep"), r).otherwise(-r)).alias("bp"), share(~F.col("_s.keep")).alias("faded"),
        F.count("*").alias("n"),
    )


def premise_gate(aucs: DataFrame, deciles: DataFrame, minimum: float = 0.53) -> DataFrame:
    """Gate: best oriented AUC (p_cross counts inverted) >= minimum and some decile with a negative mean follow return."""
    oriented = F.when(F.col("feature") == "p_cross", 1 - F.col("auc")).otherwise(F.col("auc"))
    best = aucs.agg(F.max(oriented).alias("best_auc"), F.max_by("feature", oriented).alias("best_feature"))
    fade = deciles.agg(F.bool_or(F.col("follow_bp") < 0).alias("fade_pays"))
    both = best.withColumn("_one", F.lit(1)).join(F.broadcast(fade.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return both.withColumn("passed", (F.col("best_auc") >= minimum) & F.col("fade_pays"))
