"""Analysis tables built from the operators: fit review, event variants, feature tables, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparktick.functions.columns import NS_PER_HOUR, day_start_ns, idiv, ratio, share
from sparktick.functions.rules import momentum
from sparktick.operators.excitation import (
    ALPHA, BETA, FIT, MU, above_threshold, branching_matrix, events, fit_marks, fit_windows, given_theta, horizons,
    in_fit_windows, intensities, loglik,
)
from sparktick.operators.execution import return_surface
from sparktick.operators.labels import bar_labels, trade_labels
from sparktick.operators.spread import exact_quantiles, group_quantiles, over_bars
from sparktick.operators.stats import safe_corr, spearman, working_value
from sparktick.schemas import BAR, BAR_DAY

# --------------------------------------------------------------------------- excitation review


def review(lam: DataFrame, keys: Sequence[str] = FIT) -> DataFrame:
    """Per theta key: occupancy, up share, branching means, spread of M and variation of the total intensity.

    `lam` is the output of `intensities`; M quantiles are exact over the day's events.
    """
    keys = list(keys)
    is_event = F.col("k").isNotNull()
    m, total = F.col("momentum"), F.col("lam_u") + F.col("lam_d")
    n_events = F.count_if(is_event)
    base = lam.groupBy(*keys).agg(
        F.count("*").alias("bars"), n_events.alias("events"), (n_events / F.count("*")).alias("occupancy"),
        share(F.col("k") == 0).alias("up_share"), F.avg("p_bg").alias("p_bg"), F.avg("p_same").alias("p_same"),
        F.avg("p_cross").alias("p_cross"), F.avg(m).alias("m_mean"), F.stddev_pop(m).alias("m_std"),
        share(F.abs(m) > 0.2).alias("m_abs_gt_02"), ratio(F.stddev_pop(total), F.avg(total)).alias("lambda_cv"),
    )
    spread = group_quantiles(lam, keys, "momentum", {"m_p10": 0.1, "m_p90": 0.9})
    return base.join(spread, keys, "left")


def out_of_sample(ev: DataFrame, theta: DataFrame, marks_weight) -> DataFrame:
    """Next-day log-likelihood per event: theta of a day scored on that day's own events."""
    rows = ev.join(theta.drop("total_time", "horizon"), BAR_DAY).withColumn("g", marks_weight)
    rows = rows.withColumn("total_time", F.col("horizon"))
    return loglik(rows, FIT, FIT)


def strength_ranks(lam: DataFrame, labels: DataFrame) -> DataFrame:
    """Per theta key, over evaluable bars: Spearman of the total intensity with the next moves, and given |d|."""
    rows = lam.select(*FIT, "bar_idx", (F.col("lam_u") + F.col("lam_d")).alias("lam_total")).join(
        labels.filter("evaluable").select(*BAR, "strength", F.abs(F.coalesce("d", F.lit(0.0))).alias("abs_d")), BAR
    )
    return spearman(rows, FIT, "lam_total", "strength", "abs_d")


def stability(theta: DataFrame, columns: Sequence[str] = (*MU, *ALPHA, *BETA)) -> DataFrame:
    """Spread of every parameter over days relative to its mean, by w_h."""
    long = theta.unpivot(["symbol", "num", "w_h"], list(columns), "parameter", "_v")
    return long.groupBy("symbol", "num", "w_h", "parameter").agg(
        ratio(F.stddev_samp("_v"), F.abs(F.avg("_v"))).alias("cv")
    )


def variant_fits(
    diffs: DataFrame, days: DataFrame, variants: Sequence[tuple[str, float | None]], alpha: Sequence[float], beta: Sequence[float]
) -> dict[str, tuple[str, DataFrame]]:
    """Event definitions (time axis, quantile of all |d| of the fit day, zeros included) with their theta, w_h = 1."""
    out = {}
    windows = fit_windows(days, [1])
    for axis, q in variants:
        ev = in_fit_windows(events(diffs, axis), windows)
        if q is None:
            thr = ev.select(*FIT).distinct().withColumn("event_threshold", F.lit(None).cast("double"))
        else:
            moves = in_fit_windows(diffs.filter("d is not null"), windows)
            thr = exact_quantiles(moves, FIT, F.abs("d"), [q], out="event_threshold").select(*FIT, "event_threshold")
        time = in_fit_windows(horizons(diffs, axis), windows).groupBy(*FIT).agg(F.sum("horizon").alias("total_time"))
        head = fit_marks(above_threshold(ev, thr), strict=False).join(time, FIT)
        theta = given_theta(head, alpha, beta)
        if axis != "bar_index":  # from bars to seconds
            a_day = diffs.groupBy("symbol", "num").agg((F.count("*").cast("double") / F.count_distinct("day") / 86_400.0).alias("_scale"))
            theta = theta.join(a_day, ["symbol", "num"]).withColumns({c: F.col(c) * F.col("_scale") for c in [*ALPHA, *BETA]}).drop("_scale")
        out[f"{axis}/{'all' if q is None else q}"] = (axis, theta)
    return out


def variant_review(diffs: DataFrame, fits: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Means over days of the review measures, one row per event definition."""
    parts = []
    for name, (axis, theta) in fits.items():
        lam = intensities(diffs, theta, axis=axis)
        day = review(lam).join(branching_matrix(theta).select(*FIT, "rho"), FIT)
        parts.append(day.withColumn("variant", F.lit(name)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    measures = ["occupancy", "rho", "p_bg", "p_same", "p_cross", "m_std", "m_abs_gt_02", "lambda_cv"]
    return rows.groupBy("variant").agg(F.count("*").alias("days"), *[F.avg(c).alias(c) for c in measures])


def provenance(theta: DataFrame) -> DataFrame:
    """What each used theta was fitted on, and how it looks."""
    cols = [c for c in ("loglik_per_event", "converged") if c in theta.columns]
    out = branching_matrix(theta)
    return out.select(
        *FIT, F.array_join(F.transform("fit_days", lambda x: x.cast("string")), ",").alias("fit_days"), "candidate_moves",
        (F.col("n_up") + F.col("n_down")).alias("n_events"), "event_threshold", "rho", *cols,
    )


def reward_summary(rewarded: DataFrame, keys: Sequence[str] = FIT) -> DataFrame:
    """Reward statistics at events and the share of bars that carry a reward."""
    m = F.when(F.col("k").isNotNull(), F.col("momentum"))
    return rewarded.groupBy(*keys).agg(
        F.count("k").alias("events"), (F.count("k") / F.count("*")).alias("event_share"), F.avg(m).alias("reward_mean"),
        F.stddev_samp(m).alias("reward_std"), share(m > 0).alias("share_positive"), share(m < 0).alias("share_negative"),
        share(F.col("reward_mom") != 0).alias("bars_with_reward"),
    )


# --------------------------------------------------------------------------- feature tables


def event_features(lam: DataFrame, bars: DataFrame, window: int = 3) -> DataFrame:
    """Events with M, p_same, p_cross, intensity asymmetry and both outcome labels."""
    up = F.col("k") == 0
    same = F.when(up, F.col("lam_u")).otherwise(F.col("lam_d"))
    opp = F.when(up, F.col("lam_d")).otherwise(F.col("lam_u"))
    ev = lam.filter("k is not null").select(
        *FIT, "bar_idx", "k", F.col("momentum").alias("m"), "p_same", "p_cross", ((same - opp) / (same + opp)).alias("asym")
    )
    labels = bar_labels(bars, window).select(*BAR, "evaluable", F.col("momentum").alias("paper_mom"))
    return ev.join(trade_labels(bars).select(*BAR, "dir", "ret"), BAR).join(labels, BAR)


def base_counts(bars: DataFrame, window: int = 3) -> DataFrame:
    """Per day: bars with a decided trade label, those that lose, evaluable bars and those that revert."""
    rows = bar_labels(bars, window).join(trade_labels(bars).select(*BAR, "dir", "ret"), BAR)
    known = F.col("ret").isNotNull() & (F.col("ret") != 0)
    return rows.groupBy(*BAR_DAY).agg(
        F.count_if(known).alias("decided_bars"), F.count_if(known & (F.col("ret") < 0)).alias("reversion_bars"),
        F.count_if("evaluable").alias("eval_bars"), F.count_if(F.col("evaluable") & ~F.col("momentum")).alias("eval_reversion_bars"),
    )


# --------------------------------------------------------------------------- critique tables


def lag_buckets(sources: DataFrame, buckets: DataFrame, labels: DataFrame, surface: DataFrame) -> DataFrame:
    """By source and bars-since-big-move bucket: share within the source, real rate of evaluable bars, mean bp."""
    rows = sources.join(buckets.select(*BAR, "bucket"), BAR).join(labels.select(*BAR, "evaluable", "real"), BAR)
    rows = rows.join(surface.select(*BAR, "net_return"), BAR, "left")
    table = rows.groupBy("source", "bucket").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("evaluable"), F.col("real").cast("double"))).alias("real_rate"),
        (F.avg("net_return") * 1e4).alias("bp"),
    )
    total = table.groupBy("source").agg(F.sum("n").alias("_total"))
    return table.join(total, "source").select("source", "bucket", "n", (F.col("n") / F.col("_total")).alias("share"), "real_rate", "bp")


def decile_table(deciles: DataFrame, labels: DataFrame, sources: DataFrame, names: Sequence[str]) -> DataFrame:
    """Accuracy by |d| decile for all bars and every source, and each source's share of signals by decile."""
    rows = deciles.select(*BAR, "decile").join(labels.filter("evaluable").select(*BAR, "real"), BAR)
    every = rows.withColumn("source", F.lit("all"))
    picked = rows.join(sources.select("source", *BAR), BAR)
    both = every.unionByName(picked).withColumn("_real", F.col("real").cast("double"))
    wide = both.groupBy("decile").pivot("source", ["all", *names]).agg(F.avg("_real").alias("acc"), F.count(F.lit(1)).alias("n"))
    totals = picked.groupBy("source").agg(F.count("*").alias("_n"))
    one = totals.groupBy().pivot("source", list(names)).agg(F.first("_n")).withColumn("_one", F.lit(1))
    one = one.withColumnsRenamed({n: f"_total_{n}" for n in names})
    out = wide.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "decile", F.col("all_acc").alias("acc_all"), *[F.col(f"{n}_acc").alias(f"acc_{n}") for n in names],
        *[ratio(zero(f"{n}_n"), F.col(f"_total_{n}")).alias(f"share_{n}") for n in names],
    )


# --------------------------------------------------------------------------- head-to-head


def seed_mean_daily(daily: DataFrame) -> DataFrame:
    return daily.groupBy("model", "rule", "latency_ms", "source", "day").agg(
        F.avg("pnl").alias("pnl"), F.avg("n_trades").alias("n_trades")
    )


def excess_over(daily: DataFrame, base: str = "naive_mean") -> DataFrame:
    """Per day: the model's pnl minus the random-timing pnl, and its running sum over days (one row per day)."""
    keys = ["model", "rule", "latency_ms"]
    pick = lambda s: F.max(F.when(F.col("source") == s, F.col("pnl")))
    diff = daily.groupBy(*keys, "day").agg((pick("model") - pick(base)).alias("excess"))
    over_days = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return diff.withColumn("cum_excess", F.sum("excess").over(over_days))


def model_gap(daily: DataFrame, first: str, second: str) -> DataFrame:
    """Per day: pnl of one model minus pnl of another, same rule and latency."""
    keys = ["rule", "latency_ms", "day"]
    own = daily.filter("source = 'model'")
    a = own.filter(F.col("model") == first).select(*keys, F.col("pnl").alias("_a"))
    b = own.filter(F.col("model") == second).select(*keys, F.col("pnl").alias("_b"))
    return a.join(b, keys).select(*keys, (F.col("_a") - F.col("_b")).alias("gap"))


def return_per_trade(daily: DataFrame) -> DataFrame:
    return daily.groupBy("model", "rule", "latency_ms", "source").agg(
        (ratio(F.sum("pnl"), F.sum("n_trades")) * 1e4).alias("bp_per_trade")
    )


# --------------------------------------------------------------------------- smoothing check


def with_hour(bars: DataFrame) -> DataFrame:
    return bars.withColumn("hour", idiv(F.col("ts_end_ns") - day_start_ns(F.col("day")), NS_PER_HOUR).cast("int"))


def raw_autocorrelation(trades: DataFrame) -> DataFrame:
    """Lag-1 autocorrelation of trade-to-trade price changes per day; `trades` carry their number `seq`."""
    rows = over_bars(trades, ["symbol", "day"], 2, 0, lambda w: {
        "_a": F.col("price") - F.lag("price").over(w), "_b": F.lag("price").over(w) - F.lag("price", 2).over(w),
    }, index="seq")
    return rows.groupBy("symbol", "day").agg(safe_corr("_a", "_b").alias("ac1_raw"))


def smoothing(bars: DataFrame) -> DataFrame:
    """Per day and bar size: lag-1 autocorrelation of close and vwap changes, momentum share of evaluable bars,
    win rate of the momentum rule at every bar, and the value expected for averages of a random walk."""
    def lagged(c):
        return lambda w: {
            f"_{c}a": F.col(c) - F.lag(c).over(w), f"_{c}b": F.lag(c).over(w) - F.lag(c, 2).over(w),
        }

    rows = over_bars(bars, BAR_DAY, 2, 0, lambda w: lagged("close")(w) | lagged("vwap")(w))
    ac = rows.groupBy(*BAR_DAY).agg(safe_corr("_closea", "_closeb").alias("ac1_close"), safe_corr("_vwapa", "_vwapb").alias("ac1_vwap"))
    mom = bar_labels(bars).filter("evaluable").groupBy(*BAR_DAY).agg(share(F.col("momentum")).alias("momentum_share"))
    wins = return_surface(bars, [momentum(3)]).groupBy(*BAR_DAY).agg(share(F.col("net_return") > 0).alias("win_rate"))
    out = ac.join(mom, BAR_DAY, "left").join(wins, BAR_DAY, "left")
    return out.withColumn("working", working_value(F.col("num").cast("double")))
