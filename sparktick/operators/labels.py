"""Spike labels per bar, spike metrics per day, health checks and feature tables.

With P = vwap and window w a bar t is evaluable if w <= t <= n - 2 - w. It is *real* if the mean of the next
w absolute returns after t exceeds the day's median, *momentum* unless prices come back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparktick.functions.columns import ratio, zero_small
from sparktick.functions.rules import momentum
from sparktick.operators.spread import CHUNK, exact_quantiles, number_rows, over_bars, value_cells
from sparktick.schemas import BAR, BAR_DAY


def bar_labels(bars: DataFrame, window: int = 3) -> DataFrame:
    """r, r_pivot, strength, mom_rev_flag and the booleans evaluable, real, momentum for every bar."""
    p = F.col("vwap")

    def columns(w):
        ahead = [F.lead("vwap", j).over(w) for j in range(window + 2)]
        moves = [F.abs(ratio(ahead[j + 1], ahead[j]) - 1.0) for j in range(1, window + 1)]
        prior = F.avg("vwap").over(w.rowsBetween(-window, -1))
        post = F.avg("vwap").over(w.rowsBetween(1, window))
        complete = F.lag("vwap", window).over(w).isNotNull() & ahead[window + 1].isNotNull()
        return {
            "r": F.abs(ratio(ahead[1], p) - 1.0),
            "strength": F.when(complete, reduce(Column.__add__, moves) / window),
            "mom_rev_flag": F.when(complete, zero_small(prior - p, p) * zero_small(post - p, p)),
            "evaluable": complete,
        }

    rows = over_bars(bars, BAR_DAY, window, window + 1, columns)
    pivot = exact_quantiles(rows, BAR_DAY, "r", [0.5], out="r_pivot").drop("q", "n")
    ok = F.col("evaluable")
    return rows.join(pivot, BAR_DAY, "left").withColumns({
        "real": ok & F.coalesce(F.col("strength") > F.col("r_pivot"), F.lit(False)),
        "momentum": ok & ~F.coalesce(F.col("mom_rev_flag") > 0, F.lit(False)),
    })


def day_base(labels: DataFrame) -> DataFrame:
    """Per day: bars, evaluable bars and the share of them that is real / momentum (the chance level)."""
    ok = F.count_if("evaluable")
    return labels.groupBy(*BAR_DAY).agg(
        F.count("*").alias("n_bars"), ok.alias("n_evaluable"), F.max("r_pivot").alias("r_pivot"),
        ratio(F.count_if("real"), ok).alias("base_accuracy"), ratio(F.count_if("momentum"), ok).alias("base_momentum_pct"),
    )


METRICS = [
    "n_signals", "n_evaluated", "n_excluded", "n_real", "n_momentum", "accuracy", "momentum_pct", "base_accuracy",
    "base_momentum_pct", "signal_rate",
]


def day_metrics(labels: DataFrame, signals: DataFrame, series: Sequence[str], spine: DataFrame) -> DataFrame:
    """Ten metrics per (series, day). `spine` lists every (series, symbol, day, num) wanted, so days without
    a signal stay, with 0 counts and NULL shares."""
    keys = [*series, *BAR_DAY]
    hit = signals.select(*series, *BAR).join(labels.select(*BAR, "evaluable", "real", "momentum"), BAR)
    counts = hit.groupBy(*keys).agg(
        F.count("*").alias("n_signals"), F.count_if("evaluable").alias("n_evaluated"),
        F.count_if("real").alias("n_real"), F.count_if("momentum").alias("n_momentum"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        spine.select(*keys).join(counts, keys, "left").join(day_base(labels), BAR_DAY, "left")
        .select(
            *keys, "n_bars", zero("n_signals").alias("n_signals"), zero("n_evaluated").alias("n_evaluated"),
            (zero("n_signals") - zero("n_evaluated")).alias("n_excluded"), zero("n_real").alias("n_real"),
            zero("n_momentum").alias("n_momentum"), ratio(F.col("n_real"), F.col("n_evaluated")).alias("accuracy"),
            ratio(F.col("n_momentum"), F.col("n_evaluated")).alias("momentum_pct"), "base_accuracy", "base_momentum_pct",
            F.coalesce(ratio(zero("n_signals"), F.col("n_bars")), F.lit(0.0)).alias("signal_rate"),
        )
    )


def output_health(metrics: DataFrame, low: float = 0.001, high: float = 0.5) -> DataFrame:
    """Warning text for days whose signal rate lies outside [low, high]; '' otherwise."""
    bad = ~F.col("signal_rate").between(low, high)
    return metrics.withColumn("warnings", F.when(bad, "output rate outside range").otherwise(""))


def counter_health(
    counts: DataFrame, keys: Sequence[str], units: int, ticks: int, t_ref: int, saturation: float = 0.9
) -> DataFrame:
    """Silent or saturated counters from a long table (keys, counter, n_bars, count)."""
    total = F.sum("count")
    rate = total / (units * F.greatest(F.max("n_bars"), F.lit(1)))
    limit = saturation * ticks / (t_ref + 1)
    return counts.groupBy(*keys, "counter").agg(total.alias("total"), rate.alias("rate")).withColumn(
        "warnings",
        F.when(F.col("total") == 0, F.concat(F.lit("silent "), F.col("counter")))
        .when(F.col("rate") >= limit, F.concat(F.lit("saturated "), F.col("counter"))).otherwise(""),
    )


def warning_days(health: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    return health.groupBy(*keys).agg(F.count_if(F.col("warnings") != "").alias("days_with_warnings"))


# --------------------------------------------------------------------------- trade label and features


def trade_label_columns(w, window: int = 3) -> dict[str, Column]:
    """dir (momentum rule) and ret = dir * (P[t+4]/P[t+1] - 1), NULL if dir is 0 or a bar is missing."""
    direction = momentum(window).direction(w).cast("int")
    held = ratio(F.lead("vwap", 4).over(w), F.lead("vwap", 1).over(w)) - 1.0
    return {"dir": direction, "ret": F.when(direction != 0, direction * held)}


def trade_labels(bars: DataFrame) -> DataFrame:
    return over_bars(bars, BAR_DAY, 3, 4, trade_label_columns)


def train_day_quantile(diffs: DataFrame, q: float, out: str, nonzero: bool = True) -> DataFrame:
    """Quantile of |d| of the day before, keyed by the day it is used on; 0 becomes 1 with `nonzero`."""
    rows = exact_quantiles(diffs, BAR_DAY, F.abs("d"), [q], out=out).withColumn("day", F.date_add("day", 1))
    value = F.when(F.col(out) == 0, 1.0).otherwise(F.col(out)) if nonzero else F.col(out)
    return rows.select(*BAR_DAY, value.alias(out))


def since_big_move(diffs: DataFrame, q: float = 0.9, size: int = CHUNK) -> DataFrame:
    """Bars since the last move above the training day's quantile, and its bucket.

    The running maximum of the big bars' indices is taken inside chunks; the maximum over all earlier
    chunks of the day is carried in.
    """
    thr = train_day_quantile(diffs, q, "thr", nonzero=False)
    big = F.when(F.abs(F.coalesce("d", F.lit(0.0))) > F.col("thr"), F.col("bar_idx"))
    rows = diffs.join(thr, BAR_DAY).withColumns({"_big": big, "_chunk": F.floor(F.col("bar_idx") / size)})
    earlier = Window.partitionBy(*BAR_DAY).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*BAR_DAY, "_chunk").agg(F.max("_big").alias("_m")).select(
        *BAR_DAY, "_chunk", F.max("_m").over(earlier).alias("_carry")
    )
    inside = Window.partitionBy(*BAR_DAY, "_chunk").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max("_big").over(inside), F.col("_carry"))
    out = rows.join(carry.hint("shuffle_hash"), BAR_DAY + ["_chunk"]).withColumn("lag_bars", F.col("bar_idx") - last)
    lag = F.col("lag_bars")
    bucket = F.when(lag <= 2, lag.cast("string")).when(lag <= 5, "3-5").otherwise(">5")
    return out.withColumn("bucket", bucket).drop("_big", "_chunk", "_carry")


def move_deciles(diffs: DataFrame) -> DataFrame:
    """Ordinal decile (0..9) of |d| within the day; bar 0 has none."""
    moves = diffs.filter("d is not null").withColumn("abs_d", F.abs("d"))
    sizes = moves.groupBy(*BAR_DAY).agg(F.count("*").alias("_n"))
    ranked = number_rows(moves, BAR_DAY, value_cells(F.col("abs_d")), ["abs_d", "bar_idx"], "_rn")
    decile = F.least(F.floor(F.col("_rn") * 10 / F.col("_n")), F.lit(9)).cast("int")
    return ranked.join(sizes, BAR_DAY).withColumn("decile", decile).drop("_rn", "_n")


def _lagged_moves(w, lags: int, scale: Column, direction: Column) -> dict[str, Column]:
    out = {}
    for k in range(lags):
        d = F.coalesce(F.lag("d", k).over(w), F.lit(0.0))
        out[f"move_{k}"] = direction * d / scale
        out[f"size_{k}"] = F.log1p(F.abs(d) / scale)
    return out


def decided(min_bar: int) -> Column:
    return F.col("ret").isNotNull() & (F.col("ret") != 0) & (F.col("bar_idx") >= min_bar)


def oriented_features(rows: DataFrame, scale: DataFrame, min_bar: int = 3) -> DataFrame:
    """Causal features at t, t-1, t-2 in the trade direction: signed move, log size, intensity asymmetry.

    `rows` holds d, dir, ret, lam_u, lam_d per bar, `scale` the training day's median |d|.
    """
    s, up = F.col("dir"), F.col("dir") > 0

    def columns(w):
        out = _lagged_moves(w, 3, F.col("scale"), s)
        for k in range(3):
            u, v = F.lag("lam_u", k).over(w), F.lag("lam_d", k).over(w)
            out[f"asym_{k}"] = F.when(up, u - v).otherwise(v - u) / (u + v)
        return out

    feats = over_bars(rows.join(scale, BAR_DAY), BAR_DAY, 2, 0, columns)
    return feats.filter(decided(min_bar)).withColumns(
        {"log_lam_total": F.log(F.col("lam_u") + F.col("lam_d")), "y": (F.col("ret") > 0).cast("double")}
    )


PRICE_FEATURES = [f"{n}_{k}" for k in range(3) for n in ("move", "size")]
FLOW_FEATURES = [f"ofi_{k}" for k in range(5)] + ["ofi_sum5", "ofi_sum20", "count_imb_0"]


def flow_features(bars: DataFrame, min_bar: int = 20) -> DataFrame:
    """Order-flow features oriented by the trade direction (bars from `vwap_bars(flow=True)`)."""
    base = over_bars(bars, BAR_DAY, 3, 4, lambda w: {"d": F.col("vwap") - F.lag("vwap").over(w)} | trade_label_columns(w))
    scale = train_day_quantile(base, 0.5, "scale")
    s = F.col("dir")

    def columns(w):
        out = _lagged_moves(w, 3, F.col("scale"), s)
        out |= {f"ofi_{k}": s * F.lag("ofi", k).over(w) for k in range(5)}
        out |= {f"ofi_sum{n}": s * F.sum("ofi").over(w.rowsBetween(-(n - 1), 0)) for n in (5, 20)}
        return out | {"count_imb_0": s * F.col("count_imb")}

    feats = over_bars(base.join(scale, BAR_DAY), BAR_DAY, 19, 0, columns)
    return feats.filter(decided(min_bar)).withColumn("y", (F.col("ret") > 0).cast("double"))


def regression_rows(labels: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """log1p(|d|/scale) at t, t-1, t-2, the 20-bar mean move and one 0/1 column per signal source.

    Evaluable bars t >= 2 of days with a training day; y = the bar is real.
    """
    scale = train_day_quantile(labels, 0.5, "scale")
    rows = labels.join(scale, BAR_DAY).withColumn("abs_d", F.abs(F.coalesce("d", F.lit(0.0))))
    size = lambda c: F.log1p(c / F.col("scale"))

    def columns(w):
        out = {f"d{k}": size(F.lag("abs_d", k).over(w)) for k in range(3)}
        return out | {"vol": size(F.avg("abs_d").over(w.rowsBetween(-19, 0)))}

    feats = over_bars(rows, BAR_DAY, 19, 0, columns).filter(F.col("evaluable") & (F.col("bar_idx") >= 2))
    for name, bars in signals.items():
        mark = bars.select(*BAR).distinct().withColumn("_hit", F.lit(1.0))
        feats = feats.join(mark, BAR, "left").withColumn(f"sig_{name}", F.coalesce("_hit", F.lit(0.0))).drop("_hit")
    names = ["d0", "d1", "d2", "vol", *[f"sig_{n}" for n in signals]]
    return feats.select(*BAR, F.col("real").cast("double").alias("y"), *names)
