"""Self-exciting event model: events, thresholds, marks, intensities, branching, likelihood and gradient.

    lam_m(t) = mu_m + sum_k alpha_mk sum_{i of type k, t_i < t} g_k(mark_i) exp(-beta_mk (t - t_i))

Types: 0 = up (u), 1 = down (d); alpha_ud is the excitation of up events by down events. Theta is a table with
one row per (symbol, num, w_h, day [, further keys]) and the columns in `THETA`; every day starts from scratch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktick.functions.kernels import spectral_radius
from sparktick.functions.marks import mark_weight, raw_mark
from sparktick.operators.bars import bar_time
from sparktick.operators.scan import CHUNK, decayed_sums
from sparktick.operators.spread import exact_quantiles
from sparktick.schemas import BAR, BAR_DAY
from sparktick.session import materialise

SECONDS_PER_DAY = 86_400.0
PAIRS = ("uu", "ud", "du", "dd")  # target, source
MU = ["mu_u", "mu_d"]
ALPHA = [f"alpha_{p}" for p in PAIRS]
BETA = [f"beta_{p}" for p in PAIRS]
MARKS = ["mark_scale_u", "mark_scale_d", "mark_norm_u", "mark_norm_d"]
THETA = MU + ALPHA + BETA + MARKS + ["event_threshold"]
FIT = ["symbol", "num", "w_h", "day"]  # `day` is the day theta is used on


# --------------------------------------------------------------------------- events


def events(diffs: DataFrame, axis: str = "bar_index") -> DataFrame:
    """Moves as a marked point process: t, k (0 up / 1 down), mark = |d|, horizon; no event where d is 0 or missing."""
    found = diffs.filter("d <> 0").select(
        *BAR, bar_time(axis).alias("t"), F.when(F.col("d") > 0, 0).otherwise(1).alias("k"), F.abs("d").alias("mark")
    )
    return found.join(horizons(diffs, axis), BAR_DAY)


def horizons(bars: DataFrame, axis: str = "bar_index") -> DataFrame:
    """Length of each day's window: its number of bars, or 86 400 s."""
    length = F.count("*").cast("double") if axis == "bar_index" else F.first(F.lit(SECONDS_PER_DAY))
    return bars.groupBy(*BAR_DAY).agg(length.alias("horizon"))


def event_violations(ev: DataFrame) -> DataFrame:
    """Events outside their window, with a wrong type or a mark that is not positive (must be empty)."""
    return ev.filter(~(F.col("t").between(F.lit(0.0), F.col("horizon")) & F.col("k").isin(0, 1) & (F.col("mark") > 0)))


# --------------------------------------------------------------------------- fit windows (never the day itself)


def fit_windows(days: DataFrame, spans: Sequence[int]) -> DataFrame:
    """(w_h, day, fit_day): theta of `day` uses exactly the w_h days before it."""
    span = F.explode(F.array(*[F.lit(int(w)) for w in spans])).alias("w_h")
    wanted = days.select("day", span)
    before = F.sequence(F.expr("date_sub(day, w_h)"), F.date_sub("day", 1))
    return wanted.select("w_h", "day", F.explode(before).alias("fit_day"))


def in_fit_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of the fit days; `day` becomes the day theta is used on, `fit_day` the row's own day."""
    return rows.withColumnRenamed("day", "fit_day").join(windows, "fit_day")


def fit_thresholds(pooled: DataFrame, quantile: float) -> DataFrame:
    """Quantile of the fit window's non-zero moves, one row per theta key."""
    rows = exact_quantiles(pooled, FIT, "mark", [quantile], out="event_threshold")
    return rows.select(*FIT, "event_threshold", F.col("n").alias("candidate_moves"))


def above_threshold(ev: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Events strictly above the threshold of their theta key; a NULL threshold keeps all."""
    return ev.join(thresholds, FIT).filter(F.col("event_threshold").isNull() | (F.col("mark") > F.col("event_threshold")))


def fit_marks(ev: DataFrame, name: str = "linear_normalized", strict: bool = True) -> DataFrame:
    """One row per theta key: mark_scale_k and mark_norm_k, the numbers of events n_up and n_down, and what
    `ev` says about the key (threshold, candidate moves). A missing type is an error if `strict`, otherwise the
    key is left out."""
    if name == "saturating":
        keys = [*FIT, "k"]
        ev = ev.join(exact_quantiles(ev, keys, "mark", [0.5], out="_scale").drop("q", "n"), keys)
        scale, norm = F.first("_scale"), F.avg(raw_mark(name, F.col("mark"), F.col("_scale")))
    else:
        scale, norm = F.avg("mark") if name == "linear_normalized" else F.avg(F.lit(1.0)), F.avg(F.lit(1.0))
    known = [F.first(c).alias(c) for c in ("event_threshold", "candidate_moves") if c in ev.columns]
    per_type = ev.groupBy(*FIT, "k").agg(scale.alias("_scale"), norm.alias("_norm"), F.count("*").alias("_n"), *known)
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = per_type.groupBy(*FIT).agg(
        pick("_scale", 0).alias("mark_scale_u"), pick("_scale", 1).alias("mark_scale_d"),
        pick("_norm", 0).alias("mark_norm_u"), pick("_norm", 1).alias("mark_norm_d"),
        pick("_n", 0).alias("n_up"), pick("_n", 1).alias("n_down"),
        *[F.first(c).alias(c) for c in ("event_threshold", "candidate_moves") if c in ev.columns],
    )
    both = F.col("mark_scale_u").isNotNull() & F.col("mark_scale_d").isNotNull()
    if not strict:
        return out.filter(both)
    missing = F.raise_error(F.lit("no events of one type in the fit window")).cast("double")
    return out.withColumn("mark_scale_u", F.when(both, F.col("mark_scale_u")).otherwise(missing))


def fit_events(
    diffs: DataFrame, windows: DataFrame, quantile: float | None = 0.9, marks: str = "linear_normalized",
    axis: str = "bar_index", strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The fit set (events of the fit days with weight g) and one row per theta key with threshold, marks,
    event counts, total horizon and the list of fit days."""
    pooled = in_fit_windows(events(diffs, axis), windows)
    if quantile is None:
        thr = pooled.groupBy(*FIT).agg(F.lit(None).cast("double").alias("event_threshold"), F.count("*").alias("candidate_moves"))
    else:
        thr = fit_thresholds(pooled, quantile)
    kept = materialise(above_threshold(pooled, thr), "fit-kept")  # read by marks, head and fit set
    norm = fit_marks(kept, marks, strict)
    time = in_fit_windows(horizons(diffs, axis), windows).groupBy(*FIT).agg(
        F.sum("horizon").alias("total_time"), F.sort_array(F.collect_list("fit_day")).alias("fit_days")
    )
    head = norm.join(time, FIT)
    weighted = kept.drop("event_threshold", "candidate_moves").join(norm, FIT).withColumn(
        "g", mark_weight(marks, F.col("mark"), F.col("k"))
    )
    return weighted.drop(*[c for c in norm.columns if c not in FIT]), head


def given_theta(head: DataFrame, alpha: Sequence[float], beta: Sequence[float], mu_share: float = 0.5) -> DataFrame:
    """Theta with given alpha and beta (order of `PAIRS`) and mu as a share of the fit window's event rates."""
    cols = {c: F.lit(float(v)) for c, v in zip(ALPHA + BETA, [*alpha, *beta])}
    cols |= {"mu_u": mu_share * F.col("n_up") / F.col("total_time"), "mu_d": mu_share * F.col("n_down") / F.col("total_time")}
    return head.withColumns(cols)


def branching_matrix(theta: DataFrame) -> DataFrame:
    """Adds A_mk = alpha_mk / beta_mk and rho, its spectral radius."""
    out = theta.withColumns({f"A_{p}": F.col(f"alpha_{p}") / F.col(f"beta_{p}") for p in PAIRS})
    return out.withColumn("rho", spectral_radius(*[F.col(f"A_{p}") for p in PAIRS]))


# --------------------------------------------------------------------------- intensities


def excite(rows: DataFrame, keys: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Intensities at every row of (keys, bar_idx): lam_*_minus (before the row's event) and lam_* (after it).

    Rows carry t, k (NULL without event), g and theta. At event rows `from_u`, `from_d` hold the excitation of
    the event's own type by up / down events and `lag_u`, `lag_d` the same weighted by the time lag.
    """
    c, k = F.col, F.col("k")
    weight = {s: F.when(k == i, c("g")).otherwise(0.0) for i, s in enumerate("ud")}
    sums = decayed_sums(rows, keys, "bar_idx", c("t"), {p: (c(f"beta_{p}"), weight[p[1]]) for p in PAIRS}, size)

    def lam(m: str, side: str) -> Column:
        return c(f"mu_{m}") + c(f"alpha_{m}u") * c(f"{side}_{m}u") + c(f"alpha_{m}d") * c(f"{side}_{m}d")

    def own(side: str, s: str) -> Column:
        return F.when(k == 0, c(f"alpha_u{s}") * c(f"{side}_u{s}")).when(k == 1, c(f"alpha_d{s}") * c(f"{side}_d{s}"))

    return sums.select(
        *rows.columns, *[lam(m, "minus").alias(f"lam_{m}_minus") for m in "ud"], *[lam(m, "plus").alias(f"lam_{m}") for m in "ud"],
        *[own("minus", s).alias(f"from_{s}") for s in "ud"], *[own("lag", s).alias(f"lag_{s}") for s in "ud"],
    )


def bar_events(bars: DataFrame, theta: DataFrame, marks: str = "linear_normalized", axis: str = "bar_index") -> DataFrame:
    """Every bar of a day with theta: t, and k, g where its move is an event above the day's threshold."""
    rows = bars.join(theta, BAR_DAY)
    d = F.col("d")
    is_event = (d != 0) & (F.col("event_threshold").isNull() | (F.abs(d) > F.col("event_threshold")))
    k = F.when(is_event, F.when(d > 0, 0).otherwise(1))
    rows = rows.withColumns({"t": bar_time(axis), "k": k, "mark": F.when(is_event, F.abs(d))})
    return rows.withColumn("g", F.coalesce(mark_weight(marks, F.col("mark"), F.col("k")), F.lit(0.0)))


def intensities(
    bars: DataFrame, theta: DataFrame, limit: str = "right", marks: str = "linear_normalized", axis: str = "bar_index",
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """lam_u, lam_d at every bar: the right limit includes the bar's own move, the left limit does not.

    Event bars also get the causal branching split p_bg + p_same + p_cross = 1 and momentum = p_same - p_cross.
    """
    if limit not in ("right", "left"):
        raise ValueError(f"unknown limit {limit!r}")
    rows = excite(bar_events(bars, theta, marks, axis), [*FIT, *extra_keys])
    rows = split(rows)
    if limit == "left":
        rows = rows.withColumns({"lam_u": F.col("lam_u_minus"), "lam_d": F.col("lam_d_minus")})
    return rows


def split(rows: DataFrame) -> DataFrame:
    """Share of an event's intensity from the background, its own type and the other type."""
    up = F.col("k") == 0
    lam = F.when(up, F.col("lam_u_minus")).when(F.col("k") == 1, F.col("lam_d_minus"))
    mu = F.when(up, F.col("mu_u")).otherwise(F.col("mu_d"))
    same = F.when(up, F.col("from_u")).otherwise(F.col("from_d"))
    cross = F.when(up, F.col("from_d")).otherwise(F.col("from_u"))
    out = rows.withColumns({"lam_own": lam, "p_bg": mu / lam, "p_same": same / lam, "p_cross": cross / lam})
    return out.withColumn("momentum", F.col("p_same") - F.col("p_cross"))


def rewards(rows: DataFrame) -> DataFrame:
    """Two reward streams per bar: momentum at event bars, 0 elsewhere, and its negative."""
    m = F.coalesce("momentum", F.lit(0.0))
    return rows.withColumns({"reward_mom": m, "reward_rev": -m})


# --------------------------------------------------------------------------- likelihood, gradient, EM statistics


def statistics(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Sums over events that give the likelihood, its gradient and an EM update, one row per `by`.

    `rows` are events (k, g, t, horizon, theta, total_time); `keys` separates independent days. P, D, G, H are
    per (target, source): expected children, their total lag, the compensator weight and its lag-weighted part.
    """
    ev = split(excite(rows, keys))
    lam = F.col("lam_own")
    rest = F.col("horizon") - F.col("t")
    aggs = [F.count("*").alias("n_events"), F.sum(F.log(lam)).alias("sum_log")]
    for m, c in enumerate("ud"):
        own = F.col("k") == m
        aggs.append(F.sum(F.when(own, F.col("p_bg")).otherwise(0.0)).alias(f"bg_{c}"))
        aggs.append(F.sum(F.when(own, 1.0 / lam).otherwise(0.0)).alias(f"inv_{c}"))
    for p in PAIRS:
        target, source = F.col("k") == "ud".index(p[0]), F.col("k") == "ud".index(p[1])
        fade = F.exp(-F.col(f"beta_{p}") * rest)
        aggs += [
            F.sum(F.when(target, F.col(f"from_{p[1]}") / lam).otherwise(0.0)).alias(f"P_{p}"),
            F.sum(F.when(target, F.col(f"lag_{p[1]}") / lam).otherwise(0.0)).alias(f"D_{p}"),
            F.sum(F.when(source, F.col("g") * (1.0 - fade)).otherwise(0.0)).alias(f"G_{p}"),
            F.sum(F.when(source, F.col("g") * rest * fade).otherwise(0.0)).alias(f"H_{p}"),
        ]
    carried = [F.first(c).alias(c) for c in [*MU, *ALPHA, *BETA, "total_time"]]
    out = ev.groupBy(*by).agg(*aggs, *carried)
    comp = (F.col("mu_u") + F.col("mu_d")) * F.col("total_time")
    for p in PAIRS:
        comp = comp + F.col(f"alpha_{p}") / F.col(f"beta_{p}") * F.col(f"G_{p}")
    return out.withColumn("loglik", F.col("sum_log") - comp)


def loglik(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    out = statistics(rows, keys, by)
    return out.select(*by, "n_events", "loglik", (F.col("loglik") / F.col("n_events")).alias("loglik_per_event"))


def gradient(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """d loglik / d theta in natural parameters."""
    out = statistics(rows, keys, by)
    cols = {f"g_mu_{c}": F.col(f"inv_{c}") - F.col("total_time") for c in "ud"}
    for p in PAIRS:
        a, b, g = F.col(f"alpha_{p}"), F.col(f"beta_{p}"), F.col(f"G_{p}")
        cols[f"g_alpha_{p}"] = F.col(f"P_{p}") / a - g / b
        cols[f"g_beta_{p}"] = a * g / (b * b) - F.col(f"D_{p}") - a / b * F.col(f"H_{p}")
    return out.select(*by, "n_events", "loglik", *[c.alias(n) for n, c in cols.items()])


# --------------------------------------------------------------------------- theta as JSON


def theta_json(theta: DataFrame, marks: str = "linear_normalized", axis: str = "bar_index") -> DataFrame:
    """One JSON document per theta key: parameters, marks, threshold and fit provenance."""
    matrix = lambda n: F.array(*[F.array(F.col(f"{n}_{r}u"), F.col(f"{n}_{r}d")) for r in "ud"])
    col = lambda name, kind: F.col(name) if name in theta.columns else F.lit(None).cast(kind)
    body = F.struct(
        F.array("mu_u", "mu_d").alias("mu"), matrix("alpha").alias("alpha"), matrix("beta").alias("beta"),
        F.struct(F.lit(marks).alias("name"), F.array("mark_scale_u", "mark_scale_d").alias("scale"),
                 F.array("mark_norm_u", "mark_norm_d").alias("norm")).alias("marks"),
        F.lit(axis).alias("time_axis"), F.col("event_threshold"),
        F.struct(
            F.col("day").cast("string").alias("for_day"),
            F.transform("fit_days", lambda x: x.cast("string")).alias("fit_days"), F.col("w_h").cast("long").alias("w_h"),
            F.col("candidate_moves"), (F.col("n_up") + F.col("n_down")).alias("n_events"),
            col("loglik_per_event", "double").alias("loglik_per_event"), col("converged", "boolean").alias("converged"),
        ).alias("fit"),
    )
    return theta.select(*FIT, F.to_json(body).alias("json"))


def theta_from_json(docs: DataFrame, schema) -> DataFrame:
    p = docs.withColumn("_p", F.from_json("json", schema))
    cols = {c: F.col(f"_p.mu")[i] for i, c in enumerate(MU)}
    for name in ("alpha", "beta"):
        cols |= {f"{name}_{r}{s}": F.col(f"_p.{name}")[i][j] for i, r in enumerate("ud") for j, s in enumerate("ud")}
    cols |= {f"mark_{n}_{c}": F.col(f"_p.marks.{n}")[i] for n in ("scale", "norm") for i, c in enumerate("ud")}
    cols |= {"event_threshold": F.col("_p.event_threshold"), "n_events": F.col("_p.fit.n_events")}
    return p.select(*FIT, *[c.alias(n) for n, c in cols.items()], F.col("_p.fit.fit_days").alias("fit_days"))
