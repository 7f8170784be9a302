"""Normalisation and encoding (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktick.operators import normalise as N
from sparktick.operators.labels import PRICE_FEATURES
from sparktick.queries import common as C
from sparktick.queries import label_queries as LQ
from sparktick.queries import sql as S
from sparktick.queries.registry import query, r, rs
from sparktick.schemas import BAR, BAR_DAY

_B = "symbol, day, num, bar_idx"
_KEY = "symbol, day, num, bar_idx, w_snn, test_day, split"
_STATS = [f"{a}_{x}" for x in ("x1", "x2") for a in ("mean", "std")]


@query(
    "n1_channel_stats",
    S.chain(S.folds(1, 3), S.ZSCORE) + f"SELECT symbol, num, w_snn, test_day, n_x1, n_x2, {rs(*_STATS)} FROM zst",
)
def n1(spark, sf):
    stats = N.fold_stats(C.diffs(spark, sf), C.folds(spark, sf, 1, 3), ["x1", "x2"])
    return stats.select(*N.FOLD, "n_x1", "n_x2", *_STATS)


@query("n2_shifted_zscore", S.chain(S.folds(1, 3), S.ZSCORE) + f"SELECT {_KEY}, {rs('p1', 'p2')} FROM zin")
def n2(spark, sf):
    return N.zscore_inputs(C.diffs(spark, sf), C.folds(spark, sf, 1, 3)).select(*_KEY.split(", "), "p1", "p2")


@query(
    "n2_same_day_zscore",
    S.chain() + f""", st AS (SELECT *, avg(d) OVER p AS m, stddev_pop(d) OVER p AS s FROM dd WINDOW p AS (PARTITION BY symbol, day, num))
SELECT {_B}, {r("CASE WHEN d IS NULL THEN 0.0 ELSE greatest(least((d - m) / s * 0.1 + 0.2, 1.0), 0.0) END", "p1")},
  {r("CASE WHEN d IS NULL THEN 0.0 ELSE greatest(least((-d + m) / s * 0.1 + 0.2, 1.0), 0.0) END", "p2")} FROM st""",
)
def n2_same_day(spark, sf):
    d = C.diffs(spark, sf)
    return N.shifted_zscore(d, N.same_day_stats(d), keys=BAR_DAY).select(*BAR, "p1", "p2")


EXCITED_ONLY = f"""lst AS ({S.fold_stats(['lam_u', 'lam_d'], 'lam')}),
lin AS (SELECT x.*, s.w_snn, s.test_day, s.split, greatest(least(lam_u * (0.2 / mean_lam_u), 1.0), 0.0) AS p1,
  greatest(least(lam_d * (0.2 / mean_lam_d), 1.0), 0.0) AS p2
  FROM lam x JOIN scoped s USING (day) JOIN lst USING (symbol, num, w_snn, test_day))"""
EXCITED = S.SCOPED + ",\n" + EXCITED_ONLY
_EXC = [S.events(), S.theta(), S.LAM]


@query("n3_intensity_rates", S.chain(S.folds(1, 2), *_EXC, EXCITED) + f"SELECT {_KEY}, {rs('p1', 'p2')} FROM lin")
def n3(spark, sf):
    lam = C.intensities(spark, C.bar_table(spark, sf))
    return N.intensity_inputs(lam, C.folds(spark, sf, 1, 2)).select(*_KEY.split(", "), "p1", "p2")


_NORM2 = """, z2 AS (SELECT symbol, num, w_snn, test_day, count(p1) AS n, avg(p1) AS mean_p1, stddev_pop(p1) AS std_p1 FROM zin WHERE split = 'train' GROUP BY ALL)
"""


@query(
    "n4_two_step_fit",
    S.chain(S.folds(2), S.ZSCORE) + _NORM2 + f"SELECT symbol, num, w_snn, test_day, n AS n_p1, {rs('mean_p1', 'std_p1')} FROM z2",
)
def n4(spark, sf):
    """A second step is fitted on training days as the first step left them."""
    inputs = N.zscore_inputs(C.diffs(spark, sf), C.folds(spark, sf, 2))
    train = inputs.filter("split = 'train'")
    return train.groupBy(*N.FOLD).agg(
        F.count("p1").alias("n_p1"), F.avg("p1").alias("mean_p1"), F.stddev_pop("p1").alias("std_p1")
    )


_U = S.uniform("'7'", "'test'", "symbol", "day", "'0'", "bar_idx", "tick", "'{}'")
_ENC = f""", enc AS (SELECT z.*, tick, CAST({_U.format(1)} < p1 AS INTEGER) AS s1, CAST({_U.format(2)} < p2 AS INTEGER) AS s2
  FROM zin z, (SELECT unnest(range(0, 10)) AS tick) WHERE split = 'test')"""


def _encoded(spark, sf):
    inputs = N.zscore_inputs(C.diffs(spark, sf), C.folds(spark, sf, 1)).filter("split = 'test'")
    return N.encode(inputs, 10, 7)


@query(
    "n5_bernoulli_counts",
    S.chain(S.folds(1), S.ZSCORE) + _ENC + f"SELECT {_B}, CAST(sum(s1) AS BIGINT) AS spikes_1, CAST(sum(s2) AS BIGINT) AS spikes_2 FROM enc GROUP BY ALL",
)
def n5(spark, sf):
    return N.spike_counts(_encoded(spark, sf), BAR)


@query(
    "n6_input_stats",
    S.chain(S.folds(1), S.ZSCORE) + _ENC + f"""SELECT symbol, day, num, {r('sum(s1) / count(*)', 'rate_x1')}, {r('sum(s2) / count(*)', 'rate_x2')},
  {r('avg(p1)', 'prob_x1')}, {r('avg(p2)', 'prob_x2')} FROM enc GROUP BY symbol, day, num""",
)
def n6(spark, sf):
    counts = N.spike_counts(_encoded(spark, sf), [*BAR, "p1", "p2"])
    return N.input_stats(counts, BAR_DAY, 10)


# NULL inputs (bar 0) are 0 before clipping in the z-score encoding.
_ZP = """, zp AS (SELECT nm.new_mean, 'zscore' AS encoding,
    CASE WHEN d IS NULL THEN 0.0 ELSE greatest(least((d - mean_x1) / std_x1 * 0.1 + nm.new_mean, 1.0), 0.0) END AS p1,
    CASE WHEN d IS NULL THEN 0.0 ELSE greatest(least((-d - mean_x2) / std_x2 * 0.1 + nm.new_mean, 1.0), 0.0) END AS p2
  FROM xs JOIN scoped s USING (day) JOIN zst USING (symbol, num, w_snn, test_day), (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS new_mean) nm WHERE split = 'test'),
lp AS (SELECT nm.new_mean, 'intensity' AS encoding, greatest(least(lam_u * (nm.new_mean / mean_lam_u), 1.0), 0.0) AS p1,
    greatest(least(lam_d * (nm.new_mean / mean_lam_d), 1.0), 0.0) AS p2
  FROM lam JOIN scoped s USING (day) JOIN lst USING (symbol, num, w_snn, test_day), (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS new_mean) nm WHERE split = 'test'),
al AS (SELECT * FROM zp UNION ALL SELECT * FROM lp)
"""


@query(
    "n7_clipping_shares",
    S.chain(S.folds(1), S.ZSCORE, *_EXC, f"lst AS ({S.fold_stats(['lam_u', 'lam_d'], 'lam')})") + _ZP + f"""
SELECT new_mean, encoding, {r('avg(p1)', 'mean_p1')}, {r('avg(p2)', 'mean_p2')},
  {r('(avg(CAST(p1 >= 1 AS INTEGER)) + avg(CAST(p2 >= 1 AS INTEGER))) / 2', 'at_1')},
  {r('(avg(CAST(p1 <= 0 AS INTEGER)) + avg(CAST(p2 <= 0 AS INTEGER))) / 2', 'at_0')} FROM al GROUP BY new_mean, encoding""",
)
def n7(spark, sf):
    d, folds = C.bar_table(spark, sf), C.folds(spark, sf, 1)
    means = F.explode(F.array(*[F.lit(m) for m in (0.05, 0.1, 0.2)]))
    lam = C.intensities(spark, d)
    parts = []
    for name, source, cols, fn in (
        ("zscore", d, ["x1", "x2"], lambda rows, st: N.shifted_zscore(rows, st, F.col("new_mean"))),
        ("intensity", lam, ["lam_u", "lam_d"], lambda rows, st: N.intensity_rates(rows, st, F.col("new_mean"))),
    ):
        rows = N.fold_rows(source.select(*BAR, *cols), folds).filter("split = 'test'").withColumn("new_mean", means)
        shares = fn(rows, N.fold_stats(source, folds, cols)).withColumn("encoding", F.lit(name))
        parts.append(shares.select("new_mean", "encoding", "p1", "p2"))
    return N.clipping_shares(parts[0].unionByName(parts[1]), ["new_mean", "encoding"])


_FIT = """, st AS (SELECT *, day < (SELECT min(day) + CAST((max(day) - min(day) + 1) // 2 AS INTEGER) FROM tr) AS fit_half FROM fl),
agg AS (SELECT {aggs} FROM st WHERE fit_half) SELECT symbol, day, num, bar_idx, fit_half, {cols} FROM st, agg"""


@query(
    "n8_standardised_features",
    LQ._FLOW.rsplit("\nSELECT", 1)[0] + ", fl AS (SELECT * FROM f WHERE ret <> 0 AND bar_idx >= 20)" + _FIT.format(
        aggs=", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) = 0 THEN 1.0 ELSE stddev_samp({c}) END AS s_{c}" for c in PRICE_FEATURES),
        cols=", ".join(r(f"greatest(least(({c} - m_{c}) / s_{c}, 10.0), -10.0)", c) for c in PRICE_FEATURES),
    ),
)
def n8(spark, sf):
    rows = N.half_split(LQ.flow(spark, sf), C.trades(spark, sf))
    return N.standardise_features(rows, PRICE_FEATURES).select(*BAR, "fit_half", *PRICE_FEATURES)
