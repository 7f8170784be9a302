from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import DAY, bar_rows
from pyspark.sql import functions as F

from sparktick.functions.keyed import gaussian, uniform
from sparktick.operators import audit as AU
from sparktick.operators import bars as B
from sparktick.operators import excitation as H
from sparktick.operators import normalise as N
from sparktick.operators import stats as A
from sparktick.operators.quality import calendar
from sparktick.schemas import BAR_DAY
from sparktick.session import materialise
from sparktick.sources.synthetic import synthetic_trades

NUM, TESTED = 10, (0, 7, 20)


@pytest.fixture(scope="module")
def world(spark):
    return materialise(synthetic_trades(calendar(spark, "2024-01-01", "2024-01-04"), 300, 5), "world")


def diffs(trades):
    return materialise(B.differences(B.vwap_bars(trades, NUM)), "diffs")


def folds(spark):
    return spark.createDataFrame([(1, dt.date(2024, 1, 3), dt.date(2024, 1, 2))], "w_snn int, test_day date, train_day date")


def test_causal_operators_pass(spark, world):
    f = folds(spark)
    AU.check_causal(diffs, world, "2024-01-03", TESTED, NUM, ["bar_idx"], ["vwap", "d"])
    run = lambda t: N.zscore_inputs(diffs(t), f).filter("split = 'test'")
    AU.check_causal(run, world, "2024-01-03", TESTED, NUM, ["bar_idx"], ["p1", "p2"], tolerance=1e-9)


def theta_on(day_shift):
    """Intensities with theta fitted `day_shift` days before the day it is used on (0 = a leak)."""
    def run(trades):
        d = diffs(trades)
        days = d.select("day").distinct()
        windows = days.select(F.lit(1).alias("w_h"), "day", F.date_sub("day", day_shift).alias("fit_day"))
        _, head = H.fit_events(d, windows, 0.5, strict=False)
        return H.intensities(d, H.given_theta(head, (0.3, 0.1, 0.15, 0.25), (1.0, 0.5, 0.8, 1.2)))

    return run


def test_intensities_are_causal_and_leaks_are_found(spark, world):
    args = (world, "2024-01-03", TESTED, NUM, ["bar_idx"], ["lam_u", "lam_d"])
    AU.check_causal(theta_on(1), *args, tolerance=1e-9)
    with pytest.raises(AssertionError, match="rows up to bar"):
        AU.check_causal(theta_on(0), *args, tolerance=1e-9)


def test_same_day_normalisation_is_found(spark, world):
    def leaky(trades):
        d = diffs(trades)
        return N.shifted_zscore(d, N.same_day_stats(d), keys=BAR_DAY)

    with pytest.raises(AssertionError, match="rows up to bar"):
        AU.check_causal(leaky, world, "2024-01-03", TESTED, NUM, ["bar_idx"], ["p1"], tolerance=1e-9)


def test_bars_outside_the_day_are_an_error(world):
    with pytest.raises(ValueError):
        AU.check_causal(diffs, world, "2024-01-03", [30], NUM, ["bar_idx"], ["d"])


def test_perturbed_worlds_keep_the_past(spark, world):
    worlds = AU.perturbed_worlds(world, "2024-01-03", [7], NUM)
    n = {(r.symbol, r.day.day): r["count"] for r in worlds.groupBy("symbol", "day").count().collect()}
    assert n["SYN", 3] == 300 and n["SYN#7#values", 3] == 300 and n["SYN#7#truncate", 3] == 80 + 220 // AU.KEPT_OF
    assert n["SYN#7#truncate", 4] == 300 // AU.KEPT_OF and n["SYN#7#resample", 1] == 300
    assert 80 + int(0.6 * 220) <= n["SYN#7#resample", 3] <= 80 + 1.5 * 220


# --------------------------------------------------------------------------- inputs


def test_zscore_clips_and_guards(spark):
    next_day = DAY + dt.timedelta(1)
    d = B.differences(bar_rows(spark, [1, 2, 4, 3, 9]).unionByName(bar_rows(spark, [1, 2, 50, 3], day=next_day)))
    f = spark.createDataFrame([(1, next_day, DAY)], "w_snn int, test_day date, train_day date")
    rows = N.zscore_inputs(d, f).filter("split = 'test'").orderBy("bar_idx").collect()
    x = np.array([1.0, 2.0, -1.0, 6.0])
    want = np.clip((np.array([1.0, 48.0, -47.0]) - x.mean()) / x.std() * 0.1 + 0.2, 0, 1)
    assert rows[0].p1 == 0.0 and [r.p1 for r in rows[1:]] == pytest.approx(list(want))
    flat = B.differences(bar_rows(spark, [1, 1, 1]).unionByName(bar_rows(spark, [1, 2], day=next_day)))
    with pytest.raises(Exception, match="channel without spread"):
        N.zscore_inputs(flat, f).collect()


def test_encoding_is_prefix_stable_and_guarded(spark):
    rows = [("S", DAY, 10, i, 0.3, 0.7) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, day date, num long, bar_idx long, p1 double, p2 double")
    pick = lambda e: sorted((r.bar_idx, r.tick, r.s1, r.s2) for r in e.collect())
    full, part = pick(N.encode(df, 5, 1)), pick(N.encode(df.filter("bar_idx < 50"), 5, 1))
    assert part == [x for x in full if x[0] < 50]
    assert np.mean([x[2] for x in full]) == pytest.approx(0.3, abs=0.06) and np.mean([x[3] for x in full]) == pytest.approx(0.7, abs=0.06)
    with pytest.raises(Exception, match="outside"):
        N.encode(df.withColumn("p1", F.lit(1.5)), 5, 1).collect()


def test_keyed_draws(spark):
    rows = spark.range(4000).select(uniform("k", F.col("id")).alias("u"), gaussian("k", F.col("id")).alias("z")).toPandas()
    assert 0 <= rows.u.min() and rows.u.max() < 1 and rows.u.mean() == pytest.approx(0.5, abs=0.03)
    assert rows.z.mean() == pytest.approx(0, abs=0.06) and rows.z.std() == pytest.approx(1, abs=0.05)


# --------------------------------------------------------------------------- statistics


def test_two_sided_p(spark):
    zs = [0.0, 0.5, -1.96, 3.3, -6.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", A.two_sided_p(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-6)


def test_signed_rank_with_ties_and_zeros(spark):
    x = [0.0, 1.0, 1.0, -1.0, 2.0, -3.0, 4.0, 0.0, 5.0]
    r = A.signed_rank(spark.createDataFrame([("g", v) for v in x], "g string, d double"), ["g"], "d").first()
    # |x| without zeros: 1 1 1 2 3 4 5 -> ranks 2 2 2 4 5 6 7
    assert (r.n_days, r.n_used, r.days_ahead) == (9, 7, 5) and r.w_plus == 21.0 and r.w_minus == 7.0
    sd = math.sqrt(7 * 8 * 15 / 24 - (27 - 3) / 48)
    assert r.z == pytest.approx((7 - 14) / sd)


def test_signed_rank_is_exact_for_untied_days(spark):
    rng = random.Random(6)
    groups = {f"g{n}": [rng.choice([-1, 1]) * (k + rng.random() / 2) for k in range(1, n + 1)] for n in (1, 2, 5, 9, 12)}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("zero", 0.0), ("zero", 1.0), ("long", 0.5)] + [("long", 1.0 + k) for k in range(50)]
    got = {r.g: r for r in A.signed_rank(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    for g, xs in groups.items():
        w = min(sum(i + 1 for i in range(len(xs)) if (xs[i] > 0) == up) for up in (True, False))
        sums = [sum(i + 1 for i in range(len(xs)) if m >> i & 1) for m in range(1 << len(xs))]  # every pattern of signs
        assert got[g].exact and got[g].p == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / len(sums)), rel=1e-12)
    assert not got["zero"].exact and not got["long"].exact and got["long"].n_used == 51
    full = spark.range(1).select(A.rank_sum_counts(F.lit(50)).alias("c")).first().c
    assert len(full) == 1276 and sum(full) == 2.0**50 and full == full[::-1]


def test_partial_spearman_equals_residual_correlation(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=200)
    x, y = z + rng.normal(size=200), np.round(z - rng.normal(size=200), 1)
    df = spark.createDataFrame([("g", float(a), float(b), float(c)) for a, b, c in zip(x, y, z)], "g string, x double, y double, z double")
    got = A.spearman(df, ["g"], "x", "y", "z").first()

    def ranks(v):
        order = np.sort(v)
        return np.array([(np.searchsorted(order, a, "left") + np.searchsorted(order, a, "right") + 1) / 2 for a in v])

    rx, ry, rz = ranks(x), ranks(y), ranks(z)
    design = np.column_stack([np.ones(200), rz])
    ex, ey = (r - design @ np.linalg.lstsq(design, r, rcond=None)[0] for r in (rx, ry))
    assert got.rho == pytest.approx(np.corrcoef(rx, ry)[0, 1]) and got.partial == pytest.approx(np.corrcoef(ex, ey)[0, 1])


def test_logistic_recovers_coefficients(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(0.5 + 1.0 * x[:, 0] - 0.7 * x[:, 1])))
    y = (rng.random(4000) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    table = {r.term: r for r in A.coefficient_table(A.logistic(df, ["a", "b"]), df, ["a", "b"]).collect()}
    assert table["a"].coefficient == pytest.approx(1.0, abs=0.15) and table["b"].coefficient == pytest.approx(-0.7, abs=0.15)
    effect = A.signal_effect(df, ["a"], "b").first()
    assert effect.auc_with > effect.auc_without and effect.lr > 100 and effect.z < -5
