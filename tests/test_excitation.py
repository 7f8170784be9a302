from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from conftest import DAY, bar_rows, column
from pyspark.sql import functions as F

from sparktick.operators import excitation as H
from sparktick.operators import fit as FT
from sparktick.operators.bars import differences
from sparktick.schemas import THETA
from sparktick.session import materialise

MU, ALPHA, BETA = (0.11, 0.37), (0.22, 0.41, 0.07, 0.19), (0.6, 1.7, 2.3, 0.9)
NEXT = DAY + dt.timedelta(1)


def theta_row(spark, day=DAY):
    values = [*MU, *ALPHA, *BETA, 1.0, 1.0, 1.0, 1.0, None]
    names = ", ".join(f"{c} double" for c in H.THETA)
    return spark.createDataFrame([("S", 10, 1, day, *values)], f"symbol string, num long, w_h int, day date, {names}")


def moves(seed, n=70):
    """Prices with ups, downs and stops."""
    return [float(x) for x in 60 + np.cumsum(np.random.default_rng(seed).choice([0.0, 0.0, 0.75, -0.5, 1.25, -1.5], n))]


def test_events_are_the_moves(spark):
    p = moves(5)
    rows = H.events(differences(bar_rows(spark, p))).orderBy("bar_idx").collect()
    want = [(i, int(p[i] < p[i - 1]), abs(p[i] - p[i - 1]), float(len(p))) for i in range(1, len(p)) if p[i] != p[i - 1]]
    assert [(r.bar_idx, r.k, r.mark, r.horizon) for r in rows] == want


@pytest.mark.parametrize("seed", [6, 7])
def test_intensities_are_sums_over_the_past(spark, seed):
    p = moves(seed)
    d = differences(bar_rows(spark, p))
    past = [(i, int(p[i] < p[i - 1]), abs(p[i] - p[i - 1])) for i in range(1, len(p)) if p[i] != p[i - 1]]
    kinds = {i: k for i, k, _ in past}

    def rate(m, at, own):
        return MU[m] + sum(ALPHA[2 * m + k] * g * math.exp(-BETA[2 * m + k] * (at - i)) for i, k, g in past if i < at or (own and i == at))

    for side, own in (("right", True), ("left", False)):
        options = [] if own else ["left"]
        for r in H.intensities(d, theta_row(spark), *options).collect():
            assert r.lam_u == pytest.approx(rate(0, r.bar_idx, own)) and r.lam_d == pytest.approx(rate(1, r.bar_idx, own))
            if own:
                assert r.lam_u_minus == pytest.approx(rate(0, r.bar_idx, False))
                share = MU[kinds[r.bar_idx]] / rate(kinds[r.bar_idx], r.bar_idx, False) if r.bar_idx in kinds else None
                assert r.p_bg == (None if share is None else pytest.approx(share))


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    b = None
    for i in range(3):
        vwap = 100 + np.cumsum(rng.choice([0.0, 1.1, -1.0, 2.5, -0.5, -2.0], 250))
        one = bar_rows(spark, list(vwap), day=DAY + dt.timedelta(i))
        b = one if b is None else b.unionByName(one)
    return differences(b).cache()


def wanted_days(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "day date")


def brute_loglik(ev, horizon, mu, a, b):
    total = 0.0
    for t, k, _ in ev:
        lam = mu[k]
        for t2, k2, g2 in ev:
            if t2 < t:
                lam += a[k][k2] * g2 * math.exp(-b[k][k2] * (t - t2))
        total += math.log(lam)
    for m in (0, 1):
        total -= mu[m] * horizon + sum(a[m][k] / b[m][k] * g * (1 - math.exp(-b[m][k] * (horizon - t))) for t, k, g in ev)
    return total


def matrix(v):
    return [[v[0], v[1]], [v[2], v[3]]]


def test_branching_sums_to_one_and_marks_have_mean_one(spark, world):
    fit_set, head = H.fit_events(world, H.fit_windows(wanted_days(spark, NEXT), [1]), 0.3)
    means = fit_set.groupBy("k").agg(F.avg("g").alias("g")).collect()
    assert all(r.g == pytest.approx(1.0) for r in means)
    lam = H.intensities(world, H.given_theta(head, ALPHA, BETA)).filter("k is not null").collect()
    assert lam and all(r.p_bg + r.p_same + r.p_cross == pytest.approx(1.0) for r in lam)


@pytest.mark.parametrize("marks", ["unmarked", "linear_normalized", "saturating"])
def test_mark_functions(spark, world, marks):
    fit_set, _ = H.fit_events(world, H.fit_windows(wanted_days(spark, NEXT), [1]), None, marks)
    rows = fit_set.groupBy("k").agg(F.avg("g").alias("g"), F.min("g").alias("low")).collect()
    assert len(rows) == 2 and all(r.g == pytest.approx(1.0) and r.low > 0 for r in rows)


def test_missing_type_is_an_error(spark):
    b = differences(bar_rows(spark, [1, 2, 3, 4]))
    windows = H.fit_windows(wanted_days(spark, NEXT), [1])
    with pytest.raises(Exception, match="no events of one type"):
        H.fit_events(b, windows, None)[1].collect()
    assert H.fit_events(b, windows, None, strict=False)[1].collect() == []


def test_likelihood_and_gradient(spark, world):
    fit_set, head = H.fit_events(world, H.fit_windows(wanted_days(spark, DAY + dt.timedelta(2)), [2]), 0.3)
    theta = H.given_theta(head, ALPHA, BETA)
    rows = fit_set.join(theta, H.FIT)
    got = H.gradient(rows, [*H.FIT, "fit_day"], H.FIT).first()
    params = theta.first()
    days = {}
    for r in fit_set.collect():
        days.setdefault(r.fit_day, []).append((r.t, r.k, r.g))
    mu, flat = [params.mu_u, params.mu_d], [*ALPHA, *BETA]

    def ll(mu, flat):
        return sum(brute_loglik(sorted(ev), 250.0, mu, matrix(flat[:4]), matrix(flat[4:])) for ev in days.values())

    assert len(days) == 2 and got.loglik == pytest.approx(ll(mu, flat), rel=1e-9)
    eps = 1e-5
    for i, c in enumerate("ud"):
        up, down = list(mu), list(mu)
        up[i] += eps
        down[i] -= eps
        assert got[f"g_mu_{c}"] == pytest.approx((ll(up, flat) - ll(down, flat)) / (2 * eps), rel=1e-4, abs=1e-3)
    for i, p in enumerate(H.PAIRS):
        for j, name in ((i, f"g_alpha_{p}"), (4 + i, f"g_beta_{p}")):
            up, down = list(flat), list(flat)
            up[j] += eps
            down[j] -= eps
            assert got[name] == pytest.approx((ll(mu, up) - ll(mu, down)) / (2 * eps), rel=1e-4, abs=1e-3)


def test_em_raises_the_likelihood(spark, world):
    fit_set, head = H.fit_events(world, H.fit_windows(wanted_days(spark, DAY + dt.timedelta(2)), [2]), 0.3)
    scores = [FT.em_fit(fit_set, head, restarts=1, max_iter=n).first().loglik for n in (1, 3, 6)]
    assert scores[0] < scores[1] < scores[2]
    best = FT.fit_theta(fit_set, head, restarts=2, max_iter=3)
    row = best.first()
    assert best.count() == 1 and row.rho < 1 and row.n_iter <= 12 and row.candidate_moves > 0
    assert row.reason == "not converged" and FT.usable_theta(best).count() == 0


def test_both_ways_to_iterate_agree(spark, world):
    fit_set, head = H.fit_events(world, H.fit_windows(wanted_days(spark, NEXT, DAY + dt.timedelta(2)), [1, 2]), 0.3)
    fit_set, head = materialise(fit_set, "set"), materialise(head, "head")
    together = {(r.day, r.w_h, r.restart): r for r in FT.em_fit(fit_set, head, restarts=2, max_iter=4).collect()}
    alone = {(r.day, r.w_h, r.restart): r for r in FT.em_fit_in_tasks(fit_set, head, restarts=2, max_iter=4).collect()}
    assert set(together) == set(alone) and len(alone) == 8
    for key, a in alone.items():
        b = together[key]
        assert (a.n_iter, a.n_events, a.converged) == (b.n_iter, b.n_events, b.converged)
        assert all(a[c] == pytest.approx(b[c], rel=1e-6, abs=1e-9) for c in ["loglik", "rho", *H.MU, *H.ALPHA, *H.BETA])


def test_theta_never_uses_its_own_day(spark, world):
    windows = H.fit_windows(wanted_days(spark, NEXT, DAY + dt.timedelta(2)), [1, 2])
    assert all(0 < (r.day - r.fit_day).days <= r.w_h for r in windows.collect())
    changed = world.withColumn("d", F.when(F.col("day") >= NEXT, F.col("d") * 3).otherwise(F.col("d")))
    one = H.fit_windows(wanted_days(spark, NEXT), [1])
    a, b = (H.fit_events(x, one, 0.5)[1].first() for x in (world, changed))
    assert a.event_threshold == b.event_threshold and a.mark_scale_u == b.mark_scale_u


def test_json_round_trip(spark, world):
    _, head = H.fit_events(world, H.fit_windows(wanted_days(spark, NEXT), [1]), 0.5)
    theta = H.given_theta(head, ALPHA, BETA)
    back = H.theta_from_json(H.theta_json(theta), THETA).first()
    row = theta.first()
    assert all(back[c] == row[c] for c in H.THETA) and back.fit_days == [str(DAY)]


def test_spectral_radius(spark):
    rng = np.random.default_rng(3)
    mats = rng.random((20, 4))
    cols = ", ".join(f"alpha_{p} double, beta_{p} double" for p in H.PAIRS)
    df = spark.createDataFrame([(i, *[x for v in m for x in (float(v), 1.0)]) for i, m in enumerate(mats)], f"i int, {cols}")
    for r in H.branching_matrix(df).collect():
        assert r.rho == pytest.approx(max(abs(np.linalg.eigvals(mats[r.i].reshape(2, 2)))))


def test_event_checks(spark, world):
    ev = H.events(world)
    assert H.event_violations(ev).count() == 0
    assert H.event_violations(ev.withColumn("t", F.lit(1e9))).count() == ev.count()
    assert column(H.rewards(ev.withColumn("momentum", F.lit(0.5)).limit(1)), "reward_rev") == [-0.5]
