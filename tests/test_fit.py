"""Constrained maximum likelihood: the M-step, the slopes, both engines, recovery of known parameters and rejected keys."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktick.operators import excitation as H
from sparktick.operators import fit as FT
from sparktick.session import materialise

from conftest import DAY

NEXT = DAY + dt.timedelta(1)


def test_constrained_branching_step_is_the_best_feasible_one():
    rng = random.Random(4)
    for _ in range(60):
        kids = [rng.choice([0.0, rng.uniform(0, 40)]) for _ in range(4)]
        weight = [rng.uniform(5, 40) for _ in range(4)]
        got = FT.branching_step(kids, weight)
        assert FT.radius(got) <= FT.RHO_MOST + 1e-9 and all(a >= 0 for a in got)

        def gain(a):
            return sum(k * math.log(max(x, 1e-12)) - w * x for k, w, x in zip(kids, weight, a))

        for _ in range(400):
            other = [max(1e-12, a * math.exp(rng.gauss(0, 0.3))) for a in got]
            shrink = min(1.0, FT.RHO_MOST / FT.radius(other))
            assert gain([a * shrink for a in other]) <= gain(got) + 1e-7


def made_events(days, rate, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        n = rng.poisson(rate)
        t = np.sort(rng.uniform(0, 100.0, n))
        rows += [("S", 10, 1, NEXT, DAY - dt.timedelta(d), i, float(x), int(rng.integers(0, 2)), float(rng.exponential()), 100.0) for i, x in enumerate(t)]
    return rows


EVENTS = "symbol string, num long, w_h int, day date, fit_day date, bar_idx long, t double, k int, g double, horizon double"


def test_slopes_are_those_of_the_likelihood():
    events = pd.DataFrame(made_events(2, 60, 3), columns=[c.split()[0] for c in EVENTS.split(", ")])
    sums = FT.KeySums(events)
    rng = random.Random(1)
    for _ in range(10):
        value = {"mu_u": rng.uniform(0.1, 0.5), "mu_d": rng.uniform(0.1, 0.5), "total_time": 200.0}
        value |= {f"beta_{p}": rng.uniform(0.3, 2) for p in H.PAIRS}
        value |= {f"alpha_{p}": rng.uniform(0.05, 0.4) * value[f"beta_{p}"] for p in H.PAIRS}
        numeric = []
        for name, kind in [(m, "mu") for m in H.MU] + [(p, k) for p in H.PAIRS for k in ("ratio", "beta")]:
            ends = []
            for e in (1e-5, -1e-5):
                v = dict(value)
                if kind == "mu":
                    v[name] *= 1 + e
                else:
                    v[f"alpha_{name}"] *= 1 + e
                    if kind == "beta":
                        v[f"beta_{name}"] *= 1 + e
                ends.append(sums.at(v)["loglik"])
            numeric.append((ends[0] - ends[1]) / 2e-5)
        assert FT.steepness(value, sums.at(value)) == pytest.approx(max(map(abs, numeric)) / len(events), rel=1e-3)


def fit_frame(spark, rows):
    fit_set = materialise(spark.createDataFrame(rows, EVENTS), "set")
    head = fit_set.groupBy(*H.FIT).agg(
        F.count_if(F.col("k") == 0).alias("n_up"), F.count_if(F.col("k") == 1).alias("n_down"), (100.0 * F.countDistinct("fit_day")).alias("total_time"))
    return fit_set, materialise(head, "head")


def test_both_engines_reach_the_same_optimum(spark):
    fit_set, head = fit_frame(spark, made_events(2, 40, 5))
    alone = FT.em_fit_in_tasks(fit_set, head, restarts=1, tol=1e-2).first()
    together = FT.em_fit(fit_set, head, restarts=1, tol=1e-2).first()
    assert alone.converged and together.converged and alone.n_iter == together.n_iter
    assert all(together[c] == pytest.approx(alone[c], rel=1e-6) for c in FT.PARAMS)
    split = FT.fit_theta(fit_set, head, restarts=1, tol=1e-2, most_events=10).first()  # all keys are "large"
    assert split.converged and split.loglik == pytest.approx(alone.loglik, rel=1e-9)


def test_explosive_events_end_at_the_bound(spark):
    """Events that breed ever more events have no stationary optimum of their own: the bound holds and its multiplier is used."""
    rows = [("S", 10, 1, NEXT, DAY, i, 99.9 * math.log(i + 1) / math.log(400), i % 2, 1.0, 100.0) for i in range(400)]
    fit_set, head = fit_frame(spark, rows)
    row = FT.fit_theta(fit_set, head, restarts=2).first()
    assert row.converged and row.rho == pytest.approx(FT.RHO_MOST, abs=1e-4)


def simulated(seed, horizon, mu, alpha, beta):
    """Thinning, with exponential marks of mean one."""
    rng = np.random.default_rng(seed)
    s, t, out = np.zeros((2, 2)), 0.0, []
    while True:
        top = float((mu + (alpha * s).sum(axis=1)).sum())
        gap = rng.exponential(1 / top)
        t += gap
        if t >= horizon:
            return out
        s *= np.exp(-beta * gap)
        lam = mu + (alpha * s).sum(axis=1)
        u = rng.uniform() * top
        if u < lam.sum():
            k = int(u >= lam[0])
            g = rng.exponential()
            out.append((t, k, g))
            s[:, k] += g


def test_known_parameters_are_recovered(spark):
    mu, alpha, beta = np.array([0.25, 0.15]), np.array([[0.5, 0.2], [0.1, 0.35]]), np.array([[1.5, 0.6], [0.4, 0.9]])
    rows = [
        ("S", 10, 4, NEXT, DAY - dt.timedelta(d), i, t, k, g, 6000.0)
        for d in range(4) for i, (t, k, g) in enumerate(simulated(d, 6000.0, mu, alpha, beta))
    ]
    fit_set, head = fit_frame(spark, rows)
    row = FT.fit_theta(fit_set, head.withColumn("total_time", F.lit(24_000.0)), restarts=2, tol=1e-5).first()
    assert row.converged and row.n_events > 15_000
    assert [row.mu_u, row.mu_d] == pytest.approx(list(mu), rel=0.15)
    assert [row[f"A_{p}"] for p in H.PAIRS] == pytest.approx(list((alpha / beta).ravel()), rel=0.2)
    assert [row[c] for c in H.BETA] == pytest.approx(list(beta.ravel()), rel=0.35)


def test_rejected_keys_say_why(spark):
    few = [("F", 10, 1, NEXT, DAY, i, float(i), i % 2, 1.0, 100.0) for i in range(5)]
    fit_set, head = fit_frame(spark, made_events(1, 50, 8) + few)
    theta = FT.fit_theta(fit_set, head, restarts=2)
    assert theta.count() == 2 and [r.symbol for r in FT.usable_theta(theta).collect()] == ["S"]
    wanted = spark.createDataFrame([(s, 10, 1, NEXT) for s in "SFX"], "symbol string, num long, w_h int, day date")
    assert {(r.symbol, r.reason) for r in FT.theta_rejects(wanted, theta).collect()} == {("F", "too few events"), ("X", "one kind of event missing")}


def test_no_keys(spark):
    fit_set, head = fit_frame(spark, [])
    assert FT.fit_theta(fit_set, head).count() == 0


def test_restarts_of_one_key_are_spread_over_tasks(spark):
    """A key that is fitted again with many restarts must not be one task's work; a null in a key stays a key."""
    rows = made_events(1, 40, 9)
    rows += [(None, *row[1:]) for row in rows]
    fit_set, head = fit_frame(spark, rows)
    fits = FT.em_fit_in_tasks(fit_set, head, restarts=12, max_iter=4)
    placed = fits.select("symbol", "restart", "n_events", F.input_file_name().alias("file"))
    per_key = placed.groupBy("symbol").agg(F.countDistinct("restart").alias("n"), F.countDistinct("file").alias("tasks"), F.max("n_events").alias("events"))
    found = {r["symbol"]: r for r in per_key.collect()}
    assert set(found) == {"S", None}
    assert all(r["n"] == 12 and r["tasks"] > 1 and r["events"] == len(rows) // 2 for r in found.values())


def test_sums_are_those_of_all_pairs_of_events():
    """One event, several days, and decays so fast that doubling ends early."""
    rng = random.Random(5)
    for days, rate, seed in ((1, 1, 1), (1, 5, 2), (3, 30, 3), (2, 90, 4)):
        events = pd.DataFrame(made_events(days, rate, seed), columns=[c.split()[0] for c in EVENTS.split(", ")])
        if events.empty:
            continue
        value = {"mu_u": 0.2, "mu_d": 0.3, "total_time": 100.0 * days}
        value |= {f"beta_{p}": rng.choice([1e-3, 0.3, 50.0]) for p in H.PAIRS} | {f"alpha_{p}": rng.uniform(0.05, 0.4) for p in H.PAIRS}
        want = {f"{x}_{p}": 0.0 for x in "PDGH" for p in H.PAIRS} | {"loglik": -(value["mu_u"] + value["mu_d"]) * value["total_time"], "bg_u": 0.0, "bg_d": 0.0}
        table = list(events[["fit_day", "t", "k", "g", "bar_idx"]].itertuples(index=False))
        for day, t, k, g, i in table:
            c, past = "ud"[k], [(t - s, "ud"[k2], g2) for day2, s, k2, g2, j in table if day2 == day and j < i]
            part = {s: value[f"alpha_{c}{s}"] * sum(w * math.exp(-value[f"beta_{c}{s}"] * a) for a, m, w in past if m == s) for s in "ud"}
            aged = {s: value[f"alpha_{c}{s}"] * sum(w * a * math.exp(-value[f"beta_{c}{s}"] * a) for a, m, w in past if m == s) for s in "ud"}
            rate_now = value[f"mu_{c}"] + sum(part.values())
            want["loglik"] += math.log(rate_now)
            want[f"bg_{c}"] += value[f"mu_{c}"] / rate_now
            for s in "ud":
                want[f"P_{c}{s}"] += part[s] / rate_now
                want[f"D_{c}{s}"] += aged[s] / rate_now
            for target in "ud":
                gone = math.exp(-value[f"beta_{target}{c}"] * (100.0 - t))
                want[f"G_{target}{c}"] += g * (1 - gone)
                want[f"H_{target}{c}"] += g * (100.0 - t) * gone
                want["loglik"] -= value[f"alpha_{target}{c}"] / value[f"beta_{target}{c}"] * g * (1 - gone)
        got = FT.KeySums(events).at(value)
        assert got["n_events"] == len(events)
        for name, x in want.items():
            assert got[name] == pytest.approx(x, rel=1e-9, abs=1e-12), name


def test_long_keys_take_their_sums_from_a_grid():
    """Sums of a grid are those of doubling: days of several lengths, ends that do not fill the grid, equal and all-different lags."""
    rng = random.Random(6)
    for days, rate, seed, whole in ((1, FT.SHORT_EVENTS + 90, 1, True), (3, 700, 2, False), (1, 9_000, 3, True), (40, 50, 4, False)):
        events = pd.DataFrame(made_events(days, rate, seed), columns=[c.split()[0] for c in EVENTS.split(", ")])
        if whole:
            events["t"] = np.floor(events["t"] * rate) / 10
            events["horizon"] *= rate / 10
        sums = FT.key_sums(events)
        assert isinstance(sums, FT.GridSums) and isinstance(FT.key_sums(events[:FT.SHORT_EVENTS]), FT.KeySums)
        for _ in range(4):
            value = {"mu_u": 0.2, "mu_d": 0.3, "total_time": 100.0 * days}
            value |= {f"beta_{p}": rng.choice([1e-3, 0.3, 5.0, 900.0]) for p in H.PAIRS} | {f"alpha_{p}": rng.uniform(0.05, 0.4) for p in H.PAIRS}
            want, got = FT.KeySums(events).at(value), sums.at(value)
            assert want.keys() == got.keys()
            for name, x in want.items():
                assert got[name] == pytest.approx(x, rel=1e-10, abs=1e-12), name


def test_restarts_are_dealt_to_tasks_in_turn(spark):
    """As many restarts for every task, and more tasks than partitions where a fit may take many steps; nulls in a key are a key."""
    rows = made_events(1, 40, 9)
    rows += [(None, *row[1:]) for row in rows]
    fit_set, head = fit_frame(spark, rows)
    parts, restarts = int(spark.conf.get("spark.sql.shuffle.partitions")), 5 * FT.MOST_TOGETHER
    for max_iter, tasks in ((4, [3, 3, 2, 2]), (FT.LONG_FIT, [1] * 10)):
        assert parts == 4
        fits = FT.em_fit_in_tasks(fit_set, head, restarts=restarts, max_iter=max_iter, tol=1e-2)
        per_task = fits.groupBy(F.input_file_name()).agg(F.count("*").alias("n"))
        assert sorted((r["n"] for r in per_task.collect()), reverse=True) == [FT.MOST_TOGETHER * n for n in tasks]
        assert fits.select("symbol", "restart").distinct().count() == 2 * restarts


def test_restarts_side_by_side_are_those_one_by_one():
    """The same numbers to the last bit, also for restarts that end earlier than their neighbours."""
    events = pd.DataFrame(made_events(2, 120, 7), columns=[c.split()[0] for c in EVENTS.split(", ")])
    rng = random.Random(8)
    starts = []
    for restart in range(7):
        beta = {f"beta_{p}": rng.choice([1e-3, 0.5, 2.0, 400.0]) for p in H.PAIRS}
        alpha = {f"alpha_{p}": rng.uniform(0.05, 0.4) * beta[f"beta_{p}"] for p in H.PAIRS}
        key = {"symbol": "S", "num": 10, "w_h": 1, "day": NEXT, "restart": restart, "total_time": 200.0}
        starts.append(key | {"mu_u": rng.uniform(0.1, 0.5), "mu_d": rng.uniform(0.1, 0.5)} | beta | alpha)
    sums = FT.KeySums(events)
    assert sums.at_all(starts) == [sums.at(start) for start in starts]
    fit = FT._in_task(60, 1e-3, True)
    together = fit(events, pd.DataFrame(starts)).sort_values("restart").reset_index(drop=True)
    alone = pd.concat([fit(events, pd.DataFrame([start])) for start in starts], ignore_index=True)
    assert together.equals(alone) and together["n_iter"].nunique() > 1
