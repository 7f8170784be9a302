"""Stores with a manifest: runs go on where earlier ones stopped, and compute nothing twice."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import DAY, bar_rows, trade_rows
from sparktick.operators import excitation as H
from sparktick.operators.bars import differences
from sparktick.plans.incremental import ensure_bars, ensure_theta, fit_settings, theta_keys, windows_of
from sparktick.sources.keyed import KeyedStore, bar_store, settings_key, theta_store

KEYS = "name string, part int"


def store(spark, tmp_path, **settings):
    return KeyedStore(spark, f"file://{tmp_path}/store", KEYS, settings)


def wanted(spark, *keys):
    return spark.createDataFrame(list(keys), KEYS)


def rows(spark, *values):
    return spark.createDataFrame(list(values), KEYS + ", x double")


def held(df):
    return sorted(((r.name, r.part), r.x) for r in df.collect())


def test_only_missing_keys_are_computed_and_kept(spark, tmp_path):
    place, asked = store(spark, tmp_path), []

    def compute(keys):
        found = sorted((k.name, k.part) for k in keys.collect())
        asked.append(found)
        return {"table": rows(spark, *[(n, p, float(p)) for n, p in found])}

    assert place.ensure(wanted(spark, ("a", 1), ("a", 2), ("a", 2)), compute) == 2
    assert place.ensure(wanted(spark, ("a", 2), ("b", 7)), compute) == 1
    assert place.ensure(wanted(spark, ("a", 1), ("b", 7)), compute) == 0
    assert asked == [[("a", 1), ("a", 2)], [("b", 7)]]
    assert held(place.load("table")) == [(("a", 1), 1.0), (("a", 2), 2.0), (("b", 7), 7.0)]
    assert held(place.load("table", wanted(spark, ("b", 7), ("c", 1)))) == [(("b", 7), 7.0)]


def test_settings_have_their_own_keys(spark, tmp_path):
    one, two = store(spark, tmp_path, quantile=0.5), store(spark, tmp_path, quantile=0.9)
    one.commit({"table": rows(spark, ("a", 1, 1.0))}, wanted(spark, ("a", 1)))
    assert two.missing(wanted(spark, ("a", 1))).count() == 1
    two.commit({"table": rows(spark, ("a", 1, 2.0))}, wanted(spark, ("a", 1)))
    assert held(one.load("table")) == [(("a", 1), 1.0)] and held(two.load("table")) == [(("a", 1), 2.0)]
    assert settings_key({"a": 1, "b": 2}) == settings_key({"b": 2, "a": 1}) != settings_key({"a": 1, "b": 3})


def test_last_commit_of_a_key_counts(spark, tmp_path):
    place = store(spark, tmp_path)
    place.commit({"table": rows(spark, ("a", 1, 1.0), ("a", 2, 1.0))}, wanted(spark, ("a", 1), ("a", 2)))
    place.commit({"table": rows(spark, ("a", 1, 5.0), ("a", 1, 6.0))}, wanted(spark, ("a", 1)))
    assert held(place.load("table")) == [(("a", 1), 5.0), (("a", 1), 6.0), (("a", 2), 1.0)]


def test_null_keys_and_keys_without_rows(spark, tmp_path):
    place = store(spark, tmp_path)
    place.commit({"table": rows(spark, (None, None, 1.0))}, wanted(spark, (None, None), ("empty", 1)))
    assert place.missing(wanted(spark, (None, None), ("empty", 1), ("new", None))).collect()[0].name == "new"
    assert [r.x for r in place.load("table").collect()] == [1.0]


def test_a_run_that_dies_leaves_nothing(spark, tmp_path):
    place = store(spark, tmp_path)
    place.commit({"table": rows(spark, ("a", 1, 1.0))}, wanted(spark, ("a", 1)))
    broken = rows(spark, ("b", 1, 1.0)).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        place.commit({"table": rows(spark, ("b", 1, 1.0)), "other": broken}, wanted(spark, ("b", 1)))
    assert held(place.load("table")) == [(("a", 1), 1.0)] and place.missing(wanted(spark, ("b", 1))).count() == 1
    place.commit({"table": rows(spark, ("b", 1, 2.0)), "other": rows(spark, ("b", 1, 3.0))}, wanted(spark, ("b", 1)))
    assert held(place.load("table")) == [(("a", 1), 1.0), (("b", 1), 2.0)] and held(place.load("other")) == [(("b", 1), 3.0)]
    assert {(r.name, r.n_rows) for r in place.manifest().collect()} == {("a", 1), ("b", 2)}


def test_bars_of_new_days_only(spark, tmp_path):
    days = [DAY + dt.timedelta(i) for i in range(3)]
    trades = trade_rows(spark, [100 + i % 7 for i in range(40)], day=days[0]).unionByName(trade_rows(spark, [90 + i % 5 for i in range(30)], day=days[1]))
    place = bar_store(spark, f"file://{tmp_path}/bars")
    asked = lambda *some: spark.createDataFrame([("S", d) for d in some], "symbol string, day date")
    assert ensure_bars(place, trades, 10, asked(days[0])) == 1
    assert ensure_bars(place, trades, 10, asked(*days)) == 2 and ensure_bars(place, trades, 10, asked(*days)) == 0
    assert {(r.day, r["count"]) for r in place.load("bars").groupBy("day").count().collect()} == {(days[0], 4), (days[1], 3)}


def test_theta_is_fitted_once_and_changes_with_its_days(spark, tmp_path):
    diffs = differences(bar_rows(spark, [100 + (i * 7) % 13 + (i % 5) * 0.5 for i in range(120)]))
    place = theta_store(spark, f"file://{tmp_path}/theta", fit_settings(None, restarts=1))
    key = lambda *days: spark.createDataFrame([("S", 10, 1, d) for d in days], "symbol string, num long, w_h int, day date")
    symbols = {r.symbol for r in diffs.select("symbol").distinct().collect()} | {r.num for r in diffs.select("num").distinct().collect()}
    wanted_key = key(DAY + dt.timedelta(1), DAY + dt.timedelta(9)).withColumn("symbol", F.lit(next(s for s in symbols if isinstance(s, str)))).withColumn(
        "num", F.lit(next(s for s in symbols if isinstance(s, int))).cast("long"))
    fits = []

    def fit(fit_set, head):
        fits.append(head.count())
        return H.given_theta(head, [0.1] * 4, [1.0] * 4)

    assert ensure_theta(place, diffs, wanted_key, None, fit=fit) == 2  # the later day has no bars before it: finished without theta
    assert ensure_theta(place, diffs, wanted_key, None, fit=fit) == 0 and fits == [1]
    row = place.load("theta").first()
    assert row.day == DAY + dt.timedelta(1) and row.fit_days == [DAY] and '"alpha"' in row.json
    other = theta_store(spark, f"file://{tmp_path}/theta", fit_settings(None, restarts=2))
    assert other.missing(wanted_key).count() == 2


def test_wanted_theta_keys(spark):
    jobs = spark.createDataFrame([("m", 2, 3, 0), ("m", 2, None, 0)], "model string, w_snn int, w_h int, seed int")
    folds = spark.createDataFrame([(2, DAY, DAY - dt.timedelta(i)) for i in (1, 2)] + [(5, DAY, DAY - dt.timedelta(3))], "w_snn int, test_day date, train_day date")
    symbols = spark.createDataFrame([("A", 4), ("B", 4)], "symbol string, num long")
    keys = theta_keys(jobs, folds, symbols)
    assert {(r.symbol, r.w_h, (DAY - r.day).days) for r in keys.collect()} == {(s, 3, i) for s in "AB" for i in (0, 1, 2)}
    assert windows_of(keys).count() == 9
