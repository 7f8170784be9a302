"""Signals from encoded inputs: exact training rates, seeds that differ, draws that do not depend on the rest of the day."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DAY
from sparktick.operators import normalise as N
from sparktick.operators import signals as G

INPUT = "symbol string, day date, num long, bar_idx long, w_snn int, test_day date, split string, p1 double, p2 double"
TEST = DAY + dt.timedelta(3)


def inputs(spark, n=300, p=lambda i: 0.2, days=3):
    train = [("S", DAY + dt.timedelta(d), 10, i, days, TEST, "train", p(i), 0.2) for d in range(days) for i in range(n)]
    return spark.createDataFrame(train + [("S", TEST, 10, i, days, TEST, "test", p(i), 0.2) for i in range(n)], INPUT)


@pytest.mark.parametrize("rate", [0.01, 0.1, 0.37, 0.9])
def test_training_rate_is_the_target(spark, rate):
    rows = G.encoded_score(G.with_seeds(inputs(spark), [0, 1, 2]), 5, F.col("seed"))
    fired = {(r.seed, r.split): r["count"] for r in G.score_signals(rows, ["seed"], rate).groupBy("seed", "split").count().collect()}
    assert all(abs(fired[s, "train"] - rate * 900) <= 1 for s in range(3))
    assert all(0 < fired.get((s, "test"), 1) <= 300 for s in range(3))


def test_seeds_draw_differently_and_repeatably(spark):
    def bars(seed, parts):
        rows = G.encoded_score(inputs(spark).repartition(parts), 8, seed)
        return {(r.day, r.bar_idx, round(r.score, 12)) for r in G.score_signals(rows, [], 0.1).collect()}

    assert bars(0, 3) == bars(0, 7)
    assert len({x[:2] for x in bars(0, 3)} & {x[:2] for x in bars(1, 3)}) < 0.6 * len(bars(0, 3))


def test_score_is_the_encoders_spike_count(spark):
    rows = inputs(spark, 40, lambda i: (i % 11) / 10, days=1)
    counts = N.spike_counts(N.encode(rows.filter("split = 'test'"), 6, 4), ["day", "bar_idx"])
    both = G.encoded_score(rows.filter("split = 'test'"), 6, 4).join(counts, ["day", "bar_idx"]).collect()
    assert len(both) == 40 and all(int(r.score) == r.spikes_1 + r.spikes_2 for r in both)


def test_higher_inputs_fire_more_often(spark):
    rows = G.encoded_score(inputs(spark, 300, lambda i: 0.6 if i % 10 == 0 else 0.1), 10, 0)
    fired = [r.bar_idx % 10 == 0 for r in G.score_signals(rows, [], 0.1).collect()]
    assert sum(fired) > 0.7 * len(fired)


def test_keyed_shuffle_is_a_permutation_of_any_range(spark):
    from sparktick.functions.keyed import shuffle_shifts, shuffled

    sizes = [1, 2, 3, 7, 64, 101, 1000]
    rows = spark.createDataFrame([(m,) for m in sizes], "m long").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    got = rows.select("m", "i", shuffled(F.col("i"), F.col("m"), shuffle_shifts(F.col("m"), "k", F.col("m")), "k", F.col("m")).alias("x")).collect()
    for m in sizes:
        images = [r.x for r in sorted((r for r in got if r.m == m), key=lambda r: r.i)]
        assert sorted(images) == list(range(m))
        assert m < 50 or images != sorted(images)
        assert m < 1000 or abs(sum(a < b for a, b in zip(images, images[1:])) - 500) < 80  # neighbours go apart


def test_random_bars_are_spread_evenly_and_need_no_shuffle(spark):
    ref = spark.createDataFrame([("S", DAY, 10, 0, 20, 104)], "symbol string, day date, num long, seed int, n_signals long, n_bars long")
    rows = G.random_bars(ref, ["seed"], 400, {"r": 3})
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = rows.collect()
    assert len(got) == len({(r.rep, r.bar_idx) for r in got}) == 400 * 20
    counts = [sum(r.bar_idx == b for r in got) for b in range(3, 103)]
    assert sum(counts) == 8000 and min(counts) > 40 and max(counts) < 125  # 80 each, on average
    assert sum((c - 80) ** 2 / 80 for c in counts) < 150  # 99 degrees of freedom, less by drawing without repeats


def test_random_bars_beyond_what_is_eligible(spark):
    ref = spark.createDataFrame([("S", DAY, 10, 0, 50, 10), ("T", DAY, 10, 0, 5, 3), ("U", DAY, 10, 0, 0, 50)], "symbol string, day date, num long, seed int, n_signals long, n_bars long")
    got = G.random_bars(ref, ["seed"], 2, {"r": 3}).collect()
    assert {(r.symbol, r.rep): sorted(x.bar_idx for x in got if (x.symbol, x.rep) == (r.symbol, r.rep)) for r in got} == {("S", i): [3, 4, 5, 6, 7, 8] for i in (0, 1)}


def test_draws_in_tasks_are_those_of_the_columns(spark):
    from sparktick.functions.keyed import images, joined, shuffle_shifts, shuffled, uniform, uniforms

    rows = spark.range(300).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("s"), F.lit(301).cast("long").alias("m"))
    key = ("k", F.col("s"), F.col("id"))
    got = rows.select(joined(*key).alias("text"), uniform(*key).alias("u")).collect()
    assert uniforms(r.text.encode() for r in got).tolist() == [r.u for r in got]
    shifts = shuffle_shifts(F.col("m"), "a", 5)
    one = rows.select("id", shifts.alias("shifts"), shuffled(F.col("id"), F.col("m"), shifts, "a", 5).alias("x")).orderBy("id").collect()
    assert images(np.arange(300), 301, one[0].shifts, "a|5").tolist() == [r.x for r in one]


def test_scores_and_samples_are_made_once(spark, sf):
    """Draws cost more than all else: what is read more than once is a written table, dealt to all tasks."""
    from sparktick.queries import backtests, signal_queries

    scored = signal_queries.seeded_scores(inputs(spark), [0, 1])
    assert "_scratch" in scored.__dict__ and scored.count() == 2 * inputs(spark).count()
    x, scored = backtests._scored_experiment(spark, sf)
    assert x.naive is x.naive and x.naive_daily() is x.naive_daily()
    assert all("_scratch" in t.__dict__ for t in (x.rates, x.big, x.naive, x.naive_daily()))
    assert "MapInArrow" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_dealt_to_all_tasks(spark):
    from sparktick.functions.rules import momentum
    from sparktick.plans.backtest import naive_signals

    rates = spark.createDataFrame([("j", "S", DAY, 4, 0, 10_000, 20_000)], "job string, symbol string, day date, num long, seed int, n_signals long, n_bars long")
    drawn = naive_signals(rates, [momentum(3)], 2)
    assert drawn.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert drawn.count() == 20_000 and drawn.distinct().count() == 20_000


def test_jobs_of_one_seed_share_their_draws(spark, monkeypatch):
    """The samples are those drawn for each job alone; a job without signals and a null seed stay what they were."""
    from sparktick.functions.rules import momentum
    from sparktick.plans import backtest

    schema = "job string, symbol string, day date, num long, seed int, n_signals long, n_bars long"
    jobs = [("a", 0, 40), ("b", 0, 25), ("c", 1, 30), ("d", 1, 0), ("e", 0, 2000), ("f", None, 5)]
    rates = spark.createDataFrame([(j, "S", DAY, 4, seed, n, 1000) for j, seed, n in jobs], schema)
    alone = G.random_bars(rates, ["job", "seed"], 2, {"momentum": 3}).select("job", "rule", "rep", "symbol", "day", "num", "bar_idx")
    seen = []

    def drawn(reference, *args, **options):
        seen.append(sorted((r.seed is None, r.seed, r.n_signals) for r in reference.collect()))
        return G.random_bars(reference, *args, **options)

    monkeypatch.setattr(backtest, "random_bars", drawn)
    got = backtest.naive_signals(rates, [momentum(3)], 2)
    assert seen == [[(False, 0, 2000), (False, 1, 30), (True, None, 5)]]
    assert got.columns == alone.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, alone.collect()))


def test_rows_of_one_bar_lie_side_by_side(spark):
    """Folds and models of a bar share its draws within a batch; they must not be scattered over a task's rows."""
    from sparktick.queries import signal_queries

    both = inputs(spark, 400).withColumn("model", F.lit("a")).unionByName(inputs(spark, 400).withColumn("model", F.lit("b")))
    rows = signal_queries.seeded_scores(both, [0, 1], ["model"])
    # A file is a task's rows in their order.
    placed = rows.select("split", "day", "bar_idx", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    bars = {}
    for r in placed:
        bars.setdefault((r.split, r.day, r.bar_idx), []).append((r.file, r.at))
    assert all(len({f for f, _ in v}) == 1 and max(a for _, a in v) - min(a for _, a in v) == len(v) - 1 for v in bars.values())
    assert all(len(v) % 4 == 0 for v in bars.values())
    one = signal_queries.seeded_scores(inputs(spark, 400), [0, 1])
    assert sorted(map(tuple, rows.filter("model = 'b'").select(one.columns).collect())) == sorted(map(tuple, one.collect()))


def test_an_audited_day_needs_no_other_days_theta(spark, sf):
    """Intensities of one day are those of the whole run; no other day is fitted."""
    from sparktick.queries import common

    d = common.bar_table(spark, sf)
    day = max(str(r.day) for r in common.theta(spark, d)[1].select("day").collect())
    one = common.intensities(spark, d, day=day)
    assert [str(r.day) for r in common.theta(spark, d, day=day)[1].select("day").collect()] == [day]
    whole = common.intensities(spark, d).filter(F.col("day") == F.to_date(F.lit(day)))
    columns = ["symbol", "day", "num", "w_h", "bar_idx", "k", *[F.round(c, 9).alias(c) for c in ("lam_u", "lam_d", "momentum")]]
    found = sorted(map(str, one.select(columns).collect()))
    assert found and found == sorted(map(str, whole.select(columns).collect()))


def test_many_draws_are_hashed_together(monkeypatch):
    """md5 of every text with every tail, whatever the lengths; many texts are not hashed one by one."""
    import hashlib
    import random

    from sparktick.functions import keyed

    draw = random.Random(1)
    texts = [bytes(draw.randrange(256) for _ in range(n)) for n in (0, 1, 3, 4, 40, 52, 54, 55, 56, 57, 63, 64, 119, 120, 121, 200) for _ in range(70)]
    tails = [b"", b"1|2", b"10|1", b"x" * 70]
    want = [[int.from_bytes(hashlib.md5(t + tail).digest()[:8], "big") for tail in tails] for t in texts]
    assert keyed.first_words(texts[:9], tails).tolist() == want[:9] and keyed.first_words([], tails).shape == (0, 4)
    sizes = {(n, key): [(i * 7919 + 13) % n for i in range(20)] for n in (1, 1023, 5000, 10**6, 10**12) for key in ("a", "k" * 46, "k" * 49, "k" * 70)}
    few = {at: [keyed.images(np.arange(i, i + 500) % at[0], at[0], shifts, at[1]) for i in range(0, 5000, 500)] for at, shifts in sizes.items()}
    monkeypatch.setattr(keyed.hashlib, "md5", None)
    assert keyed.first_words(texts, tails).tolist() == want
    assert keyed.uniforms(texts, tails).tolist() == [(w >> 4) / 2.0**60 for row in want for w in row]
    for at, shifts in sizes.items():
        assert keyed.images(np.arange(5000) % at[0], at[0], shifts, at[1]).tolist() == np.concatenate(few[at]).tolist()


def small_experiment(spark, labels=None, surface=None):
    from conftest import bar_rows
    from sparktick.functions.rules import momentum
    from sparktick.operators.bars import differences
    from sparktick.operators.execution import return_surface
    from sparktick.operators.labels import bar_labels
    from sparktick.plans.backtest import Experiment

    test_day = DAY + dt.timedelta(1)
    d = differences(bar_rows(spark, [100 + i * 7 % 11 for i in range(40)]).unionByName(bar_rows(spark, [100 + i * 5 % 13 for i in range(40)], day=test_day)))
    jobs = spark.createDataFrame([("j", "m", 1, None, 0)], "job string, model string, w_snn int, w_h int, seed int")
    folds = spark.createDataFrame([(1, test_day, DAY)], "w_snn int, test_day date, train_day date")
    signals = spark.createDataFrame([("j", "test", test_day, "S", test_day, 10, b) for b in range(5, 15)], "job string, split string, test_day date, symbol string, day date, num long, bar_idx long")
    rules = [momentum(3)]
    labels, surface = labels or bar_labels, surface or (lambda rows: return_surface(rows, rules))
    return Experiment(d, labels(d), surface(d), signals, jobs, folds, rules, (0.0,), 2)


def test_big_moves_need_no_labels_or_returns(spark):
    never = lambda d: d.withColumn("bar_idx", F.raise_error(F.lit("not needed")).cast("long"))
    x = small_experiment(spark, never, never)
    big = sorted(r.bar_idx for r in x.big.collect())
    assert big and big == sorted(r.bar_idx for r in small_experiment(spark).big.collect())


def test_daily_results_of_one_source_make_no_other(spark):
    x = small_experiment(spark)
    alone = x.daily(["model"])
    assert alone.count() == 1 and not {"rates", "big", "naive", "_naive_daily", "labels"} & set(x.__dict__)
    whole = x.daily()
    assert sorted(r.source for r in whole.collect()) == ["big_move", "model", "naive_mean"]
    order = [F.col(c).cast("double") if c not in ("job", "rule", "day", "source") else F.col(c) for c in whole.columns]
    assert alone.select(order).collect() == whole.filter("source = 'model'").select(order).collect()
    assert x.surface is x.surface and "_scratch" in x.surface.__dict__
