from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pytest
from conftest import DAY, DAY_NS, bar_rows, column, trade_rows
from pyspark.sql import functions as F

from sparktick.operators import bars as B
from sparktick.operators import quality as Q
from sparktick.functions.columns import to_ns
from sparktick.schemas import TRADES
from sparktick.session import scratch_path
from sparktick.sources import files, store
from sparktick.sources.synthetic import synthetic_trades


@pytest.mark.parametrize(("n", "num"), [(41, 4), (30, 7)])
def test_vwap_bars(spark, n, num):
    rng = np.random.default_rng(n)
    price, qty = rng.uniform(3, 9, n), rng.integers(1, 8, n).astype(float)
    maker = [bool(x) for x in rng.integers(0, 2, n)]
    at = [DAY_NS + int(x) for x in np.cumsum(rng.integers(1, 10**9, n))]
    t = trade_rows(spark, list(price), list(qty), at, maker)
    rows = B.vwap_bars(t.repartition(3), num, flow=True, close=True).orderBy("bar_idx").collect()
    assert len(rows) == n // num  # the trades of an unfinished bar are left out
    for i, r in enumerate(rows):
        own = slice(i * num, (i + 1) * num)
        p, q, sign = price[own], qty[own], np.where(maker[own], -1, 1)
        assert r.vwap == pytest.approx((p * q).sum() / q.sum()) and r.volume == q.sum() and r.close == p[-1]
        assert r.ofi == pytest.approx((sign * q).sum() / q.sum()) and r.count_imb == pytest.approx(sign.mean())
        assert (r.ts_start_ns, r.ts_end_ns) == (at[own][0], at[own][-1])


def test_zero_volume_bar_takes_the_mean_price(spark):
    assert column(B.vwap_bars(trade_rows(spark, [10, 12], [0, 0]), 2), "vwap") == [11.0]


def test_order_flow_signs(spark):
    rows = B.vwap_bars(trade_rows(spark, [10, 10], [3, 1], makers=[True, False]), 2, flow=True).collect()
    assert rows[0].ofi == -0.5 and rows[0].count_imb == 0.0


def test_ties_in_time_are_ordered_by_trade_id(spark):
    t = trade_rows(spark, [1, 2, 3, 4], ts=[DAY_NS] * 4)
    assert column(B.vwap_bars(t, 2), "vwap") == column(B.vwap_bars(t, 2, slices=B.tied_slices(2)), "vwap") == [1.5, 3.5]


def test_several_bar_sizes_share_one_pass(spark):
    t = trade_rows(spark, list(range(1, 8)))
    rows = B.vwap_bars(t, [2, 3]).groupBy("num").count().collect()
    assert {r.num: r["count"] for r in rows} == {2: 3, 3: 2}


def test_differences_and_returns(spark):
    b = bar_rows(spark, [100, 101, 103])
    assert column(B.differences(b), "d") == [None, 1.0, 2.0]
    assert column(B.next_return(b), "r")[2] is None
    assert column(B.differences(b), "x2") == [None, -1.0, -2.0]


def test_event_clock(spark):
    b = bar_rows(spark, [1, 2]).withColumn("t", B.bar_time("wallclock"))
    assert column(b, "t") == [0.009, 0.019]
    with pytest.raises(ValueError):
        B.bar_time("moon")


# --------------------------------------------------------------------------- files


HEADER = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker"


@pytest.mark.parametrize("header", [True, False])
def test_csv_with_and_without_header(spark, tmp_path, header):
    rng, ms = np.random.default_rng(4), DAY_NS // 1_000_000
    trades = [(900 + 3 * i, float(rng.integers(1, 999)) / 8, float(rng.integers(1, 99)) / 4, ms + 11 * i, bool(i % 3)) for i in range(12)]
    lines = [f"{i},{p},{q},{2 * i},{2 * i + 1},{at},{str(m).lower()}" for i, p, q, at, m in trades]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / f"ACME-aggTrades-{DAY}.csv").write_text("\n".join([HEADER] * header + lines) + "\n")
    rows = files.read_trade_csv(spark, str(tmp_path), "aggTrades").orderBy("trade_id").collect()
    assert {(r.symbol, r.day) for r in rows} == {("ACME", DAY)}
    assert [(r.trade_id, r.price, r.qty, r.ts_ns // 1_000_000, r.is_buyer_maker) for r in rows] == trades


def test_trades_layout_accepts_capitalised_booleans(spark, tmp_path):
    ms = DAY_NS // 1_000_000
    (tmp_path / f"X-trades-{DAY}.csv").write_text(f"id,price,qty,quote_qty,time,is_buyer_maker\n1,2.5,3,7.5,{ms},True\n2,2.5,3,7.5,{ms},false\n")
    assert column(files.read_trade_csv(spark, str(tmp_path), "trades"), "is_buyer_maker", "trade_id") == [True, False]


def test_timestamp_units(spark):
    ms = [DAY_NS // 1_000_000 + 77 * i for i in range(5)]
    rows = spark.createDataFrame([(m * f, m) for m in ms for f in (1, 10**3, 10**6)], "t long, ms long")
    assert rows.filter(to_ns(F.col("t")) != F.col("ms") * 1_000_000).count() == 0


def test_checksums(spark, tmp_path):
    def put(name, body, listed):
        (tmp_path / name).write_bytes(body)
        if listed is not None:
            (tmp_path / f"{name}.CHECKSUM").write_text(listed)

    bodies = {f"good{i}.zip": bytes(range(i, i + 40)) for i in range(3)}
    for name, body in bodies.items():
        put(name, body, f"{hashlib.sha256(body).hexdigest()}  {name}\n")
    put("cut.zip", b"\x00" * 9, f"{hashlib.sha256(bytes(10)).hexdigest()}  cut.zip\n")
    put("alone.zip", b"nobody listed this", None)
    put("blank.zip", b"listed, but without a sum", "")
    got = {r.name: r.ok for r in files.verify_checksums(*files.read_for_checksum(spark, str(tmp_path))).collect()}
    assert got == {**dict.fromkeys(bodies, True), "cut.zip": False, "alone.zip": False, "blank.zip": False}


# --------------------------------------------------------------------------- days, coverage, store


def test_standardise_keeps_the_utc_day(spark):
    day = 86_400 * 10**9
    offsets = [-3, 7 * day // 9, day + 5, 0, day - 2, -day, 11, 2 * day]
    t = trade_rows(spark, [1.5] * len(offsets), ts=[DAY_NS + x for x in offsets])
    inside = [i + 1 for i, x in enumerate(offsets) if 0 <= x < day]
    assert sorted(column(Q.standardise(t), "trade_id", "trade_id")) == inside
    assert Q.day_counts(t).first().n_outside_day == len(offsets) - len(inside)


def test_violations(spark):
    t = trade_rows(spark, [1, 2], ts=[DAY_NS + 5, DAY_NS]).withColumn("pos", F.col("trade_id"))
    assert Q.order_violations(t, "pos").count() == 1
    assert Q.schema_violations(t) == [] and Q.schema_violations(t.withColumn("trade_id", F.col("trade_id").cast("double"))) == ["trade_id"]
    wrong = t.withColumn("day", F.date_sub("day", 1))
    assert Q.order_violations(wrong, "pos").filter("outside").count() == 2


def test_coverage_and_missing_days(spark):
    t = trade_rows(spark, range(1, 26), ts=[DAY_NS + i * 70_000_000_000 + (40_000_000_000 if i > 9 else 0) for i in range(25)])
    days = Q.calendar(spark, str(DAY - dt.timedelta(1)), str(DAY)).select(F.lit("S").alias("symbol"), "day")
    rows = Q.coverage(t, days, 10).orderBy("day").collect()
    assert [r.cached for r in rows] == [False, True] and rows[1].n_bars == 2 and rows[1].max_gap_s == 110.0
    assert [r.day for r in files.missing(days, t, ["symbol", "day"]).collect()] == [DAY - dt.timedelta(1)]


def test_calendar_crosses_months(spark):
    days = [r.day for r in Q.calendar(spark, "2026-02-27", "2026-03-01").orderBy("day").collect()]
    assert days == [dt.date(2026, 2, 27), dt.date(2026, 2, 28), dt.date(2026, 3, 1)]
    prev = Q.previous_days(spark.createDataFrame([(dt.date(2026, 3, 1),)], "day date"), 2).orderBy("prev_day").collect()
    assert [r.prev_day for r in prev] == [dt.date(2026, 2, 27), dt.date(2026, 2, 28)]


def test_store_round_trip_and_partial_overwrite(spark):
    path = scratch_path(spark, "store")
    a, b = trade_rows(spark, [1, 2]), trade_rows(spark, [3], day=DAY + dt.timedelta(1))
    store.save_trades(a.unionByName(b), path, "v", "aggTrades")
    store.save_trades(trade_rows(spark, [9, 9, 9]), path, "v", "aggTrades")
    back = store.load(spark, path, f"day = '{DAY}'").select([f.name for f in TRADES])
    assert sorted(column(back, "price", "trade_id")) == [9.0, 9.0, 9.0]
    assert store.load(spark, path).count() == 4


def test_synthetic_trades_are_deterministic(spark):
    days = Q.calendar(spark, "2024-01-01", "2024-01-02")
    rows = lambda seed, d=days: sorted(map(tuple, synthetic_trades(d, 300, seed).collect()))
    a = rows(3)
    assert a == rows(3) and a != rows(4) and len(a) == 600 and all(r[3] > 0 for r in a)
    one = rows(3, days.limit(1))
    assert one == [r for r in a if r[1] == one[0][1]]


def test_random_walk_has_the_known_smoothing(spark):
    """Averages of m points of a random walk: lag-1 autocorrelation of their differences near (m^2-1)/(2(2m^2+1))."""
    from sparktick.plans.reports import smoothing

    t = synthetic_trades(Q.calendar(spark, "2024-01-01", "2024-01-01"), 40_000, 1)
    row = smoothing(B.vwap_bars(t, 10, close=True)).first()
    # Lognormal sizes make the average effectively shorter than 10 points, so the value lies below 0.246.
    assert 0.10 < row.ac1_vwap < 0.26 and abs(row.ac1_close) < 0.05
    assert 0.50 < row.momentum_share < 0.56 and np.isclose(row.working, 99 / 402)
