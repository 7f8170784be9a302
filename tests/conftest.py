from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sparktick.schemas import BARS, TRADES  # noqa: E402
from sparktick.session import build_session  # noqa: E402

DAY = dt.date(2024, 3, 5)
DAY_NS = 1_709_596_800_000_000_000


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def trade_rows(spark, prices, qtys=None, ts=None, makers=None, day=DAY, symbol="S"):
    n = len(prices)
    qtys, makers = qtys or [1.0] * n, makers or [False] * n
    start = DAY_NS + (day - DAY).days * 86_400_000_000_000
    ts = ts or [start + i * 1_000_000 for i in range(n)]
    rows = [(symbol, day, t, float(p), float(q), m, i + 1) for i, (t, p, q, m) in enumerate(zip(ts, prices, qtys, makers))]
    return spark.createDataFrame(rows, TRADES)


def bar_rows(spark, vwap, start_ms=None, end_ms=None, day=DAY, symbol="S", num=10):
    n = len(vwap)
    start_ms = start_ms or [10 * i for i in range(n)]
    end_ms = end_ms or [10 * i + 9 for i in range(n)]
    rows = [
        (symbol, day, num, i, DAY_NS + a * 1_000_000, DAY_NS + b * 1_000_000, float(p), 1.0, num)
        for i, (p, a, b) in enumerate(zip(vwap, start_ms, end_ms))
    ]
    return spark.createDataFrame(rows, BARS)


def column(df, name, order="bar_idx"):
    return [row[0] for row in df.orderBy(order).select(name).collect()]
