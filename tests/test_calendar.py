"""Days are taken from the data: later days appear in every family of queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparktick.queries import QUERIES


@pytest.fixture(scope="module")
def longer(spark, sf, tmp_path_factory):
    """The events twice, the second time 40 days later."""
    folder = str(tmp_path_factory.mktemp("longer"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    later = events.withColumn("ts", F.col("ts") + F.expr("interval 40 days")).withColumn("event_id", F.col("event_id") + 1_000_000)
    events.unionByName(later).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize(("name", "day"), [
    ("k3_walk_forward_folds", "test_day"), ("n1_channel_stats", "test_day"), ("h2_event_threshold", "day"), ("g4_signal_rate", "day"),
    ("q3_coverage", "day"), ("q7_calendar", "day"), ("h6_intensities", "day"),
])
def test_later_days(spark, sf, longer, name, day):
    first, second = (QUERIES[name](spark, folder).agg(F.max(day)).first()[0] for folder in (sf, longer))
    assert (second - first).days >= 35
