"""Deterministic random-walk trades, a pure function of (seed, symbol, day, trade number)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktick.functions.columns import day_start_ns
from sparktick.functions.keyed import gaussian, uniform
from sparktick.operators.spread import running_totals

STEP, HALF_SPREAD, START = 0.5, 0.05, 100_000.0
LOG_SIZE_MEAN, LOG_SIZE_STD = -3.0, 1.5


def random_walk(slots: DataFrame, seed: int) -> DataFrame:
    """Prices for `slots(symbol, day, seq, ts_ns)`: Gaussian steps summed over the day, trades at bid or ask.

    The seq-th step of a day depends only on its key, and the walk is summed slice by slice, so a day of
    any length is spread over many tasks.
    """
    key = (seed, F.col("symbol"), F.col("day"), F.col("seq"))
    steps = slots.withColumns({"_step": STEP * gaussian(*key, "step")})
    walked = running_totals(steps, ["symbol", "day"], [F.floor(F.col("seq") / 65_536)], ["seq"], {"_sum": F.col("_step")})
    bounce = F.when(uniform(*key, "side") < 0.5, HALF_SPREAD).otherwise(-HALF_SPREAD)
    return walked.select(
        "symbol", "day", "ts_ns", (START + F.col("_sum") + F.col("_step") + bounce).alias("price"),
        F.exp(LOG_SIZE_MEAN + LOG_SIZE_STD * gaussian(*key, "size")).alias("qty"),
        (uniform(*key, "maker") < 0.5).alias("is_buyer_maker"), F.col("seq").alias("trade_id"),
    )


def synthetic_trades(days: DataFrame, per_day: int, seed: int, symbol: str = "SYN") -> DataFrame:
    """`per_day` trades for every row of `days(day)`, millisecond times spread over the UTC day."""
    block = 4096
    first = F.col("_block") * block
    blocks = days.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((per_day - 1) // block)).cast("array<bigint>")))
    slots = blocks.withColumn("seq", F.explode(F.sequence(first, F.least(first + block - 1, F.lit(per_day - 1).cast("long")))))
    ms = F.floor((F.col("seq") + uniform(seed, F.col("day"), F.col("seq"), "time")) * (86_400_000 / per_day))
    slots = slots.withColumns({"symbol": F.lit(symbol), "ts_ns": day_start_ns(F.col("day")) + ms * 1_000_000})
    return random_walk(slots.drop("_block"), seed)
