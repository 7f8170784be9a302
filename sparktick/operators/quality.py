"""Day standardisation, validation, coverage and calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparktick.functions.columns import NS_PER_DAY, day_start_ns, idiv
from sparktick.schemas import DAY, TRADES
from sparktick.operators.spread import MINUTE_NS


def _inside_day() -> Column:
    start = day_start_ns(F.col("day"))
    return (F.col("ts_ns") >= start) & (F.col("ts_ns") < start + NS_PER_DAY)


def standardise(trades: DataFrame) -> DataFrame:
    """Only trades inside their UTC day. Order is not stored: every operator names its own."""
    return trades.filter(_inside_day())


def day_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy(*DAY).agg(
        F.count("*").alias("n_raw"), F.count_if(~_inside_day()).alias("n_outside_day")
    )


def schema_violations(df: DataFrame) -> list[str]:
    """Columns whose type differs from the fixed trade layout, or that are missing."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in TRADES if have.get(f.name) != f.dataType]


def order_violations(trades: DataFrame, position: str) -> DataFrame:
    """Rows of a stored sequence (`position` = stored order) that are out of order or outside their day.

    The neighbour is found by an equi join on position, so no day is sorted as a whole.
    """
    key = F.struct("ts_ns", "trade_id")
    prev = trades.select(*DAY, (F.col(position) + 1).alias(position), key.alias("_prev"))
    checked = trades.join(prev, DAY + [position], "left").withColumns(
        {"unsorted": F.coalesce(F.col("_prev") > key, F.lit(False)), "outside": ~_inside_day()}
    )
    return checked.filter("unsorted or outside").drop("_prev")


def coverage(trades: DataFrame, days: DataFrame, num: int) -> DataFrame:
    """One row per wanted `days(symbol, day)`: cached, n_trades, n_bars, hours_covered, max_gap_s, n_outside_day.

    The longest gap comes from gaps inside one-minute slices and gaps between neighbouring slices.
    """
    counts = day_counts(trades)
    cut = standardise(trades).withColumn("_slice", idiv(F.col("ts_ns"), MINUTE_NS))
    inside = Window.partitionBy(*DAY, "_slice").orderBy("ts_ns")
    across = Window.partitionBy(*DAY).orderBy("_slice")
    per_slice = cut.withColumn("_gap", F.col("ts_ns") - F.lag("ts_ns").over(inside)).groupBy(*DAY, "_slice").agg(
        F.count("*").alias("_n"), F.min("ts_ns").alias("_a"), F.max("ts_ns").alias("_b"), F.max("_gap").alias("_gap")
    )
    per_day = per_slice.withColumn("_jump", F.col("_a") - F.lag("_b").over(across)).groupBy(*DAY).agg(
        F.sum("_n").alias("n_trades"), F.min("_a").alias("first_ts_ns"), F.max("_b").alias("last_ts_ns"),
        F.max(F.greatest("_gap", "_jump")).alias("_max_gap"),
    )
    span = F.col("last_ts_ns") - F.col("first_ts_ns")
    return days.join(per_day, DAY, "left").join(counts, DAY, "left").select(
        *DAY, F.col("n_trades").isNotNull().alias("cached"), "n_trades",
        F.floor(F.col("n_trades") / num).alias("n_bars"), "first_ts_ns", "last_ts_ns",
        (span / 3.6e12).alias("hours_covered"), (F.col("_max_gap") / 1e9).alias("max_gap_s"), "n_outside_day",
    )


def period_of(day: Column, last: Column, test: int, validation: int) -> Column:
    """The last `test` days, the `validation` days before them, and all before."""
    return F.when(day > F.date_sub(last, test), "test").when(day > F.date_sub(last, test + validation), "validation").otherwise("history")


def period_summary(cov: DataFrame, period: Column, ticks: int) -> DataFrame:
    """Median (min, max) of trades, bars and ticks per day by period, plus the row `all`.

    Input is one row per day, so the per-period percentile state is bounded by the calendar.
    """
    named = cov.filter("cached").withColumn("period", period).withColumn("n_ticks", F.col("n_bars") * ticks)
    aggs = [F.count("*").alias("days")]
    for c in ("n_trades", "n_bars", "n_ticks"):
        aggs += [F.median(c).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return named.rollup("period").agg(*aggs).withColumn("period", F.coalesce("period", F.lit("all")))


def weekday_medians(cov: DataFrame) -> DataFrame:
    weekend = F.dayofweek("day").isin(1, 7)
    return cov.filter("cached").groupBy(F.when(weekend, "weekend").otherwise("weekday").alias("kind")).agg(
        F.count("*").alias("days"), F.median("n_trades").alias("median_trades")
    )


def extreme_days(cov: DataFrame, k: int = 3) -> DataFrame:
    """The k busiest and k quietest days (ties by date, earliest first)."""
    days = cov.filter("cached").select(*DAY, "n_trades")
    top = days.orderBy(F.desc("n_trades"), "day", "symbol").limit(k).withColumn("kind", F.lit("busiest"))
    low = days.orderBy("n_trades", "day", "symbol").limit(k).withColumn("kind", F.lit("quietest"))
    return top.unionByName(low)


def gap_days(cov: DataFrame, max_gap_s: float = 60.0, min_hours: float = 23.9) -> DataFrame:
    return cov.filter("cached").filter((F.col("max_gap_s") > max_gap_s) | (F.col("hours_covered") < min_hours))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day of an inclusive range."""
    span = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    return spark.range(1).select(F.explode(span).alias("day"))


def days_of(rows: DataFrame, after_first: int = 0, after_last: int = 0) -> DataFrame:
    """Every day from `after_first` days after the first `day` of the rows to `after_last` days after the last; none of no rows."""
    ends = rows.agg(F.date_add(F.min("day"), after_first).alias("a"), F.date_add(F.max("day"), after_last).alias("b"))
    return ends.select(F.explode(F.when(F.col("a") <= F.col("b"), F.sequence("a", "b"))).alias("day"))


def previous_days(days: DataFrame, k: int) -> DataFrame:
    """(day, prev_day) for the k days before each day, oldest first."""
    span = F.sequence(F.date_sub("day", k), F.date_sub("day", 1))
    return days.select("day", F.explode(span).alias("prev_day"))
