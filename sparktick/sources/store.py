"""Partitioned tables: trades, bars, signals, metrics, theta and result sinks.

Every store is a plain partitioned parquet (or csv / json) folder. Writes replace only the partitions they
touch, so a run that adds days leaves the others alone; readers prune partitions and columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_PARTITIONS = ("venue", "symbol", "dataset", "day")
BAR_PARTITIONS = ("symbol", "num", "day")
SIGNAL_PARTITIONS = ("model", "w_snn", "w_h", "seed", "day")
RESULT_PARTITIONS = ("experiment", "run_id")


def save(df: DataFrame, path: str, partitions: Sequence[str], spread: Sequence[str] = (), files: int = 8) -> None:
    """Write `df` partitioned, replacing only the partitions present in it.

    Each partition is written by at most `files` tasks picked by a hash of the `spread` columns, so neither
    one hot partition lands in one task nor does every task open every partition.
    """
    if spread:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(files))).repartition(*partitions, "_salt").drop("_salt")
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(*partitions).parquet(path)
    )


def load(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(where) if where else df


def save_trades(trades: DataFrame, path: str, venue: str, dataset: str) -> None:
    tagged = trades.withColumns({"venue": F.lit(venue), "dataset": F.lit(dataset)})
    save(tagged, path, TRADE_PARTITIONS, ["ts_ns", "trade_id"])


def save_bars(bars: DataFrame, path: str) -> None:
    save(bars, path, BAR_PARTITIONS, ["bar_idx"])


def save_signals(signals: DataFrame, path: str) -> None:
    save(signals, path, SIGNAL_PARTITIONS, ["symbol", "bar_idx"])


def save_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result frame keyed by (experiment, run_id) as parquet, csv or json."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RESULT_PARTITIONS)
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


def save_summary(df: DataFrame, path: str) -> None:
    """A summary table (one row per run and source) as a single CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def trades_to_keep(trades: DataFrame, policy: str) -> DataFrame:
    """Which trades are stored: `none`, `first_seed` (lowest seed of each job) or `all`."""
    if policy == "all":
        return trades
    if policy == "none":
        return trades.limit(0)
    if policy != "first_seed":
        raise ValueError(f"unknown policy {policy!r}")
    first = trades.groupBy("model", "w_snn", "w_h").agg(F.min("seed").alias("_first"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("model", "w_snn", "w_h")]
    kept = trades.alias("t").join(first.alias("f"), [*same, F.col("t.seed") == F.col("f._first")], "left_semi")
    return kept.select("t.*")


def model_results(spark: SparkSession, path: str, model: str, rule: str | None = None) -> DataFrame:
    """Results of all runs of one model (and rule): reads only the matching partitions."""
    df = spark.read.parquet(path)
    pattern = f"{model}__{rule}__%" if rule else f"{model}__%"
    return df.filter(F.col("run_id").like(pattern))
