"""Adapters that present the given tables as trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktick.session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def event_trades(spark: SparkSession, folder: str, symbol: Column | None = None) -> DataFrame:
    """`events` as trades of one symbol, or of one symbol per `symbol` value (e.g. the event type)."""
    at = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select(
        (F.lit("ALL") if symbol is None else symbol).alias("symbol"),
        F.to_date("ts").alias("day"),
        (F.unix_micros(at) * 1000).alias("ts_ns"),
        (100.0 + F.col("value")).alias("price"),
        (1 + F.col("event_id") % 7).cast("double").alias("qty"),
        F.col("event_type").isin("error", "signup").alias("is_buyer_maker"),
        F.col("event_id").alias("trade_id"),
    )


def lineitem_trades(spark: SparkSession, folder: str) -> DataFrame:
    """`lineitem` as trades: many trades share a timestamp and a "day" is a quarter of shipping dates."""
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.to_date(F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp"))).alias("day"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_ns"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_linestatus") == "F").alias("is_buyer_maker"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trade_id"),
    )
