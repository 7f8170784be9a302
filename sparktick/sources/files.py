"""Exchange trade files: parsing, checksums, naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktick.functions.columns import to_ns
from sparktick.schemas import RAW_AGG_TRADES, RAW_TRADES

LAYOUTS = {"trades": RAW_TRADES, "aggTrades": RAW_AGG_TRADES}
# Standard column -> column of each layout.
_FROM = {
    "trades": {"trade_id": "id", "price": "price", "qty": "qty", "t": "time"},
    "aggTrades": {"trade_id": "agg_trade_id", "price": "price", "qty": "quantity", "t": "transact_time"},
}


def parse_trades(raw: DataFrame, dataset: str) -> DataFrame:
    """Standard trade columns from all-string file columns; a header row has no numeric id and drops out.

    Further columns of `raw` (symbol, day, file name) are kept.
    """
    names = _FROM[dataset]
    keep = [c for c in raw.columns if c not in LAYOUTS[dataset]]
    trade_id = F.col(names["trade_id"]).try_cast("long")
    return raw.filter(trade_id.isNotNull()).select(
        *keep,
        to_ns(F.col(names["t"]).cast("long")).alias("ts_ns"),
        F.col(names["price"]).cast("double").alias("price"),
        F.col(names["qty"]).cast("double").alias("qty"),
        (F.lower(F.trim("is_buyer_maker")) == "true").alias("is_buyer_maker"),
        trade_id.alias("trade_id"),
    )


def read_trade_csv(spark: SparkSession, path: str | list[str], dataset: str) -> DataFrame:
    """Local or remote CSV files named `{symbol}-{dataset}-{day}.csv`, with or without header, any nesting."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in LAYOUTS[dataset]])
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, header=False)
    return parse_trades(_named(raw, dataset), dataset)


def read_trade_parquet(spark: SparkSession, path: str | list[str], dataset: str) -> DataFrame:
    """Parquet files with the standard columns, named like the CSV files."""
    return _named(spark.read.option("recursiveFileLookup", "true").parquet(path), dataset)


def _named(df: DataFrame, dataset: str) -> DataFrame:
    pattern = rf"([^/=]+)-{dataset}-(\d{{4}}-\d{{2}}-\d{{2}})\.(?:csv|parquet)"
    name = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(name, pattern, 1).alias("symbol"), F.to_date(F.regexp_extract(name, pattern, 2)).alias("day"), "*"
    )


def verify_checksums(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """`files(name, content binary)` against `checksums(text)` lines of the form `<sha256>  <name>`.

    One row per file: `ok` is false when the sum differs, is missing or is empty.
    """
    parts = F.split(F.trim("text"), r"\s+")
    wanted = checksums.select(F.get(parts, F.lit(1)).alias("name"), F.lower(F.get(parts, F.lit(0))).alias("wanted"))
    actual = files.select("name", F.sha2("content", 256).alias("sha256"))
    return actual.join(wanted, "name", "left").select(
        "name", "sha256", F.coalesce(F.col("sha256") == F.col("wanted"), F.lit(False)).alias("ok")
    )


def read_for_checksum(spark: SparkSession, path: str, suffix: str = ".CHECKSUM") -> tuple[DataFrame, DataFrame]:
    """Data files and their checksum lines below `path`, ready for `verify_checksums`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = raw.filter(~F.col("path").endswith(suffix)).select(name.alias("name"), "content")
    sums = raw.filter(F.col("path").endswith(suffix)).select(F.decode("content", "UTF-8").alias("text"))
    return files, sums


def missing(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys with nothing stored yet: the work an incremental run still has to do."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")
