"""Stores that know what they hold: tables keyed by settings and work keys, with a manifest, so that a run only computes what is missing.

Layout below `path`: `<table>/commit=<id>/` holds the rows of one commit, `manifest/` one row for each finished key. Rows are
written first and the manifest last, so a run that dies leaves nothing that is read; a key finished twice counts once, with the
rows of its last commit. A key may be finished without rows (a day without a fit) and is then not tried again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktick.session import materialise


def settings_key(settings: Mapping) -> str:
    """Short stable name of everything besides the keys that determines what is stored."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:12]


class KeyedStore:
    """`keys` is a DDL string, such as "symbol string, num long, day date". Keys may be null."""

    def __init__(self, spark: SparkSession, path: str, keys: str, settings: Mapping | None = None):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings_key(settings or {})
        self.keys = T.StructType.fromDDL(keys)
        self.names = self.keys.fieldNames()

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _same(self, a: str, b: str):
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in self.names]

    def manifest(self) -> DataFrame:
        """The last commit of every finished key of these settings, with its number of rows in all tables."""
        fields = [*self.keys, T.StructField("settings", T.StringType()), T.StructField("commit", T.StringType()), T.StructField("n_rows", T.LongType())]
        rows = self._read("manifest", T.StructType(fields)).filter(F.col("settings") == self.settings)
        return rows.groupBy(*self.names).agg(F.max(F.struct("commit", "n_rows")).alias("_last")).select(*self.names, "_last.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Wanted keys that are not finished yet."""
        rows = wanted.select(*self.names).distinct()
        return rows.alias("w").join(self.manifest().alias("m"), self._same("w", "m"), "left_anti")

    def commit(self, tables: Mapping[str, DataFrame], done: DataFrame) -> str:
        """Write the tables' rows and then, in one step, the keys of `done` as finished; returns the commit's id."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        counts = []
        for table, rows in tables.items():
            place = f"{self.path}/{table}/commit={name}"
            rows.write.mode("error").option("compression", "zstd").parquet(place)
            counts.append(self.spark.read.schema(rows.schema).parquet(place).groupBy(*self.names).agg(F.count("*").alias("n")))
        finished = done.select(*[F.col(f.name).cast(f.dataType) for f in self.keys]).distinct().withColumn("n", F.lit(0).cast("long"))
        for rows in counts:
            finished = finished.unionByName(rows.select(*self.names, "n"))
        finished = finished.groupBy(*self.names).agg(F.sum("n").alias("n_rows"))
        finished.withColumns({"settings": F.lit(self.settings), "commit": F.lit(name)}).write.mode("append").parquet(f"{self.path}/manifest")
        return name

    def load(self, table: str, wanted: DataFrame | None = None) -> DataFrame:
        """Rows of finished keys (of `wanted` only, if given): of each key those of its last commit."""
        last = self.manifest().filter("n_rows > 0")
        if wanted is not None:
            last = last.alias("m").join(wanted.select(*self.names).distinct().alias("w"), self._same("m", "w"), "left_semi")
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        return rows.alias("r").join(last.alias("m"), [*self._same("r", "m"), F.col("r.commit") == F.col("m.commit")], "left_semi").drop("commit")

    def ensure(self, wanted: DataFrame, compute: Callable[[DataFrame], Mapping[str, DataFrame]]) -> int:
        """Compute and commit the keys of `wanted` that are missing; how many there were. Nothing is computed if none is missing."""
        open_keys = materialise(self.missing(wanted), "store-missing")
        n = open_keys.count()
        if n:
            self.commit(compute(open_keys), open_keys)
        return n


def bar_store(spark: SparkSession, path: str, settings: Mapping | None = None) -> KeyedStore:
    return KeyedStore(spark, path, "symbol string, num long, day date", {"kind": "bars"} | dict(settings or {}))


def theta_store(spark: SparkSession, path: str, settings: Mapping) -> KeyedStore:
    return KeyedStore(spark, path, "symbol string, num long, w_h int, day date", {"kind": "theta"} | dict(settings))


def result_store(spark: SparkSession, path: str, settings: Mapping | None = None) -> KeyedStore:
    """Results of experiments by job: all tables come with one commit."""
    return KeyedStore(spark, path, "experiment string, job string", {"kind": "results"} | dict(settings or {}))
