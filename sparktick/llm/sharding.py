"""Histogram sort into shards of equal bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktick.session import materialise

LEAST, MOST = -(2**63), 2**63 - 1
PROBES = 16  # candidate boundaries per splitter and round


def splitters(keys: DataFrame, targets: Sequence[int], tolerance: int) -> list[int]:
    """For each target the key with that many bytes below it, within `tolerance` or as near as whole keys allow.

    keys: `k` long, `bytes` long. Each round counts exactly, in one aggregation, the bytes below PROBES candidates for every
    open splitter and keeps the interval around its target.
    """
    low = [(LEAST, 0)] * len(targets)  # (key, bytes below it) at or under the target
    high: list[tuple[int, int | None]] = [(MOST, None)] * len(targets)
    found: list[int | None] = [None] * len(targets)
    while any(x is None for x in found):
        wanted = set()
        for i, done in enumerate(found):
            if done is None:
                (a, _), (b, _) = low[i], high[i]
                step = max(1, (b - a) // (PROBES + 1))
                wanted.update(range(a + step, b, step))
        probes = sorted(wanted)
        below: dict[int, int] = {}
        if probes:
            sums = [F.sum(F.when(F.col("k") < F.lit(p), F.col("bytes"))) for p in probes]
            row = keys.agg(*[F.coalesce(s, F.lit(0)).alias(f"p{i}") for i, s in enumerate(sums)]).first()
            below = {p: int(v) for p, v in zip(probes, row)}
        for i, target in enumerate(targets):
            if found[i] is not None:
                continue
            for p, v in below.items():
                if v <= target and p > low[i][0]:
                    low[i] = (p, v)
            for p, v in below.items():
                if v > target and p < high[i][0] and p > low[i][0]:
                    high[i] = (p, v)
            (a, under), (b, over) = low[i], high[i]
            if target - under <= tolerance:
                found[i] = a
            elif over is not None and over - target <= tolerance:
                found[i] = b
            elif b - a <= 1:
                found[i] = b if over is not None and over - target < target - under else a
    return [x for x in found if x is not None]


def histogram_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, rows_per_bin: int = 100_000) -> DataFrame:
    """Deal documents into `shards` shards of near equal bytes; equal texts stay in one shard.

    Returns doc_id, text, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard) and grown_shard (null:
    only the `key` law has one). Size is the UTF-8 length plus 1. Other columns of `docs` are not read.

    The sort key is a 64-bit hash of the text, so that copies are neighbours. Bytes below candidate keys are counted over all
    rows until the splitters meet the tolerance (a share of a shard's bytes); then rows move once, without a sort of the whole
    table. A group of copies above the tolerance cannot lie across a splitter: it gets the least filled shard, and the splitters
    then share out the rest. A group above a whole shard's share is dealt by a hash of the text and the id, row by row.

    Null text counts as empty. Empty tables give no rows. Repeated rows are rows of their own; ties in the order of a shard are
    broken by doc_id, null first.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumns({
        "_h": F.xxhash64("text"), "size": (F.octet_length("text") + F.lit(1)).cast("long"), "text_crc32": F.crc32("text"),
    })
    keys = materialise(base.select("doc_id", "_h", "size"), "shard-keys")
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(1, total // shards)
    slack = max(1, int(share * tolerance))
    # At most shards / tolerance groups can be this large.
    large = keys.groupBy("_h").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > slack).collect()
    scattered = [r["_h"] for r in large if r["bytes"] > share]
    filled, place = [0] * shards, {}
    for r in sorted((r for r in large if r["bytes"] <= share), key=lambda r: (-r["bytes"], r["_h"])):
        s = min(range(shards), key=lambda i: (filled[i], i))
        place[r["_h"]] = s
        filled[s] += r["bytes"]
    k: Column = F.when(F.col("_h").isin(scattered), F.xxhash64("_h", "doc_id")).otherwise(F.col("_h")) if scattered else F.col("_h")
    placed = spark.createDataFrame(list(place.items()), "_h long, _fixed int")
    light = keys.join(F.broadcast(placed), "_h", "left_anti").select(k.alias("k"), F.col("size").alias("bytes"))
    goals, run = [], 0
    loose = max(0, total - sum(filled))
    room = [max(0, total // shards - f) for f in filled]
    for s in range(shards - 1):
        run += room[s]
        goals.append(loose * run // max(1, sum(room)))
    cuts = splitters(light, goals, slack) if n else [0] * (shards - 1)

    bins = max(1, -(-n // (shards * rows_per_bin)))
    edges = [LEAST, *cuts, MOST]
    home = sum((F.col("_k") >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    lo = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("_home") + 1)
    hi = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("_home") + 2)
    part = F.floor((F.col("_k").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * bins)

    def binned(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(placed), "_h", "left").withColumn("_k", k).withColumn("_home", home)
        return df.withColumns({
            "shard": F.coalesce("_fixed", "_home").cast("int"),
            "_bin": F.when(F.col("_fixed").isNull(), F.least(F.greatest(part, F.lit(0)), F.lit(bins - 1)))
            .otherwise(bins + F.pmod(F.xxhash64("doc_id", "_h"), F.lit(bins))).cast("long"),
        })

    counts = binned(keys).groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    # At most 2 x bins rows for each shard.
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_bin").orderBy("_k", "_h", "doc_id")
    return (
        binned(base).withColumn("_rank", F.row_number().over(inside)).join(counts, ["shard", "_bin"])
        .select(
            "doc_id", "text", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
