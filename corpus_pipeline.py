"""Corpus pipeline: toxicity, quality, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktick.llm.common import documents
from sparktick.llm.neardup import drop_near_duplicates
from sparktick.llm.packing import pack_documents
from sparktick.llm.quality import quality
from sparktick.llm.simhash import drop_simhash_copies
from sparktick.llm.substrings import remove_repeats
from sparktick.llm.toxicity import toxicity
from sparktick.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Scores, packing and passages cannot be written in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def frugal(stage):
    """Texts have kilobytes: Arrow batches of 1,000 rows in place of the usual 10,000 keep Python workers small. A setting of the
    user's own stays."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if spark.conf.get(name) == "10000":
            spark.conf.set(name, "1000")
        return stage(spark, docs, sf_dir)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_d": F.xxhash64(F.col("doc_id").cast("long")), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})


@frugal
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, carried=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


@frugal
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within the bounds of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality(docs, labels).filter("not keep").select(F.xxhash64("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    gone = materialise(judged, "pipeline-poor")
    if gone.count() <= 2_000_000:  # 16 bytes each; above that both sides are sent by key
        gone = F.broadcast(gone)
    return _keyed(docs).join(gone, ["_d", "_h"], "left_anti").select(*COLUMNS)


@frugal
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints (operator 6), and of what is left one of each group of near copies by an
    exact join, which also finds copies whose fingerprints are further apart."""
    return drop_near_duplicates(drop_simhash_copies(docs.select(*COLUMNS)))


@frugal
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of passages that occur earlier; texts of which nothing is left go."""
    kept = remove_repeats(docs, text=True, carried=("lang", "source"))
    return kept.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"),
    )


@frugal
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("near copies", drop_copies), ("passages", cut_passages), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written once to the shared folder."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
