"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktick.llm.bpe import encode_decode
from sparktick.llm.chat import chat_trees, read_back
from sparktick.llm.common import documents
from sparktick.llm.fingerprints import fingerprint_documents
from sparktick.llm.neighbours import nearest
from sparktick.llm.packing import pack_documents
from sparktick.llm.repair import damaged, repair_conversations, repair_report
from sparktick.llm.simhash import as_digits, simhash_components
from sparktick.llm.spelling import spelling_groups
from sparktick.llm.sql import OP11, OP13
from sparktick.llm.substrings import remove_repeats
from sparktick.llm.tokenblocks import token_blocks
from sparktick.llm.toxicity import toxicity
from sparktick.llm.quality import quality
from sparktick.llm.sharding import histogram_shards



LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {"op11_conversation_repair": OP11, "op13_spelling_groups": OP13}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op3_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return histogram_shards(documents(spark, sf_dir), shards=8).drop("text")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(documents(spark, sf_dir), BYTE_BPE)


@query
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests."""
    return encode_decode(documents(spark, sf_dir), WORD_BPE, digests=True)


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of all documents and of their edited forms."""
    found = fingerprint_documents(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited",
        "near_next", "n_shingles", "edited_shingles", "edited_in_text",
    )


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in two bits at most."""
    found = simhash_components(documents(spark, sf_dir), width=3, radius=2, lower=True)
    return found.select("doc_id", as_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of passages of twenty words that occur earlier."""
    return remove_repeats(documents(spark, sf_dir), text=False)


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest inner product for every twentieth vec_id, against all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


@query
def op5_chat_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted as prefix trees, and read back from them."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(chat_trees(turns.unionByName(probe))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents and whether they are kept."""
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("h")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule, with their cheapest repair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(*repair_conversations(damaged(turns)))


@query
def op12_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, read back from files of packed blocks."""
    return token_blocks(documents(spark, sf_dir), WORD_BPE)


@query
def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the commoner words they are variants of."""
    return spelling_groups(documents(spark, sf_dir))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
