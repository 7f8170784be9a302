"""Bottom-k sketches of shingle hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktick.llm.common import WORD_GAP
from sparktick.session import materialise

SKETCH = 128
SHINGLE = 5
RANGE = float(2**63)


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, WORD_GAP), ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, width: int = SHINGLE) -> Column:
    """63-bit hashes of all runs of `width` words; the whole sequence, if it is shorter; none without words.

    `words` must be a plain column of word hashes, or each look-up would compute it again.
    """
    def run(first: Column, at: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(first, *[F.get(words, at + i) for i in range(1, width)]), 1)

    return F.slice(F.transform(words, run), F.lit(1), F.greatest(F.size(words) - F.lit(width - 1), F.lit(1)))


def bottom(hashes: Column, k: int = SKETCH) -> Column:
    """The k smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Sketch of the union of what two sketches were made of: sketches of parts give the sketch of the whole."""
    return bottom(F.concat(a, b), k)


def distinct_count(sketch: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(
        F.lit(float(k - 1)) * F.lit(RANGE) / F.greatest(F.element_at(sketch, -1).cast("double"), F.lit(1.0))
    )


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity: the share of the k smallest hashes of the union that both sketches hold. Two empty: 1."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's distinct shingles that b holds; 1 for an empty a."""
    j, n, m = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def sketched(df: DataFrame, text: str, name: str, k: int = SKETCH, width: int = SHINGLE) -> DataFrame:
    """Add the sketch of column `text` as column `name`."""
    return (
        df.withColumn("_words", word_hashes(F.col(text)))
        .withColumn(name, bottom(shingle_hashes(F.col("_words"), width), k)).drop("_words")
    )


def neighbours(keys: DataFrame) -> DataFrame:
    """For each distinct (doc_id, id, h) the next one in ascending order as (next_id, next_h); after the last the first.

    Range partitions are numbered within themselves; only the first key of each partition is looked at together.
    """
    spark = keys.sparkSession
    order = ["doc_id", "id", "h"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(
        keys.groupBy(*order).agg(F.max("half").alias("half"), F.count(F.lit(1)).alias("copies"))
        .repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "fingerprint-order",
    )
    heads = dealt.groupBy("part").agg(F.min(F.struct(*order)).alias("head")).orderBy("part").collect()  # one row a partition
    follow = [(a["part"], *b["head"]) for a, b in zip(heads, heads[1:] + heads[:1])]
    border = spark.createDataFrame(follow, "part int, _d long, _id long, _h long")
    own = Window.partitionBy("part").orderBy(*order)
    return (
        dealt.withColumn("_next", F.lead(F.struct(*order)).over(own)).join(F.broadcast(border), "part")
        .select(
            *order, "half", "copies",
            F.when(F.col("_next").isNull(), F.col("_id")).otherwise(F.col("_next.id")).alias("next_id"),
            F.when(F.col("_next").isNull(), F.col("_h")).otherwise(F.col("_next.h")).alias("next_h"),
        )
    )


def fingerprint_documents(docs: DataFrame, k: int = SKETCH, width: int = SHINGLE) -> DataFrame:
    """Sketches of each document and of an edited form of it, and how alike they are.

    The edited form has the last half of the code points (rounded down) replaced by as many from the start of the next document
    in ascending doc_id (after the last the first). Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next, n_shingles and edited_shingles (estimated distinct counts) and edited_in_text (estimated containment).

    Null text counts as empty: no shingles, an empty fingerprint. A null doc_id comes first. Documents with one doc_id are ordered
    by a hash of their text; rows that repeat both are one document there, and each gets its result. A single document follows
    itself. Empty tables give no rows. Other columns are not read.

    Texts move once, by key; the same exchange serves the document itself and its part as the next document of another one.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumns({"id": F.coalesce("doc_id", F.lit(0)), "h": F.xxhash64("text", F.col("doc_id").isNull())})  # a key without nulls
    half = F.floor(F.char_length("text") / 2).cast("long")
    order = materialise(neighbours(base.select("doc_id", "id", "h", half.alias("half"))), "fingerprint-next")
    mine = order.select(
        "doc_id", F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("half").alias("_half"), F.col("next_id").alias("id"),
        F.col("next_h").alias("h"),
    )
    source = base.select("id", "h", "text").repartition("id", "h")  # both uses need just these columns, so it is one exchange
    coming = (
        sketched(source, "text", "next_sketch", k, width).join(mine, ["id", "h"])
        .select(
            "doc_id", F.col("_id").alias("id"), F.col("_h").alias("h"), F.expr("substring(text, 1, cast(_half as int))").alias("_start"),
            "next_sketch",
        )
    )
    if order.filter(F.col("copies") > 1).limit(1).count():
        coming = coming.dropDuplicates(["id", "h"])
    joined = source.join(coming, ["id", "h"]).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "next_sketch",
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.col("_start"))
        .alias("edited"),
    )
    both = sketched(sketched(joined, "text", "_own", k, width), "edited", "_edited", k, width)
    return both.select(
        "doc_id", "n_chars", "edited", as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_edited"), k).alias("near_edited"),
        resemblance(F.col("_own"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("_own"), k).alias("n_shingles"), distinct_count(F.col("_edited"), k).alias("edited_shingles"),
        containment(F.col("_edited"), F.col("_own"), k).alias("edited_in_text"),
    )
