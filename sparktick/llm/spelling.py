"""Spelling variants: words one edit apart, found by two disjoint chunks of one word among the positional grams of the other."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import chunks, released
from sparktick.session import materialise

# Fixed values of the task: letters, and the rule by which occurrences lose a letter.
LETTERS, CRC_STEP = "A-Za-zÀ-ÿ", 31
BLOCK_CHARS = 8 << 20
# Buckets of more candidate pairs than this are split by a further chunk.
MOST_PAIRS = 1024


def counted_words(docs: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n, len): maximal runs of Latin letters of whole texts, A-Z in lower case, with at least `shortest` code points that
    occur `least` times in all.

    An occurrence whose crc32 of "doc_id:run" is a multiple of 31 loses the code point at crc32 modulo its length first, so equal
    texts of different documents can differ. Counts are added up for blocks of text in the task that reads them, then by word.
    """
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches, "text", BLOCK_CHARS):
            total: Counter[str] = Counter()
            for batch in held:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(run.findall(text.encode().lower().decode())).items():
                        crc = zlib.crc32(word.encode(), start)
                        if crc % CRC_STEP == 0:
                            at = crc % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < shortest:
                                continue
                        total[word] += n
            words = list(total)
            for at in range(0, len(words), 50_000):
                part = words[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([total[w] for w in part], pa.int64())], names=["word", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter("text is not null")
    found = texts.mapInArrow(released(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least).withColumn("len", F.char_length("word"))


def _key(word: Column, size: Column, start: Column, end: Column, shift: Column) -> Column:
    """Hash of what stands outside a segment of the shorter word; in the longer one the segment ends `shift` later."""
    return F.xxhash64(size, start, end, F.substring(word, F.lit(1), start), F.substring(word, end + shift + 1, F.lit(1 << 30)))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the second half of its segment still open (the first half is a chunk both words share), and with the
    first half open (the second half is shared, in the longer word one place later)."""
    middle = F.col("start") + F.ceil((F.col("end") - F.col("start")) / 2).cast("int")
    halves = F.explode(F.array(
        F.struct(middle.alias("start"), F.col("end")), F.struct(F.col("start"), middle.alias("end")),
    )).alias("half")
    out = rows.select("word", "n", "size", "shift", "chunk", halves).select("word", "n", "size", "shift", "chunk", "half.start", "half.end")
    return out.withColumn("key", _key(*map(F.col, ("word", "size", "start", "end", "shift"))))


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """All pairs (a, a_n, b, b_n) of distinct words that differ by one inserted, deleted or replaced code point, each once.

    The shorter word (or either of two equally long ones) contributes its two halves as disjoint chunks; the other contributes the
    grams that can equal them: those of its own halves' length and of a word's that is one shorter, at the same place or one
    later, as the difference of lengths says. One edit leaves one chunk whole, so no pair is missed. Candidates that share a chunk
    are verified by their edit distance.

    A chunk shared by many words would make all pairs of its bucket. Buckets of more than `most_pairs` candidates are split: the
    half that holds the edit is cut in two again, and both words must also share one of these chunks, until buckets are small or
    one letter is left open (as many words as there are letters). A pair belongs to the leftmost place where its words differ, so
    it is found in one bucket only.
    """
    roles = F.explode(F.array(
        F.struct(F.lit(True).alias("chunk"), F.lit(0).alias("shift")), F.struct(F.lit(False).alias("chunk"), F.lit(0).alias("shift")),
        F.struct(F.lit(False).alias("chunk"), F.lit(1).alias("shift")),
    )).alias("role")
    whole = words.select("word", "n", "len", roles).select(
        "word", "n", "role.chunk", "role.shift", (F.col("len") - F.col("role.shift")).alias("size"), F.lit(0).alias("start"),
    ).withColumn("end", F.col("size"))
    rows, found = _halved(whole), None
    while True:
        rows = materialise(rows, "spelling-chunks")
        sizes = rows.groupBy("key").agg(
            F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"), F.count_if(F.col("shift") == 1).alias("shifted"),
        ).filter("chunks > 0 and grams > 0 and (chunks > 1 or shifted > 0)")
        held = materialise(rows.join(sizes, "key"), "spelling-buckets")
        small = (F.col("chunks") * F.col("grams") <= most_pairs) | (F.col("end") - F.col("start") <= 1)
        ours, others = (held.filter(small & side).select("key", "word", "n", "size", "shift", "end") for side in (F.col("chunk"), ~F.col("chunk")))
        a, b = F.col("a.word"), F.col("b.word")
        pairs = ours.alias("a").join(others.alias("b"), "key").filter(
            ((F.col("b.shift") == 1) | (a < b))
            & ((F.col("a.end") == F.col("a.size")) | (F.substring(a, F.lit(1), F.col("a.end")) != F.substring(b, F.lit(1), F.col("a.end"))))
            & (F.levenshtein(a, b, 1) == 1)
        ).select(a.alias("a"), F.col("a.n").alias("a_n"), b.alias("b"), F.col("b.n").alias("b_n"))
        found = pairs if found is None else found.unionByName(pairs)
        large = held.filter(~small)
        if large.isEmpty():
            return found
        rows = _halved(large)


def spelling_groups(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Words of whole texts with the commoner word they are probably a misspelling of.

    Returns word, form (its near word of largest n, ties: smallest, if that n is at least `times` the word's; else null), root
    (forms followed to the last), n, n_near, form_n. Counts grow by `times` along a chain of forms, so chains are short whatever
    the corpus; they are followed by doubling. A null text has no words, a null doc_id counts as an empty one in "doc_id:run";
    repeated rows count each time; empty tables give no rows.
    """
    words = materialise(counted_words(docs, shortest, least), "spelling-words")
    near = near_pairs(words, most_pairs)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    large = -F.col("best.less") >= F.col("n") * times
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.other")).alias("form"),
        F.when(large, -F.col("best.less")).alias("form_n"),
    )
    known = materialise(known, "spelling-forms")
    top = known.agg(F.max("n")).first()[0] or 1
    steps = known.filter("form is not null").select("word", F.col("form").alias("root"))
    reach, longest = 1, 1
    while least * times ** longest <= top:
        longest += 1
    while reach < longest:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = materialise(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        reach *= 2
    return known.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n",
    )
