"""Groups of near copies: an exact join on the rarest shingles of each text, and an exact check of similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import ids_and_texts, released
from sparktick.llm.components import connected_components
from sparktick.llm.simhash import runs, shingle_hashes
from sparktick.session import discard, materialise

MARKS = 8  # 64-bit words of a set's parities
FEW = 3  # neighbours in a shard's random order that are tested first; each later round takes four times as many
HOT_BLOCK = 512  # members of a shard above which it is dealt into blocks in these rounds
ROUNDS, WORK = 4, 1024  # rounds at most, and pairs a row that are few enough for the join that tests all that is left
SAMPLED, FREQUENT = 16, 200_000  # one in so many texts is asked for frequent shingles, and how many of these are put last at most
KNOWN_IDS = 2_000_000  # ids up to which they go to the texts, not the texts to them
EPS = 1e-6  # of a shingle: bounds are never tightened by rounding


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["key"])


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; their numbers of uses) of those used most in a sample of the texts. They only set the order of shingles."""
    uses = materialise(
        texts.filter(F.pmod("h", F.lit(SAMPLED)) == 0).mapInArrow(released(lambda b: _shingles(b, width)), "key long")
        .groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2"), "neardup-frequent",
    )
    least, total = 3, 0
    for r in sorted(uses.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect(), key=lambda r: -r["n"]):
        total += r["m"]
        if total > FREQUENT:
            least = r["n"] + 1
            break
    rows = uses.filter(F.col("n") >= least).toArrow()
    keys, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix_length(size: int, similarity: float) -> int:
    """Of two sets of at least the similarity, both sorted in one order, the first shared element is among so many first ones."""
    return size - math.ceil(similarity * size - EPS) + 1 if size else 0


def _prints(batches: Iterator[pa.RecordBatch], width: int, similarity: float, frequent) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, node, size, m0.., keys): node is a hash of the set of shingles, m0.. the parities of its numbers of elements in
    64 MARKS classes, keys its first elements in the order of uses, then of a hash."""
    known, uses = frequent.value
    for batch in batches:
        nodes, sizes, marks, keys = [], [], [], []
        for text in batch.column("text"):
            hashes = np.unique(shingle_hashes(text.as_py(), width))
            mixed = _mixed(hashes, 1)
            count = np.zeros(len(hashes), np.int64)
            if len(known) and len(hashes):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                count = np.where(known[at] == hashes, uses[at], 0)
            order = np.lexsort((hashes, mixed, count))
            keys.append(hashes[order[: prefix_length(len(hashes), similarity)]])
            parity = np.bincount((mixed % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
            marks.append(np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64))
            nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
            sizes.append(len(hashes))
        if not nodes:
            continue
        flat = np.concatenate(keys).view(np.int64)
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        table = np.stack(marks)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("h"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(MARKS)], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            names=["doc_id", "h", "node", "size", *MARK_COLUMNS, "keys"],
        )


MARK_COLUMNS = [f"m{k}" for k in range(MARKS)]
SHARED = ["node", "size", "pos", *MARK_COLUMNS]


def _neighbours(batches: Iterator[pa.RecordBatch], low: int, high: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of each block: members more than `low` and up to `high` places apart that are in two components."""
    for (nodes, comps, sizes, pos, *marks), starts in runs(batches, ["key", "block"], ["node", "comp", "size", "pos", *MARK_COLUMNS]):
        run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        a, b = [], []
        for step in range(low + 1, min(high, int(np.diff(starts).max(initial=0)) - 1) + 1):
            x = np.flatnonzero((run[step:] == run[:-step]) & (comps[step:] != comps[:-step]))
            y = x + step
            x, y = (v[can_be_alike(sizes[x], sizes[y], pos[x], pos[y], similarity)] for v in (x, y))
            apart = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int64) for m in (c.view(np.uint64) for c in marks))
            close = apart <= most_apart(sizes[x].astype(np.int64) + sizes[y], similarity)
            a.append(np.minimum(nodes[x[close]], nodes[y[close]]))
            b.append(np.maximum(nodes[x[close]], nodes[y[close]]))
        none = np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([none, *a]), np.concatenate([none, *b])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def can_be_alike(s, t, i, j, similarity: float):
    """Can sets of sizes s and t, whose first shared elements stand at i and j, have the similarity? For arrays and columns."""
    shared = similarity / (1 + similarity) * (s + t) - EPS
    return (s >= similarity * t - EPS) & (t >= similarity * s - EPS) & (s - i >= shared) & (t - j >= shared)


def most_apart(sizes, similarity: float):
    """Elements that are in one of two sets only, at most; parities of two sets differ in no more classes."""
    return (1 - similarity) / (1 + similarity) * sizes + EPS


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets of shingles have at least the Jaccard similarity."""
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("_left").to_pylist(), batch.column("_right").to_pylist()):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared >= similarity * (len(x) + len(y) - shared))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _sized(keys: DataFrame) -> DataFrame:
    """Keys to be sent to the texts if they are few enough; above that Spark sends both sides by key."""
    return F.broadcast(keys) if keys.count() <= KNOWN_IDS else keys


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, node, group): documents with a chain of links of at least the similarity have one group, its smallest doc_id.

    Similarity is the Jaccard similarity of the sets of runs of `width` words; h is a hash of the text, node one of the set. Equal
    sets are one node and never compared. Groups are exact: two sets of the similarity share one of their first shingles in any order
    (`prefix_length`), so each such shingle is a shard, and frequent shingles come last. Pairs of a shard are left out only if sizes,
    places or parities rule the similarity out, or if both are in one group already; the others are tested by their shingle sets.
    First come a few neighbours in random orders of each shard, which joins families of copies in blocks over many tasks; then all
    pairs of two groups, of which one is not the shard's largest, so a family is never compared all with all.

    Null and empty texts have the empty set and are one node. A group without any doc_id has a null one. Rows that repeat id and
    text are alike. Empty tables give no rows. Other columns are not read.
    """
    texts = ids_and_texts(docs).withColumn("h", F.xxhash64("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts, width))
    schema = "doc_id long, h long, node long, size int, " + "".join(f"{m} long, " for m in MARK_COLUMNS) + "keys array<long>"
    prints = materialise(texts.mapInArrow(released(lambda b: _prints(b, width, similarity, frequent)), schema), "neardup-prints")
    nodes = materialise(
        prints.groupBy("node").agg(F.min(F.struct("h", "doc_id")).alias("own"), F.min("doc_id").alias("first"))
        .select("node", "first", F.col("own.h").alias("h"), F.col("own.doc_id").alias("doc_id")), "neardup-nodes",
    )
    ends = prints.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    keys = materialise(ends.filter("a != b").select("key"), "neardup-keys")
    rows = materialise(
        prints.select("node", "size", *MARK_COLUMNS, F.posexplode("keys").alias("pos", "key")).join(_sized(keys), "key")
        .select("key", *SHARED).distinct(), "neardup-shared",
    )
    shared = rows
    comps, links, low, high = nodes.withColumn("comp", F.col("node")), None, 0, FEW
    rows = rows.withColumn("comp", F.col("node"))
    for turn in range(ROUNDS):
        large = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_BLOCK), "neardup-large")
        blocks = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / HOT_BLOCK)))
        found = (
            rows.join(_sized(large), "key", "left").withColumn("block", blocks.cast("long")).drop("n")
            .withColumn("turn", F.xxhash64("key", "node", F.lit(turn))).repartition("key", "block").sortWithinPartitions("key", "block", "turn")
            .mapInArrow(released(lambda b, low=low, high=high: _neighbours(b, low, high, similarity)), "a long, b long").distinct()
        )
        before = comps
        links, comps = _joined(texts, nodes, links, materialise(found, "neardup-pairs"), width, similarity)
        discard(large, before)
        shares = rows.drop("comp").join(comps.select("node", "comp"), "node").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
        most = shares.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
        most = materialise(  # the shards with pairs that are neither tested nor in one group
            most.filter((F.col("n") > min(high + 1, HOT_BLOCK)) & (F.col("top.n") < F.col("n"))).select("key", "n", F.col("top.comp").alias("main"), F.col("top.n").alias("m")),
            "neardup-left",
        )
        n, work = most.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * (F.col("n") - F.col("m"))), F.lit(0))).first()
        if not n:
            break
        spent, rows = rows, materialise(
            rows.drop("comp").join(_sized(most.select("key")), "key").join(comps.select("node", "comp"), "node").select("key", *SHARED, "comp"), "neardup-rest",
        )
        discard(spent)
        if turn == ROUNDS - 1 or work <= WORK * n:
            rest = _across(rows.join(_sized(most.select("key", "main")), "key"), similarity)
            before = comps
            links, comps = _joined(texts, nodes, links, materialise(rest, "neardup-pairs"), width, similarity)
            discard(before, most)
            break
        discard(most)
        low, high = 0, 4 * high
    least = comps.groupBy("comp").agg(F.min("first").alias("group"))
    labels = materialise(comps.join(least, "comp").select("node", "group"), "neardup-labels")
    discard(shared, rows, keys, nodes, comps)
    return prints.select("doc_id", "h", "node").join(labels, "node")


def _across(rows: DataFrame, similarity: float) -> DataFrame:
    """All candidate pairs of a shard in two components: one is not in its `main` one, so the join is never all with all of that."""
    left = rows.select("key", "main", *[F.col(c).alias("_" + c) for c in ("comp", *SHARED)])
    right = rows.filter(F.col("comp") != F.col("main")).drop("main")
    apart: Column = sum((F.bit_count(F.col(m).bitwiseXOR(F.col("_" + m))) for m in MARK_COLUMNS), F.lit(0))
    pairs = left.join(right, "key").filter(
        (F.col("comp") != F.col("_comp")) & ((F.col("_comp") == F.col("main")) | (F.col("_node") < F.col("node")))
        & can_be_alike(F.col("size"), F.col("_size"), F.col("pos"), F.col("_pos"), similarity)
        & (apart <= most_apart(F.col("size") + F.col("_size"), similarity))
    )
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def _joined(texts: DataFrame, nodes: DataFrame, links: DataFrame | None, pairs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links with those of the pairs that are alike, nodes with their component comp)."""
    tested = _verified(texts, nodes, pairs, width, similarity)
    discard(pairs)
    links = tested if links is None else links.unionByName(tested)
    roots = materialise(connected_components(links), "neardup-roots")
    comps = materialise(nodes.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "neardup-groups")
    discard(roots)
    return links, comps


def _verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs of nodes that are alike enough, by the shingle sets of one text of each."""
    named = materialise(
        nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        .select("node", F.xxhash64("doc_id").alias("_d"), "h"), "neardup-wanted",
    )
    sets = (
        texts.withColumn("_d", F.xxhash64("doc_id")).join(_sized(named), ["_d", "h"]).select("node", "text")
        .mapInArrow(released(lambda b: _sets(b, width)), "node long, shingles binary").dropDuplicates(["node"])
    )
    sets = materialise(sets, "neardup-sets")
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_left")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_right")), "b")
    )
    found = materialise(both.mapInArrow(released(lambda b: _alike(b, similarity)), "a long, b long"), "neardup-links")
    discard(sets, named)
    return found


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, but only one of each group of near copies: the one with the smallest doc_id.

    All columns of `docs` are returned as they are. Of rows with the smallest id but other texts the first by a hash of the text
    stays, and of rows that repeat both one. A group of which all ids are null keeps one row.
    """
    groups = near_duplicate_groups(docs, width, similarity)
    one = groups.groupBy("doc_id", "h", "group").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    keep = (
        one.filter(F.col("doc_id").eqNullSafe(F.col("group")))
        .groupBy("group", F.when(F.col("group").isNull(), F.col("node")).alias("node")).agg(F.min("h").alias("h"))
        .select(F.xxhash64("group").alias("_d"), F.col("h").alias("_h"), F.lit(True).alias("_first"))
    )
    every = one.select(F.xxhash64("doc_id").alias("_d"), F.col("h").alias("_h"), "n").groupBy("_d", "_h").agg(F.max("n").alias("n"))
    judged = materialise(every.join(keep, ["_d", "_h"], "left"), "neardup-keep")
    gone = judged.filter(F.col("_first").isNull()).select("_d", "_h")
    keyed = docs.withColumns({"_d": F.xxhash64(F.col("doc_id").cast("long")), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = keyed.join(_sized(gone), ["_d", "_h"], "left_anti")
    if judged.filter(F.col("_first") & (F.col("n") > 1)).limit(1).count():
        kept = kept.dropDuplicates(["_d", "_h"])
    return kept.select(*docs.columns)
