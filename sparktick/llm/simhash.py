"""SimHash fingerprints, linked through BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import ids_and_texts, released
from sparktick.llm.components import connected_components
from sparktick.session import materialise

SEED = 42
HOT_GROUP = 4096  # members of a shard above which its key is refined
SMALL = 8
KNOWN_IDS = 2_000_000  # ids up to which they go to the texts, not the texts to them


# ---- fingerprints ---------------------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, width: int, lower: bool = False) -> np.ndarray:
    """XXH64 of each run of `width` words joined by a blank, repeats included; of all words, if there are fewer."""
    raw = text.encode()
    words = (raw.lower() if lower else raw).split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (np.concatenate(([0], ends[:-1]))[: len(words) - width + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())], np.uint64)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, lowest first: is it set in over half the hashes?"""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)


def simhash64(hashes: np.ndarray) -> int:
    return int.from_bytes(np.packbits(majority_bits(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [simhash64(shingle_hashes(t.as_py(), width, lower)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "h", "fp"],
        )


# ---- shards and their trees -----------------------------------------------------------------------------------------------------


class BKTree:
    """Fingerprints; a node's children are keyed by their Hamming distance to it."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, item: int, radius: int) -> list[tuple[int, int]]:
        """(distance, index) of all nodes at most `radius` away; only edges that can lead there are followed."""
        found, stack = [], [0] if self.items else []
        while stack:
            i = stack.pop()
            d = (self.items[i] ^ item).bit_count()
            if d <= radius:
                found.append((d, i))
            stack.extend([c for e, c in self.children[i].items() if d - radius <= e <= d + radius])
        return found

    def add(self, item: int) -> None:
        new = len(self.items)
        self.items.append(item)
        self.children.append({})
        i = 0
        while new:
            d = (self.items[i] ^ item).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = new
                break
            i = self.children[i][d]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Blocks of sorted rows that hold whole runs of equal keys: (columns, starts of the runs and the end)."""
    held: list[list[np.ndarray]] = []

    def block(rows: list[list[np.ndarray]], whole: bool):
        full = [np.concatenate(c) for c in zip(*rows)]
        changed = np.zeros(len(full[0]), bool)
        changed[0] = True
        for k in full[: len(keys)]:
            changed[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(changed)
        cut = len(changed) if whole else int(starts[-1])
        starts = np.append(starts[starts < cut], cut)
        return [c[:cut] for c in full[len(keys):]], starts, [c[cut:] for c in full]

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in keys + columns])
        if held and sum(len(h[0]) for h in held) >= 1 << 16 and any(h[0][0] != held[-1][0][-1] for h in held):
            out, starts, rest = block(held, False)
            held = [rest]
            if len(starts) > 1:
                yield out, starts
    if held:
        out, starts, _ = block(held, True)
        yield out, starts


def near_runs(fps: np.ndarray, starts: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The runs that can hold a pair: those above SMALL, and the others in which some pair lies within the radius."""
    sizes = np.diff(starts)
    run = np.repeat(np.arange(len(sizes)), sizes)
    hit = sizes > SMALL
    for step in range(1, SMALL):
        same = run[step:] == run[:-step]
        if not same.any():
            break
        a = np.flatnonzero(same)
        close = np.bitwise_count(fps[a] ^ fps[a + step]) <= radius
        hit[run[a[close]]] = True
    return [(int(starts[i]), int(starts[i + 1])) for i in np.flatnonzero(hit)]


def _spanning_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """For each shard, links that connect what its BK-tree finds connected: from each fingerprint to its group's first."""
    for (fps,), starts in runs(batches, ["mask", "key"], ["fp"]):
        values = fps.view(np.uint64)
        a, b = [], []
        for lo, hi in near_runs(values, starts, radius):
            tree, up = BKTree(), list(range(hi - lo))

            def top(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for i, item in enumerate(values[lo:hi].tolist()):
                for _, j in tree.within(item, radius):
                    p, q = top(i), top(j)
                    up[max(p, q)] = min(p, q)
                tree.add(item)
            for i in range(hi - lo):
                if top(i) != i:
                    a.append(int(fps[lo + i]))
                    b.append(int(fps[lo + top(i)]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n:(i + 1) * len(bits) // n] for i in range(n)]


def _mask(bits: Iterable[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint_links(fps: DataFrame, radius: int, hot: int = HOT_GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within `radius` bits, directly or through others.

    Of radius + 2 blocks of bits, two within the radius share at least two; each pair of blocks gives a shard of fingerprints
    equal there, in which a BK-tree is searched. A shard above `hot` members is split the same way: what is left can differ in
    `radius` bits at most, so one of radius + 1 parts of the other bits is equal. That loses no link and ends when few bits are
    left. A shard gives at most one link for each member.
    """
    spark = fps.sparkSession
    blocks = _parts(list(range(64)), radius + 2)
    free = {_mask(p + q): [b for r in blocks if r is not p and r is not q for b in r] for i, p in enumerate(blocks) for q in blocks[:i]}
    todo = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in free])).alias("mask"))
    links = None
    while True:
        todo = materialise(todo.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))), "simhash-shards")
        large = materialise(
            todo.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("mask", "key"),
            "simhash-large",
        )
        masks = [r["mask"] for r in large.select("mask").distinct().collect() if len(free[r["mask"]]) > radius + 1]
        refined = large.filter(F.col("mask").isin(masks)) if masks else None
        rest = todo if refined is None else todo.join(refined, ["mask", "key"], "left_anti")
        found = (
            rest.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
            .mapInArrow(released(lambda batches: _spanning_links(batches, radius)), "a long, b long")
        )
        links = found if links is None else links.unionByName(found)
        if refined is None:
            return links
        finer = [(m, _mask([b for b in range(64) if b not in free[m]] + p), _parts_left(free[m], p)) for m in masks for p in _parts(free[m], radius + 1)]
        table = spark.createDataFrame([(m, n) for m, n, _ in finer], "mask long, finer long")
        free = {n: left for _, n, left in finer}
        todo = todo.join(refined, ["mask", "key"], "left_semi").join(F.broadcast(table), "mask").select("fp", F.col("finer").alias("mask"))


def _parts_left(bits: list[int], taken: list[int]) -> list[int]:
    return [b for b in bits if b not in taken]


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, lower: bool = True, hot: int = HOT_GROUP) -> DataFrame:
    """(doc_id, h, fp long, component_id): documents linked by fingerprints at most `radius` bits apart, directly or through others.

    component_id is the smallest doc_id of the component, h a hash of the text. Copies and all other documents of one fingerprint are one node. Null and
    empty texts have fingerprint zero and are linked like any other; a component without any doc_id has a null id. Repeated rows
    stay. Empty tables give no rows. Other columns are not read.
    """
    prints = materialise(
        ids_and_texts(docs).withColumn("h", F.xxhash64("text"))
        .mapInArrow(released(lambda batches: _fingerprints(batches, width, lower)), "doc_id long, h long, fp long"), "simhash",
    )
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = materialise(connected_components(fingerprint_links(nodes, radius, hot)), "simhash-roots")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "h", "fp", "component_id")


def drop_simhash_copies(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of `docs`, but of each component of fingerprints only those with its smallest doc_id.

    Of rows with the smallest id but other texts the first by a hash of the text stays; rows that repeat both stay. Where all ids are
    null, one text of each fingerprint stays. All columns of `docs` are returned as they are.
    """
    found = simhash_components(docs, width, radius)
    first = (
        found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(F.min("h").alias("_h"))
        .select(F.xxhash64("component_id").alias("_d"), "_h")
    )
    every = found.select(F.xxhash64("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    gone = materialise(every.join(first, ["_d", "_h"], "left_anti"), "simhash-gone")
    if gone.count() <= KNOWN_IDS:
        gone = F.broadcast(gone)
    keyed = docs.withColumns({"_d": F.xxhash64(F.col("doc_id").cast("long")), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(gone, ["_d", "_h"], "left_anti").select(*docs.columns)


def as_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
