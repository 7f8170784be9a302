"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktick.llm.common import released
from sparktick.session import discard, materialise

TABLES = 16
WIDTH = 1.5  # of a bucket; vectors are scaled into the unit ball
BUCKET = 8192  # vectors of a bucket that are scored at once
PART = 100_000  # vectors of a part of the index, which one task holds
PROBED = 1 << 22  # buckets probed by the queries of a slice, which one task holds
FIRST = 4  # parts that are searched at first; each later round searches as many as all rounds before it
SPARE = 8  # candidates kept beyond the wanted number until they are scored exactly


def projections_for(n: int) -> int:
    """Projections of a table: buckets grow finer with the number of vectors."""
    return max(0, int(0.6 * (math.log2(max(n, 1)) - 5.5)))


def perturbations(offsets: np.ndarray, probes: int) -> list[list[int]]:
    """The first `probes` perturbations of a bucket in estimated success order.

    offsets: place of the query in its bucket for each projection, 0 to 1. A step to a neighbour bucket costs the square of the
    distance to it; a set of steps costs their sum. Sets are taken from a heap by the usual shift and expand moves.
    """
    m = len(offsets)
    steps = sorted([(float(x) ** 2, j, -1) for j, x in enumerate(offsets)] + [(float(1 - x) ** 2, j, 1) for j, x in enumerate(offsets)])
    found, heap = [[0] * m], [(steps[0][0], (0,))] if m else []
    while heap and len(found) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({steps[i][1] for i in chosen}) == len(chosen):
            move = [0] * m
            for i in chosen:
                move[steps[i][1]] = steps[i][2]
            found.append(move)
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
    return found


class Tables:
    """Gaussian projections of all tables, the same in every task."""

    def __init__(self, dim: int, projections: int, tables: int, largest: float):
        rng = np.random.default_rng([dim, projections, tables])
        self.m, self.tables, self.largest = projections, tables, largest
        self.axes = rng.normal(size=(dim + 1, tables * projections))
        self.shift = rng.uniform(0, WIDTH, tables * projections)
        self.mix = rng.integers(1, 2**63, size=(tables, projections + 1), dtype=np.uint64) | np.uint64(1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.axes + self.shift) / WIDTH).reshape(len(x), self.tables, self.m)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """64-bit bucket keys of integer cells (.., tables, m)."""
        k = (cells.astype(np.int64).view(np.uint64) * self.mix[:, 1:]).sum(axis=-1, dtype=np.uint64) + self.mix[:, 0]
        k = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return k ^ (k >> np.uint64(29))

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        """Keys (n, tables) of vectors: scaled into the unit ball, with what is missing to length one as a further coordinate."""
        x = v / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
        return self.keys(np.floor(self.cells(np.concatenate([x, rest], axis=1))))

    def of_queries(self, v: np.ndarray, probes: int) -> list[np.ndarray]:
        """Keys of all probes of each query; its length does not change the order of inner products."""
        x = v / np.linalg.norm(v, axis=1, keepdims=True)
        cells = self.cells(np.concatenate([x, np.zeros((len(x), 1))], axis=1))
        home = np.floor(cells)
        out = []
        for own, inside in zip(home, cells - home):
            moves = [perturbations(o, probes) for o in inside]
            probed = np.array(moves).transpose(1, 0, 2) + own[None]
            out.append(np.unique(self.keys(probed)))
        return out


def _floats(column: pa.Array) -> np.ndarray:
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _hashed(batches: Iterator[pa.RecordBatch], hashing: Tables, probes: int, queries: bool) -> Iterator[pa.RecordBatch]:
    """The batches with the vector as bytes, and with the keys of its buckets, or of those that the query probes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _floats(batch.column("vector"))
        keys = hashing.of_queries(v, probes) if queries else [np.unique(own) for own in hashing.of_rows(v)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())],
            names=["id", "vector", "keys"],
        )


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `keep` best distinct candidates of each query."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    pair = np.lexsort((v, q))
    first = np.ones(len(q), bool)
    first[pair[1:]] = (q[pair[1:]] != q[pair[:-1]]) | (v[pair[1:]] != v[pair[:-1]])
    q, v, s = q[first], v[first], s[first]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    inside = rank < keep
    return q[inside], v[inside], s[inside]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _owners(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row numbers) sorted by key."""
    keys = np.frombuffer(b"".join(column), np.uint64)
    rows = np.repeat(np.arange(len(column)), [len(k) // 8 for k in column])
    order = np.argsort(keys, kind="stable")
    return keys[order], rows[order]


def _search(keep: int, most_scored: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "row": [], "near": []}).astype({"query": "int64", "row": "int64", "near": "float64"})
        if index.empty or queries.empty:
            return none
        vectors, asked = _matrix(index["vector"]), _matrix(queries["vector"])
        keys, rows = _owners(index["keys"])
        probed, askers = _owners(queries["keys"])
        known = queries["least"].to_numpy(np.float64)  # the last of the best that earlier rounds found
        least, most = known, max(1 << 16, 4 * keep * len(queries))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        edges = np.append(np.flatnonzero(np.diff(probed, prepend=probed[0] - np.uint64(1))), len(probed))
        los, his = np.searchsorted(keys, probed[edges[:-1]], "left"), np.searchsorted(keys, probed[edges[:-1]], "right")
        for a, b, lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), los.tolist(), his.tolist()):
            for at in range(lo, hi, most_scored):
                own, bucket = askers[a:b], rows[at:min(at + most_scored, hi)]
                for q0 in range(0, len(own), 1024):
                    some = own[q0:q0 + 1024]
                    score = asked[some] @ vectors[bucket].T
                    i, j = np.nonzero(score >= least[some][:, None])
                    held.append((some[i], bucket[j], score[i, j]))
                    size += len(i)
                    if size > most:
                        held = [_best(*map(np.concatenate, zip(*held)), keep)]
                        size = len(held[0][0])
                        counts = np.bincount(held[0][0], minlength=len(queries))
                        last = np.full(len(queries), np.inf)
                        np.minimum.at(last, held[0][0], held[0][2])
                        least = np.where(counts >= keep, np.maximum(last, known), known)
        if not held:
            return none
        q, v, s = _best(*map(np.concatenate, zip(*held)), keep)
        return pd.DataFrame({"query": queries["id"].to_numpy()[q], "row": index["id"].to_numpy()[v], "near": s})

    return search


def valid(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(
    embeddings: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, bucket: int = BUCKET, projections: int | None = None,
) -> DataFrame:
    """The k rows with the largest inner product for each row for which `is_query` holds, without the row itself.

    Returns query_id, rank, vec_id, score (double precision, on the original vectors); ties go to the smaller vec_id.

    Vectors are put on the unit sphere by one more coordinate, where the largest inner product is the least distance, and hashed
    by Gaussian projections into `tables` tables. A query probes 2^(projections - 1), at least 8, perturbed buckets of each table
    in the order of their estimated success. Index and queries meet by bucket: a group holds a part of the vectors and a slice of the
    queries, with the keys of their buckets, and keeps the best distinct candidates of each query. Parts are searched in rounds that
    double; a later round returns only what is as good as the last of the best so far, so that the candidates returned for a query
    grow with the logarithm of the parts. The best are then scored exactly. `bucket` vectors of a bucket are scored at once. Queries for which too few candidates turn up (fewer than k, and fewer than there are) search everything in one bucket.

    Equal vectors are one entry, with as many of their smallest ids as can be needed. Vectors that are null, zero or hold null or
    non-finite components take no part, and neither do those of another dimension than the first valid row by vec_id. Null
    vec_ids take no part. Of rows that repeat a vec_id one counts, the first by a hash of the vector. No valid rows give no result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
    ).filter(F.col("vec_id").isNotNull()).withColumn("asks", F.coalesce(is_query, F.lit(False))).filter(valid(F.col("vector")))
    first = rows.agg(F.min_by(F.size("vector"), "vec_id")).first()[0]
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = (
        rows.filter(F.size("vector") == first)
        .withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector")})
        .groupBy("vec_id").agg(F.min(F.struct("h", "g", "vector", "asks")).alias("row")).select("vec_id", "row.*")
    )
    # The row limit of a rank is taken before the exchange too, so copies of one vector never meet as a whole.
    by_id = Window.partitionBy("h", "g").orderBy("vec_id")
    queries = materialise(rows.filter("asks").select(F.col("vec_id").alias("id"), "vector"), "ann-queries")
    member = materialise(
        rows.select("h", "g", "vec_id", "vector").withColumn("place", F.row_number().over(by_id))
        .filter(F.col("place") <= k + 1), "ann-members",
    )
    entry = member.filter("place = 1").select(F.col("vec_id").alias("id"), "vector", "h", "g")
    longest = F.sqrt(F.max(inner_product(F.col("vector"), F.col("vector"))))
    n, largest = entry.agg(F.count(F.lit(1)), longest).first()
    found = _candidates(entry, queries, n, largest, first, tables, projections_for(n) if projections is None else projections, bucket, k)
    everything = member.agg(F.count(F.lit(1))).first()[0]
    few = queries.join(
        found.groupBy("query").count().filter(F.col("count") >= min(k + 1, n)).withColumnRenamed("query", "id"), "id", "left_anti",
    )
    if few.limit(1).count():
        rest = materialise(few, "ann-rest")
        more = _candidates(entry, rest, n, largest, first, 1, 0, bucket, k)
        found = materialise(found.join(rest.select(F.col("id").alias("query")), "query", "left_anti").unionByName(more), "ann-found")
    scored = (
        found.join(queries.select(F.col("id").alias("query"), F.col("vector").alias("_q")), "query")
        .join(entry.select(F.col("id").alias("row"), "vector", "h", "g"), "row")
        .select("query", "h", "g", inner_product(F.col("_q"), F.col("vector")).alias("score"))
    )
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return (
        scored.join(member.select("h", "g", "vec_id"), ["h", "g"]).filter(F.col("vec_id") != F.col("query"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(k, max(everything, 1)))
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _candidates(
    entry: DataFrame, queries: DataFrame, n: int, largest: float, dim: int, tables: int, projections: int, bucket: int, k: int,
) -> DataFrame:
    """(query, row, near): the best distinct entries of each query, by the inner product as a block of products gives it."""
    hashing = Tables(dim, projections, tables, largest * (1 + 1e-12))
    probes, keep = max(8, 1 << max(0, projections - 1)), k + 1 + SPARE
    parts, asking = -(-n // PART) or 1, queries.count()
    # Slices are bounded by what a task holds; a small index is cut more often, so that all cores have work.
    slices = max(-(-asking * tables * min(probes, 3**projections) // PROBED), -(-entry.sparkSession.sparkContext.defaultParallelism // parts))
    kind = "id long, vector binary, keys binary"
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    index = entry.select("id", "vector").mapInArrow(released(lambda b: _hashed(b, hashing, probes, False)), kind)
    index = materialise(index.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), "ann-index")
    asked = queries.select("id", "vector").repartition(max(slices, parts), "id").mapInArrow(released(lambda b: _hashed(b, hashing, probes, True)), kind)
    asked = materialise(asked.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")), "ann-asked")
    best = Window.partitionBy("query").orderBy(F.col("near").desc(), "row")
    found, done = None, 0
    while done < parts:
        upto = min(parts, max(FIRST, 2 * done))
        inside = index.filter(F.col("part").between(done, upto - 1)).select("part", each, "id", "vector", "keys")
        if found is None:
            known = asked.withColumn("least", F.lit(float("-inf")))
        else:
            last = found.groupBy(F.col("query").alias("id")).agg(F.when(F.count(F.lit(1)) >= keep, F.min("near")).alias("least"))
            known = asked.join(last, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        each_part = F.explode(F.sequence(F.lit(done), F.lit(upto - 1))).alias("part")
        known = known.select(each_part, "slice", "id", "vector", "keys", "least")
        dealt = max(1, (upto - done) * slices)
        near = (
            inside.repartition(dealt, "part", "slice").groupBy("part", "slice")
            .cogroup(known.repartition(dealt, "part", "slice").groupBy("part", "slice")).applyInPandas(_search(keep, bucket), "query long, row long, near double")
        )
        near = near if found is None else found.unionByName(near)
        found = materialise(near.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep).drop("_n"), "ann-candidates")
        done = upto
    discard(index, asked)
    return found
