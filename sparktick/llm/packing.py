"""Hierarchical residual packing of token sequences into bins of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import ids_and_texts, released
from sparktick.llm.tokens import encoder
from sparktick.session import discard, materialise

CAPACITY = 2048
BLOCK_ITEMS = 20_000  # items or bins that one group packs at a time
FAN_IN = 8  # nodes merged into one in each round
ITEMS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin of each item, its offset there, fill of each bin). Equal lengths keep their order."""
    bins, places, fills = [0] * len(lengths), [0] * len(lengths), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is a bin with room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += n
        left = room - n
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins, places, fills


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and a shorter first one."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """The pieces of each text's ids, numbered within the task; texts and ids go no further."""
    ids_of = encoder(path).encode
    end = (0).to_bytes(4, "little")
    number = TaskContext.get().partitionId() << 40
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "item"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    items: list[tuple] = []

    def held() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*items), kinds)], names=names)
        items.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = ids_of(text.as_py()) + end
            for piece, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                items.append((doc_id, piece, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), number))
                number += 1
            if len(items) >= BLOCK_ITEMS:
                yield held()
    if items:
        yield held()
    encoder(path).forget()  # the worker lives on


def _pack_items(capacity: int):
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        bins, places, fills = best_fit(pdf["length"].tolist(), capacity)
        first = int(pdf["node"].iloc[0]) << 36
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["bin"], out["place"], out["fill"] = [first + b for b in bins], places, [fills[b] for b in bins]
        return out

    return pack


def _pack_node(capacity: int):
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bins, places, fills = best_fit(pdf["fill"].tolist(), capacity)
        name: dict[int, int] = {}
        for own, b in zip(pdf["bin"].tolist(), bins):
            name.setdefault(b, own)  # the merged bin keeps the id of its first member
        return pd.DataFrame({
            "bin": pdf["bin"], "into": [name[b] for b in bins], "at": places, "fill_into": [fills[b] for b in bins],
            "node": pdf["node"],
        })

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, nearly_full: int = 2) -> DataFrame:
    """Pack whole documents into as few sequences of at most `capacity` tokens as best fit finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece. A document is its text's ids by
    the tokenizer file and the id 0; only a longer one than `capacity` is cut, with a shorter first piece.

    Texts and ids stay in the tasks that read them; what moves is a few numbers for each piece. In round 0 the pieces are dealt by a
    hash to nodes of about BLOCK_ITEMS, so that each node has short and long ones whatever the order of the table, and each node
    packs its own by best fit decreasing. Bins with at most `nearly_full` tokens of room, or with less room than the smallest
    underfull bin has tokens, are done. The others become items that are packed again by a tree of groups, FAN_IN nodes in one,
    until one node is left; a node with more than BLOCK_ITEMS loose bins is packed in slices of that size, dealt by a hash. The
    pieces move once more at the end, to learn their final place.

    Null and empty texts give one piece of one token. Empty tables give no rows. Repeated rows are packed as rows of their own.
    """
    pieces = materialise(
        ids_and_texts(docs).mapInArrow(released(lambda batches: _pieces(batches, tokenizer, capacity)), ITEMS + ", item long"), "pack-pieces",
    )
    nodes = max(1, -(-pieces.count() // BLOCK_ITEMS))
    items = materialise(
        pieces.withColumn("node", F.pmod(F.xxhash64("item"), F.lit(nodes))).groupBy("node")
        .applyInPandas(_pack_items(capacity), ITEMS + ", bin long, place long, fill int"), "pack-items",
    )
    discard(pieces)
    bins = items.select("bin", "fill", F.shiftright("bin", 36).alias("node")).distinct()
    moves = None
    while True:
        least = bins.filter(F.col("fill") < capacity - nearly_full).agg(F.min("fill"), F.max("node")).first()
        if least[0] is None:
            break
        room = capacity - F.col("fill")
        loose = bins.filter((room > nearly_full) & (room >= F.lit(least[0])))
        loose = loose.withColumn("node", F.floor(F.col("node") / FAN_IN))
        sizes = loose.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ITEMS).alias("slices"))
        merged = materialise(
            loose.join(sizes, "node").withColumn("slice", F.pmod(F.xxhash64("bin"), F.col("slices")))
            .groupBy("node", "slice").applyInPandas(_pack_node(capacity), "bin long, into long, at long, fill_into int, node long"),
            "pack-moves",
        )
        step = merged.select("bin", "into", "at")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("at").alias("_at"))
            older = moves.join(later, "into", "left").select(
                "bin", F.coalesce("_into", "into").alias("into"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"),
            )
            moves = materialise(older.unionByName(step.join(moves.select("bin"), "bin", "left_anti")), "pack-moves")
        if least[1] < FAN_IN:
            break
        bins = merged.select(F.col("into").alias("bin"), F.col("fill_into").alias("fill"), "node").distinct()
    placed = items if moves is None else items.join(moves, "bin", "left")
    into, at = (F.col("bin"), F.lit(0)) if moves is None else (F.coalesce("into", "bin"), F.coalesce("at", F.lit(0)))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", into.alias("sequence_id"), (F.col("place") + at).cast("long").alias("offset"),
    )
