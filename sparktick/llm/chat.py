"""Chat formatting of conversations as prefix trees."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import released

# The template's control strings.
END, HEAD, BREAK = "</s>", "<|turn|>", "<|text|>"
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<</?SYS>>|<\|[a-z_]+\|>")
BLOCK_CHARS = 1 << 22  # code points of a tree that a task holds


def escape(text: str) -> str:
    """A backslash after the first character of each control string, and before each backslash: none of them is left."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """(string of a turn, begin and end of its text in it): <|turn|>role<|text|>text</s>."""
    before = HEAD + escape(role) + BREAK
    body = escape(text)
    return before + body + END, len(before), len(before) + len(body)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; no unescaped control string can stand inside them."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(HEAD).partition(BREAK)
        turns.append((unescape(role), unescape(text)))
    return turns


NODES = (
    "block long, node long, parent long, depth int, start long, position long, length long, text string, loss_start long, "
    "loss_end long, attends array<struct<start:long,end:long>>, conv_ids array<long>"
)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix trees of conversations sorted by their turns, depth first; a block ends at BLOCK_CHARS and starts its paths anew."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    path: list[tuple[tuple, dict]] = []  # the open turns and their nodes
    nodes: list[dict] = []
    place = 0

    def flushed() -> pa.RecordBatch:
        names = [f.split()[0] for f in NODES.split(", ")[:11]] + ["conv_ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([n[c] for n in nodes], k) for c, k in zip(names, kinds)], names=names)

    for batch in batches:
        for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
            own = [(t["role"], t["text"]) for t in turns]
            if place > BLOCK_CHARS:
                yield flushed()
                nodes, path, place, block = [], [], 0, block + 1
            shared = 0
            for (turn, _), mine in zip(path, own):
                if turn != mine:
                    break
                shared += 1
            del path[shared:]
            for role, text in own[shared:]:
                value, a, b = formatted_turn(role, text)
                up = path[-1][1] if path else None
                attends = list(up["attends"]) if up else []
                if up:  # the parent's own tokens; neighbours in the sequence become one interval
                    mine = {"start": up["start"], "end": up["start"] + up["length"]}
                    if attends and attends[-1]["end"] == mine["start"]:
                        attends[-1] = {"start": attends[-1]["start"], "end": mine["end"]}
                    else:
                        attends.append(mine)
                learned = role == "assistant"
                node = {
                    "block": block, "node": len(nodes), "parent": up["node"] if up else -1, "depth": len(path), "start": place,
                    "position": up["position"] + up["length"] if up else 0, "length": len(value), "text": value,
                    "loss_start": place + a if learned else None, "loss_end": place + b if learned else None,
                    "attends": attends, "conv_ids": [],
                }
                place += len(value)
                nodes.append(node)
                path.append(((role, text), node))
            path[-1][1]["conv_ids"].append(conv_id)
    if nodes:
        yield flushed()


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, path) of rows (conv_id, turn, role, text): turns in order, path the running hashes of the turns so far."""
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
        .alias("turns")
    )
    return whole.withColumn("path", F.aggregate(
        F.col("turns"), F.array().cast("array<long>"),
        lambda done, t: F.concat(done, F.array(F.xxhash64(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)), t["role"], t["text"]))),
    ))


def chat_trees(turns: DataFrame) -> DataFrame:
    """Conversations as prefix trees: one row for each node, a turn that all conversations below it begin with.

    Columns: block, node, parent (-1: root), depth, start (place in the block's sequence, depth first), position (id of its first
    code point: the lengths of its ancestors), length, text (the turn by the template), loss_start and loss_end (the part under
    the loss mask: texts of assistants), attends (intervals of the ancestors in the sequence; besides, a node sees itself
    causally) and conv_ids (conversations that end here).

    Conversations are sorted by their running turn hashes over range partitions, so those with equal first turns lie together and
    each task emits a shared turn once for each block. A block holds about BLOCK_CHARS; the turns above a cut are emitted again
    in the next block, since a sequence can only attend to itself. A first turn or a whole conversation that a third of the rows
    share is spread over as many partitions as it needs (equal paths are told apart by conv_id).

    Null texts and roles count as empty. Rows without conv_id take no part. Turns are ordered by turn (null first), role and text;
    repeated rows are turns of their own. A conversation's turns must fit into a task, as one training example. Empty tables give
    no rows.
    """
    spark = turns.sparkSession
    whole = conversations_of(turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        whole.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
        .mapInArrow(released(_trees), NODES)
    )


READ = "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from nodes in their order: each is what its last node attends to, and the node itself."""
    block: int | None = None
    starts: list[int] = []
    texts: list[tuple[str, str]] = []  # (formatted turn, its part under the loss mask)
    for batch in batches:
        rows = []
        for n in batch.to_pylist():
            if n["block"] != block:
                block, starts, texts = n["block"], [], []
            a, b = (n["loss_start"] or 0) - n["start"], (n["loss_end"] or 0) - n["start"]
            starts.append(n["start"])
            texts.append((n["text"], "" if n["loss_start"] is None else n["text"][a:b]))
            if not n["conv_ids"]:
                continue
            seen = []
            for s in n["attends"]:
                seen.extend(texts[bisect_left(starts, s["start"]):bisect_left(starts, s["end"])])
            seen.append(texts[-1])
            text = "".join(t for t, _ in seen)
            loss = "".join(unescape(t) for _, t in seen)
            turns = [{"role": r, "text": t} for r, t in parsed(text)]
            rows.extend((c, text, turns, loss) for c in n["conv_ids"])
        if rows:
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            a, b, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, kind), pa.array(d, pa.string())],
                names=["conv_id", "formatted", "turns", "loss"],
            )


def read_back(nodes: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss) of each conversation, from the tree alone: its text is what its last node attends to."""
    return nodes.repartition("block").sortWithinPartitions("block", "node").mapInArrow(released(_read), READ)
