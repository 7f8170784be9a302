"""Token ids in binary files of patched frame-of-reference blocks, with an index of block starts."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktick.llm.bpe import PIECES, UNUSUAL
from sparktick.llm.common import chunks, ids_and_texts, released
from sparktick.session import materialise, scratch_path

MAGIC = b"PFOR"
BLOCK = 256  # ids of a block
SEGMENT_IDS = 1 << 18  # a segment ends with the document that reaches so many ids
SEGMENTS_A_FILE = 4
PERCENTILE = 90
AT_ONCE = 512  # blocks whose bits are spread out at once
REMEMBERED = 200_000  # distinct parts of a generation; a worker keeps two
BLOCK_BYTES = 4 << 20
ODD = r"<\||[^\x00-\x1b\x20-\x{24F}]"  # may hold a special token's string, or characters beyond those `PIECES` knows

# A file is a run of segments, each followed by one line feed. A segment, little endian:
#   header  "PFOR", then unsigned 32-bit: bytes of the segment, partition, number in the partition, documents, blocks, exceptions;
#           unsigned 64-bit: ids
#   documents  doc_id (64-bit) of each; 1 where doc_id is null (8-bit) of each; ids (unsigned 64-bit) of each
#   index   start of each block's bytes in the packed part (unsigned 64-bit); first exception of each block (unsigned 32-bit)
#   blocks  minimum (unsigned 32-bit) of each; width in bits (8-bit) of each
#   packed  of each block: 256 differences to the minimum, `width` low bits each, lowest bit first
#   exceptions  place in the block (8-bit) of each; what stands above the block's width (unsigned 32-bit) of each
HEADER = struct.Struct("<4s6IQ")


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> dict[str, np.ndarray]:
    """Blocks of 256 ids: minimum, the width that `percentile` of the differences fit in, packed low bits and exceptions."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[:len(ids)] = ids
    full[len(ids):] = ids[-1] if len(ids) else 0
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1, initial=0xFFFFFFFF) if n else np.zeros(0, np.uint32)
    full -= low[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile / 100)) - 1))
    wide = np.partition(full, rank, axis=1)[:, rank] if n else low
    width = np.ceil(np.log2(wide.astype(np.float64) + 1)).astype(np.uint8)
    block, place = np.nonzero(full >> np.minimum(width, 31)[:, None].astype(np.uint32)) if n else (np.zeros(0, int), np.zeros(0, int))
    if n and (width == 32).any():
        narrow = width[block] < 32
        block, place = block[narrow], place[narrow]
    above = full[block, place] >> width[block].astype(np.uint32)
    starts = np.zeros(n + 1, np.uint64)
    np.cumsum(width.astype(np.uint64) * (BLOCK // 8), out=starts[1:])
    packed = np.zeros(int(starts[-1]), np.uint8)
    for bits in np.unique(width):
        if bits:
            for rows in np.array_split(np.nonzero(width == bits)[0], 1 + int((width == bits).sum()) // AT_ONCE):
                if len(rows):
                    size = int(bits) * (BLOCK // 8)
                    ones = (full[rows][:, :, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
                    spots = starts[rows].astype(np.int64)[:, None] + np.arange(size)
                    packed[spots] = np.packbits(ones.reshape(len(rows), -1), axis=1, bitorder="little")
    first = np.searchsorted(block, np.arange(n)).astype(np.uint32)
    return {
        "starts": starts[:-1], "first": first, "low": low, "width": width, "packed": packed, "place": place.astype(np.uint8),
        "above": above.astype(np.uint32),
    }


def unpack(parts: dict[str, np.ndarray], blocks: np.ndarray) -> np.ndarray:
    """The ids of the given blocks, 256 each; only these blocks' bytes are touched."""
    out = np.empty((len(blocks), BLOCK), np.uint32)
    width, starts = parts["width"][blocks], parts["starts"][blocks].astype(np.int64)
    for bits in np.unique(width):
        chosen = np.nonzero(width == bits)[0]
        for rows in np.array_split(chosen, 1 + len(chosen) // AT_ONCE):
            if bits and len(rows):
                size = int(bits) * (BLOCK // 8)
                ones = np.unpackbits(parts["packed"][starts[rows][:, None] + np.arange(size)], axis=1, bitorder="little")
                weights = np.uint32(1) << np.arange(bits, dtype=np.uint32)
                out[rows] = (ones.reshape(len(rows), BLOCK, int(bits)) * weights).sum(axis=2, dtype=np.uint32)
            else:
                out[rows] = 0
    ends = np.append(parts["first"][1:], len(parts["place"]))
    begin, count = parts["first"][blocks].astype(np.int64), (ends[blocks].astype(np.int64) - parts["first"][blocks])
    if count.sum():
        row = np.repeat(np.arange(len(blocks)), count)
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        out[row, parts["place"][at]] |= parts["above"][at] << width[row].astype(np.uint32)
    return (out + parts["low"][blocks][:, None]).reshape(-1)


def segment(task: int, number: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    p = pack(ids, percentile)
    body = b"".join([
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.array(lengths, "<u8").tobytes(), p["starts"].astype("<u8").tobytes(), p["first"].astype("<u4").tobytes(),
        p["low"].astype("<u4").tobytes(), p["width"].tobytes(), p["packed"].tobytes(), p["place"].tobytes(), p["above"].astype("<u4").tobytes(),
    ])
    return HEADER.pack(MAGIC, HEADER.size + len(body), task, number, len(doc_ids), len(p["low"]), len(p["place"]), len(ids)) + body


class Segment:
    """A segment read in place: nothing is decoded before ids are asked for."""

    def __init__(self, raw: memoryview):
        magic, self.bytes, self.task, self.number, docs, blocks, exceptions, self.n_ids = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token block file")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, null, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null)]
        self.parts = {"starts": take("<u8", blocks), "first": take("<u4", blocks), "low": take("<u4", blocks), "width": take("u1", blocks)}
        self.parts |= {"packed": take("u1", int(self.parts["width"].sum(dtype=np.int64)) * (BLOCK // 8))}
        self.parts |= {"place": take("u1", exceptions), "above": take("<u4", exceptions)}

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from `start` to before `stop`: through the index, only the blocks they lie in are decoded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        return unpack(self.parts, np.arange(first, last + 1))[start - first * BLOCK:stop - first * BLOCK]


def segments(content: bytes) -> Iterator[Segment]:
    raw = memoryview(content)
    at = 0
    while at < len(raw):
        found = Segment(raw[at:])
        yield found
        at += found.bytes + 1


class WordIds:
    """Ids of texts through their distinct chunks: what stands between blanks or line feeds, across which the file joins nothing.

    Signs behind a letter are chunks of their own, and texts without odd characters are read in lower case, so few chunks are distinct.
    Chunks of Latin characters are cut into words where the file's pattern cuts them, in lower case as its normaliser makes them;
    words are learned from the library many at a call and remembered. Other chunks, and those that may hold a special token's
    string, are encoded by the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(tokens.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Ids of many words: joined by blanks, 500 at a time, and cut after each token that ends a word."""
        some = [words[at:at + 500] for at in range(0, len(words), 500)]
        for group, found in zip(some, self.library.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
            ids = np.asarray(found.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(group):
                raw = ids.tobytes()
                self.known.update(zip(group, [raw[x:y] for x, y in zip([0, *stops], stops)]))
            else:  # not one word each: one by one
                self.known.update((word, self.alone(word)) for word in group)

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """Ids of each text: its distinct chunks are found by Arrow, encoded once, and put in the texts' order again by Arrow."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        odd = pc.match_substring_regex(texts, ODD)
        mixed = pc.any(odd).as_py()
        texts = pc.if_else(odd, texts, pc.ascii_lower(texts)) if mixed else pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?])", r"\1 \2")  # a word always ends there
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = pc.dictionary_encode(cut.flatten())
        n = len(found.dictionary)  # chunks hold no blanks: one string of all of them is cut faster than they are fetched one by one
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), found.dictionary), " ")
        chunk = whole[0].as_py().split(" ") if n else []
        ids = list(map(self.known.get, chunk))  # most chunks are words known by now
        open_ = [i for i, found_ids in enumerate(ids) if found_ids is None]
        words = []
        for c in map(chunk.__getitem__, open_):
            words.append(None if mixed and (UNUSUAL.search(c) or "<|" in c) else [c.lower()] if c.isalpha() else PIECES.findall(c.lower()))
        wanted = {w for ws in words if ws for w in ws}.difference(self.known)
        again = self.older.keys() & wanted
        self.known.update((w, self.older[w]) for w in again)
        new = list(wanted - again)
        for at in range(0, len(new), 20_000):
            self.learn(new[at:at + 20_000])
        known = self.known.__getitem__
        for i, ws in zip(open_, words):
            ids[i] = self.alone(chunk[i]) if ws is None else known(ws[0]) if len(ws) == 1 else b"".join(map(known, ws))
        placed = pa.array(ids, pa.large_binary()).take(found.indices)
        _, bounds, data = placed.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(placed) + 1)[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        raw = memoryview(data) if data is not None else memoryview(b"")
        return [raw[x:y] for x, y in zip(bounds, bounds[1:])]

    def alone(self, chunk: str) -> bytes:
        return np.asarray(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, WordIds] = {}


def write_token_blocks(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Ids of whole texts, each document followed by `end_id`, in files below `path`, in ascending doc_id order.

    The texts are dealt by ranges of doc_id; a task encodes its texts in order and hands each segment to Spark's text writer as a
    row, so files come about under Spark's commit protocol on any file system, and a lost task leaves nothing behind. A document
    is never cut; a segment holds about `segment_ids` ids or one longer document. Null texts are empty (only `end_id`), null
    doc_ids come first, equal ones are ordered by text hash; repeated rows are written each time. An empty table gives no segment.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordIds(tokenizer)
        encoder, task, number = _ENCODERS[tokenizer], TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        doc_ids, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            raw = segment(task, number, doc_ids, lengths, np.frombuffer(b"".join(held), "<u4"), percentile)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["segment"])

        for some in chunks(batches, "text", BLOCK_BYTES):
            texts = pa.concat_arrays([b.column("text") for b in some])
            for doc_id, ids in zip((i for b in some for i in b.column("doc_id").to_pylist()), encoder.encode(texts)):
                doc_ids.append(doc_id), lengths.append(len(ids) // 4 + 1), held.extend((bytes(ids), end))
                size += lengths[-1]
                if size >= segment_ids:
                    yield close()
                    doc_ids, lengths, held, size = [], [], [], 0
                    number += 1
        if doc_ids:
            yield close()

    dealt = ids_and_texts(docs).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = dealt.mapInArrow(released(encode), "segment binary")
    rows.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS_A_FILE).option("lineSep", "\n").text(path)


READ = "task int, number int, doc_id long, at long, n_tokens long, ids_crc32 long"


def read_token_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files below `path`: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, with `with_ids`,
    ids (little-endian unsigned 32-bit, binary). The files are decoded once, where they are read; their totals give the starts."""
    fields = pa.schema([
        ("task", pa.int32()), ("number", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else []),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for s in segments(content.as_py()):
                    raw = memoryview(s.ids().astype("<u4").tobytes())
                    ends = np.cumsum(s.lengths.astype(np.int64))
                    starts = ends - s.lengths.astype(np.int64)
                    pieces = [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                    n = len(pieces)
                    columns = [[s.task] * n, [s.number] * n, s.doc_ids, starts, s.lengths.astype(np.int64), [zlib.crc32(p) for p in pieces]]
                    columns += [[bytes(p) for p in pieces]] if with_ids else []
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialise(files.mapInArrow(released(decode), READ + (", ids binary" if with_ids else "")), "token-rows")
    totals = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("total"))
    return rows.join(_starts(totals), ["task", "number"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []),
    )


def _starts(totals: DataFrame) -> DataFrame:
    """Ids before each segment: running totals inside a writer's partition, after the totals of the partitions before it.

    One row for each partition of the writer is summed in one task; the segments of a partition are summed on their own.
    """
    from pyspark.sql import Window

    totals = materialise(totals, "token-segments")
    parts = totals.groupBy("task").agg(F.sum("total").alias("of_task"))
    earlier = parts.select("task", (F.sum("of_task").over(Window.orderBy("task")) - F.col("of_task")).alias("earlier"))
    inside = F.sum("total").over(Window.partitionBy("task").orderBy("number")) - F.col("total")
    return totals.withColumn("inside", inside).join(earlier, "task").select("task", "number", (F.col("earlier") + F.col("inside")).alias("before"))


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Write all documents to a new folder of the shared one and read the files back."""
    path = scratch_path(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, tokenizer, path, end_id)
    return read_token_blocks(docs.sparkSession, path, with_ids)
