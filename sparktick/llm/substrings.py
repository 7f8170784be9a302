"""Removal of long word sequences that occur earlier, by suffix automata over shards of repeated passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import chunks, released
from sparktick.session import materialise

WINDOW = 20
ANCHOR = 8  # words of an anchor; a window's anchor is that of its anchors with the smallest hash, the leftmost of equal ones
BLOCK_BYTES = 8 << 20
MOST_HOT = 1_000_000  # anchors that may be named hot
LEAST_HOT = 4096  # places below which no anchor is hot
NO_ID = -(2**63)


class SuffixAutomaton:
    """Automaton of all factors of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # known already: only split off the state, if it is too long
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, w, q)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w: bytes, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matching_statistics(self, words: list[bytes]) -> list[int]:
        """For each place the length of the longest factor that ends there."""
        out, state, n = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            else:
                state, n = 0, 0
            out.append(n)
        return out


def matched_spans(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans (start, end) covered by matches of at least `least`."""
    spans: list[tuple[int, int]] = []
    for end, n in enumerate(statistics, 1):
        if n >= least:
            if spans and end - n <= spans[-1][1]:
                spans[-1] = (min(spans[-1][0], end - n), end)
            else:
                spans.append((end - n, end))
    return spans


# ---- windows and their anchors --------------------------------------------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()  # of the task at hand


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Segments:
    """Runs of consecutive windows of one document that have the same anchor at the same place."""

    doc: np.ndarray  # index of the document
    anchor: np.ndarray  # hash of the anchor
    first: np.ndarray  # first word of the first window
    end: np.ndarray  # behind the last word of the last window


def segments(words: list[list[bytes]], window: int, width: int) -> Segments:
    """Each window of each document is in just one segment, and equal windows have equal anchors at the same place inside."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    long = np.flatnonzero(sizes >= window)
    empty = np.zeros(0, np.int64)
    if not len(long):
        return Segments(empty, empty.view(np.uint64), empty, empty)
    value = _HASHES.__getitem__
    flat = np.concatenate([np.fromiter(map(value, words[i]), np.uint64, len(words[i])) for i in long])
    n = len(flat) - width + 1
    grams = np.zeros(n, np.uint64)
    for i in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + flat[i:i + n]
    grams = _mixed(grams)
    # Place of the leftmost smallest gram in each run of `reach`, by doubling.
    reach = window - width + 1
    at, span = np.arange(n), 1

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(grams[left] <= grams[right], left, right)

    while 2 * span <= reach:
        at = joined(at[: len(at) - span], at[span:])
        span *= 2
    if span < reach:
        at = joined(at[: len(at) - (reach - span)], at[reach - span:])
    ends = np.cumsum(sizes[long])
    begins = ends - sizes[long]
    valid = np.ones(len(at), bool)
    for e in ends[:-1]:
        valid[e - window + 1:e] = False
    start = np.flatnonzero(valid)
    at = at[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    cuts = np.flatnonzero(new)
    first, last = start[cuts], start[np.append(cuts[1:], len(start)) - 1]
    owner = np.searchsorted(ends, first, side="right")
    return Segments(long[owner], grams[at[cuts]], first - begins[owner], last + window - begins[owner])


def _texts(held: list[pa.RecordBatch]) -> list[list[bytes]]:
    return [(t.as_py() or "").encode().split() for b in held for t in b.column("text")]


def _column(held: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in held])


ANCHORS = "route long, anchor long, id long, tie long, places long"


def _anchors(batches: Iterator[pa.RecordBatch], window: int, width: int) -> Iterator[pa.RecordBatch]:
    """Anchors of a block's documents. Those at several places of the block are known to repeat: their rows only pass through
    the exchange, and one row without an id stands for the block there, so that an anchor has at most one row from each block."""
    for held in chunks(batches, "text", BLOCK_BYTES):
        ids, ties = _column(held, "id"), _column(held, "tie")
        found = segments(_texts(held), window, width)
        if not len(found.doc):
            continue
        anchors, inverse, counts = np.unique(found.anchor, return_inverse=True, return_counts=True)
        several = counts[inverse] > 1
        once, pairs = ~several, np.divmod(np.unique(found.doc[several] * len(anchors) + inverse[several]), len(anchors))
        own, many = found.doc[once], np.flatnonzero(counts > 1)
        single, shared, stand = found.anchor[once].view(np.int64), anchors[pairs[1]].view(np.int64), anchors[many].view(np.int64)
        passing = _mixed(np.arange(len(shared), dtype=np.uint64) ^ shared.view(np.uint64)).view(np.int64)
        none = np.full(len(stand), NO_ID)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([single, passing, stand])), pa.array(np.concatenate([single, shared, stand])),
                pa.array(np.concatenate([ids[own], ids[pairs[0]], none])),
                pa.array(np.concatenate([ties[own], ties[pairs[0]], np.zeros(len(stand), np.int64)])),
                pa.array(np.concatenate([np.ones(len(single), np.int64), np.zeros(len(shared), np.int64), counts[many]])),
            ],
            names=["route", "anchor", "id", "tie", "places"],
        )
    _HASHES.clear()


def _repeated(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by route: (id, tie, anchor) of anchors at several places; also the number of places of those above `hot`."""
    carry: list[np.ndarray] | None = None
    names = ["route", "anchor", "id", "tie", "places"]

    def out(route, anchor, ids, tie, places) -> pa.RecordBatch:
        passed = places == 0
        a, i, t, n = anchor[~passed], ids[~passed], tie[~passed], places[~passed]
        value, inverse = np.unique(a, return_inverse=True)
        total = np.bincount(inverse, n, len(value)).astype(np.int64)
        again = (total[inverse] > 1) & (i != NO_ID)
        many = np.flatnonzero(total > hot)
        z = np.zeros(len(many), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[passed], i[again], z])), pa.array(np.concatenate([tie[passed], t[again], z])),
                pa.array(np.concatenate([anchor[passed], a[again], value[many]])),
                pa.array(np.concatenate([np.zeros(passed.sum() + again.sum(), np.int64), total[many]])),
            ],
            names=["id", "tie", "anchor", "places"],
        )

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(now[0]):
            continue
        if carry is not None:
            now = [np.concatenate(x) for x in zip(carry, now)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # rows of the last route may go on
        carry = [x[cut:] for x in now]
        if cut:
            yield out(*[x[:cut] for x in now])
    if carry is not None:
        yield out(*carry)


# ---- passages to shards, and back -----------------------------------------------------------------------------------------------

PASSAGES = "route long, shard long, id long, tie long, first long, size long, words binary"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passages(batches: Iterator[pa.RecordBatch], window: int, width: int, hot) -> Iterator[pa.RecordBatch]:
    """Segments with repeated anchors. One that equals an earlier one of the block is to be removed whole and only passes through;
    of a hot anchor each window is a passage and a shard key of its own."""
    crowded = hot.value
    for held in chunks(batches, "text", BLOCK_BYTES):
        ids, ties = _column(held, "id"), _column(held, "tie")
        words = _texts(held)
        repeated = [np.array(v.as_py(), np.int64).view(np.uint64) for b in held for v in b.column("anchors")]
        order = np.lexsort((ties, ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found = segments(words, window, width)
        by_doc = np.argsort(rank[found.doc], kind="stable")
        seen: set[tuple[int, bytes]] = set()
        rows: list[tuple] = []
        docs = found.doc[by_doc]
        bounds = np.flatnonzero(np.diff(docs, prepend=-1)).tolist() + [len(docs)]
        for lo, hi in zip(bounds, bounds[1:]):
            part = by_doc[lo:hi]
            d = int(docs[lo])
            part = part[np.isin(found.anchor[part], repeated[d])]
            known: list[tuple[int, int]] = []
            i, t, own = int(ids[d]), int(ties[d]), words[d]
            for anchor, first, end in zip(found.anchor[part].tolist(), found.first[part].tolist(), found.end[part].tolist()):
                for a, b in [(first, end)] if anchor not in crowded else [(s, s + window) for s in range(first, end - window + 1)]:
                    passage = b" ".join(own[a:b])
                    shard = xxhash.xxh64_intdigest(passage, 1) if anchor in crowded else anchor
                    if (shard, passage) in seen:
                        known.append((a, b))
                    else:
                        seen.add((shard, passage))
                        rows.append((shard, shard, i, t, a, b - a, passage))
            rows.extend((xxhash.xxh64_intdigest(f"{i} {a}"), 0, i, t, a, b - a, None) for a, b in _merged(known))
        if rows:
            route, shard, i, t, a, n, passage = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(route, np.uint64).view(np.int64)), pa.array(np.array(shard, np.uint64).view(np.int64)),
                    *[pa.array(x, pa.int64()) for x in (i, t, a, n)], pa.array(passage, pa.binary()),
                ],
                names=["route", "shard", "id", "tie", "first", "size", "words"],
            )
    _HASHES.clear()


def _earlier(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and place in the table. Each passage is streamed through the automaton of the shard's earlier passages,
    then added to it. Gives the spans to remove."""
    shard, tree, whole, waiting = None, None, set(), None
    for batch in batches:
        spans: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("shard", "id", "tie", "first", "size", "words")]
        for s, i, t, first, size, passage in zip(*columns):
            if passage is None:
                spans.append((i, t, first, first + size))
                continue
            if s != shard:
                shard, tree, whole, waiting = s, None, {passage}, passage
                continue
            if passage in whole:
                spans.append((i, t, first, first + size))
                continue
            if tree is None:
                tree = SuffixAutomaton()
            if waiting is not None:
                tree.add(waiting.split(b" "))
            spans.extend(
                (i, t, first + a, first + b) for a, b in matched_spans(tree.matching_statistics(passage.split(b" ")), window)
            )
            whole.add(passage)
            waiting = passage
        if spans:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*spans)], names=["id", "tie", "first", "end"])


def _kept(batches: Iterator[pa.RecordBatch], window: int, text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("text", "spans", "copied")]
        for value, spans, copied in zip(*columns):
            words = (value or "").encode().split()
            n = len(words)
            if copied and n >= window:
                spans = [{"first": 0, "end": n}]
            cuts = _merged([(s["first"], s["end"]) for s in spans or []])
            kept, last = [], 0
            for a, b in [*cuts, (n, n)]:
                kept.extend(words[last:a])
                last = b
            line = b" ".join(kept)
            whole = value if not cuts else line.decode()
            rows.append((n, n - len(kept), hashlib.sha256(line).hexdigest(), whole if text else None))
        n, removed, digest, whole = zip(*rows) if rows else ((), (), (), ())
        keep = [c for c in batch.schema.names if c not in ("text", "spans", "copied")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep]
            + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(whole, pa.string())],
            names=[*keep, "n_words", "n_removed", "kept_sha256", "kept"],
        )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, width: int = ANCHOR, text: bool = True, carried: tuple[str, ...] = (), hot: int = LEAST_HOT,
) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier: in a smaller doc_id or before in the text.

    Returns doc_id, the `carried` columns, n_words, n_removed, kept_sha256 (of the kept words joined by a blank) and with `text`
    also `kept`: the text itself where nothing is removed, else the kept words joined by blanks. Windows are judged on the input.

    Every window belongs to its anchor, a run of `width` words chosen by content alone, so equal windows have equal anchors.
    Anchors at one place only are dropped first. The passages around an anchor are a shard: each is streamed through the suffix
    automaton of the shard's earlier passages and the spans that reach the length are removed. The automaton is built in the task
    that holds the shard, and passages are sent there; sending every automaton to every text would grow with the square of the
    corpus. Copies of a passage meet in the block of texts that a task holds, so a shard gets one row at most from each block; an
    anchor with very many places is split by whole windows. Copies of a whole text are told by its hash and never searched.

    Null texts have no words, a null doc_id comes before all others. Rows of one doc_id are ordered by a hash of the text; rows that
    repeat both are one document and are kept or removed alike. Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(
        "doc_id", *carried, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID + 1)).alias("id"),
        F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), "text").alias("_g"),
    )
    keys = materialise(texts.groupBy("id", "_h", "_g").agg(F.count(F.lit(1)).alias("rows")), "repeat-keys")
    again = bool(keys.filter("rows > 1").limit(1).count())  # rows that repeat id and text are searched once
    unique = not keys.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    tie = F.coalesce(F.pmod("id", F.lit(1)), F.lit(0)) if unique else F.col("_h")  # never null, nor known to be 0 by the planner
    place = F.struct(F.col("id"), tie.alias("tie"))
    firsts = keys.groupBy("_h", "_g").agg(F.min(place).alias("_first"))
    copies = materialise(
        keys.join(firsts, ["_h", "_g"]).filter(F.col("_first") != place).select("id", tie.alias("tie"), F.lit(True).alias("copied")),
        "repeat-copies",
    )
    texts = texts.withColumn("tie", tie).drop("_h", "_g")

    def once(df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["id", "tie"]) if again else df

    bare = once(texts).select("id", "tie", F.coalesce("text", F.lit("")).alias("text"))
    anchors = (
        bare.mapInArrow(released(lambda batches: _anchors(batches, window, width)), ANCHORS)
        .repartition("route").sortWithinPartitions("route").mapInArrow(released(lambda batches: _repeated(batches, hot)), "id long, tie long, anchor long, places long")
    )
    repeated = materialise(anchors, "repeat-anchors")
    total = repeated.agg(F.sum("places")).first()[0] or 0
    least = max(hot, total // MOST_HOT)  # so at most MOST_HOT anchors are hot
    crowded = [r["anchor"] % (1 << 64) for r in repeated.filter(F.col("places") > least).select("anchor").collect()]
    crowd = spark.sparkContext.broadcast(frozenset(crowded))

    wanted = (
        repeated.filter(F.col("places") == 0).groupBy("id", "tie").agg(F.collect_list("anchor").alias("anchors"))
        .join(copies, ["id", "tie"], "left_anti")
    )
    # All columns go both ways, so that the texts move once and the exchange is used twice.
    source = texts.repartition("id", "tie")
    spans = (
        once(source).join(wanted, ["id", "tie"])
        .mapInArrow(released(lambda batches: _passages(batches, window, width, crowd)), PASSAGES)
        .repartition("route").sortWithinPartitions("shard", "id", "tie", "first").drop("route")
        .mapInArrow(released(lambda batches: _earlier(batches, window)), "id long, tie long, first long, end long")
        .groupBy("id", "tie").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    )
    joined = source.join(spans, ["id", "tie"], "left").join(copies, ["id", "tie"], "left").drop("id", "tie")
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "spans", "copied")]
        + ["n_words long, n_removed long, kept_sha256 string, kept string"]
    )
    out = joined.mapInArrow(released(lambda batches: _kept(batches, window, text)), schema)
    return out if text else out.drop("kept")
