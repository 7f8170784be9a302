"""Toxicity scores of text restored by a noisy-channel decoder."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import chunks, ids_and_texts, released
from sparktick.session import materialise

SAMPLE = 5000  # labelled rows that the word weights are fitted on, at most
HELD_OUT = 2  # remainder of crc32(doc_id) by 4 that is never learned from

# What a character may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "€": "e", "(": "c", "<": "c",
}
# Costs in nats of what the writer may have done.
SWAP = 0.5  # a look-alike for a letter
NOISE, LAST_NOISE, MARK = 9.0, 2.0, 0.5  # a look-alike in or behind a word that means nothing; any other sign
DROPPED, REPEATED = 7.0, 1.5  # two equal letters for one; three and more for one or two

# Letters of the character model: lower-case Latin ones; all else is a gap.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x180)) if c.isalpha() and c == c.lower())
CODE = np.zeros(1 << 16, np.uint8)
for _i, _c in enumerate(SYMBOLS, 1):
    CODE[ord(_c)] = _i
K = len(SYMBOLS) + 1


# ---- character language model ---------------------------------------------------------------------------------------------------


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter trigrams with gaps around words, of all text of the task."""
    counts = np.zeros(K**3, np.int64)
    for held in chunks(batches, "text", 1 << 20):
        text = " ".join([t.as_py() for b in held for t in b.column("text")])
        raw = np.frombuffer(f" {text} ".lower().encode("utf-16-le", "surrogatepass"), np.uint16)
        c = CODE[raw]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)  # one gap between words
        c = c[keep].astype(np.int64)
        if len(c) > 1:
            c = np.concatenate([c[:1], c])
            counts += np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])


class CharModel:
    """Letter trigrams with linear interpolation; a gap ends a word. At most K^3 counts, whatever the corpus."""

    def __init__(self, counts: dict[int, int]):
        tri = np.zeros(K**3)
        for g, n in counts.items():
            tri[g] = n
        tri = tri.reshape(K, K, K)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + K)
        p2 = (bi + 5 * p1[None]) / (bi.sum(axis=1, keepdims=True) + 5)
        self.cost = -np.log((tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)).astype(np.float32)

    def step(self, a: int, b: int, c: int) -> float:
        return float(self.cost[a, b, c])


def arcs(token: str) -> list[tuple[int, list[tuple[str, float]]]]:
    """The lattice of a lower-case token: (length of a run of one character, [(what it stands for, cost)]) in order."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        options: list[tuple[str, float]] = []
        if ord(c) < 1 << 16 and CODE[ord(c)]:
            if n == 1:
                options.append((c, 0.0))
            elif n == 2:
                options.extend([(c + c, 0.0), (c, DROPPED)])
            else:
                options.extend([(c, REPEATED), (c + c, REPEATED)])
        else:
            like = LEET.get(c, "")
            options.extend((x * k, SWAP * k) for x in like for k in range(1, min(n, 2) + 1))
            options.append(("", MARK if n > 1 or not like else LAST_NOISE if m.end() == len(token) else NOISE))
        out.append((n, options))
    return out


def restore(token: str, model: CharModel) -> str:
    """Viterbi decoding of a token: the letters most likely to have been meant. A token without letters stays as it is."""
    if not any(c.isalpha() for c in token):
        return token
    lattice = arcs(token.lower())
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for _, options in lattice:
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for letters, price in options:
                x, y, total = a, b, cost + price
                for c in letters:
                    code = int(CODE[ord(c)])
                    total += model.step(x, y, code)
                    x, y = y, code
                held = new.get((x, y))
                if held is None or total < held[0]:
                    new[x, y] = (total, text + letters)
        states = new
    best = min((cost + model.step(a, b, 0), text) for (a, b), (cost, text) in states.items())[1] if lattice else ""
    return best or token


def word_starts(run: str, model: CharModel) -> list[int]:
    """Where the words of a run of single characters begin: Viterbi decoding of its letters with a gap or none before each."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # (cost, linked list of starts)
    for i, c in enumerate(run.lower()):
        options = arcs(c + "\0" * (i + 1 < len(run)))[0][1]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        gap = [(b, 0, cost + model.step(a, b, 0), (i, starts)) for (a, b), (cost, starts) in states.items() if b]
        for a, b, cost, starts in [*((a, b, *held) for (a, b), held in states.items()), *gap]:
            for letters, price in options:
                x, y, total = a, b, cost + price
                for letter in letters:
                    code = int(CODE[ord(letter)])
                    total += model.step(x, y, code)
                    x, y = y, code
                held = new.get((x, y))
                if held is None or total < held[0]:
                    new[x, y] = (total, starts)
        states = new
    best = min(((cost + model.step(a, b, 0), starts) for (a, b), (cost, starts) in states.items()), key=lambda e: e[0])[1]
    found = [0]
    while best:
        found.append(best[0])
        best = best[1]
    return sorted(set(found))


_EDGES = ".,;:!?*&%#$|\"'()[]"
_SKELETON = {ord(k): v[0] for k, v in LEET.items()} | {ord("l"): "i"}
_RUNS = re.compile(r"(.)\1+", re.S)
_CUTS = re.compile(r"[.,;:!?/|*&%#\"()\[\]]+")
# At least three single characters with one blank between them.
SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?=[.,;:!?]*(?!\S))")


def skeletons(token: str) -> set[str]:
    """What is left of a token when each look-alike is taken for its letter or for noise, other signs for noise, and runs for one.

    Any word that `restore` can give has its skeleton among those of the token, so others need no decoding. Of more than six
    look-alikes those behind the sixth are taken for letters.
    """
    low = token.lower()
    if low.isalpha():
        return {_RUNS.sub(r"\1", low.replace("l", "i"))}
    forms, choices = [""], 0
    for c in _RUNS.sub(r"\1", low):
        letter = _SKELETON.get(ord(c), c)
        if c.isalpha():
            forms = [f + letter for f in forms]
        elif letter.isalpha():
            choices += 1
            forms = [f + x for f in forms for x in ((letter, "") if choices <= 6 else (letter,))]
    return {_RUNS.sub(r"\1", f) for f in forms}


def beginning(run: str, start: int) -> str:
    """The run from `start` on, as far as the beginning of a word can lie: 3 * STEMS[-1] changes of letters and look-alikes, and all
    repeats and other signs among them."""
    left, before = 3 * STEMS[-1], ""
    for end in range(start, len(run)):
        c = run[end].lower()
        if c != before and _SKELETON.get(ord(c), c).isalpha():
            if not left:
                return run[start:end]
            left -= 1
        before = c
    return run[start:]


LEAST_GAIN = 15.0  # nats that a feature must save in telling the labels: above the logarithm of the number of features
STEMS = range(3, 9)  # lengths of word beginnings that may be weighted, besides whole words


def stem_features(word: str) -> list[str]:
    """The whole word, marked by a gap behind it, and its beginnings."""
    return [word + " ", *[word[:k] for k in STEMS if k <= len(word)]]


@dataclass
class Detector:
    """Finds weighted words and word beginnings in text, as written or restored.

    weights: for each of them the share of toxic documents among those with one, two, and more uses. totals: the same for uses of
    all of them together, from no use on, among documents in which no single one tells.
    """

    weights: dict[str, tuple[float, float, float]]
    model: CharModel
    totals: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    known: dict[str, str | None] = field(default_factory=dict)
    bones: set[str] = field(default_factory=set)
    lengths: list[int] = field(default_factory=list)

    def __post_init__(self):
        for w in self.weights:
            self.bones.update(s + " " * w.endswith(" ") for s in skeletons(w))
        self.lengths = sorted({len(w) for w in self.weights if not w.endswith(" ")})

    def plain(self, word: str) -> str | None:
        """The weighted word or beginning of a lower-case word as it stands."""
        if word + " " in self.weights:
            return word + " "
        return next((word[:k] for k in self.lengths if word[:k] in self.weights), None)

    def hidden(self, part: str) -> str | None:
        """The same of what a token is decoded to; decoding is left out where no skeleton fits."""
        for s in skeletons(part):
            if s + " " in self.bones or any(s[:k] in self.bones for k in range(1, min(len(s), STEMS[-1]) + 1)):
                return self.plain(restore(part.lower(), self.model))
        return None

    def meant(self, token: str) -> str | None:
        """The weighted word or beginning that a token stands for."""
        if len(self.known) > 200_000:
            self.known.clear()
        low = token.lower()
        core = low.strip(_EDGES)
        found = self.plain(core)
        bare = low.strip(".,;:?")
        if found is None and not (bare.isalpha() and not _RUNS.search(bare)):
            parts = dict.fromkeys([token, core, *_CUTS.split(token)])
            found = next((f for f in (self.hidden(p) for p in parts if p) if f), None)
        self.known[token] = found
        return found

    def uses(self, text: str) -> dict[str, int]:
        """Number of uses of each weighted word or beginning."""
        tokens = text.split()
        found: dict[str, int] = {}
        for token in set(tokens):
            word = self.known[token] if token in self.known else self.meant(token)
            if word:
                found[word] = found.get(word, 0) + tokens.count(token)
        for m in SPACED.finditer(text):
            run = m[0].replace(" ", "")
            for i in range(len(run)):
                for j in range(i + 3, min(len(run), i + 24) + 1):
                    word = self.hidden(run[i:j])
                    if word and word.endswith(" "):
                        found[word] = found.get(word, 0) + 1
            for i in word_starts(run, self.model) if self.lengths else ():
                word = self.hidden(beginning(run, i))
                if word and not word.endswith(" "):
                    found[word] = found.get(word, 0) + 1
        return found

    def strength(self, uses: dict[str, int]) -> float:
        """Chance that some of the words tell by themselves."""
        return 1 - math.prod(1 - self.weights[w][min(n, 3) - 1] for w, n in uses.items())

    def score(self, uses: dict[str, int]) -> float:
        return min(1.0, max(self.strength(uses), self.totals[min(3, sum(uses.values()))]))


# ---- fitting --------------------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def _first_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document and feature: how often it is used (3: more than twice), the word before its first use, and the label."""
    import xxhash

    for batch in batches:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = [t.strip(_EDGES) for t in text.lower().split()]
            counts: dict[str, int] = {}
            first: dict[str, str] = {}
            for word, before in zip(words, ["", *words]):
                if word.isalpha():
                    for f in stem_features(word):
                        counts[f] = counts.get(f, 0) + 1
                        first.setdefault(f, before)
            for f, n in counts.items():
                rows[0].append(f)
                rows[1].append(min(n, 3))
                rows[2].append(xxhash.xxh32_intdigest(first[f]))
                rows[3].append(toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32())],
            names=["word", "uses", "before", "toxic"],
        )


def _weights(sample: DataFrame, n: int, toxic: int) -> dict[str, tuple[float, float, float]]:
    """Weights of words and beginnings that tell toxic documents.

    Uses behind the same word count once, so copies of a document don't add up, and a document counts once for each feature. At
    least `least` toxic uses are asked for, and more than chance gives: that bounds the list by words / least. Of features of which
    one begins another, the one that tells most stays, the longest of equals.
    """
    base, least = toxic / n, max(3.0, 0.01 * toxic)
    each = (
        sample.select("text", "toxic").mapInArrow(released(_first_uses), "word string, uses int, before long, toxic int")
        .groupBy("word", "uses", "before").agg(F.avg("toxic").alias("share"))
    )
    bins = [c for k in (1, 2, 3) for c in (
        F.sum(F.when(F.col("uses") == k, F.col("share"))).alias(f"t{k}"), F.count(F.when(F.col("uses") == k, F.lit(1))).alias(f"n{k}"),
    )]
    sums = each.groupBy("word").agg(F.sum("share").alias("t"), F.count(F.lit(1)).alias("n"), *bins)
    z, p = 2.6, F.col("t") / F.col("n")
    likely = sums.filter((F.col("t") >= least) & (p - z * F.sqrt(F.lit(base * (1 - base)) / F.col("n")) > 1.5 * base)).collect()

    def entropy(t: float, m: float) -> float:
        q = t / m if m else 0.0
        return -m * (q * math.log(q) + (1 - q) * math.log(1 - q)) if 0 < q < 1 else 0.0

    def told(r) -> float:
        rest = entropy(max(0.0, toxic - r["t"]), max(1.0, n - r["n"]))
        return entropy(toxic, n) - rest - sum(entropy(r[f"t{k}"] or 0.0, r[f"n{k}"]) for k in (1, 2, 3))

    chosen: dict[str, tuple[float, float, float]] = {}
    for r in sorted(likely, key=lambda r: (-round(told(r), 6), -len(r["word"]), r["word"])):
        w = r["word"]
        if told(r) < LEAST_GAIN or any(w.startswith(c) or c.startswith(w) for c in chosen):
            continue
        chosen[w] = tuple(((r[f"t{k}"] or 0.0) + base / 4) / (r[f"n{k}"] + 1) for k in (1, 2, 3))
    return chosen


def _forgetting(batches: Iterator[pa.RecordBatch], detector: Detector) -> Iterator[pa.RecordBatch]:
    """A task's batches; what it remembers of tokens ends with it, since workers live on."""
    yield from batches
    detector.known.clear()


def _counted(batches: Iterator[pa.RecordBatch], detector) -> Iterator[pa.RecordBatch]:
    d: Detector = detector.value
    for batch in _forgetting(batches, d):
        uses = [d.uses(t) for t in batch.column("text").to_pylist()]
        total = [min(3, sum(u.values())) for u in uses]
        weak = [d.strength(u) < 0.5 for u in uses]
        yield pa.RecordBatch.from_arrays(
            [pa.array(total, pa.int64()), pa.array(weak, pa.bool_()), batch.column("toxic")], names=["total", "weak", "toxic"],
        )


def fit_detector(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Detector:
    """Character model of all texts; word weights of at most `sample` labelled rows outside the held-out ones."""
    spark = docs.sparkSession
    texts = ids_and_texts(docs)
    counts = texts.select("text").mapInArrow(released(_trigrams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = materialise(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")  # at most `sample` ids
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    detector = Detector(_weights(rows, n, toxic) if toxic else {}, CharModel({r["gram"]: r["n"] for r in counts}))
    if toxic:
        shared = spark.sparkContext.broadcast(detector)
        seen = (
            rows.mapInArrow(released(lambda b: _counted(b, shared)), "total long, weak boolean, toxic int").filter("weak")
            .groupBy("total").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()
        )
        by = {r["total"]: (r["t"], r["n"]) for r in seen}
        rates = [(by.get(k, (0, 0))[0] + toxic / n / 4) / (by.get(k, (0, 0))[1] + 1) for k in range(4)]
        detector.totals = tuple(max(rates[: k + 1]) for k in range(4))
    return detector


def _scored(batches: Iterator[pa.RecordBatch], detector) -> Iterator[pa.RecordBatch]:
    d: Detector = detector.value
    for batch in _forgetting(batches, d):
        found = [d.uses(t) for t in batch.column("_read").to_pylist()]
        keep = [c for c in batch.schema.names if c != "_read"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep]
            + [pa.array([d.score(u) for u in found], pa.float64()), pa.array([sorted(w.strip() for w in u) for u in found], pa.list_(pa.string()))],
            names=[*keep, "score", "words"],
        )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, carried: Sequence[str] = ()) -> DataFrame:
    """Score whole texts for toxicity: doc_id, held_out, score, predicted (1 from `threshold` on), the words found, and the
    `carried` columns of `docs` as they are.

    Tokens are read as lattices: a character may be itself, a letter it looks like, one of a run that stands for one or two, or
    noise; single characters with blanks between them are one token, in which whole words may lie anywhere and word beginnings at its
    start and where the best path begins a word. The best path under the character trigram model of the corpus
    is the word meant. A document's score joins the weights of the words and word beginnings found, by their number of uses; without
    any it is the share of toxic documents among those without. Tokens are decoded once for each task's memory of them.

    Labels are learned from rows outside the held-out ones (crc32 of doc_id by 4 is not 2), at most `sample` of them, by a hash of
    the id; labels, language, source and id are not inputs of a score. Conflicting labels of one id count as toxic; null labels
    and ids take no part. Null and empty texts have no words. Without toxic rows all scores are 0. Empty tables give no rows;
    repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_detector(docs, labels, sample))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_read"),
        *[F.col(c) for c in carried if c not in ("doc_id",)],
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "_read")
    scored = texts.mapInArrow(released(lambda b: _scored(b, shared)), schema + ", score double, words array<string>")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "words",
        *[c for c in carried if c not in ("doc_id",)],
    )
