"""Text quality by an interpolated modified Kneser-Ney model of characters, trained on trusted texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktick.llm.common import released
from sparktick.session import materialise

ORDER = 4
BITS = 12  # of a character: code points below 3840 are themselves, others share 256 values
BLOCK_CHARS = 1 << 20
SHARD = 2_000_000  # n-grams of the score table that a task holds at a time
KNOWN_IDS = 2_000_000  # trusted ids up to which they go to the texts, not the texts to them
CHECKED = 5  # one in so many trusted texts is kept from the counts, for the quantiles
LOW, HIGH, SLACK, PRIOR = 0.05, 0.9, 5.0, 50
BEGIN = 1  # a text begins with ORDER - 1 of these


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all characters of the texts, the first characters' reaching before the text; number of each text's)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = chr(BEGIN) * (order - 1)
    raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(raw < 3840, raw, 3840 + raw % 256)
    gram = code[: len(code) - order + 1].copy()
    for i in range(1, order):
        gram = (gram << BITS) | code[i:len(code) - order + 1 + i]
    starts = np.concatenate(([0], np.cumsum(sizes + order - 1)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return gram[at], sizes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in batch.schema.names]):
            for c, v in zip(batch.schema.names, row):
                held.setdefault(c, []).append(v)
            size += len(row[batch.schema.names.index("text")])
            if size >= BLOCK_CHARS:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _by_language(block: dict[str, list]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, lang in enumerate(block["lang"]):
        out.setdefault(lang, []).append(i)
    return out


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): the n-grams of the block's texts, with their number of uses in texts to be counted."""
    for block in _blocks(batches):
        for lang, rows in _by_language(block).items():
            for counted in (True, False):
                gram, _ = grams([block["text"][i] for i in rows if block["counted"][i] == counted], order)
                distinct, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(distinct), pa.string()), pa.array(distinct), pa.array(n if counted else 0 * n, pa.int64())],
                    names=["lang", "gram", "n"],
                )


def _discounted(counts: DataFrame, level: int) -> DataFrame:
    """Counts (lang, gram, n > 0) of n-grams of `level` characters with their context's terms of modified Kneser-Ney smoothing:
    own (the discounted share) and rest (what the context leaves for the lower order)."""
    kinds = counts.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"k{k}") for k in (1, 2, 3, 4)])
    y = F.col("k1") / F.greatest(F.col("k1") + 2 * F.col("k2"), F.lit(1))

    def discount(k: int) -> Column:  # kept between nothing and the count, also where kinds of counts are missing
        d = k - (k + 1) * y * F.col(f"k{k + 1}") / F.greatest(F.col(f"k{k}"), F.lit(1))
        return F.when((F.col(f"k{k}") == 0) | (y == 0), F.lit(0.5)).otherwise(F.least(F.greatest(d, F.lit(0.1)), F.lit(k - 0.1)))

    kinds = kinds.select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    priced = counts.join(kinds, "lang").select("lang", "gram", F.shiftright("gram", BITS).alias("context"), "n", cut.alias("d"))
    context = priced.groupBy("lang", "context").agg(F.sum("n").alias("_n"), F.sum("d").alias("_d"))
    return priced.join(context, ["lang", "context"]).select(
        "lang", "gram", "context", ((F.col("n") - F.col("d")) / F.col("_n")).alias("own"), (F.col("_d") / F.col("_n")).alias("rest"),
    )


def _suffix(gram: Column, level: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS * level) - 1))


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, cost) of every n-gram of the corpus: minus the logarithm of its probability by the trusted counts.

    counts: (lang, gram, n), n = 0 for n-grams that only other texts use. The highest order takes uses, each lower one the number
    of different characters before an n-gram. All tables are joined by language and n-gram, shard by shard; a language without
    trusted texts has no row.
    """
    trusted = counts.filter("n > 0")
    levels = {order: trusted}
    for level in range(order - 1, 0, -1):
        above = levels[level + 1]
        levels[level] = above.groupBy("lang", _suffix(F.col("gram"), level).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    # From single characters up: the probability of each n-gram that is asked for.
    asked = {order: counts.select("lang", "gram").distinct()}
    for level in range(order - 1, 0, -1):
        asked[level] = asked[level + 1].select("lang", _suffix(F.col("gram"), level).alias("gram")).distinct()
    sizes = levels[1].groupBy("lang").agg(F.count(F.lit(1)).alias("_v"))
    below = asked[1].join(sizes, "lang").select("lang", "gram", (1 / (F.col("_v") + 1.0)).alias("p"))
    for level in range(1, order + 1):
        terms = materialise(_discounted(levels[level], level), "quality-terms")
        contexts = terms.select("lang", "context", "rest").distinct()
        wanted = asked[level].withColumn("context", F.shiftright("gram", BITS)).withColumn("_low", _suffix(F.col("gram"), max(1, level - 1)))
        low = below.withColumnRenamed("gram", "_low").withColumnRenamed("p", "_p")
        below = materialise(
            wanted.join(low, ["lang", "_low"]).join(contexts, ["lang", "context"], "left")
            .join(terms.select("lang", "gram", "own"), ["lang", "gram"], "left")
            .select("lang", "gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("_p")).alias("p")),
            "quality-level",
        )
    return below.select("lang", "gram", (-F.log("p")).cast("float").alias("cost"))


def _summed(batches: Iterator[pa.RecordBatch], order: int, shard: int, shards: int, table) -> Iterator[pa.RecordBatch]:
    """Sums of the costs of each text's n-grams that lie in the shard."""
    tables = table.value
    for block in _blocks(batches):
        total, number = np.zeros(len(block["text"])), np.zeros(len(block["text"]), np.int64)
        for lang, rows in _by_language(block).items():
            gram, sizes = grams([block["text"][i] for i in rows], order)
            number[rows] = sizes
            if lang not in tables or not len(gram):
                continue
            known, cost = tables[lang]
            value = cost[np.minimum(np.searchsorted(known, gram), len(known) - 1)]
            if shards > 1:
                value = np.where(gram % shards == shard, value, 0)
            total[rows] = np.bincount(np.repeat(np.arange(len(rows)), sizes), value, len(rows))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block["doc_id"], pa.int64()), pa.array(block["h"], pa.int64()), pa.array(block["lang"], pa.string()),
                pa.array(total), pa.array(number),
            ],
            names=["doc_id", "h", "lang", "cost", "n"],
        )


def summed_costs(docs: DataFrame, scores: DataFrame, order: int = ORDER, shard_size: int = SHARD) -> DataFrame:
    """(doc_id, h, lang, cost, n) for rows (doc_id, h, lang, text): the summed cost of a text's n-grams and their number.

    Tasks hold the score table in shards of at most `shard_size` n-grams; a text's sums over the shards are added.
    """
    spark = docs.sparkSession
    shards = max(1, -(-scores.count() // shard_size))
    every = None
    for shard in range(shards):
        rows = scores.filter(F.pmod("gram", F.lit(shards)) == shard).orderBy("lang", "gram").toArrow()
        lang = rows.column("lang").to_numpy(zero_copy_only=False)
        gram, cost = rows.column("gram").to_numpy(), rows.column("cost").to_numpy()
        tables = {x: (gram[lang == x], cost[lang == x]) for x in np.unique(lang)} if len(lang) else {}
        table = spark.sparkContext.broadcast(tables)
        part = docs.mapInArrow(
            released(lambda b, shard=shard, table=table: _summed(b, order, shard, shards, table)), "doc_id long, h long, lang string, cost double, n long",
        )
        if shards > 1:  # rows that repeat id and text have equal sums
            part = part.groupBy("doc_id", "h", "lang").agg(F.max("cost").alias("cost"), F.max("n").alias("n"))
        every = part if every is None else every.unionByName(part)
    if shards == 1:
        return every
    return every.groupBy("doc_id", "h", "lang").agg(F.sum("cost").alias("cost"), F.max("n").alias("n"))


def quality(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, low: float = LOW, high: float = HIGH, slack: float = SLACK, prior: int = PRIOR,
    shard_size: int = SHARD, known_ids: int = KNOWN_IDS,
) -> DataFrame:
    """Judge whole texts by their perplexity: doc_id, h (hash of the text), lang, n_chars, perplexity, judged, lower, upper, keep.

    An interpolated modified Kneser-Ney model of characters is counted for each language over all texts that labels.quality marks 1,
    but for one in CHECKED, and every n-gram of the corpus gets its cost by joins of the count tables. `judged` is the perplexity with
    `prior` characters of the language's middle cost added, so that a few characters don't decide. A document is kept, if judged lies
    between the language's bounds: the `high` quantile of the trusted texts that were not counted and the `low` one of all trusted
    texts, moved out by `slack` times their distance from the median (of logarithms), and by more where they rest on few texts.

    Null language counts as 'und'; languages without trusted texts have no bounds and are kept. Null and empty texts have no
    perplexity and are not kept. Conflicting labels of one id count as not trusted; null ids are never trusted. Rows that repeat id
    and text are judged alike. Empty tables give no rows.
    """
    trusted = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    trusted = materialise(trusted, "quality-trusted")
    ids = trusted.withColumn("trusted", F.lit(True))
    if trusted.count() <= known_ids:  # 8 bytes each; above that both sides are sent by id
        ids = F.broadcast(ids)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    checked = F.pmod(F.xxhash64("doc_id"), F.lit(CHECKED)) == 0
    marked = texts.join(ids, "doc_id", "left").select("lang", "text", F.coalesce(F.col("trusted") & ~checked, F.lit(False)).alias("counted"))
    counts = materialise(
        marked.mapInArrow(released(lambda b: _counted(b, order)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "quality-counts",
    )
    scores = materialise(gram_scores(counts, order), "quality-scores")
    costs = materialise(
        summed_costs(texts.select("doc_id", "h", "lang", "text"), scores, order, shard_size)
        .dropDuplicates(["doc_id", "h", "lang"]), "quality-costs",
    )
    reference = costs.filter("n > 0").join(trusted, "doc_id", "left_semi").join(scores.select("lang").distinct(), "lang", "left_semi")
    each = F.col("cost") / F.when(F.col("n") > 0, F.col("n"))
    middles = reference.filter(checked).groupBy("lang").agg(F.percentile_approx(each, F.lit(0.5), F.lit(10_000)).alias("middle"))
    eased = (F.col("cost") + F.lit(float(prior)) * F.col("middle")) / (F.col("n") + F.lit(float(prior)))
    marks = reference.join(middles, "lang").select("lang", "middle", eased.alias("eased"), checked.alias("checked"))
    unseen = F.when(F.col("checked"), F.col("eased"))
    wide = F.lit(slack) * (1 + F.lit(20.0) / F.col("_n"))
    bounds = marks.groupBy("lang").agg(
        F.first("middle").alias("middle"), F.count(unseen).alias("_n"),
        F.percentile_approx(unseen, F.array(F.lit(0.5), F.lit(high)), F.lit(10_000)).alias("_up"),
        F.percentile_approx("eased", F.array(F.lit(low), F.lit(0.5)), F.lit(10_000)).alias("_down"),
    )
    bounds = materialise(bounds.select(
        "lang", "middle", (F.col("_down")[0] - wide * (F.col("_down")[1] - F.col("_down")[0])).alias("_low"),
        (F.col("_up")[1] + wide * (F.col("_up")[1] - F.col("_up")[0])).alias("_high"),
    ), "quality-bounds")
    out = costs.join(F.broadcast(bounds), "lang", "left").withColumn("eased", eased)  # one row a language
    return out.select(
        "doc_id", "h", "lang", F.col("n").alias("n_chars"), F.when(F.col("middle").isNotNull(), F.exp(each)).alias("perplexity"),
        F.when(F.col("n") > 0, F.exp("eased")).alias("judged"), F.exp("_low").alias("lower"), F.exp("_high").alias("upper"),
        ((F.col("n") > 0) & F.coalesce(F.col("eased").between(F.col("_low"), F.col("_high")), F.lit(True))).alias("keep"),
    )
