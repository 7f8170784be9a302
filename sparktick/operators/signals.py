"""Signal generators: big moves, random timing, score threshold; validity and rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktick.functions.columns import ratio
from sparktick.functions.keyed import images, joined, shuffle_shifts, uniforms
from sparktick.operators.spread import exact_quantiles
from sparktick.schemas import BAR, BAR_DAY


def signal_rates(signals: DataFrame, series: Sequence[str], spine: DataFrame, sizes: DataFrame) -> DataFrame:
    """(series, day): n_signals, n_bars, rate; `spine` keeps the days without signals."""
    keys = [*series, *BAR_DAY]
    counts = signals.groupBy(*keys).agg(F.count("*").alias("n_signals"))
    n = F.coalesce(F.col("n_signals"), F.lit(0))
    return spine.select(*keys).join(counts, keys, "left").join(sizes, BAR_DAY).select(
        *keys, n.alias("n_signals"), "n_bars", ratio(n, F.col("n_bars")).alias("rate")
    )


def signal_violations(signals: DataFrame, series: Sequence[str], sizes: DataFrame) -> DataFrame:
    """Days whose signals repeat a bar or lie outside the day (must be empty)."""
    per_bar = signals.groupBy(*series, *BAR).agg(F.count("*").alias("_c"))
    days = per_bar.groupBy(*series, *BAR_DAY).agg(
        F.max("_c").alias("_c"), F.min("bar_idx").alias("_a"), F.max("bar_idx").alias("_b")
    )
    bad = (F.col("_c") > 1) | (F.col("_a") < 0) | (F.col("_b") >= F.coalesce(F.col("n_bars"), F.lit(0)))
    return days.join(sizes, BAR_DAY, "left").filter(bad).select(*series, *BAR_DAY)


def train_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of the training days of every fold: `folds(w_snn, test_day, train_day)`."""
    return rows.join(folds.withColumnRenamed("train_day", "day"), "day")


def thresholds(
    rows: DataFrame, folds: DataFrame, value: Column, rates: DataFrame, tags: Sequence[str], fold_keys: Sequence[str] = ()
) -> DataFrame:
    """(1 - rate) quantile of `value` over each fold's training days; one row per target in
    `rates(symbol, num, w_snn, test_day, fold_keys, tags, rate)`. Rate 0 gives no row: such a signal never fires."""
    keys = ["symbol", "num", "w_snn", "test_day", *fold_keys]
    pooled = train_rows(rows.withColumn("_value", value), folds)
    rate = F.least(F.greatest(F.col("rate"), F.lit(0.0)), F.lit(1.0))
    want = rates.filter("rate > 0").withColumn("q", 1.0 - rate)
    return exact_quantiles(pooled, keys, "_value", targets=want, tags=tags, out="threshold").drop("q", "n")


def big_moves(diffs: DataFrame, folds: DataFrame, rates: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Bars of the test day with |d| strictly above the training threshold at the target rate."""
    limit = thresholds(diffs, folds, F.abs("d"), rates, tags).withColumnRenamed("test_day", "day")
    return diffs.join(limit, ["symbol", "num", "day"]).filter(F.abs("d") > F.col("threshold")).select(
        *tags, "w_snn", *BAR, "threshold"
    )


def random_bars(
    reference: DataFrame, series: Sequence[str], reps: int, histories: dict[str, int], delay: int = 1, seed: str = "seed", place: str | None = None,
) -> DataFrame:
    """`reps` random-timing samples per (series, rule, day): n distinct eligible bars, n as in the reference.

    `reference(series, symbol, day, num, n_signals, n_bars)`; eligible bars are history <= t <= n_bars-1-delay. A keyed
    permutation of the eligible bars sends 0, 1, .. n-1 to the sample: a row is made for each drawn bar, none for the others,
    and nothing is shuffled or sorted. The work is done where the reference's rows are: deal them (`dealt`) if they are few.
    With `place`, each bar's place in its sample is a column of that name: the first n places are the sample of size n.
    """
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(h).alias("lo")) for r, h in histories.items()])
    key = ["naive", F.col("rep"), F.col("day"), F.col(seed), F.col("symbol")]
    jobs = reference.filter("n_signals > 0").select(
        *series, *BAR_DAY, "n_signals", "n_bars", F.explode(rules).alias("_rule")
    ).select("*", "_rule.rule", F.col("_rule.lo").cast("long").alias("_lo"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    jobs = jobs.withColumn("_size", (F.col("n_bars") - delay - F.col("_lo")).cast("long")).filter("_size > 0")
    jobs = jobs.withColumn("_n", F.least(F.col("n_signals").cast("long"), F.col("_size"))).withColumn("_shifts", shuffle_shifts(F.col("_size"), *key))
    # One row for a block of the sample: a large sample is made block by block.
    jobs = jobs.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _SAMPLE))))
    kept = [*series, "rule", "rep", *BAR_DAY]
    blocks = jobs.select(*kept, "_lo", "_size", "_n", "_shifts", "_block", joined(*key).alias("_key"))
    schema = T.StructType([blocks.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("bar_idx", place) if c])
    return blocks.mapInArrow(lambda batches: _sampled(batches, kept, place), schema)


_SAMPLE = 4096  # bars of a sample that are drawn together


def _sampled(batches: Iterator[pa.RecordBatch], kept: list[str], place: str | None) -> Iterator[pa.RecordBatch]:
    """The bars of each block of a sample."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_lo", "_size", "_n", "_shifts", "_block", "_key")]
        for i, (low, size, n, shifts, block, key) in enumerate(zip(*columns)):
            places = np.arange(block * _SAMPLE, min(n, (block + 1) * _SAMPLE))
            found = {"bar_idx": low + images(places, size, shifts, key)} | ({place: places} if place else {})
            same = pa.array(np.full(len(places), i))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in kept], *map(pa.array, found.values())], names=[*kept, *found])


def dealt(rows: DataFrame, keys: Sequence[str] = tuple(BAR)) -> DataFrame:
    """Rows dealt to tasks by a hash of `keys`, or one by one without: small tables whose rows make long work are not to be put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def score_signals(
    scored: DataFrame, series: Sequence[str], rate: float | None = None, rates: DataFrame | None = None, score: str = "score"
) -> DataFrame:
    """Score-threshold signal: bars whose score is strictly above the (1 - rate) quantile of the fold's training scores.

    `scored(series, w_snn, test_day, split, symbol, day, num, bar_idx, score)` covers training and test days;
    the threshold uses training rows only. The rate is one number or a column of `rates(series, rate)`.
    Works for any external score table too.
    """
    keys = [*series, "symbol", "num", "w_snn", "test_day"]
    train = scored.filter("split = 'train'")
    if rates is None:
        limit = exact_quantiles(train, keys, score, [1.0 - rate], out="threshold")
    else:
        folds = scored.select(*keys).distinct()
        want = folds.join(rates, list(series)).withColumn("q", 1.0 - F.col("rate"))
        limit = exact_quantiles(train, keys, score, targets=want, out="threshold")
    return scored.join(limit.drop("q", "n"), keys).filter(F.col(score) > F.col("threshold")).select(
        *series, "w_snn", "test_day", "split", *BAR, score, "threshold"
    )


def input_score(inputs: DataFrame) -> DataFrame:
    """Score = p1 + p2. Rounded far below its scale: both channels often sum to a constant, and rounding noise
    must not decide a strict comparison."""
    return inputs.withColumn("score", F.round(F.col("p1") + F.col("p2"), 9))


def encoded_score(inputs: DataFrame, ticks: int, seed: Column | int) -> DataFrame:
    """Score of seeded inputs: spikes of both channels over `ticks` Bernoulli draws (those of `normalise.encode`), plus a keyed tie break; also
    the counts themselves as spikes_1 and spikes_2.

    Spike counts repeat, so a threshold on them alone would miss its target rate by whole classes of equal counts. The tie break
    below one orders bars of equal counts by a draw, and a quantile of the sum then cuts the training bars at the target rate to
    within one bar. Draws are summed where the bar is, no row is made for a tick. They cost far more than anything else that is done
    with a bar: deal the rows (`dealt`) before, and write the table before it is read more than once.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    key = (seed, F.col("split"), F.col("symbol"), F.col("day"))
    rows = inputs.withColumns({
        "_draws": joined(*key, 0, F.col("bar_idx")), "_tie": joined("tie", *key, F.col("bar_idx")), "_p1": F.col("p1").cast("double"), "_p2": F.col("p2").cast("double"),
    })
    more = [T.StructField("spikes_1", T.IntegerType()), T.StructField("spikes_2", T.IntegerType()), T.StructField("score", T.DoubleType())]
    kept = inputs.columns
    return rows.mapInArrow(lambda batches: _counted(batches, kept, ticks), T.StructType([*inputs.schema.fields, *more]))


def _counted(batches: Iterator[pa.RecordBatch], kept: list[str], ticks: int) -> Iterator[pa.RecordBatch]:
    """Spikes and scores; a bar's draws are made once for all its rows of a batch, since folds share them."""
    for batch in batches:
        bars = batch.column("_draws").dictionary_encode()
        at = bars.indices.to_numpy()
        heads = [t.encode() + b"|" for t in bars.dictionary.to_pylist()]
        spikes = []
        for i in (1, 2):
            tails = [b"%d|%d" % (t, i) for t in range(ticks)]
            draws = uniforms(heads, tails).reshape(len(heads), ticks)
            p = batch.column(f"_p{i}")
            known = p.is_valid().to_numpy(zero_copy_only=False)
            value = p.fill_null(0.0).to_numpy(zero_copy_only=False)
            value = np.where(np.isnan(value), np.inf, value)  # SQL's order: above all numbers
            spikes.append((np.sum(draws[at] < value[:, None], axis=1, dtype=np.int32), known))
        ties = batch.column("_tie").dictionary_encode()
        tie = uniforms(t.encode() for t in ties.dictionary.to_pylist())[ties.indices.to_numpy()]
        (one, known_1), (two, known_2) = spikes
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(one, mask=~known_1), pa.array(two, mask=~known_2), pa.array(one + two + tie, mask=~(known_1 & known_2))],
            names=[*kept, "spikes_1", "spikes_2", "score"],
        )


def with_seeds(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return rows.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def rate_grid(rates: Sequence[float], days: DataFrame) -> DataFrame:
    """Targets for an accuracy-vs-rate curve: every fold day with every target rate."""
    return days.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
