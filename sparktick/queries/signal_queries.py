"""Signal generators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktick.operators import bars as B
from sparktick.operators import labels as L
from sparktick.operators import normalise as N
from sparktick.operators import signals as G
from sparktick.queries import common as C
from sparktick.queries import inputs as NQ
from sparktick.queries import sql as S
from sparktick.queries.registry import query, r, rs
from sparktick.schemas import BAR, BAR_DAY
from sparktick.session import materialise

_B = "symbol, day, num, bar_idx"
RATE = 0.1

# A reference signal with a different rate every day: bars whose move is above 60.
_REF = """ref AS (SELECT f.w_snn, f.test_day, d.symbol, d.num, max(d.n) AS n_bars, count(*) FILTER (abs(d.d) > 60) AS n_signals
  FROM (SELECT DISTINCT w_snn, test_day FROM folds) f JOIN dd d ON d.day = f.test_day GROUP BY ALL)"""


def _reference(spark, d, folds):
    sizes = B.day_sizes(d)
    days = folds.select("w_snn", F.col("test_day").alias("day")).distinct().join(sizes, "day")
    signals = d.filter(F.abs("d") > 60).join(folds.select("w_snn", F.col("test_day").alias("day")).distinct(), "day")
    return G.signal_rates(signals, ["w_snn"], days, sizes)


_BIG = """pooled AS (SELECT f.w_snn, f.test_day, d.symbol, d.num, abs(d.d) AS a, row_number() OVER (PARTITION BY f.w_snn, f.test_day, d.symbol, d.num ORDER BY abs(d.d)) - 1 AS i,
  count(*) OVER (PARTITION BY f.w_snn, f.test_day, d.symbol, d.num) AS m FROM folds f JOIN dd d ON d.day = f.train_day WHERE d.d IS NOT NULL),
pos AS (SELECT ref.*, n_signals / n_bars AS rate FROM ref WHERE n_signals > 0),
lim AS (SELECT q.w_snn, q.test_day, q.symbol, q.num, q.rate,
  max(a) FILTER (i = floor((m - 1) * (1 - rate))) + (max(a) FILTER (i = ceil((m - 1) * (1 - rate))) - max(a) FILTER (i = floor((m - 1) * (1 - rate))))
    * (max((m - 1) * (1 - rate)) - floor(max((m - 1) * (1 - rate)))) AS threshold
  FROM pos q JOIN pooled p USING (w_snn, test_day, symbol, num) GROUP BY ALL)"""


@query(
    "g1_big_move_signals",
    S.chain(S.folds(1, 3), _REF, _BIG) + f"""SELECT w_snn, d.symbol, d.day, d.num, d.bar_idx, {rs('threshold')} FROM lim JOIN dd d ON d.day = test_day
  AND d.symbol = lim.symbol AND d.num = lim.num WHERE abs(d.d) > threshold""",
)
def g1(spark, sf):
    d, folds = C.bar_table(spark, sf), C.folds(spark, sf, 1, 3)
    rates = _reference(spark, d, folds).withColumnRenamed("day", "test_day")
    return G.big_moves(d, folds, rates, [])


def naive_sql(source: str, day: str, reps: int) -> str:
    """Random samples as many as the reference's signals: `source` has symbol, num, seed, n_signals, n_bars and the day column."""
    where = S.shuffled("i", "size", "'naive'", "rep", "day", "seed", "symbol")
    return f"""SELECT * EXCLUDE (lo, size, i), lo + {where} AS bar_idx FROM (SELECT *, unnest(range(0, least(n_signals, size))) AS i FROM (
  SELECT q.* EXCLUDE ({day}), q.{day} AS day, h.rule, h.lo, rep, CAST(n_bars - 1 - lo AS BIGINT) AS size FROM {source} q,
    (SELECT unnest(['momentum', 'alexanders_filter', 'stochastic_oscillator']) AS rule, unnest([3, 1, 2]) AS lo) h, (SELECT unnest(range(0, {reps})) AS rep)) WHERE size > 0)"""


@query(
    "g2_random_timing",
    S.chain(S.folds(1), _REF) + f""", zref AS (SELECT *, 0 AS seed FROM ref)
SELECT rule, CAST(rep AS INTEGER) AS rep, symbol, day, num, bar_idx FROM ({naive_sql('zref', 'test_day', 4)})""",
)
def g2(spark, sf):
    d, folds = C.diffs(spark, sf), C.folds(spark, sf, 1)
    ref = _reference(spark, d, folds).withColumn("seed", F.lit(0))
    rules = {"momentum": 3, "alexanders_filter": 1, "stochastic_oscillator": 2}
    return G.random_bars(ref, ["seed"], 4, rules).drop("seed")


def score_sql(source: str, out: str, rate: float = RATE) -> str:
    return f"""{out} AS (SELECT s.*, threshold FROM (SELECT *, round(p1 + p2, 9) AS score FROM {source}) s JOIN (SELECT symbol, num, w_snn, test_day,
  quantile_cont(round(p1 + p2, 9), {1 - rate}) AS threshold FROM {source} WHERE split = 'train' GROUP BY ALL) USING (symbol, num, w_snn, test_day)
  WHERE score > threshold)"""


TICKS, SEEDS = 10, (0, 1, 2, 3, 4)


def encoded_sql(source: str, out: str, seeds=SEEDS, rate: float = RATE, ticks: int = TICKS) -> str:
    """Spike counts of seeded draws with a keyed tie break, cut at the (1 - rate) quantile of the training bars."""
    u = lambda i: S.uniform("seed", "split", "symbol", "day", "'0'", "bar_idx", "k", f"'{i}'")
    spikes = [f"list_sum(list_transform(range({ticks}), lambda k: CAST({u(i)} < p{i} AS INTEGER)))" for i in (1, 2)]
    tie = S.uniform("'tie'", "seed", "split", "symbol", "day", "bar_idx")
    return f"""{out}_all AS (SELECT z.*, CAST(seed AS INTEGER) AS seed, {spikes[0]} AS spikes_1, {spikes[1]} AS spikes_2, spikes_1 + spikes_2 + {tie} AS score FROM {source} z, (SELECT unnest({list(seeds)}) AS seed)),
{out} AS (SELECT s.*, threshold FROM {out}_all s JOIN (SELECT seed, symbol, num, w_snn, test_day, quantile_cont(score, {1 - rate}) AS threshold
  FROM {out}_all WHERE split = 'train' GROUP BY ALL) USING (seed, symbol, num, w_snn, test_day) WHERE score > threshold)"""


_SK = "w_snn, test_day, split, symbol, day, num, bar_idx"


def seeded_scores(inputs, seeds, series=()):
    """Scores of encoded inputs for each seed, as a written table; rows of one bar (folds, `series`) lie side by side and share its draws."""
    rows = G.dealt(inputs.select(*series, *_SK.split(", "), "p1", "p2")).sortWithinPartitions(*BAR, "split")
    return materialise(G.encoded_score(G.with_seeds(rows, seeds), TICKS, F.col("seed")), "scored")


@query("g3_encoded_signals", S.chain(S.folds(1, 3), S.ZSCORE, encoded_sql("zin", "sg")) + f"SELECT seed, {_SK}, {r('score', 'score', 9)} FROM sg", digits=9)
def g3_encoded(spark, sf):
    """Signals of five seeds from encoded inputs, at the target rate on the training days."""
    scored = seeded_scores(N.zscore_inputs(C.bar_table(spark, sf), C.folds(spark, sf, 1, 3)), SEEDS)
    return G.score_signals(scored, ["seed"], RATE).drop("threshold")


@query(
    "g3_training_rates",
    S.chain(S.folds(1, 3), S.ZSCORE, encoded_sql("zin", "sg")) + """, tr_bars AS (SELECT symbol, num, w_snn, test_day, count(*) AS n FROM zin WHERE split = 'train' GROUP BY ALL)
SELECT CAST(seed AS INTEGER) AS seed, symbol, num, w_snn, test_day, TRUE AS within_one_bar FROM tr_bars, (SELECT unnest([0, 1, 2, 3, 4]) AS seed)""",
)
def g3_rates(spark, sf):
    """For every seed and fold: is the number of training signals the target rate's, to within one bar?"""
    inputs = materialise(N.zscore_inputs(C.diffs(spark, sf), C.folds(spark, sf, 1, 3)), "inputs")
    keys = ["symbol", "num", "w_snn", "test_day"]
    fired = G.score_signals(seeded_scores(inputs, SEEDS), ["seed"], RATE).filter("split = 'train'")
    wanted = G.with_seeds(inputs.filter("split = 'train'").groupBy(*keys).agg(F.count("*").alias("n")), SEEDS)
    rows = wanted.join(fired.groupBy("seed", *keys).agg(F.count("*").alias("fired")), ["seed", *keys], "left")
    return rows.select("seed", *keys, (F.abs(F.coalesce("fired", F.lit(0)) - RATE * F.col("n")) <= 1).alias("within_one_bar"))


# The score already has 9 digits: rounding it again to fewer could hit exact halves.
@query("g3_zscore_signals", S.chain(S.folds(1, 3), S.ZSCORE, score_sql("zin", "sg")) + f"SELECT {_SK}, score FROM sg", digits=9)
def g3(spark, sf):
    inputs = G.input_score(N.zscore_inputs(C.diffs(spark, sf), C.folds(spark, sf, 1, 3)))
    return G.score_signals(inputs, [], RATE).drop("threshold")


@query(
    "g3_excited_signals",
    S.chain(S.folds(1), S.events(), S.theta(), S.LAM, NQ.EXCITED, score_sql("lin", "sg")) + f"SELECT {_SK}, score FROM sg",
    digits=9,
)
def g3_excited(spark, sf):
    lam = C.intensities(spark, C.bar_table(spark, sf))
    inputs = G.input_score(N.intensity_inputs(lam, C.folds(spark, sf, 1)))
    return G.score_signals(inputs, [], RATE).drop("threshold")


@query(
    "g4_signal_rate",
    S.chain(S.folds(1), _REF) + f"SELECT w_snn, symbol, test_day AS day, num, n_signals, n_bars, {r('n_signals / n_bars', 'rate')} FROM ref",
)
def g4(spark, sf):
    return _reference(spark, C.diffs(spark, sf), C.folds(spark, sf, 1))


@query(
    "g4_signal_violations",
    S.chain() + """, sg AS (SELECT symbol, day, num, bar_idx FROM dd WHERE abs(d) > 60 UNION ALL SELECT symbol, day, num, bar_idx FROM dd WHERE d > 0 AND day(day) % 3 = 0
  UNION ALL SELECT symbol, day, num, n FROM dd WHERE bar_idx = 0 AND day(day) % 5 = 0)
SELECT symbol, day, num FROM (SELECT symbol, day, num, bar_idx, count(*) AS c FROM sg GROUP BY ALL) JOIN (SELECT symbol, day, num, max(n) AS n FROM dd GROUP BY ALL) USING (symbol, day, num)
GROUP BY symbol, day, num HAVING max(c) > 1 OR max(bar_idx) >= max(n)""",
)
def g4_violations(spark, sf):
    """Signals made invalid on purpose: repeated bars on every third day, a bar past the end on every fifth."""
    d = C.diffs(spark, sf)
    sizes = B.day_sizes(d)
    day = F.dayofmonth("day")
    signals = d.filter(F.abs("d") > 60).select(*BAR).unionByName(d.filter((F.col("d") > 0) & (day % 3 == 0)).select(*BAR))
    late = sizes.filter(day % 5 == 0).select(*BAR_DAY, F.col("n_bars").alias("bar_idx"))
    return G.signal_violations(signals.unionByName(late), [], sizes)


_RATES = (0.02, 0.05, 0.1, 0.2, 0.4)
_CURVE = f"""rt AS (SELECT unnest([{', '.join(map(str, _RATES))}]::DOUBLE[]) AS target_rate),
lim AS (SELECT q.test_day, q.symbol, q.num, rt.target_rate,
  max(a) FILTER (i = floor((m - 1) * (1 - target_rate))) + (max(a) FILTER (i = ceil((m - 1) * (1 - target_rate))) - max(a) FILTER (i = floor((m - 1) * (1 - target_rate))))
    * (max((m - 1) * (1 - target_rate)) - floor(max((m - 1) * (1 - target_rate)))) AS threshold
  FROM ref q JOIN pooled p USING (w_snn, test_day, symbol, num), rt GROUP BY ALL),
dm AS (SELECT l.target_rate, l.test_day, count(b.bar_idx) FILTER (abs(b.d) > threshold) / max(b.n) AS rate, max(base_accuracy) AS chance,
  count(*) FILTER (abs(b.d) > threshold AND b.real) / nullif(count(*) FILTER (abs(b.d) > threshold AND b.evaluable), 0) AS accuracy
  FROM lim l JOIN lab b ON b.day = l.test_day AND b.symbol = l.symbol AND b.num = l.num JOIN base ON base.day = b.day AND base.symbol = b.symbol AND base.num = b.num GROUP BY ALL)"""


@query(
    "g5_accuracy_rate_curve",
    S.chain(S.LABELS, S.folds(1), _REF, _BIG.split(",\npos AS")[0], _CURVE) + f"""SELECT target_rate, count(*) AS days, {r('avg(rate)', 'rate')}, {r('avg(accuracy)', 'accuracy')},
  {r('avg(chance)', 'chance')} FROM dm GROUP BY target_rate""",
)
def g5(spark, sf):
    d, folds = C.bar_table(spark, sf), C.folds(spark, sf, 1)
    labels = L.bar_labels(d)
    sizes = B.day_sizes(d)
    days = folds.select("w_snn", F.col("test_day").alias("day")).distinct().join(sizes, "day")
    targets = G.rate_grid(_RATES, days).withColumn("target_rate", F.col("rate"))
    signals = G.big_moves(d, folds, targets.withColumnRenamed("day", "test_day"), ["target_rate"])
    per_day = L.day_metrics(labels, signals, ["target_rate"], targets)
    return per_day.groupBy("target_rate").agg(
        F.count("*").alias("days"), F.avg("signal_rate").alias("rate"), F.avg("accuracy").alias("accuracy"), F.avg("base_accuracy").alias("chance")
    )
