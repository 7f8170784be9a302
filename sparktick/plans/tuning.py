"""Parameter search: grid points as rows, all trials evaluated in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparktick.functions.keyed import uniform
from sparktick.operators.labels import day_metrics, output_health
from sparktick.operators.normalise import FOLD, fold_rows, fold_stats, shifted_zscore
from sparktick.operators.signals import input_score, score_signals
from sparktick.schemas import BAR, BAR_DAY


def grid_points(spark: SparkSession, grid: dict[str, Sequence[float]]) -> DataFrame:
    """Every combination of the grid values, numbered in grid order (first name varies slowest)."""
    rows = spark.range(1).select(F.lit(0).alias("_i"))
    for name, values in grid.items():
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(values)])
        rows = rows.withColumn("_p", F.explode(pairs)).withColumn(name, F.col("_p.v")).withColumn(
            "_i", F.col("_i") * len(values) + F.col("_p.i")
        )
    return rows.select(F.col("_i").alias("point"), *grid)


def sample_trials(points: DataFrame, n: int, seed: int) -> DataFrame:
    """n distinct points drawn without replacement, named t000, t001, ... in grid order."""
    drawn = points.withColumn("_u", uniform("trial", seed, F.col("point"))).orderBy("_u", "point").limit(n)
    number = F.row_number().over(Window.orderBy("point")) - 1  # n rows
    return drawn.withColumn("trial", F.format_string("t%03d", number)).drop("_u")


def trial_signals(diffs: DataFrame, folds: DataFrame, trials: DataFrame) -> DataFrame:
    """Score-threshold signals of every trial (new_mean, new_std, rate). Statistics are fitted once per fold;
    only the bars of folds are repeated per trial, inside the job."""
    stats = fold_stats(diffs, folds, ["x1", "x2"])
    options = trials.agg(F.collect_list(F.struct("trial", "new_mean", "new_std")).alias("_trials")).withColumn("_one", F.lit(1))
    rows = fold_rows(diffs.select(*BAR, "x1", "x2"), folds).withColumn("_one", F.lit(1))
    rows = rows.join(F.broadcast(options), "_one").select("*", F.explode("_trials").alias("_t")).select(
        *BAR, "x1", "x2", "w_snn", "test_day", "split", "_t.*"
    )
    scored = input_score(shifted_zscore(rows, stats, F.col("new_mean"), F.col("new_std"), FOLD))
    return score_signals(scored, ["trial"], rates=trials.select("trial", "rate"))


def trial_table(labels: DataFrame, signals: DataFrame, trials: DataFrame, folds: DataFrame) -> DataFrame:
    """Per trial: mean accuracy, chance, rate, share of unhealthy days, folds and the edge over chance in pp."""
    days = folds.select("w_snn", F.col("test_day").alias("day")).distinct()
    sizes = labels.select(*BAR_DAY).distinct()
    names = trials.agg(F.collect_list("trial").alias("_t")).withColumn("_one", F.lit(1))
    spine = days.join(sizes, "day").withColumn("_one", F.lit(1)).join(F.broadcast(names), "_one")
    spine = spine.withColumn("trial", F.explode("_t")).select("trial", "w_snn", *BAR_DAY)
    test = signals.filter("split = 'test'").select("trial", "w_snn", *BAR)
    per_day = output_health(day_metrics(labels, test, ["trial", "w_snn"], spine))
    table = per_day.groupBy("trial").agg(
        F.avg("accuracy").alias("accuracy"), F.avg("base_accuracy").alias("chance"), F.avg("signal_rate").alias("signal_rate"),
        F.avg((F.col("warnings") != "").cast("double")).alias("unhealthy_share"), F.count("*").alias("folds"),
    )
    return trials.join(table, "trial").withColumn("edge_pp", (F.col("accuracy") - F.col("chance")) * 100)


def best_trial(table: DataFrame, max_unhealthy: float = 0.05) -> DataFrame:
    """Most accurate trial among those with few unhealthy days (ties: first trial)."""
    ok = table.filter((F.col("unhealthy_share") <= max_unhealthy) & F.col("accuracy").isNotNull())
    return ok.orderBy(F.desc("accuracy"), "trial").limit(1)


def ranked_trials(table: DataFrame, max_unhealthy: float = 0.05) -> DataFrame:
    """Admissible trials first, then by accuracy."""
    ok = F.col("unhealthy_share") <= max_unhealthy
    return table.withColumn("admissible", ok).orderBy(F.desc("admissible"), F.desc_nulls_last("accuracy"), "trial")
