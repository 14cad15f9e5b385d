"""Evaluation reports over the run table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.numbers import ratio_or_null, ratio_or_zero, rounded

METRICS = (
    "suite_green",
    "test_pass_rate",
    "completion_rate",
    "oracle_integrity_rate",
    "no_progress_retries",
    "recover_visits",
    "recover_budget_used",
    "escalation_rescued",
    "llm_calls",
    "cost_usd",
    "wall_seconds",
)
PLAN_METRICS = ("architect_acceptance_rate", "architect_repair_rate", "llm_calls", "cost_usd", "wall_seconds")


def leaderboard(runs: DataFrame, corpus: DataFrame, suites: Sequence[str] = ()) -> DataFrame:
    """Success, cost and retries per corpus entry and scenario.

    The join to the manifest comes after the aggregation, so it sees one row per cell.
    """
    pass_rate = ratio_or_null(F.col("tests_passed"), F.col("tests_total"))
    cells = (
        runs.filter(P.in_suites(F.col("suite"), suites))
        .groupBy("corpus_name", "scenario")
        .agg(
            F.count("*").alias("runs"),
            F.count_if(F.col("status") == "green").alias("green"),
            F.avg(pass_rate).alias("pass_mean"),
            F.var_samp(pass_rate).alias("pass_var"),
            F.avg(ratio_or_null(F.col("tasks_done"), F.col("tasks_total"))).alias("completion"),
            F.avg("cost_usd").alias("cost"),
            F.avg("wall_seconds").alias("wall"),
            F.avg("recover_visits").alias("visits"),
            F.sum("escalation_attempted").alias("escalations"),
            F.sum("escalation_rescued").alias("rescued"),
        )
    )
    tiers = corpus.select(F.col("name").alias("corpus_name"), "tier")
    return cells.join(tiers, "corpus_name", "left").select(
        "corpus_name",
        "scenario",
        F.coalesce("tier", F.lit("")).alias("tier"),
        "runs",
        "green",
        rounded(F.col("green") / F.col("runs"), 3).alias("green_rate"),
        rounded(F.col("pass_mean"), 3).alias("test_pass_mean"),
        rounded(F.col("pass_var"), 5).alias("test_pass_variance"),
        rounded(F.col("completion"), 3).alias("completion_mean"),
        rounded(F.col("cost"), 4).alias("cost_mean"),
        rounded(F.col("wall"), 1).alias("wall_mean"),
        rounded(F.col("visits"), 1).alias("recover_visits_mean"),
        F.coalesce("escalations", F.lit(0)).alias("escalation_attempted"),
        F.coalesce("rescued", F.lit(0)).alias("escalation_rescued"),
    ).orderBy("scenario", "corpus_name")


def suite_list(runs: DataFrame) -> DataFrame:
    """Suites other than replays, the one that ran last first."""
    return (
        runs.filter(P.in_suites(F.col("suite"), ()))
        .groupBy("suite")
        .agg(F.max("created_at").alias("last_run"))
        .orderBy(F.desc("last_run"), "suite")
    )


def latest_runs(runs: DataFrame, limit: int = 25, scenario: str = "") -> DataFrame:
    """The newest runs of a scenario; the id breaks ties."""
    return runs.filter(P.of_scenario(F.col("scenario"), scenario)).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def metric_value(name: str) -> Column:
    """A run's value for a metric; rates with nothing to count are 0.0."""
    if name == "suite_green":
        return (F.col("status") == "green").cast("double")
    if name == "test_pass_rate":
        return ratio_or_zero(F.col("tests_passed"), F.col("tests_total"))
    if name == "completion_rate":
        return ratio_or_zero(F.col("tasks_done"), F.col("tasks_total"))
    if name == "architect_acceptance_rate":
        return F.col("architect_accepted").cast("double")
    if name == "architect_repair_rate":
        return F.col("architect_repairs").cast("double")
    return F.coalesce(F.col(name), F.lit(0)).cast("double")


def cell_metrics(runs: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and sample variance of every metric per cell; one run has variance 0.0.

    All metrics are aggregated side by side and unpivoted afterwards: unpivoting the runs first
    would multiply what is shuffled by the number of metrics.
    """
    cell = ["suite", "corpus_name", "scenario", "driver_model"]
    values = runs.select(*cell, *[metric_value(m).alias(m) for m in metrics])
    wide = values.groupBy(*cell).agg(
        F.count("*").alias("k"),
        *[
            F.struct(
                F.bround(F.avg(m), 4).alias("mean"),
                F.bround(F.coalesce(F.var_samp(m), F.lit(0.0)), 6).alias("variance"),
            ).alias(m)
            for m in metrics
        ],
    )
    return wide.unpivot([*cell, "k"], list(metrics), "metric", "stats").select(
        *cell, "metric", "k", "stats.mean", "stats.variance"
    )


def weighted_rollup(cells: DataFrame) -> DataFrame:
    """Totals over the baseline cells of a leaderboard; means weigh by runs."""

    def weighted(name: str) -> Column:
        total = F.sum(F.col(name) * F.col("runs"))
        return F.bround(F.coalesce(total / F.nullif(F.sum("runs"), F.lit(0)), F.lit(0.0)), 4)

    return cells.filter(F.col("scenario") == "baseline").agg(
        F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"),
        F.coalesce(F.sum("green"), F.lit(0)).alias("green"),
        weighted("cost_mean").alias("cost_mean"),
        weighted("wall_mean").alias("wall_mean"),
    )


def status_histogram(runs: DataFrame, suite: str) -> DataFrame:
    return runs.filter(F.col("suite") == suite).groupBy("status").agg(F.count("*").alias("n"))


def run_grid(corpus: DataFrame, scenarios: DataFrame, k: int) -> DataFrame:
    """Every (entry, scenario, k) a suite has to run.

    Both inputs are manifests, a few rows each, and the grid is the work list itself.
    """
    names = scenarios.agg(F.collect_set("scenario").alias("names"))
    return (
        corpus.select("name")
        .withColumn("scenario", F.explode(names.scalar()))
        .withColumn("k_index", F.explode(F.sequence(F.lit(1), F.lit(k))))
    )


def harvest(grid: DataFrame, jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Fold each run's job and report into a flat run record; missing numbers read as 0."""

    waited_out = F.col("job_status").isNull()

    def number(name: str) -> Column:
        """0 when missing, and for a run whose job never ended, whatever its report says."""
        return F.coalesce(F.when(~waited_out, F.col(name).cast("int")), F.lit(0)).alias(name)

    micros = F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    joined = grid.join(jobs, "job_id", "left").join(reports, "job_id", "left")
    return joined.select(
        "corpus_name",
        "scenario",
        "k_index",
        "job_id",
        P.run_status(
            F.col("job_status"),
            F.coalesce("tests_total", F.lit(0)),
            F.coalesce("tests_passed", F.lit(0)),
            F.coalesce("tasks_total", F.lit(0)),
            F.coalesce("tasks_done", F.lit(0)),
            F.coalesce("migration_outcome", F.lit("failed")),
        ).alias("status"),
        number("tests_total"),
        number("tests_passed"),
        number("tasks_total"),
        number("tasks_done"),
        number("tasks_skipped"),
        F.coalesce(F.bround(micros / 1000000, 1), F.lit(0.0)).alias("wall_seconds"),
        F.when(waited_out, "failed").otherwise(F.coalesce("migration_outcome", F.lit("failed"))).alias("migration_outcome"),
    )
