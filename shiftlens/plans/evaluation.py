"""Queries over evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.numbers import ratio_or_null, ratio_or_zero
from ..operators import evaluation as E
from . import relations as R
from .catalogue import over, query

_CELLS = """
cells AS (
  SELECT corpus_name, scenario, count(*) AS runs, count(*) FILTER (status = 'green') AS green,
         avg(CAST(tests_passed AS DOUBLE) / nullif(tests_total, 0)) AS pass_mean,
         var_samp(CAST(tests_passed AS DOUBLE) / nullif(tests_total, 0)) AS pass_var,
         avg(CAST(tasks_done AS DOUBLE) / nullif(tasks_total, 0)) AS completion,
         avg(cost_usd) AS cost, avg(wall_seconds) AS wall, avg(recover_visits) AS visits,
         sum(escalation_attempted) AS esc, sum(escalation_rescued) AS resc
  FROM runs WHERE {where} GROUP BY corpus_name, scenario),
board AS (
  SELECT corpus_name, scenario, coalesce(tier, '') AS tier, runs, green,
         round_even(coalesce(green / runs, 0), 3) AS green_rate,
         round_even(coalesce(pass_mean, 0), 3) AS test_pass_mean,
         round_even(coalesce(pass_var, 0), 5) AS test_pass_variance,
         round_even(coalesce(completion, 0), 3) AS completion_mean,
         round_even(coalesce(cost, 0), 4) AS cost_mean, round_even(coalesce(wall, 0), 1) AS wall_mean,
         round_even(coalesce(visits, 0), 1) AS recover_visits_mean,
         CAST(coalesce(esc, 0) AS BIGINT) AS escalation_attempted, CAST(coalesce(resc, 0) AS BIGINT) AS escalation_rescued
  FROM cells LEFT JOIN corpus ON name = corpus_name)
"""
_NO_REPLAY = "suite NOT LIKE '%-replay-%'"
_WANTED = ("grid-replay-low", "grid-2")


@query("G-01 G-02 J-03 F-06 S-10 S-15", over("runs corpus", "," + _CELLS.format(where=_NO_REPLAY) + "SELECT * FROM board"))
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return E.leaderboard(R.runs(spark, folder), R.corpus(spark, folder))


@query(
    "F-06 G-01 J-03",
    over("runs corpus", "," + _CELLS.format(where="suite IN ('grid-replay-low', 'grid-2')") + "SELECT * FROM board"),
)
def leaderboard_explicit_suites(spark: SparkSession, folder: str) -> DataFrame:
    return E.leaderboard(R.runs(spark, folder), R.corpus(spark, folder), _WANTED)


@query("G-03", over("runs", f"SELECT suite, max(created_at) AS last_run FROM runs WHERE {_NO_REPLAY} GROUP BY suite"))
def suite_latest(spark: SparkSession, folder: str) -> DataFrame:
    return E.suite_list(R.runs(spark, folder))


_VALUE_SQL = {
    "suite_green": "CASE WHEN status = 'green' THEN 1.0 ELSE 0.0 END",
    "test_pass_rate": "CASE WHEN tests_total > 0 THEN tests_passed / tests_total ELSE 0 END",
    "completion_rate": "CASE WHEN tasks_total > 0 THEN tasks_done / tasks_total ELSE 0 END",
}
_METRICS_SQL = " UNION ALL ".join(
    f"""SELECT suite, corpus_name, scenario, driver_model, '{m}' AS metric, count(*) AS k,
        round_even(avg(CAST({_VALUE_SQL.get(m, m)} AS DOUBLE)), 4) AS mean,
        round_even(coalesce(var_samp(CAST({_VALUE_SQL.get(m, m)} AS DOUBLE)), 0), 6) AS variance
        FROM runs GROUP BY suite, corpus_name, scenario, driver_model"""
    for m in E.METRICS
)


@query("G-10 F-37", over("runs", _METRICS_SQL))
def cell_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return E.cell_metrics(R.runs(spark, folder))


@query(
    "G-10 F-15",
    over("jobs", """
, r AS (SELECT migration_recipe AS cell, user_id IS NULL OR status <> 'failed' AS accepted, status = 'running' AS repaired FROM jobs)
SELECT cell AS corpus_name, 'architect_acceptance_rate' AS metric, count(*) AS k,
       round_even(avg(CAST(accepted AS DOUBLE)), 4) AS mean, round_even(coalesce(var_samp(CAST(accepted AS DOUBLE)), 0), 6) AS variance
FROM r GROUP BY cell
UNION ALL
SELECT cell, 'architect_repair_rate', count(*), round_even(avg(CAST(repaired AS DOUBLE)), 4),
       round_even(coalesce(var_samp(CAST(repaired AS DOUBLE)), 0), 6) FROM r GROUP BY cell"""),
)
def plan_only_metrics(spark: SparkSession, folder: str) -> DataFrame:
    runs = R.jobs(spark, folder).select(
        F.lit("plan").alias("suite"),
        F.col("migration_recipe").alias("corpus_name"),
        F.lit("baseline").alias("scenario"),
        F.lit("driver").alias("driver_model"),
        (F.col("user_id").isNull() | (F.col("status") != "failed")).alias("architect_accepted"),
        (F.col("status") == "running").alias("architect_repairs"),
    )
    return E.cell_metrics(runs, E.PLAN_METRICS[:2]).select("corpus_name", "metric", "k", "mean", "variance")


@query(
    "G-01 G-10",
    over("runs", """
SELECT corpus_name,
       round_even(avg(CAST(tests_passed AS DOUBLE) / nullif(tests_total, 0)), 4) AS mean_nullskip,
       round_even(avg(CASE WHEN tests_total > 0 THEN tests_passed / tests_total ELSE 0 END), 4) AS mean_zerofill
FROM runs GROUP BY corpus_name"""),
)
def zero_filled_vs_null_skipped(spark: SparkSession, folder: str) -> DataFrame:
    passed, total = F.col("tests_passed"), F.col("tests_total")
    return R.runs(spark, folder).groupBy("corpus_name").agg(
        F.bround(F.avg(ratio_or_null(passed, total)), 4).alias("mean_nullskip"),
        F.bround(F.avg(ratio_or_zero(passed, total)), 4).alias("mean_zerofill"),
    )


@query(
    "G-13",
    over("runs corpus", "," + _CELLS.format(where=_NO_REPLAY) + """
SELECT CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(green) AS BIGINT) AS green,
       round_even(sum(cost_mean * runs) / sum(runs), 4) AS cost_mean,
       round_even(sum(wall_mean * runs) / sum(runs), 4) AS wall_mean
FROM board WHERE scenario = 'baseline'"""),
)
def weighted_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return E.weighted_rollup(leaderboard(spark, folder))


@query("G-23", over("runs", "SELECT status, count(*) AS n FROM runs WHERE suite = 'grid-2' GROUP BY status"))
def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return E.status_histogram(R.runs(spark, folder), "grid-2")


_RUN_COLUMNS = ("id", "suite", "corpus_name", "scenario", "k_index", "status", "cost_usd", "created_at")


@query(
    "T-02 F-07 S-15",
    over("runs", f"""SELECT {', '.join(_RUN_COLUMNS)} FROM runs WHERE scenario <> 'baseline'
         ORDER BY created_at DESC, id DESC LIMIT 25"""),
)
def latest_fault_runs(spark: SparkSession, folder: str) -> DataFrame:
    return E.latest_runs(R.runs(spark, folder), 25, "faults").select(*_RUN_COLUMNS)


@query(
    "F-07 T-08",
    over("runs", """
SELECT 'baseline' AS asked, count(*) AS n FROM runs WHERE scenario = 'baseline'
UNION ALL SELECT 'faults', count(*) FROM runs WHERE scenario <> 'baseline'
UNION ALL SELECT '', count(*) FROM runs"""),
)
def scenario_filter_counts(spark: SparkSession, folder: str) -> DataFrame:
    runs = R.runs(spark, folder)
    asked = F.array(*[
        F.when(P.of_scenario(F.col("scenario"), name), F.lit(name)) for name in ("baseline", "faults", "")
    ])
    return runs.select(F.explode(F.array_compact(asked)).alias("asked")).groupBy("asked").agg(F.count("*").alias("n"))


@query(
    "G-14 T-02",
    over("runs", """
, recent AS (SELECT * FROM runs ORDER BY created_at DESC, id DESC LIMIT 25)
SELECT (SELECT count(*) FROM runs WHERE status = 'timeout') AS active,
       (SELECT count(*) FROM runs WHERE status = 'green') AS successful,
       (SELECT count(*) FROM runs WHERE status IN ('red', 'error')) AS attention,
       round_even(coalesce((SELECT avg(cost_usd) FROM recent WHERE status = 'green' AND cost_usd > 0), 0), 4) AS green_cost"""),
)
def home_tiles(spark: SparkSession, folder: str) -> DataFrame:
    runs = R.runs(spark, folder)
    paid = (F.col("status") == "green") & (F.col("cost_usd") > 0)
    cost = E.latest_runs(runs, 25).agg(F.avg(F.when(paid, F.col("cost_usd"))).alias("cost"))
    status = F.col("status")
    return runs.agg(
        F.count_if(status == "timeout").alias("active"),
        F.count_if(status == "green").alias("successful"),
        F.count_if(status.isin("red", "error")).alias("attention"),
    ).withColumn("green_cost", F.bround(F.coalesce(cost.scalar(), F.lit(0.0)), 4))


@query(
    "W-08 V-06",
    over("corpus runs", """
, s AS (SELECT DISTINCT scenario FROM runs)
SELECT name, scenario, CAST(k AS INTEGER) AS k_index FROM corpus, s, range(1, 4) t(k)"""),
)
def run_grid(spark: SparkSession, folder: str) -> DataFrame:
    scenarios = R.runs(spark, folder).select("scenario").distinct()
    return E.run_grid(R.corpus(spark, folder), scenarios, 3)


_HARVEST_SQL = """
, grid AS (SELECT corpus_name, scenario, k_index, id AS job_id FROM runs),
j AS (SELECT id AS job_id, status AS job_status, created_at, updated_at, tests_total, tests_passed FROM (
        SELECT jobs.*, r.tests_total, r.tests_passed FROM jobs JOIN runs r USING (id) WHERE CAST(id AS BIGINT) % 11 <> 0)),
rep AS (SELECT id AS job_id, tasks_total, CAST(CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN tasks_total ELSE tasks_done END AS INTEGER) AS tasks_done,
               tasks_skipped, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'success' ELSE 'failed' END AS migration_outcome
        FROM runs WHERE CAST(id AS BIGINT) % 5 <> 0)
SELECT corpus_name, scenario, k_index, job_id,
       CASE WHEN job_status IS NULL THEN 'timeout' WHEN job_status = 'failed' THEN 'error' WHEN job_status <> 'done' THEN 'timeout'
            WHEN coalesce(tests_total, 0) > 0 AND coalesce(tests_passed, 0) = coalesce(tests_total, 0) AND coalesce(tasks_total, 0) > 0
                 AND coalesce(tasks_done, 0) = coalesce(tasks_total, 0) AND coalesce(migration_outcome, 'failed') = 'success'
            THEN 'green' ELSE 'red' END AS status,
       CASE WHEN job_status IS NULL THEN 0 ELSE coalesce(tests_total, 0) END AS tests_total, CASE WHEN job_status IS NULL THEN 0 ELSE coalesce(tests_passed, 0) END AS tests_passed,
       CASE WHEN job_status IS NULL THEN 0 ELSE coalesce(tasks_total, 0) END AS tasks_total, CASE WHEN job_status IS NULL THEN 0 ELSE coalesce(tasks_done, 0) END AS tasks_done, CASE WHEN job_status IS NULL THEN 0 ELSE coalesce(tasks_skipped, 0) END AS tasks_skipped,
       coalesce(round_even(epoch(updated_at - created_at), 1), 0.0) AS wall_seconds,
       CASE WHEN job_status IS NULL THEN 'failed' ELSE coalesce(migration_outcome, 'failed') END AS migration_outcome
FROM grid LEFT JOIN j USING (job_id) LEFT JOIN rep USING (job_id)
"""


@query("F-13 F-14 F-23 J-04 Q-07", over("runs jobs", _HARVEST_SQL))
def run_harvest(spark: SparkSession, folder: str) -> DataFrame:
    runs, jobs = R.runs(spark, folder), R.jobs(spark, folder)
    number = F.col("id").cast("long")
    grid = runs.select("corpus_name", "scenario", "k_index", F.col("id").alias("job_id"))
    found = jobs.join(runs.select("id", "tests_total", "tests_passed"), "id").filter(number % 11 != 0).select(
        F.col("id").alias("job_id"), F.col("status").alias("job_status"), "created_at", "updated_at", "tests_total", "tests_passed"
    )
    reports = runs.filter(number % 5 != 0).select(
        F.col("id").alias("job_id"),
        "tasks_total",
        F.when(number % 3 == 0, F.col("tasks_total")).otherwise(F.col("tasks_done")).alias("tasks_done"),
        "tasks_skipped",
        F.when(number % 2 == 0, "success").otherwise("failed").alias("migration_outcome"),
    )
    return E.harvest(grid, found, reports)


@query(
    "F-15 F-24",
    over("jobs", """
SELECT id, CASE WHEN status IN ('done', 'queued') THEN 'green' ELSE 'red' END AS status,
       CASE WHEN status NOT IN ('done', 'queued') THEN
         CASE WHEN lower(coalesce(error, '')) LIKE '%must declare at least one export%' THEN 'schema_missing_export'
              WHEN lower(coalesce(error, '')) LIKE '%strict json%' THEN 'schema_invalid_json'
              WHEN lower(coalesce(error, '')) LIKE '%requires exactly one owner artifact, got 0%' THEN 'policy_missing_owner'
              WHEN lower(coalesce(error, '')) LIKE '%path%' AND lower(error) LIKE '%forbidden%' THEN 'policy_path'
              ELSE 'engine_or_unknown' END END AS rejection
FROM jobs"""),
)
def plan_only_status(spark: SparkSession, folder: str) -> DataFrame:
    """A queued job has no architect task yet, so its plan counts as accepted."""
    jobs = R.jobs(spark, folder)
    status = P.plan_only_status(F.when(F.col("status") != "queued", F.col("status")))
    return jobs.select(
        "id", status.alias("status"), F.when(status == "red", P.rejection_class(F.col("error"))).alias("rejection")
    )


@query(
    "F-24",
    """
SELECT doc_id, CASE
    WHEN lower(text) LIKE '%must declare at least one export%' THEN 'schema_missing_export'
    WHEN lower(text) LIKE '%strict json%' THEN 'schema_invalid_json'
    WHEN lower(text) LIKE '%requires exactly one owner artifact, got 0%' THEN 'policy_missing_owner'
    WHEN lower(text) LIKE '%requires exactly one class export%' OR lower(text) LIKE '%wrong export kinds%' THEN 'policy_contract_shape'
    WHEN lower(text) LIKE '%path%' AND (lower(text) LIKE '%forbidden%' OR contains(lower(text), 'allowed_new_artifact_paths')) THEN 'policy_path'
    WHEN lower(text) LIKE '%artifact architecture rejected%' THEN 'schema_or_policy_other'
    ELSE 'engine_or_unknown' END AS reject_class
FROM documents""",
)
def reject_class(spark: SparkSession, folder: str) -> DataFrame:
    return R.table(spark, folder, "documents").select("doc_id", P.rejection_class(F.col("text")).alias("reject_class"))
