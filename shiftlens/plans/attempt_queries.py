"""Queries over attempts, recovery actions, leases and step logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attempts as A
from ..operators import queue_state as Q
from ..operators import sets as S
from . import relations as R
from .catalogue import over, query


@query(
    "J-01 G-05 F-09 X-20",
    over("attempts users", """
SELECT u.login AS user_id, round_even(sum(cost_usd), 6) AS spend, count(*) AS paid_attempts
FROM attempts a JOIN users u ON u.id = a.job_id WHERE cost_usd IS NOT NULL GROUP BY u.login"""),
)
def spend_ledger(spark: SparkSession, folder: str) -> DataFrame:
    owners = R.users(spark, folder).select(F.col("id").alias("job_id"), F.col("login").alias("user_id"))
    return A.spend(R.task_logs(spark, folder), owners)


@query(
    "G-05 F-05 X-18",
    over("attempts", """SELECT round_even(coalesce(sum(cost_usd), 0), 6) AS spend FROM attempts
         WHERE created_at >= date_trunc('day', TIMESTAMP '2024-01-20 13:00:00')"""),
)
def spend_since_midnight(spark: SparkSession, folder: str) -> DataFrame:
    since = F.date_trunc("day", F.lit("2024-01-20 13:00:00").cast("timestamp_ntz")).cast("timestamp_ntz")
    return A.spend_since(R.task_logs(spark, folder), since)


@query(
    "G-06",
    over("attempts task_logs", """
, t AS (SELECT DISTINCT job_id FROM task_logs),
a AS (SELECT job_id, count(*) FILTER (action IN ('architect', 'architect_repair', 'migrate', 'contract_repair', 'diagnose')) AS calls,
             sum(coalesce(prompt_tokens, 0)) AS p, sum(coalesce(completion_tokens, 0)) AS c, sum(coalesce(cost_usd, 0)) AS cost
      FROM attempts GROUP BY job_id)
SELECT t.job_id, coalesce(calls, 0) AS calls, CAST(coalesce(p, 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(c, 0) AS BIGINT) AS completion_tokens, round_even(coalesce(cost, 0), 6) AS cost_usd
FROM t LEFT JOIN a USING (job_id)"""),
)
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    return A.usage(R.task_logs(spark, folder))


@query(
    "G-07",
    over("attempts task_logs", """
, e AS (SELECT DISTINCT id FROM attempts WHERE tier = 'escalation')
SELECT job_id, count(e.id) AS escalation_attempted, count(e.id) FILTER (status = 'done') AS escalation_rescued
FROM task_logs t LEFT JOIN e ON e.id = t.id GROUP BY job_id"""),
)
def escalation_rescue(spark: SparkSession, folder: str) -> DataFrame:
    return A.escalations(R.task_logs(spark, folder))


@query(
    "G-08 Q-05",
    over("recovery_actions task_logs", """
, a AS (SELECT job_id, count(*) AS visits, count(*) FILTER (budget_charged) AS budget_used,
               count(*) FILTER (classification LIKE '%no_progress%') AS no_progress_retries,
               arg_max(classification, ("at", seq)) AS last_classification FROM recovery_actions GROUP BY job_id),
s AS (SELECT job_id, count(*) FILTER (status = 'skipped') AS tasks_skipped FROM task_logs GROUP BY job_id)
SELECT coalesce(a.job_id, s.job_id) AS job_id, visits, budget_used, no_progress_retries, last_classification, tasks_skipped
FROM a FULL JOIN s ON a.job_id = s.job_id"""),
)
def recovery_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.recovery_summary(R.recovery_actions(spark, folder), R.task_logs(spark, folder))


@query(
    "G-24",
    over("attempts task_logs", """
, a AS (SELECT id, count(*) FILTER (action IN ('architect', 'architect_repair')) AS calls,
               count(*) FILTER (action = 'architect_repair') AS repairs,
               arg_min(model, attempt) FILTER (action = 'architect') AS model FROM attempts GROUP BY id)
SELECT t.id, CAST(coalesce(calls, 0) AS INTEGER) AS calls, CAST(coalesce(repairs, 0) AS INTEGER) AS repairs, model
FROM task_logs t LEFT JOIN a ON a.id = t.id WHERE type = 'artifact_architect'"""),
)
def architect_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return A.architect_analysis(R.task_logs(spark, folder))


@query(
    "W-01",
    over("attempts task_logs", """
, l AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY id ORDER BY attempt DESC) = 1)
SELECT t.id, l.attempt, l.tier, l.action, l.cost_usd FROM task_logs t LEFT JOIN l ON l.id = t.id"""),
)
def latest_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return A.latest_attempt(R.task_logs(spark, folder))


@query(
    "W-01 K-04",
    over("attempts", """
, n AS (SELECT id, max(attempt) AS last FROM attempts GROUP BY id)
SELECT a.id, a.attempt, CASE WHEN a.attempt = n.last AND a.cost_usd IS NULL THEN 0.5
            ELSE a.cost_usd END AS cost_usd FROM attempts a JOIN n ON n.id = a.id
UNION ALL SELECT id, last + 1, NULL FROM n"""),
)
def amended_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Fill in the last attempt's missing cost, then append one more attempt."""
    from ..operators.writes import amended_attempt, appended_attempt

    tasks = R.task_logs(spark, folder).filter(F.size("attempts_log") > 0)
    last_cost = F.element_at("attempts_log", -1)["cost_usd"]
    amended = amended_attempt(F.col("attempts_log"), {"cost_usd": F.coalesce(last_cost, F.lit(0.5))})
    tasks = tasks.withColumn("attempts_log", amended)
    last = F.element_at("attempts_log", -1)
    entry = last.withField("attempt", last["attempt"] + 1).withField("cost_usd", F.lit(None).cast("double"))
    appended = tasks.withColumn("attempts_log", appended_attempt(F.col("attempts_log"), entry))
    return A.exploded(appended).select("id", "attempt_row.attempt", "attempt_row.cost_usd")


@query(
    "W-02 X-21",
    over("attempts task_logs", """
, l AS (SELECT id, arg_max(failing_diff, attempt) AS diff FROM attempts WHERE failing_diff <> '' GROUP BY id)
SELECT t.id, coalesce(l.diff, '') AS diff FROM task_logs t LEFT JOIN l ON l.id = t.id"""),
)
def latest_failing_diff(spark: SparkSession, folder: str) -> DataFrame:
    return A.latest_failing_diff(R.task_logs(spark, folder))


@query(
    "G-17",
    over("attempts task_logs", """
, c AS (SELECT id, count(*) AS n FROM attempts WHERE action = 'contract_repair' AND scope = 'runtime_targeted' GROUP BY id)
SELECT t.id, CAST(coalesce(n, 0) AS INTEGER) AS targeted_repairs FROM task_logs t LEFT JOIN c ON c.id = t.id"""),
)
def targeted_repairs(spark: SparkSession, folder: str) -> DataFrame:
    return A.targeted_repairs(R.task_logs(spark, folder))


@query(
    "G-17 W-06",
    over("recovery_actions", """
, r AS (SELECT job_id, seq, row_number() OVER (PARTITION BY job_id, fingerprint ORDER BY "at", seq) AS repeat FROM recovery_actions)
SELECT job_id, seq, repeat, CASE WHEN repeat >= 3 THEN 'stop' WHEN repeat = 2 THEN 'diagnose' ELSE 'retry' END AS verdict FROM r"""),
)
def failure_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    return A.failure_ordinals(R.recovery_actions(spark, folder)).select("job_id", "seq", "repeat", "verdict")


@query(
    "W-07",
    over("recovery_actions", """
, r AS (SELECT job_id, seq, row_number() OVER w AS visit, CAST(sum(CAST(budget_charged AS INTEGER)) OVER w AS BIGINT) AS budget_used
        FROM recovery_actions WINDOW w AS (PARTITION BY job_id ORDER BY "at", seq ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN visit > 26 THEN 'hard_safety_cap' WHEN budget_used > 4 THEN 'budget_exhausted' END AS stop FROM r"""),
)
def budget_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return A.budget_ledger(R.recovery_actions(spark, folder), F.lit(20)).select("job_id", "seq", "visit", "budget_used", "stop")


@query(
    "G-18",
    over("recovery_actions", """
, r AS (SELECT job_id, seq, coalesce(sum(cost_usd) OVER (PARTITION BY job_id ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM recovery_actions)
SELECT job_id, seq, round_even(before, 2) AS spent_before, before >= 1500.005 AS skipped FROM r"""),
)
def ceiling_skips(spark: SparkSession, folder: str) -> DataFrame:
    skips = A.ceiling_skips(R.recovery_actions(spark, folder), F.lit(1500.005))
    return skips.select("job_id", "seq", F.bround("spent_before", 2).alias("spent_before"), "skipped")


@query(
    "J-15",
    """
WITH b AS (SELECT user_id, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS p FROM events WHERE event_type <> 'error'),
i AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS p FROM events WHERE event_type = 'error')
SELECT CAST(b.user_id AS VARCHAR) AS job_id, max(seq) AS batch_seq FROM b JOIN i ON i.user_id = b.user_id AND i.p = b.p GROUP BY b.user_id""",
)
def latest_overlap(spark: SparkSession, folder: str) -> DataFrame:
    events = R.table(spark, folder, "events").select(
        R.text_of("user_id").alias("job_id"), (R.props_k() % 20).alias("path"), F.col("event_id").alias("seq"), "event_type"
    )
    implicated = events.filter("event_type = 'error'").select("job_id", "path")
    return A.latest_overlap(implicated, events.filter("event_type <> 'error'").select("job_id", "path", "seq"))


@query(
    "J-16",
    over("file_tasks", """
, m AS (SELECT DISTINCT job_id, 'u' || CAST(order_index // 20 AS VARCHAR) AS unit_id, target_path AS path FROM file_tasks WHERE target_path IS NOT NULL),
p AS (SELECT DISTINCT job_id, target_path AS path FROM file_tasks WHERE status = 'failed' AND target_path IS NOT NULL)
SELECT m.job_id, m.path, m.unit_id FROM m JOIN p USING (job_id, path)"""),
)
def units_of_failed_paths(spark: SparkSession, folder: str) -> DataFrame:
    tasks = R.file_tasks(spark, folder).filter("target_path IS NOT NULL").withColumnRenamed("target_path", "path")
    unit = F.concat(F.lit("u"), F.floor(F.col("order_index") / 20).cast("string")).alias("unit_id")
    members = tasks.select("job_id", unit, "path").distinct()
    failed = tasks.filter("status = 'failed'").select("job_id", "path").distinct()
    return A.containing(members, failed).select("job_id", "path", "unit_id")


@query(
    "G-16 U-01",
    """SELECT DISTINCT l_suppkey AS batch, 'tests/test_' || CAST(l_partkey % 50 AS VARCHAR) || '.py' AS test FROM lineitem""",
)
def batch_test_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("batch"),
        F.concat(F.lit("tests/test_"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py")).alias("test"),
    )
    return S.union_of_tests(rows, ["batch"])


# ----------------------------------------------------------------------- queue and leases

_NOW = "1998-06-01 00:00:20"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


_CLAIM = f"status = 'queued' OR (status = 'running' AND heartbeat_at < TIMESTAMP '{_NOW}' - INTERVAL 15 SECOND)"


@query(
    "Q-01 F-10 T-03",
    over("jobs", f"SELECT id, status, created_at FROM jobs WHERE {_CLAIM} ORDER BY created_at, id LIMIT 1"),
)
def queue_head(spark: SparkSession, folder: str) -> DataFrame:
    return Q.queue_head(R.jobs(spark, folder), _now()).select("id", "status", "created_at")


@query("F-10", over("jobs", f"SELECT id FROM jobs WHERE {_CLAIM}"))
def claimable_jobs(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.predicates import claimable

    return R.jobs(spark, folder).filter(claimable(F.col("status"), F.col("heartbeat_at"), _now(), 15.0)).select("id")


#: Running jobs are held by one of ten workers, by the last digit of their id.
_HOLDER = "CASE WHEN status = 'running' THEN 'w' || right(CAST(id AS VARCHAR), 1) END"


def _held(spark: SparkSession, folder: str) -> DataFrame:
    holder = F.when(F.col("status") == "running", F.concat(F.lit("w"), F.right(F.col("id").cast("string"), F.lit(1))))
    return R.jobs(spark, folder).withColumn("worker_id", holder)


@query(
    "Q-01",
    over("jobs", f"""
, held AS (SELECT *, {_HOLDER} AS worker_id FROM jobs),
h AS (SELECT id FROM jobs WHERE {_CLAIM} ORDER BY created_at, id LIMIT 1)
SELECT j.id, CASE WHEN h.id IS NOT NULL THEN 'running' ELSE status END AS status, CASE WHEN h.id IS NOT NULL THEN 'w1' ELSE j.worker_id END AS worker_id,
       CASE WHEN h.id IS NOT NULL THEN TIMESTAMP '{_NOW}' ELSE heartbeat_at END AS heartbeat_at
FROM held j LEFT JOIN h ON h.id = j.id"""),
)
def claimed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return Q.claimed(_held(spark, folder), _now(), "w1")


def _beats(spark: SparkSession, folder: str) -> DataFrame:
    return R.table(spark, folder, "events").select(
        R.text_of("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at")
    )


@query(
    "Q-02",
    over("jobs", f"""
, held AS (SELECT *, {_HOLDER} AS worker_id FROM jobs),
beats AS (SELECT CAST(l_orderkey AS VARCHAR) AS job_id, 'w' || right(CAST(l_partkey AS VARCHAR), 1) AS beating, max(CAST(l_shipdate AS TIMESTAMP)) AS beat FROM lineitem GROUP BY 1, 2)
SELECT id, worker_id, greatest(heartbeat_at, beat) AS heartbeat_at FROM held LEFT JOIN beats ON job_id = CAST(id AS VARCHAR) AND beating = worker_id WHERE status = 'running'"""),
)
def renewed_leases(spark: SparkSession, folder: str) -> DataFrame:
    """Workers beat for orders by the parts of their lines, so most beats come from workers that do not hold the job."""
    beats = R.table(spark, folder, "lineitem").select(
        R.text_of("l_orderkey").alias("job_id"), F.concat(F.lit("w"), F.right(R.text_of("l_partkey"), F.lit(1))).alias("worker_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("at"),
    )
    return Q.renewed_leases(_held(spark, folder), beats)


@query(
    "Q-02",
    "SELECT CAST(user_id AS VARCHAR) AS job_id, max(ts) AS heartbeat_at, count(*) AS beats FROM events GROUP BY 1",
)
def last_heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    return Q.last_heartbeats(_beats(spark, folder))


@query(
    "Q-03",
    """
SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts AS "at", next_at FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_at FROM events) WHERE next_at > ts + INTERVAL 6 HOUR""",
)
def lease_expired(spark: SparkSession, folder: str) -> DataFrame:
    return Q.expired_leases(_beats(spark, folder), 6 * 3600)


_STEP_SQL = """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts AS "at",
  CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN 'execute' WHEN 'click' THEN 'verify' WHEN 'error' THEN 'recover'
       ELSE CASE WHEN event_id % 2 = 0 THEN 'integrate' ELSE 'report' END END AS step FROM events)
"""


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    step = (
        F.when(kind == "signup", "plan")
        .when(kind == "view", "execute")
        .when(kind == "click", "verify")
        .when(kind == "error", "recover")
        .when(F.col("event_id") % 2 == 0, "integrate")
        .otherwise("report")
    )
    events = R.table(spark, folder, "events")
    return events.select(R.text_of("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), step.alias("step"))


@query(
    "Q-04",
    _STEP_SQL + """
, l AS (SELECT job_id, arg_max(step, ("at", seq)) AS step FROM s GROUP BY job_id)
SELECT job_id, step, CASE WHEN step = 'report' THEN 'no_op' ELSE 'resume' END AS decision FROM l""",
)
def resume_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return Q.latest_checkpoint(_steps(spark, folder))


@query(
    "Q-06",
    _STEP_SQL + """
, p AS (SELECT *, lag(step) OVER (PARTITION BY job_id ORDER BY "at", seq) AS came_from FROM s)
SELECT job_id, seq, step, came_from, coalesce((came_from IS NULL AND step = 'ingest') OR (came_from, step) IN (
  ('ingest', 'plan'), ('plan', 'execute'), ('plan', 'report'), ('execute', 'verify'), ('verify', 'execute'), ('verify', 'recover'),
  ('verify', 'integrate'), ('recover', 'execute'), ('recover', 'plan'), ('recover', 'verify'), ('recover', 'integrate'),
  ('integrate', 'recover'), ('integrate', 'report')), false) AS allowed
FROM p""",
)
def transition_audit(spark: SparkSession, folder: str) -> DataFrame:
    return Q.transition_audit(_steps(spark, folder)).select("job_id", "seq", "step", "came_from", "allowed")


@query(
    "Q-05",
    _STEP_SQL + """SELECT job_id, step AS channel, seq, row_number() OVER (PARTITION BY job_id, step ORDER BY "at", seq) AS place FROM s""",
)
def channel_entries(spark: SparkSession, folder: str) -> DataFrame:
    return Q.channel_entries(_steps(spark, folder).withColumnRenamed("step", "channel")).select("job_id", "channel", "seq", "place")


@query(
    "Q-08",
    """SELECT user_id % 10 AS address, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > 1 AS over FROM events GROUP BY ALL""",
)
def rate_limit_minute(spark: SparkSession, folder: str) -> DataFrame:
    requests = R.table(spark, folder, "events").select((F.col("user_id") % 10).alias("address"), F.col("ts").alias("at"))
    return Q.requests_per_minute(requests, 1)


@query(
    "Q-09",
    """
SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round_even(sum(value), 4) AS cost, count(*) >= 4 AS over_quota,
       round_even(sum(value), 4) >= 300.00005 AS over_spend FROM events GROUP BY ALL""",
)
def daily_quota(spark: SparkSession, folder: str) -> DataFrame:
    events = R.table(spark, folder, "events").select("user_id", F.col("ts").alias("at"), F.col("value").alias("cost"))
    return Q.daily_totals(events, 4, 300.00005)


@query(
    "Q-12",
    """
SELECT d.doc_id AS id, b.item_id FROM documents d JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = CAST(d.doc_id AS VARCHAR)
WHERE d.doc_id % 3 <> 0 AND sha256(CASE WHEN d.doc_id % 2 = 0 THEN b.text ELSE d.text END) = sha256(b.text)""",
)
def unchanged_done(spark: SparkSession, folder: str) -> DataFrame:
    bench = R.table(spark, folder, "benchmark")
    files = bench.select(R.text_of("item_id").alias("path"), F.sha2("text", 256).alias("content_hash"), "item_id")
    docs = R.table(spark, folder, "documents").select("doc_id", F.col("text").alias("own"))
    joined = docs.join(bench, docs.doc_id == bench.item_id)
    tasks = joined.select(
        F.col("doc_id").alias("id"),
        R.text_of("item_id").alias("target_path"),
        F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("done").alias("status"),
        F.sha2(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("own")), 256).alias("content_hash"),
    )
    return Q.unchanged_done(tasks, files).select("id", F.col("target_path").cast("long").alias("item_id"))


@query(
    "S-13",
    over("jobs tasks", """SELECT j.id, count(*) AS plan_size FROM jobs j JOIN tasks t ON t.job_id = j.id
         WHERE j.status = 'done' AND t.type = 'artifact_architect' AND t.status = 'done' GROUP BY j.id"""),
)
def replay_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs whose finished architecture task can be replayed; an empty plan is no plan."""
    done = R.jobs(spark, folder).filter("status = 'done'").select("id")
    plans = R.tasks(spark, folder).filter("type = 'artifact_architect' AND status = 'done'")
    return plans.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("plan_size")).join(done, "id", "left_semi")
