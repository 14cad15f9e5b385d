"""Queries over jobs, tasks and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.numbers import passed_of_total
from ..operators import accounts as A
from ..operators import sets as S
from ..operators import task_tables as T
from ..operators import writes as W
from . import relations as R
from .catalogue import over, query

_NOW = "1998-01-01 06:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query(
    "T-01 F-02 F-03 G-04 S-15",
    over("jobs", """SELECT id, status, user_id, created_at, (SELECT count(*) FROM jobs) AS total_count FROM jobs
         ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100"""),
)
def jobs_page(spark: SparkSession, folder: str) -> DataFrame:
    page = T.jobs_page(R.jobs(spark, folder), "7", True, 50, 100)
    return page.select("id", "status", "user_id", "created_at", "total_count")


@query(
    "T-01 F-03 G-04",
    over("jobs", """SELECT id, status, (SELECT count(*) FROM jobs WHERE user_id = '7') AS total_count FROM jobs
         WHERE user_id = '7' ORDER BY created_at DESC, id DESC LIMIT 5"""),
)
def own_jobs_page(spark: SparkSession, folder: str) -> DataFrame:
    return T.jobs_page(R.jobs(spark, folder), "7", False, 5, 0).select("id", "status", "total_count")


@query("F-01 F-02", over("jobs", "SELECT id, status, repo_url FROM jobs WHERE id = '12' LIMIT 1"))
def job_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return T.job_by_id(R.jobs(spark, folder), "12", "7", True).select("id", "status", "repo_url")


@query(
    "F-02 F-42",
    over("jobs users", """
SELECT j.id, coalesce(u.role = 'admin', false) AS owner_is_admin, coalesce(NOT u.disabled, false) AS may_sign_in
FROM jobs j LEFT JOIN users u ON u.id = j.user_id"""),
)
def job_owners(spark: SparkSession, folder: str) -> DataFrame:
    owners = R.users(spark, folder).select(F.col("id").alias("user_id"), "role", "disabled")
    joined = R.jobs(spark, folder).join(owners, "user_id", "left")
    return joined.select(
        "id",
        F.coalesce(F.col("role") == "admin", F.lit(False)).alias("owner_is_admin"),
        F.coalesce(~F.col("disabled"), F.lit(False)).alias("may_sign_in"),
    )


@query(
    "F-04 F-05 G-04 Q-09",
    over("jobs", f"""
SELECT user_id, count(*) FILTER (status IN ('queued', 'running')) AS active,
       count(*) FILTER (created_at >= date_trunc('day', TIMESTAMP '{_NOW}')) AS today,
       count(*) FILTER (status IN ('queued', 'running')) >= 3 AS over_active,
       count(*) FILTER (created_at >= date_trunc('day', TIMESTAMP '{_NOW}')) >= 2 AS over_daily
FROM jobs WHERE user_id IS NOT NULL GROUP BY user_id"""),
)
def user_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """Open jobs and jobs since midnight per user, against limits of 3 and 2."""
    active = F.count_if(P.active(F.col("status")))
    today = F.count_if(P.since_midnight(F.col("created_at"), _now()))
    return (
        R.jobs(spark, folder)
        .filter("user_id IS NOT NULL")
        .groupBy("user_id")
        .agg(active.alias("active"), today.alias("today"), (active >= 3).alias("over_active"), (today >= 2).alias("over_daily"))
    )


@query(
    "F-12",
    over("file_tasks", "SELECT id, job_id, type, target_path, status, attempts, order_index FROM file_tasks"),
)
def task_states(spark: SparkSession, folder: str) -> DataFrame:
    return R.file_tasks(spark, folder).select("id", "job_id", "type", "target_path", "status", "attempts", "order_index")


_TREE_SQL = """
, p AS (SELECT * FROM tasks WHERE parent_id IS NULL), c AS (SELECT * FROM tasks WHERE parent_id IS NOT NULL)
"""


@query(
    "J-02 F-08 T-04",
    over("tasks", _TREE_SQL + """
SELECT p.id AS task_id, p.job_id, p.order_index AS task_order, p.created_at AS task_created_at, p.status AS task_status,
       c.id AS child_id, c.order_index AS child_order, c.created_at AS child_created_at, c.status AS child_status
FROM p LEFT JOIN c ON c.parent_id = p.id"""),
)
def task_tree(spark: SparkSession, folder: str) -> DataFrame:
    return T.task_tree(R.tasks(spark, folder))


@query(
    "J-02 T-04",
    over("tasks", _TREE_SQL + """
SELECT p.job_id, p.id AS task_id, count(c.id) AS children,
       arg_min(c.id, (c.order_index, c.created_at, c.id)) AS first_child,
       arg_max(c.id, (c.order_index, c.created_at, c.id)) AS last_child
FROM p LEFT JOIN c ON c.parent_id = p.id GROUP BY p.job_id, p.id"""),
)
def child_summary(spark: SparkSession, folder: str) -> DataFrame:
    return T.child_summary(R.tasks(spark, folder))


@query(
    "G-12",
    over("tasks", """
SELECT job_id, count(*) AS file_tasks, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'skipped') AS skipped,
       count(*) FILTER (status IN ('done', 'skipped')) AS settled
FROM tasks WHERE parent_id IS NULL AND target_path IS NOT NULL GROUP BY job_id"""),
)
def progress_two_ways(spark: SparkSession, folder: str) -> DataFrame:
    return T.progress(R.tasks(spark, folder))


@query(
    "G-19",
    over("tasks", """SELECT job_id, count(*) AS tasks_total, count(*) FILTER (status = 'done') AS tasks_done
         FROM tasks WHERE parent_id IS NULL GROUP BY job_id"""),
)
def task_counts(spark: SparkSession, folder: str) -> DataFrame:
    return T.task_counts(R.tasks(spark, folder))


_REPORTS = "reports AS (SELECT id AS job_id, recover_visits, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'unsupported' WHEN status = 'green' THEN 'success' ELSE 'failed' END AS migration_outcome FROM runs WHERE CAST(id AS BIGINT) % 4 <> 0)"


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("id").cast("long")
    outcome = F.when(number % 6 == 0, "unsupported").when(F.col("status") == "green", "success").otherwise("failed")
    return R.runs(spark, folder).filter(number % 4 != 0).select(
        F.col("id").alias("job_id"), "recover_visits", outcome.alias("migration_outcome")
    )


@query(
    "F-18",
    over("jobs tasks runs", f""", {_REPORTS},
c AS (SELECT job_id, bool_and(status IN ('done', 'skipped')) AS settled FROM tasks WHERE target_path IS NOT NULL GROUP BY job_id),
x AS (SELECT j.id AS job_id, j.status = 'running' AS run, j.status IN ('done', 'failed') AS fin, c.settled IS NOT NULL AS planned,
             coalesce(c.settled, false) AS settled, coalesce(r.recover_visits, 0) AS visits, r.job_id IS NOT NULL AS reported
      FROM jobs j LEFT JOIN c ON c.job_id = j.id LEFT JOIN reports r ON r.job_id = j.id)
SELECT job_id,
       CASE WHEN planned OR fin THEN 'done' WHEN run AND NOT planned THEN 'active' ELSE 'pending' END AS ingest,
       CASE WHEN planned OR fin THEN 'done' ELSE 'pending' END AS plan,
       CASE WHEN settled OR fin THEN 'done' WHEN run AND planned AND NOT settled THEN 'active' ELSE 'pending' END AS execute,
       CASE WHEN fin THEN 'done' WHEN run AND settled THEN 'active' ELSE 'pending' END AS verify,
       CASE WHEN visits > 0 THEN 'done' ELSE 'optional' END AS recover,
       CASE WHEN fin THEN 'done' ELSE 'pending' END AS integrate,
       CASE WHEN reported THEN 'done' ELSE 'pending' END AS report
FROM x"""),
)
def job_stages(spark: SparkSession, folder: str) -> DataFrame:
    return T.stages(R.jobs(spark, folder), R.tasks(spark, folder), _reports(spark, folder))


@query(
    "J-05 F-17 F-19",
    over("jobs runs", f""", {_REPORTS},
x AS (SELECT j.id AS job_id, j.status, r.migration_outcome,
             CASE WHEN j.status IN ('queued', 'running', 'failed') THEN j.status ELSE coalesce(r.migration_outcome, 'done') END AS shown
      FROM jobs j LEFT JOIN reports r ON r.job_id = j.id)
SELECT job_id, status, migration_outcome, shown,
       CASE WHEN shown IN ('queued', 'running') THEN 'active' WHEN shown = 'success' THEN 'success'
            WHEN shown IN ('failed', 'unsupported') THEN 'attention' END AS list_group
FROM x"""),
)
def jobs_with_reports(spark: SparkSession, folder: str) -> DataFrame:
    return T.with_reports(R.jobs(spark, folder), _reports(spark, folder).drop("recover_visits"))


@query(
    "F-16",
    over("runs", """
, x AS (SELECT *, CAST(id AS BIGINT) AS n FROM runs)
SELECT id, CASE WHEN n % 10 = 0 AND (n % 3 = 0 OR status = 'green') THEN 'plan_accepted' WHEN n % 10 = 0 THEN 'plan_rejected'
     WHEN n % 7 = 0 THEN 'unsupported'
     WHEN n % 9 <> 0 AND tests_passed > 0 AND tasks_skipped = 0 AND tasks_done = tasks_total AND n % 5 <> 0 THEN 'success'
     WHEN n % 9 <> 0 THEN 'failed' ELSE 'not_applicable' END AS migration_outcome
FROM x"""),
)
def outcome_priority(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("id").cast("long")
    architect = F.when(n % 3 != 0, F.when(F.col("status") == "green", "done").otherwise("failed"))
    outcome = P.migration_outcome(
        n % 10 == 0,
        architect,
        F.when(n % 7 == 0, 1).otherwise(0),
        n % 9 != 0,
        P.report_suite_ok(F.col("tests_passed"), F.col("tasks_skipped"), F.lit(0)),
        F.col("tasks_total"),
        F.col("tasks_done"),
        F.when(n % 5 == 0, 1).otherwise(0),
    )
    return R.runs(spark, folder).select("id", outcome.alias("migration_outcome"))


@query(
    "F-20 F-21 F-22 F-23",
    """
SELECT l_orderkey AS job_id, passed > 0 AND failed = 0 AND errors = 0 AS verify_passed,
       passed > 0 AND failed = 0 AND errors = 0 AS report_suite_ok,
       failed = 0 AND errors = 0 AND total > 0 AS junit_ok, total > 0 AND passed = total AS harness_suite_ok
FROM (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS passed,
             count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS failed,
             count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS errors
      FROM lineitem GROUP BY l_orderkey)""",
)
def passed_predicates(spark: SparkSession, folder: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    counts = R.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.count("*").alias("total"),
        F.count_if(flag == "R").alias("passed"),
        F.count_if((flag == "A") & (line == "F")).alias("failed"),
        F.count_if((flag == "A") & (line == "O")).alias("errors"),
    )
    total, passed, failed, errors = (F.col(c) for c in ("total", "passed", "failed", "errors"))
    return counts.select(
        "job_id",
        P.verify_passed(passed, failed, errors).alias("verify_passed"),
        P.report_suite_ok(passed, failed, errors).alias("report_suite_ok"),
        P.junit_ok(total, failed, errors).alias("junit_ok"),
        P.harness_suite_ok(total, passed).alias("harness_suite_ok"),
    )


@query(
    "X-17 X-19",
    over("runs", """SELECT id, CASE WHEN tests_total > 0 THEN CAST(tests_passed AS VARCHAR) || '/' || CAST(tests_total AS VARCHAR) ELSE '-' END AS tests,
         round_even(tests_passed / nullif(tests_total, 0), 4) AS rate FROM runs"""),
)
def test_ratio_texts(spark: SparkSession, folder: str) -> DataFrame:
    passed, total = F.col("tests_passed"), F.col("tests_total")
    return R.runs(spark, folder).select(
        "id", passed_of_total(passed, total).alias("tests"), F.bround(F.try_divide(passed, total), 4).alias("rate")
    )


@query(
    "J-06",
    over("file_tasks", """
, a AS (SELECT DISTINCT job_id, target_path AS path FROM file_tasks WHERE target_path IS NOT NULL AND order_index >= 30
        UNION SELECT DISTINCT job_id, 'src/none.py' FROM file_tasks),
s AS (SELECT job_id, target_path AS path, arg_min(status, (order_index, created_at, id)) AS status FROM file_tasks GROUP BY ALL)
SELECT a.job_id, a.path, s.status FROM a LEFT JOIN s USING (job_id, path)"""),
)
def artifact_status(spark: SparkSession, folder: str) -> DataFrame:
    tasks = R.file_tasks(spark, folder)
    late = tasks.filter("target_path IS NOT NULL AND order_index >= 30").select("job_id", F.col("target_path").alias("path"))
    absent = tasks.select("job_id", F.lit("src/none.py").alias("path"))
    return T.artifact_status(late.unionByName(absent).distinct(), tasks)


@query(
    "W-05 F-36",
    over("file_tasks", """
, f AS (SELECT job_id, arg_min(target_path, (order_index, created_at, id)) AS first_path FROM file_tasks
        WHERE target_path IS NOT NULL AND type NOT IN ('test_compat', 'test_harness') GROUP BY job_id)
SELECT t.id, f.first_path,
       coalesce(t.target_path = f.first_path AND attempts = 1, false) AS bad_patch,
       coalesce(t.target_path = f.first_path AND attempts <= 2, false) AS bad_until_escalation
FROM file_tasks t LEFT JOIN f USING (job_id)"""),
)
def fault_gates(spark: SparkSession, folder: str) -> DataFrame:
    tasks = R.file_tasks(spark, folder)
    first = T.first_eligible(tasks, ("test_compat", "test_harness"))
    joined = tasks.join(first, "job_id", "left")
    gate = [
        P.fault_fires(F.lit(f), F.col("target_path"), F.col("first_path"), F.col("attempts")).alias(name)
        for f, name in (("bad_patch", "bad_patch"), ("bad_patch_until_escalation", "bad_until_escalation"))
    ]
    return joined.select("id", "first_path", *gate)


@query(
    "F-35",
    over("file_tasks", """SELECT id, CASE WHEN attempts <= 2 THEN 'driver' ELSE 'escalation' END AS tier,
         coalesce(nullif(CASE WHEN attempts % 2 = 0 THEN '' ELSE type END, ''), 'raw-model') AS label FROM file_tasks"""),
)
def attempt_tiers(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("attempts") % 2 == 0, "").otherwise(F.col("type"))
    return R.file_tasks(spark, folder).select(
        "id", P.tier_of(F.col("attempts")).alias("tier"), P.model_label(label, F.lit("raw-model")).alias("label")
    )


@query(
    "T-06",
    over("file_tasks", """
SELECT job_id, target_path, CAST(position AS INTEGER) AS position FROM (
  SELECT job_id, target_path, row_number() OVER (PARTITION BY job_id ORDER BY order_index, id) AS position
  FROM file_tasks WHERE status IN ('failed', 'skipped')) WHERE position <= 3"""),
)
def first_failing(spark: SparkSession, folder: str) -> DataFrame:
    bad = R.file_tasks(spark, folder).filter(F.col("status").isin("failed", "skipped"))
    return T.first_k(bad, ["job_id"], ["order_index", "id"], 3).select("job_id", "target_path", "position")


@query(
    "W-04 T-05",
    over("file_tasks", """SELECT id, job_id, CAST((row_number() OVER (PARTITION BY job_id ORDER BY order_index, created_at, id) - 1) * 10 AS INTEGER) AS order_index
         FROM file_tasks"""),
)
def renumbered(spark: SparkSession, folder: str) -> DataFrame:
    return T.renumber(R.file_tasks(spark, folder), ["order_index", "created_at", "id"]).select("id", "job_id", "order_index")


# one row per path of a job, units of up to two neighbouring paths
_BATCH_SQL = """
, t AS (SELECT job_id, target_path AS path, min(order_index) AS order_index, arg_min(status, (order_index, created_at, id)) AS status,
               arg_min(type, (order_index, created_at, id)) AS type
        FROM file_tasks WHERE target_path IS NOT NULL GROUP BY ALL),
u AS (SELECT job_id, 'u' || CAST(order_index // 20 AS VARCHAR) AS unit_id, path FROM t WHERE order_index // 20 <> 1),
first AS (SELECT job_id, arg_min(path, (order_index, path)) AS first_path, min(order_index) AS first_order FROM t WHERE status = 'pending' GROUP BY job_id),
ok AS (SELECT u.job_id, u.unit_id, min(t.order_index) AS unit_order FROM u JOIN t USING (job_id, path) GROUP BY u.job_id, u.unit_id
       HAVING bool_and(t.status <> 'skipped') AND bool_or(t.status = 'pending')),
best AS (SELECT job_id, min(unit_order) AS unit_order, arg_min(unit_id, (unit_order, unit_id)) AS unit_id FROM ok GROUP BY job_id),
start AS (SELECT first.job_id, first.first_path AS path FROM first LEFT JOIN best USING (job_id) WHERE best.unit_id IS NULL OR unit_order > first_order
          UNION ALL
          SELECT first.job_id, u.path FROM first JOIN best USING (job_id) JOIN u USING (job_id, unit_id) WHERE unit_order <= first_order)
"""


def _batch_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    place = F.struct("order_index", "created_at", "id")
    tasks = R.file_tasks(spark, folder).filter("target_path IS NOT NULL").groupBy("job_id", "target_path").agg(
        F.min_by("status", place).alias("status"),
        F.min_by("type", place).alias("type"),
        F.min("order_index").alias("order_index"),
    )
    pair = F.floor(F.col("order_index") / 20)
    units = tasks.filter(pair != 1).select(
        "job_id", F.concat(F.lit("u"), pair.cast("string")).alias("unit_id"), F.col("target_path").alias("path")
    )
    return tasks.withColumn("owns_tests", F.substring("target_path", -4, 1) == "7"), units


@query("N-10", over("file_tasks", _BATCH_SQL + "SELECT job_id, path FROM start"))
def next_batches(spark: SparkSession, folder: str) -> DataFrame:
    return T.next_batch(*_batch_inputs(spark, folder))


@query(
    "N-11",
    over("file_tasks", _BATCH_SQL + """
, f AS (SELECT *, path LIKE '%7.py' AS owns FROM t),
s AS (SELECT job_id, bool_or(owns OR type = 'test_compat') AS settled FROM start JOIN f USING (job_id, path) GROUP BY job_id),
uo AS (SELECT job_id, unit_id, bool_or(owns) AS uowns FROM u JOIN f USING (job_id, path) GROUP BY ALL),
w AS (SELECT f.job_id, f.path, f.order_index, u.unit_id, f.owns OR coalesce(uo.uowns, false) AS brings
      FROM f JOIN s ON s.job_id = f.job_id AND NOT s.settled LEFT JOIN u ON u.job_id = f.job_id AND u.path = f.path
      LEFT JOIN uo ON uo.job_id = u.job_id AND uo.unit_id = u.unit_id
      WHERE f.status = 'pending' AND NOT EXISTS (SELECT 1 FROM start x WHERE x.job_id = f.job_id AND x.path = f.path)),
z AS (SELECT *, count(*) FILTER (brings) OVER (PARTITION BY job_id ORDER BY order_index, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
SELECT job_id, path FROM start UNION SELECT job_id, path FROM z WHERE before = 0
UNION SELECT z.job_id, u.path FROM z JOIN u USING (job_id, unit_id) WHERE before = 0"""),
)
def verifiable_batches(spark: SparkSession, folder: str) -> DataFrame:
    return T.verifiable_batch(*_batch_inputs(spark, folder))


# ---------------------------------------------------------------------------------- writes


@query(
    "K-01",
    """SELECT 'new-' || CAST(event_id AS VARCHAR) AS id, 'https://code.test/r' || CAST(user_id AS VARCHAR) AS repo_url,
       'flask_to_fastapi' AS migration_recipe, 'queued' AS status, CAST(user_id AS VARCHAR) AS user_id, ts AS created_at
       FROM events WHERE event_type = 'signup'""",
)
def enqueue(spark: SparkSession, folder: str) -> DataFrame:
    requests = R.table(spark, folder, "events").filter("event_type = 'signup'").select(
        F.concat(F.lit("new-"), R.text_of("event_id")).alias("id"),
        F.concat(F.lit("https://code.test/r"), R.text_of("user_id")).alias("repo_url"),
        F.lit("flask_to_fastapi").alias("migration_recipe"),
        R.text_of("user_id").alias("user_id"),
        F.col("ts").alias("created_at"),
    )
    return W.queued_jobs(requests)


_SPECS = """
, specs AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, path AS target_path FROM orders,
   LATERAL (SELECT unnest(['src/new.py', 'src/p' || CAST(o_orderkey % 10 AS VARCHAR) || '/m' || CAST(o_custkey AS VARCHAR) || '.py', NULL]) AS path))
"""


def _specs(spark: SparkSession, folder: str) -> DataFrame:
    guess = F.concat(F.lit("src/p"), (F.col("o_orderkey") % 10).cast("string"), F.lit("/m"), R.text_of("o_custkey"), F.lit(".py"))
    paths = F.array(F.lit("src/new.py"), guess, F.lit(None).cast("string"))
    return R.table(spark, folder, "orders").select(R.text_of("o_orderkey").alias("job_id"), F.explode(paths).alias("target_path"))


@query(
    "K-02",
    over("tasks", _SPECS + "SELECT job_id, target_path FROM specs WHERE job_id NOT IN (SELECT job_id FROM tasks WHERE parent_id IS NULL)"),
)
def plan_insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    return W.plan_if_absent(_specs(spark, folder), R.tasks(spark, folder))


@query(
    "K-03",
    over("tasks", _SPECS + """SELECT job_id, target_path FROM specs s WHERE NOT EXISTS (
         SELECT 1 FROM tasks t WHERE t.parent_id IS NULL AND t.job_id = s.job_id AND t.target_path IS NOT DISTINCT FROM s.target_path)"""),
)
def append_missing_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return W.append_missing(_specs(spark, folder), R.tasks(spark, folder))


@query(
    "K-05",
    over("jobs tasks", """
, a AS (SELECT job_id, arg_min(id, (created_at, id)) AS id, arg_min(status, (created_at, id)) AS status, arg_min(order_index, (created_at, id)) AS order_index
        FROM tasks WHERE parent_id IS NULL AND type = 'artifact_architect' GROUP BY job_id)
SELECT j.id AS job_id, coalesce(a.id, j.id || '-architect') AS id, coalesce(a.status, 'pending') AS status,
       coalesce(a.order_index, -20) AS order_index, a.id IS NULL AS created
FROM jobs j LEFT JOIN a ON a.job_id = j.id"""),
)
def architect_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return W.with_architect_task(R.jobs(spark, folder), R.tasks(spark, folder))


@query(
    "K-04",
    over("tasks", """
, patch AS (SELECT id, CASE WHEN attempts % 2 = 0 THEN 'done' END AS status, CASE WHEN attempts = 3 THEN 9 END AS attempts, attempts <> 1 AS cascade
            FROM tasks WHERE parent_id IS NULL AND attempts > 0)
SELECT t.id, t.parent_id, coalesce(d.status, p.status, t.status) AS status, coalesce(p.attempts, t.attempts) AS attempts
FROM tasks t LEFT JOIN patch p ON p.id = t.id LEFT JOIN patch d ON d.id = t.parent_id AND d.cascade AND d.status IS NOT NULL"""),
)
def task_patches(spark: SparkSession, folder: str) -> DataFrame:
    tasks = R.tasks(spark, folder)
    patches = tasks.filter("parent_id IS NULL AND attempts > 0").select(
        "id",
        F.when(F.col("attempts") % 2 == 0, "done").alias("status"),
        F.when(F.col("attempts") == 3, 9).alias("attempts"),
        (F.col("attempts") != 1).alias("cascade"),
    )
    return W.patched(tasks, patches, ["status", "attempts"]).select("id", "parent_id", "status", "attempts")


_ENDINGS = """
, e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts AS "at", CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status,
               CASE WHEN event_type = 'error' THEN repeat('x', 1990 + CAST(event_id % 30 AS INTEGER)) END AS error
        FROM events WHERE event_type IN ('error', 'purchase')),
l AS (SELECT job_id, max("at") AS "at", arg_max(status, "at") AS status, arg_max(coalesce(error, ''), "at") AS error FROM e GROUP BY job_id)
"""


@query(
    "K-06",
    over("jobs", _ENDINGS + """
SELECT j.id, coalesce(l.status, j.status) AS status, CASE WHEN l.job_id IS NULL THEN heartbeat_at END AS heartbeat_at,
       length(CASE WHEN l.job_id IS NULL THEN j.error ELSE substring(nullif(l.error, ''), 1, 2000) END) AS error_length,
       coalesce(l."at", updated_at) AS updated_at
FROM jobs j LEFT JOIN l ON l.job_id = j.id"""),
)
def job_endings(spark: SparkSession, folder: str) -> DataFrame:
    events = R.table(spark, folder, "events").filter(F.col("event_type").isin("error", "purchase"))
    failed = F.col("event_type") == "error"
    endings = events.select(
        R.text_of("user_id").alias("job_id"),
        F.col("ts").alias("at"),
        F.when(failed, "failed").otherwise("done").alias("status"),
        F.when(failed, F.repeat(F.lit("x"), (1990 + F.col("event_id") % 30).cast("int"))).alias("error"),
    )
    done = W.ended(R.jobs(spark, folder), endings)
    return done.select("id", "status", "heartbeat_at", F.length("error").cast("long").alias("error_length"), "updated_at")


@query(
    "K-11",
    over("users", """
, l AS (SELECT user_id + 100 AS github_id, 'login-' || CAST(event_id AS VARCHAR) AS login, ts FROM events),
n AS (SELECT github_id, arg_max(login, ts) AS login FROM l GROUP BY github_id)
SELECT coalesce(u.github_id, n.github_id) AS github_id, coalesce(u.id, 'gh-' || CAST(n.github_id AS VARCHAR)) AS id,
       coalesce(n.login, u.login) AS login, coalesce(u.role, 'user') AS role
FROM users u FULL JOIN n ON n.github_id = u.github_id"""),
)
def user_upsert(spark: SparkSession, folder: str) -> DataFrame:
    logins = R.table(spark, folder, "events").select(
        (F.col("user_id") + 100).alias("github_id"), F.concat(F.lit("login-"), R.text_of("event_id")).alias("login"), F.col("ts").alias("at")
    )
    return W.upserted_users(R.users(spark, folder), logins)


@query(
    "K-12",
    over("api_keys", """
, p AS (SELECT sha256('pk_' || CAST(event_id AS VARCHAR)) AS key_hash FROM events WHERE event_type = 'error'),
h AS (SELECT DISTINCT user_id FROM api_keys WHERE key_hash IN (SELECT key_hash FROM p))
SELECT id, user_id AS family_id, revoked OR user_id IN (SELECT user_id FROM h) AS revoked FROM api_keys"""),
)
def family_revoke(spark: SparkSession, folder: str) -> DataFrame:
    tokens = R.api_keys(spark, folder).select("id", F.col("user_id").alias("family_id"), F.col("key_hash").alias("token_hash"), "revoked")
    presented = R.table(spark, folder, "events").filter("event_type = 'error'").select(
        F.sha2(F.concat(F.lit("pk_"), R.text_of("event_id")), 256).alias("token_hash")
    )
    return W.revoked_families(tokens, presented).select("id", "family_id", "revoked")


_PINS = """
, o AS (SELECT 'p' || CAST(l_suppkey AS VARCHAR) AS path, 's' || CAST(l_partkey AS VARCHAR) AS symbol, min(l_returnflag) AS decision
        FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
n AS (SELECT 'p' || CAST(l_suppkey AS VARCHAR) AS path, 's' || CAST(l_partkey AS VARCHAR) AS symbol, max(l_linestatus) AS decision
      FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
"""


def _pins(spark: SparkSession, folder: str, where: str, decision) -> DataFrame:
    path = F.concat(F.lit("p"), R.text_of("l_suppkey")).alias("path")
    symbol = F.concat(F.lit("s"), R.text_of("l_partkey")).alias("symbol")
    return R.table(spark, folder, "lineitem").filter(where).groupBy(path, symbol).agg(decision.alias("decision"))


@query(
    "U-04",
    "WITH " + _PINS.lstrip().removeprefix(",") + """SELECT coalesce(o.path, n.path) AS path, coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.decision, n.decision) AS decision
       FROM o FULL JOIN n ON o.path = n.path AND o.symbol = n.symbol""",
)
def replan_pins(spark: SparkSession, folder: str) -> DataFrame:
    old = _pins(spark, folder, "l_linenumber <= 3", F.min("l_returnflag"))
    new = _pins(spark, folder, "l_linenumber >= 3", F.max("l_linestatus"))
    return W.merged_pins(old, new)


@query(
    "U-02 U-03",
    "WITH " + _PINS.lstrip().removeprefix(",") + """SELECT coalesce(o.path, n.path) AS path, count(o.symbol) FILTER (n.symbol IS NULL) AS missing,
              count(n.symbol) FILTER (o.symbol IS NULL) AS introduced, count(*) FILTER (o.symbol IS NOT NULL AND n.symbol IS NOT NULL) AS common
       FROM o FULL JOIN n ON o.path = n.path AND o.symbol = n.symbol GROUP BY 1""",
)
def symbol_set_changes(spark: SparkSession, folder: str) -> DataFrame:
    old = _pins(spark, folder, "l_linenumber <= 3", F.min("l_returnflag")).select("path", "symbol")
    new = _pins(spark, folder, "l_linenumber >= 3", F.max("l_linestatus")).select("path", "symbol")
    return S.set_changes(old, new, ["path"], "symbol")


@query(
    "U-06 F-40",
    over("runs corpus", "SELECT DISTINCT corpus_name FROM runs WHERE corpus_name NOT IN (SELECT name FROM corpus)"),
)
def unknown_corpus_names(spark: SparkSession, folder: str) -> DataFrame:
    known = R.corpus(spark, folder).select(F.col("name").alias("corpus_name"))
    return S.unknown_references(R.runs(spark, folder), known, "corpus_name")


@query(
    "F-40",
    over("file_tasks", """SELECT DISTINCT job_id, target_path AS path FROM file_tasks
         WHERE EXISTS (SELECT 1 FROM part WHERE target_path = 'src/p3/m' || CAST(p_partkey AS VARCHAR) || '.py')"""),
)
def existing_targets(spark: SparkSession, folder: str) -> DataFrame:
    present = R.table(spark, folder, "part").select(F.concat(F.lit("src/p3/m"), R.text_of("p_partkey"), F.lit(".py")).alias("path"))
    targets = R.file_tasks(spark, folder).select("job_id", F.col("target_path").alias("path")).distinct()
    return targets.join(present, "path", "left_semi").select("job_id", "path")


_VERSIONS = """
, v AS (SELECT CAST(l_suppkey AS VARCHAR) AS job_id, 'm' || CAST(l_partkey % 40 AS VARCHAR) AS path, l_orderkey * 10 + l_linenumber AS version,
               max(sha256(CAST(l_extendedprice AS VARCHAR))) AS content_hash FROM lineitem GROUP BY ALL),
b AS (SELECT CAST(l_suppkey AS VARCHAR) AS job_id, CAST(l_linenumber AS BIGINT) AS batch, 'm' || CAST(l_partkey % 40 AS VARCHAR) AS path,
             min(l_orderkey * 10 + l_linenumber) + 4000 AS version FROM lineitem GROUP BY ALL),
snap AS (SELECT b.job_id, b.batch, b.path, arg_max(v.content_hash, v.version) FILTER (v.version < b.version) AS content_hash,
                coalesce(bool_or(v.version < b.version), false) AS existed
         FROM b LEFT JOIN v ON v.job_id = b.job_id AND v.path = b.path GROUP BY b.job_id, b.batch, b.path)
"""


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    line = R.table(spark, folder, "lineitem").select(
        R.text_of("l_suppkey").alias("job_id"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 40).cast("string")).alias("path"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"),
        F.col("l_linenumber").cast("long").alias("batch"),
        F.sha2(F.col("l_quantity").cast("int").cast("string"), 256).alias("hash"),
    )
    versions = line.groupBy("job_id", "path", "version").agg(F.max("hash").alias("content_hash"))
    batches = line.groupBy("job_id", "batch", "path").agg((F.min("version") + 4000).alias("version"))
    return versions, batches


_VERSIONS = _VERSIONS.replace("CAST(l_extendedprice AS VARCHAR)", "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)")


@query("S-12 K-10", over("jobs", _VERSIONS + "SELECT * FROM snap"))
def checkpoint_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots saved as a version, saved again, and read back by the pointer."""
    from uuid import uuid4

    from ..session import stored, use_checkpoint_dir
    from ..sources import manifests

    # both versions are written from it
    rows = stored(W.snapshot_rows(*_versions(spark, folder)))
    place = f"{use_checkpoint_dir(spark)}/versions-{uuid4().hex}"
    manifests.save_version(rows.filter("batch < 3"), place, 1)
    manifests.save_version(rows, place, 2)
    return manifests.load_version(spark, place, rows.schema)


@query("K-10", over("jobs", _VERSIONS + "SELECT * FROM snap"))
def batch_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return W.snapshot_rows(*_versions(spark, folder))


@query(
    "K-10",
    over("jobs", _VERSIONS + """
, cur AS (SELECT job_id, path, arg_max(content_hash, version) AS content_hash FROM v GROUP BY ALL),
undo AS (SELECT job_id, path, arg_min(coalesce(content_hash, ''), batch) AS content_hash, arg_min(existed, batch) AS existed FROM snap WHERE batch >= 6 GROUP BY ALL)
SELECT cur.job_id, cur.path, CASE WHEN undo.path IS NULL THEN cur.content_hash ELSE undo.content_hash END AS content_hash
FROM cur LEFT JOIN undo ON undo.job_id = cur.job_id AND undo.path = cur.path WHERE undo.path IS NULL OR undo.existed"""),
)
def restored_files(spark: SparkSession, folder: str) -> DataFrame:
    versions, batches = _versions(spark, folder)
    snapshot = W.snapshot_rows(versions, batches)
    current = versions.groupBy("job_id", "path").agg(F.max_by("content_hash", "version").alias("content_hash"))
    failed = batches.filter("batch >= 6").select("job_id", "batch").distinct()
    return W.restored(current, snapshot, failed)


# -------------------------------------------------------------------------------- accounts


@query(
    "F-11",
    over("api_keys", "SELECT id, created_at FROM api_keys WHERE user_id = '7' AND NOT revoked"),
)
def active_api_keys(spark: SparkSession, folder: str) -> DataFrame:
    return A.active_keys(R.api_keys(spark, folder), "7").select("id", "created_at")


@query(
    "J-17 X-06",
    over("api_keys users", """
, p AS (SELECT event_id, sha256('pk_' || CAST(event_id AS VARCHAR)) AS key_hash FROM events)
SELECT p.key_hash, CASE WHEN u.id IS NOT NULL THEN k.user_id END AS user_id, u.login, u.role
FROM p LEFT JOIN api_keys k ON k.key_hash = p.key_hash AND NOT k.revoked LEFT JOIN users u ON u.id = k.user_id AND NOT u.disabled"""),
)
def api_key_owners(spark: SparkSession, folder: str) -> DataFrame:
    presented = R.table(spark, folder, "events").select(
        F.sha2(F.concat(F.lit("pk_"), R.text_of("event_id")), 256).alias("key_hash")
    )
    return A.key_owner(presented, R.api_keys(spark, folder), R.users(spark, folder))


@query(
    "F-42",
    over("api_keys users", """
, c AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'error' THEN 'oauth-state' END AS purpose, ts + INTERVAL 15 DAY AS expires_at FROM events),
r AS (SELECT event_id, event_type = 'purchase' AS admin_only,
      CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Bearer   ' WHEN 2 THEN 'Basic at_' || event_id WHEN 3 THEN 'Bearer at_' || event_id
           WHEN 4 THEN 'Bearer  at_' || event_id || ' ' ELSE 'Bearer pk_' || event_id END AS header FROM events),
t AS (SELECT *, CASE WHEN header LIKE 'Bearer %' THEN trim(substr(header, 8)) ELSE '' END AS token FROM r),
m AS (SELECT t.*, CASE WHEN token LIKE 'pk\\_%' ESCAPE '\\' THEN k.user_id ELSE c.user_id END AS uid, NOT k.revoked AS key_ok,
      coalesce(c.purpose, '') <> 'oauth-state' AND c.expires_at > TIMESTAMP '2024-01-31' AS token_ok
      FROM t LEFT JOIN api_keys k ON k.key_hash = sha256(token) LEFT JOIN c ON 'at_' || c.event_id = token),
j AS (SELECT m.*, CASE WHEN token = '' THEN 'no_token'
             WHEN token LIKE 'pk\\_%' ESCAPE '\\' AND (NOT coalesce(key_ok, false) OR coalesce(u.disabled, true)) THEN 'bad_key'
             WHEN token NOT LIKE 'pk\\_%' ESCAPE '\\' AND NOT coalesce(token_ok, false) THEN 'bad_token'
             WHEN coalesce(u.disabled, true) THEN 'bad_user' WHEN admin_only AND u.role <> 'admin' THEN 'not_admin' ELSE 'passed' END AS reason
      FROM m LEFT JOIN users u ON u.id = m.uid)
SELECT event_id AS request_id, CASE WHEN reason IN ('passed', 'not_admin') THEN uid END AS user_id,
       CASE reason WHEN 'passed' THEN 200 WHEN 'not_admin' THEN 403 ELSE 401 END AS status, reason FROM j"""),
)
def request_gates(spark: SparkSession, folder: str) -> DataFrame:
    events = R.table(spark, folder, "events")
    number, kind = R.text_of("event_id"), F.col("event_id") % 6
    header = (
        F.when(kind == 1, "Bearer   ").when(kind == 2, F.concat(F.lit("Basic at_"), number)).when(kind == 3, F.concat(F.lit("Bearer at_"), number))
        .when(kind == 4, F.concat(F.lit("Bearer  at_"), number, F.lit(" "))).when(kind == 5, F.concat(F.lit("Bearer pk_"), number))
    )
    requests = events.select(F.col("event_id").alias("request_id"), header.alias("header"), (F.col("event_type") == "purchase").alias("admin_only"))
    claims = events.select(
        F.sha2(F.concat(F.lit("at_"), number), 256).alias("token_hash"), R.text_of("user_id").alias("user_id"),
        F.when(F.col("event_type") == "error", "oauth-state").alias("purpose"),
        (F.col("ts") + F.make_dt_interval(days=F.lit(15))).alias("expires_at"),
    )
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return A.request_gate(requests, R.api_keys(spark, folder), claims, R.users(spark, folder), now)


@query(
    "J-18 Q-11",
    over("api_keys users", """
, p AS (SELECT event_id, sha256('pk_' || CAST(event_id AS VARCHAR)) AS key_hash FROM events)
SELECT p.event_id, CASE WHEN k.key_hash IS NULL THEN 'unknown' WHEN k.revoked THEN 'reuse'
       WHEN k.created_at + INTERVAL 1000 DAY <= TIMESTAMP '1998-06-01' THEN 'expired'
       WHEN coalesce(u.disabled, true) THEN 'no_user' ELSE 'rotated' END AS outcome
FROM p LEFT JOIN api_keys k ON k.key_hash = p.key_hash LEFT JOIN users u ON u.id = k.user_id"""),
)
def refresh_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    presented = R.table(spark, folder, "events").select(
        "event_id", F.sha2(F.concat(F.lit("pk_"), R.text_of("event_id")), 256).alias("key_hash")
    )
    tokens = R.api_keys(spark, folder).select("key_hash", "user_id", "revoked", "created_at", F.lit(True).alias("known"))
    people = R.users(spark, folder).select(F.col("id").alias("user_id"), "disabled")
    expires = F.col("created_at") + F.make_dt_interval(days=F.lit(1000))
    outcome = A.token_outcome(
        F.col("known"), F.col("revoked"), expires, F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), F.col("disabled")
    )
    owned = tokens.join(people, "user_id", "left")
    return presented.join(owned, "key_hash", "left").select("event_id", outcome.alias("outcome"))


@query(
    "Q-10",
    """
WITH u AS (SELECT CAST(user_id AS VARCHAR) AS family_id, event_id AS seq, event_id // 400 + CASE WHEN event_type = 'error' THEN -1 ELSE 0 END + user_id % 3 AS generation FROM events),
m AS (SELECT *, max(generation) OVER (PARTITION BY family_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM u),
k AS (SELECT family_id, min(seq) AS killed FROM m WHERE generation <= newest GROUP BY family_id)
SELECT m.family_id, seq, generation, CASE WHEN seq >= killed THEN 'reuse' ELSE 'rotated' END AS outcome
FROM m LEFT JOIN k ON k.family_id = m.family_id""",
)
def token_reuse(spark: SparkSession, folder: str) -> DataFrame:
    late = F.when(F.col("event_type") == "error", -1).otherwise(0)
    uses = R.table(spark, folder, "events").select(
        R.text_of("user_id").alias("family_id"),
        F.col("event_id").alias("seq"),
        (F.floor(F.col("event_id") / 400) + late + F.col("user_id") % 3).alias("generation"),
    )
    return A.token_uses(uses)
