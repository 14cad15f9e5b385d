"""The domain relations, derived from the given tables.

Each relation is stated twice: as a DataFrame for the engine and as SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_TASK = 20_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows over all cores, before each of them grows into a long text that Python parses.

    Real source tables come in enough splits; these rows come from one small file.  The number of tasks grows with the
    rows, so what one task holds does not.  The narrow rows are cut off here: a filter on the texts would otherwise go below
    the exchange, to the one task that reads the file, and every branch of a query would read and deal the rows again.
    """
    return cut_lineage(df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))))


def seconds(value: Column) -> Column:
    return F.make_dt_interval(secs=value)


def text_of(column: str) -> Column:
    return F.col(column).cast("string")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    created = F.col("o_orderdate") + seconds(key % 86400)
    rejected = (
        F.when(key % 5 == 0, "Artifact architecture rejected: must declare at least one export")
        .when(key % 5 == 1, "response is not strict JSON")
        .when(key % 5 == 2, "capability requires exactly one owner artifact, got 0")
        .when(key % 5 == 3, "path forbidden by policy")
        .otherwise("engine stopped")
    )
    status = (
        F.when(F.col("o_orderstatus") == "O", "queued")
        .when(F.col("o_orderstatus") == "P", "running")
        .when(key % 8 == 0, "failed")
        .otherwise("done")
    )
    return table(spark, folder, "orders").select(
        text_of("o_orderkey").alias("id"),
        F.concat(F.lit("https://code.test/r"), (F.col("o_custkey") % 50).cast("string")).alias("repo_url"),
        F.col("o_orderpriority").alias("migration_recipe"),
        status.alias("status"),
        F.when(key % 97 != 0, text_of("o_custkey")).alias("user_id"),
        F.when((status == "running") & (key % 7 != 0), created + seconds(key % 40)).alias("heartbeat_at"),
        F.when(status == "failed", rejected).alias("error"),
        created.alias("created_at"),
        (created + seconds((key * 7) % 1000)).alias("updated_at"),
    )


JOBS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id,
       'https://code.test/r' || CAST(o_custkey % 50 AS VARCHAR) AS repo_url,
       o_orderpriority AS migration_recipe,
       status,
       CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS user_id,
       CASE WHEN status = 'running' AND o_orderkey % 7 <> 0
            THEN created + to_seconds(o_orderkey % 40) END AS heartbeat_at,
       CASE WHEN status = 'failed' THEN CASE o_orderkey % 5
            WHEN 0 THEN 'Artifact architecture rejected: must declare at least one export'
            WHEN 1 THEN 'response is not strict JSON'
            WHEN 2 THEN 'capability requires exactly one owner artifact, got 0'
            WHEN 3 THEN 'path forbidden by policy'
            ELSE 'engine stopped' END END AS error,
       created AS created_at,
       created + to_seconds((o_orderkey * 7) % 1000) AS updated_at
FROM (SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS created,
             CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running'
                  WHEN o_orderkey % 8 = 0 THEN 'failed' ELSE 'done' END AS status
      FROM orders)
"""


def line_id() -> Column:
    """Line items have no key of their own; these columns together are unique."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string"))


def file_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """One top-level task per line item."""
    part = F.col("l_partkey")
    kind = (
        F.when(part % 11 == 0, "artifact_architect")
        .when(part % 11 == 1, "test_compat")
        .when(part % 11 == 2, "test_harness")
        .otherwise("file_migration")
    )
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = (
        F.when(flag == "R", "done")
        .when((flag == "A") & (line == "F"), "skipped")
        .when(flag == "A", "failed")
        .when(line == "F", "running")
        .otherwise("pending")
    )
    path = F.concat(
        F.lit("src/p"), (F.col("l_suppkey") % 10).cast("string"), F.lit("/m"), text_of("l_partkey"), F.lit(".py")
    )
    return table(spark, folder, "lineitem").select(
        line_id().alias("id"),
        text_of("l_orderkey").alias("job_id"),
        F.lit(None).cast("string").alias("parent_id"),
        kind.alias("type"),
        F.when(kind != "artifact_architect", path).alias("target_path"),
        status.alias("status"),
        (F.col("l_quantity").cast("int") % 4).alias("attempts"),
        (F.col("l_linenumber") * 10).alias("order_index"),
        F.when(status.isin("failed", "skipped"), F.concat(F.lit("last error: "), F.col("l_linestatus"))).alias("error"),
        (F.col("l_quantity").cast("int") % 3).alias("subtask_count"),
        F.col("l_shipdate").alias("created_at"),
    )


FILE_TASKS_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS id,
       CAST(l_orderkey AS VARCHAR) AS job_id, CAST(NULL AS VARCHAR) AS parent_id, kind AS type,
       CASE WHEN kind <> 'artifact_architect'
            THEN 'src/p' || CAST(l_suppkey % 10 AS VARCHAR) || '/m' || CAST(l_partkey AS VARCHAR) || '.py' END AS target_path,
       status, CAST(l_quantity AS INTEGER) % 4 AS attempts, l_linenumber * 10 AS order_index,
       CASE WHEN status IN ('failed', 'skipped') THEN 'last error: ' || l_linestatus END AS error,
       CAST(l_quantity AS INTEGER) % 3 AS subtask_count, l_shipdate AS created_at
FROM (SELECT *, CASE l_partkey % 11 WHEN 0 THEN 'artifact_architect' WHEN 1 THEN 'test_compat'
                     WHEN 2 THEN 'test_harness' ELSE 'file_migration' END AS kind,
             CASE WHEN l_returnflag = 'R' THEN 'done'
                  WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'skipped'
                  WHEN l_returnflag = 'A' THEN 'failed'
                  WHEN l_linestatus = 'F' THEN 'running' ELSE 'pending' END AS status
      FROM lineitem)
"""


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """File tasks and their subtasks in one relation, as the task table stores them."""
    top = file_tasks(spark, folder)
    child = top.filter("subtask_count > 0").select(
        "*", F.explode(F.sequence(F.lit(1), F.col("subtask_count"))).alias("n")
    )
    children = child.select(
        F.concat(F.col("id"), F.lit("#"), F.col("n").cast("string")).alias("id"),
        "job_id",
        F.col("id").alias("parent_id"),
        F.lit("subtask").alias("type"),
        F.lit(None).cast("string").alias("target_path"),
        "status",
        "attempts",
        (F.col("order_index") + F.col("n")).alias("order_index"),
        "error",
        F.lit(0).alias("subtask_count"),
        "created_at",
    )
    return top.unionByName(children)


TASKS_SQL = """
SELECT * FROM file_tasks
UNION ALL
SELECT id || '#' || CAST(n AS VARCHAR), job_id, id, 'subtask', NULL, status, attempts,
       order_index + CAST(n AS INTEGER), error, 0, created_at
FROM file_tasks, LATERAL (SELECT unnest(range(1, subtask_count + 1)) AS n)
"""


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


_ACTIONS = {
    "view": "migrate",
    "click": "contract_repair",
    "signup": "architect",
    "purchase": "format_repair",
    "error": "rollback_regenerate",
}


def task_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks with their attempts as a nested array, zero to three attempts each."""
    action = F.create_map(*[F.lit(x) for pair in _ACTIONS.items() for x in pair])[F.col("event_type")]
    base = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "value", "event_type", props_k().alias("k"), action.alias("action")
    )

    def attempt(i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("attempt"),
            F.when(i > 2, "escalation").otherwise("driver").alias("tier"),
            F.concat(F.lit("model-"), (F.col("event_id") % 2).cast("string")).alias("model"),
            F.when(i == 1, F.col("action")).otherwise("contract_repair").alias("action"),
            F.when((F.col("k") + i) % 3 == 0, "runtime_targeted").otherwise("batch").alias("scope"),
            (F.col("k") * i).cast("long").alias("prompt_tokens"),
            (F.col("k") + i).cast("long").alias("completion_tokens"),
            F.when((F.col("k") + i) % 5 != 0, F.col("value") * i / 1000).alias("cost_usd"),
            F.when((F.col("k") + i) % 4 == 0, F.concat(F.lit("diff "), F.col("k").cast("string"), F.lit("/"), i.cast("string")))
            .otherwise("")
            .alias("failing_diff"),
        )

    n = F.col("k") % 4
    log = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), attempt)).otherwise(F.array().cast(
        "array<struct<attempt:int,tier:string,model:string,action:string,scope:string,prompt_tokens:bigint,"
        "completion_tokens:bigint,cost_usd:double,failing_diff:string>>"
    ))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("k") % 3 == 0, "skipped").otherwise("done")
    return base.select(
        text_of("event_id").alias("id"),
        text_of("user_id").alias("job_id"),
        F.when(F.col("k") % 10 == 0, "artifact_architect").otherwise("file_migration").alias("type"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        log.alias("attempts_log"),
    )


# one row per attempt
ATTEMPTS_SQL = """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS job_id,
       CASE WHEN k % 10 = 0 THEN 'artifact_architect' ELSE 'file_migration' END AS type,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN k % 3 = 0 THEN 'skipped' ELSE 'done' END AS status,
       ts AS created_at, CAST(i AS INTEGER) AS attempt,
       CASE WHEN i > 2 THEN 'escalation' ELSE 'driver' END AS tier,
       'model-' || CAST(event_id % 2 AS VARCHAR) AS model,
       CASE WHEN i > 1 THEN 'contract_repair' ELSE CASE event_type WHEN 'view' THEN 'migrate' WHEN 'click' THEN 'contract_repair'
            WHEN 'signup' THEN 'architect' WHEN 'purchase' THEN 'format_repair' ELSE 'rollback_regenerate' END END AS action,
       CASE WHEN (k + i) % 3 = 0 THEN 'runtime_targeted' ELSE 'batch' END AS scope,
       CAST(k * i AS BIGINT) AS prompt_tokens, CAST(k + i AS BIGINT) AS completion_tokens,
       CASE WHEN (k + i) % 5 <> 0 THEN value * i / 1000 END AS cost_usd,
       CASE WHEN (k + i) % 4 = 0 THEN 'diff ' || CAST(k AS VARCHAR) || '/' || CAST(i AS VARCHAR) ELSE '' END AS failing_diff
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
     LATERAL (SELECT unnest(range(1, k % 4 + 1)) AS i)
"""

TASK_LOGS_SQL = """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS job_id,
       CASE WHEN k % 10 = 0 THEN 'artifact_architect' ELSE 'file_migration' END AS type,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN k % 3 = 0 THEN 'skipped' ELSE 'done' END AS status,
       ts AS created_at
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def recovery_actions(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        text_of("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        F.when(kind == "error", "behavioral")
        .when(kind == "click", "crash_batch")
        .when(kind == "view", "contract_failure")
        .when(kind == "signup", "behavioral_no_progress_diagnostic")
        .otherwise("no_progress")
        .alias("classification"),
        F.concat(F.lit("f"), (props_k() % 7).cast("string")).alias("fingerprint"),
        (kind != "view").alias("budget_charged"),
        F.col("value").alias("cost_usd"),
    )


RECOVERY_SQL = """
SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts AS "at",
       CASE event_type WHEN 'error' THEN 'behavioral' WHEN 'click' THEN 'crash_batch' WHEN 'view' THEN 'contract_failure'
            WHEN 'signup' THEN 'behavioral_no_progress_diagnostic' ELSE 'no_progress' END AS classification,
       'f' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) AS fingerprint,
       event_type <> 'view' AS budget_charged, value AS cost_usd
FROM events
"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One evaluation run per job; counts come from the job's line items."""
    line = table(spark, folder, "lineitem")
    per_job = line.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.count("*").cast("int").alias("tests_total"),
        F.count_if(F.col("l_linestatus") == "F").cast("int").alias("tests_passed"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("tasks_done"),
        F.count_if(F.col("l_returnflag") == "A").cast("int").alias("tasks_skipped"),
        F.max("l_linenumber").alias("recover_visits"),
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    joined = table(spark, folder, "orders").join(per_job, F.col("o_orderkey") == F.col("key"), "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    total, passed, done = zero("tests_total"), zero("tests_passed"), zero("tasks_done")
    clean = (total > 0) & (passed * 2 >= total)
    status = (
        F.when(key % 13 == 0, "timeout").when(key % 8 == 0, "error").when(clean, "green").otherwise("red")
    )
    return joined.select(
        text_of("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "grid-replay-low")
        .otherwise(F.concat(F.lit("grid-"), F.substring("o_orderpriority", 1, 1)))
        .alias("suite"),
        F.concat(F.lit("NATION_"), (customer % 25).cast("string")).alias("corpus_name"),
        F.when(F.col("o_orderstatus") == "F", "baseline")
        .when(F.col("o_orderstatus") == "O", "bad_patch")
        .otherwise("integration_only")
        .alias("scenario"),
        (key % 3 + 1).cast("int").alias("k_index"),
        F.concat(F.lit("driver-"), (customer % 2).cast("string")).alias("driver_model"),
        status.alias("status"),
        total.alias("tests_total"),
        passed.alias("tests_passed"),
        total.alias("tasks_total"),
        done.alias("tasks_done"),
        zero("tasks_skipped").alias("tasks_skipped"),
        zero("recover_visits").alias("recover_visits"),
        (key % 4).cast("int").alias("recover_budget_used"),
        (key % 2).cast("int").alias("escalation_attempted"),
        F.when(status == "green", key % 2).otherwise(0).cast("int").alias("escalation_rescued"),
        (key % 5 / 4).alias("oracle_integrity_rate"),
        (key % 3).cast("int").alias("no_progress_retries"),
        (key % 9).cast("int").alias("llm_calls"),
        (F.col("o_totalprice") / 100000).alias("cost_usd"),
        ((key * 7) % 997 / 7).alias("wall_seconds"),
        (F.col("o_orderdate") + seconds(key % 86400)).alias("created_at"),
    )


RUNS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'grid-replay-low' ELSE 'grid-' || substring(o_orderpriority, 1, 1) END AS suite,
       'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS corpus_name,
       CASE o_orderstatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'bad_patch' ELSE 'integration_only' END AS scenario,
       CAST(o_orderkey % 3 + 1 AS INTEGER) AS k_index, 'driver-' || CAST(o_custkey % 2 AS VARCHAR) AS driver_model,
       status, total AS tests_total, passed AS tests_passed, total AS tasks_total, done AS tasks_done,
       skipped AS tasks_skipped, visits AS recover_visits, CAST(o_orderkey % 4 AS INTEGER) AS recover_budget_used,
       CAST(o_orderkey % 2 AS INTEGER) AS escalation_attempted,
       CAST(CASE WHEN status = 'green' THEN o_orderkey % 2 ELSE 0 END AS INTEGER) AS escalation_rescued,
       o_orderkey % 5 / 4 AS oracle_integrity_rate, CAST(o_orderkey % 3 AS INTEGER) AS no_progress_retries,
       CAST(o_orderkey % 9 AS INTEGER) AS llm_calls, o_totalprice / 100000 AS cost_usd,
       (o_orderkey * 7) % 997 / 7 AS wall_seconds, o_orderdate + to_seconds(o_orderkey % 86400) AS created_at
FROM (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'timeout' WHEN o_orderkey % 8 = 0 THEN 'error'
                     WHEN total > 0 AND passed * 2 >= total THEN 'green' ELSE 'red' END AS status
      FROM (SELECT o.*, CAST(coalesce(n, 0) AS INTEGER) AS total, CAST(coalesce(p, 0) AS INTEGER) AS passed,
                   CAST(coalesce(d, 0) AS INTEGER) AS done, CAST(coalesce(s, 0) AS INTEGER) AS skipped,
                   coalesce(v, 0) AS visits
            FROM orders o LEFT JOIN (
              SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS p,
                     count(*) FILTER (l_returnflag = 'R') AS d, count(*) FILTER (l_returnflag = 'A') AS s,
                     max(l_linenumber) AS v
              FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey))
"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus entries; the manifest leaves out the last three nations."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return (
        nation.filter("n_nationkey < 22")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("name"), F.lower("r_name").alias("tier"))
    )


CORPUS_SQL = """
SELECT n_name AS name, lower(r_name) AS tier FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 22
"""


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        text_of("c_custkey").alias("id"),
        F.col("c_custkey").alias("github_id"),
        F.col("c_name").alias("login"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("member").alias("role"),
        (F.col("c_acctbal") < 0).alias("disabled"),
    )


USERS_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS github_id, c_name AS login,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'member' END AS role, c_acctbal < 0 AS disabled FROM customer
"""


def api_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        text_of("o_orderkey").alias("id"),
        text_of("o_custkey").alias("user_id"),
        F.sha2(F.concat(F.lit("pk_"), text_of("o_orderkey")), 256).alias("key_hash"),
        (F.col("o_orderstatus") == "O").alias("revoked"),
        F.col("o_orderdate").alias("created_at"),
    )


API_KEYS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
       sha256('pk_' || CAST(o_orderkey AS VARCHAR)) AS key_hash, o_orderstatus = 'O' AS revoked, o_orderdate AS created_at
FROM orders
"""


def repo_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the non-source files of a repository; ``source`` names the repository."""
    key = F.col("doc_id")
    name = (
        F.when(key % 23 == 0, F.concat(F.lit(".env."), text_of("doc_id")))
        .when(key % 29 == 0, F.concat(F.lit("id_rsa_"), text_of("doc_id")))
        .when(key % 31 == 0, F.concat(F.lit("notes"), text_of("doc_id"), F.lit(".PEM")))
        .when(key % 4 == 0, F.concat(F.lit("t"), text_of("doc_id"), F.lit(".html")))
        .when(key % 4 == 1, F.concat(F.lit("q"), text_of("doc_id"), F.lit(".SQL")))
        .when(key % 4 == 2, F.concat(F.lit("m"), text_of("doc_id"), F.lit(".py")))
        .otherwise(F.concat(F.lit("r"), text_of("doc_id"), F.lit(".bin")))
    )
    return table(spark, folder, "documents").select(
        F.col("source").alias("repo"),
        F.concat(F.when(key % 41 == 0, F.lit(".git/")).otherwise(F.concat(F.col("lang"), F.lit("/"))), name).alias("path"),
        "text",
    )


REPO_TEXTS_SQL = """
SELECT source AS repo, (CASE WHEN doc_id % 41 = 0 THEN '.git/' ELSE lang || '/' END) ||
       (CASE WHEN doc_id % 23 = 0 THEN '.env.' || CAST(doc_id AS VARCHAR)
             WHEN doc_id % 29 = 0 THEN 'id_rsa_' || CAST(doc_id AS VARCHAR)
             WHEN doc_id % 31 = 0 THEN 'notes' || CAST(doc_id AS VARCHAR) || '.PEM'
             WHEN doc_id % 4 = 0 THEN 't' || CAST(doc_id AS VARCHAR) || '.html'
             WHEN doc_id % 4 = 1 THEN 'q' || CAST(doc_id AS VARCHAR) || '.SQL'
             WHEN doc_id % 4 = 2 THEN 'm' || CAST(doc_id AS VARCHAR) || '.py'
             ELSE 'r' || CAST(doc_id AS VARCHAR) || '.bin' END) AS path, text
FROM documents
"""

# name -> (relations it is built from, SQL)
RELATION_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "jobs": ((), JOBS_SQL),
    "file_tasks": ((), FILE_TASKS_SQL),
    "tasks": (("file_tasks",), TASKS_SQL),
    "attempts": ((), ATTEMPTS_SQL),
    "task_logs": ((), TASK_LOGS_SQL),
    "recovery_actions": ((), RECOVERY_SQL),
    "runs": ((), RUNS_SQL),
    "corpus": ((), CORPUS_SQL),
    "users": ((), USERS_SQL),
    "api_keys": ((), API_KEYS_SQL),
    "repo_texts": ((), REPO_TEXTS_SQL),
}


# ------------------------------------------------------------------------- source files

_FACTORY = '''from flask import Flask
from . import db
from .m2 import bp

def create_app(config=None):
    app = Flask(__name__)
    app.config["KEY_@brand"] = config
    db.init_app(app)
    app.register_blueprint(bp)
    return app
'''
_RESOURCE = '''from flask import g, current_app

def get_db(name, timeout=1):
    return g.db

def init_app(app):
    app.teardown_appcontext(close_db)

def close_db(error=None):
    pass
'''
_ROUTER = '''from flask import Blueprint, request
from .db import get_db
from app.m@next import helper_@next

bp = Blueprint("m@j", __name__)

@bp.route("/x@j")
def view_@j(a, b=2):
    conn = get_db("@brand")
    if request.args:
        return flash_message(a)
    return helper_@next(a)

def helper_@j(x, *, flag=None):
    return x
'''
_PLAIN = '''import os

class Store@j:
    limit: int = @size

    def __init__(self, root):
        self.root = root

    @property
    def name(self):
        return "@name"

    def rows(self):
        yield os.path.join(self.root, self.name)
'''
_CONFTEST = '''import pytest
from app import create_app

@pytest.fixture
def client():
    app = create_app()
    yield app.test_client()
'''
_TEST = '''import pytest
from flask import g, request as req, jsonify

def test_get(client):
    assert client.get("/x2").status_code == 200
    assert client.get("/x3").get_json() == {"n": @size}

class TestBad:
    def test_raises(self, client):
        with pytest.raises(ValueError):
            client.get("/bad")
'''
_BROKEN = '''def broken(:
    pass
'''
FILES_PER_REPO = 20


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty source files per repository, one per part, written out by Spark from the part's row.

    0 application factory, 1 resource module, 2-12 routers that import the next one, 13-15 plain
    modules, 16 conftest, 17-18 tests, 19 a file that does not parse.
    """
    j = (F.col("p_partkey") % FILES_PER_REPO).cast("int")
    number = j.cast("string")
    path = (
        F.when(j == 0, "src/app/__init__.py")
        .when(j == 1, "src/app/db.py")
        .when(j <= 12, F.concat(F.lit("src/app/m"), number, F.lit(".py")))
        .when(j <= 15, F.concat(F.lit("src/app/util"), number, F.lit(".py")))
        .when(j == 16, "tests/conftest.py")
        .when(j <= 18, F.concat(F.lit("tests/test_m"), number, F.lit(".py")))
        .otherwise("src/app/broken.py")
    )
    template = (
        F.when(j == 0, _FACTORY)
        .when(j == 1, _RESOURCE)
        .when(j <= 12, _ROUTER)
        .when(j <= 15, _PLAIN)
        .when(j == 16, _CONFTEST)
        .when(j <= 18, _TEST)
        .otherwise(_BROKEN)
    )
    following = F.when(j == 12, 2).otherwise(j + 1).cast("string")
    text = template
    for mark, value in (
        ("@next", following), ("@j", number), ("@brand", F.translate("p_brand", "#", "_")),
        ("@size", F.col("p_size").cast("string")), ("@name", F.col("p_name")),
    ):
        text = F.replace(text, F.lit(mark), value)
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return spread(parts).select(
        F.floor(F.col("p_partkey") / FILES_PER_REPO).alias("repo_no"),
        j.alias("j"),
        path.alias("path"),
        text.alias("text"),
        "p_brand",
        "p_size",
    ).select(F.concat(F.lit("r"), F.col("repo_no").cast("string")).alias("repo"), "path", "text", "j", "p_brand", "p_size")


SOURCE_SQL = """
SELECT 'r' || CAST(p_partkey // 20 AS VARCHAR) AS repo, CAST(p_partkey % 20 AS INTEGER) AS j, p_brand, p_size,
       CASE WHEN p_partkey % 20 = 0 THEN 'src/app/__init__.py' WHEN p_partkey % 20 = 1 THEN 'src/app/db.py'
            WHEN p_partkey % 20 <= 12 THEN 'src/app/m' || CAST(p_partkey % 20 AS VARCHAR) || '.py'
            WHEN p_partkey % 20 <= 15 THEN 'src/app/util' || CAST(p_partkey % 20 AS VARCHAR) || '.py'
            WHEN p_partkey % 20 = 16 THEN 'tests/conftest.py'
            WHEN p_partkey % 20 <= 18 THEN 'tests/test_m' || CAST(p_partkey % 20 AS VARCHAR) || '.py'
            ELSE 'src/app/broken.py' END AS path,
       CASE WHEN p_partkey % 20 = 12 THEN 2 ELSE CAST(p_partkey % 20 + 1 AS INTEGER) END AS nxt
FROM part
"""
RELATION_SQL["source_files"] = ((), SOURCE_SQL)
