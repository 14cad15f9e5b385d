"""Queries over proposals, replies, reports and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code_facts as C
from ..operators import contracts as K
from ..operators import evaluation as E
from ..operators import migration_plan as M
from ..operators import proposals as X
from ..operators import seams as W
from ..session import cut_lineage
from ..sources import job_reports as J
from ..sources import sinks as S
from . import relations as R
from .catalogue import growing, over
from .evaluation import _METRICS_SQL
from .code_queries import _files, _pins


@growing("X-14 X-15 N-06", """
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS plan_id, event_id % 12 AS m FROM events)
SELECT plan_id, CAST(CASE WHEN m IN (1, 2, 3) THEN NULL ELSE 0 END AS INTEGER) AS item,
  CASE m WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_a_list' WHEN 3 THEN 'too_many_artifacts' WHEN 4 THEN 'path_unsafe' WHEN 5 THEN 'no_exports' WHEN 6 THEN 'role_not_identifier'
    WHEN 7 THEN 'unknown_consumer' WHEN 8 THEN 'path_exists' WHEN 9 THEN 'dependency_cycle' WHEN 10 THEN 'signature_name' WHEN 11 THEN 'purpose_empty' END AS rule
FROM e WHERE m > 0
UNION ALL SELECT plan_id, 1, 'dependency_cycle' FROM e WHERE m = 9""")
def plan_violations(spark: SparkSession, folder: str) -> DataFrame:
    """A good plan in every twelfth row, the others each broken in one way."""
    m = F.col("event_id") % 12
    good = (
        '{"path": "src/app/db2.py", "role": "support", "purpose": "p @", "instructions": "do", "capabilities": ["database"], '
        '"exports": [{"name": "get", "kind": "function", "signature": "def get(x)", "members": []}], "consumers": ["src/a.py"], "depends_on": []}'
    )
    changes = {
        4: ('"src/app/db2.py"', '"../db2.py"'), 5: ('[{"name": "get", "kind": "function", "signature": "def get(x)", "members": []}]', "[]"),
        6: ('"support"', '"not a name"'), 7: ('["src/a.py"]', '["src/other.py"]'), 8: ("src/app/db2.py", "src/app/old.py"),
        10: ("def get(x)", "def other(x)"), 11: ('"p @"', '"  "'),
    }
    first = F.lit(good)
    for number, (before, after) in changes.items():
        first = F.when(m == number, F.lit(good.replace(before, after))).otherwise(first)
    looped = good.replace('"depends_on": []', '"depends_on": ["src/app/y.py"]')
    back = good.replace("db2.py", "y.py").replace('"depends_on": []', '"depends_on": ["src/app/db2.py"]')
    text = (
        F.when(m == 1, F.lit("[{'path': 1}"))
        .when(m == 2, F.lit(good))
        .when(m == 3, F.lit("[" + ", ".join(good.replace("db2", f"d{i}") for i in range(5)) + "]"))
        .when(m == 9, F.lit(f"[{looped}, {back}]"))
        .otherwise(F.concat(F.lit("["), first, F.lit("]")))
    )
    events = R.spread(R.table(spark, folder, "events").select("event_id", "event_type"))
    plans = events.select(R.text_of("event_id").alias("plan_id"), F.replace(text, F.lit("@"), F.col("event_type")).alias("text"))
    existing = plans.select("plan_id", F.lit("src/app/old.py").alias("path"))
    rewrites = plans.select("plan_id", F.lit("src/a.py").alias("path"))
    return X.plan_violations(plans, existing, rewrites)


_REPLIES = """
WITH r AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS reply_id, turn, trim(text, ' ' || chr(10) || chr(13) || chr(9)) || chr(10) AS body FROM conversations)
"""


def _replies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    turns = R.table(spark, folder, "conversations")

    def block(path: str):
        return F.concat(F.lit(f"<<<FILE: {path} >>>\n```python\n"), F.col("text"), F.lit("```\n<<<END_FILE>>>\n"))

    second = F.when(F.col("turn") % 3 == 0, block("a.py")).when(F.col("turn") % 3 == 1, block("b.py")).otherwise(block("x.py"))
    reply_id = F.concat_ws("-", "conv_id", "turn")
    replies = turns.select(reply_id.alias("reply_id"), F.concat(F.lit("Sure.\n"), block("a.py"), second).alias("text"))
    return replies, replies.select("reply_id", F.explode(F.array(F.lit("a.py"), F.lit("b.py"))).alias("path"))


@growing("X-05", _REPLIES + """
SELECT reply_id, 'a.py' AS path, body FROM r UNION ALL
SELECT reply_id, CASE turn % 3 WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.py' ELSE 'x.py' END, body FROM r""")
def cluster_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return X.cluster_files(*_replies(spark, folder))[0]


@growing("X-05 U-02", _REPLIES + """
SELECT reply_id, 'a.py' AS path, 'duplicate' AS rule FROM r WHERE turn % 3 = 0 UNION ALL SELECT reply_id, 'b.py', 'missing' FROM r WHERE turn % 3 <> 1
UNION ALL SELECT reply_id, 'x.py', 'unexpected' FROM r WHERE turn % 3 = 2""")
def cluster_problems(spark: SparkSession, folder: str) -> DataFrame:
    return X.cluster_files(*_replies(spark, folder))[1]


@growing("F-39", """
SELECT CAST(event_id AS VARCHAR) AS id, unnest(['tests/test_' || event_type || '.py', 'src/a_test.py']) AS test FROM events""")
def affected_tests(spark: SparkSession, folder: str) -> DataFrame:
    document = F.concat(
        F.lit('{"files": [{"path": "/work/r/tests/test_'), F.col("event_type"), F.lit('.py", "deep": {"x": ["src/a_test.py", "/work/r/tests/conftest.py"]}}], "test_key.py": 1}')
    )
    results = R.table(spark, folder, "events").select(R.text_of("event_id").alias("id"), document.alias("result"))
    return X.test_files_in(results, "/work/r")


@growing("X-22", """
SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['inject_fault', 'ref', 'user'] ELSE ['ref', 'user'] END) AS key,
       unnest(CASE WHEN event_id % 2 = 0 THEN ['bad_patch', event_type, CAST(user_id AS VARCHAR)] ELSE [event_type, CAST(user_id AS VARCHAR)] END) AS value FROM events""")
def job_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Scenario settings under a repository's own, empty ones dropped; a repeated key takes the later value."""
    fault = F.when(F.col("event_id") % 2 == 0, "bad_patch").otherwise("")
    base = F.create_map(F.lit("inject_fault"), fault, F.lit("ref"), F.lit("main"))
    own = F.create_map(F.lit("ref"), F.col("event_type"), F.lit("user"), R.text_of("user_id"), F.lit("subdir"), F.lit(""))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))
    merged = F.map_filter(F.map_concat(kept, own), lambda k, v: v != "")
    return R.table(spark, folder, "events").select("event_id", F.explode(merged).alias("key", "value"))


@growing("S-09 K-14", over("runs", """
SELECT id AS job_id, tasks_total, tasks_done, tasks_skipped, recover_visits, CAST(0 AS INTEGER) AS recover_budget_used, escalation_attempted, escalation_rescued,
       CAST(0 AS INTEGER) AS no_progress_retries, llm_calls, cost_usd, CAST(0 AS DOUBLE) AS oracle_integrity_rate, CASE WHEN status = 'green' THEN 'success' ELSE 'failed' END AS migration_outcome
FROM runs"""))
def report_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Reports written as JSON and read back into run numbers."""
    reports = R.runs(spark, folder).select(
        F.col("id").alias("job_id"), F.when(F.col("status") == "green", "success").alias("migration_outcome"), "tasks_total", "tasks_done",
        F.struct(F.col("recover_visits").alias("visits"), "tasks_skipped", "escalation_attempted", "escalation_rescued").alias("recovery"),
        F.struct(F.col("llm_calls").alias("calls"), "cost_usd").alias("llm_usage"),
        F.lit('+password = "hunter2hunter2"').alias("diff"),
    )
    return J.flat(J.parsed(J.written(reports)))


@growing("K-13 K-07", over("runs", f"""
SELECT corpus_name, metric, '| ' || corpus_name || ' | ' || scenario || ' | ' || metric || ' | ' || CAST(k AS VARCHAR) || ' | ' || printf('%.4f', mean) || ' | ' || printf('%.6f', variance) || ' |' AS line
FROM ({_METRICS_SQL})"""))
def metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    return S.metric_lines(E.cell_metrics(R.runs(spark, folder))).select("corpus_name", "metric", "line")


@growing("E-21 E-20", over("source_files", """
SELECT repo, 'application_factory' AS kind, path, 'KEY_' || replace(p_brand, '#', '_') AS name, CAST(NULL AS VARCHAR) AS detail FROM source_files WHERE j = 0
UNION ALL SELECT repo, 'application_factory', path, 'create_app', 'config=None' FROM source_files WHERE j = 0
UNION ALL SELECT repo, 'route_names', path, 'view_' || CAST(j AS VARCHAR), '/x' || CAST(j AS VARCHAR) FROM source_files WHERE j BETWEEN 2 AND 12
UNION ALL SELECT repo, 'test_harness', path, NULL, NULL FROM source_files WHERE j IN (16, 17, 18)
UNION ALL SELECT repo, 'ambient_context_runtime', path, NULL, NULL FROM source_files WHERE j = 1"""))
def seam_decisions(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return W.decisions(files, cut_lineage(M.planned_files(files)))


@growing("E-17", over("source_files", """
, d AS (SELECT *, p_size % 4 AS s FROM source_files WHERE j BETWEEN 2 AND 12)
SELECT repo, path, 'flask' AS symbol, 'package_unavailable' AS rule, '1' AS detail FROM d WHERE s = 0
UNION ALL SELECT repo, path, 'errorhandler', 'router_lacks_member', '5' FROM d WHERE s = 1
UNION ALL SELECT repo, path, 'test_client', 'application_lacks_member', '5' FROM d WHERE s = 2
UNION ALL SELECT repo, path, 'view_' || CAST(j AS VARCHAR), 'route_removed', 'view_' || CAST(j AS VARCHAR) FROM d WHERE s IN (1, 2, 3)"""))
def seam_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts of routers: still the old package, or a new one used wrongly and without its route."""
    files, size = R.source_files(spark, folder), F.col("p_size") % 4
    router = "from fastapi import APIRouter\nimport os\n\nbp = APIRouter()\n@bp.errorhandler(404)\ndef lost():\n    pass\n"
    application = "from fastapi import FastAPI\nimport os\n\napp = FastAPI()\nclient = app.test_client()\n"
    text = F.when(size == 0, F.col("text")).when(size == 1, router).when(size == 2, application).otherwise("from app import db\n")
    drafts = files.filter("j BETWEEN 2 AND 12").select("repo", "path", text.alias("text"))
    seam = W.decisions(files.select("repo", "path", "text"), M.planned_files(files.select("repo", "path", "text")))
    local = files.select("repo", F.lit("app").alias("package")).distinct()
    return W.draft_violations(drafts, seam, local)


@growing("E-27", over("source_files", """
, x AS (SELECT repo, list(j) AS js FROM source_files GROUP BY repo),
f AS (SELECT repo, j, path, nxt, js FROM source_files JOIN x USING (repo)),
pin AS (SELECT repo, path AS owner, 'create_app [function] def create_app(config=None)' AS what FROM f WHERE j = 0 AND list_contains(js, 16)
        UNION ALL SELECT repo, path, 'get_db [function] def get_db(name, timeout=1)' FROM f WHERE j = 1 AND list_has_any(js, range(2, 13))
        UNION ALL SELECT repo, path, 'init_app [function] def init_app(app)' FROM f WHERE j = 1 AND list_contains(js, 0)
        UNION ALL SELECT repo, path, 'bp [variable] bp = Blueprint(''m2'', __name__)' FROM f WHERE j = 2 AND list_contains(js, 0)
        UNION ALL SELECT repo, path, 'helper_' || CAST(j AS VARCHAR) || ' [function] def helper_' || CAST(j AS VARCHAR) || '(x, *, flag=None)' FROM f
          WHERE j BETWEEN 2 AND 12 AND list_contains(js, CASE WHEN j = 2 THEN 12 ELSE j - 1 END)),
e AS (SELECT repo, path, 'src/app/db.py' AS dep FROM f WHERE j BETWEEN 2 AND 12 OR j = 0
      UNION ALL SELECT repo, path, 'src/app/m' || CAST(nxt AS VARCHAR) || '.py' FROM f WHERE j BETWEEN 2 AND 12
      UNION ALL SELECT repo, path, 'src/app/m2.py' FROM f WHERE j = 0 UNION ALL SELECT repo, path, 'src/app/__init__.py' FROM f WHERE j = 16)
SELECT repo, owner AS path, 'DEFINES' AS section, '  - ' || owner || '::' || what AS line FROM pin
UNION ALL SELECT e.repo, e.path, 'CALLS', '  - ' || dep || '::' || what FROM e JOIN pin ON pin.repo = e.repo AND pin.owner = e.dep"""))
def contract_lines(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    planned = cut_lineage(M.planned_files(files)).withColumn("position", F.col("order"))
    pins, taken = _pins(files, planned)
    consumed = K.consumed_pins(pins, taken, C.planned_imports(files, planned))
    return W.contract_lines(pins, consumed)
