"""Queries on proposals of new modules: their completion, the log of it, and what they get wrong.

Every part gives one proposal.  What it holds is decided by bits of the part's key, so that all combinations occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import plan_completion as PC
from . import relations as R
from .catalogue import growing

_BITS = 1 << 17
_RUNTIME, _COMPAT, _TESTING, _TEMPLATES = "src/app/runtime.py", "src/app/compat.py", "src/app/testing.py", "src/app/templating.py"


def _bit(i: int) -> Column:
    return F.floor((F.col("p_partkey") * 69069) % _BITS / (1 << i)) % 2 == 1


def _facts_of(rows: DataFrame, columns: list[str], some: list[tuple]) -> DataFrame:
    """A row for every tuple whose last entry, a condition, holds."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, values, strict=True)], when.alias("there")) for *values, when in some]
    picked = rows.withColumn("f", F.explode(F.array(*structs))).filter("f.there")
    return picked.select(F.concat(F.lit("p"), R.text_of("p_partkey")).alias("repo"), *[f"f.{c}" for c in columns])


def _proposals(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    rows, b, yes = R.spread(R.table(spark, folder, "part").select("p_partkey")), _bit, F.lit(True)
    facts = _facts_of(rows, ["owner", "relation", "name", "value"], [
        (_RUNTIME, "capability", "request_context", "", yes), (_RUNTIME, "capability", "session_and_flash", "", b(1)),
        (_RUNTIME, "export", "Ctx", "class", b(2)), (_RUNTIME, "member", "dispatch", "Ctx", b(2) & b(3)), (_RUNTIME, "member", "extra", "Ctx", b(2) & b(4)),
        (_RUNTIME, "export", "get_request_context", "function", b(5)), (_RUNTIME, "export", "g", "function", b(6) & b(12)), (_RUNTIME, "export", "g", "variable", b(6) & ~b(12)),
        (_RUNTIME, "consumer", "src/app/m1.py", "", yes), (_RUNTIME, "consumer", "src/app/m2.py", "", b(7)),
        (_COMPAT, "capability", "request_context", "", b(8)), (_COMPAT, "consumer", "src/app/m1.py", "", b(8)),
        (_TESTING, "capability", "test_context_surface", "", yes), (_TESTING, "capability", "direct_test_surface", "", b(9)),
        (_TESTING, "export", "Facade", "class", yes), (_TESTING, "export", "Extra", "class", b(3)), (_TESTING, "member", "cli", "Facade", yes), (_TESTING, "member", "old", "Facade", yes),
        (_TESTING, "member", "app_context", "Facade", b(16)), (_TESTING, "dependency", _RUNTIME, "", b(12)),
        (_TEMPLATES, "capability", "template_rendering", "", yes), (_TEMPLATES, "capability", "other", "", b(10)), (_TEMPLATES, "capability", "session_and_flash", "", b(15)),
        (_TEMPLATES, "export", "render_template", "function", yes), (_TEMPLATES, "export", "helper", "function", b(11)),
        ("tests/test_rt.py", "capability", "other", "", b(13)),
    ])
    needs = _facts_of(rows, ["capability", "relation", "name", "value"], [
        ("request_context", "consumer", "src/app/m1.py", "", yes), ("request_context", "consumer", "src/app/m2.py", "", yes), ("request_context", "export", "g", "variable", yes),
        ("request_context", "member", "bind", "", b(0)), ("direct_test_surface", "member", "app_context", "", yes), ("direct_test_surface", "member", "cli", "", yes),
        ("session_and_flash", "consumer", "src/app/m1.py", "", b(14)),
    ])
    factories = _facts_of(rows, ["path"], [("src/app/__init__.py", yes)])
    allowed = _facts_of(rows, ["owner"], [(p, yes) for p in (_RUNTIME, _TESTING, _TEMPLATES)])
    return {"facts": facts, "needs": needs, "factories": factories, "allowed": allowed}


_PLANS_SQL = f"""
WITH h AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS repo, (p_partkey * 69069) % {_BITS} AS m FROM part),
b AS (SELECT repo, {", ".join(f"m // {1 << i} % 2 = 1 AS b{i}" for i in range(17))} FROM h),
d AS (SELECT *, NOT b8 AS rc, NOT b8 AND NOT b15 AS solo, b14 AND b1 <> b15 AS sess, CASE WHEN b2 THEN 'Ctx' ELSE 'RequestContextMiddleware' END AS cls,
             '{_RUNTIME}' AS rt, '{_COMPAT}' AS cp, '{_TESTING}' AS ts, '{_TEMPLATES}' AS tp FROM b)"""

_LOG_SQL = """
SELECT repo, rt AS owner, 'add' AS action, 'consumer' AS relation, 'src/app/m2.py' AS name, '' AS value, 'consumers' AS rule, 0 AS layer FROM d WHERE rc AND NOT b7
UNION ALL SELECT repo, tp, 'add', 'consumer', 'src/app/m1.py', '', 'consumers', 0 FROM d WHERE sess AND b15
UNION ALL SELECT repo, rt, 'add', 'export', 'g', 'variable', 'exports', 0 FROM d WHERE rc AND NOT b6
UNION ALL SELECT repo, rt, 'add', 'member', 'bind', 'Ctx', 'members', 0 FROM d WHERE rc AND b0 AND b2
UNION ALL SELECT repo, ts, 'add', 'member', 'app_context', 'Facade', 'members', 0 FROM d WHERE b9 AND NOT b16
UNION ALL SELECT repo, tp, 'remove', 'export', 'helper', 'function', 'template_exports', 1 FROM d WHERE NOT b10 AND NOT b15 AND b11
UNION ALL SELECT repo, rt, 'remove', 'export', 'get_request_context', 'function', 'runtime_class', 1 FROM d WHERE solo AND b5
UNION ALL SELECT repo, rt, 'add', 'export', cls, 'class', 'runtime_class', 1 FROM d WHERE solo AND NOT b2
UNION ALL SELECT repo, rt, 'add', 'member', unnest(['get_request_context', 'manage_session']), cls, 'runtime_class', 1 FROM d WHERE solo
UNION ALL SELECT repo, rt, 'remove', 'member', 'extra', 'Ctx', 'runtime_class', 1 FROM d WHERE solo AND b2 AND b4
UNION ALL SELECT repo, rt, 'remove', 'member', 'bind', 'Ctx', 'runtime_class', 1 FROM d WHERE solo AND b2 AND b0
UNION ALL SELECT repo, rt, 'add', 'consumer', 'src/app/__init__.py', '', 'factory_consumers', 1 FROM d WHERE solo
UNION ALL SELECT repo, ts, 'remove', 'member', 'old', 'Facade', 'test_class', 2 FROM d WHERE solo AND b9 AND NOT b3
UNION ALL SELECT repo, ts, 'add', 'dependency', rt, '', 'test_dependency', 2 FROM d WHERE solo AND NOT b12
UNION ALL SELECT repo, tp, 'add', 'dependency', rt, '', 'template_dependency', 2 FROM d WHERE solo"""


@growing("E-23", _PLANS_SQL + """
SELECT repo, rt AS owner, 'capability' AS relation, 'request_context' AS name, '' AS value FROM d
UNION ALL SELECT repo, rt, 'capability', 'session_and_flash', '' FROM d WHERE b1
UNION ALL SELECT repo, cp, 'capability', 'request_context', '' FROM d WHERE b8
UNION ALL SELECT repo, cp, 'consumer', 'src/app/m1.py', '' FROM d WHERE b8
UNION ALL SELECT repo, ts, 'capability', 'test_context_surface', '' FROM d
UNION ALL SELECT repo, ts, 'capability', 'direct_test_surface', '' FROM d WHERE b9
UNION ALL SELECT repo, tp, 'capability', 'template_rendering', '' FROM d
UNION ALL SELECT repo, tp, 'capability', 'other', '' FROM d WHERE b10
UNION ALL SELECT repo, tp, 'capability', 'session_and_flash', '' FROM d WHERE b15
UNION ALL SELECT repo, 'tests/test_rt.py', 'capability', 'other', '' FROM d WHERE b13
UNION ALL SELECT repo, rt, 'consumer', 'src/app/m1.py', '' FROM d
UNION ALL SELECT repo, rt, 'consumer', 'src/app/m2.py', '' FROM d WHERE rc OR b7
UNION ALL SELECT repo, rt, 'consumer', 'src/app/__init__.py', '' FROM d WHERE solo
UNION ALL SELECT repo, tp, 'consumer', 'src/app/m1.py', '' FROM d WHERE sess AND b15
UNION ALL SELECT repo, rt, 'export', cls, 'class' FROM d WHERE b2 OR solo
UNION ALL SELECT repo, rt, 'export', 'get_request_context', 'function' FROM d WHERE b5 AND NOT solo
UNION ALL SELECT repo, rt, 'export', 'g', CASE WHEN b6 AND b12 THEN 'function' ELSE 'variable' END FROM d WHERE b6 OR rc
UNION ALL SELECT repo, ts, 'export', 'Facade', 'class' FROM d
UNION ALL SELECT repo, ts, 'export', 'Extra', 'class' FROM d WHERE b3
UNION ALL SELECT repo, tp, 'export', 'render_template', 'function' FROM d
UNION ALL SELECT repo, tp, 'export', 'helper', 'function' FROM d WHERE b11 AND (b10 OR b15)
UNION ALL SELECT repo, rt, 'member', unnest(['get_request_context', 'manage_session']), cls FROM d WHERE solo
UNION ALL SELECT repo, rt, 'member', 'dispatch', 'Ctx' FROM d WHERE b2 AND b3
UNION ALL SELECT repo, rt, 'member', 'extra', 'Ctx' FROM d WHERE b2 AND b4 AND NOT solo
UNION ALL SELECT repo, rt, 'member', 'bind', 'Ctx' FROM d WHERE b2 AND b0 AND rc AND NOT solo
UNION ALL SELECT repo, ts, 'member', 'cli', 'Facade' FROM d
UNION ALL SELECT repo, ts, 'member', 'app_context', 'Facade' FROM d WHERE b9 OR b16
UNION ALL SELECT repo, ts, 'member', 'old', 'Facade' FROM d WHERE NOT (solo AND b9 AND NOT b3)
UNION ALL SELECT repo, ts, 'dependency', rt, '' FROM d WHERE solo OR b12
UNION ALL SELECT repo, tp, 'dependency', rt, '' FROM d WHERE solo""")
def completed_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Every proposal with its consumers, exports, members and dependencies completed, and what does not belong taken out."""
    p = _proposals(spark, folder)
    return PC.completed(p["facts"], p["needs"], p["factories"])[0]


@growing("E-23", _PLANS_SQL + _LOG_SQL)
def plan_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The log of the completion: each addition and removal with its rule."""
    p = _proposals(spark, folder)
    return PC.completed(p["facts"], p["needs"], p["factories"])[1]


def _listed(action: str, relation: str, text: str) -> str:
    return f"coalesce(list_sort(list_distinct(list({text}) FILTER (action = '{action}' AND relation = '{relation}'))), [])"


@growing("E-23", f"""{_PLANS_SQL}, log AS ({_LOG_SQL})
SELECT repo, owner, {_listed('add', 'consumer', 'name')} AS added_consumers, {_listed('add', 'export', 'name')} AS added_exports, {_listed('remove', 'export', 'name')} AS removed_exports,
       {_listed('add', 'member', "value || '.' || name")} AS added_members, {_listed('remove', 'member', "value || '.' || name")} AS removed_members,
       {_listed('add', 'dependency', 'name')} AS added_dependencies FROM log GROUP BY repo, owner""")
def plan_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row per changed module with all that was changed about it."""
    p = _proposals(spark, folder)
    return PC.audit(PC.completed(p["facts"], p["needs"], p["factories"])[1])


@growing("E-22", _PLANS_SQL + """
SELECT repo, 'tests/test_rt.py' AS subject, 'test_path' AS rule, '' AS detail FROM d WHERE b13
UNION ALL SELECT repo, cp, 'path_not_allowed', '' FROM d WHERE b8
UNION ALL SELECT repo, 'request_context', 'owner_count', '2' FROM d WHERE b8
UNION ALL SELECT repo, 'direct_test_surface', 'owner_count', '0' FROM d WHERE NOT b9
UNION ALL SELECT repo, 'session_and_flash', 'owner_count', CASE WHEN b1 THEN '2' ELSE '0' END FROM d WHERE b14 AND b1 = b15
UNION ALL SELECT repo, rt, 'runtime_not_shared', tp FROM d WHERE sess AND b15 AND rc
UNION ALL SELECT repo, 'request_context', 'consumers_omitted', 'src/app/m2.py' FROM d WHERE rc AND NOT b7
UNION ALL SELECT repo, 'session_and_flash', 'consumers_omitted', 'src/app/m1.py' FROM d WHERE sess AND b15
UNION ALL SELECT repo, 'request_context', 'member_classes', '0' FROM d WHERE rc AND b0
UNION ALL SELECT repo, 'direct_test_surface', 'member_classes', '0' FROM d WHERE b9 AND NOT b16
UNION ALL SELECT repo, 'request_context', 'export_omitted', 'g' FROM d WHERE rc AND NOT b6
UNION ALL SELECT repo, 'request_context', 'export_kind', 'g: function for variable' FROM d WHERE rc AND b6 AND b12
UNION ALL SELECT repo, rt, 'runtime_classes', '0' FROM d WHERE solo AND NOT b2
UNION ALL SELECT repo, ts, 'facade_classes', '2' FROM d WHERE b9 AND b3
UNION ALL SELECT repo, tp, 'template_exports', '2' FROM d WHERE NOT b10 AND NOT b15 AND b11""")
def proposal_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Thirteen rules on proposals: placement, owners, consumers, exports and their kinds, members, classes."""
    p = _proposals(spark, folder)
    return PC.violations(p["facts"], p["needs"], p["allowed"])
