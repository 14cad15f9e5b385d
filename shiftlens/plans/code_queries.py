"""Queries over source files: facts, bindings, contracts and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as I
from ..operators import code_facts as C
from ..operators import contracts as K
from ..operators import migration_plan as M
from ..session import cut_lineage
from . import relations as R
from .catalogue import growing, over


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return R.source_files(spark, folder).select("repo", "path", "text")


@growing("E-15 E-14", over("source_files", "SELECT repo, path, j <> 19 AS parses, CASE WHEN j = 19 THEN 1 END AS line FROM source_files"))
def parse_status(spark: SparkSession, folder: str) -> DataFrame:
    return C.parse_status(_files(spark, folder))


_IMPORTS = """
, i AS (
  SELECT repo, path, unnest(CASE
    WHEN j = 0 THEN [('flask', 'Flask', 'Flask'), ('src.app', 'db', 'db'), ('src.app.m2', 'bp', 'bp')]
    WHEN j = 1 THEN [('flask', 'g', 'g'), ('flask', 'current_app', 'current_app')]
    WHEN j <= 12 THEN [('flask', 'Blueprint', 'Blueprint'), ('flask', 'request', 'request'), ('src.app.db', 'get_db', 'get_db'),
                       ('app.m' || CAST(nxt AS VARCHAR), 'helper_' || CAST(nxt AS VARCHAR), 'helper_' || CAST(nxt AS VARCHAR))]
    WHEN j <= 15 THEN [('', 'os', 'os')]
    WHEN j = 16 THEN [('', 'pytest', 'pytest'), ('app', 'create_app', 'create_app')]
    WHEN j <= 18 THEN [('', 'pytest', 'pytest'), ('flask', 'g', 'g'), ('flask', 'request', 'req'), ('flask', 'jsonify', 'jsonify')]
    ELSE [] END) AS r FROM source_files)
"""


@growing("E-01 X-03", over("source_files", _IMPORTS + "SELECT repo, path, r[1] AS resolved, r[2] AS name, r[3] AS local FROM i"))
def import_facts(spark: SparkSession, folder: str) -> DataFrame:
    return C.imports(_files(spark, folder)).select("repo", "path", "resolved", "name", "local")


_BINDINGS = """
, b AS (
  SELECT repo, 'src/app/db.py' AS path, path AS importer, NULL AS symbol, 'db' AS local FROM source_files WHERE j = 0
  UNION ALL SELECT repo, 'src/app/m2.py', path, 'bp', 'bp' FROM source_files WHERE j = 0
  UNION ALL SELECT repo, 'src/app/db.py', path, 'get_db', 'get_db' FROM source_files WHERE j BETWEEN 2 AND 12
  UNION ALL SELECT repo, 'src/app/m' || CAST(nxt AS VARCHAR) || '.py', path, 'helper_' || CAST(nxt AS VARCHAR), 'helper_' || CAST(nxt AS VARCHAR)
            FROM source_files WHERE j BETWEEN 2 AND 12
  UNION ALL SELECT repo, 'src/app/__init__.py', path, 'create_app', 'create_app' FROM source_files WHERE j = 16),
used AS (SELECT repo, path, coalesce(symbol, 'init_app') AS symbol, importer, local, CASE WHEN symbol IS NULL THEN 'module' ELSE 'symbol' END AS binding FROM b),
contract AS (SELECT DISTINCT repo, path, symbol, CASE WHEN symbol = 'bp' THEN 'variable' ELSE 'function' END AS kind FROM used)
"""


@growing("J-07 E-01 E-02", over("source_files", _BINDINGS + "SELECT * FROM b"))
def import_bindings(spark: SparkSession, folder: str) -> DataFrame:
    return C.bindings(_files(spark, folder)).drop("seq")


def _used(files: DataFrame) -> DataFrame:
    return C.used_symbols(C.bindings(files), C.references(files))


@growing("E-04 J-12", over("source_files", _BINDINGS + "SELECT repo, path, symbol, importer AS consumer, local, binding FROM used"))
def symbol_consumers(spark: SparkSession, folder: str) -> DataFrame:
    return K.consumers(_used(_files(spark, folder)))


@growing("E-04", over("source_files", _BINDINGS + "SELECT DISTINCT repo, path, symbol FROM used"))
def export_contract(spark: SparkSession, folder: str) -> DataFrame:
    return C.export_contract(_used(_files(spark, folder)))


@growing(
    "E-03",
    over("source_files", _BINDINGS + """
SELECT b.repo, b.path, importer, CASE WHEN b.path LIKE '%/db.py' AND symbol IS NULL THEN 'db.init_app(app)'
  WHEN symbol = 'bp' THEN NULL WHEN symbol = 'get_db' THEN 'conn = get_db("' || replace(p_brand, '#', '_') || '")'
  WHEN symbol = 'create_app' THEN 'app = create_app()' ELSE 'return ' || symbol || '(a)' END AS line
FROM b JOIN source_files s ON s.repo = b.repo AND s.path = b.importer WHERE symbol IS NULL OR symbol <> 'bp'"""),
)
def call_sites(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return C.call_sites(C.bindings(files), files).select("repo", "path", "importer", "line")


@growing("E-07 E-05", over("source_files", _BINDINGS + "SELECT * FROM contract"))
def interface_contract(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return C.interface_contract(files, _used(files)).select("repo", "path", "symbol", "kind")


@growing(
    "E-05 E-06",
    over("source_files", """
SELECT repo, path, name, n AS required_positional, k AS positional_capacity, kw AS keyword_names, g AS is_generator FROM (
  SELECT repo, path, unnest(CASE WHEN j = 0 THEN [('create_app', 0, 1, ['config'], false)]
    WHEN j = 1 THEN [('get_db', 1, 2, ['name', 'timeout'], false), ('init_app', 1, 1, ['app'], false), ('close_db', 0, 1, ['error'], false)]
    WHEN j <= 12 THEN [('view_' || CAST(j AS VARCHAR), 1, 2, ['a', 'b'], false), ('helper_' || CAST(j AS VARCHAR), 1, 1, ['x', 'flag'], false)]
    WHEN j = 16 THEN [('client', 0, 0, [], true)] WHEN j BETWEEN 17 AND 18 THEN [('test_get', 1, 1, ['client'], false)] ELSE [] END) AS r FROM source_files)
  AS t, LATERAL (SELECT r[1] AS name, r[2] AS n, r[3] AS k, r[4] AS kw, r[5] AS g)"""),
)
def function_shapes(spark: SparkSession, folder: str) -> DataFrame:
    found = C.definitions(_files(spark, folder)).filter("kind = 'function'")
    return found.select("repo", "path", "name", "shape.required_positional", "shape.positional_capacity", "shape.keyword_names", "shape.is_generator")


_PLANNED = """
, planned AS (SELECT repo, path, j, CASE WHEN j = 0 THEN 'app_factory' WHEN j = 1 THEN 'support' WHEN j <= 12 THEN 'router' ELSE 'test_harness' END AS role,
    CASE WHEN j = 0 THEN 20 WHEN j = 1 THEN 15 WHEN j <= 12 THEN 10 ELSE 30 END AS ord,
    CASE WHEN j = 0 THEN ['app_factory'] WHEN j = 1 THEN ['request_context'] WHEN j <= 12 THEN ['blueprint_to_router', 'route_to_endpoint', 'request_parsing']
         ELSE ['test_harness'] END AS subtasks
  FROM source_files WHERE j <= 12 OR j BETWEEN 16 AND 18)
"""


@growing("F-30 T-05 X-08", over("source_files", _PLANNED + 'SELECT repo, path, role, ord AS "order", subtasks FROM planned'))
def planned_files(spark: SparkSession, folder: str) -> DataFrame:
    return M.planned_files(_files(spark, folder))


@growing(
    "F-29 F-31",
    over("source_files", "SELECT repo, bool_or(j <= 12) AS matches, bool_or(j BETWEEN 17 AND 18) AS wants_new_modules FROM source_files GROUP BY repo"),
)
def repo_traits(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return M.matching_repos(files).join(M.wants_new_modules(files), "repo")


@growing(
    "X-08",
    over("source_files", """SELECT repo, path, j = 0 OR j BETWEEN 1 AND 12 OR j IN (17, 18) AS framework_import, j BETWEEN 2 AND 12 AS route, j = 0 AS app_factory,
         j IN (16, 17, 18) AS test_client, j = 1 AS request_context FROM source_files"""),
)
def idiom_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = _files(spark, folder).select("repo", "path", *I.idiom_flags(F.col("text")))
    return flags.select("repo", "path", "framework_import", "route", "app_factory", "test_client", "request_context")


@growing(
    "X-09",
    over("source_files", "SELECT repo, path, 'cmd-' || p_brand AS command, 'run_' || CAST(j AS VARCHAR) AS function, 'page.' || CAST(p_size AS VARCHAR) AS endpoint FROM source_files"),
)
def command_facts(spark: SparkSession, folder: str) -> DataFrame:
    files = R.source_files(spark, folder)
    number = F.col("j").cast("string")
    text = F.concat(
        "text", F.lit("\n@click.command('cmd-"), "p_brand", F.lit("')\n@click.option('--x')\ndef run_"), number,
        F.lit("(x):\n    return url_for('page."), F.col("p_size").cast("string"), F.lit("')\n"),
    )
    grown = files.select("repo", "path", text.alias("text"))
    names = F.regexp_extract_all("text", F.lit("(?U)" + I.CLICK_COMMAND), F.lit(1))
    functions = F.regexp_extract_all("text", F.lit("(?U)" + I.CLICK_COMMAND), F.lit(2))
    ends = F.regexp_extract_all("text", F.lit("(?U)" + I.TEMPLATE_ENDPOINT), F.lit(1))
    rows = grown.select("repo", "path", F.explode(F.arrays_zip(names.alias("command"), functions.alias("function"), ends.alias("endpoint"))).alias("r"))
    return rows.select("repo", "path", "r.*")


@growing(
    "F-38",
    over("source_files", """SELECT repo, path, 'direct_test_surface' AS surface FROM source_files WHERE j IN (16, 17, 18)
         UNION ALL SELECT repo, path, 'request_context' FROM source_files WHERE j = 1"""),
)
def surfaces(spark: SparkSession, folder: str) -> DataFrame:
    return M.surfaces(_files(spark, folder))


@growing(
    "G-20",
    over("source_files", "SELECT repo, 'direct_test_surface' AS surface, count(*) AS consumers FROM source_files WHERE j IN (16, 17, 18) GROUP BY repo HAVING count(*) >= 2"),
)
def surface_requirements(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return M.requirements(M.surfaces(files), M.planned_files(files))


@growing(
    "G-20 U-02",
    """
SELECT l_suppkey AS owner, 'c' || CAST(l_partkey % 60 AS VARCHAR) AS surface, count(DISTINCT l_orderkey) AS consumers
FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2""",
)
def requirement_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Surfaces with at least two distinct consumers, over line items."""
    rows = R.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("owner"), F.concat(F.lit("c"), (F.col("l_partkey") % 60).cast("string")).alias("surface"), "l_orderkey"
    )
    return rows.groupBy("owner", "surface").agg(F.count_distinct("l_orderkey").alias("consumers")).filter("consumers >= 2")


_OWN = """
, need AS (SELECT repo, path FROM source_files WHERE j IN (16, 17, 18)),
own AS (SELECT repo, 'src/app/testing.py' AS owner FROM source_files WHERE j = 0 AND p_size % 3 <> 0 UNION ALL
        SELECT repo, 'src/app/compat.py' FROM source_files WHERE j = 0 AND p_size % 3 = 2),
decl AS (SELECT repo, owner, 'tests/conftest.py' AS path FROM own),
n AS (SELECT r.repo, count(own.owner) AS n, min(own.owner) AS owner FROM (SELECT DISTINCT repo FROM need) r LEFT JOIN own ON own.repo = r.repo GROUP BY r.repo)
"""


def _ownership(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    files = _files(spark, folder)
    size = R.source_files(spark, folder).filter("j = 0").select("repo", "p_size")
    one = size.filter("p_size % 3 <> 0").select("repo", F.lit("src/app/testing.py").alias("owner"))
    two = size.filter("p_size % 3 = 2").select("repo", F.lit("src/app/compat.py").alias("owner"))
    owners = one.unionByName(two).withColumn("surface", F.lit("direct_test_surface"))
    declared = owners.select("repo", "owner", F.lit("tests/conftest.py").alias("path"))
    planned = M.planned_files(files)
    found = M.surfaces(files)
    required = M.requirements(found, planned)
    needed = found.join(planned.select("repo", "path"), ["repo", "path"], "left_semi").join(required.select("repo", "surface"), ["repo", "surface"], "left_semi")
    return {"required": required.select("repo", "surface"), "owners": owners, "declared": declared, "needed": needed}


@growing(
    "E-22",
    over("source_files", _OWN + """
SELECT repo, 'direct_test_surface' AS surface, 'owner_count' AS rule, CAST(n AS VARCHAR) AS detail FROM n WHERE n <> 1
UNION ALL SELECT need.repo, 'direct_test_surface', 'omitted_consumer', need.path FROM need JOIN n ON n.repo = need.repo AND n.n = 1
WHERE need.path <> 'tests/conftest.py'"""),
)
def ownership_violations(spark: SparkSession, folder: str) -> DataFrame:
    o = _ownership(spark, folder)
    return M.ownership_violations(o["required"], o["owners"], o["needed"], o["declared"])


@growing(
    "E-23",
    over("source_files", _OWN + """
SELECT repo, owner, path FROM decl UNION SELECT need.repo, n.owner, need.path FROM need JOIN n ON n.repo = need.repo AND n.n = 1"""),
)
def completed_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    o = _ownership(spark, folder)
    return M.completed_artifacts(o["declared"], o["owners"], o["needed"])[0]


@growing(
    "E-25",
    over("source_files", """
, n AS (SELECT unnest(['authentication.py', 'database.py', 'testing.py', 'context.py', 'session.py', 'templating.py', 'runtime_context.py', 'runtime.py', 'compat.py', 'support.py', 'adapters.py']) AS b)
SELECT DISTINCT repo, 'src/app/' || b AS path FROM source_files, n WHERE j <= 12"""),
)
def allowed_new_paths(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return M.allowed_new_paths(files, M.planned_files(files))


@growing(
    "F-25 E-11",
    over("source_files", """SELECT repo, path, CASE WHEN j = 16 THEN 'adapter_wiring' WHEN j IN (17, 18) THEN 'unsupported_test_seam' ELSE 'unchanged' END AS strategy FROM source_files"""),
)
def test_strategies(spark: SparkSession, folder: str) -> DataFrame:
    return M.test_strategy(_files(spark, folder))


@growing(
    "E-24",
    over("source_files", """
SELECT repo, path, CAST(2 AS INTEGER) AS line, 'from flask import jsonify' || chr(10) || 'from src.app.runtime_context import g, request as req' AS after
FROM source_files WHERE j IN (17, 18)"""),
)
def test_normalizations(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    owners = files.select("repo").distinct().select(
        "repo", F.lit("src/app/runtime_context.py").alias("owner_path"), F.explode(F.array(F.lit("g"), F.lit("request"))).alias("export")
    )
    return M.test_normalizations(M.context_imports(files), owners).select("repo", "path", "line", "after")


@growing(
    "X-16",
    over("source_files", """
SELECT repo, path, sha256('import pytest' || chr(10) || 'from flask import jsonify' || chr(10) || 'from src.app.runtime_context import g, request as req' || chr(10) || chr(10)
 || 'def test_get(client):' || chr(10) || '    assert client.get("/x2").status_code == 200' || chr(10) || '    assert client.get("/x3").get_json() == {"n": ' || CAST(p_size AS VARCHAR) || '}' || chr(10) || chr(10)
 || 'class TestBad:' || chr(10) || '    def test_raises(self, client):' || chr(10) || '        with pytest.raises(ValueError):' || chr(10) || '            client.get("/bad")' || chr(10)) AS content_hash
FROM source_files WHERE j IN (17, 18)"""),
)
def normalized_tests(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    owners = files.select("repo").distinct().select(
        "repo", F.lit("src/app/runtime_context.py").alias("owner_path"), F.explode(F.array(F.lit("g"), F.lit("request"))).alias("export")
    )
    changes = M.test_normalizations(M.context_imports(files), owners)
    return K.normalized_lines(files, changes).select("repo", "path", F.sha2("text", 256).alias("content_hash"))


@growing(
    "E-20",
    over("source_files", """
SELECT repo, path, 'config_key' AS fact, 'KEY_' || replace(p_brand, '#', '_') AS name, NULL AS detail FROM source_files WHERE j = 0
UNION ALL SELECT repo, path, 'factory', 'create_app', 'config=None' FROM source_files WHERE j = 0
UNION ALL SELECT repo, path, 'route', 'view_' || CAST(j AS VARCHAR), '/x' || CAST(j AS VARCHAR) FROM source_files WHERE j BETWEEN 2 AND 12"""),
)
def web_facts(spark: SparkSession, folder: str) -> DataFrame:
    return C.web_facts(_files(spark, folder)).drop("seq")


# ------------------------------------------------------------------------------- contracts


def _pins(files: DataFrame, planned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    used = cut_lineage(_used(files))
    return cut_lineage(K.manifest(C.interface_contract(files, used), M.planned_files(files) if planned is None else planned)), K.consumers(used)


@growing(
    "E-08 J-11 V-03",
    over("source_files", _BINDINGS + """
SELECT repo, path, symbol, kind, true AS preserve_shape, kind AS target_kind, CASE WHEN symbol = 'get_db' THEN ['get_db_dep'] ELSE [] END AS companions FROM contract"""),
)
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    pins, _ = _pins(_files(spark, folder))
    return pins.select("repo", "path", "symbol", "kind", "preserve_shape", "target_kind", "companions")


@growing(
    "J-09",
    over("source_files", _BINDINGS + """
, e AS (SELECT DISTINCT repo, importer AS consumer, path FROM b)
SELECT DISTINCT e.repo, e.consumer, c.path, c.symbol FROM e JOIN contract c ON c.repo = e.repo AND c.path = e.path"""),
)
def consumed_pins(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    planned = cut_lineage(M.planned_files(files)).withColumn("position", F.col("order"))
    pins, taken = _pins(files, planned)
    return K.consumed_pins(pins, taken, C.planned_imports(files, planned))


def _drafts(spark: SparkSession, folder: str) -> DataFrame:
    """New versions with known faults, told apart by the part's size."""
    j, size = F.col("j"), F.col("p_size")
    number = j.cast("string")
    helper = F.concat(F.lit("def helper_"), number, F.lit("(x, *, flag=None):"))
    changed = (
        F.when((size % 5 == 0) & (j >= 2) & (j <= 12), F.replace("text", helper, F.concat(F.lit("async def helper_"), number, F.lit("(x, y, *, flag):"))))
        .when((size % 5 == 1) & (j >= 2) & (j <= 12), F.replace("text", F.concat(F.lit("def helper_"), number), F.concat(F.lit("def renamed_"), number)))
        .when((size % 5 == 2) & (j >= 2) & (j <= 12), F.replace("text", F.lit("conn = get_db("), F.lit("conn = get_db(1, 2, 3, ")))
        .when((size % 5 == 3) & (j >= 2) & (j <= 12), F.replace("text", F.lit("from .db import get_db\n"), F.lit("")))
        .when((size % 5 == 4) & (j >= 2) & (j <= 12), F.concat(F.col("text"), F.lit("(")))
        .otherwise(F.col("text"))
    )
    return R.source_files(spark, folder).select("repo", "path", changed.alias("text"))


_ROUTERS = ", d AS (SELECT *, CAST(j AS VARCHAR) AS n FROM source_files WHERE j BETWEEN 2 AND 12)\n"


@growing("E-14", over("source_files", _ROUTERS + """
SELECT repo, path, CAST(NULL AS VARCHAR) AS symbol, 'unparseable' AS rule, '16' AS detail FROM d WHERE p_size % 5 = 4
UNION ALL SELECT repo, path, NULL, 'unparseable', '1' FROM source_files WHERE j = 19"""))
def unparseable_drafts(spark: SparkSession, folder: str) -> DataFrame:
    return K.unparseable(_drafts(spark, folder))


@growing("E-14 U-02", over("source_files", _ROUTERS + """
SELECT repo, path, 'helper_' || n AS symbol, rule, detail FROM d, (SELECT unnest([('required_grew', '1 -> 2'), ('required_keyword_only', 'flag'), ('async_changed', '')]) AS v), LATERAL (SELECT v[1] AS rule, v[2] AS detail) WHERE p_size % 5 = 0
UNION ALL SELECT repo, path, 'helper_' || n, 'missing', '' FROM d WHERE p_size % 5 = 1
UNION ALL SELECT repo, path, 'get_db', 'companion_missing', 'get_db_dep' FROM source_files WHERE j = 1"""))
def definition_violations(spark: SparkSession, folder: str) -> DataFrame:
    pins, _ = _pins(_files(spark, folder))
    return K.definition_violations(pins, _drafts(spark, folder))


@growing("E-12", over("source_files", _ROUTERS + """
SELECT repo, path, 'get_db' AS symbol, 'too_many_positional' AS rule, '9:get_db' AS detail FROM d WHERE p_size % 5 = 2
UNION ALL SELECT repo, path, 'get_db', 'binding_removed', 'get_db' FROM d WHERE p_size % 5 = 3"""))
def caller_violations(spark: SparkSession, folder: str) -> DataFrame:
    pins, taken = _pins(_files(spark, folder))
    return K.caller_violations(pins, taken, _drafts(spark, folder))


@growing("E-16", over("source_files", _ROUTERS + """
SELECT repo, path, 'flash_message' AS symbol, 'undefined_name' AS rule, '' AS detail FROM d WHERE p_size % 5 <> 4
UNION ALL SELECT repo, path, 'get_db', 'undefined_name', '' FROM d WHERE p_size % 5 = 3"""))
def undefined_names(spark: SparkSession, folder: str) -> DataFrame:
    return K.undefined_name_violations(_drafts(spark, folder))


@growing("E-14 G-21", over("source_files", """
, w AS (SELECT *, 'Store' || CAST(j AS VARCHAR) AS symbol FROM source_files WHERE j BETWEEN 13 AND 15)
SELECT repo, path, symbol, 'member_not_callable' AS rule, 'name' AS detail FROM w
UNION ALL SELECT repo, path, symbol, 'member_not_manager', 'rows' FROM w
UNION ALL SELECT repo, path, symbol, 'member_missing', 'close' FROM w"""))
def member_violations(spark: SparkSession, folder: str) -> DataFrame:
    stores = R.source_files(spark, folder).filter("j BETWEEN 13 AND 15")
    uses = F.array(*[F.struct(F.lit(m).alias("member"), F.lit(u).alias("use")) for m, u in (
        ("name", "method"), ("rows", "context_manager"), ("close", "method"), ("root", "attribute"), ("limit", "attribute"))])
    wanted = stores.select("repo", "path", F.concat(F.lit("Store"), F.col("j").cast("string")).alias("symbol"), F.explode(uses).alias("u")).select(
        "repo", "path", "symbol", "u.*"
    )
    return K.member_violations(wanted, _drafts(spark, folder))


@growing("G-21", over("source_files", """
SELECT DISTINCT repo, 'get' AS member, 'method' AS shape FROM source_files WHERE j = 17 UNION ALL
SELECT DISTINCT repo, 'args', 'attribute' FROM source_files WHERE j = 2 UNION ALL
SELECT DISTINCT repo, 'raises', 'context_manager' FROM source_files WHERE j = 17"""))
def member_shapes(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    wanted = files.select("repo", F.explode(F.array(F.lit("get"), F.lit("args"), F.lit("raises"))).alias("member")).distinct()
    return C.member_uses(files, wanted)


@growing("N-08", over("source_files", """
SELECT repo, 'src/app/db.py' AS path, 'src/app/m3.py' AS symbol, 'imports_consumer' AS rule, '1' AS detail FROM source_files WHERE j = 1 AND p_size % 2 = 0"""))
def topology_violations(spark: SparkSession, folder: str) -> DataFrame:
    return K.topology_violations(*_topology(spark, folder))


def _topology(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    resource = R.source_files(spark, folder).filter("j = 1")
    top = F.when(F.col("p_size") % 2 == 0, F.lit("from .m3 import bp\n")).otherwise(
        F.lit("from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from .m3 import bp\n"))
    drafts = resource.select("repo", "path", F.concat(top, F.col("text")).alias("text"))
    declared = resource.select("repo", "path", F.explode(F.array(F.lit("src/app/m3.py"), F.lit("src/app/m4.py"))).alias("consumer"))
    return declared, drafts


@growing("N-09", over("source_files", "SELECT repo, path FROM source_files WHERE j = 1 AND p_size % 2 = 0"))
def circular_import_targets(spark: SparkSession, folder: str) -> DataFrame:
    declared, drafts = _topology(spark, folder)
    batch = R.source_files(spark, folder).filter("j <= 4").select(
        "repo", "path", F.lit("ImportError: circular import in src/app/db.py and src/app/m3.py").alias("output"))
    return K.circular_targets(batch, K.topology_violations(declared, drafts))


@growing("E-13", over("source_files", """
SELECT repo, path, 'Facade' AS symbol, 'capability_not_imported' AS rule, 'src/app/testing.py' AS detail FROM source_files WHERE j = 0 AND p_size % 3 = 0
UNION ALL SELECT repo, path, 'Facade', 'capability_not_built', 'src/app/testing.py' FROM source_files WHERE j = 0 AND p_size % 3 = 1"""))
def capability_violations(spark: SparkSession, folder: str) -> DataFrame:
    factories = R.source_files(spark, folder).filter("j = 0")
    head = F.when(F.col("p_size") % 3 == 0, "").otherwise("from .testing import Facade\n")
    tail = F.when(F.col("p_size") % 3 == 2, "\ndef build():\n    return Facade()\n").otherwise("")
    drafts = factories.select("repo", "path", F.concat(head, F.col("text"), tail).alias("text"))
    pins = factories.select("repo", F.lit("src/app/testing.py").alias("owner_path"), F.lit("Facade").alias("symbol"))
    wanted = factories.select("repo", F.lit("src/app/testing.py").alias("owner_path"), F.lit("Facade").alias("symbol"), "path")
    return K.capability_violations(pins, wanted, drafts)


# ----------------------------------------------------------------------------- test oracle


@growing("E-11 E-09 E-10", over("source_files", """
SELECT repo, path, CASE WHEN j = 16 THEN 'adapter_wiring' ELSE 'unsupported_test_seam' END AS strategy, CAST(CASE WHEN j = 16 THEN 0 ELSE 2 END AS BIGINT) AS tests,
  CAST(CASE WHEN j = 16 THEN 0 ELSE 2 END AS BIGINT) AS assertions, CAST(CASE WHEN j = 16 THEN 1 ELSE 0 END AS BIGINT) AS fixtures FROM source_files WHERE j IN (16, 17, 18)"""))
def oracle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return K.oracle_manifest(files, M.test_strategy(files)).drop("sha256")


def _test_drafts(spark: SparkSession, folder: str) -> DataFrame:
    size, text = F.col("p_size") % 6, F.col("text")
    test = F.col("j").isin(17, 18)
    changed = (
        F.when(test & (size == 0), F.replace(text, F.lit(".get_json()"), F.lit(".json()")))
        .when(test & (size == 1), F.replace(text, F.lit("    assert client.get(\"/x2\").status_code == 200\n"), F.lit("")))
        .when(test & (size == 2), F.replace(text, F.lit("def test_get"), F.lit("@pytest.mark.skip\ndef test_get")))
        .when(test & (size == 3), F.replace(text, F.lit("ValueError"), F.lit("KeyError")))
        .when(test & (size == 4), F.replace(text, F.lit("test_raises"), F.lit("test_other")))
        .when(test & (size == 5), F.concat(text, F.lit("\npytestmark = pytest.mark.xfail\n")))
        .when((F.col("j") == 16) & (size == 0), F.replace(text, F.lit("yield "), F.lit("return ")))
        .otherwise(text)
    )
    return R.source_files(spark, folder).filter("j IN (16, 17, 18)").select("repo", "path", changed.alias("text"))


_ORACLE = """
, t AS (SELECT *, p_size % 6 AS s FROM source_files WHERE j IN (17, 18)),
v AS (SELECT repo, path, 'test_get' AS symbol, 'assertions_changed' AS rule, '' AS detail FROM t WHERE s = 1
UNION ALL SELECT repo, path, 'test_get', 'skip_introduced', 'pytest.mark.skip' FROM t WHERE s = 2
UNION ALL SELECT repo, path, 'TestBad::test_raises', 'raises_changed', '' FROM t WHERE s = 3
UNION ALL SELECT repo, path, 'TestBad::test_raises', 'test_removed', '' FROM t WHERE s = 4
UNION ALL SELECT repo, path, 'TestBad::test_other', 'test_added', '' FROM t WHERE s = 4
UNION ALL SELECT repo, path, NULL, 'module_skip_introduced', 'pytestmark = pytest.mark.xfail' FROM t WHERE s = 5
UNION ALL SELECT repo, path, 'client', 'fixture_changed', '' FROM source_files WHERE j = 16 AND p_size % 6 = 0)
"""


@growing("J-19 E-09 E-10 U-03", over("source_files", _ORACLE + "SELECT * FROM v"))
def oracle_violations(spark: SparkSession, folder: str) -> DataFrame:
    before = _files(spark, folder).filter("path LIKE 'tests/%'")
    return K.oracle_violations(before, _test_drafts(spark, folder))


@growing("G-09", over("source_files", _ORACLE + """
, x AS (SELECT repo, path FROM v GROUP BY ALL)
SELECT s.repo, count(*) AS protected_files, round_even(count(*) FILTER (x.path IS NULL) / count(*), 4) AS integrity_rate
FROM source_files s LEFT JOIN x ON x.repo = s.repo AND x.path = s.path WHERE j IN (16, 17, 18) GROUP BY s.repo"""))
def oracle_integrity(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    protected = files.filter("path LIKE 'tests/%'")
    rates = K.oracle_integrity(protected, K.oracle_violations(protected, _test_drafts(spark, folder)))
    return K.integrity_or_one(files.select("repo").distinct(), rates)


@growing("E-18", over("source_files", _ROUTERS + """
SELECT repo, path, count(*) AS violations FROM (
  SELECT repo, path FROM d WHERE p_size % 5 = 4 UNION ALL SELECT repo, path FROM source_files WHERE j IN (19, 1)
  UNION ALL SELECT repo, path FROM d, range(3) WHERE p_size % 5 = 0 UNION ALL SELECT repo, path FROM d WHERE p_size % 5 IN (1, 2, 3)
  UNION ALL SELECT repo, path FROM d WHERE p_size % 5 <> 4 UNION ALL SELECT repo, path FROM d WHERE p_size % 5 = 3) GROUP BY ALL"""))
def draft_violation_counts(spark: SparkSession, folder: str) -> DataFrame:
    pins, taken = _pins(C.read_once(_files(spark, folder), "imports", "references", "defines"))
    drafts = C.read_once(_drafts(spark, folder), C.STATUS, "imports", "calls", "references", "bound_names", "defines", "scopes")
    found = (
        K.unparseable(drafts)
        .unionByName(K.definition_violations(pins, drafts))
        .unionByName(K.caller_violations(pins, taken, drafts))
        .unionByName(K.undefined_name_violations(drafts))
    )
    return found.groupBy("repo", "path").agg(F.count("*").alias("violations"))


@growing("E-19", """
WITH d AS (SELECT doc_id, 1 AS draft, doc_id % 3 <> 0 AS parses, doc_id % 5 AS n FROM labels UNION ALL SELECT doc_id, 2, doc_id % 4 <> 0, doc_id % 7 FROM labels),
p AS (SELECT a.doc_id, a.parses AS p1, b.parses AS p2, a.n AS n1, b.n AS n2 FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.draft = 1 AND b.draft = 2)
SELECT doc_id, CASE WHEN NOT p2 THEN 1 WHEN NOT p1 THEN 2 WHEN n2 <= n1 THEN 2 ELSE 1 END AS draft FROM p""")
def draft_choice(spark: SparkSession, folder: str) -> DataFrame:
    labels = R.table(spark, folder, "labels")
    first = labels.select("doc_id", F.lit(1).alias("draft"), (F.col("doc_id") % 3 != 0).alias("parses"), (F.col("doc_id") % 5).alias("violations"), F.lit(False).alias("is_repair"))
    second = labels.select("doc_id", F.lit(2).alias("draft"), (F.col("doc_id") % 4 != 0).alias("parses"), (F.col("doc_id") % 7).alias("violations"), F.lit(True).alias("is_repair"))
    return K.chosen_draft(first.unionByName(second), ["doc_id"])
