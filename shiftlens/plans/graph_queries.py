"""Queries over import, contract and event graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_oracle_test
from ..operators import code_facts as C
from ..operators import contracts as K
from ..operators import cuts as U
from ..operators import graphs as G
from ..operators import migration_plan as M
from ..operators.ordered import ordinal, previous, with_running
from ..session import cut_lineage
from . import relations as R
from .catalogue import growing, over
from .code_queries import _PLANNED, _files, _used

_EDGES = """
, e AS (SELECT repo, path, 'src/app/db.py' AS dep FROM source_files WHERE j BETWEEN 2 AND 12 OR j = 0
        UNION ALL SELECT repo, path, 'src/app/m' || CAST(nxt AS VARCHAR) || '.py' FROM source_files WHERE j BETWEEN 2 AND 12
        UNION ALL SELECT repo, path, 'src/app/m2.py' FROM source_files WHERE j = 0
        UNION ALL SELECT repo, path, 'src/app/__init__.py' FROM source_files WHERE j = 16)
"""


def _planned(files: DataFrame) -> DataFrame:
    """Planned files with their place in the plan."""
    # ranges are cut by a sample of the rows first, so texts would be searched twice
    return cut_lineage(with_running(cut_lineage(M.planned_files(files)), ["repo"], ["order", "path"], {"position": ordinal()}))


@growing("J-08", over("source_files", _EDGES + "SELECT * FROM e"))
def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return C.planned_imports(files, _planned(files))


@growing("N-02 N-01", over("source_files", """
, p AS (SELECT repo, path, CASE WHEN j = 1 THEN 1 WHEN j <= 12 AND j >= 2 THEN 2 WHEN j = 0 THEN 3 ELSE 4 END AS stage FROM source_files WHERE j <= 12 OR j BETWEEN 16 AND 18)
SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY stage, path) AS position FROM p"""))
def dependency_order(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    planned = _planned(files)
    edges = C.planned_imports(files, planned).select("repo", F.col("path").alias("node"), "dep")
    nodes = planned.select("repo", F.col("path").alias("node"), "order")
    return G.dependency_order(nodes, edges).select("repo", F.col("node").alias("path"), "position")


@growing("N-01", over("source_files", """
SELECT repo, path AS node, CASE WHEN j BETWEEN 2 AND 12 THEN 'src/app/m9.py' ELSE path END AS scc FROM source_files WHERE j <= 12 OR j BETWEEN 16 AND 18"""))
def strong_components(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    planned = _planned(files)
    edges = C.planned_imports(files, planned).select("repo", F.col("dep").alias("src"), F.col("path").alias("dst"))
    return G.strong_components(planned.select("repo", F.col("path").alias("node")), edges)


# orders of one block of eight meet in the return flags of their lines
_LINKS = """
, g AS (SELECT DISTINCT l_suppkey % 7 AS repo, CAST(l_orderkey AS VARCHAR) AS src, 'c' || CAST(l_orderkey // 8 AS VARCHAR) || l_returnflag AS dst FROM lineitem)
"""


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return R.table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("repo"), R.text_of("l_orderkey").alias("src"),
        F.concat(F.lit("c"), F.floor(F.col("l_orderkey") / 8).cast("string"), "l_returnflag").alias("dst"),
    ).distinct()


@growing("N-03", "WITH RECURSIVE " + _LINKS.lstrip().removeprefix(",") + """
, u AS (SELECT repo, src AS a, dst AS b FROM g UNION SELECT repo, dst, src FROM g),
reach AS (SELECT DISTINCT repo, a AS node, a AS other FROM u UNION SELECT r.repo, r.node, u.b FROM reach r JOIN u ON u.repo = r.repo AND u.a = r.other)
SELECT repo, node, min(other) AS component FROM reach GROUP BY repo, node""")
def components(spark: SparkSession, folder: str) -> DataFrame:
    return G.components(_links(spark, folder))


_CALLS = """
WITH RECURSIVE s AS (SELECT user_id % 5 AS repo, event_id, 'n' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * 7 + user_id AS VARCHAR) AS node,
   lag('n' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * 7 + user_id AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
e AS (SELECT DISTINCT repo, before AS src, node AS dst FROM s WHERE before IS NOT NULL),
seeds AS (SELECT DISTINCT repo, src AS node FROM e WHERE src LIKE '%7')
"""


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("n"), (R.props_k() * 7 + F.col("user_id")).cast("string"))
    steps = R.table(spark, folder, "events").select((F.col("user_id") % 5).alias("repo"), "user_id", "ts", "event_id", name.alias("node"))
    placed = with_running(steps, ["user_id"], ["ts", "event_id"], {"before": previous(F.col("node"))})
    return placed.filter("before IS NOT NULL").select("repo", F.col("before").alias("src"), F.col("node").alias("dst")).distinct()


@growing("N-07 S-11 V-05", _CALLS + """
, r AS (SELECT repo, node, 0 AS depth FROM seeds UNION SELECT r.repo, e.dst, depth + 1 FROM r JOIN e ON e.repo = r.repo AND e.src = r.node WHERE depth < 2)
SELECT repo, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY repo, node""")
def blast_radius(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut_lineage(_calls(spark, folder))
    seeds = edges.filter("src LIKE '%7'").select("repo", F.col("src").alias("node"))
    return G.blast_radius(edges, seeds, 2)


@growing("S-11", _CALLS + """
SELECT repo, count(*) AS total_edges, count(DISTINCT src) AS sources FROM e GROUP BY repo""")
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(spark, folder).groupBy("repo").agg(F.count("*").alias("total_edges"), F.count_distinct("src").alias("sources"))


@growing("N-06", """
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 9 AS repo, 'a' || CAST(l_partkey AS VARCHAR) AS node, 'a' || CAST(CASE WHEN l_linenumber = 7 AND l_quantity > 40 AND l_returnflag = 'R' THEN l_partkey * 2 ELSE l_partkey // 2 END AS VARCHAR) AS dep
  FROM lineitem),
x AS (SELECT * FROM e WHERE node <> dep),
back AS (SELECT repo, node, dep AS goal FROM x UNION SELECT b.repo, b.node, x.dep FROM back b JOIN x ON x.repo = b.repo AND x.node = b.goal),
cyc AS (SELECT DISTINCT repo, node FROM back WHERE node = goal)
SELECT repo, node FROM cyc UNION SELECT b.repo, b.node FROM back b JOIN cyc ON cyc.repo = b.repo AND cyc.node = b.goal""")
def cycle_members(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("l_partkey")
    odd = (F.col("l_linenumber") == 7) & (F.col("l_quantity") > 40) & (F.col("l_returnflag") == "R")
    dep = F.when(odd, part * 2).otherwise(F.floor(part / 2))
    edges = R.table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 9).alias("repo"), F.concat(F.lit("a"), part.cast("string")).alias("node"), F.concat(F.lit("a"), dep.cast("string")).alias("dep")
    )
    return G.cycle_members(edges.filter("node <> dep"))


# ------------------------------------------------------------------------------------ cuts


def _cut_inputs(spark: SparkSession, folder: str, *more: str) -> dict[str, DataFrame | C.Sources]:
    files = C.read_once(_files(spark, folder), C.STATUS, "imports", "references", "defines", *more)
    planned = _planned(files)
    strategies = cut_lineage(M.test_strategy(files.filter(is_oracle_test(F.col("path")))))
    pins = K.manifest(C.interface_contract(files, _used(files)), planned)
    extra = pins.filter(F.size("companions") > 0)
    companions = extra.select("repo", "path", F.explode(F.array_append("companions", F.col("symbol"))).alias("symbol"))
    return {"files": files, "planned": planned, "strategies": strategies, "companions": cut_lineage(companions)}


_CUT_EDGES = """
, x AS (
  SELECT repo, 'src/app/m2.py' AS provider, path AS consumer, 'router_registration' AS kind, 'register_blueprint' AS operation, 'app.register_blueprint(bp)' AS evidence FROM source_files WHERE j = 0
  UNION ALL SELECT repo, 'src/app/db.py', path, 'extension_initialization', 'init_app', 'db.init_app(app)' FROM source_files WHERE j = 0
  UNION ALL SELECT repo, 'src/app/db.py', path, 'framework_state', 'call', 'db.init_app(app)' FROM source_files WHERE j = 0
  UNION ALL SELECT repo, 'src/app/db.py', path, 'framework_state', 'call', 'get_db("' || replace(p_brand, '#', '_') || '")' FROM source_files WHERE j BETWEEN 2 AND 12
  UNION ALL SELECT repo, 'src/app/db.py', path, 'resource_lifecycle', 'call', 'get_db("' || replace(p_brand, '#', '_') || '")' FROM source_files WHERE j BETWEEN 2 AND 12
  UNION ALL SELECT repo, 'src/app/__init__.py', path, 'factory_harness', 'create_app', 'create_app()' FROM source_files WHERE j = 16)
"""


@growing("J-10 N-12 T-07", over("source_files", _CUT_EDGES + "SELECT * FROM x"))
def executable_edges(spark: SparkSession, folder: str) -> DataFrame:
    c = _cut_inputs(spark, folder, "calls", "web_facts")
    return U.executable_edges(c["files"], c["planned"], c["strategies"], c["companions"])


@growing("N-04 G-25", over("source_files", """
SELECT repo, 'executable-cut-1' AS cut_id, count(*) AS size, 'batch_only' AS mode,
       ['extension_initialization', 'factory_harness', 'framework_state', 'resource_lifecycle', 'router_registration'] AS edge_kinds
FROM source_files WHERE j <= 12 OR j = 16 GROUP BY repo"""))
def executable_cuts(spark: SparkSession, folder: str) -> DataFrame:
    c = _cut_inputs(spark, folder, "calls", "web_facts")
    edges = cut_lineage(U.executable_edges(c["files"], c["planned"], c["strategies"], c["companions"]))
    return U.executable_cuts(edges, c["planned"], c["strategies"])[0]


@growing("G-25 J-20", over("source_files", "SELECT DISTINCT repo, CAST(26 AS BIGINT) AS edges, CAST(1 AS BIGINT) AS cuts, CAST(1 AS BIGINT) AS diagnostics, CAST(16 AS BIGINT) AS members FROM source_files"))
def cut_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per repository, and cut members once the sanctioned test changes are attached."""
    c = _cut_inputs(spark, folder, "calls", "web_facts")
    edges = cut_lineage(U.executable_edges(c["files"], c["planned"], c["strategies"], c["companions"]))
    cuts, members = U.executable_cuts(edges, c["planned"], c["strategies"])
    changed = c["files"].filter("path LIKE 'tests/test_%'").select("repo", "path", F.lit("src/app/__init__.py").alias("owner_path"))
    _, grown = U.attached_normalizations(members, changed, c["planned"])
    return U.cut_summary(edges, cuts).join(grown.groupBy("repo").agg(F.count("*").alias("members")), "repo")


@growing("N-05", over("source_files", """
SELECT repo, 'framework-seam-1' AS unit_id, path FROM source_files WHERE j IN (0, 1, 16)"""))
def migration_units(spark: SparkSession, folder: str) -> DataFrame:
    c = _cut_inputs(spark, folder)
    deps = cut_lineage(C.planned_imports(c["files"], c["planned"]))
    invoking = c["files"].filter(F.contains("text", F.lit(".invoke("))).select("repo", "path")
    return U.migration_units(c["planned"].select("repo", "path", "role", "position"), deps, c["companions"].select("repo", "path"), invoking)


@growing("J-21", over("source_files", """
SELECT repo, 'u1' AS unit_id, path FROM source_files WHERE j IN (0, 2, 3, 16)"""))
def filled_units(spark: SparkSession, folder: str) -> DataFrame:
    """A unit of the factory and conftest fills up in plan order: m2, and m3 which m2 imports."""
    files = _files(spark, folder)
    units = files.filter("path IN ('src/app/__init__.py', 'tests/conftest.py')").select("repo", F.lit("u1").alias("unit_id"), "path")
    return U.filled_units(units, C.bindings(files), _planned(files).select("repo", "path", "position"))


@growing("U-05", """
WITH s AS (SELECT doc_id AS repo FROM labels)
SELECT CAST(repo AS VARCHAR) AS repo, 'coordinated-unit-1' AS unit_id, p AS path FROM s, (SELECT unnest(['g', 'h']) AS p)
UNION ALL SELECT CAST(repo AS VARCHAR), 'coordinated-unit-2', p FROM s, (SELECT unnest(['a', 'b', 'c']) AS p)
UNION ALL SELECT CAST(repo AS VARCHAR), 'coordinated-unit-3', p FROM s, (SELECT unnest(['x', 'y']) AS p)""")
def merged_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units {a, b} and {g, h}; cuts {b, c}, {x, y} and {h, i, j, k}, the last too big once merged."""
    repos = R.table(spark, folder, "labels").select(R.text_of("doc_id").alias("repo"))

    def rows(name: str, sets: dict[str, str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias(name), F.lit(p).alias("path")) for i, ps in sets.items() for p in ps])
        return repos.select("repo", F.explode(pairs).alias("r")).select("repo", "r.*")

    units = rows("unit_id", {"framework-seam-1": "ab", "framework-seam-2": "gh"})
    members = rows("cut_id", {"executable-cut-1": "bc", "executable-cut-2": "xy", "executable-cut-3": "hijk"})
    cuts = members.select("repo", "cut_id").distinct().withColumn("mode", F.lit("coordinated"))
    return U.merged_units(units, cuts, members)


@growing("J-22", over("source_files", """
, f AS (SELECT repo, p_size % 2 = 0 AS has_unit FROM source_files WHERE j = 0)
SELECT repo, 'u1' AS unit_id, p AS path FROM f, (SELECT unnest(['src/app/db.py', 'src/app/__init__.py', 'tests/conftest.py']) AS p) WHERE has_unit
UNION ALL SELECT repo, 'test-adapter-seam-src/app/__init__.py', p FROM f, (SELECT unnest(['src/app/__init__.py', 'tests/conftest.py']) AS p) WHERE NOT has_unit"""))
def wired_units(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories with a unit around their factory, and others without any."""
    files = _files(spark, folder)
    planned = _planned(files)
    strategies = M.test_strategy(files.filter(is_oracle_test(F.col("path"))))
    pairs = cut_lineage(U.wiring_factories(planned, strategies, C.bindings(files)))
    with_unit = R.source_files(spark, folder).filter("j = 0 AND p_size % 2 = 0").select("repo")
    both = F.explode(F.array(F.lit("src/app/db.py"), F.lit("src/app/__init__.py")))
    units = with_unit.select("repo", F.lit("u1").alias("unit_id"), both.alias("path"))
    return U.wired_units(units, pairs, planned)
