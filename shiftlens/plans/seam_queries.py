"""Queries on the life of resources and request state in old code and in drafts of the new code.

Every part gives one resource module, its draft and a draft that uses it.  What each holds or lacks is decided by bits of
the part's key, one for every peculiarity, so that they occur in all combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import syntax as X
from ..operators import code_facts as C
from ..operators import lifecycle as L
from . import relations as R
from .catalogue import growing

_BITS = 1 << 17


def _mixed() -> Column:
    return (F.col("p_partkey") * 69069) % _BITS


def _bit(i: int) -> Column:
    return F.floor(_mixed() / (1 << i)) % 2 == 1


def _old(i: int) -> Column:
    return F.floor(F.col("p_partkey") / (3 << i)) % 2 == 1


_PARTS_SQL = f"""
WITH h AS (SELECT 'r' || CAST(p_partkey // 20 AS VARCHAR) AS repo, CAST(p_partkey AS VARCHAR) AS k, replace(p_brand, '#', '_') AS brand, CAST(p_size AS VARCHAR) AS size,
                  (p_partkey * 69069) % {_BITS} AS m, p_partkey // 3 AS o FROM part),
d AS (SELECT repo, 'src/app/res' || k || '.py' AS path, 'src/app/use' || k || '.py' AS user_path, brand, size,
             o % 2 = 1 AS files, o // 2 % 2 = 1 AS caches, o // 4 % 2 = 1 AS cleans, o // 8 % 2 = 1 AS threads,
             {", ".join(f"m // {1 << i} % 2 = 1 AS b{i}" for i in range(17))} FROM h)"""


def _filled(text: Column) -> Column:
    for mark, value in (("@key", R.text_of("p_partkey")), ("@brand", F.translate("p_brand", "#", "_")), ("@size", R.text_of("p_size"))):
        text = F.replace(text, F.lit(mark), value)
    return text


def _joined(*pieces: str | Column) -> Column:
    return _filled(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]))


def _either(condition: Column, then: str, otherwise: str = "") -> Column:
    return F.when(condition, F.lit(then)).otherwise(F.lit(otherwise))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = R.table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    repo = F.concat(F.lit("r"), F.floor(F.col("p_partkey") / 20).cast("string"))
    return R.spread(parts).withColumn("repo", repo).withColumn("path", _joined("src/app/res@key.py"))


def _old_files(spark: SparkSession, folder: str) -> DataFrame:
    text = _joined(
        "from flask import current_app, g\n", _either(_old(3), "import sqlite3\n", "import driver\n"),
        "\ndef get_db():\n",
        _either(_old(1), "    if 'db' not in g:\n        g.conn_@size = "), _either(~_old(1), "    return "),
        _either(_old(3), "sqlite3", "driver"), '.connect(current_app.config["DB_@brand"], current_app.config.get("MODE"))\n', _either(_old(1), "    return g.conn_@size\n"),
        _either(_old(0), '\ndef load():\n    with current_app.open_resource("schema_@size.sql") as f:\n        return f.read()\n'),
        _either(_old(2), '\ndef close_db(error=None):\n    db = g.pop("db", None)\n    if db is not None:\n        db.close()\n', "\ndef idle():\n    pass\n"),
        "\ndef init_app(app):\n    app.teardown_appcontext(print)\n",
    )
    return _rows(spark, folder).select("repo", "path", text.alias("text"))


def _drafts(spark: SparkSession, folder: str) -> DataFrame:
    b = _bit
    draft = _joined(
        "import sqlite3\nfrom contextvars import ContextVar\n\n",
        "def export(rows):\n", '    out = open("a.txt", "w")\n',
        _either(b(14), "", "    if not rows:\n        return 0\n"),
        _either(b(15), "    try:\n        out.write(rows)\n    finally:\n        out.close()\n", "    out.write(rows)\n    out.close()\n"),
        "    return 1\n\n_state = ContextVar('state')\n\ndef get_db():\n",
        _either(b(0), "    name = current_app\n"), _either(b(4), "    audit()\n"), _either(b(1), "    if _state.get(None):\n        return _state.get()\n"),
        "    conn = sqlite3.connect('x'", _either(b(2), ", check_same_thread=False"), ")\n",
        _either(b(3), "    _state.set(conn)\n", "    _state.set({'db': conn})\n"), "    return conn\n",
        "\ndef audit():\n    return note()\n\ndef note():\n    return request.path\n",
        _either(b(5), "\ndef init_app(app):\n    global _config\n"),
        F.when(b(5), _either(b(6), "    _config = app.state.config['DB_@brand']\n", "    _config = None\n")).otherwise(""),
        F.when(b(5), _either(b(7), "    app.state.cleanups.append(close_db)\n")).otherwise(""),
        F.when(b(5), _either(b(8), "    app.cli.add_command(load)\n")).otherwise(""),
        _either(b(9), "\ndef close_db(error=None):\n    held = _state.get(None)\n"),
        F.when(b(9), _either(b(10), "    held.close()\n", "    held.rollback()\n")).otherwise(""), F.when(b(9), _either(b(11), "    _state.set(None)\n")).otherwise(""),
        "\ndef load():\n    with open(", _either(b(12), "'schema_@size.sql'", "PLACE"), _either(b(13), ", 'rb'"), ") as f:\n        return f.read().decode('utf8')\n",
    )
    user = _joined(
        "from .res@key import get_db_dep as dep\nfrom fastapi import Depends\n\ndef page(db=", _either(b(16), "Depends(dep)", "None"), "):\n    return ", _either(b(16), "db", "dep()"), "\n",
    )
    rows = _rows(spark, folder)
    return rows.select("repo", "path", draft.alias("text")).unionByName(rows.select("repo", _joined("src/app/use@key.py").alias("path"), user.alias("text")))


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    helpers = _rows(spark, folder).select("repo", "path", F.lit("get_db").alias("symbol"), F.lit("get_db_dep").alias("dependency"))
    return L.resource_decisions(L.held(_old_files(spark, folder))[0], helpers)


@growing("E-21 E-20", _PARTS_SQL + """
SELECT repo, path, 'get_db' AS symbol, 'get_db_dep' AS dependency, 'DB_' || brand || ',MODE' AS config_keys, CASE WHEN caches THEN 'conn_' || size ELSE '' END AS cache_members,
       CASE WHEN files THEN 'schema_' || size || '.sql' ELSE '' END AS resource_files, CASE WHEN cleans THEN 'close_db' ELSE '' END AS cleanup_functions,
       'init_app' AS initializer, threads AS cross_thread FROM d""")
def resource_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What every direct resource helper has to keep, read off the old module."""
    lists = ("config_keys", "cache_members", "resource_files", "cleanup_functions")
    return _decisions(spark, folder).withColumns({c: F.array_join(c, ",") for c in lists})


@growing("E-17", _PARTS_SQL + """
SELECT repo, path, 'get_db' AS symbol, 'reads_request_state' AS rule, path || '::get_db reads current_app' AS detail FROM d WHERE b0
UNION ALL SELECT repo, path, 'get_db', 'reads_request_state', path || '::get_db > ' || path || '::audit > ' || path || '::note reads request' FROM d WHERE b4
UNION ALL SELECT repo, path, 'get_db', 'opens_on_every_call', '' FROM d WHERE caches AND NOT b1
UNION ALL SELECT repo, path, 'get_db', 'live_connection_in_context', 'conn' FROM d WHERE caches AND b3
UNION ALL SELECT repo, path, 'init_app', 'initializer_missing', '' FROM d WHERE NOT b5
UNION ALL SELECT repo, path, 'init_app', 'config_not_copied', CASE WHEN b6 THEN 'MODE' ELSE 'DB_' || brand || ',MODE' END FROM d WHERE b5
UNION ALL SELECT repo, path, 'init_app', 'invents_cleanup_storage', 'close_db' FROM d WHERE b5 AND b7 AND cleans
UNION ALL SELECT repo, path, 'init_app', 'old_application_member', 'app.cli' FROM d WHERE b5 AND b8
UNION ALL SELECT repo, path, 'close_db', 'cleanup_missing', '' FROM d WHERE cleans AND NOT b9
UNION ALL SELECT repo, path, 'close_db', 'cleanup_keeps_open', '' FROM d WHERE cleans AND b9 AND NOT b10
UNION ALL SELECT repo, path, 'close_db', 'cleanup_keeps_entry', '' FROM d WHERE cleans AND caches AND b9 AND b10 AND NOT b11
UNION ALL SELECT repo, path, 'connect', 'connection_of_one_thread', CAST(11 + CASE WHEN b14 THEN 0 ELSE 2 END + CASE WHEN b15 THEN 4 ELSE 2 END + CASE WHEN b0 THEN 1 ELSE 0 END
       + CASE WHEN b4 THEN 1 ELSE 0 END + CASE WHEN b1 THEN 2 ELSE 0 END AS VARCHAR) FROM d WHERE threads AND NOT b2
UNION ALL SELECT repo, path, 'f', 'resource_from_working_directory', 'schema_' || size || '.sql' FROM d WHERE files AND b12
UNION ALL SELECT repo, path, 'f', 'decodes_text', CAST(19 + CASE WHEN b14 THEN 0 ELSE 2 END + CASE WHEN b15 THEN 4 ELSE 2 END + CASE WHEN b0 THEN 1 ELSE 0 END + CASE WHEN b4 THEN 1 ELSE 0 END
       + CASE WHEN b1 THEN 2 ELSE 0 END + CASE WHEN b5 THEN 4 + CASE WHEN b7 THEN 1 ELSE 0 END + CASE WHEN b8 THEN 1 ELSE 0 END ELSE 0 END
       + CASE WHEN b9 THEN 4 + CASE WHEN b11 THEN 1 ELSE 0 END ELSE 0 END + 3 AS VARCHAR) FROM d WHERE NOT b13
UNION ALL SELECT repo, path, 'out', 'resource_leaks', '5>6>7' FROM d WHERE NOT b14
UNION ALL SELECT repo, path, 'out', 'resource_leaks_on_error', '5>6' FROM d WHERE b14 AND NOT b15
UNION ALL SELECT repo, user_path, 'get_db_dep', 'dependency_called', '5' FROM d WHERE NOT b16""")
def lifecycle_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Seventeen rules on resources in drafts, each broken and kept; two of them follow the flow of control, one the calls."""
    drafts = _drafts(spark, folder)
    named = C.names_of(drafts).withColumnRenamed("name", "module_name")
    return L.resource_violations(*L.held(drafts), named, _decisions(spark, folder))


def _session_drafts(spark: SparkSession, folder: str) -> DataFrame:
    b = _bit
    provider = _joined(
        "from contextvars import ContextVar\nfrom .sess@key import current\n", _either(b(0), "_state = ContextVar('s')\n", "_state = {}\n"),
        "\nclass Context:\n    async def ", _either(b(1), "dispatch", "handle"), "(self, request, call_next):\n        return await call_next(request)\n",
        "\ndef wire(app):\n    ", _either(b(2), "app.add_middleware(Context)\n", "pass\n"), "\ndef flash(request, text):\n    ",
        F.when(b(3), F.lit("request.session['m'] = text\n")).otherwise(_either(b(5), "current(request).update(m=text)\n", "print(text)\n")),
        _either(b(4), "    text.set_cookie('a', 'b')\n"),
    )
    helper = _joined("def current(request):\n    return request.session\n")
    factory = _joined(
        "from starlette.middleware.sessions import SessionMiddleware as Sess\nfrom .ctx@key import Context, flash\n\ndef create_app():\n    app = FastAPI(",
        F.when(b(6), _either(b(13), "middleware=[Middleware(Context), Middleware(Sess)], ", "middleware=[Middleware(Sess), Middleware(Context)], ")).otherwise(""),
        _either(b(7), "lifespan=Context.run, "), ")\n", _either(b(8), "    app.add_middleware(Context)\n"), _either(b(9), "    app.add_middleware(Sess, secret_key='x')\n"),
        _either(b(10), "    app.add_middleware(Context)\n"), _either(b(11), "    holder = Sess(app)\n"), _either(b(12), "    flash(None, 'x')\n"), "    return app\n",
    )
    tests = _joined(_either(b(14), "from .ctx@key import _state\n"), _either(b(15), "from contextvars import ContextVar\nown = ContextVar('t')\n", "own = 1\n"))
    rows = _rows(spark, folder)
    some = [("ctx", provider), ("sess", helper), ("app", factory), ("tctx", tests)]
    files = F.explode(F.array(*[F.struct(_joined(f"src/app/{name}@key.py").alias("path"), text.alias("text")) for name, text in some]))
    return rows.select("repo", files.alias("f")).select("repo", "f.path", "f.text")


@growing("E-17", _PARTS_SQL + """
, s AS (SELECT *, replace(path, '/res', '/ctx') AS ctx, replace(path, '/res', '/app') AS app, replace(path, '/res', '/tctx') AS tctx, replace(path, '/res', '/sess') AS sess FROM d)
SELECT repo, app AS path, 'Sess' AS symbol, 'session_middleware_called' AS rule, '' AS detail FROM s WHERE b11
UNION ALL SELECT repo, app, NULL, 'session_middleware_not_installed', '' FROM s WHERE NOT b6 AND NOT b9
UNION ALL SELECT repo, app, 'create_app', 'session_outside_request', app || '::create_app > ' || ctx || '::flash' FROM s WHERE b12 AND b3
UNION ALL SELECT repo, app, 'create_app', 'session_outside_request', app || '::create_app > ' || ctx || '::flash > ' || sess || '::current' FROM s WHERE b12 AND NOT b3 AND b5
UNION ALL SELECT repo, ctx, NULL, 'no_request_session', '' FROM s WHERE NOT b3 AND NOT b5
UNION ALL SELECT repo, ctx, 'set_cookie', 'writes_cookies', '' FROM s WHERE b4 AND NOT b16
UNION ALL SELECT repo, ctx, 'add_middleware', 'provider_installs_middleware', 'app' FROM s WHERE b2
UNION ALL SELECT repo, ctx, NULL, 'no_context_variable', '' FROM s WHERE NOT b0
UNION ALL SELECT repo, ctx, 'Context', 'context_class_without_dispatch', '' FROM s WHERE NOT b1
UNION ALL SELECT repo, tctx, NULL, 'parallel_context', '' FROM s WHERE NOT b14 OR b15
UNION ALL SELECT repo, app, 'Context', 'context_not_installed', '' FROM s WHERE NOT b6 AND NOT b8 AND NOT b10
UNION ALL SELECT repo, app, NULL, 'context_outside_session', '' FROM s WHERE b9 AND b10 OR b6 AND b13
UNION ALL SELECT repo, app, 'Context', 'context_as_lifespan', 'Context.run' FROM s WHERE b7""")
def session_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rules on sessions and ambient state in drafts; calls are followed over files, with the chain as witness."""
    drafts = _session_drafts(spark, folder)
    role = lambda surface, role, name, only=None: (surface, role, name, F.lit(True) if only is None else only)
    roles = [
        role("session", "provider", "ctx"), role("session", "factory", "app"), role("session", "cookie_writer", "ctx", _bit(16)),
        role("ambient", "provider", "ctx"), role("ambient", "factory", "app"), role("ambient", "test_provider", "tctx"),
    ]
    each = F.explode(F.array(*[
        F.struct(F.lit(surface).alias("surface"), F.lit(what).alias("role"), _joined(f"src/app/{name}@key.py").alias("path"), only.alias("only")) for surface, what, name, only in roles
    ]))
    rows = _rows(spark, folder)
    surfaces = rows.select("repo", each.alias("s")).filter("s.only").select("repo", "s.surface", "s.role", "s.path")
    owners = rows.select("repo", _joined("src/app/ctx@key.py").alias("path"), F.lit("Context").alias("symbol"))
    named = C.names_of(drafts).withColumnRenamed("name", "module_name")
    found, brought = C.nodes_and_imports(drafts, *L.SESSION_COLUMNS, keep=X.installs, said=X.is_argument)
    return L.session_violations(found, brought, named, surfaces, owners)
