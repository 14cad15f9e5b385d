"""What one process holds does not grow with the tables."""

import ast

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import __spark_entry__ as entry
from shiftlens.functions import syntax as X
from shiftlens.operators import code_facts as C
from shiftlens.operators import cuts as U
from shiftlens.operators import graphs as G
from shiftlens.plans import relations as R

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["contract_owners", "contract_targets", "traceback_leaves", "call_sites", "symbol_consumers", "caller_violations", "proposal_violations"])
def test_no_broadcast_by_the_size_of_the_files(spark, name):
    before = dict(spark.conf.getAll)
    planned = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in planned and "Broadcast" not in planned
    assert dict(spark.conf.getAll) == before


def test_small_sides_are_still_broadcast_once_measured(spark):
    found = entry.queries()["call_sites"](spark, FOLDER)
    found.collect()
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_facts_leave_python_in_batches():
    arrow = to_arrow_schema(StructType.fromDDL("repo string, path string, seq int, " + X.NODES))
    texts = ["x = [1, 2, 3]\n"] * 200 + ["def broken(:\n"]
    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * 201, "path": [str(i) for i in range(201)], "text": texts})
    sizes = [b.num_rows for b in C.read_facts(iter([batch]), X.nodes, arrow, 50)]
    assert sum(sizes) == 200 * 7 and max(sizes) <= 50 + 7


def test_nodes_write_out_only_what_is_asked(monkeypatch):
    """Names, dotted names and plain constants are written as by ``ast.unparse`` without it; no text without ``with_text``."""
    source = "import a\n@a.mark\ndef f(x=-1, *, y='q', z=b'q'):\n    return a.b(x)[y].c, 1.5, None, (lambda: u'k')(1 .real)\n"
    tree = ast.parse(source)
    for node in ast.walk(tree):
        if isinstance(node, ast.expr):
            assert X._said(node) == ast.unparse(node)
    whole = list(X.nodes(tree, source))
    plain = ast.parse("@a.mark\ndef f(x=1, y='q'):\n    return a.b(x, None)\n")
    said = []
    monkeypatch.setattr(ast, "unparse", lambda node: said.append(node) or "")
    assert {r["text"] for r in X.nodes(plain, "") if r["text"]} >= {"a.mark", "x", "None"} and [type(n).__name__ for n in said] == ["arguments", "Call"]
    said.clear()
    assert [r | {"text": None} for r in whole] == list(X.nodes(tree, source, with_text=False))
    assert all(isinstance(n, ast.Attribute) for n in said)


def test_tasks_grow_with_rows(spark):
    assert R.spread(spark.range(10)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(40 * R.ROWS_PER_TASK).select(F.col("id"))
    assert R.spread(many).rdd.getNumPartitions() == 40


def test_no_filter_on_texts_in_the_task_that_reads_the_file(spark):
    files = R.source_files(spark, FOLDER).filter(F.col("text").rlike("Blueprint"))
    planned = files._jdf.queryExecution().sparkPlan().toString()
    assert "Filter" in planned and "Exchange" not in planned and "FileScan" not in planned
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_what_is_bound_is_parsed_once(spark):
    """One pass for the imports and one for the names in use, two over the packages' own files."""
    files = R.source_files(spark, FOLDER).select("repo", "path", "text")
    used = C.used_symbols(C.bindings(files), C.references(files))
    assert used._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 4


def test_readers_keep_to_the_order_and_the_texts_of_ast():
    source = (
        "import a.b, c as d\nif TYPE_CHECKING:\n    from x import (y,\n        z)\n@m.route('/é', k=f(1))\nasync def f(p=u.v):\n    with open(  'ü' , q.r(s)[0]) as t:\n"
        "        try:\n            import late\n        except E:\n            from .. import w\n        else:\n            import n\n        finally:\n            import o\n"
        "    match p:\n        case [1]:\n            import g\n    return (a or b).c, (-x).y, 1 .real, 'k'.join(h\n      .i()), l[1].j, (lambda: 1).e, [].d, t().u().v\n"
    )
    tree = ast.parse(source)
    assert X._walk(tree) == [n for n in ast.walk(tree) if not isinstance(n, ast.expr_context)]
    standing = (ast.Module, ast.stmt, ast.ExceptHandler, ast.match_case)
    assert X._walk_statements(tree) == [n for n in ast.walk(tree) if isinstance(n, standing)]
    asked = [n for n in ast.walk(tree) if isinstance(n, ast.Attribute) or isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)]
    assert [r["text"] for r in X.references(tree, source)] == [ast.unparse(n) for n in asked]
    called = [n for n in ast.walk(tree) if isinstance(n, ast.Call)]
    assert [r["evidence"] for r in X.calls(tree, source)] == [" ".join(ast.get_source_segment(source, n).split()) for n in called]
    assert [r["target"] for r in X.calls(tree, source)] == [ast.unparse(n.func) for n in called]


def _stored(spark):
    from pathlib import Path

    from shiftlens.session import use_checkpoint_dir

    return {p.name for p in Path(use_checkpoint_dir(spark).removeprefix("file:")).glob("stored-*")}


def test_components_keep_one_round(spark):
    edges = spark.range(1000).select(F.lit("r").alias("repo"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    before = _stored(spark)
    found = G.components(edges)
    assert len(_stored(spark) - before) == 1
    assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(0, 1001)]
    assert G.components(edges.limit(0)).count() == 0


def test_components_keep_no_shuffle_files(spark):
    """The rounds leave nothing in the folders of the block manager, and the session's setting as it was."""
    from pathlib import Path

    folders = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p.name for d in folders for p in d.rglob("shuffle_*.data")}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    asked = spark.conf.get(key, None)
    edges = spark.range(1000).select(F.lit("r").alias("repo"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = G.components(edges)
    assert not files() - before and spark.conf.get(key, None) == asked
    assert found.count() == found.count() == 1001


def test_stars_are_told_in_one_pass(spark):
    rows = lambda *ends: spark.createDataFrame([("r", a, b) for a, b in ends], "repo string, a int, b int")
    for ends, stars in (([(2, 1), (3, 1), (5, 4)], True), ([(2, 1), (3, 1), (3, 2)], False), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False)):
        assert G._are_stars(rows(*ends), ["repo"]) == stars


def test_clusters_merge_without_a_frame_each():
    rows = [{"is_cut": c, "rank": r, "path": p} for c, r, ps in ((0, 1, "ab"), (0, 2, "gh"), (1, 1, "bc"), (1, 2, "xy"), (1, 3, "hijk"), (1, 10, "cd")) for p in ps]
    assert list(U._merged(rows, 4)) == [(0, 2, p) for p in "gh"] + [(1, 2, p) for p in "xy"] + [(1, 10, p) for p in "abcd"]


def test_definitions_take_few_nodes():
    """Nodes that say nothing on definitions neither leave Python nor are written out."""
    source = "import a\n@a.b(1)\nclass C(B):\n    x: int = f(2)\n    def __init__(self, y=g(3)):\n        self.y = h(y)[4]\n        return self\nif T:\n    z = w = k(5)\n"
    tree = ast.parse(source)
    every, kept = list(X.nodes(tree, source)), list(X.nodes(tree, source, keep=X.defines))
    assert [r for r in every if X.defines(r["kind"], r["slot"], r["within"])] == kept
    said = {(r["kind"], r["name"] or r["text"]) for r in kept}
    assert {("alias", "a"), ("Call", "a.b(1)"), ("ClassDef", "C"), ("FunctionDef", "__init__"), ("arg", "y"), ("Name", "self"), ("Call", "k(5)"), ("Name", "w")} <= said
    assert not {("Constant", "4"), ("Call", "h(y)"), ("Subscript", "h(y)[4]"), ("Name", "h")} & said and len(kept) < len(every) * 0.7


def test_role_is_sought_once(spark):
    from shiftlens.operators import migration_plan as M

    files = R.source_files(spark, FOLDER).select("repo", "path", "text")
    planned = M.planned_files(files).select("repo", "path")._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in planned and "Filter" not in planned


def test_plans_are_parsed_once_and_in_many_tasks(spark):
    found = entry.queries()["plan_violations"](spark, FOLDER)
    planned = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in planned and "events.parquet" not in planned and "variant" not in planned


def test_a_plan_that_is_an_empty_list_breaks_no_rule(spark):
    from shiftlens.operators import proposals as X

    plans = spark.createDataFrame([("a", "[]"), ("b", "[1]"), ("c", "{}"), ("d", "[" * 2), ("e", "[" + ",".join("1" * 99) + "]"), ("f", None), ("g", "null")], "plan_id string, text string")
    none = spark.createDataFrame([], "plan_id string, path string")
    rows = X.plan_violations(plans, none, none).filter("rule IN ('not_json', 'not_a_list', 'too_many_artifacts', 'not_an_object')").groupBy("plan_id", "rule").count().collect()
    assert {tuple(r) for r in rows} == {
        ("b", "not_an_object", 1), ("c", "not_a_list", 1), ("d", "not_json", 1), ("e", "too_many_artifacts", 1), ("e", "not_an_object", 99), ("f", "not_json", 1), ("g", "not_a_list", 1)
    }


def test_snapshots_are_worked_out_once(spark, monkeypatch):
    from shiftlens.sources import manifests

    saved, save = [], manifests.save_version
    monkeypatch.setattr(manifests, "save_version", lambda rows, *rest: saved.append(rows) or save(rows, *rest))
    assert entry.queries()["checkpoint_read_back"](spark, FOLDER).count() > 0
    assert len(saved) == 2 and all("Window" not in rows._jdf.queryExecution().optimizedPlan().toString() for rows in saved)


@pytest.mark.parametrize(("limit", "measured"), [("10m", 1 << 20), ("10485760b", 1 << 20), ("256k", 256 << 10), ("1000", 1000), ("-1", -1)])
def test_sides_together_do_not_fill_the_driver(spark, limit, measured):
    from shiftlens.session import beside, sized_when_run

    found = sized_when_run(beside(spark, {"spark.sql.autoBroadcastJoinThreshold": limit}))
    assert found.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == str(measured)
    assert found.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_paths_are_taken_apart_once(spark):
    from shiftlens.functions import paths as P

    planned = spark.range(1).select(F.explode(P.module_names(F.col("id").cast("string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert planned.count("regexp_extract(") == 1


def test_names_of_pins_are_worked_out_once(spark):
    planned = entry.queries()["contract_owners"](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert planned.count("__init__") == 1 and planned.count("Join") == 3


def test_frames_are_found_once(spark):
    planned = entry.queries()["traceback_leaves"](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "translate(" not in planned and "Window" in planned


def test_session_drafts_are_parsed_once(spark, monkeypatch):
    read, facts = [], C.facts
    monkeypatch.setattr(C, "facts", lambda files, *rest: read.append(files) or facts(files, *rest))
    assert entry.queries()["session_violations"](spark, FOLDER).schema.names == ["repo", "path", "symbol", "rule", "detail"]
    assert len(read) == 1


def test_installing_takes_few_nodes():
    """Calls, definitions and arguments leave Python; only what is passed to calls is written out again."""
    source = "class C:\n    def f(self):\n        x = [g(1)[2], 3]\n        app.add(C, m(D), k=Q.run, l=[4])\n        return a.session['b'] + x\n"
    tree = ast.parse(source)
    every, kept = list(X.nodes(tree, source)), list(X.nodes(tree, source, with_text=X.is_argument, keep=X.installs))
    assert [r | {"text": None} for r in every if X.installs(r["kind"], r["slot"], r["within"])] == [r | {"text": None} for r in kept]
    assert len(kept) < len(every) * 0.6
    assert [r["text"] for r in kept if r["text"] is not None] == ["1", "C", "m(D)", "D", "Q.run", "[4]"]


def test_a_text_that_stands_twice_is_read_once():
    arrow = to_arrow_schema(StructType.fromDDL("repo string, path string, seq int, name string"))
    texts = ["x = 1", "y = 2", "x = 1", "broken(", "x = 1", "#" * C.SHORT_TEXT + "\nz = 1", "#" * C.SHORT_TEXT + "\nz = 1"]
    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * 7, "path": [str(i) for i in range(7)], "text": texts})
    read = []
    found = [r for b in C.read_facts(iter([batch]), lambda tree, text: read.append(text) or [{"name": text[0]}], arrow, 50) for r in b.to_pylist()]
    assert [(r["path"], r["seq"], r["name"]) for r in found] == [("0", 0, "x"), ("1", 0, "y"), ("2", 0, "x"), ("4", 0, "x"), ("5", 0, "#"), ("6", 0, "#")]
    assert read == ["x = 1", "y = 2", texts[5], texts[5]]


def test_resources_are_read_once(spark, monkeypatch):
    """One pass over the drafts and one over the old files, for nodes and imports together."""
    read, passes = [], (C.facts, C.facts_apart)
    monkeypatch.setattr(C, "facts", lambda files, *rest: read.append(files) or passes[0](files, *rest))
    monkeypatch.setattr(C, "facts_apart", lambda files, *rest: read.append(files) or passes[1](files, *rest))
    assert entry.queries()["lifecycle_violations"](spark, FOLDER).schema.names == ["repo", "path", "symbol", "rule", "detail"]
    assert len(read) == 2


def test_flow_is_followed_file_by_file(spark):
    from shiftlens.operators import flow

    files = spark.createDataFrame([("r", "a.py", "def f():\n    a = open(1)\n    g()\n    a.close()\n")], "repo string, path string, text string")
    planned = flow.flow_edges(C.nodes(files))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in planned


def test_what_hangs_on_a_node_is_told_with_it():
    from shiftlens.operators import lifecycle as L

    source = (
        "V = ContextVar('v')\ndef f(app, p=out):\n    app.cli.add(x, 'b', k=None)\n    g.db = app.state.config.copy()\n    c = m['K']\n"
        "    with open('a' 'b', mode='rb') as t:\n        t.read().decode()\ndef w():\n    out = open(q)\n    out.close()\n"
    )
    found = list(X.held(ast.parse(source), source, L.OPENERS, L.OLD_MEMBERS, L.AMBIENT, L.HOLDER))
    told = {r["label"] if r["kind"] == "Call" else (r["kind"], r["name"] or r["line"]): r for fact, r in found if fact == "told"}
    call, entered = told["Call:app.cli.add"], told["Call:open"]
    assert call["first"] == {"kind": "Name", "name": "x", "text": "x"} and call["second"] == "'b'" and call["keywords"] == [{"keyword": "k", "value": "None"}]
    assert told["Attribute", "cli"]["owner"]["text"] == "app" and told["Attribute", "db"]["owner"]["name"] == "g"
    assert (told["Assign", 1]["assigned"], told["Assign", 1]["owner"]["label"]) == (["V"], "Call:ContextVar")
    assert told["Assign", 4]["owner"]["text"] == "app.state.config.copy()" and told["Subscript", 5]["key"] == "'K'" and told["Subscript", 5]["owner"]["text"] == "m"
    assert told["Call:t.read().decode"]["around"] and {k[0] for k in told if isinstance(k, tuple)} >= {"Module", "FunctionDef", "arg", "Name"}
    assert entered["first"] and {r["line"] for fact, r in found if fact == "watched" and r["line"]} == {8, 9, 10}


@pytest.mark.parametrize(("name", "passes"), [("draft_violation_counts", 2), ("cut_reports", 1)])
def test_sources_are_parsed_once(spark, monkeypatch, name, passes):
    """One pass over the files, one over the drafts, whatever is asked of them."""
    read, (one, apart, status) = [], (C.facts, C.facts_apart, C._parses)
    monkeypatch.setattr(C, "facts", lambda files, *rest: (isinstance(files, C.Sources) or read.append(files)) and None or one(files, *rest))
    monkeypatch.setattr(C, "facts_apart", lambda files, *rest: read.append(files) or apart(files, *rest))
    monkeypatch.setattr(C, "_parses", lambda texts: read.append(texts) or status(texts))
    planned = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert len(read) == passes and "MapInArrow" not in planned and "PythonUDF" not in planned


def test_sources_give_what_files_give(spark):
    texts = {"pkg/__init__.py": "from .b import f\nK = 1\n", "pkg/b.py": "import os as o\n@x.route('/p')\ndef f(a, *, b=nope):\n    global G\n    G = o.path(a).q\n", "pkg/c.py": "def (:\n", "pkg/d.py": ""}
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, text string")
    once = C.read_once(files, C.STATUS, "imports", "calls", "references", "bound_names", "web_facts", "defines", "scopes")
    rows = lambda df: sorted(map(repr, df.collect()))
    for read in (C.parse_status, C.imports, C.calls, C.references, C.bound_names, C.web_facts, C.definitions, C.undefined_globals, C.reexported, C.bindings):
        assert rows(read(once)) == rows(read(files)), read.__name__
    assert rows(C.imports(once.filter("path LIKE '%b.py'"))) == rows(C.imports(files.filter("path LIKE '%b.py'")))
