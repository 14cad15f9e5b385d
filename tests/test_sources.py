"""Manifest, reports, sinks, rule sets and contract edge cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shiftlens import rules
from shiftlens.operators import code_facts as C
from shiftlens.operators import contracts as K
from shiftlens.operators import evaluation as E
from shiftlens.operators import sets
from shiftlens.sources import corpus, job_reports, sinks


def manifest(tmp_path, text):
    path = tmp_path / "corpus.toml"
    path.write_text(text)
    return str(path)


def test_corpus(spark, tmp_path):
    good = '[[repos]]\nname = "a"\nrepo_url = "./a"\nrecipe = "r"\nextra = 1\n'
    rows = corpus.load(spark, manifest(tmp_path, good)).collect()
    assert [(r["name"], r["tier"], r["test_args"], r["test_env"]) for r in rows] == [("a", "", [], None)]
    for bad in ("", '[[repos]]\nname = "a"\n', '[[repos]]\nname = "a"\nrepo_url = "https://x"\nrecipe = "r"\n'):
        with pytest.raises(ValueError):
            corpus.load(spark, manifest(tmp_path, bad))


def test_unknown_names_raise(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    sets.require_known(rows, rows, "name", "repos")
    with pytest.raises(ValueError, match="unknown repos: b"):
        sets.require_known(rows, rows.filter("name = 'a'"), "name", "repos")


@pytest.mark.parametrize("key", ["../x", "/etc/passwd", "a/../../root-x/y", "", "."])
def test_store_path_stays_inside(key):
    with pytest.raises(ValueError):
        sinks.store_path("/data/root", key)


def test_store_path():
    assert sinks.store_path("/data/root", "a/./b/../c.txt") == "/data/root/a/c.txt"


def test_append_by_suite_keeps_earlier_rows(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2)], "suite string, corpus_name string, n int")
    for _ in range(2):
        sinks.append_by_suite(rows, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).groupBy("suite").count().orderBy("suite").collect() == [("s1", 2), ("s2", 2)]


def test_report_files(spark, tmp_path):
    (tmp_path / "1.json").write_text('{\n "job_id": "j", "tasks_total": 2, "recovery": {"visits": null}, "other": 1}')
    row = job_reports.flat(job_reports.read(spark, str(tmp_path))).first()
    assert (row["tasks_total"], row["recover_visits"], row["cost_usd"], row["migration_outcome"]) == (2, 0, 0.0, "failed")


def test_rule_sets():
    found = rules.get("flask_to_fastapi")
    assert isinstance(found, rules.RuleSet)
    assert rules.known() == ["flask_to_fastapi"]
    assert rules.get("other") is None
    assert rules.hook(found, "pin_rules") is not None
    assert rules.hook(found, "materialize_artifact_contracts") is None


def test_one_run_has_no_variance(spark):
    run = spark.createDataFrame(
        [("s", "c", "baseline", "d", "green", 0, 0)], "suite string, corpus_name string, scenario string, driver_model string, status string, tests_total int, tests_passed int"
    )
    got = {r["metric"]: (r["mean"], r["variance"]) for r in E.cell_metrics(run, ["suite_green", "test_pass_rate"]).collect()}
    assert got == {"suite_green": (1.0, 0.0), "test_pass_rate": (0.0, 0.0)}


def files_of(spark, **texts):
    rows = [("r", path.replace("__", "/") + ".py", text) for path, text in texts.items()]
    return spark.createDataFrame(rows, "repo string, path string, text string")


def test_package_reexport_is_a_symbol(spark):
    def binding(init):
        files = spark.createDataFrame(
            [("r", "pkg/__init__.py", init), ("r", "pkg/app.py", "app = 1"), ("r", "use.py", "from pkg import app")],
            "repo string, path string, text string",
        )
        found = C.bindings(files).filter("importer = 'use.py'").select("path", "symbol").collect()
        return sorted((r["path"], r["symbol"]) for r in found)

    assert ("pkg/app.py", None) not in binding("from .app import app")
    assert ("pkg/app.py", None) in binding("from . import app")


def test_star_import_and_broken_importer_bind_nothing(spark):
    files = files_of(spark, db="x = 1", a="from db import *", b="import db as (")
    assert C.bindings(files).count() == 0


def test_two_rules_for_one_symbol_stop_the_query(spark):
    contract = spark.createDataFrame([("r", "a.py", "f", "function", "def f()", None)], "repo string, path string, symbol string, kind string, signature string, shape string")
    planned = spark.createDataFrame([("r", "a.py", "support", ["s"])], "repo string, path string, role string, subtasks array<string>")
    rule = K.PinRule("s", lambda: F.lit(True))
    assert K.manifest(contract, planned, [rule]).count() == 1
    with pytest.raises(PySparkException, match="pin conflict"):
        K.manifest(contract, planned, [rule, rule]).collect()


def test_replacement_refuses_drift(spark):
    files = files_of(spark, a="one\r\ntwo\nthree")
    change = spark.createDataFrame([("r", "a.py", 1, "one", "1")], "repo string, path string, line int, before string, after string")
    assert K.normalized_lines(files, change).first()["text"] == "1\r\ntwo\nthree"
    with pytest.raises(PySparkException, match="drift"):
        K.normalized_lines(files, change.withColumn("before", F.lit("other"))).collect()
    with pytest.raises(PySparkException, match="beyond"):
        K.normalized_lines(files, change.withColumn("line", F.lit(9))).collect()


def test_shape_facts(spark):
    text = "def f(a, /, b, c=1, *d, e, g=2, **h):\n    def w():\n        yield 1\n    return w\nasync def k():\n    yield 2\n"
    found = {r["name"]: r["shape"] for r in C.definitions(files_of(spark, a=text)).collect()}
    f = found["f"]
    assert (f["required_positional_names"], f["required_keyword_only"], f["positional_capacity"]) == (["a", "b"], ["e"], 3)
    assert f["keyword_names"] == ["b", "c", "e", "g"]
    assert (f["accepts_varargs"], f["accepts_varkw"], f["is_generator"], f["returns_nested_function"]) == (True, True, False, True)
    assert (found["k"]["is_async"], found["k"]["is_generator"]) == (True, True)


def _write(spark, path, text):
    from shiftlens.sources import manifests

    folder, name = path.rsplit("/", 1)
    manifests._put(spark, folder, name, text)


def test_checkpoint_versions(spark, tmp_path):
    """Read back; the newest counts; a torn write, a malformed or missing file, or rows that do not fit read as what was before, or empty."""
    from shiftlens.sources import manifests

    folder, schema = f"file://{tmp_path}/versions", "path string, hash string"
    rows = lambda found: sorted(tuple(r) for r in found.collect())
    assert rows(manifests.load_version(spark, folder, schema)) == []
    first = spark.createDataFrame([("a.py", "1"), ("b.py", None)], schema)
    manifests.save_version(first, folder, 1)
    assert rows(manifests.load_version(spark, folder, schema)) == [("a.py", "1"), ("b.py", None)]
    second = manifests.save_version(spark.createDataFrame([("a.py", "2")], schema), folder, 2)
    assert rows(manifests.load_version(spark, folder, schema)) == [("a.py", "2")]
    # a writer that died before its pointer moved
    first.write.parquet(f"{folder}/v-00000003-{'0' * 32}/rows")
    assert rows(manifests.load_version(spark, folder, schema)) == [("a.py", "2")]
    assert rows(manifests.load_version(spark, folder, "path string, other string")) == []
    good = (tmp_path / "versions" / second / "manifest.json").read_text()
    for text in ("{", "[]", "{}", good.replace('"rows": 1', '"rows": 7'), good.replace("number", "n")):
        _write(spark, f"{folder}/{second}/manifest.json", text)
        assert rows(manifests.load_version(spark, folder, schema)) == []
    _write(spark, f"{folder}/{second}/manifest.json", good)
    assert rows(manifests.load_version(spark, folder, schema)) == [("a.py", "2")]
    for text in ("../../elsewhere", "v-1", f"v-00000009-{'1' * 32}", ""):
        _write(spark, f"{folder}/CURRENT", text)
        assert rows(manifests.load_version(spark, folder, schema)) == []
    _write(spark, f"{folder}/CURRENT", second)
    manifests.discard_versions(spark, folder)
    assert rows(manifests.load_version(spark, folder, schema)) == []
