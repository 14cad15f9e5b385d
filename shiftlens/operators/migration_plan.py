"""What to migrate in a repository, from the text and the syntax of its files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import patterns as I
from . import code_facts as C

# Basenames a new module may take.
NEW_BASENAMES = (
    "authentication.py", "database.py", "testing.py", "context.py", "session.py", "templating.py",
    "runtime_context.py", "runtime.py", "compat.py", "support.py", "adapters.py",
)


def planned_files(files: DataFrame) -> DataFrame:
    """Files to change with role, order and subtasks; sorted by (order, path) by a reader."""
    # not a column and a filter on it, which would search the text twice
    with_role = files.select("repo", "path", "text", F.explode(F.array_compact(F.array(I.role(F.col("path"), F.col("text"))))).alias("role"))
    return with_role.select(
        "repo", "path", "role", I.role_order(F.col("role")).alias("order"), I.subtasks(F.col("role"), F.col("text")).alias("subtasks")
    )


def matching_repos(files: DataFrame) -> DataFrame:
    """Whether any file of a repository imports the framework family."""
    return files.groupBy("repo").agg(F.max(I.has(F.col("text"), "framework_family_import")).alias("matches"))


def wants_new_modules(files: DataFrame) -> DataFrame:
    """Whether a repository has a shared surface that needs a module of its own."""
    text, path = F.col("text"), F.col("path")
    surface = reduce(Column.__or__, [I.has(text, n) for n in ("templates", "session_flash", "login", "database")])
    direct = P.is_recipe_test(path) & (P.basename(path) != "conftest.py") & text.contains(".test_client(")
    by_text = files.groupBy("repo").agg(F.max(surface | direct).alias("by_text"))
    by_import = context_imports(files).select("repo").distinct().withColumn("by_import", F.lit(True))
    return by_text.join(by_import, "repo", "left").select(
        "repo", (F.col("by_text") | F.coalesce("by_import", F.lit(False))).alias("wants_new_modules")
    )


def context_imports(files: DataFrame) -> DataFrame:
    """Single-line imports of context globals in tests: one row per imported name.

    Lines with a comment or several statements are left alone.
    """
    tests = files.filter(P.is_recipe_test(F.col("path")))
    rows = C.imports(tests).filter("is_from AND module = 'flask' AND level = 0")
    chosen = F.col("name").isin(*I.CONTEXT_GLOBALS)
    lines = tests.select("repo", "path", F.posexplode(F.split("text", "\n", -1)).alias("at", "before"))
    lines = lines.withColumn("line", F.col("at") + 1).drop("at")
    whole = ~F.col("before").contains("#") & ~F.col("before").contains(";") & ~F.col("before").rlike(r"\(\s*$")
    joined = rows.join(lines, ["repo", "path", "line"]).filter(whole)
    picked = joined.filter(chosen).select("repo", "path", "line").distinct()
    return joined.join(picked, ["repo", "path", "line"], "left_semi").select(
        "repo", "path", "line", "before", "name", "local", "seq", chosen.alias("selected")
    )


def test_normalizations(found: DataFrame, owners: DataFrame) -> DataFrame:
    """Replacement lines for context imports, where one new module owns all the names.

    ``owners`` is (repo, owner_path, exports) with one row per exported name; repositories with
    several owners get none.  A line carries a handful of names, so its names are gathered.
    """
    single = owners.groupBy("repo").agg(
        F.min("owner_path").alias("owner_path"), F.max("owner_path").alias("_last")
    ).filter("owner_path = _last").drop("_last")
    exported = owners.select("repo", F.col("export").alias("name")).distinct()
    selected = found.filter("selected")
    incomplete = selected.join(exported, ["repo", "name"], "left_anti").select("repo", "path").distinct()
    module = F.replace(F.regexp_replace("owner_path", r"\.py$", ""), F.lit("/"), F.lit("."))

    def names(wanted: Column) -> Column:
        alias = F.when(F.col("local") == F.col("name"), F.col("name")).otherwise(F.concat_ws(" as ", "name", "local"))
        rows = F.array_sort(F.collect_list(F.when(wanted, F.struct("seq", alias.alias("text")))))
        return F.array_join(F.transform(rows, lambda r: r["text"]), ", ")

    lines = found.join(incomplete, ["repo", "path"], "left_anti").groupBy("repo", "path", "line", "before").agg(
        names(F.col("selected")).alias("moved"), names(~F.col("selected")).alias("kept")
    )
    indent = F.regexp_extract("before", r"^\s*", 0)
    moved = F.concat(indent, F.lit("from "), module, F.lit(" import "), F.col("moved"))
    kept = F.when(F.col("kept") != "", F.concat(indent, F.lit("from flask import "), F.col("kept")))
    return lines.join(single, "repo").select(
        "repo", "path", "line", "before", F.concat_ws("\n", kept, moved).alias("after"), "owner_path"
    )


def surfaces(files: DataFrame) -> DataFrame:
    """(repo, surface, path): the files that show each shared surface, in one pass over the text."""
    hits = F.array_compact(F.array(*[F.when(I.has(F.col("text"), idiom), F.lit(name)) for name, idiom in I.SURFACES.items()]))
    return files.select("repo", "path", F.explode(hits).alias("surface"))


def requirements(found: DataFrame, planned: DataFrame) -> DataFrame:
    """Surfaces with at least two planned consumers, which then need exactly one owner."""
    consumers = found.join(planned.select("repo", "path"), ["repo", "path"], "left_semi").distinct()
    wide = consumers.groupBy("repo", "surface").agg(F.count("*").alias("consumers")).filter("consumers >= 2")
    return wide


def direct_test_members(files: DataFrame) -> DataFrame:
    """Members of the application object that tests other than conftest use."""
    tests = files.filter(P.is_recipe_test(F.col("path")) & (P.basename(F.col("path")) != "conftest.py"))
    refs = C.references(tests).filter("owner IS NOT NULL")
    return refs.filter(F.col("name").isin(*I.DIRECT_TEST_MEMBERS)).select("repo", F.col("name").alias("member")).distinct()


def ownership_violations(required: DataFrame, owners: DataFrame, planned_consumers: DataFrame, declared: DataFrame) -> DataFrame:
    """Required surfaces without exactly one owner, and owners that leave out consumers.

    ``owners`` is (repo, surface, owner), ``declared`` (repo, owner, path) the consumers an owner
    lists, ``planned_consumers`` (repo, surface, path) those it must list.
    """
    counted = required.join(
        owners.groupBy("repo", "surface").agg(F.count("*").alias("n"), F.min("owner").alias("owner")), ["repo", "surface"], "left"
    ).withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = counted.filter("n <> 1").select(
        "repo", "surface", F.lit("owner_count").alias("rule"), F.col("n").cast("string").alias("detail")
    )
    single = counted.filter("n = 1").select("repo", "surface", "owner")
    omitted = (
        single.join(planned_consumers, ["repo", "surface"])
        .join(declared, ["repo", "owner", "path"], "left_anti")
        .select("repo", "surface", F.lit("omitted_consumer").alias("rule"), F.col("path").alias("detail"))
    )
    return wrong.unionByName(omitted)


def completed_artifacts(declared: DataFrame, owners: DataFrame, planned_consumers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners' consumer lists with what the requirements add, and the additions by themselves.

    A surface without exactly one owner gets nothing: an owner is never invented.
    """
    single = owners.groupBy("repo", "surface").agg(F.min("owner").alias("owner"), F.count("*").alias("n")).filter("n = 1")
    needed = single.join(planned_consumers, ["repo", "surface"]).select("repo", "owner", "path").distinct()
    added = needed.filter("owner <> path").join(declared, ["repo", "owner", "path"], "left_anti")
    return declared.unionByName(added).distinct(), added


def allowed_new_paths(files: DataFrame, planned: DataFrame) -> DataFrame:
    """Paths a new module may take: allowed folders times basenames, minus existing and test paths.

    The basenames are a short fixed list, so this is an explode per folder.
    """
    folder = P.parent(F.col("path"))
    app = planned.filter(~P.is_recipe_test(F.col("path"))).select("repo", folder.alias("parent")).distinct()
    packages = files.filter(P.basename(F.col("path")) == "__init__.py").select("repo", folder.alias("root")).distinct()
    parts = F.split("parent", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # the outermost package above a planned file, or its own folder
    outer = (
        app.filter("parent <> '.'")
        .select("repo", "parent", F.explode(above).alias("root"))
        .join(packages, ["repo", "root"], "left_semi")
        .groupBy("repo", "parent")
        .agg(F.min_by("root", F.length("root")).alias("root"))
    )
    roots = app.join(outer, ["repo", "parent"], "left").select("repo", F.coalesce("root", "parent").alias("root")).distinct()
    folders = files.select("repo", folder.alias("folder")).distinct()
    up = F.split("folder", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(up)), lambda n: F.array_join(F.slice(up, 1, n), "/"))
    below = (
        folders.select("repo", "folder", F.explode(heads).alias("root"))
        .join(roots.filter("root <> '.'"), ["repo", "root"], "left_semi")
        .select("repo", "folder")
    )
    allowed = roots.select("repo", F.col("root").alias("folder")).unionByName(below).distinct()
    name = F.explode(F.array(*[F.lit(n) for n in NEW_BASENAMES]))
    candidates = allowed.select("repo", "folder", name.alias("name")).select(
        "repo", F.when(F.col("folder") == ".", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")).alias("path")
    )
    return candidates.filter(~P.is_recipe_test(F.col("path"))).join(files.select("repo", "path"), ["repo", "path"], "left_anti")


def test_strategy(files: DataFrame) -> DataFrame:
    """How each file's tests are carried over; a test that does not parse is rewritten with care."""
    path, text = F.col("path"), F.col("text")
    tests = files.filter(P.is_oracle_test(path))
    direct = C.imports(tests).filter("is_from AND module = 'flask' AND level = 0").filter(F.col("name").isin(*I.CONTEXT_GLOBALS)).select("repo", "path")
    dotted = C.references(tests).filter("owner = 'flask'").filter(F.col("name").isin(*I.CONTEXT_GLOBALS)).select("repo", "path")
    context = direct.unionByName(dotted).distinct().withColumn("context", F.lit(True))
    status = C.parse_status(files).select("repo", "path", "parses")
    seam = reduce(Column.__or__, [text.contains(m) for m in I.TEST_SEAMS])
    used = reduce(Column.__or__, [text.contains(m) for m in I.SUPPORTED_TEST_USES])
    marks = files.select("repo", "path", seam.alias("seam"), used.alias("used"), (text.contains("from flask") | text.contains("import flask")).alias("old"))
    joined = marks.join(status, ["repo", "path"]).join(context, ["repo", "path"], "left")
    strategy = (
        F.when(~P.is_oracle_test(path), "unchanged")
        .when(~F.col("parses"), "guarded_rewrite")
        .when(F.coalesce("context", F.lit(False)) | F.col("seam"), "unsupported_test_seam")
        .when((P.basename(path) == "conftest.py") & F.col("used"), "adapter_wiring")
        .when(F.col("used"), "adapter")
        .when(F.col("old"), "guarded_rewrite")
        .otherwise("unchanged")
    )
    return joined.select("repo", "path", strategy.alias("strategy"))
