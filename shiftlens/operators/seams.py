"""Decisions on framework seams, and checks of new drafts against them, as joins over source facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as I
from . import code_facts as C

# Packages a draft may import, members a router does not have, and names that only
# exist in the old framework.
ALLOWED_PACKAGES = (
    "click", "fastapi", "httpx", "itsdangerous", "jinja2", "multipart", "pydantic", "pytest", "sqlalchemy", "starlette",
    "uvicorn", "werkzeug",
)
ROUTER_LACKS = ("middleware", "add_middleware", "exception_handler", "errorhandler")
APPLICATION_LACKS = ("app_context", "test_client", "test_cli_runner", "test_request_context", "instance_path", "cli")


def decisions(files: DataFrame, planned: DataFrame) -> DataFrame:
    """(repo, kind, path, name, detail): what each framework seam has to keep.

    Factories keep their configuration keys, routers their routes, applications their hooks and
    commands; test set-ups and modules with shared state are named.
    """
    facts = C.web_facts(files).join(planned.select("repo", "path", "role"), ["repo", "path"])
    kind = (
        F.when((F.col("fact") == "config_key") & (F.col("role") == "app_factory"), "application_factory")
        .when(F.col("fact") == "factory", "application_factory")
        .when(F.col("fact") == "route", "route_names")
        .when(F.col("fact") == "request_hook", "request_hooks")
        .when(F.col("fact") == "command", "standalone_cli")
    )
    by_fact = facts.withColumn("kind", kind).filter("kind IS NOT NULL").select("repo", "kind", "path", "name", "detail")
    marked = files.join(planned.select("repo", "path", "role"), ["repo", "path"])
    flags = F.array_compact(F.array(
        F.when((F.col("role") == "test_harness") & I.has(F.col("text"), "test_client"), F.lit("test_harness")),
        F.when((F.col("role") != "test_harness") & I.has(F.col("text"), "session_flash"), F.lit("session_runtime")),
        F.when((F.col("role") != "test_harness") & I.has(F.col("text"), "templates"), F.lit("template_runtime")),
        F.when((F.col("role") != "test_harness") & I.has(F.col("text"), "request_context"), F.lit("ambient_context_runtime")),
    ))
    by_text = marked.select("repo", F.explode(flags).alias("kind"), "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("detail"))
    return by_fact.unionByName(by_text).distinct()


def draft_violations(drafts: DataFrame, seam: DataFrame, local_packages: DataFrame) -> DataFrame:
    """(repo, path, symbol, rule, detail): what a draft gets wrong about the new framework.

    ``local_packages`` is (repo, package), the top names a repository imports itself by.
    """

    def rows(found: DataFrame, symbol: str, rule: str, detail: str) -> DataFrame:
        return found.select("repo", "path", F.col(symbol).alias("symbol"), F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail"))

    imported = C.imports(drafts)
    root = F.split(F.when(F.col("is_from"), F.col("module")).otherwise(F.col("name")), r"\.")[0]
    standard = F.array(*[F.lit(n) for n in sorted(_standard_modules())])
    outside = (
        imported.filter("top AND level = 0")
        .withColumn("package", root)
        .filter(~F.col("package").isin(*ALLOWED_PACKAGES) & ~F.array_contains(standard, F.col("package")))
        .join(local_packages, ["repo", "package"], "left_anti")
        .dropDuplicates(["repo", "path", "package", "line"])
    )
    made = C.definitions(drafts).filter("kind = 'variable'")
    routers = made.filter(F.col("signature").rlike(r"= (?:\w+\.)?APIRouter\(")).select("repo", "path", F.col("name").alias("owner"))
    applications = made.filter(F.col("signature").rlike(r"= (?:\w+\.)?FastAPI\(")).select("repo", "path", F.col("name").alias("owner"))
    refs = C.references(drafts).filter("owner IS NOT NULL")
    on_router = refs.filter(F.col("name").isin(*ROUTER_LACKS)).join(routers, ["repo", "path", "owner"], "left_semi")
    on_app = refs.filter(F.col("name").isin(*APPLICATION_LACKS)).join(applications, ["repo", "path", "owner"], "left_semi")
    gone = seam.filter("kind = 'route_names'").select("repo", "path", F.col("name").alias("function")).join(
        C.parse_status(drafts).filter("parses").select("repo", "path"), ["repo", "path"], "left_semi"
    ).join(C.definitions(drafts).filter("kind = 'function'").select("repo", "path", F.col("name").alias("function")), ["repo", "path", "function"], "left_anti")
    return (
        rows(outside, "package", "package_unavailable", "line")
        .unionByName(rows(on_router, "name", "router_lacks_member", "line"))
        .unionByName(rows(on_app, "name", "application_lacks_member", "line"))
        .unionByName(rows(gone, "function", "route_removed", "function"))
    )


def _standard_modules() -> frozenset[str]:
    import sys

    return sys.stdlib_module_names


def contract_lines(pins: DataFrame, consumed: DataFrame) -> DataFrame:
    """(repo, path, section, line): what a file defines and what it calls, one line per pin."""
    line = F.concat(
        F.lit("  - "), F.col("owner"), F.lit("::"), F.col("symbol"), F.lit(" ["), F.col("target_kind"), F.lit("] "), F.col("signature")
    )
    named = pins.withColumnRenamed("path", "owner")
    defines = named.select("repo", F.col("owner").alias("path"), F.lit("DEFINES").alias("section"), line.alias("line"))
    calls = consumed.withColumnRenamed("path", "owner").filter("owner <> consumer").join(named, ["repo", "owner", "symbol"])
    return defines.unionByName(calls.select("repo", F.col("consumer").alias("path"), F.lit("CALLS").alias("section"), line.alias("line")))
