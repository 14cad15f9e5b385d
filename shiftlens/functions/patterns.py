"""Idioms of the old web framework in source text, and the roles files play by them.

Patterns are matched anywhere in a file; ``(?m)`` lets ``^`` match at every line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths as P

# One pattern per idiom.
IDIOMS = {
    "framework_import": r"(?m)^\s*(from\s+flask\b|import\s+flask\b)",
    "framework_family_import": r"(?m)^\s*(?:from|import)\s+(?:flask(?:\b|_)|flask_login\b|flask_sqlalchemy\b|flask_restx\b)",
    "route": r"\.route\s*\(|methods\s*=",
    "blueprint": r"\bBlueprint\s*\(",
    "request_parse": r"request\.(args|get_json|json|form|values|data)\b",
    "error_handler": r"\berrorhandler\s*\(",
    "app_factory": r"\bFlask\s*\(|def\s+create_app\b",
    "test_client": r"\.test_client\s*\(|get_json\s*\(",
    "templates": r"\brender_template\s*\(|\bget_flashed_messages\b",
    "session_flash": r"\bflash\s*\(|(?<!\.)\bsession\[|(?<!\.)\bsession\.get\b|(?<!\.)\bsession\.clear\b",
    "request_context": r"\bg\.[a-zA-Z_]|before_app_request|before_request|\bcurrent_app\b",
    "login": r"\bflask_login\b|\blogin_required\b|\bcurrent_user\b|\blogin_user\b|\blogout_user\b",
    "auth_runtime": r"\blogin_required\b|\bcurrent_user\b|\blogin_user\b|\blogout_user\b",
    "database": r"\bflask_sqlalchemy\b|\bSQLAlchemy\s*\(",
    "cli": r"\bapp\.cli\b|\btest_cli_runner\s*\(|\bclick\.|\.invoke\s*\(",
}
CLICK_COMMAND = r"(?m)@click\.command\(\s*['\"]([^'\"]+)['\"]\s*\)\s*(?:@[^\n]+\s*)*def\s+(\w+)\s*\("
TEMPLATE_ENDPOINT = r"\burl_for\(\s*['\"]([^'\"]+)['\"]"

# The idiom that shows each shared surface, and the member names tests use directly.
SURFACES = {
    "template_rendering": "templates",
    "session_and_flash": "session_flash",
    "authentication": "auth_runtime",
    "request_context": "request_context",
    "database_extension": "database",
    "direct_test_surface": "test_client",
}
CONTEXT_GLOBALS = ("g", "session", "current_app", "request")
DIRECT_TEST_MEMBERS = ("app_context", "test_client", "test_cli_runner", "testing")
TEST_SEAMS = (".test_request_context(", ".request_context(")
SUPPORTED_TEST_USES = (
    ".test_client(", ".app_context(", ".test_cli_runner(", ".session_transaction(",
    ".get_json(", ".get_data(", ".data", ".config", ".testing", ".instance_path",
)


def has(text: Column, idiom: str) -> Column:
    return text.rlike("(?U)" + IDIOMS[idiom])


def idiom_flags(text: Column) -> list[Column]:
    return [has(text, name).alias(name) for name in IDIOMS]


def role(path: Column, text: Column) -> Column:
    """What part a file plays, NULL when it is not to be changed; the first rule that applies wins."""
    framework = has(text, "framework_family_import")
    return (
        F.when(P.is_recipe_test(path), F.when(has(text, "test_client") | framework, "test_harness"))
        .when(framework & has(text, "app_factory"), "app_factory")
        .when(framework & (has(text, "blueprint") | has(text, "route")), "router")
        .when(framework, "support")
    )


def role_order(role_name: Column) -> Column:
    return (
        F.when(role_name == "router", 10)
        .when(role_name == "support", 15)
        .when(role_name == "app_factory", 20)
        .when(role_name == "test_harness", 30)
    )


def subtasks(role_name: Column, text: Column) -> Column:
    """The changes a file needs, in order."""
    factory, router = role_name == "app_factory", role_name == "router"

    def when(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    application = role_name.isin("app_factory", "router", "support")
    found = F.array_compact(F.array(
        when(role_name == "test_harness", "test_harness"),
        when(factory, "app_factory"),
        when(factory & has(text, "error_handler"), "error_handler"),
        when(router & has(text, "blueprint"), "blueprint_to_router"),
        when((factory | router) & has(text, "route"), "route_to_endpoint"),
        when((factory | router) & has(text, "request_parse"), "request_parsing"),
        when(application & has(text, "templates"), "templates_render"),
        when(application & has(text, "session_flash"), "sessions_flash"),
        when(application & has(text, "login"), "auth_login"),
        when(application & has(text, "database"), "sqlalchemy_plain"),
        when(application & has(text, "request_context"), "request_context"),
    ))
    return F.when((role_name == "support") & (F.size(found) == 0), F.array(F.lit("request_context"))).otherwise(found)
