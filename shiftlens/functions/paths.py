"""Path expressions: parts, module names and the rules that sort files into kinds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Names of files that hold credentials.
DENIED_NAMES = (
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx",
    "id_rsa*", "id_ed25519*", "id_ecdsa*",
    "credentials*", "*credentials.json", "service-account*.json",
    ".netrc", ".npmrc", ".pypirc", "htpasswd", "*.htpasswd",
)

# Folders that never hold project source; a deployment adds its own work folders.
SKIPPED_FOLDERS = (".git", ".code-review-graph", "__pycache__", ".pytest_cache")

# Suffixes of files whose text changes what the program does.
SEMANTIC_SUFFIXES = (".html", ".jinja", ".jinja2", ".sql", ".toml", ".yaml", ".yml")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of the path, ``.`` at the top."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(F.contains(path, F.lit("/")), cut).otherwise(F.lit("."))


def suffix(path: Column) -> Column:
    """The last suffix with its dot, empty for ``.name`` and ``name.``."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def without_suffix(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - F.length(suffix(path)))


def has_part(path: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def is_denied(path: Column) -> Column:
    """The file exists to hold credentials and must never be listed."""
    patterns = [re.escape(glob).replace(r"\*", ".*") for glob in DENIED_NAMES]
    name = F.lower(basename(F.translate(path, "\\", "/")))
    return name.rlike("(?s)^(?:" + "|".join(patterns) + r")\z")


def is_oracle_test(path: Column) -> Column:
    """A file the test oracle protects; any path under a ``tests`` folder counts."""
    name = basename(path)
    return (
        name.isin("conftest.py", "tests.py")
        | name.startswith("test_")
        | name.endswith("_test.py")
        | F.concat(F.lit("/"), path).contains("/tests/")
    )


def test_path_reason(path: Column) -> Column:
    """Why a path may not hold a new module, empty when it may; a part ``tests`` is enough."""
    name = basename(path)
    return (
        F.when(name == "conftest.py", 'basename "conftest.py" is reserved for pytest configuration')
        .when(name == "tests.py", 'basename "tests.py" is a test module')
        .when(name.startswith("test_"), F.format_string('basename "%s" starts with forbidden prefix "test_"', name))
        .when(name.endswith("_test.py"), F.format_string('basename "%s" ends with forbidden suffix "_test.py"', name))
        .when(has_part(path, ["tests"]), 'path component "tests" marks a test tree')
        .otherwise("")
    )


def is_recipe_test(path: Column) -> Column:
    return test_path_reason(path) != ""


def module_names(path: Column) -> Column:
    """Every dotted name the file can be imported under: its full name and all suffixes of it."""
    def names_of(parts: Column) -> Column:
        size = F.size(parts)
        names = F.transform(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.greatest(size - i + 1, F.lit(0))), ".")
        )
        return F.when(size > 0, names).otherwise(F.array().cast("array<string>"))

    def without_init(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)

    # the path is taken apart once, not once for every use of its parts
    return let(F.split(without_suffix(path), "/"), lambda parts: let(without_init(parts), names_of))


def resolve_module(module: Column, level: Column, importer: Column) -> Column:
    """The dotted module an import statement names, relative levels counted from the importer."""
    parts = F.split(importer, "/")
    kept = F.when(level > 0, F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    named = F.when(F.coalesce(module, F.lit("")) != "", F.split(module, r"\.")).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(kept, named), ".")


def last_segment(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def relative_to(path: Column, root: Column) -> Column:
    """Strip a leading workspace folder; other paths stay as they are."""
    clean, base = F.translate(path, "\\", "/"), F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    inside = F.startswith(clean, base)
    return F.when(inside, F.substring(clean, F.length(base) + 1, F.length(clean))).otherwise(clean)
