"""Text expressions: redaction, fingerprints, extraction and diff counting.

All of them run inside the JVM and read the whole text.  Patterns carry ``(?U)`` so that word,
space and digit classes cover all of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of secrets, specific before generic.  The marker names the kind.
SECRET_SHAPES = (
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws-access-key", r"(?U)\b(AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github-token", r"(?U)\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
    ("slack-token", r"(?U)\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("openai-key", r"(?U)\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("google-api-key", r"(?U)\bAIza[0-9A-Za-z_-]{35}\b"),
    ("jwt", r"(?U)\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
)
URL_PASSWORD = r"(?U)://[^/\s:@]{3,}:([^@/\s]{6,})@"
SECRET_ASSIGNMENT = (
    r"(?iU)\b(password|passwd|secret|api_key|apikey|auth_token|access_token|secret_key|private_key|client_secret)"
    r"\s*[:=]\s*([\"'][^\"']{8,}[\"'])"
)
PLACEHOLDERS = ("example", "changeme", "placeholder", "your-", "xxxx", "dummy", "<", "{", "$")

# Parts of a failure text that change from run to run, and terminal colours.
VOLATILE = r"(?U)(?:(?<=line )\d+|\b\d+(?:\.\d+)?s\b|0x[0-9a-fA-F]+|/tmp/[^\s:]+)"
ANSI = "\x1b\\[[0-9;]*m"

# Words that tell a crash from a failed assertion.
CRASH_MARKERS = (
    "SyntaxError", "IndentationError", "ImportError", "ModuleNotFoundError",
    "cannot import name", "ERROR collecting", "errors during collection",
)

FENCE = r"(?s)```(?:[\w+-]*)\n(.*?)```"
SUMMARY_LINE = "short test summary info"
EXCEPTION_LINE = r"^\s*(?:E\s+)?(?:[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:Error|Exception)|AssertionError)(?::|$)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used several times in one expression is otherwise computed as often inside lambdas and
    conditions, where Spark does not share it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z", "")


def lines_of(text: Column) -> Column:
    """Lines as a text reader sees them, without an empty one after the last line end."""
    split = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)
    def drop_empty_end(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)

    return let(split, drop_empty_end)


def rewrite_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match by ``rewrite(match)``.

    The text is cut at the matches and put together again, so the replacement may depend on the
    match, which a replacement template cannot express.
    """

    def rebuilt(source: Column) -> Column:
        between = F.split(source, pattern, -1)
        matches = F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), rewrite)
        padded = F.concat(matches, F.array(F.lit("")))
        joined = F.zip_with(between, padded, lambda piece, match: F.concat(piece, match))
        return F.when(source.rlike(pattern), F.array_join(joined, "")).otherwise(source)

    return let(text, rebuilt)


# No secret above is without one of these; those of assignments in upper case.
SECRET_SIGNS = ("-----BEGIN ", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza", "eyJ", "://")
ASSIGNED_SIGNS = ("PASSWORD", "PASSWD", "SECRET", "API_KEY", "APIKEY", "AUTH_TOKEN", "ACCESS_TOKEN", "PRIVATE_KEY")


def scrub(text: Column) -> Column:
    """Replace what looks like a secret by ``[REDACTED:<kind>]``; placeholders stay.

    Most texts have no sign of any secret, and searching for plain strings is cheap, so only the others are rewritten.
    """
    folded = F.upper(F.lower(text))  # letters that match regardless of case under more than one capital
    signs = [text.contains(sign) for sign in SECRET_SIGNS] + [folded.contains(sign) for sign in ASSIGNED_SIGNS]
    return F.when(reduce(Column.__or__, signs), _rewritten(text)).otherwise(text)


def _rewritten(text: Column) -> Column:
    for kind, pattern in SECRET_SHAPES:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")

    def hide_password(match: Column) -> Column:
        return F.replace(match, F.regexp_extract(match, URL_PASSWORD, 1), F.lit("[REDACTED:url-credentials]"))

    def hide_literal(match: Column) -> Column:
        literal = F.regexp_extract(match, SECRET_ASSIGNMENT, 2)
        placeholder = reduce(Column.__or__, [F.lower(literal).contains(p) for p in PLACEHOLDERS])
        hidden = F.replace(match, literal, F.lit('"[REDACTED:secret-assignment]"'))
        return F.when(placeholder, match).otherwise(hidden)

    text = rewrite_matches(text, URL_PASSWORD, hide_password)
    return rewrite_matches(text, SECRET_ASSIGNMENT, hide_literal)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_output(output: Column) -> Column:
    """The failure text without colours and without what changes from run to run."""
    return strip(F.regexp_replace(F.regexp_replace(output, ANSI, ""), VOLATILE, "<volatile>"))


def failure_fingerprint(output: Column, diff: Column, paths: Column) -> Column:
    """Identity of a failure: the same paths, stable output and draft give the same hash."""
    head = F.array_sort(paths)
    return F.sha2(F.array_join(F.concat(head, F.array(stable_output(output), strip(diff))), "\n"), 256)


def extract_code(text: Column) -> Column:
    """The first fenced block, or the whole text, stripped and with one line end."""
    body = F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    return F.concat(strip(body), F.lit("\n"))


def json_payload(text: Column) -> Column:
    """Unwrap one outer JSON fence; any other text stays."""
    body = strip(text)
    fenced = body.startswith("```json\n") & body.endswith("\n```")
    return F.when(fenced, F.substring(body, F.lit(9), F.length(body) - 12)).otherwise(text)


def missing_module(output: Column) -> Column:
    return F.nullif(F.regexp_extract(output, "(?U)ModuleNotFoundError:\\s*No module named\\s+['\"]([^'\"]+)['\"]", 1), F.lit(""))


_MISSING_NAME = "(?U)cannot import name\\s+['\"]?([A-Za-z_]\\w*)['\"]?\\s+from\\s+['\"]([^'\"]+)"


def missing_name(output: Column) -> Column:
    return F.nullif(F.regexp_extract(output, _MISSING_NAME, 1), F.lit(""))


def missing_name_module(output: Column) -> Column:
    return F.nullif(F.regexp_extract(output, _MISSING_NAME, 2), F.lit(""))


def missing_attribute(output: Column) -> Column:
    pattern = "(?U)AttributeError:\\s*['\"][^'\"]+['\"] object has no attribute ['\"]([A-Za-z_]\\w*)['\"]"
    return F.nullif(F.regexp_extract(output, pattern, 1), F.lit(""))


def crashed(output: Column) -> Column:
    return reduce(Column.__or__, [output.contains(m) for m in CRASH_MARKERS])


def trace_region(output: Column) -> Column:
    """The output before the short summary, which repeats test paths."""
    return F.substring_index(output, SUMMARY_LINE, 1)


def lacks_compat_module(output: Column, compat_path: Column) -> Column:
    """The exact module of the compat file is reported missing."""
    module = F.replace(_module_path(compat_path), F.lit("/"), F.lit("."))
    return missing_module(output) == module


def _module_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def evidence(text: Column) -> Column:
    """A snippet on one line, at most 200 characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, 200)


def diff_stats(diff: Column) -> Column:
    """Files, added and removed lines of a unified diff."""
    files = F.regexp_count(diff, F.lit("(?md)^diff --git "))

    def counted(lines: Column) -> Column:
        added = F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++"))
        removed = F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---"))
        return F.struct(
            files.cast("long").alias("files"),
            F.size(added).cast("long").alias("additions"),
            F.size(removed).cast("long").alias("deletions"),
        )

    return let(lines_of(diff), counted)


def truncated(text: Column, limit: int = 8000) -> Column:
    """The text, cut with a note when it is longer than the limit."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("\n# … (truncated)\n"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def elided(text: Column, limit: int = 6000, keep: int = 3000) -> Column:
    """Both ends of a long output."""
    short = F.concat(F.substring(text, 1, keep), F.lit("\n... output elided ...\n"), F.substring(text, -keep, keep))
    return F.when(F.length(text) > limit, short).otherwise(text)


def last_characters(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.substring(text, -limit, limit)).otherwise(text)
