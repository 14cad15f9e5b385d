"""Frozen interface contracts and the checks of a new draft against them.

Every check yields rows (repo, path, symbol, rule, detail); a draft without rows keeps its contract.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import stored
from . import code_facts as C


@dataclass(frozen=True)
class PinRule:
    """Overrides the contract of symbols defined in files with a subtask."""

    subtask: str
    applies: Callable[[], Column]
    preserve_shape: bool = False
    target_kind: str | None = None
    companions: Sequence[str] = field(default_factory=tuple)


# What the shipped rules match.
_RESOURCE = r"^(get|open|connect)_(db|database|session|connection)$"
_LOGIN_NAMES = ("login_user", "logout_user", "current_user", "login_required")

SHIPPED_RULES = (
    PinRule("request_context", lambda: (F.col("kind") == "function") & F.col("symbol").rlike(_RESOURCE), True, "function", ("{name}_dep",)),
    PinRule("auth_login", lambda: F.col("symbol").isin(*_LOGIN_NAMES), True, "function"),
    PinRule("sqlalchemy_plain", lambda: (F.col("kind") == "variable") & F.col("signature").contains("SQLAlchemy("), False, "variable"),
)


def manifest(contract: DataFrame, planned: DataFrame, rules: Sequence[PinRule] = SHIPPED_RULES) -> DataFrame:
    """One frozen decision per symbol of a planned file; two rules for one symbol stop the query."""
    joined = contract.join(planned.select("repo", "path", "role", "subtasks"), ["repo", "path"])

    def hit(rule: PinRule) -> Column:
        return F.coalesce(F.array_contains("subtasks", rule.subtask) & rule.applies(), F.lit(False))

    count = reduce(Column.__add__, [hit(r).cast("int") for r in rules], F.lit(0))
    message = F.concat(F.lit("interface pin conflict for "), F.col("path"), F.lit("::"), F.col("symbol"))
    checked = joined.withColumn("hits", F.when(count > 1, F.raise_error(message).cast("int")).otherwise(count))

    def choose(value: Callable[[PinRule], Column], default: Column) -> Column:
        return reduce(lambda rest, r: F.when(hit(r), value(r)).otherwise(rest), rules, default)

    def companions(rule: PinRule) -> Column:
        names = [F.concat(*[x for part in _around(c) for x in part]) for c in rule.companions]
        return F.array(*names) if names else F.array().cast("array<string>")

    return checked.filter("hits >= 0").select(
        *contract.columns,
        "role",
        choose(lambda r: F.lit(r.preserve_shape), F.lit(True)).alias("preserve_shape"),
        choose(lambda r: F.lit(r.target_kind or None).cast("string"), F.col("kind")).alias("target_kind"),
        choose(companions, F.array().cast("array<string>")).alias("companions"),
    )


def _around(template: str) -> list[list[Column]]:
    before, _, after = template.partition("{name}")
    return [[F.lit(before)], [F.col("symbol")], [F.lit(after)]]


def consumers(used: DataFrame) -> DataFrame:
    """Who takes each pinned symbol and under what name, one row per consumer."""
    return used.select("repo", "path", "symbol", F.col("importer").alias("consumer"), "local", "binding")


def consumed_pins(pins: DataFrame, taken: DataFrame, imported: DataFrame) -> DataFrame:
    """(repo, consumer, path, symbol): pins whose contract a file has to see.

    Those it is a consumer of, and those of the files it imports.
    """
    declared = pins.join(taken.select("repo", "path", "symbol", "consumer"), ["repo", "path", "symbol"])
    edges = imported.select("repo", F.col("path").alias("consumer"), F.col("dep").alias("path"))
    through = pins.join(edges, ["repo", "path"])
    columns = ["repo", "consumer", "path", "symbol"]
    return declared.select(*columns).unionByName(through.select(*columns)).distinct()


def _row(path: str, symbol: str | Column, rule: str | Column, detail: Column) -> list[Column]:
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return [
        F.col("repo"), F.col(path).alias("path"), as_column(symbol).alias("symbol"),
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), detail.cast("string").alias("detail"),
    ]


def unparseable(drafts: DataFrame) -> DataFrame:
    """One row per draft that does not parse; no other rule looks at it."""
    bad = C.parse_status(drafts).filter("NOT parses")
    return bad.select(*_row("path", F.lit(None).cast("string"), "unparseable", F.col("line")))


def definition_violations(pins: DataFrame, drafts: DataFrame) -> DataFrame:
    """Missing names, changed kinds, grown or flipped shapes, missing companions.

    ``pins`` counts for the drafts it has paths of; drafts that do not parse are left to
    ``unparseable``.
    """
    parsed = C.parse_status(drafts).filter("parses").select("repo", "path")
    now = stored(C.definitions(drafts).select(
        "repo", "path", F.col("name").alias("symbol"), F.col("kind").alias("now_kind"), F.col("shape").alias("now"), F.lit(True).alias("found")
    ))
    joined = stored(pins.join(parsed, ["repo", "path"], "left_semi").join(now, ["repo", "path", "symbol"], "left"))
    found = F.coalesce("found", F.lit(False))
    keeps = F.col("preserve_shape") & F.col("shape").isNotNull() & F.col("now").isNotNull()
    new_required = F.array_except("now.required_keyword_only", "shape.required_keyword_only")

    def when(condition: Column, rule: str, detail: Column) -> Column:
        return F.when(condition, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))

    def arrow(before: Column, after: Column) -> Column:
        return F.concat_ws(" -> ", before.cast("string"), after.cast("string"))

    rules = F.array_compact(F.array(
        when(~found, "missing", F.lit("")),
        when(F.col("target_kind") != F.col("now_kind"), "kind_changed", arrow(F.col("target_kind"), F.col("now_kind"))),
        when(
            keeps & (F.col("now.required_positional") > F.col("shape.required_positional")), "required_grew",
            arrow(F.col("shape.required_positional"), F.col("now.required_positional")),
        ),
        when(keeps & (F.size(new_required) > 0), "required_keyword_only", F.array_join(F.array_sort(new_required), ",")),
        when(keeps & (F.col("now.is_async") != F.col("shape.is_async")), "async_changed", F.lit("")),
        when(keeps & (F.col("now.is_generator") != F.col("shape.is_generator")), "generator_changed", F.lit("")),
        when(keeps & F.col("shape.returns_nested_function") & ~F.col("now.returns_nested_function"), "wrapper_lost", F.lit("")),
    ))
    own = joined.withColumn("v", F.explode(rules)).select(*_row("path", "symbol", F.col("v.rule"), F.col("v.detail")))
    # a companion only counts as missing next to a name that is there
    expected = joined.filter(found).select("repo", "path", "symbol", F.explode("companions").alias("companion"))
    names = now.select("repo", "path", F.col("symbol").alias("companion"))
    missing = expected.join(names, ["repo", "path", "companion"], "left_anti")
    return own.unionByName(missing.select(*_row("path", "symbol", "companion_missing", F.col("companion"))))


def member_violations(wanted: DataFrame, drafts: DataFrame) -> DataFrame:
    """Planned class members that are missing or made the wrong way.

    ``wanted`` is (repo, path, symbol, member, use) where ``use`` is how consumers use the member.
    """
    made = C.members(drafts).groupBy("repo", "path", F.col("owner").alias("symbol"), F.col("name").alias("member")).agg(
        F.bool_or(F.col("made") == "method").alias("is_method"),
        F.bool_or(F.col("made") == "assigned").alias("is_assigned"),
        F.bool_or("is_property").alias("is_property"),
        F.bool_or("yields").alias("yields"),
        F.bool_or("is_manager").alias("is_manager"),
    )
    kinds = C.definitions(drafts).select("repo", "path", F.col("name").alias("symbol"), "kind")
    joined = wanted.join(kinds, ["repo", "path", "symbol"]).join(made, ["repo", "path", "symbol", "member"], "left")
    called = F.col("use").isin("method", "context_manager")
    there = F.col("is_method").isNotNull()
    rule = (
        F.when(F.coalesce(F.col("kind") != "class", F.lit(True)), "members_need_class")
        .when(~there, "member_missing")
        .when(called & (~F.col("is_method") | F.col("is_property")), "member_not_callable")
        .when((F.col("use") == "context_manager") & F.col("yields") & ~F.col("is_manager"), "member_not_manager")
        .when((F.col("use") == "attribute") & F.col("is_method") & ~F.col("is_property") & ~F.col("is_assigned"), "member_not_readable")
    )
    return joined.withColumn("rule", rule).filter("rule IS NOT NULL").select(*_row("path", "symbol", F.col("rule"), F.col("member")))


def caller_violations(pins: DataFrame, taken: DataFrame, drafts: DataFrame) -> DataFrame:
    """Direct calls that cannot fit a pinned function, and pinned names that lost their import.

    Calls with starred arguments are not judged.
    """
    functions = pins.filter("kind = 'function' AND preserve_shape AND shape IS NOT NULL").select(
        "repo", F.col("path").alias("owner_path"), "symbol", "shape"
    )
    named = functions.select("repo", "owner_path", F.explode(P.module_names(F.col("owner_path"))).alias("module_name")).distinct()
    brought = C.imports(drafts).filter("name <> '*'")
    direct = (
        brought.filter("is_from")
        .select("repo", "path", F.col("resolved").alias("module_name"), F.col("name").alias("symbol"), F.col("local").alias("target"))
        .join(named, ["repo", "module_name"])
    )
    dotted = F.when(F.col("is_from"), F.regexp_replace(F.concat_ws(".", "resolved", "name"), r"^\.+", "")).otherwise(F.col("name"))
    modules = brought.select("repo", "path", dotted.alias("module_name"), "local").join(named, ["repo", "module_name"])
    through = modules.join(functions.select("repo", "owner_path", "symbol"), ["repo", "owner_path"]).select(
        "repo", "path", "owner_path", "symbol", F.concat_ws(".", "local", "symbol").alias("target")
    )
    names = direct.select("repo", "path", "owner_path", "symbol", "target").unionByName(through).filter("path <> owner_path").distinct()
    made = C.calls(drafts).filter("NOT starred").select("repo", "path", "line", "target", "positional", "keywords")
    judged = made.join(names, ["repo", "path", "target"]).join(functions, ["repo", "owner_path", "symbol"])
    unexpected = F.array_except("keywords", "shape.keyword_names")
    supplied = F.concat(F.slice("shape.required_positional_names", F.lit(1), F.col("positional")), F.col("keywords"))
    lacking = F.array_union(
        F.array_except("shape.required_positional_names", supplied), F.array_except("shape.required_keyword_only", "keywords")
    )
    rule = (
        F.when(~F.col("shape.accepts_varargs") & (F.col("positional") > F.col("shape.positional_capacity")), "too_many_positional")
        .when(~F.col("shape.accepts_varkw") & (F.size(unexpected) > 0), "unexpected_keyword")
        .when(F.size(lacking) > 0, "missing_argument")
    )
    detail = F.concat_ws(":", F.col("line").cast("string"), "target")
    misfits = judged.withColumn("rule", rule).filter("rule IS NOT NULL").select(*_row("path", "symbol", F.col("rule"), detail))

    mine = taken.join(functions.select("repo", F.col("owner_path").alias("path"), "symbol"), ["repo", "path", "symbol"], "left_semi")
    mine = mine.select("repo", F.col("consumer").alias("path"), "symbol", F.col("local").alias("name"), "binding")
    loads = C.references(drafts).filter("owner IS NULL").select("repo", "path", "name").distinct()
    lost = (
        mine.filter("binding = 'symbol'")
        .join(loads, ["repo", "path", "name"], "left_semi")
        .join(C.bound_names(drafts), ["repo", "path", "name"], "left_anti")
    )
    return misfits.unionByName(lost.select(*_row("path", "symbol", "binding_removed", F.col("name"))))


def undefined_name_violations(drafts: DataFrame) -> DataFrame:
    return C.undefined_globals(drafts).select(*_row("path", "name", "undefined_name", F.lit("")))


def topology_violations(planned_consumers: DataFrame, drafts: DataFrame) -> DataFrame:
    """Providers that import a file declared to consume them, with the first such line.

    ``planned_consumers`` is (repo, path, consumer).  Imports for type checkers alone are fine.
    """
    brought = C.imports(drafts).filter("NOT typed_only")
    dotted = F.regexp_replace(F.concat_ws(".", F.nullif("resolved", F.lit("")), F.col("name")), r"^\.+", "")
    asked = (
        F.when(F.col("is_from") & F.col("module").isNotNull() & (F.col("resolved") != ""), F.array(F.col("resolved"), dotted))
        .when(F.col("is_from"), F.array(dotted))
        .otherwise(F.array("name"))
    )
    wanted = brought.select("repo", "path", "line", F.explode(asked).alias("module_name"))
    names = planned_consumers.select("repo", "path", "consumer", F.explode(P.module_names(F.col("consumer"))).alias("module_name"))
    hits = wanted.join(names, ["repo", "path", "module_name"]).groupBy("repo", "path", "consumer").agg(F.min("line").alias("line"))
    return hits.select(*_row("path", "consumer", "imports_consumer", F.col("line")))


def circular_targets(outputs: DataFrame, violations: DataFrame) -> DataFrame:
    """The one file of a failed batch that a circular import is the fault of.

    ``outputs`` is (repo, output, path) with a row per file of the batch.
    """
    circular = F.col("output").contains("circular import") | F.col("output").contains("partially initialized module")
    named = outputs.filter(circular & F.contains("output", "path")).select("repo", "path")
    guilty = named.join(violations.select("repo", "path").distinct(), ["repo", "path"], "left_semi").distinct()
    found = guilty.groupBy("repo").agg(F.min("path").alias("path"), F.max("path").alias("_last"))
    return found.filter("path = _last").drop("_last")


def capability_violations(pins: DataFrame, factory_consumers: DataFrame, drafts: DataFrame) -> DataFrame:
    """Declared consumers that do not import a planned class they must build.

    ``pins`` is (repo, owner_path, symbol), ``factory_consumers`` (repo, owner_path, symbol, path).
    """
    parsed = C.parse_status(drafts).filter("parses").select("repo", "path")
    wanted = factory_consumers.join(parsed, ["repo", "path"], "left_semi")
    names = pins.select("repo", "owner_path", F.explode(P.module_names(F.col("owner_path"))).alias("module_name"))
    brought = C.imports(drafts)
    by_name = brought.filter("is_from").select("repo", "path", F.col("resolved").alias("module_name"), F.col("name").alias("symbol"), "local").join(
        names, ["repo", "module_name"]
    ).select("repo", "path", "owner_path", "symbol", F.col("local").alias("target"))
    by_module = brought.filter("NOT is_from").select("repo", "path", F.col("name").alias("module_name"), "local").join(
        names, ["repo", "module_name"]
    ).join(pins, ["repo", "owner_path"]).select("repo", "path", "owner_path", "symbol", F.concat_ws(".", "local", "symbol").alias("target"))
    found = by_name.unionByName(by_module).distinct()
    keys = ["repo", "path", "owner_path", "symbol"]
    absent = wanted.join(found.select(*keys), keys, "left_anti")
    built = found.join(C.calls(drafts).select("repo", "path", "target").distinct(), ["repo", "path", "target"], "left_semi")
    unused = wanted.join(found.select(*keys), keys, "left_semi").join(built.select(*keys), keys, "left_anti")
    return absent.select(*_row("path", "symbol", "capability_not_imported", F.col("owner_path"))).unionByName(
        unused.select(*_row("path", "symbol", "capability_not_built", F.col("owner_path")))
    )


# ------------------------------------------------------------------------------ test oracle


def oracle_manifest(files: DataFrame, strategies: DataFrame) -> DataFrame:
    """Protected files with their hash, strategy and the size of what they promise."""
    tests = files.filter(P.is_oracle_test(F.col("path")))
    counts = C.tests(tests).groupBy("repo", "path").agg(
        F.count("*").alias("tests"), F.sum(F.size("assertions").cast("long")).alias("assertions")
    )
    setups = C.fixtures(tests).groupBy("repo", "path").agg(F.count("*").alias("fixtures"))
    hashed = tests.select("repo", "path", F.sha2("text", 256).alias("sha256"))
    joined = hashed.join(counts, ["repo", "path"], "left").join(setups, ["repo", "path"], "left").join(strategies, ["repo", "path"])
    return joined.select(
        "repo", "path", "sha256", "strategy",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tests", "assertions", "fixtures")],
    )


def oracle_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a new version of protected tests weakens, test by test."""
    a, b = C.tests(before).drop("seq"), C.tests(after).drop("seq")
    fields = ("assertions", "raises", "parametrize", "skips")
    both = a.select("repo", "path", "test", F.struct(*fields).alias("a")).join(
        b.select("repo", "path", "test", F.struct(*fields).alias("b")), ["repo", "path", "test"], "full"
    )
    new_skips = F.array_except("b.skips", "a.skips")

    def when(condition: Column, rule: str, detail: Column | None = None) -> Column:
        return F.when(condition, F.struct(F.lit(rule).alias("rule"), (F.lit("") if detail is None else detail).alias("detail")))

    both_there = F.col("a").isNotNull() & F.col("b").isNotNull()
    rules = F.array_compact(F.array(
        when(F.col("b").isNull(), "test_removed"),
        when(F.col("a").isNull(), "test_added"),
        when(both_there & (F.col("a.assertions") != F.col("b.assertions")), "assertions_changed"),
        when(both_there & (F.col("a.raises") != F.col("b.raises")), "raises_changed"),
        when(both_there & (F.col("a.parametrize") != F.col("b.parametrize")), "parametrize_changed"),
        when(both_there & (F.size(new_skips) > 0), "skip_introduced", F.array_join(F.array_sort(new_skips), ",")),
    ))
    by_test = both.withColumn("v", F.explode(rules)).select(*_row("path", "test", F.col("v.rule"), F.col("v.detail")))

    keep = ("dependencies", "keyword_dependencies", "is_async", "is_generator", "decorators")
    fa = C.fixtures(before).select("repo", "path", "fixture", F.struct(*keep).alias("a"))
    fb = C.fixtures(after).select("repo", "path", "fixture", F.struct(*keep).alias("b"))
    setups = fa.join(fb, ["repo", "path", "fixture"], "full")
    fixture_rule = (
        F.when(F.col("b").isNull(), "fixture_removed").when(F.col("a").isNull(), "fixture_added").when(F.col("a") != F.col("b"), "fixture_changed")
    )
    by_fixture = setups.withColumn("rule", fixture_rule).filter("rule IS NOT NULL").select(*_row("path", "fixture", F.col("rule"), F.lit("")))

    marks = C.module_skips(after).select("repo", "path", "mark").distinct()
    new_marks = marks.join(C.module_skips(before).select("repo", "path", "mark"), ["repo", "path", "mark"], "left_anti")
    by_module = new_marks.select(*_row("path", F.lit(None).cast("string"), "module_skip_introduced", F.col("mark")))
    return by_test.unionByName(by_fixture).unionByName(by_module)


def oracle_integrity(protected: DataFrame, violations: DataFrame) -> DataFrame:
    """Share of protected files that are clean; 1.0 where nothing is protected is a reader's default."""
    broken = violations.select("repo", "path").distinct().withColumn("broken", F.lit(True))
    joined = protected.select("repo", "path").join(broken, ["repo", "path"], "left")
    return joined.groupBy("repo").agg(
        F.count("*").alias("protected_files"),
        F.count_if(F.col("broken").isNull()).alias("clean_files"),
        F.bround(F.count_if(F.col("broken").isNull()) / F.count("*"), 4).alias("integrity_rate"),
    )


def integrity_or_one(repos: DataFrame, integrity: DataFrame) -> DataFrame:
    return repos.join(integrity, "repo", "left").select(
        "repo",
        F.coalesce("protected_files", F.lit(0)).alias("protected_files"),
        F.coalesce("integrity_rate", F.lit(1.0)).alias("integrity_rate"),
    )


def chosen_draft(drafts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The better of the drafts of a file.

    A draft that parses beats one that does not; then fewer violations win and the repair wins a tie.
    Two drafts that do not parse leave the first.  ``drafts`` has draft, parses, violations, is_repair.
    """
    parses = F.col("parses")
    rank = F.struct(
        parses,
        F.when(parses, -F.col("violations")).otherwise(0),
        F.when(parses, F.col("is_repair")).otherwise(~F.col("is_repair")),
    )
    return drafts.groupBy(*keys).agg(F.max_by("draft", rank).alias("draft"))


def normalized_lines(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """Apply frozen single-line replacements; a line that has drifted or is claimed twice stops it.

    The few replacements of a file are gathered into its row, so the text itself never moves; line
    ends stay as they are.
    """
    grouped = replacements.groupBy("repo", "path").agg(
        F.map_from_entries(F.collect_list(F.struct("line", F.struct("before", "after")))).alias("changes")
    )
    joined = files.join(grouped, ["repo", "path"])
    parts = F.split("text", "\n", -1)

    def rewrite(raw: Column, at: Column) -> Column:
        change = F.try_element_at("changes", (at + 1).cast("int"))
        body = F.regexp_replace(raw, r"\r\z", "")
        ending = F.when(raw.endswith("\r"), "\r").otherwise("")
        drift = F.raise_error(F.concat(F.lit("source drift at line "), (at + 1).cast("string"))).cast("string")
        return F.when(change.isNull(), raw).when(change["before"] == body, F.concat(change["after"], ending)).otherwise(drift)

    beyond = F.exists(F.map_keys("changes"), lambda k: (k < 1) | (k > F.size(parts)))
    text = F.array_join(F.transform(parts, rewrite), "\n")
    return joined.select(
        "repo", "path", F.when(beyond, F.raise_error(F.lit("replacement beyond the file")).cast("string")).otherwise(text).alias("text")
    )
