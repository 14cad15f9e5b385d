"""Checks of proposed plans and replies, which come as free text and are taken whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .graphs import cycle_members

# Limits and kinds of a proposal.
MAX_ARTIFACTS = 4
MAX_PURPOSE = 600
MAX_INSTRUCTIONS = 2400
MAX_SIGNATURE = 300
KINDS = ("class", "function", "variable")

# Letters, marks, digits and connectors of Unicode make an identifier.
_IDENTIFIER = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*\z"


def is_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(_IDENTIFIER), F.lit(False))


def is_safe_path(value: Column) -> Column:
    """Relative, normalized and inside the repository."""
    parts = F.split(value, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return (value != "") & ~bad


def _text(item: Column, name: str) -> Column:
    """A field that is a JSON string, else NULL."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def _list(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "array<variant>")


def _is_list(item: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")).startswith("ARRAY")


def _strings(item: Column, name: str) -> Column:
    """A list of strings, NULL elements standing for anything else; a missing field is empty."""
    values = F.transform(
        F.coalesce(_list(item, name), F.array().cast("array<variant>")),
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )
    return values


def _absent(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant").isNull()


def _repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) != F.size(values)


def plan_violations(plans: DataFrame, existing: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(plan_id, item, rule): every rule a proposed plan breaks; a plan without rows is accepted.

    ``plans`` is (plan_id, text), ``existing`` and ``rewrites`` (plan_id, path).  The text must be a
    JSON list of at most ``MAX_ARTIFACTS`` objects.  The texts are parsed once; what the rules across items need of them
    is written out as plain columns.
    """
    from ..session import stored

    parsed = plans.select("plan_id", F.try_parse_json("text").alias("v"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    listing = parsed.select("plan_id", F.col("v").isNull().alias("broken"), F.when(is_list, F.try_variant_get("v", "$", "array<variant>")).alias("items"))
    wrong = F.when(F.col("broken"), "not_json").when(F.col("items").isNull(), "not_a_list").when(F.size("items") > MAX_ARTIFACTS, "too_many_artifacts")
    items = listing.select("plan_id", wrong.alias("wrong"), F.posexplode_outer("items").alias("item", "i"))
    i = F.col("i")
    fields = items.select(
        "plan_id", "wrong", "item", "i",
        _text(i, "path").alias("path"), _text(i, "purpose").alias("purpose"), _text(i, "instructions").alias("instructions"),
        F.when(_absent(i, "role"), F.lit("support")).otherwise(_text(i, "role")).alias("role"),
        _strings(i, "capabilities").alias("capabilities"), _strings(i, "consumers").alias("consumers"), _strings(i, "depends_on").alias("depends_on"),
        F.coalesce(_list(i, "exports"), F.array().cast("array<variant>")).alias("exports"),
    )

    def when(condition: Column, rule: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(rule))

    path, text = F.col("path"), F.col

    def blank(name: str) -> Column:
        return F.coalesce(F.trim(text(name)) == "", F.lit(True))

    def listed(name: str) -> Column:
        return ~_absent(i, name) & ~_is_list(i, name)

    names = F.transform("exports", lambda e: _text(e, "name"))
    wrong_kind = F.exists("exports", lambda e: ~F.coalesce(_text(e, "kind").isin(*KINDS), F.lit(False)))
    bad_members = F.exists(
        "exports", lambda e: (~_absent(e, "members") & ~_is_list(e, "members")) | F.exists(_strings(e, "members"), lambda m: ~is_identifier(m)) | _repeats(_strings(e, "members"))
    )
    declared = r"(?U)^\s*(?:class|(?:async\s+)?def)\s+([A-Za-z_]\w*)\b"

    def other_name(e: Column) -> Column:
        said = F.regexp_extract(F.coalesce(_text(e, "signature"), F.lit("")), declared, 1)
        return (said != "") & (said != _text(e, "name")) & (_text(e, "kind") != "variable")

    long_signature = F.exists("exports", lambda e: ~_absent(e, "signature") & F.coalesce(F.length(_text(e, "signature")) > MAX_SIGNATURE, F.lit(True)))
    rules = F.array_compact(F.array(
        when(~F.schema_of_variant(i).startswith("OBJECT"), "not_an_object"),
        when(path.isNull() | (path == ""), "path_missing"),
        when(~is_safe_path(path), "path_unsafe"),
        when(P.suffix(path) != ".py", "path_not_python"),
        when(P.is_denied(path), "path_denied"),
        when(blank("purpose"), "purpose_empty"),
        when(F.length("purpose") > MAX_PURPOSE, "purpose_long"),
        when(blank("instructions"), "instructions_empty"),
        when(F.length("instructions") > MAX_INSTRUCTIONS, "instructions_long"),
        when(~is_identifier(text("role")), "role_not_identifier"),
        when(listed("capabilities") | F.exists("capabilities", lambda c: ~is_identifier(c)), "capability_not_identifier"),
        when(_repeats(text("capabilities")), "capability_repeated"),
        when(F.size("exports") == 0, "no_exports"),
        when(F.exists(names, lambda n: ~is_identifier(n)), "export_not_identifier"),
        when(_repeats(names), "export_repeated"),
        when(wrong_kind, "export_kind"),
        when(bad_members, "export_members"),
        when(long_signature, "signature_long"),
        when(F.exists("exports", other_name), "signature_name"),
        when(listed("consumers") | listed("depends_on") | F.exists("consumers", lambda c: c.isNull()) | F.exists("depends_on", lambda c: c.isNull()), "relations_not_strings"),
        when(_repeats(text("consumers")) | _repeats(text("depends_on")), "relations_repeated"),
        when(F.array_contains("depends_on", path), "depends_on_itself"),
        when(F.arrays_overlap("consumers", "depends_on"), "depends_on_consumer"),
    ))
    judged = stored(fields.select("plan_id", "wrong", "item", "path", "consumers", "depends_on", F.when(F.col("item").isNotNull(), rules).alias("rules")))
    whole = judged.filter("wrong IS NOT NULL AND coalesce(item, 0) = 0").select("plan_id", F.lit(None).cast("int").alias("item"), F.col("wrong").alias("rule"))
    fields = judged.filter("item IS NOT NULL")
    alone = fields.select("plan_id", "item", F.explode("rules").alias("rule"))

    def rows(found: DataFrame, rule: str) -> DataFrame:
        return found.select("plan_id", "item", F.lit(rule).alias("rule"))

    paths = fields.filter("path IS NOT NULL").select("plan_id", "item", "path")
    taken = paths.join(existing, ["plan_id", "path"], "left_semi")
    twice = paths.join(paths.groupBy("plan_id", "path").agg(F.count("*").alias("n")).filter("n > 1"), ["plan_id", "path"], "left_semi")
    named = fields.select("plan_id", "item", F.explode("consumers").alias("path")).filter("path IS NOT NULL")
    strangers = named.join(rewrites, ["plan_id", "path"], "left_anti").dropDuplicates(["plan_id", "item"])
    needs = fields.select("plan_id", "item", F.col("path").alias("node"), F.explode("depends_on").alias("path")).filter("path IS NOT NULL")
    known = rewrites.unionByName(paths.select("plan_id", "path")).distinct()
    unknown = needs.join(known, ["plan_id", "path"], "left_anti").dropDuplicates(["plan_id", "item"])
    between = needs.join(paths.select("plan_id", "path"), ["plan_id", "path"], "left_semi").select(F.col("plan_id").alias("repo"), "node", F.col("path").alias("dep"))
    circle = cycle_members(between).select(F.col("repo").alias("plan_id"), F.col("node").alias("path"))
    looped = paths.join(circle, ["plan_id", "path"], "left_semi")
    return (
        whole.unionByName(alone)
        .unionByName(rows(taken, "path_exists"))
        .unionByName(rows(twice, "path_repeated"))
        .unionByName(rows(strangers, "unknown_consumer"))
        .unionByName(rows(unknown, "unknown_dependency"))
        .unionByName(rows(looped, "dependency_cycle"))
    )


def cluster_pattern(start: str = "<<<FILE:", end: str = "<<<END_FILE>>>") -> str:
    """One marked, fenced file of a reply; the markers are the deployment's."""
    return rf"(?s)\Q{start}\E([^>\n]+)>>>\s*```(?:python)?\n(.*?)```\s*\Q{end}\E"


def cluster_files(replies: DataFrame, wanted: DataFrame, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The files of a reply and what is wrong with it.

    ``replies`` is (reply_id, text), ``wanted`` (reply_id, path).  Returns (reply_id, path, body) and
    (reply_id, path, rule) with rules unexpected, duplicate and missing.
    """
    from ..functions.text import strip

    regex = F.lit(pattern or cluster_pattern())
    blocks = F.arrays_zip(F.regexp_extract_all("text", regex, F.lit(1)).alias("path"), F.regexp_extract_all("text", regex, F.lit(2)).alias("body"))
    found = replies.select("reply_id", F.explode(blocks).alias("b")).select(
        "reply_id", strip(F.col("b.path")).alias("path"), F.concat(strip(F.col("b.body")), F.lit("\n")).alias("body")
    )
    unexpected = found.join(wanted, ["reply_id", "path"], "left_anti").select("reply_id", "path").distinct()
    twice = found.groupBy("reply_id", "path").agg(F.count("*").alias("n")).filter("n > 1").select("reply_id", "path")
    missing = wanted.join(found, ["reply_id", "path"], "left_anti").select("reply_id", "path")
    problems = (
        unexpected.withColumn("rule", F.lit("unexpected"))
        .unionByName(twice.withColumn("rule", F.lit("duplicate")))
        .unionByName(missing.withColumn("rule", F.lit("missing")))
    )
    return found, problems


def test_files_in(results: DataFrame, workspace: str) -> DataFrame:
    """Test modules named anywhere in a JSON result, relative to the workspace.

    Every string of the document is looked at, whatever its depth, so quoted strings are taken from
    the text; escapes other than the slash do not occur in paths.
    """
    quoted = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')
    both = F.arrays_zip(F.regexp_extract_all("result", quoted, F.lit(1)).alias("s"), F.regexp_extract_all("result", quoted, F.lit(2)).alias("colon"))
    # a string followed by a colon is a key
    values = F.transform(F.filter(both, lambda x: x["colon"] == ""), lambda x: x["s"])
    raw = results.select("id", F.explode(F.array_distinct(values)).alias("s"))
    clean = raw.select("id", F.replace(F.replace("s", F.lit("\\/"), F.lit("/")), F.lit("\\\\"), F.lit("/")).alias("path"))
    name = P.basename(F.col("path"))
    wanted = (name.startswith("test_") & name.endswith(".py")) | name.endswith("_test.py")
    return clean.filter(wanted).select("id", P.relative_to(F.col("path"), F.lit(workspace)).alias("test")).distinct()
