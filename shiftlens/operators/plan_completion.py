"""Completion of proposed modules by rewriting rules, and the checks of a proposal.

A proposal is a table of facts (repo, owner, relation, name, value) about the modules it wants to make:

* ``capability``: name is what the module offers
* ``consumer``: name is a file that will use it
* ``export``: name is what it exports, value the kind (class, function or variable)
* ``member``: name is a member, value the export that has it
* ``dependency``: name is another module it needs

``needs`` is (repo, capability, relation, name, value): the consumers, exports with their kinds, and class members that a
capability has to have.  ``factories`` is (repo, path).

Rules propose additions and removals.  Rules of one layer are applied together, again and again on what the last round has
touched, until nothing changes; then the next layer follows.  What was taken away is not put back, so this ends.  Every
change goes to a log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import stored

FACT = ["repo", "owner", "relation", "name", "value"]
# What offers a request's state, and what the class that owns it has to have.
RUNTIME = ("request_context", "session_and_flash")
RUNTIME_MEMBERS = ("get_request_context", "manage_session")
RUNTIME_CLASSES = ("RequestContextMiddleware", "FastAPIRequestContextMiddleware")
KEPT_MEMBER = "dispatch"
RENDER = "render_template"

Rule = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def _of(facts: DataFrame, relation: str) -> DataFrame:
    return facts.filter(F.col("relation") == relation).drop("relation")


def _sole(rows: DataFrame, *keys: str) -> DataFrame:
    """The owner of every key that has exactly one."""
    return rows.groupBy(*keys).agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("n")).filter("n = 1").drop("n")


def _change(rows: DataFrame, action: str, relation: str, rule: str, name: str | Column = "name", value: str | Column = "value") -> DataFrame:
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(
        "repo", "owner", F.lit(action).alias("action"), F.lit(relation).alias("relation"), as_column(name).alias("name"), as_column(value).alias("value"), F.lit(rule).alias("rule")
    )


def _needed(facts: DataFrame, needs: DataFrame, relation: str) -> DataFrame:
    """What the one owner of each needed capability has to have."""
    offered = _of(facts, "capability").select("repo", "owner", F.col("name").alias("capability"))
    return _sole(offered, "repo", "capability").join(_of(needs, relation), ["repo", "capability"])


def _classes(facts: DataFrame) -> DataFrame:
    """(repo, owner, export, classes): the classes that modules export, with how many each has."""
    classes = _of(facts, "export").filter("value = 'class'").select("repo", "owner", F.col("name").alias("export"))
    return classes.join(classes.groupBy("repo", "owner").agg(F.count("*").alias("classes")), ["repo", "owner"])


def add_consumers(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """The one owner of a capability lists all files that need it."""
    return _change(_needed(facts, needs, "consumer"), "add", "consumer", "consumers", value=F.lit(""))


def add_exports(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """The one owner of a capability exports what is needed, unless it has an export of that name."""
    there = _of(facts, "export").select("repo", "owner", "name")
    return _change(_needed(facts, needs, "export").join(there, ["repo", "owner", "name"], "left_anti"), "add", "export", "exports")


def add_members(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """Needed members go to the owner's only class, or to the only one that has any of them."""
    needed = _needed(facts, needs, "member").select("repo", "owner", "capability", "name").distinct()
    classes = _classes(facts)
    only = needed.join(classes.filter("classes = 1"), ["repo", "owner"])
    has = _of(facts, "member").select("repo", "owner", "name", F.col("value").alias("export"))
    touching = needed.join(has, ["repo", "owner", "name"]).join(classes.filter("classes > 1"), ["repo", "owner", "export"])
    sole = touching.groupBy("repo", "owner", "capability").agg(F.min("export").alias("export"), F.max("export").alias("_last")).filter("export = _last").drop("_last")
    both = only.select("repo", "owner", "name", "export").unionByName(needed.join(sole, ["repo", "owner", "capability"]).select("repo", "owner", "name", "export"))
    return _change(both, "add", "member", "members", value="export")


def _runtime(facts: DataFrame) -> DataFrame:
    """(repo, owner) of the one module that offers request state."""
    return _sole(_of(facts, "capability").filter(F.col("name").isin(*RUNTIME)), "repo")


def _sole_owner(facts: DataFrame, capability: str) -> DataFrame:
    return _sole(_of(facts, "capability").filter(F.col("name") == capability), "repo")


def standalone_template(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """A module that only renders templates exports the render function and nothing else."""
    offers = _of(facts, "capability").groupBy("repo", "owner").agg(F.count_distinct("name").alias("offers"))
    alone = _sole_owner(facts, "template_rendering").join(offers.filter("offers = 1"), ["repo", "owner"]).select("repo", "owner")
    others = _of(facts, "export").join(alone, ["repo", "owner"]).filter((F.col("name") != RENDER) | (F.col("value") != "function"))
    return _change(alone, "add", "export", "template_exports", F.lit(RENDER), F.lit("function")).unionByName(_change(others, "remove", "export", "template_exports"))


def runtime_class(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """The owner of request state has one class with the two runtime members, and no functions of their names.

    A class that is missing is named; members beyond those go, but for ``dispatch``, unless the module is the test surface
    too.  A module with several classes is left as it is.
    """
    runtime = _runtime(facts)
    counted = runtime.join(_classes(facts).select("repo", "owner", "export", "classes"), ["repo", "owner"], "left")
    judged = counted.filter("classes IS NULL OR classes = 1").select("repo", "owner", "export")
    functions = _of(facts, "export").filter(F.col("value") == "function").filter(F.col("name").isin(*RUNTIME_MEMBERS))
    gone = _change(functions.join(judged.select("repo", "owner"), ["repo", "owner"]), "remove", "export", "runtime_class")
    names = _of(facts, "export").groupBy("repo", "owner").agg(F.collect_set("name").alias("names"))
    first, second = RUNTIME_CLASSES
    fresh = judged.filter("export IS NULL").join(names, ["repo", "owner"], "left")
    fresh = fresh.withColumn("export", F.when(F.array_contains("names", first), second).otherwise(first)).select("repo", "owner", "export")
    made = _change(fresh, "add", "export", "runtime_class", "export", F.lit("class"))
    tested = _sole_owner(facts, "test_context_surface")
    old = judged.filter("export IS NOT NULL").join(tested, ["repo", "owner"], "left_anti")
    wanted = F.explode(F.array(*[F.lit(m) for m in RUNTIME_MEMBERS])).alias("name")
    filled = _change(fresh.unionByName(old).select("repo", "owner", "export", wanted), "add", "member", "runtime_class", value="export")
    has = _of(facts, "member").join(old.select("repo", "owner", F.col("export").alias("value")), ["repo", "owner", "value"])
    cut = _change(has.filter(~F.col("name").isin(*RUNTIME_MEMBERS, KEPT_MEMBER)), "remove", "member", "runtime_class")
    return gone.unionByName(made).unionByName(filled).unionByName(cut)


def factory_consumers(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """Application factories use the owner of request state."""
    return _change(_runtime(facts).join(factories, "repo"), "add", "consumer", "factory_consumers", "path", F.lit(""))


def test_class(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """Where one module has the test surfaces and one class, the class has exactly the members that tests use."""
    both = _sole_owner(facts, "test_context_surface").join(
        _of(facts, "capability").filter("name = 'direct_test_surface'").select("repo", "owner"), ["repo", "owner"]
    ).join(_runtime(facts).select("repo"), "repo")
    one = both.join(_classes(facts).filter("classes = 1"), ["repo", "owner"])
    wanted = _of(needs, "member").filter("capability = 'direct_test_surface'").select("repo", "name").distinct()
    one = one.join(wanted.select("repo").distinct(), "repo")
    added = _change(one.join(wanted, "repo"), "add", "member", "test_class", value="export")
    has = _of(facts, "member").join(one.select("repo", "owner", F.col("export").alias("value")), ["repo", "owner", "value"])
    return added.unionByName(_change(has.join(wanted, ["repo", "name"], "left_anti"), "remove", "member", "test_class"))


def _depends_on_runtime(facts: DataFrame, capability: str, rule: str) -> DataFrame:
    owner, runtime = _sole_owner(facts, capability), _runtime(facts).withColumnRenamed("owner", "runtime")
    return _change(owner.join(runtime, "repo").filter("owner <> runtime"), "add", "dependency", rule, "runtime", F.lit(""))


def test_dependency(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """The test surface needs the owner of request state."""
    return _depends_on_runtime(facts, "test_context_surface", "test_dependency")


def template_dependency(facts: DataFrame, needs: DataFrame, factories: DataFrame) -> DataFrame:
    """The template module needs the owner of request state."""
    return _depends_on_runtime(facts, "template_rendering", "template_dependency")


LAYERS: tuple[tuple[Rule, ...], ...] = (
    (add_consumers, add_exports, add_members),
    (standalone_template, runtime_class, factory_consumers),
    (test_class, test_dependency, template_dependency),
)
LOG = ["repo", "owner", "action", "relation", "name", "value", "rule", "layer"]


def completed(facts: DataFrame, needs: DataFrame, factories: DataFrame, layers: Sequence[Sequence[Rule]] = LAYERS) -> tuple[DataFrame, DataFrame]:
    """(facts, log): the proposal with all changes, and the changes (repo, owner, action, relation, name, value, rule, layer)."""
    state = stored(facts.select(*FACT).distinct())
    needs, factories = stored(needs), stored(factories)
    log = state.limit(0).select("repo", "owner", F.lit("").alias("action"), "relation", "name", "value", F.lit("").alias("rule"), F.lit(0).alias("layer"))
    for layer, rules in enumerate(layers):
        view = state
        while True:
            found = stored(reduce(DataFrame.unionByName, [rule(view, needs, factories) for rule in rules]))
            removed = found.filter("action = 'remove'").join(state, FACT, "left_semi")
            added = found.filter("action = 'add'").join(state, FACT, "left_anti").join(removed, FACT, "left_anti")
            added = added.join(log.filter("action = 'remove'").select(*FACT), FACT, "left_anti")
            new = added.unionByName(removed).groupBy(*LOG[:-2]).agg(F.min("rule").alias("rule"))
            new = stored(new.withColumn("layer", F.lit(layer)).select(*LOG))
            if new.isEmpty():
                break
            kept = state.join(new.filter("action = 'remove'"), FACT, "left_anti")
            state = stored(kept.unionByName(new.filter("action = 'add'").select(*FACT)))
            log = stored(log.unionByName(new))
            # rules look at one repository at a time, so only those that changed can change again
            view = state.join(new.select("repo").distinct(), "repo", "left_semi")
    return state, log


def audit(log: DataFrame) -> DataFrame:
    """One row per changed module: what was added to it and taken from it."""

    def listed(action: str, relation: str, text: Column) -> Column:
        wanted = (F.col("action") == action) & (F.col("relation") == relation)
        return F.array_sort(F.collect_set(F.when(wanted, text)))

    member = F.concat_ws(".", "value", "name")
    return log.groupBy("repo", "owner").agg(
        listed("add", "consumer", F.col("name")).alias("added_consumers"), listed("add", "export", F.col("name")).alias("added_exports"),
        listed("remove", "export", F.col("name")).alias("removed_exports"), listed("add", "member", member).alias("added_members"),
        listed("remove", "member", member).alias("removed_members"), listed("add", "dependency", F.col("name")).alias("added_dependencies"),
    )


def violations(facts: DataFrame, needs: DataFrame, allowed: DataFrame) -> DataFrame:
    """(repo, subject, rule, detail): what a proposal gets wrong.  ``allowed`` is (repo, owner), the paths a module may take."""
    facts, needs = stored(facts.select(*FACT).distinct()), stored(needs)

    def rows(found: DataFrame, subject: str, rule: str, detail: Column) -> DataFrame:
        return found.select("repo", F.col(subject).alias("subject"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail")).distinct()

    nothing = F.lit("")
    owners = facts.select("repo", "owner").distinct()
    is_test = P.is_recipe_test(F.col("owner"))
    out = [
        rows(owners.filter(is_test), "owner", "test_path", nothing),
        rows(owners.filter(~is_test).join(allowed, ["repo", "owner"], "left_anti"), "owner", "path_not_allowed", nothing),
    ]
    offered = _of(facts, "capability").select("repo", "owner", F.col("name").alias("capability"))
    asked = needs.select("repo", "capability").distinct()
    counts = asked.join(offered, ["repo", "capability"], "left").groupBy("repo", "capability").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"))
    out.append(rows(counts.filter("n <> 1"), "capability", "owner_count", F.col("n")))
    sole = _sole(offered.filter(F.col("capability").isin(*RUNTIME)).join(asked, ["repo", "capability"], "left_semi"), "repo", "capability")
    apart = sole.groupBy("repo").agg(F.count("*").alias("n"), F.min("owner").alias("owner"), F.max("owner").alias("other")).filter("n = 2 AND owner <> other")
    out.append(rows(apart, "owner", "runtime_not_shared", F.col("other")))
    single = counts.filter("n = 1").select("repo", "capability", "owner")
    consumers = single.join(_of(needs, "consumer"), ["repo", "capability"]).join(_of(facts, "consumer").select("repo", "owner", "name"), ["repo", "owner", "name"], "left_anti")
    grouped = consumers.groupBy("repo", "capability").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    out.append(rows(grouped, "capability", "consumers_omitted", F.col("names")))
    wanted = single.join(_of(needs, "member").select("repo", "capability", "name").distinct(), ["repo", "capability"])
    asked_members = wanted.groupBy("repo", "capability", "owner").agg(F.count("*").alias("wanted"))
    held = wanted.join(_of(facts, "member").withColumnRenamed("value", "export"), ["repo", "owner", "name"]).join(_classes(facts), ["repo", "owner", "export"])
    whole = held.groupBy("repo", "capability", "owner", "export").agg(F.count_distinct("name").alias("held")).join(asked_members, ["repo", "capability", "owner"]).filter("held = wanted")
    owning = asked_members.join(whole.groupBy("repo", "capability").agg(F.count("*").alias("n")), ["repo", "capability"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out.append(rows(owning.filter("n <> 1"), "capability", "member_classes", F.col("n")))
    exports = single.join(_of(needs, "export").withColumnRenamed("value", "needed"), ["repo", "capability"]).join(_of(facts, "export"), ["repo", "owner", "name"], "left")
    out.append(rows(exports.filter("value IS NULL"), "capability", "export_omitted", F.col("name")))
    out.append(rows(exports.filter("value <> needed"), "capability", "export_kind", F.concat("name", F.lit(": "), "value", F.lit(" for "), "needed")))
    class_counts = owners.join(_classes(facts).groupBy("repo", "owner").agg(F.count("*").alias("n")), ["repo", "owner"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out.append(rows(_runtime(facts).join(class_counts, ["repo", "owner"]).filter("n <> 1"), "owner", "runtime_classes", F.col("n")))
    surfaces = offered.filter("capability IN ('direct_test_surface', 'test_context_surface')").groupBy("repo", "owner").agg(F.count_distinct("capability").alias("both")).filter("both = 2")
    out.append(rows(surfaces.join(class_counts, ["repo", "owner"]).filter("n <> 1"), "owner", "facade_classes", F.col("n")))
    lone = offered.groupBy("repo", "owner").agg(F.collect_set("capability").alias("c")).filter(F.col("c") == F.array(F.lit("template_rendering")))
    shown = _of(facts, "export").groupBy("repo", "owner").agg(F.count("*").alias("n"), F.max((F.col("name") == RENDER) & (F.col("value") == "function")).alias("renders"))
    renders = lone.join(shown, ["repo", "owner"], "left").filter("n IS NULL OR n <> 1 OR NOT renders")
    out.append(rows(renders, "owner", "template_exports", F.coalesce("n", F.lit(0))))
    return reduce(DataFrame.unionByName, out)
