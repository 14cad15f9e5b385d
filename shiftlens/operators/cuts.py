"""Framework contracts between files and the cuts that must be migrated and verified together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage
from . import code_facts as C
from .graphs import components
from .ordered import ordinal, with_running

# Calls that register routers, idioms of test set-up and of shared state.
REGISTRARS = ("add_namespace", "include_router", "register_blueprint", "register_blueprints")
HARNESS_USE = r"\.(?:app_context|session_transaction|test_cli_runner|test_client)\s*\("
SHARED_STATE = r"(?U)\b(?:flash|session|current_user|login_required|render_template|url_for)\b"
STATEFUL = ("auth_login", "request_context", "sessions_flash", "sqlalchemy_plain")
NOT_REWRITTEN = ("adapter", "unchanged", "sanctioned_normalization", "unsupported_test_seam")


def _binding_calls(bound: DataFrame, called: DataFrame) -> DataFrame:
    """Calls that use a binding, as target or in an argument.

    A call is keyed by every dotted prefix of its target and every name in its arguments, so the
    join is on the name and no file has its calls paired with all its imports.
    """
    parts = F.split("target", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    keys = F.concat(
        F.transform(prefixes, lambda p: F.struct(p.alias("local"), F.lit(True).alias("as_target"))),
        F.transform("mentions", lambda m: F.struct(m.alias("local"), F.lit(False).alias("as_target"))),
    )
    keyed = called.select(
        "repo", F.col("path").alias("consumer"), F.col("seq").alias("call_seq"), "target", "operation", "evidence", F.explode(keys).alias("k")
    ).select("repo", "consumer", "call_seq", "target", "operation", "evidence", "k.local", "k.as_target")
    return bound.join(keyed, ["repo", "consumer", "local"])


def executable_edges(
    files: DataFrame, planned: DataFrame, strategies: DataFrame, companions: DataFrame, artifacts: DataFrame | None = None
) -> DataFrame:
    """(repo, provider, consumer, kind, operation, evidence) between planned files.

    ``companions`` is (repo, path, symbol) for pinned symbols that bring a companion export and for
    those exports; ``artifacts`` (repo, path, other, relation, purpose) with relation ``consumer`` or
    ``dependency`` for new modules.  Of several edges that differ in evidence only the last stays.
    """
    roles = planned.select("repo", "path", "role", F.arrays_overlap("subtasks", F.array(*[F.lit(s) for s in STATEFUL])).alias("stateful"))
    frozen = strategies.filter(F.col("strategy").isin(*NOT_REWRITTEN)).select("repo", F.col("path").alias("consumer"))
    wiring = strategies.filter("strategy = 'adapter_wiring'").select("repo", F.col("path").alias("consumer"), F.lit(True).alias("wired"))
    texts = files.select(
        "repo", F.col("path").alias("consumer"), F.col("text").rlike(HARNESS_USE).alias("harness_use")
    )
    bound = (
        C.bindings(files)
        .withColumnRenamed("path", "provider")
        .withColumnRenamed("importer", "consumer")
        .join(roles.select("repo", F.col("path").alias("provider"), F.col("role").alias("p_role"), "stateful"), ["repo", "provider"])
        .join(roles.select("repo", F.col("path").alias("consumer"), F.col("role").alias("c_role")), ["repo", "consumer"])
        .join(frozen, ["repo", "consumer"], "left_anti")
    )
    bound = cut_lineage(bound)
    called = C.calls(files)
    uses = cut_lineage(_binding_calls(bound, called))
    keys = ["repo", "provider", "consumer"]

    def edge(rows: DataFrame, kind: str, operation: Column, evidence: Column, last: Column) -> DataFrame:
        return rows.groupBy(*keys, F.lit(kind).alias("kind"), operation.alias("operation")).agg(F.max_by(evidence, last).alias("evidence"))

    by_call = F.struct("seq", "call_seq")
    first_call = F.struct(F.col("seq"), -F.col("call_seq"))
    registering = uses.filter(F.col("operation").isin(*REGISTRARS) & ~F.col("as_target"))
    found = [
        edge(registering, "router_registration", F.col("operation"), F.col("evidence"), by_call),
        edge(uses.filter("operation = 'init_app' AND as_target"), "extension_initialization", F.col("operation"), F.col("evidence"), by_call),
        edge(uses.filter("operation = 'add_command' AND NOT as_target"), "cli_registration", F.col("operation"), F.col("evidence"), by_call),
    ]

    refs = C.references(files).select("repo", F.col("path").alias("consumer"), F.col("text").alias("local")).distinct()
    referenced = bound.join(refs, ["repo", "consumer", "local"], "left_semi")

    # a router handed over through a list: the factory registers something, and does use the import
    registrars = called.filter(F.col("operation").isin(*REGISTRARS)).groupBy("repo", F.col("path").alias("consumer")).agg(
        F.min_by(F.struct("operation", "evidence"), "seq").alias("call")
    )
    direct = registering.groupBy(*keys).agg(F.min("seq").alias("direct_at"))
    indirect = (
        referenced.filter("p_role = 'router' AND c_role = 'app_factory'")
        .groupBy(*keys)
        .agg(F.min("seq").alias("seq"))
        .join(direct, keys, "left")
        .filter("direct_at IS NULL OR seq < direct_at")
        .join(registrars, ["repo", "consumer"])
    )
    found.append(
        indirect.select(*keys, F.lit("router_registration").alias("kind"), F.concat(F.col("call.operation"), F.lit("_indirect")).alias("operation"), F.col("call.evidence").alias("evidence"))
    )

    pinned = companions.select("repo", F.col("path").alias("provider"), F.col("symbol").alias("pinned")).distinct()
    lifecycle = uses.join(pinned, ["repo", "provider"]).filter(
        F.when(F.col("symbol").isNotNull(), F.col("symbol") == F.col("pinned")).otherwise(F.col("target") == F.concat_ws(".", "local", "pinned"))
    )
    found.append(edge(lifecycle, "resource_lifecycle", F.lit("call"), F.col("evidence"), first_call))

    first_use = uses.groupBy(*keys, "seq", "local").agg(F.min_by("evidence", "call_seq").alias("use"))
    state = referenced.filter("stateful").join(first_use, [*keys, "seq", "local"], "left")
    found.append(
        edge(
            state, "framework_state", F.when(F.col("use").isNotNull(), "call").otherwise("reference"),
            F.coalesce("use", "local"), F.struct("seq", "local"),
        )
    )

    harness = (
        bound.filter("p_role = 'app_factory' AND c_role = 'test_harness'")
        .join(first_use, [*keys, "seq", "local"])
        .join(wiring, ["repo", "consumer"], "left")
        .join(texts, ["repo", "consumer"])
        .filter(F.coalesce("wired", F.lit(False)) | F.col("harness_use"))
    )
    found.append(edge(harness, "factory_harness", F.lit("create_app"), F.col("use"), F.struct("seq", "local")))

    commands = C.web_facts(files).filter("fact = 'command'").select("repo", F.col("path").alias("provider")).distinct()
    cli = bound.filter("c_role = 'test_harness'").join(commands, ["repo", "provider"], "left_semi")
    found.append(edge(cli, "cli_harness", F.lit("invoke"), F.col("local"), F.struct("seq", "local")))

    registered = found[0].unionByName(found[3]).select(*keys).distinct()
    shared = files.filter(F.col("text").rlike(SHARED_STATE)).select("repo", F.col("path").alias("provider"))
    middleware = (
        bound.filter("p_role = 'router' AND c_role = 'app_factory'").select(*keys).distinct().join(registered, keys, "left_semi").join(shared, ["repo", "provider"], "left_semi")
    )
    found.append(
        middleware.select(
            *keys, F.lit("middleware_configuration").alias("kind"), F.lit("session/template/auth").alias("operation"),
            F.lit("route requires app-owned middleware/config").alias("evidence"),
        )
    )
    if artifacts is not None:
        made = artifacts.join(planned.select("repo", F.col("path").alias("other")), ["repo", "other"], "left_semi")
        forward = F.col("relation") == "consumer"
        found.append(
            made.select(
                "repo",
                F.when(forward, F.col("path")).otherwise(F.col("other")).alias("provider"),
                F.when(forward, F.col("other")).otherwise(F.col("path")).alias("consumer"),
                F.when(forward, "planned_artifact").otherwise("artifact_dependency").alias("kind"),
                F.when(forward, "consume").otherwise("depends_on").alias("operation"),
                F.coalesce("purpose", F.lit("planned target architecture artifact")).alias("evidence"),
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.filter("provider <> consumer")


def executable_cuts(edges: DataFrame, planned: DataFrame, strategies: DataFrame, limit: int = 4) -> tuple[DataFrame, DataFrame]:
    """The cuts and their members.

    A cut is a connected part of the edges between files that are rewritten.  Up to ``limit`` files
    are generated together, larger cuts only verified together.  ``planned`` has ``position``.
    Returns (repo, cut_id, size, mode, edge_kinds) and (repo, cut_id, path, position).
    """
    fixed = strategies.filter(F.col("strategy").isin(*NOT_REWRITTEN)).select("repo", "path")
    eligible = planned.select("repo", "path", "position").join(fixed, ["repo", "path"], "left_anti")
    active = edges
    for side in ("provider", "consumer"):
        active = active.join(eligible.select("repo", F.col("path").alias(side)), ["repo", side], "left_semi")
    active = cut_lineage(active.select("repo", "provider", "consumer", "kind"))
    parts = components(active.select("repo", F.col("provider").alias("src"), F.col("consumer").alias("dst")))
    members = eligible.join(parts.withColumnRenamed("node", "path"), ["repo", "path"])
    kinds = active.join(parts.select("repo", F.col("node").alias("provider"), "component"), ["repo", "provider"]).groupBy("repo", "component").agg(
        F.array_sort(F.collect_set("kind")).alias("edge_kinds")
    )
    sized = members.groupBy("repo", "component").agg(F.count("*").alias("size"), F.min("position").alias("first"))
    numbered = with_running(sized, ["repo"], ["first"], {"n": ordinal()})
    cut_id = F.concat(F.lit("executable-cut-"), F.col("n").cast("string"))
    named = numbered.select("repo", "component", "size", cut_id.alias("cut_id"))
    cuts = named.join(kinds, ["repo", "component"]).select(
        "repo", "cut_id", "size", F.when(F.col("size") <= limit, "coordinated").otherwise("batch_only").alias("mode"), "edge_kinds"
    )
    return cuts, members.join(named.drop("size"), ["repo", "component"]).select("repo", "cut_id", "path", "position")


def cut_summary(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Counts for the report; evidence stays out of it."""
    per_repo = edges.groupBy("repo").agg(F.count("*").alias("edges"))
    cut = cuts.groupBy("repo").agg(F.count("*").alias("cuts"), F.count_if(F.col("mode") == "batch_only").alias("diagnostics"))
    return per_repo.join(cut, "repo", "left").select(
        "repo", "edges", F.coalesce("cuts", F.lit(0)).alias("cuts"), F.coalesce("diagnostics", F.lit(0)).alias("diagnostics")
    )


def attached_normalizations(members: DataFrame, normalizations: DataFrame, planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of sanctioned test changes, and cut members with the changed tests next to their owner.

    An owner without a cut gets one of its own.  ``normalizations`` is (repo, path, owner_path).
    """
    both = normalizations.join(planned.select("repo", "path"), ["repo", "path"], "left_semi").join(
        planned.select("repo", F.col("path").alias("owner_path")), ["repo", "owner_path"], "left_semi"
    )
    edges = both.select(
        "repo", F.col("owner_path").alias("provider"), F.col("path").alias("consumer"), F.lit("sanctioned_test_normalization").alias("kind")
    )
    owner = members.select("repo", F.col("path").alias("owner_path"), "cut_id")
    placed = both.join(owner, ["repo", "owner_path"], "left").withColumn(
        "cut_id", F.coalesce("cut_id", F.concat(F.lit("executable-cut-for-"), F.col("owner_path")))
    )
    added = placed.select("repo", "cut_id", "path").unionByName(placed.select("repo", "cut_id", F.col("owner_path").alias("path")))
    return edges, members.select("repo", "cut_id", "path").unionByName(added).distinct()


def filled_units(units: DataFrame, bound: DataFrame, eligible: DataFrame, max_files: int = 4) -> DataFrame:
    """Fill each unit up to ``max_files`` with the first file one of its members imports.

    ``units`` is (repo, unit_id, path), ``bound`` (repo, path, importer), ``eligible``
    (repo, path, position).  One file joins a unit per round, so a few rounds of joins do it.
    """
    current = units.select("repo", "unit_id", "path").distinct()
    imports = bound.select("repo", F.col("importer").alias("member"), "path").distinct().join(eligible, ["repo", "path"])
    for _ in range(max_files - 1):
        open_units = current.groupBy("repo", "unit_id").agg(F.count("*").alias("n")).filter(F.col("n") < max_files).select("repo", "unit_id")
        wanted = (
            current.join(open_units, ["repo", "unit_id"], "left_semi")
            .withColumnRenamed("path", "member")
            .join(imports, ["repo", "member"])
            .select("repo", "unit_id", "path", "position")
            .join(current, ["repo", "unit_id", "path"], "left_anti")
        )
        chosen = wanted.groupBy("repo", "unit_id").agg(F.min_by("path", F.struct("position", "path")).alias("path"))
        current = cut_lineage(current.unionByName(chosen))
    return current


def migration_units(planned: DataFrame, deps: DataFrame, owners: DataFrame, invoking: DataFrame, max_files: int = 4) -> DataFrame:
    """(repo, unit_id, path): small units around resource modules.

    An owner brings the first application factory and the first test set-up that depend on it, and
    one more test that invokes commands.  A unit needs two files.  An owner an earlier unit holds
    starts no unit.  ``planned`` is (repo, path, role, position), ``deps`` (repo, path, dep),
    ``owners`` and ``invoking`` (repo, path).
    """
    seeds = owners.distinct().join(planned, ["repo", "path"]).select("repo", F.col("path").alias("owner"), "position", "role")

    def dependents(starts: DataFrame) -> DataFrame:
        """(repo, owner, path): everything that depends on a start, at any distance."""
        seen = cut_lineage(starts.select("repo", "owner", "path"))
        frontier = seen
        while not frontier.isEmpty():
            step = frontier.withColumnRenamed("path", "dep").join(deps, ["repo", "dep"]).select("repo", "owner", "path").distinct()
            frontier = cut_lineage(step.join(seen, ["repo", "owner", "path"], "left_anti"))
            seen = cut_lineage(seen.unionByName(frontier))
        return seen

    def first(rows: DataFrame, rank: Column) -> DataFrame:
        return rows.groupBy("repo", "owner").agg(F.min_by("path", rank).alias("path"))

    above = dependents(seeds.select("repo", "owner", F.col("owner").alias("path")))
    placed = above.join(planned, ["repo", "path"]).filter("path <> owner")
    by_place = F.struct("position", "path")
    factory = first(placed.filter("role = 'app_factory'"), by_place)
    around = dependents(factory).unionByName(above).distinct().join(planned, ["repo", "path"]).filter("role = 'test_harness' AND path <> owner")
    harness = first(around, F.struct(~F.col("path").rlike(r"(^|/)conftest\.py$"), F.col("position"), F.col("path")))
    core = cut_lineage(
        seeds.select("repo", "owner", F.col("owner").alias("path")).unionByName(factory).unionByName(harness).distinct()
    )
    tests = planned.filter("role = 'test_harness'").join(invoking, ["repo", "path"], "left_semi").select("repo", "path", "position")
    # the members exclude at most three tests, so the first four per repository are enough
    from .task_tables import first_k

    few = first_k(tests, ["repo"], ["position", "path"], max_files).drop("position")
    order = tests.select("repo", "path", "position")
    spare = seeds.select("repo", "owner").join(few.join(order, ["repo", "path"]), "repo").join(core, ["repo", "owner", "path"], "left_anti")
    size = core.groupBy("repo", "owner").agg(F.count("*").alias("n"))
    invoker = first(spare.join(size.filter(F.col("n") < max_files), ["repo", "owner"], "left_semi"), by_place)
    unit = core.unionByName(invoker)
    roles = unit.join(planned.select("repo", "path", "role"), ["repo", "path"]).groupBy("repo", "owner").agg(
        F.count("*").alias("n"), F.bool_or(F.col("role").isin("support", "app_factory")).alias("anchored")
    )
    usable = cut_lineage(unit.join(roles.filter("n >= 2 AND anchored"), ["repo", "owner"], "left_semi"))

    # owners that an earlier unit already holds: decided from the first owner on
    start = seeds.select("repo", "owner", "position")
    claims = (
        usable.join(start.withColumnRenamed("position", "claimer_at"), ["repo", "owner"])
        .select("repo", F.col("owner").alias("claimer"), F.col("path").alias("owner"), "claimer_at")
        .join(start, ["repo", "owner"])
        .filter("claimer <> owner AND claimer_at < position")
        .select("repo", "claimer", "owner")
    )
    open_claims, dropped = cut_lineage(claims), None
    while not open_claims.isEmpty():
        kept = open_claims.select("repo", F.col("claimer").alias("owner")).distinct().join(open_claims, ["repo", "owner"], "left_anti")
        lost = open_claims.join(kept.withColumnRenamed("owner", "claimer"), ["repo", "claimer"], "left_semi").select("repo", "owner").distinct()
        dropped = lost if dropped is None else dropped.unionByName(lost)
        gone = cut_lineage(lost)
        open_claims = cut_lineage(
            open_claims.join(gone, ["repo", "owner"], "left_anti")
            .join(gone.withColumnRenamed("owner", "claimer"), ["repo", "claimer"], "left_anti")
        )
    if dropped is not None:
        usable = usable.join(dropped, ["repo", "owner"], "left_anti")
    numbered = with_running(
        usable.select("repo", "owner").distinct().join(start, ["repo", "owner"]), ["repo"], ["position", "owner"], {"n": ordinal()}
    )
    unit_id = F.concat(F.lit("framework-seam-"), F.col("n").cast("string"))
    return usable.join(numbered.select("repo", "owner", unit_id.alias("unit_id")), ["repo", "owner"]).select("repo", "unit_id", "path")


def _merged(rows: list[dict], limit: int) -> Iterator[tuple[int, int, str]]:
    """(is_cut, rank, path) of one cluster's sets once its cuts have been merged in, the lowest rank first."""
    found: dict = {}
    for r in rows:
        found.setdefault((r["is_cut"], r["rank"]), set()).add(r["path"])
    merged = [(k, found[k]) for k in sorted(found) if k[0] == 0]
    for k in sorted(k for k in found if k[0] == 1):
        touching = [u for u in merged if u[1] & found[k]]
        together = found[k].union(*[u[1] for u in touching])
        if len(together) <= limit:
            merged = [u for u in merged if u not in touching] + [(k, together)]
    for k, paths in merged:
        yield from ((*k, p) for p in sorted(paths))


def merged_units(units: DataFrame, cuts: DataFrame, members: DataFrame, limit: int = 4) -> DataFrame:
    """Units and coordinated cuts that overlap, merged while they stay small: (repo, unit_id, path).

    Only sets that share files, directly or through others, influence each other, so each such
    cluster is merged by itself, cut by cut.
    """
    small = members.join(cuts.filter("mode = 'coordinated'").select("repo", "cut_id"), ["repo", "cut_id"], "left_semi")
    rank = F.regexp_extract("cut_id", r"(\d+)$", 1).cast("int")
    sets = units.select("repo", F.lit(0).alias("is_cut"), F.regexp_extract("unit_id", r"(\d+)$", 1).cast("int").alias("rank"), "path").unionByName(
        small.select("repo", F.lit(1).alias("is_cut"), rank.alias("rank"), "path")
    )
    named = cut_lineage(sets.withColumn("set_id", F.concat_ws("-", "is_cut", "rank")))
    links = named.select("repo", F.concat(F.lit("s:"), F.col("set_id")).alias("src"), F.concat(F.lit("p:"), F.col("path")).alias("dst"))
    cluster = components(links).select("repo", F.col("node").alias("src"), "component")
    keyed = named.withColumn("src", F.concat(F.lit("s:"), F.col("set_id"))).join(cluster, ["repo", "src"]).drop("src", "set_id")

    clusters = keyed.groupBy("repo", "component").agg(F.collect_list(F.struct("is_cut", "rank", "path")).alias("rows"))
    schema = StructType.fromDDL("repo string, is_cut int, rank int, path string")
    arrow = to_arrow_schema(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repos, rows = (c.to_pylist() for c in batch.columns)
            out = [(repo, *row) for repo, members in zip(repos, rows, strict=True) for row in _merged(members, limit)]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True) if out else [[]] * 4, arrow, strict=True)], schema=arrow)

    done = clusters.select("repo", "rows").mapInArrow(merge, schema)
    heads = done.select("repo", "is_cut", "rank").distinct()
    numbered = with_running(heads, ["repo"], ["is_cut", "rank"], {"n": ordinal()})
    unit_id = F.concat(F.lit("coordinated-unit-"), F.col("n").cast("string"))
    return done.join(numbered, ["repo", "is_cut", "rank"]).select("repo", unit_id.alias("unit_id"), "path")


def wiring_factories(planned: DataFrame, strategies: DataFrame, bound: DataFrame) -> DataFrame:
    """(repo, wiring, factory): the application factory each test set-up wraps.

    The first factory the set-up imports; without one, the repository's only factory.
    """
    place = F.struct("position", "path")
    factories = planned.filter("role = 'app_factory'").select("repo", "path", "position")
    wiring = strategies.filter("strategy = 'adapter_wiring'").join(planned.select("repo", "path"), ["repo", "path"], "left_semi").select(
        "repo", F.col("path").alias("wiring")
    )
    imported = (
        bound.select("repo", "path", F.col("importer").alias("wiring"))
        .distinct()
        .join(factories, ["repo", "path"])
        .groupBy("repo", "wiring")
        .agg(F.min_by("path", place).alias("imported"))
    )
    only = factories.groupBy("repo").agg(F.count("*").alias("n"), F.min("path").alias("only")).filter("n = 1").drop("n")
    return (
        wiring.join(imported, ["repo", "wiring"], "left")
        .join(only, "repo", "left")
        .select("repo", "wiring", F.coalesce("imported", "only").alias("factory"))
        .filter("factory IS NOT NULL")
    )


def wired_units(units: DataFrame, pairs: DataFrame, planned: DataFrame, max_files: int = 4) -> DataFrame:
    """Units with factories and their test set-ups in one unit, while there is room.

    A pair joins the first unit that holds either file; pairs without one share a new unit per
    factory.
    """
    either = pairs.select("repo", "wiring", "factory", F.explode(F.array("factory", "wiring")).alias("path"))
    held = either.join(units, ["repo", "path"]).groupBy("repo", "wiring", "factory").agg(F.min("unit_id").alias("held"))
    unit_id = F.coalesce("held", F.concat(F.lit("test-adapter-seam-"), F.col("factory")))
    wanted = either.join(held, ["repo", "wiring", "factory"], "left").select("repo", unit_id.alias("unit_id"), "path", (F.col("path") == F.col("factory")).alias("leads"))
    fresh = (
        wanted.groupBy("repo", "unit_id", "path").agg(F.max("leads").alias("leads"))
        .join(units.select("repo", "unit_id", "path"), ["repo", "unit_id", "path"], "left_anti")
        .join(planned.select("repo", "path", "position"), ["repo", "path"])
        .withColumn("follows", ~F.col("leads"))
    )
    size = units.groupBy("repo", "unit_id").agg(F.count("*").alias("size"))
    placed = with_running(fresh, ["repo", "unit_id"], ["follows", "position", "path"], {"n": ordinal()})
    room = placed.join(size, ["repo", "unit_id"], "left").filter(F.coalesce("size", F.lit(0)) + F.col("n") <= max_files)
    return units.select("repo", "unit_id", "path").unionByName(room.select("repo", "unit_id", "path"))
