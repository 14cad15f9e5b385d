"""Life of resources and request state: what the old code keeps, and what a draft of the new code gets wrong about it.

All functions take tables of nodes (``held``, ``code_facts.nodes``) of files and are joins over them; ``brought`` is
``code_facts.imported_names`` and ``named`` the module names that files go by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import code_facts as C
from . import flow

_KEYS = ["repo", "path"]

# Names that only mean something inside a request, members that only the old framework's application has,
# and the name that resource modules give to their set-up function.
AMBIENT = ("app", "application", "request", "current_app", "g")
OLD_MEMBERS = ("cli", "config", "open_resource", "teardown_appcontext")
INITIALIZER = "init_app"
#: The name of the request's state.
HOLDER = "g"
# Calls whose result has to be closed.
OPENERS = ("open", "sqlite3.connect", "psycopg2.connect", "socket.socket", "socket.create_connection", "tempfile.TemporaryFile", "tempfile.NamedTemporaryFile", "urllib.request.urlopen")
#: Calls that take over what is passed to them.
_TAKES = ("closing", "enter_context", "push", "append", "set", "callback")
#: Calls that a helper's way to request state may take.
REACH = 4


def literal(text: Column) -> Column:
    """The characters of a string literal as it is written out again; NULL for other expressions."""
    return F.when(text.rlike(r"""^('.*'|".*")$"""), F.substring(text, F.lit(2), F.length(text) - 2))


def _arguments(found: DataFrame) -> DataFrame:
    """(repo, path, id, place, arg_kind, arg_name, arg_text, arg_literal): positional arguments of each call."""
    return found.filter("slot = 'args' AND kind <> 'arg'").select(
        *_KEYS, F.col("parent").alias("id"), "place", F.col("kind").alias("arg_kind"), F.col("name").alias("arg_name"), F.col("text").alias("arg_text"), literal(F.col("text")).alias("arg_literal")
    )


def _keywords(found: DataFrame) -> DataFrame:
    """(repo, path, id, keyword, value): keyword arguments of each call."""
    names = found.filter("kind = 'keyword'").select(*_KEYS, F.col("id").alias("at"), F.col("parent").alias("id"), F.col("name").alias("keyword"))
    return names.join(found.filter("slot = 'value'").select(*_KEYS, F.col("parent").alias("at"), F.col("text").alias("value")), [*_KEYS, "at"]).drop("at")


def _owners(found: DataFrame) -> DataFrame:
    """(repo, path, id, owner_kind, owner_name, owner_text): what an attribute or a subscript hangs on, or an assignment takes."""
    return found.filter("slot = 'value'").select(
        *_KEYS, F.col("parent").alias("id"), F.col("kind").alias("owner_kind"), F.col("name").alias("owner_name"), F.col("text").alias("owner_text"), F.col("label").alias("owner_label")
    )


def _top() -> Column:
    return F.get("callables", F.lit(0)).alias("function")


def held(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(told, watched, brought) of files, as ``resource_decisions`` and ``resource_violations`` take them."""
    return C.held(files, openers=OPENERS, members=OLD_MEMBERS, ambient=AMBIENT, holder=HOLDER)


def _some(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def _every(value: Column | str, test: Column) -> Column:
    return F.collect_set(F.when(test, F.col(value) if isinstance(value, str) else value))


def _all(lists: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists))))


def _in_functions(told: DataFrame) -> DataFrame:
    """The rows of ``told`` with what they call; ``function`` is the function on top that they are in, or are."""
    tops = F.when(F.col("kind").isin("FunctionDef", "AsyncFunctionDef"), F.col("id"))
    return told.select("*", *flow.called(), F.coalesce(F.get("callables", F.lit(0)), tops).alias("function"), literal(F.col("first.text")).alias("first_literal"))


def _config_keys(of: str) -> Column:
    """The literal keys that a row reads from a mapping whose text matches ``of``."""
    receives = F.col("receiver").rlike(of)
    read = (
        F.when(F.col("key").isNotNull() & F.col("owner.text").rlike(of), F.array(literal(F.col("key"))))
        .when((F.col("operation") == "get") & receives, F.array("first_literal"))
        .when((F.col("operation") == "from_mapping") & receives, F.col("keywords.keyword"))
    )
    return F.array_compact(read)


def resource_decisions(told: DataFrame, helpers: DataFrame) -> DataFrame:
    """What each direct resource helper of the old code has to keep.

    ``told`` is what ``held`` says of the old files, ``helpers`` (repo, path, symbol, dependency).  Added are the configuration
    keys that its module reads, the members of the request's state that it caches in, files opened relative to the package,
    the functions that close something, the set-up function, and whether connections may cross threads.
    """
    call = lambda operation: F.col("operation") == operation
    per_function = _in_functions(told).groupBy(*_KEYS, "function").agg(
        _all(_config_keys(r"(^|\.)config$")).alias("config_keys"),
        _every("name", (F.col("kind") == "Attribute") & (F.col("owner.kind") == "Name") & (F.col("owner.name") == HOLDER)).alias("cached"),
        _every("first_literal", call("open_resource") & F.col("receiver").isNotNull()).alias("opened"),
        _some(call("close") & F.col("receiver").isNotNull()).alias("closes"), _some(F.col("target") == "sqlite3.connect").alias("cross_thread"),
    )
    named = per_function.join(flow.functions(told).select(*_KEYS, "function", "name"), [*_KEYS, "function"], "left")
    per_file = named.groupBy(*_KEYS).agg(
        _all("config_keys").alias("config_keys"), F.collect_list(F.when(F.col("name").isNotNull() & (F.size("cached") > 0), F.struct("name", "cached"))).alias("caches"),
        _all("opened").alias("resource_files"), F.array_sort(_every("name", F.col("closes"))).alias("closers"),
        F.max(F.when(F.col("name") == INITIALIZER, F.col("name"))).alias("initializer"), F.bool_or("cross_thread").alias("cross_thread"),
    )
    joined = helpers.join(per_file, _KEYS, "left")
    none = F.array().cast("array<string>")
    cached = F.array_sort(F.flatten(F.transform(F.filter("caches", lambda c: c["name"] == F.col("symbol")), lambda c: c["cached"])))
    return joined.select(
        "repo", "path", "symbol", "dependency", F.coalesce("config_keys", none).alias("config_keys"), F.coalesce(cached, none).alias("cache_members"),
        F.coalesce("resource_files", none).alias("resource_files"), F.array_remove(F.coalesce("closers", none), F.col("symbol")).alias("cleanup_functions"),
        "initializer", F.coalesce("cross_thread", F.lit(False)).alias("cross_thread"),
    )


def _told(found: DataFrame, symbol: str, rule: str, detail: Column | str) -> DataFrame:
    detail = F.col(detail) if isinstance(detail, str) else detail
    return found.select("repo", "path", F.col(symbol).alias("symbol"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def _rows(found: DataFrame, symbol: str, rule: str, detail: Column | str) -> DataFrame:
    return _told(found, symbol, rule, detail).distinct()


def unreleased(found: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, symbol, rule, detail): resources opened in ``files`` that some way through their function does not close.

    What is returned, stored, entered with ``with`` or used by an inner function has left the function's care.  Where
    every ordinary way closes it, ways by an error are looked at.  The detail is the lines of one shortest way.
    """
    made = flow.calls(found)
    targets = found.filter("slot = 'targets' AND kind = 'Name'").select(*_KEYS, F.col("parent").alias("statement"), F.col("name").alias("variable"))
    opened = made.filter(F.col("target").isin(*OPENERS) & (F.col("slot") == "value") & F.col("function").isNotNull() & (F.col("parent") == F.col("statement")))
    opened = opened.select(*_KEYS, "function", "statement").join(files, _KEYS, "left_semi").join(targets, [*_KEYS, "statement"])
    opened = stored(opened.select(*_KEYS, "function", "statement", "variable"))
    inner = F.element_at("callables", -1)
    uses = found.filter("kind = 'Name' AND use = 'Load' AND size(callables) > 0").select(
        *_KEYS, F.col("name").alias("variable"), inner.alias("user"), "callables", F.col("statement").alias("node"), "parent", "slot"
    ).join(opened, [*_KEYS, "variable"]).filter(F.array_contains("callables", F.col("function")))
    parents = found.select(*_KEYS, F.col("id").alias("parent"), F.col("kind").alias("parent_kind"), F.col("label").alias("parent_label"))
    uses = stored(uses.join(parents, [*_KEYS, "parent"]))
    closes = made.filter("operation = 'close'").select(*_KEYS, F.col("statement").alias("node"), F.col("receiver").alias("variable"), F.col("function").alias("user"))
    takes = F.col("parent_label").rlike(rf"^Call:(.*\.)?({'|'.join(_TAKES)})$")
    leaves = (
        F.col("parent_kind").isin("Return", "withitem", "Assign", "AnnAssign", "Dict", "Tuple", "List", "Set") | (F.col("parent_kind") == "Call") & takes
        | (F.col("parent_kind") == "keyword")
    )
    captured = uses.filter("user <> function").select(*_KEYS, F.col("statement"), "variable").distinct()
    kept = opened.join(captured, [*_KEYS, "statement", "variable"], "left_anti")
    key = F.concat_ws(":", F.col("statement").cast("string"), "variable").alias("key")
    stops = uses.filter(leaves & (F.col("user") == F.col("function"))).select(*_KEYS, key, "node").unionByName(
        kept.join(closes, [*_KEYS, "variable"]).filter("user = function").select(*_KEYS, key, "node")
    )
    edges = stored(flow.flow_edges(found))
    starts = kept.select(*_KEYS, key, F.col("statement").alias("src"), F.array("statement").alias("trail"))
    ordinary = stored(flow.paths_avoiding(edges.filter("kind <> 'error'"), starts, stops).filter(F.col("dst") == flow.END).withColumn("rule", F.lit("resource_leaks")))
    left = starts.join(ordinary.select(*_KEYS, "key"), [*_KEYS, "key"], "left_anti")
    failing = flow.paths_avoiding(edges, left, stops).filter(F.col("dst") == flow.RAISED).withColumn("rule", F.lit("resource_leaks_on_error"))
    lines = found.filter("above IS NOT NULL").select(*_KEYS, F.col("id").alias("node"), "line")
    told = ordinary.unionByName(failing).select(*_KEYS, "key", "rule", F.posexplode("trail").alias("at", "node")).join(lines, [*_KEYS, "node"])
    told = told.groupBy(*_KEYS, "key", "rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"].cast("string")).alias("lines"))
    return told.select(*_KEYS, F.substring_index("key", ":", -1).alias("symbol"), "rule", F.array_join("lines", ">").alias("detail"))


def _own_rules(told: DataFrame, tops: DataFrame, own: DataFrame) -> DataFrame:
    """(repo, path, symbol, rule, detail) of the rules that ask what helpers, set-ups and clean-ups do themselves.

    The rows of a function are gathered once, for all rules; lists are those of one function.
    """
    call = lambda operation: F.col("operation") == operation
    receives, state = F.col("receiver").isNotNull(), r"\.state\.config$"
    assigns, by_name = F.col("kind").isin("Assign", "AnnAssign"), F.col("first.kind") == "Name"
    made_by = flow.dotted(F.col("owner.label"))
    passed = F.struct("receiver", F.col("first.name").alias("name"))
    rows = _in_functions(told)
    per_function = rows.filter("function IS NOT NULL").groupBy(*_KEYS, "function").agg(
        _some(call("connect") & receives).alias("connects"), _some(F.col("kind") == "If").alias("branches"),
        _every(passed, call("set") & by_name).alias("sets"), _all(F.when(made_by == "sqlite3.connect", F.col("assigned"))).alias("connections"),
        _all(_config_keys(state)).alias("copied"),
        _some(assigns & F.col("owner.text").rlike(r"\.state\.config(\.copy\(\))?$") | call("update") & F.col("first.text").rlike(state)).alias("copies_all"),
        _every("name", F.col("kind") == "arg").alias("parameters"), _every(passed, call("append") & by_name).alias("appends"),
        _every(F.struct(F.col("owner.name").alias("owner"), F.concat_ws(".", "owner.text", "name").alias("member")), (F.col("kind") == "Attribute") & F.col("name").isin(*OLD_MEMBERS)).alias("members"),
        _some(call("close") & receives).alias("closes"),
        _some(
            call("pop") | call("reset") & F.col("first").isNotNull() | call("set") & (F.col("first.text") == "None") | assigns & (F.col("owner.text") == "None") | (F.col("kind") == "Delete")
        ).alias("clears"),
    )
    variables = rows.filter((F.size("callables") == 0) & made_by.rlike(r"(^|\.)ContextVar$")).groupBy(*_KEYS).agg(_all("assigned").alias("variables"))

    # what decisions say of a name, by the part that it plays
    parts = F.explode(F.concat(
        F.array(F.struct(F.lit("helper").alias("part"), F.col("symbol").alias("name")), F.struct(F.lit("initializer").alias("part"), F.col("initializer").alias("name"))),
        F.transform("cleanup_functions", lambda c: F.struct(F.lit("cleanup").alias("part"), c.alias("name"))),
    ))
    lists = ("config_keys", "cache_members", "cleanup_functions")
    asked = own.select(*_KEYS, *lists, parts.alias("p")).select(*_KEYS, *lists, "p.*").filter("name IS NOT NULL").groupBy(*_KEYS, "part", "name").agg(*[_all(c).alias(c) for c in lists])
    joined = asked.join(tops.select(*_KEYS, "name", "function"), [*_KEYS, "name"], "left").join(per_function, [*_KEYS, "function"], "left").join(variables, _KEYS, "left")

    there, caches = F.col("function").isNotNull(), F.size("cache_members") > 0
    helper, setup, cleanup = (F.col("part") == p for p in ("helper", "initializer", "cleanup"))
    live = F.filter("sets", lambda x: F.array_contains(F.coalesce("variables", F.array().cast("array<string>")), x["receiver"]) & F.array_contains("connections", x["name"]))
    lacking = F.when(~F.col("copies_all"), F.array_except("config_keys", "copied"))
    invented = F.filter("appends", lambda x: F.array_contains("cleanup_functions", x["name"]) & F.exists("parameters", lambda p: F.startswith(x["receiver"], F.concat(p, F.lit(".state.")))))
    old = F.filter("members", lambda x: F.array_contains("parameters", x["owner"]))

    def when(test: Column, rule: str, details: Column | None = None) -> Column:
        details = F.array(F.lit("")) if details is None else details
        return F.when(test, F.transform(details, lambda d: F.struct(F.lit(rule).alias("rule"), d.alias("detail"))))

    rules = F.flatten(F.array_compact(F.array(
        when(helper & there & caches & F.col("connects") & ~F.col("branches"), "opens_on_every_call"),
        when(helper & there & caches, "live_connection_in_context", live["name"]),
        when(setup & ~there, "initializer_missing"),
        when(setup & there & (F.size(lacking) > 0), "config_not_copied", F.array(F.array_join(F.array_sort(lacking), ","))),
        when(setup & there, "invents_cleanup_storage", invented["name"]),
        when(setup & there, "old_application_member", old["member"]),
        when(cleanup & ~there, "cleanup_missing"),
        when(cleanup & there & ~F.col("closes"), "cleanup_keeps_open"),
        when(cleanup & there & caches & F.col("closes") & ~F.col("clears"), "cleanup_keeps_entry"),
    )))
    return joined.select(*_KEYS, F.col("name").alias("symbol"), F.explode(rules).alias("r")).select(*_KEYS, "symbol", "r.*")


def resource_violations(told: DataFrame, watched: DataFrame, brought: DataFrame, named: DataFrame, decisions: DataFrame) -> DataFrame:
    """(repo, path, symbol, rule, detail): what drafts get wrong about ``resource_decisions``.

    ``told``, ``watched`` and ``brought`` are what ``held`` says of the drafts.  Rules: a helper or what it calls reads request
    state (the detail is the chain of calls), opens anew on every call, or puts a live connection into a context variable;
    set-up is missing, leaves out configuration keys, invents a place for clean-up, or uses members of the old application;
    clean-up is missing, never closes, or keeps the entry; connections stay in one thread; package files are opened from the
    working directory or decoded as text; the dependency is called by hand; and resources are not released on every path.
    """
    named = stored(named)
    tops = stored(flow.functions(told))
    made = flow.calls(told, "first", "second", "keywords", "entered", "around")
    parsed = told.filter("kind = 'Module'").select(*_KEYS)
    decisions = stored(decisions)
    own = stored(decisions.join(parsed, _KEYS, "left_semi"))
    out = [_own_rules(told, tops, own)]

    # request state within reach of a helper
    ambient = told.filter("kind = 'Name'").select(*_KEYS, F.col("name").alias("read"), _top())
    readers = ambient.join(tops.select(*_KEYS, "function", "name"), [*_KEYS, "function"]).select(*_KEYS, "name", "read").distinct()
    helper = own.select(*_KEYS, F.col("symbol").alias("name")).join(tops.select(*_KEYS, "name"), [*_KEYS, "name"], "left_semi")
    reached = flow.reaching(flow.call_graph(told, named, brought), helper, REACH)
    reads = reached.join(readers, ["repo", "path", "name"]).select(
        "repo", F.col("start_path").alias("path"), F.col("start").alias("symbol"), F.concat(F.array_join("way", " > "), F.lit(" reads "), "read").alias("detail")
    )
    out.append(_told(reads, "symbol", "reads_request_state", "detail"))

    # connections and files
    across = own.filter("cross_thread").select(*_KEYS)
    given = lambda test: F.coalesce(F.exists("keywords", test), F.lit(False))
    shared = given(lambda k: (k["keyword"] == "check_same_thread") & (k["value"] == "False"))
    out.append(_told(made.filter((F.col("target") == "sqlite3.connect") & ~shared).join(across, _KEYS, "left_semi"), "operation", "connection_of_one_thread", "line"))
    binary = F.coalesce(F.contains(literal(F.col("second")), F.lit("b")), F.lit(False)) | given(lambda k: (k["keyword"] == "mode") & F.contains(k["value"], F.lit("b")))
    entered = made.filter("target = 'open' AND entered IS NOT NULL").select(
        *_KEYS, "line", F.col("entered.id").alias("entered"), F.col("entered.variable").alias("variable"), literal(F.col("first.text")).alias("file"), binary.alias("binary")
    ).join(own.select(*_KEYS, "resource_files"), _KEYS)
    out.append(_told(entered.filter(F.exists("resource_files", lambda f: F.endswith("file", f))), "variable", "resource_from_working_directory", "file"))
    decoded = made.filter("operation = 'decode'").select(*_KEYS, F.regexp_extract("target", r"^(\w+)\.read\(.*\)\.decode$", 1).alias("variable"), F.explode("around").alias("entered"))
    out.append(_told(entered.filter("NOT binary").join(decoded, [*_KEYS, "entered", "variable"], "left_semi"), "variable", "decodes_text", "line"))

    # the dependency is for the framework to call
    asked = decisions.filter("dependency IS NOT NULL").select("repo", F.col("path").alias("owner"), "dependency")
    owner_names = asked.join(named.withColumnRenamed("path", "owner"), ["repo", "owner"])
    by_name = brought.filter("is_from").withColumnRenamed("name", "dependency").join(owner_names, ["repo", "module_name", "dependency"]).select("repo", "path", "owner", "dependency", F.col("local").alias("target"))
    dotted_name = F.when(F.col("is_from"), F.concat_ws(".", "module_name", "name")).otherwise(F.col("name"))
    by_module = brought.select("repo", "path", dotted_name.alias("module_name"), "local").join(owner_names, ["repo", "module_name"]).select(
        "repo", "path", "owner", "dependency", F.concat_ws(".", "local", "dependency").alias("target")
    )
    called = made.join(by_name.unionByName(by_module).filter("path <> owner"), ["repo", "path", "target"])
    out.append(_told(called, "dependency", "dependency_called", "line"))

    resources = unreleased(watched, own.select(*_KEYS))
    return reduce(DataFrame.unionByName, out).distinct().unionByName(resources)


# Where the session middleware comes from, and what writes cookies.
SESSION_MODULE, SESSION_CLASS = "starlette.middleware.sessions", "SessionMiddleware"
_COOKIES = ("set_cookie", "delete_cookie")


SESSION_COLUMNS = ("id", "parent", "slot", "place", "kind", "label", "name", "line", "within", "callables", "text", "statement")


def session_violations(found: DataFrame, brought: DataFrame, named: DataFrame, surfaces: DataFrame, owners_of_context: DataFrame) -> DataFrame:
    """(repo, path, symbol, rule, detail): what drafts get wrong about sessions and ambient request state.

    ``surfaces`` is (repo, surface, role, path) with the surfaces ``session`` and ``ambient`` and the roles ``provider``,
    ``factory``, ``test_provider`` and ``cookie_writer``; ``owners_of_context`` (repo, path, symbol), the classes that own
    the request state.  Functions are followed over files for at most ``REACH`` calls: a provider whose callees use the
    session uses it, and a factory must not get to it before there is a request (the detail is the chain of calls).
    Of ``found`` the columns ``SESSION_COLUMNS`` of nodes that ``syntax.installs`` keeps are enough, with the text of
    arguments.  ``found`` and ``brought`` are read many times, so they should be ``stored``.
    """
    named, surfaces = stored(named), stored(surfaces)
    tops, made = stored(flow.functions(found)), stored(flow.calls(found))
    first = stored(_arguments(found).filter("place = 0"))
    parsed = found.filter("kind = 'Module'").select(*_KEYS)

    def files(surface: str, role: str) -> DataFrame:
        return surfaces.filter((F.col("surface") == surface) & (F.col("role") == role)).select(*_KEYS).distinct().join(parsed, _KEYS, "left_semi")

    out = []
    # the session middleware by any name it goes by
    by_name = brought.filter((F.col("module_name") == SESSION_MODULE) & F.col("is_from") & (F.col("name") == SESSION_CLASS)).select(*_KEYS, F.col("local").alias("ref"))
    by_module = brought.filter((F.col("module_name") == SESSION_MODULE) & ~F.col("is_from")).select(*_KEYS, F.concat("local", F.lit(f".{SESSION_CLASS}")).alias("ref"))
    session_refs = stored(by_name.unionByName(by_module).distinct())
    anywhere = surfaces.filter("surface = 'session'").select("repo").distinct()
    called = made.withColumn("ref", F.col("target")).join(session_refs, [*_KEYS, "ref"]).join(anywhere, "repo", "left_semi")
    out.append(_rows(called, "target", "session_middleware_called", F.lit("")))

    installs = made.filter((F.col("operation") == "add_middleware") | (F.col("operation") == "Middleware")).join(
        first.filter("arg_kind IN ('Name', 'Attribute')").withColumn("ref", F.col("arg_text")), [*_KEYS, "id"]
    ).select(*_KEYS, "id", "parent", "line", "operation", "ref")
    installs = stored(installs)
    sessions = installs.join(session_refs, [*_KEYS, "ref"], "left_semi")
    none = F.lit(None).cast("string").alias("symbol")
    lacking = files("session", "factory").join(sessions.select(*_KEYS), _KEYS, "left_anti")
    out.append(_rows(lacking.select(*_KEYS, none), "symbol", "session_middleware_not_installed", F.lit("")))

    uses = found.filter("kind = 'Attribute' AND name = 'session'").select(*_KEYS, _top())
    users = stored(uses.join(tops.select(*_KEYS, "function", "name"), [*_KEYS, "function"]).select(*_KEYS, "name").distinct())
    factories = surfaces.filter("role = 'factory'").select(*_KEYS).distinct()
    providers = files("session", "provider")
    starts = tops.select(*_KEYS, "name").join(factories.unionByName(providers).distinct(), _KEYS, "left_semi")
    reached = stored(flow.reaching(flow.call_graph(found, named, brought), starts, REACH).join(users, ["repo", "path", "name"]))
    through = reached.select("repo", F.col("start_path").alias("path"), F.col("start").alias("symbol"), F.array_join("way", " > ").alias("detail"))
    out.append(_rows(through.join(factories, _KEYS, "left_semi"), "symbol", "session_outside_request", "detail"))
    without = providers.join(uses.select(*_KEYS), _KEYS, "left_anti").join(through.select(*_KEYS), _KEYS, "left_anti")
    out.append(_rows(without.select(*_KEYS, none), "symbol", "no_request_session", F.lit("")))
    writers = surfaces.filter("role = 'cookie_writer'").select(*_KEYS).distinct()
    cookies = made.filter(F.col("operation").isin(*_COOKIES) & F.col("receiver").isNotNull()).join(providers, _KEYS, "left_semi").join(writers, _KEYS, "left_anti")
    out.append(_rows(cookies, "operation", "writes_cookies", F.lit("")))

    # ambient state
    ambient, tested = files("ambient", "provider"), files("ambient", "test_provider").join(files("ambient", "provider"), _KEYS, "left_anti")
    variables = made.filter("operation = 'ContextVar'").select(*_KEYS).distinct()
    out.append(_rows(made.filter("operation = 'add_middleware' AND receiver IS NOT NULL").join(ambient, _KEYS, "left_semi"), "operation", "provider_installs_middleware", "receiver"))
    out.append(_rows(ambient.join(variables, _KEYS, "left_anti").select(*_KEYS, none), "symbol", "no_context_variable", F.lit("")))
    classes = found.filter("kind = 'ClassDef' AND within = 'Module.body'").select(*_KEYS, "id", F.col("name").alias("symbol")).join(owners_of_context, [*_KEYS, "symbol"])
    handlers = found.filter("kind IN ('FunctionDef', 'AsyncFunctionDef') AND name IN ('dispatch', '__call__')").select(*_KEYS, F.col("parent").alias("id"))
    out.append(_rows(classes.join(ambient, _KEYS, "left_semi").join(handlers, [*_KEYS, "id"], "left_anti"), "symbol", "context_class_without_dispatch", F.lit("")))
    provider_names = surfaces.filter("surface = 'ambient' AND role = 'provider'").select("repo", F.col("path").alias("owner")).distinct().join(named.withColumnRenamed("path", "owner"), ["repo", "owner"])
    from_provider = stored(brought.filter("is_from").join(provider_names, ["repo", "module_name"]).filter("path <> owner").select(*_KEYS, "owner", "name", "local").distinct())
    parallel = tested.join(from_provider.select(*_KEYS), _KEYS, "left_anti").unionByName(tested.join(variables, _KEYS, "left_semi")).distinct()
    out.append(_rows(parallel.select(*_KEYS, none), "symbol", "parallel_context", F.lit("")))

    # factories: the owner of the state inside of the session
    owned = owners_of_context.select("repo", F.col("path").alias("owner"), F.col("symbol").alias("name"))
    context_refs = stored(from_provider.join(owned, ["repo", "owner", "name"]).select(*_KEYS, F.col("local").alias("ref"), "name").distinct())
    contexts = installs.join(context_refs, [*_KEYS, "ref"])
    ambient_factories = files("ambient", "factory").join(context_refs.select(*_KEYS), _KEYS, "left_semi")
    missing = ambient_factories.join(contexts.select(*_KEYS), _KEYS, "left_anti")
    out.append(_rows(missing.join(context_refs, _KEYS), "name", "context_not_installed", F.lit("")))
    added = lambda rows, name, pick: rows.filter("operation = 'add_middleware'").groupBy(*_KEYS).agg(pick("line").alias(name))
    wrong_calls = added(contexts, "context", F.max).join(added(sessions, "session", F.min), _KEYS).filter("context >= session").select(*_KEYS)
    listed = lambda rows, name, pick: rows.filter("operation = 'Middleware'").groupBy(*_KEYS, "parent").agg(pick("id").alias(name))
    wrong_lists = listed(sessions, "session", F.max).join(listed(contexts, "context", F.min), [*_KEYS, "parent"]).filter("session >= context").select(*_KEYS)
    wrong = wrong_calls.unionByName(wrong_lists).distinct().join(files("ambient", "factory"), _KEYS, "left_semi")
    out.append(_rows(wrong.select(*_KEYS, none), "symbol", "context_outside_session", F.lit("")))
    spans = _keywords(found).filter("keyword = 'lifespan'").withColumn("ref", F.regexp_extract("value", r"^(\w+)\.\w+$", 1)).join(context_refs, [*_KEYS, "ref"]).join(files("ambient", "factory"), _KEYS, "left_semi")
    out.append(_rows(spans, "name", "context_as_lifespan", "value"))
    return reduce(DataFrame.unionByName, out)
