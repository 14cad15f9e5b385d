"""Control flow inside functions and calls between them, as edge tables over the node table.

``found`` is the node table of ``code_facts.nodes``.  A flow edge leads from a statement to one that may run next; -1 is
the end of the function, -2 the end by an error.  What follows a statement is the first of what the statements around it
offer, and what holds on every path is what no path avoids; both are looked up file by file (``functions.control``).  Calls
between files are joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import control as X
from ..session import stored

END, RAISED = X.END, X.RAISED
_KEYS = ["repo", "path"]


def statements(found: DataFrame) -> DataFrame:
    """(repo, path, function, id, parent, slot, place, kind, line, above, raises) of the statements of every function.

    ``function`` is the id of the innermost function, ``raises`` whether a statement's own expressions hold a call, an
    ``await`` or a ``yield``, so that it may end by an error.
    """
    risky = found.filter(_may_raise()).select(*_KEYS, F.col("statement").alias("id"), F.lit(True).alias("raises")).distinct()
    rows = found.filter(_stands()).select(*_KEYS, F.element_at("callables", -1).alias("function"), "id", "parent", "slot", "place", "kind", "line", "above")
    return rows.join(risky, [*_KEYS, "id"], "left").withColumn("raises", F.coalesce("raises", F.lit(False)))


def _stands() -> Column:
    return F.col("above").isNotNull() & (F.size("above") > 0) & (F.size("callables") > 0)


def _may_raise() -> Column:
    return F.col("kind").isin("Call", "Await", "Yield", "YieldFrom") & F.col("statement").isNotNull()


def _by_file(gathered: DataFrame, follow: Callable[..., Iterable[tuple]], columns: str) -> DataFrame:
    """(repo, path, ``columns``): the rows that ``follow`` makes of the lists of each file."""
    schema = StructType.fromDDL(f"repo string, path string, {columns}")
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, *lists in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.extend([(repo, path, *row) for row in follow(*lists)])
            cut = zip(*rows, strict=True) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cut, arrow, strict=True)], schema=arrow)

    return gathered.mapInArrow(read, schema)


def _said(rows: str) -> Column:
    """A list of structs as JSON, which Python reads far faster than Arrow's structs."""
    return F.to_json(rows, {"ignoreNullFields": "false"}).alias(rows)


def _listed(rows: str | None) -> list[tuple]:
    return [tuple(r.values()) for r in json.loads(rows)] if rows else []


def _edges(rows: str, risky: list[int], forever: list[int]) -> Iterable[tuple]:
    return X.edges([(*r, [tuple(a.values()) for a in above]) for *r, above in _listed(rows)], set(risky), set(forever))


def flow_edges(found: DataFrame) -> DataFrame:
    """(repo, path, function, src, dst, kind): where control may go; kind is ``normal``, ``caught`` or ``error``.

    Errors are those that calls raise, and ``raise``; inside a ``try`` they lead to its handlers (``caught``), else to its ``finally``.
    A jump out of a ``try`` with a ``finally`` goes through it; what comes after that may be either way out.  The statements
    of a file are gathered and followed together.
    """
    statement = F.struct(F.try_element_at("callables", F.lit(-1)).alias("function"), "id", "parent", "slot", "place", "kind", "above")
    forever = F.expr("slot = 'test' AND kind = 'Constant' AND text IN ('True', '1')")
    gathered = found.filter(_stands() | _may_raise() | forever).groupBy(*_KEYS).agg(
        F.collect_list(F.when(_stands(), statement)).alias("rows"), F.collect_set(F.when(_may_raise(), F.col("statement"))).alias("risky"), F.collect_set(F.when(forever, F.col("parent"))).alias("forever")
    )
    return _by_file(gathered.filter("size(rows) > 0").select(*_KEYS, _said("rows"), "risky", "forever"), _edges, "function int, src int, dst int, kind string")


def _ways(steps: str, starts: str, stops: str | None) -> Iterable[tuple]:
    return X.ways(_listed(steps), _listed(starts), _listed(stops))


def paths_avoiding(edges: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """(repo, path, key, dst, trail): ends of functions that are reached from ``starts`` without passing ``stops``.

    ``starts`` is (repo, path, key, src, trail), ``stops`` (repo, path, key, node); the trail is the list of statements on
    one shortest way.  A key without a row meets a stop on every path.  The start itself is taken to have worked, so its
    own errors are no way on.  A statement is entered once for a key.  The edges of files with a start are gathered, and
    followed file by file.
    """
    begun = starts.groupBy(*_KEYS).agg(F.collect_set(F.struct("key", "src", "trail")).alias("starts"))
    steps = edges.join(begun.select(*_KEYS), _KEYS, "left_semi").groupBy(*_KEYS).agg(F.collect_set(F.struct("src", "dst", "kind")).alias("steps"))
    kept = stops.groupBy(*_KEYS).agg(F.collect_set(F.struct("key", "node")).alias("stops"))
    gathered = begun.join(steps, _KEYS).join(kept, _KEYS, "left").select(*_KEYS, _said("steps"), _said("starts"), _said("stops"))
    return _by_file(gathered, _ways, "key string, dst int, trail array<int>")


def dotted(label: Column) -> Column:
    """What a call calls, as written; NULL for other nodes."""
    return F.when(label.startswith("Call:"), F.substring(label, 6, 1 << 20))


def called() -> list[Column]:
    """``target``, ``operation`` and ``receiver`` of a call, NULL for other nodes; the operation is the last part of the target."""
    target = dotted(F.col("label"))
    return [
        target.alias("target"), F.substring_index(target, ".", -1).alias("operation"),
        F.when(target.contains("."), F.regexp_replace(target, r"\.[^.]*$", "")).alias("receiver"),
    ]


def calls(found: DataFrame, *more: str) -> DataFrame:
    """(repo, path, id, parent, slot, line, statement, function, top, target, operation, receiver) and ``more`` columns.

    ``function`` is the innermost function's id, ``top`` the outermost one's.
    """
    return found.filter("kind = 'Call'").select(
        *_KEYS, "id", "parent", "slot", "line", "statement", F.try_element_at("callables", F.lit(-1)).alias("function"), F.get("callables", F.lit(0)).alias("top"),
        *called(), *more,
    )


def functions(found: DataFrame) -> DataFrame:
    """(repo, path, function, name, line) of the functions on the top level of each file; the last of a name counts."""
    tops = found.filter(F.col("kind").isin("FunctionDef", "AsyncFunctionDef") & (F.col("within") == "Module.body"))
    return tops.groupBy(*_KEYS, "name").agg(F.max(F.struct(F.col("id").alias("function"), "line")).alias("f")).select(*_KEYS, "f.function", "name", "f.line")


def call_graph(found: DataFrame, named: DataFrame, brought: DataFrame) -> DataFrame:
    """(repo, caller_path, caller, path, name): which top-level function calls which, across files.

    ``named`` is (repo, path, module_name), the names files go by; ``brought`` (repo, path, module_name, name, local,
    is_from), the imports with the module each resolves to.  A called name means the file's own function, one imported by
    name, or a function of an imported module.
    """
    tops = functions(found).select(*_KEYS, "function", "name")
    made = calls(found).filter("top IS NOT NULL AND target IS NOT NULL").join(
        tops.select(*_KEYS, F.col("function").alias("top"), F.col("name").alias("caller")), [*_KEYS, "top"]
    ).select("repo", F.col("path").alias("caller_path"), "caller", "target").distinct()
    own = tops.select("repo", F.col("path").alias("caller_path"), F.col("path"), "name", F.col("name").alias("target"))
    by_name = brought.filter("is_from").join(named.withColumnRenamed("path", "owner"), ["repo", "module_name"]).join(
        tops.select("repo", F.col("path").alias("owner"), "name"), ["repo", "owner", "name"]
    ).select("repo", F.col("path").alias("caller_path"), F.col("owner").alias("path"), "name", F.col("local").alias("target"))
    dotted_name = F.when(F.col("is_from"), F.concat_ws(".", "module_name", "name")).otherwise(F.col("name"))
    by_module = brought.select("repo", F.col("path").alias("caller_path"), dotted_name.alias("module_name"), "local").join(named, ["repo", "module_name"]).join(
        tops.select(*_KEYS, "name"), _KEYS
    ).select("repo", "caller_path", "path", "name", F.concat_ws(".", "local", "name").alias("target"))
    means = own.unionByName(by_name).unionByName(by_module).distinct()
    return made.join(means, ["repo", "caller_path", "target"]).select("repo", "caller_path", "caller", "path", "name").distinct()


def reaching(graph: DataFrame, starts: DataFrame, reach: int) -> DataFrame:
    """(repo, start_path, start, path, name, way): functions that a start reaches by at most ``reach`` calls.

    ``starts`` is (repo, path, name).  ``way`` names the functions of one shortest chain of calls, the start first.
    """
    calls_of = stored(graph)
    place = F.concat_ws("::", "path", "name")
    frontier = stored(starts.select("repo", F.col("path").alias("start_path"), F.col("name").alias("start"), "path", "name", F.array(place).alias("way")).distinct())
    known = frontier
    for _ in range(reach):
        step = frontier.withColumnsRenamed({"path": "caller_path", "name": "caller"}).join(calls_of, ["repo", "caller_path", "caller"])
        grown = step.groupBy("repo", "start_path", "start", "path", "name").agg(F.min("way").alias("way")).withColumn("way", F.array_append("way", place))
        frontier = stored(grown.join(known, ["repo", "start_path", "start", "path", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier.select(*known.columns))
    return known
