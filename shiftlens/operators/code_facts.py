"""Syntax facts of source files as tables, and the import relations between files.

``files`` is (repo, path, text).  Files that do not parse yield no facts; ``parse_status`` names
them.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import paths as P
from ..functions import syntax as X


#: The same short text stands in many places (empty packages, licence headers, copies); the facts of the last few are kept.
SHORT_TEXT, SHORT_TEXTS = 2000, 64


def read_facts(batches: Iterator[pa.RecordBatch], read: Callable, arrow: pa.Schema, at_once: int) -> Iterator[pa.RecordBatch]:
    wanted = arrow.names[3:]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def facts_of(text: str) -> list[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        return [tuple([row[w] for w in wanted]) for row in read(tree, text)]

    facts_of_short = lru_cache(SHORT_TEXTS)(facts_of)
    for batch in batches:
        rows = []
        for repo, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = facts_of_short(text) if len(text) <= SHORT_TEXT else facts_of(text)
            rows.extend((repo, path, i, *row) for i, row in enumerate(found))
            if len(rows) >= at_once:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)


#: Facts that a task's Python holds at a time, besides those of one file.
FACTS_AT_ONCE = 5000


class Sources:
    """Files with the facts that ``read_once`` took from them; for the rest it is the table of files.

    A reader that asks for one of these facts gets its table instead of parsing.  Filters hold for files and facts; one
    that looks at texts leaves no facts to ask for.
    """

    def __init__(self, files: DataFrame, found: dict[str, DataFrame], kept: tuple = ()) -> None:
        self.files, self.found, self.kept = files, found, kept

    def filter(self, condition: Column | str) -> Sources:
        return Sources(self.files.filter(condition), self.found, (*self.kept, condition))

    def facts(self, name: str) -> DataFrame:
        return reduce(DataFrame.filter, self.kept, self.found[name])

    def __getattr__(self, name: str) -> Any:
        return getattr(self.files, name)


_READERS = {"imports": (X.imports, X.IMPORTS), "calls": (X.calls, X.CALLS), "references": (X.references, X.REFERENCES), "bound_names": (X.bound_names, X.BOUND_NAMES), "web_facts": (X.web_facts, X.WEB_FACTS)}
_NODES = {
    "defines": "id int, parent int, slot string, place int, kind string, name string, alias string, line int, within string, callables array<int>, text string",
    "scopes": "id int, kind string, name string, alias string, use string, names array<string>, within string, sees array<int>",
}


def _asked(tree: ast.AST, source: str, names: tuple[str, ...]) -> Iterator[tuple[str, dict]]:
    keeps = [(n, getattr(X, n)) for n in names if n in _NODES]
    if keeps:
        keep = lambda *node: any(k(*node) for _, k in keeps)
        for row in X.nodes(tree, source, with_text=X.defines if "defines" in names else False, keep=keep):
            yield from ((n, row) for n, k in keeps if k(row["kind"], row["slot"], row["within"]))
    for name in names:
        if name in _READERS:
            yield from ((name, row) for row in _READERS[name][0](tree, source))


def read_once(files: DataFrame, *names: str) -> Sources:
    """``files`` with the facts of these names: those of ``_READERS``, the nodes that ``defines`` or ``scopes``, and ``status``."""
    columns = {n: STATUS_COLUMNS if n == STATUS else _NODES.get(n) or _READERS[n][1] for n in names}
    return Sources(files, facts_apart(files, partial(_asked, names=names), columns))


def facts(files: DataFrame | Sources, read: Callable, columns: str, at_once: int = FACTS_AT_ONCE) -> DataFrame:
    """Apply one fact reader to every file; each row also carries its place in the file.

    Facts leave in batches of about ``at_once``, however many files come in one batch.
    """
    if isinstance(files, Sources):
        return files.facts(read.__name__)
    schema = StructType.fromDDL(f"repo string, path string, seq int, {columns}")
    arrow = to_arrow_schema(schema)
    return files.select("repo", "path", "text").mapInArrow(lambda batches: read_facts(batches, read, arrow, at_once), schema)


def read_apart(batches: Iterator[pa.RecordBatch], read: Callable, arrow: pa.Schema, wanted: dict[str, list[str]], at_once: int) -> Iterator[pa.RecordBatch]:
    """As ``read_facts`` for a reader that says of every row which fact it is; a batch holds rows of one fact."""

    def batch_of(fact: str, rows: list[tuple]) -> pa.RecordBatch:
        own = dict(zip(("repo", "path", "seq", *wanted[fact]), zip(*rows, strict=True), strict=True)) | {TABLE_OF: [fact] * len(rows)}
        return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(rows), f.type) for f in arrow], schema=arrow)

    def facts_of(text: str) -> list[tuple[str, list[tuple]]]:
        found, status = {fact: [] for fact in wanted}, {"parses": True, "line": None}
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError) as error:
            status = {"parses": False, "line": error.lineno if isinstance(error, SyntaxError) else None}
        else:
            for fact, row in read(tree, text):
                found[fact].append(tuple([row[w] for w in wanted[fact]]))
        if STATUS in wanted:
            found[STATUS].append(tuple([status[w] for w in wanted[STATUS]]))
        return [(fact, rows) for fact, rows in found.items() if rows]

    facts_of_short = lru_cache(SHORT_TEXTS)(facts_of)
    for batch in batches:
        held, n = {fact: [] for fact in wanted}, 0
        for repo, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for fact, rows in facts_of_short(text) if len(text) <= SHORT_TEXT else facts_of(text):
                held[fact].extend([(repo, path, i, *row) for i, row in enumerate(rows)])
                n += len(rows)
            if n >= at_once:
                yield from (batch_of(fact, rows) for fact, rows in held.items() if rows)
                held, n = {fact: [] for fact in wanted}, 0
        yield from (batch_of(fact, rows) for fact, rows in held.items() if rows)


#: The fact that every file has, one that does not parse too.
STATUS, STATUS_COLUMNS = "status", "parses boolean, line int"
#: The column that says which fact a row is of.
TABLE_OF = "table_of"


def facts_apart(files: DataFrame, read: Callable, columns: dict[str, str], at_once: int = FACTS_AT_ONCE) -> dict[str, DataFrame]:
    """A stored table for every fact that ``read`` tells of, for which every file is parsed once; a column has one type in all of them."""
    from ..session import stored

    own = {fact: StructType.fromDDL(ddl) for fact, ddl in columns.items()}
    every = {f.name: f.dataType.simpleString() for fields in own.values() for f in fields}
    schema = StructType.fromDDL(f"repo string, path string, seq int, {', '.join(f'{name} {kind}' for name, kind in every.items())}, {TABLE_OF} string")
    arrow, wanted = to_arrow_schema(schema), {fact: fields.names for fact, fields in own.items()}
    found = stored(files.select("repo", "path", "text").mapInArrow(lambda batches: read_apart(batches, read, arrow, wanted, at_once), schema), TABLE_OF)
    return {fact: found.filter(F.col(TABLE_OF) == fact).select("repo", "path", "seq", *names) for fact, names in wanted.items()}


def _held(tree: ast.AST, source: str, read: Callable) -> Iterator[tuple[str, dict]]:
    yield from read(tree, source)
    yield from (("imports", row) for row in X.imports(tree, source))


def held(files: DataFrame, **names: str | tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What files tell on resources, the nodes to follow them by (``syntax.held``), and ``imported_names``: every file is parsed once for all."""
    found = facts_apart(files, partial(_held, read=partial(X.held, **names)), X.HELD | {"imports": X.IMPORTS})
    return found["told"].drop("seq"), found["watched"].drop("seq"), _names_imported(_resolved(found["imports"]))


def _resolved(found: DataFrame) -> DataFrame:
    return found.withColumn("resolved", P.resolve_module(F.col("module"), F.col("level"), F.col("path")))


def imports(files: DataFrame) -> DataFrame:
    """Imported names with the module each statement resolves to."""
    return _resolved(facts(files, X.imports, X.IMPORTS))


def _nodes_and_imports(tree: ast.AST, source: str, read: Callable, columns: tuple[str, ...]) -> Iterator[dict]:
    yield from ({**_NO_IMPORT, **row} for row in read(tree, source))
    yield from ({**dict.fromkeys(columns), **row, "is_import": True} for row in X.imports(tree, source))


_IMPORTED = "is_import boolean, is_from boolean, module string, level int, local string"
_NO_IMPORT = {"is_import": False, "is_from": None, "module": None, "level": None, "local": None}


def nodes_and_imports(files: DataFrame, *columns: str, keep: Callable, said: Callable) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``columns``, those to ``keep`` with the text of those to be ``said``, and ``imported_names``: every file is parsed once for both."""
    from ..session import stored

    wanted = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(X.NODES) if f.name in columns)
    read = partial(_nodes_and_imports, read=partial(X.nodes, with_text=said, keep=keep), columns=columns)
    found = stored(facts(files, read, f"{wanted}, {_IMPORTED}").drop("seq"))
    return found.filter("NOT is_import").select("repo", "path", *columns), _names_imported(_resolved(found.filter("is_import")))


def nodes(files: DataFrame, *columns: str, keep: Callable | None = None) -> DataFrame:
    """Every node of every file that parses, or those to ``keep``, with ``columns`` or all; the rules below are joins and aggregates over it."""
    if isinstance(files, Sources):
        return files.facts(keep.__name__).select("repo", "path", *columns)
    found = StructType.fromDDL(X.NODES)
    wanted = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found if not columns or f.name in columns)
    read = partial(X.nodes, with_text=not columns or "text" in columns, keep=keep)
    return facts(files, read, wanted).drop("seq")


def _is_function() -> Column:
    return F.col("kind").isin("FunctionDef", "AsyncFunctionDef")


_ON_IMPORT = r"^Module\.body(/(If(:[\w.]+)?\.(body|orelse)|Try\.(body|orelse|finalbody|handlers)|ExceptHandler\.body))*$"
_TYPES_ONLY = r"If:([\w.]+\.)?TYPE_CHECKING\.body"
#: from a function's body through statements alone, past no other definition
_RETURNED = r"(FunctionDef|AsyncFunctionDef)\.body(/(If(:[\w.]+)?|For|AsyncFor|While|With|AsyncWith|Try|TryStar)\.(body|orelse|finalbody))*/Return\.value$"


def _gathered(column: str, test: Column) -> Column:
    """The values of ``column`` where ``test`` holds, in source order."""
    return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("id", F.col(column).alias("v"))))), lambda x: x["v"])


def _by_function(found: DataFrame) -> DataFrame:
    """(repo, path, about, ...): what belongs to each function.

    An argument belongs to the function whose list it is in, a yield to the nearest function or lambda, a returned name
    to the function that its statement ends, an inner function to the one whose body it stands in.
    """
    nearest = F.element_at("callables", -1)
    about = (
        F.when(F.col("within").rlike(r"FunctionDef\.args/arguments\.\w+$"), nearest)
        .when(F.col("kind").isin("Yield", "YieldFrom"), nearest)
        .when((F.col("kind") == "Name") & F.col("within").rlike(_RETURNED), nearest)
        .when(_is_function() & F.col("within").rlike(r"FunctionDef\.body$"), nearest)
    )
    rows = found.filter(F.size("callables") > 0).withColumn("about", about).filter("about IS NOT NULL")
    slot = F.col("slot")
    positional = slot.isin("posonlyargs", "args") & (F.col("kind") == "arg")
    keyword = (slot == "kwonlyargs")
    gathered = rows.groupBy("repo", "path", "about").agg(
        _gathered("name", positional).alias("positional"), F.count(F.when(slot == "defaults", 1)).alias("defaults"),
        _gathered("name", (slot == "args") & (F.col("kind") == "arg")).alias("by_name"), _gathered("name", keyword).alias("keyword_only"),
        _gathered("place", keyword).alias("keyword_places"), F.collect_set(F.when(slot == "kw_defaults", F.col("place"))).alias("given"),
        F.count(F.when(slot == "vararg", 1)).alias("varargs"), F.count(F.when(slot == "kwarg", 1)).alias("varkw"),
        F.count(F.when(F.col("kind").isin("Yield", "YieldFrom"), 1)).alias("yields"),
        F.collect_set(F.when(F.col("kind") == "Name", F.col("name"))).alias("returned"), F.collect_set(F.when(_is_function(), F.col("name"))).alias("inner"),
    )
    required = F.size("positional") - F.col("defaults").cast("int")
    needed = F.filter(F.arrays_zip("keyword_only", "keyword_places"), lambda x: ~F.array_contains("given", x["keyword_places"]))
    return gathered.select(
        "repo", "path", "about", "positional", "keyword_only",
        F.struct(
            required.alias("required_positional"), F.slice("positional", F.lit(1), F.greatest(required, F.lit(0))).alias("required_positional_names"),
            F.transform(needed, lambda x: x["keyword_only"]).alias("required_keyword_only"), F.size("positional").alias("positional_capacity"),
            F.concat("by_name", "keyword_only").alias("keyword_names"), (F.col("varargs") > 0).alias("accepts_varargs"), (F.col("varkw") > 0).alias("accepts_varkw"),
            F.lit(False).alias("is_async"), (F.col("yields") > 0).alias("is_generator"), F.arrays_overlap("returned", "inner").alias("returns_nested_function"),
        ).alias("shape"),
    )


def _statements(found: DataFrame) -> DataFrame:
    """(repo, path, about, statement facts): functions, classes and bindings that run on import, with what hangs on them."""
    on_import = F.col("within").rlike(_ON_IMPORT) & ~F.col("within").rlike(_TYPES_ONLY)
    made = F.col("kind").isin("FunctionDef", "AsyncFunctionDef", "ClassDef", "Assign", "AnnAssign", "Import", "ImportFrom") & on_import
    owner = F.regexp_replace("within", r"/[^/]*$", "")
    hangs = owner.rlike(_ON_IMPORT) & ~owner.rlike(_TYPES_ONLY) & F.col("slot").isin("decorator_list", "args", "value", "targets", "target", "names")
    rows = found.filter(made | hangs).withColumn("about", F.when(made, F.col("id")).otherwise(F.col("parent")))
    first = lambda column, test: F.min_by(F.when(test, F.col(column)), F.when(test, F.col("id")))
    slot = F.col("slot")
    own = F.col("about") == F.col("id")
    return rows.groupBy("repo", "path", "about").agg(
        F.max(F.when(own, F.col("kind"))).alias("made"), F.max(F.when(own, F.col("name"))).alias("own_name"), F.max(F.when(own, F.col("line"))).alias("line"),
        F.max(F.when(own, F.col("within") != "Module.body")).alias("nested"), _gathered("text", ~own & (slot == "decorator_list")).alias("decorators"),
        first("text", ~own & (slot == "args")).alias("arguments"), first("text", ~own & (slot == "value")).alias("value"),
        _gathered("name", ~own & slot.isin("targets", "target") & (F.col("kind") == "Name")).alias("targets"),
        F.transform(
            F.array_sort(F.collect_list(F.when(~own & (F.col("kind") == "alias"), F.struct("id", F.coalesce("alias", "name").alias("v"))))),
            lambda x: F.substring_index(x["v"], ".", 1),
        ).alias("brought"),
    )


def definitions(files: DataFrame) -> DataFrame:
    """The last binding of every name that import-time statements bind; an import binds a name of unknown kind."""
    from ..session import stored

    found = nodes(files, "id", "parent", "slot", "place", "kind", "name", "alias", "line", "within", "callables", "text", keep=X.defines)
    found = found if isinstance(files, Sources) else stored(found)
    statements = _statements(found).filter("made IS NOT NULL")
    starts = found.filter((F.col("kind") == "FunctionDef") & (F.col("name") == "__init__") & F.col("within").rlike(r"ClassDef\.body$"))
    lists = found.filter("kind = 'arguments'").select("repo", "path", F.col("parent").alias("id"), F.col("text").alias("list"))
    starts = starts.join(lists, ["repo", "path", "id"]).groupBy("repo", "path", F.col("parent").alias("about")).agg(F.min_by("list", "id").alias("start"))
    joined = statements.join(_by_function(found).select("repo", "path", "about", "shape"), ["repo", "path", "about"], "left").join(
        starts, ["repo", "path", "about"], "left"
    )
    function, plain = F.col("made").isin("FunctionDef", "AsyncFunctionDef"), F.col("made").isin("Assign", "AnnAssign")
    none = F.expr("CAST(array() AS array<string>)")
    bare = F.struct(
        F.lit(0).alias("required_positional"), none.alias("required_positional_names"), none.alias("required_keyword_only"), F.lit(0).alias("positional_capacity"),
        none.alias("keyword_names"), F.lit(False).alias("accepts_varargs"), F.lit(False).alias("accepts_varkw"), F.lit(False).alias("is_async"),
        F.lit(False).alias("is_generator"), F.lit(False).alias("returns_nested_function"),
    )
    shape = F.coalesce("shape", bare).withField("is_async", F.col("made") == "AsyncFunctionDef")
    notes = F.concat(F.transform("decorators", lambda d: F.concat(F.lit("@"), d)), F.when(shape["is_generator"], F.array(F.lit("generator"))).otherwise(none))
    arguments = F.when(F.col("start").contains(","), F.expr("trim(substring(start, instr(start, ',') + 1))")).otherwise(F.lit(""))
    bound = F.when(plain, F.col("targets")).when(F.col("made").isin("Import", "ImportFrom"), F.col("brought")).otherwise(F.array("own_name"))
    rows = joined.select("*", F.posexplode(bound).alias("n", "name"))
    kind = F.when(function, "function").when(F.col("made") == "ClassDef", "class").when(plain, "variable")
    signature = (
        F.when(function, F.concat(F.when(shape["is_async"], "async def ").otherwise("def "), "name", F.lit("("), F.coalesce("arguments", F.lit("")), F.lit(")")))
        .when(F.col("made") == "ClassDef", F.concat(F.lit("class "), "name", F.lit("("), F.coalesce(arguments, F.lit("")), F.lit(")")))
        .when(plain, F.concat("name", F.lit(" = "), F.substring(F.coalesce("value", F.lit("")), 1, 80))).otherwise("")
    )
    facts_of = F.struct(
        F.col("about").alias("seq"), "line", "nested", kind.alias("kind"), signature.alias("signature"),
        F.when(function, F.array_join(notes, "; ")).otherwise("").alias("notes"), F.when(function, shape).alias("shape"),
    )
    last = rows.groupBy("repo", "path", "name").agg(F.max_by(facts_of, F.struct("about", "n")).alias("d"))
    return last.select("repo", "path", "name", "d.*")


def members(files: DataFrame) -> DataFrame:
    return facts(files, X.members, X.MEMBERS)


def calls(files: DataFrame) -> DataFrame:
    return facts(files, X.calls, X.CALLS)


def references(files: DataFrame) -> DataFrame:
    return facts(files, X.references, X.REFERENCES)


def _mark() -> Column:
    """What a decorator is called."""
    return F.when(F.col("label").startswith("Call:"), F.substring_index("label", ":", -1)).otherwise(F.col("text"))


def _skips(mark: Column) -> Column:
    return mark.contains("skip") | mark.contains("xfail")


def same_reading(text: Column) -> Column:
    """An expression's text with the old and the new ways to read a response written alike.

    It works on the text as written out again from the syntax tree, so blanks and quotes do not matter; a string that
    itself spells such a reading is rewritten too.
    """
    for pattern, reading in (
        (r"\.(get_json|json)\([^()]*\)", ".<json>"), (r"\.get_data\([^()]*as_text=True[^()]*\)", ".<text>"), (r"\.get_data\([^()]*\)", ".<bytes>"),
        (r"\.text\b", ".<text>"), (r"\.(data|content)\b", ".<bytes>"),
    ):
        text = F.regexp_replace(text, pattern, reading)
    return text


def _all_of(value: Column, test: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(test, value)))


def tests(files: DataFrame) -> DataFrame:
    """What each test promises: its assertions, expected errors, parameters and skips."""
    found = nodes(files, "id", "slot", "place", "kind", "label", "name", "within", "callables", "qualified", "text")
    is_test = _is_function() & F.col("name").startswith("test") & F.col("within").rlike(r"^Module\.body(/ClassDef\.body)*$")
    decorates = (F.col("slot") == "decorator_list") & F.col("within").rlike(r"^Module\.body(/ClassDef\.body)*/(FunctionDef|AsyncFunctionDef)\.decorator_list$")
    asserted = (F.col("slot") == "test") & F.col("within").rlike(r"/Assert\.test$")
    raised = (F.col("place") == 0) & F.col("within").rlike(r"/With\.items\[0\]/withitem\.context_expr/Call:pytest\.raises\.args$")
    skipped = F.col("label").isin("Call:pytest.skip", "Call:pytest.xfail")
    about = F.when(is_test, F.col("id")).otherwise(F.get("callables", F.lit(0)))
    rows = found.withColumn("about", about).filter(is_test | decorates | asserted | raised | skipped)
    per_test = rows.groupBy("repo", "path", "about").agg(
        F.max(F.when(is_test, F.array_join(F.array_append("qualified", F.col("name")), "::"))).alias("test"),
        _all_of(same_reading(F.col("text")), raised).alias("raises"),
        _all_of(same_reading(F.col("text")), decorates & _mark().contains("parametrize")).alias("parametrize"),
        F.array_sort(F.concat(
            F.collect_list(F.when(decorates & _skips(_mark()), _mark())), F.collect_list(F.when(skipped, F.substring_index("label", ":", -1)))
        )).alias("skips"),
        _all_of(same_reading(F.col("text")), asserted).alias("assertions"),
    )
    return per_test.filter("test IS NOT NULL").select("repo", "path", F.col("about").alias("seq"), "test", "raises", "parametrize", "skips", "assertions")


def fixtures(files: DataFrame) -> DataFrame:
    """Functions marked as fixtures, with what they ask for and how they are made."""
    found = nodes(files, "id", "slot", "kind", "label", "name", "within", "callables", "text")
    marks = (F.col("slot") == "decorator_list") & F.col("within").rlike(r"FunctionDef\.decorator_list$") & _mark().contains("fixture")
    yields = F.col("kind").isin("Yield", "YieldFrom")
    asked = (F.col("kind") == "arg") & F.col("slot").isin("posonlyargs", "args", "kwonlyargs")
    rows = found.filter(_is_function() | marks | yields | asked).withColumn(
        "about",
        F.explode(F.when(_is_function(), F.array("id")).when(yields, F.col("callables")).otherwise(F.slice("callables", -1, 1))),
    )
    per_function = rows.groupBy("repo", "path", "about").agg(
        F.max(F.when(_is_function(), F.col("name"))).alias("fixture"),
        _gathered("name", asked & (F.col("slot") != "kwonlyargs")).alias("dependencies"), _gathered("name", asked & (F.col("slot") == "kwonlyargs")).alias("keyword_dependencies"),
        F.coalesce(F.max(F.when(_is_function(), F.col("kind") == "AsyncFunctionDef")), F.lit(False)).alias("is_async"), (F.count(F.when(yields, 1)) > 0).alias("is_generator"),
        _all_of(same_reading(F.col("text")), marks).alias("decorators"),
    )
    return per_function.filter((F.size("decorators") > 0) & F.col("fixture").isNotNull()).withColumnRenamed("about", "seq")


def module_skips(files: DataFrame) -> DataFrame:
    """Skip marks on classes and on the whole module."""
    on_class = (F.col("within") == "Module.body/ClassDef.decorator_list") & _skips(_mark())
    on_module = (F.col("within") == "Module.body") & F.col("kind").isin("Assign", "AnnAssign") & F.col("text").contains("pytestmark") & _skips(F.col("text"))
    return nodes(files, "id", "slot", "kind", "label", "within", "text").filter(on_class | on_module).select(
        "repo", "path", F.col("id").alias("seq"), F.when(on_class, _mark()).otherwise(F.col("text")).alias("mark")
    )


#: Names that every module has without binding them.
_GIVEN = sorted({*dir(builtins), *vars(ModuleType("m")), "__file__", "__builtins__", "__annotations__"})


def undefined_globals(files: DataFrame) -> DataFrame:
    """Names in use that no namespace in sight binds; a star import makes the answer unknowable.

    A use is joined with the bindings of every namespace that it sees.  What a function declares global and assigns is a
    binding of the module.
    """
    from ..session import stored

    columns = ("id", "kind", "name", "alias", "use", "names", "within", "sees")
    found = nodes(files, *columns, keep=X.scopes).select("repo", "path", *columns)
    found = found if isinstance(files, Sources) else stored(found)
    binds = ((F.col("kind") == "Name") & (F.col("use") != "Load")) | ~F.col("kind").isin("Name", "Global")
    bound = found.filter(binds & F.coalesce(F.col("alias"), F.col("name")).isNotNull()).select(
        "repo", "path", F.element_at("sees", -1).alias("space"), F.substring_index(F.coalesce("alias", "name"), ".", 1).alias("name")
    ).distinct()
    shared = found.filter("kind = 'Global'").select("repo", "path", F.element_at("sees", -1).alias("space"), F.explode("names").alias("name"))
    bound = bound.unionByName(bound.join(shared, ["repo", "path", "space", "name"], "left_semi").withColumn("space", F.lit(0))).distinct()
    used = found.filter((F.col("kind") == "Name") & (F.col("use") == "Load") & ~F.col("name").isin(*_GIVEN))
    used = used.filter((F.col("name") != "__class__") | ~F.col("within").contains("ClassDef.body"))
    resolved = used.select("repo", "path", "id", "name", F.explode("sees").alias("space")).join(bound, ["repo", "path", "space", "name"]).select("repo", "path", "id")
    stars = found.filter((F.col("name") == "*") & (F.col("within") == "Module.body/ImportFrom.names")).select("repo", "path").distinct()
    left = used.join(resolved, ["repo", "path", "id"], "left_anti").join(stars, ["repo", "path"], "left_anti")
    return left.select("repo", "path", "name").distinct()


def web_facts(files: DataFrame) -> DataFrame:
    return facts(files, X.web_facts, X.WEB_FACTS)


def _parses(texts: pa.Array) -> pa.Array:
    def check(text: str | None) -> dict:
        try:
            ast.parse(text or "")
        except SyntaxError as error:
            return {"parses": False, "line": error.lineno}
        except (ValueError, RecursionError):
            return {"parses": False, "line": None}
        return {"parses": True, "line": None}

    return pa.array([check(t) for t in texts.to_pylist()], pa.struct([("parses", pa.bool_()), ("line", pa.int32())]))


def parse_status(files: DataFrame) -> DataFrame:
    """Whether each file parses, and where it stops."""
    if isinstance(files, Sources):
        return files.facts(STATUS).drop("seq")
    # declared so that a filter on the result is not pushed down and the text parsed twice
    status = F.arrow_udf(_parses, "parses boolean, line int").asNondeterministic()("text")
    return files.select(*[c for c in files.columns if c != "text"], status.alias("s")).select(
        *[c for c in files.columns if c != "text"], "s.parses", "s.line"
    )


# --------------------------------------------------------------------------------- imports


def names_of(paths: DataFrame) -> DataFrame:
    """(repo, path, name): every dotted name a file goes by."""
    return paths.select("repo", "path", F.explode(P.module_names(F.col("path"))).alias("name"))


def reexported(files: DataFrame) -> DataFrame:
    """(repo, module, name): what a package's own file binds as a symbol.

    ``from . import x`` binds a module, so it does not count.
    """
    inits = files.filter(P.basename(F.col("path")) == "__init__.py")
    defined = nodes(inits, "kind", "name", "within", keep=X.defines).filter(F.col("within").rlike(r"^Module\.body(/(Assign|AnnAssign)\.targets?)?$") & (
        F.col("kind").isin("FunctionDef", "AsyncFunctionDef", "ClassDef") | ((F.col("kind") == "Name") & F.col("within").contains("target"))
    )).select("repo", "path", "name")
    brought = facts(inits, X.imports, X.IMPORTS).filter("top AND is_from AND module IS NOT NULL")
    bound = defined.unionByName(brought.select("repo", "path", F.col("local").alias("name"))).distinct()
    # when two packages go by one name the first path answers
    owner = names_of(inits.select("repo", "path")).groupBy("repo", "name").agg(F.min("path").alias("path"))
    return owner.withColumnRenamed("name", "module").join(bound, ["repo", "path"]).select("repo", "module", "name")


def bindings(files: DataFrame) -> DataFrame:
    """How files bind other files: (repo, path, importer, symbol, local, seq).

    ``path`` is the imported file; ``symbol`` is NULL when the whole module is bound.  A file goes by
    the last part of its name too, on purpose: an import that could mean it counts.  All names of a
    file end alike, so that part is the join key; only ``from package import module`` needs the full
    name.  An import asks for both in one join, so that files are parsed once.
    """
    named = names_of(files.select("repo", "path"))
    tails = named.select("repo", "path", P.last_segment(F.col("name")).alias("asked")).distinct().withColumn("whole", F.lit(False))
    known = tails.unionByName(named.select("repo", "path", F.col("name").alias("asked"), F.lit(True).alias("whole")))
    found = imports(files).filter("name <> '*'").withColumnRenamed("path", "importer")
    own = F.col("importer") != F.col("path")

    relative = F.col("is_from") & F.col("module").isNull()
    absolute = F.col("is_from") & F.col("module").isNotNull()
    key = (
        F.when(relative, F.col("name"))
        .when(absolute, P.last_segment(F.col("resolved")))
        .otherwise(P.last_segment(F.col("name")))
    )
    # from package import module
    dotted = F.regexp_replace(F.concat_ws(".", "resolved", F.col("name")), r"^\.+", "")
    asked = F.array_compact(F.array(
        F.struct(F.lit(False).alias("whole"), key.alias("asked")), F.when(absolute, F.struct(F.lit(True).alias("whole"), dotted.alias("asked")))
    ))
    hits = (
        found.select("repo", "importer", "seq", "resolved", "name", "local", F.when(absolute, F.col("name")).alias("symbol"), F.explode(asked).alias("a"))
        .select("*", "a.*")
        .join(known, ["repo", "whole", "asked"])
        .filter(own & (~F.col("whole") | (P.last_segment(F.col("resolved")) != P.last_segment(F.col("asked")))))
        .withColumn("package", F.when(F.col("whole"), F.col("resolved")))
    )
    symbols = reexported(files).select("repo", F.col("module").alias("package"), "name")
    return hits.join(symbols, ["repo", "package", "name"], "left_anti").select(
        "repo", "path", "importer", F.when(~F.col("whole"), F.col("symbol")).alias("symbol"), "local", "seq"
    )


def planned_imports(files: DataFrame, planned: DataFrame) -> DataFrame:
    """Edges (repo, path, dep) between planned files.

    ``planned`` is (repo, path, position).  A name several planned files go by means the one planned
    last.  The full dotted name is tried before its last part.
    """
    lookup = (
        planned.select("repo", "path", "position", F.explode(P.module_names(F.col("path"))).alias("name"))
        .groupBy("repo", "name")
        .agg(F.max_by("path", F.struct("position", "path")).alias("dep"))
    )
    # parsed where the texts are: they are not shuffled, and tasks are not made few by their bytes
    found = imports(files).join(planned.select("repo", "path"), ["repo", "path"], "left_semi")
    whole = F.regexp_replace(F.concat_ws(".", F.nullif("resolved", F.lit("")), F.col("name")), r"^\.+", "")
    asked = (
        F.when(F.col("is_from") & F.col("module").isNull(), F.array(whole))
        .when(F.col("is_from"), F.array(F.col("resolved"), F.concat_ws(".", "resolved", "name")))
        .otherwise(F.array("name"))
    )
    wanted = found.select("repo", "path", F.explode(asked).alias("name")).distinct()
    full = lookup.select("repo", "name", F.col("dep").alias("full_dep"))
    tail = lookup.select("repo", F.col("name").alias("tail"), F.col("dep").alias("tail_dep"))
    joined = (
        wanted.join(full, ["repo", "name"], "left")
        .withColumn("tail", P.last_segment(F.col("name")))
        .join(tail, ["repo", "tail"], "left")
        .withColumn("dep", F.coalesce("full_dep", "tail_dep"))
    )
    return joined.filter("dep IS NOT NULL AND dep <> path").select("repo", "path", "dep").distinct()


def used_symbols(bound: DataFrame, refs: DataFrame) -> DataFrame:
    """(repo, path, symbol, importer, local, binding): the names importers take from a file.

    A symbol import names it; a module import takes the attributes used on it.
    """
    attributes = refs.filter("owner IS NOT NULL").select(
        "repo", F.col("path").alias("importer"), F.col("owner").alias("module"), F.col("name").alias("attribute")
    ).distinct()
    # one join for both, so that what is bound is found once
    named = F.col("symbol").isNotNull()
    taken = bound.withColumn("module", F.when(~named, F.col("local"))).join(attributes, ["repo", "importer", "module"], "left")
    return taken.filter(named | F.col("attribute").isNotNull()).select(
        "repo", "path", F.coalesce("symbol", "attribute").alias("symbol"), "importer", "local", F.when(named, "symbol").otherwise("module").alias("binding")
    ).distinct()


def call_sites(bound: DataFrame, files: DataFrame, limit: int = 3) -> DataFrame:
    """The first lines of an importer that use a binding, by text."""
    from ..functions.text import lines_of, strip

    lines = files.select("repo", F.col("path").alias("importer"), F.posexplode(lines_of(F.col("text"))).alias("line_no", "raw"))
    code = lines.select("repo", "importer", "line_no", strip(F.col("raw")).alias("line")).filter(
        ~F.col("line").rlike("^(def |class |from |import |#)")
    )
    local = F.col("local")
    uses: Column = F.when(
        F.col("symbol").isNotNull(),
        F.contains("line", F.concat(local, F.lit("("))) | F.contains("line", F.concat(F.lit("with "), local)) | F.contains("line", F.concat(F.lit("@"), local)),
    ).otherwise(F.contains("line", F.concat(local, F.lit("."))))
    from .task_tables import first_k

    hits = bound.join(code, ["repo", "importer"]).filter(uses)
    keyed = first_k(hits, ["repo", "path", "importer", "seq", "local"], ["line_no"], limit)
    return keyed.select("repo", "path", "importer", "symbol", "local", "line_no", F.substring("line", 1, 160).alias("line"))


def export_contract(used: DataFrame) -> DataFrame:
    """Names a file has to keep exporting."""
    return used.select("repo", "path", "symbol").distinct()


def interface_contract(files: DataFrame, used: DataFrame) -> DataFrame:
    """Every used name with the kind and shape of its top-level definition; default a variable."""
    defined = definitions(files).filter("NOT nested AND kind IS NOT NULL").select(
        "repo", "path", F.col("name").alias("symbol"), "kind", "signature", "notes", "shape"
    )
    wanted = export_contract(used)
    joined = wanted.join(defined, ["repo", "path", "symbol"], "left")
    return joined.select(
        "repo", "path", "symbol", F.coalesce("kind", F.lit("variable")).alias("kind"),
        F.coalesce("signature", "symbol").alias("signature"), F.coalesce("notes", F.lit("")).alias("notes"), "shape",
    )


def member_uses(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The strongest use of each wanted member: read, called, or entered with ``with``."""
    rank = F.when(F.col("use") == "context_manager", 2).when(F.col("use") == "method", 1).otherwise(0)
    refs = references(files).filter("owner IS NOT NULL")
    hits = refs.join(wanted.select("repo", F.col("member").alias("name")).distinct(), ["repo", "name"])
    return hits.groupBy("repo", F.col("name").alias("member")).agg(F.max_by("use", rank).alias("shape"))


def bound_names(files: DataFrame) -> DataFrame:
    return facts(files, X.bound_names, X.BOUND_NAMES).select("repo", "path", "name").distinct()


def imported_names(files: DataFrame) -> DataFrame:
    """(repo, path, module_name, name, local, is_from): imports with the module that each names, without stars."""
    return _names_imported(imports(files))


def _names_imported(found: DataFrame) -> DataFrame:
    return found.filter("name <> '*'").select(
        "repo", "path", F.when(F.col("is_from"), F.col("resolved")).otherwise(F.col("name")).alias("module_name"), "name", "local", "is_from"
    )
