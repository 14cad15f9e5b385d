"""Control flow and calls between functions."""

import pytest

from shiftlens.operators import code_facts as C
from shiftlens.operators import flow

#: source of one function, the line that a way starts at, the lines it must not pass, and whether an end is reached:
#: by the function's end and by an error
CASES = {
    "straight": ("def f():\n    a = open(1)\n    work()\n    a.close()\n", 2, [4], False, True),
    "branch": ("def f(x):\n    a = open(1)\n    if x:\n        a.close()\n    return 1\n", 2, [4], True, False),
    "both branches": ("def f(x):\n    a = open(1)\n    if x:\n        a.close()\n    else:\n        a.close()\n    return 1\n", 2, [4, 6], False, False),
    "early return": ("def f(x):\n    a = open(1)\n    for i in x:\n        if i:\n            return i\n    a.close()\n", 2, [6], True, False),
    "finally": ("def f(x):\n    a = open(1)\n    try:\n        if x:\n            return work()\n        more()\n    finally:\n        a.close()\n    return 2\n", 2, [8], False, False),
    "handler": ("def f(x):\n    a = open(1)\n    try:\n        work()\n    except ValueError:\n        return 0\n    a.close()\n", 2, [7], True, False),
    "handler closes": ("def f(x):\n    a = open(1)\n    try:\n        work()\n    except ValueError:\n        a.close()\n        raise\n    a.close()\n", 2, [6, 8], False, False),
    "forever": ("def f():\n    a = open(1)\n    while True:\n        if work():\n            break\n    a.close()\n", 2, [6], False, True),
    "continue": ("def f(x):\n    a = open(1)\n    for i in x:\n        if i:\n            continue\n        a.close()\n    return 1\n", 2, [6], True, False),
    "else of a loop": ("def f(x):\n    a = open(1)\n    for i in x:\n        pass\n    else:\n        a.close()\n", 2, [6], False, False),
    "else of a try": ("def f(x):\n    a = open(1)\n    try:\n        x = 1\n    except KeyError:\n        x = 2\n    else:\n        a.close()\n", 2, [8], False, False),
    "nested finally": ("def f(x):\n    a = open(1)\n    try:\n        try:\n            return work()\n        finally:\n            log()\n    finally:\n        a.close()\n", 2, [9], False, False),
    "inner function": ("def f(x):\n    a = open(1)\n    def g():\n        return a.close()\n    return 1\n", 2, [4], True, False),
    "with": ("def f(x):\n    a = open(1)\n    with lock:\n        a.close()\n", 2, [4], False, False),
    "match": ("def f(x):\n    a = open(1)\n    match x:\n        case 1:\n            a.close()\n        case _:\n            pass\n", 2, [5], True, False),
    "raise": ("def f(x):\n    a = open(1)\n    if x:\n        raise ValueError\n    a.close()\n", 2, [5], False, True),
}


@pytest.fixture(scope="module")
def ends(spark):
    files = spark.createDataFrame([("r", name, text) for name, (text, *_) in CASES.items()], "repo string, path string, text string")
    found = C.nodes(files).cache()
    edges = flow.flow_edges(found)
    rows = {(r["path"], r["line"]): r["id"] for r in flow.statements(found).collect()}
    starts = [("r", n, "k", rows[n, start], [rows[n, start]]) for n, (_, start, *_) in CASES.items()]
    stops = [("r", n, "k", rows[n, line]) for n, (_, _, lines, *_) in CASES.items() for line in lines]
    starts = spark.createDataFrame(starts, "repo string, path string, key string, src int, trail array<int>")
    stops = spark.createDataFrame(stops, "repo string, path string, key string, node int")
    lines = {(n, i): line for (n, line), i in rows.items()}
    out = {}
    for kind, allowed in (("normal", "kind <> 'error'"), ("any", "true")):
        for r in flow.paths_avoiding(edges.filter(allowed), starts, stops).collect():
            out[kind, r["path"], r["dst"]] = [lines[r["path"], i] for i in r["trail"]]
    return out


@pytest.mark.parametrize("name", sorted(CASES))
def test_ends_that_avoid_the_release(ends, name):
    _, start, lines, by_end, by_error = CASES[name]
    assert (("normal", name, flow.END) in ends) == by_end
    assert (("any", name, flow.RAISED) in ends) == by_error
    for (_, n, _), way in ends.items():
        if n == name:
            assert way[0] == start and not set(way[1:]) & set(lines)


def test_shortest_way_is_told(ends):
    assert ends["normal", "branch", flow.END] == [2, 3, 5]
    assert ends["normal", "early return", flow.END] == [2, 3, 4, 5]


def test_calls_across_files(spark):
    texts = {
        "pkg/a.py": "from .b import mid as m\nfrom pkg import c\ndef start():\n    m()\ndef other():\n    return c.leaf()\n",
        "pkg/b.py": "import pkg.c\ndef mid():\n    inner()\ndef inner():\n    pkg.c.leaf()\n    missing()\n",
        "pkg/c.py": "def leaf():\n    return leaf()\n",
    }
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, text string")
    graph = flow.call_graph(C.nodes(files), C.names_of(files).withColumnRenamed("name", "module_name"), C.imported_names(files))
    edges = {(r["caller_path"][4], r["caller"], r["path"][4], r["name"]) for r in graph.collect()}
    assert edges == {("a", "start", "b", "mid"), ("a", "other", "c", "leaf"), ("b", "mid", "b", "inner"), ("b", "inner", "c", "leaf"), ("c", "leaf", "c", "leaf")}
    starts = spark.createDataFrame([("r", "pkg/a.py", "start"), ("r", "pkg/c.py", "leaf")], "repo string, path string, name string")
    for reach, far in ((1, {"mid"}), (2, {"mid", "inner"}), (9, {"mid", "inner", "leaf"})):
        found = {r["name"]: r["way"] for r in flow.reaching(graph, starts, reach).filter("start = 'start'").collect()}
        assert set(found) == far | {"start"}
    assert found["leaf"] == ["pkg/a.py::start", "pkg/b.py::mid", "pkg/b.py::inner", "pkg/c.py::leaf"]
