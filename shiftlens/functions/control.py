"""Control flow inside one file, on its statements as plain rows.

What a file holds is small, so it is followed here by look-ups; what concerns many files is for joins.  The functions use
the standard library alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

END, RAISED = -1, -2
_LOOPS = ("For", "AsyncFor", "While")
_TRIES = ("Try", "TryStar")
_DEFINITIONS = ("FunctionDef", "AsyncFunctionDef", "ClassDef")
#: Statements with a block that simply runs.
_PLAIN_BLOCKS = ("With", "AsyncWith", "Try", "TryStar", "ClassDef")
_COMPOUND = (*_PLAIN_BLOCKS, "ExceptHandler", "match_case")
_BLOCKS = ("body", "orelse", "finalbody")
_LAST = 1e9


def _first_of(candidates: Iterable[tuple[int, int, float]]) -> dict[int, set[int]]:
    """Per statement the candidates with the lowest rank."""
    best: dict[int, float] = {}
    found: dict[int, set[int]] = {}
    for src, dst, rank in candidates:
        if src not in best or rank < best[src]:
            best[src], found[src] = rank, {dst}
        elif rank == best[src]:
            found[src].add(dst)
    return found


def edges(rows: Iterable[tuple], risky: set[int], forever: set[int]) -> set[tuple[int, int, int, str]]:
    """(function, src, dst, kind) of one file; ``operators.flow.flow_edges`` says what they mean.

    ``rows`` are (function, id, parent, slot, place, kind, above) of its statements in functions, ``above`` a list of (id,
    slot, kind); ``risky`` are the statements whose own expressions may raise, ``forever`` those whose test always holds.
    """
    following, first, handlers, kinds, functions = (defaultdict(set) for _ in range(5))
    at, around, handling = defaultdict(set), [], set()
    for function, me, parent, slot, place, kind, above in rows:
        kinds[me].add(kind)
        functions[me].add(function)
        if slot in _BLOCKS:
            at[parent, slot, place].add(me)
            if place == 0:
                first[parent].add((slot, me))
        if kind == "ExceptHandler":
            handlers[parent].add(me)
            handling.add(me)
        around.extend([(me, kind, far, *owner) for far, owner in enumerate(reversed(above))])
    for (parent, slot, place), sources in at.items():
        for dst in at.get((parent, slot, place + 1), ()):
            for src in sources:
                following[src].add(dst)

    # what comes after a statement: the next of its block, else what the statements around it offer, nearest first
    def offers() -> Iterator[tuple[int, int, float]]:
        yield from ((src, dst, 0.0) for src, ds in following.items() for dst in ds)
        for src, _, far, owner, through, owner_kind in around:
            yield from ((src, dst, 2 * far + 2) for dst in following.get(owner, ()))
            if owner_kind in _LOOPS and through == "body":
                yield src, owner, 2 * far + 1
            elif owner_kind in ("FunctionDef", "AsyncFunctionDef"):
                yield src, END, 2 * far + 1
            elif owner_kind in _TRIES:
                for block, dst in first.get(owner, ()):
                    # an else part comes before the finally part
                    if through == "body" and block == "orelse":
                        yield src, dst, 2 * far + 1
                    elif through in ("body", "handlers", "orelse") and block == "finalbody":
                        yield src, dst, 2 * far + 1.5

    after = _first_of(offers())
    raising = {me for me, ks in kinds.items() for k in ks if k == "Raise" or me in risky and k not in _DEFINITIONS}
    out = set()

    def edge(src: int, dst: int, kind: str) -> None:
        out.update((function, src, dst, kind) for function in functions.get(src, ()))

    for src, ks in kinds.items():
        for kind in ks:
            blocks = first.get(src, ())
            for block, dst in blocks:
                if block == "body" and (kind == "If" or kind in _LOOPS or kind in _COMPOUND) or block == "orelse" and (kind == "If" or kind in _LOOPS):
                    edge(src, dst, "normal")
            if kind in ("Return", "Raise", "Break", "Continue") or kind in _COMPOUND:
                continue
            if (kind == "If" or kind in _LOOPS) and (any(block == "orelse" for block, _ in blocks) or src in forever and kind == "While"):
                continue
            for dst in after.get(src, ()):
                edge(src, dst, "normal")
    for _, me, parent, _, _, kind, _ in rows:
        if kind == "match_case":
            edge(parent, me, "normal")

    # ways out: the nearest finally on the way, else the loop or the end
    finals = [
        (src, kind, dst, far) for src, kind, far, owner, through, owner_kind in around if owner_kind in _TRIES and through != "finalbody"
        for block, dst in first.get(owner, ()) if block == "finalbody"
    ]
    loops: dict[tuple[int, str], tuple[int, int]] = {}
    for src, kind, far, owner, through, owner_kind in around:
        if owner_kind in _LOOPS and through == "body" and kind in ("Break", "Continue"):
            loops[src, kind] = min(loops.get((src, kind), (far, owner)), (far, owner))
    jumps = [(src, dst, far) for src, kind, dst, far in finals if kind in ("Return", "Break", "Continue")]
    jumps += [(src, END, _LAST) for src, ks in kinds.items() if "Return" in ks]
    for (src, kind), (far, owner) in loops.items():
        jumps += [(src, dst, far) for dst in after.get(owner, ())] if kind == "Break" else [(src, owner, far)]
    for src, ds in _first_of(jumps).items():
        for dst in ds:
            edge(src, dst, "normal")

    # errors: the handlers of the nearest try whose body this is, else the nearest finally, else the end by an error
    thrown = [(src, dst, far) for src, _, far, owner, through, owner_kind in around if owner_kind in _TRIES and through == "body" for dst in handlers.get(owner, ())]
    thrown += [(src, dst, far + 0.5) for src, _, dst, far in finals] + [(src, RAISED, _LAST) for src in raising]
    for src, ds in _first_of(t for t in thrown if t[0] in raising).items():
        for dst in ds:
            edge(src, dst, "caught" if dst in handling else "error")

    # a finally that was entered by a jump or an error goes on outwards
    in_final = {(src, owner) for src, _, _, owner, through, owner_kind in around if owner_kind in _TRIES and through == "finalbody"}
    if in_final:
        broken = defaultdict(set)
        for src, kind, _, owner, through, owner_kind in around:
            if owner_kind in _TRIES and through in ("body", "handlers", "orelse"):
                if src in raising:
                    broken[owner].add("error")
                if kind == "Return":
                    broken[owner].add("normal")
        outward = _first_of([(src, dst, far) for src, _, dst, far in finals] + [(src, END, _LAST) for src, *_ in around])
        for src, owner in in_final:
            if any((dst, owner) not in in_final for dst in after.get(src, ())):
                for kind in broken.get(owner, ()):
                    for dst in outward.get(src, ()):
                        edge(src, RAISED if kind == "error" and dst == END else dst, kind)
    return out


def ways(steps: Iterable[tuple[int, int, str]], starts: Iterable[tuple[str, int, list[int]]], stops: Iterable[tuple[str, int]]) -> Iterator[tuple[str, int, list[int]]]:
    """(key, dst, trail) of the ends that are reached in one file; ``operators.flow.paths_avoiding`` says how."""
    onward, blocked, begun = defaultdict(set), defaultdict(set), defaultdict(list)
    for src, dst, kind in steps:
        onward[src].add((dst, kind))
    for key, node in stops:
        blocked[key].add(node)
    for key, src, trail in starts:
        begun[key].append((src, trail))
    for key, frontier in begun.items():
        seen, kept, anywhere = set(), blocked.get(key, set()), False
        while frontier:
            reached: dict[int, list[int]] = {}
            for src, trail in frontier:
                for dst, kind in onward.get(src, ()):
                    if (anywhere or kind == "normal") and dst not in kept and dst not in seen and (dst not in reached or trail < reached[dst]):
                        reached[dst] = trail
            anywhere = True
            seen |= reached.keys()
            yield from ((key, dst, trail) for dst, trail in reached.items() if dst < 0)
            frontier = [(dst, [*trail, dst]) for dst, trail in reached.items() if dst >= 0]
