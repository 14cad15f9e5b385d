"""Benchmark passages in documents, found by one Aho-Corasick automaton over the words of all items."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh, process_state, with_read, written

WINDOW = 13
#: Bytes of item text in one automaton.  More items are scanned for in turns, each with its own automaton.
AUTOMATON_BYTES = 16 << 20
#: What stands between words becomes a space, A-Z lower case; bytes from 0x80 on are parts of words.
_NORMAL = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

SCANNED = "struct<hits:array<int>,items:array<string>>"
FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,stop:int>>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


class _Finder:
    """The automaton over word numbers, with the items of each of its windows."""

    def __init__(self, items: list[tuple[str | None, str]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        of_window: dict[tuple[int, ...], set] = defaultdict(set)
        for item_id, text in items:
            coded = [self.number.setdefault(w, len(self.number) + 1) for w in normal_words(text)]
            for at in range(max(1, len(coded) - WINDOW + 1) if coded else 0):
                of_window[tuple(coded[at : at + WINDOW])].add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in of_window.items():
            self.automaton.add_word(window, (len(window), ids - {None}))
        self.empty = not of_window
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[set[int], set[str]]:
        """The places of the words that are hit, and the items."""
        hit, items = set(), set()
        if not self.empty and words:
            known = self.number.get
            for end, (length, ids) in self.automaton.iter(tuple([known(w, 0) for w in words])):
                hit.update(range(end - length + 1, end + 1))
                items |= ids
        return hit, items


def _spans(text: str, hit: list[int]) -> list[dict]:
    """Runs of hit words as places in the original text, in code points."""
    if not hit:
        return []
    places = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    out, first = [], hit[0]
    for before, after in zip(hit, [*hit[1:], None], strict=True):
        if after != before + 1:
            out.append({"start": places[first][0], "stop": places[before][1]})
            first = after
    return out


def _scan(items, name: str, last: bool):
    """One turn over texts and what the turns before have found; ``items`` is a broadcast list of (item_id, text)."""

    def make():
        kept = process_state()
        if kept.get("finder", ("",))[0] != name:
            kept["finder"] = (name, _Finder(items.value))
        finder = kept["finder"][1]

        def read(texts: list, before: list | None = None) -> pa.Array:
            rows = []
            for text, found in zip(texts, before or [None] * len(texts), strict=True):
                words = normal_words(text)
                hit, ids = finder.find(words)
                if found is not None:
                    hit, ids = hit.union(found["hits"]), ids.union(found["items"])
                hit, ids = sorted(hit), sorted(ids)
                if last:
                    rows.append({"n_words": len(words), "n_hit": len(hit), "items": ids, "spans": _spans(text or "", hit)})
                else:
                    rows.append({"hits": hit, "items": ids})
            span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
            done = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))])
            return pa.array(rows, done if last else pa.struct([("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

        return read

    return make


def _with_found(docs: DataFrame, benchmark: DataFrame, name: str, automaton_bytes: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text")).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    turns = max(1, -(-size // automaton_bytes))
    cut = written(items.withColumn("turn", F.pmod(F.xxhash64("item_id", "text"), F.lit(turns))), "items") if turns > 1 else items.withColumn("turn", F.lit(0))
    context, rows, before = docs.sparkSession.sparkContext, docs, None
    for turn in range(turns):
        sent = context.broadcast([(r["item_id"], r["text"]) for r in cut.filter(F.col("turn") == turn).collect()])
        last = turn == turns - 1
        added = name if last else fresh(rows, "scanned")
        made = with_read(rows, ["text"] + [before] * (before is not None), added, FOUND if last else SCANNED, _scan(sent, uuid.uuid4().hex, last))
        rows = made.drop(before) if before else made
        before = added
        if not last:
            rows = written(rows, "scanned")
    return rows


_RULE = "{0}.n_hit > 0 AND 20 * {0}.n_hit >= {0}.n_words"


def contamination(docs: DataFrame, benchmark: DataFrame, *, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated): what of each document row occurs in benchmark items.

    Words are runs of letters and digits, A-Z in lower case.  An item is its windows of 13 words, or all its
    words if it has fewer; a document word inside an occurrence of a window is hit.  ``items`` are the items
    with such windows as sorted strings, ``spans`` the hit runs as code-point ranges of the original text.
    NULL and empty texts have no words, items without words no windows; an item without an id makes hits but
    is not listed.  Equal rows are judged alike.  No documents: no rows; no items: nothing is hit.

    Items are cut into groups of ``automaton_bytes``, each sent to the tasks by itself, so what is broadcast
    stays bounded; documents are written to the shared folder between two groups.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return _with_found(rows, benchmark, "found", automaton_bytes).select("doc_id", "found.*", F.expr(_RULE.format("found")).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    name = fresh(docs, "found")
    return _with_found(docs, benchmark, name, automaton_bytes).filter(f"NOT ({_RULE.format(name)})").drop(name)
