"""Ranked lexical search by two hierarchies that are walked together.

A document is a vector with one coordinate per term of the items, its score for an item the sum of the item's
coordinates.  Documents of a batch are the leaves of one tree, items those of another, each node holding the maximum of
every coordinate below it.  For a pair of nodes the product of their maxima bounds every score below both, so the pair is
dropped with all that is under it where the bound is less than the weakest 50th score that any of its items has so far.
Bounds are sums of integers below 2**53, so nothing is dropped that belongs to the result.

Documents are read twice: their text for the counts (once), and the small table of the terms that items hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sum, with_running
from .base import written

#: Bytes of item text whose terms are counted in one pass over the documents.  More items are taken in turns.
ITEM_BYTES = 4 << 20
#: Bytes of item text in one tree; a turn with more has several trees, each searched for in the counted terms.
TREE_BYTES = 1 << 18
#: Numbers in the matrix of a batch of documents (terms x documents), 64 MB.
CELLS = 1 << 23
#: Children of a node of either tree, and levels above the leaves.
FAN, LEVELS = 8, 3
#: Documents scored first, to have scores that bounds can fail to reach.
SEED = 4096
#: Lists of the best are merged in so many groups before they are merged into one.
MERGE = 64

#: What stands between terms becomes a space, A-Z lower case; bytes from 0x80 on are parts of terms.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = "doc_id long, n long, terms binary, counts binary"
FOUND = "part int, item int, doc_id long, score long"


def text_terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def _count(sent):
    """Per document its number of terms, and those that items hold with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found = text_terms(text)
                own = np.array([t for t in map(known, found) if t is not None], np.int32)
                which, often = np.unique(own, return_counts=True)
                sizes.append(len(found))
                terms.append(which.astype("<i4").tobytes())
                counts.append(often.astype("<i8").tobytes())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the terms its documents hold, with the number of documents."""
    for batch in batches:
        which, often = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(often, pa.int64())], ["term", "df"])


def _maxima(values: np.ndarray) -> np.ndarray:
    """The rows of the next level: the coordinate maxima of every ``FAN`` rows."""
    return np.maximum.reduceat(values, np.arange(0, len(values), FAN), axis=0)


def _minima(values: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, np.arange(0, len(values), FAN))


class ItemTree:
    """The items of a turn, those with common terms side by side, with the coordinate maxima of their groups."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, frequency: np.ndarray):
        by_frequency = [sorted(terms, key=lambda t: (-frequency[t], t)) for terms in items]
        self.order = sorted(range(len(items)), key=lambda i: by_frequency[i])
        self.terms = [np.array(items[i], np.int64) for i in self.order]
        self.weights = weights
        groups = np.zeros((-(-len(items) // FAN), len(weights)))
        for row, terms in enumerate(self.terms):
            groups[row // FAN, terms] = 1
        #: from the groups of ``FAN`` items upwards; the items themselves are their terms
        self.levels = [groups]
        for _ in range(LEVELS - 1):
            self.levels.append(_maxima(self.levels[-1]))


class Search:
    """The best ``k`` documents of every item among the batches so far."""

    def __init__(self, tree: ItemTree, k: int, weakest: np.ndarray):
        self.tree, self.k = tree, k
        #: per item, in the tree's order, a score below which nothing can be among the best
        self.weakest = np.maximum(weakest, 1)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tree.terms]

    def see(self, ids: np.ndarray, values: np.ndarray) -> None:
        """``values``: a row of coordinates per document."""
        # documents with the same heaviest coordinates stand together
        heavy = np.argpartition(-values, min(2, values.shape[1] - 1), axis=1)[:, :3]
        order = np.lexsort(heavy.T[::-1])
        ids, levels = ids[order], [values[order]]
        for _ in range(LEVELS):
            levels.append(_maxima(levels[-1]))
        bars = [self.weakest]
        for _ in range(LEVELS):
            bars.append(_minima(bars[-1]))
        alive = np.ones((len(bars[LEVELS]), len(levels[LEVELS])), bool)
        for level in range(LEVELS, 0, -1):
            if level < LEVELS:  # the children of the pairs that are left
                alive = alive.repeat(FAN, 0)[: len(bars[level])].repeat(FAN, 1)[:, : len(levels[level])]
            some, docs = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            bound = np.zeros(alive.shape)
            bound[np.ix_(some, docs)] = self.tree.levels[level - 1][some] @ levels[level][docs].T
            alive &= bound >= bars[level][:, None]
        columns = levels[0].T.copy()
        for item, terms in enumerate(self.tree.terms):
            groups = np.flatnonzero(alive[item // FAN])
            if not len(groups) or not len(terms):
                continue
            docs = (groups[:, None] * FAN + np.arange(FAN)).ravel()
            docs = docs[docs < len(ids)]
            scores = columns[np.ix_(terms, docs)].sum(0).astype(np.int64)
            good = scores >= self.weakest[item]
            if good.any():
                self._keep(item, ids[docs[good]], scores[good])

    def _keep(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.best[item][0], ids), np.append(self.best[item][1], scores)
        first = np.lexsort((ids, -scores))[: self.k]
        self.best[item] = ids[first], scores[first]
        if len(first) == self.k:
            self.weakest[item] = max(self.weakest[item], scores[first[-1]])


def _search(sent, k: int):
    """The best of each task.  Rows are (doc_id, n, terms, counts) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree, local, weakest, documents, length = sent.value
        search, width = Search(tree, k, weakest), len(tree.weights)
        step = max(FAN, CELLS // max(1, width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                terms, counts = part.column(2).to_pylist(), part.column(3).to_pylist()
                rows = np.repeat(np.arange(len(ids)), [len(t) // 4 for t in terms])
                which = np.frombuffer(b"".join(terms), "<i4")
                tf = np.frombuffer(b"".join(counts), "<i8")
                which = local[which]  # a term of other trees is -1
                rows, tf, which = rows[which >= 0], tf[which >= 0], which[which >= 0]
                m = 100 - 50 + (50 * n * documents) // length
                values = np.zeros((len(ids), width))
                values[rows, which] = tree.weights[which] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[rows]))
                search.see(ids, values)
        found = [(np.full(len(ids), tree.order[i], np.int32), ids, scores) for i, (ids, scores) in enumerate(search.best) if len(ids)]
        if found:
            item, ids, scores = (np.concatenate(c) for c in zip(*found, strict=True))
            part = np.full(len(ids), TaskContext.get().partitionId() % MERGE, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(item), pa.array(ids), pa.array(scores)], ["part", "item", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score, rank): lists of tasks are merged in groups first, so that none grows with the tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def _trees(texts: list[str], tree_bytes: int) -> list[list[int]]:
    """The places of the items of each tree."""
    out, held = [[]], 0
    for at, text in enumerate(texts):
        if out[-1] and held + len(text) > tree_bytes:
            out.append([])
            held = 0
        out[-1].append(at)
        held += len(text)
    return out


def _turn(rows: DataFrame, items: list, k: int, tree_bytes: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items of one turn; ``rows`` are (doc_id, text)."""
    spark = rows.sparkSession
    context = spark.sparkContext
    number: dict[bytes, int] = {}
    coded = [sorted({number.setdefault(t, len(number)) for t in text_terms(r["text"])}) for r in items]
    counted = written(rows.mapInArrow(_count(context.broadcast(number)), COUNTED), "counted")
    total = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    frequency = np.zeros(max(1, len(number)), np.int64)
    for r in counted.select("terms").mapInArrow(_holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        frequency[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    held = counted.filter("doc_id IS NOT NULL AND octet_length(terms) > 0")

    def best(of: DataFrame, tree: ItemTree, local: np.ndarray, weakest: np.ndarray) -> DataFrame:
        sent = context.broadcast((tree, local, weakest, total["documents"], max(1, total["length"])))
        return _best(of.mapInArrow(_search(sent, k), FOUND), k)

    out = None
    for places in _trees([r["text"] for r in items], tree_bytes):
        own = np.unique(np.array([t for at in places for t in coded[at]], np.int64))
        local = np.full(len(frequency), -1, np.int64)
        local[own] = np.arange(len(own))
        if not len(own):
            continue
        tree = ItemTree([local[coded[at]].tolist() for at in places], weights[own], frequency[own])
        weakest = np.zeros(len(places), np.int64)
        place = {item: at for at, item in enumerate(tree.order)}
        for r in best(held.limit(SEED), tree, local, weakest).filter(F.col("rank") == k).select("item", "score").collect():
            weakest[place[r["item"]]] = r["score"]
        ids = spark.createDataFrame([(i, items[at]["item_id"]) for i, at in enumerate(places)], "item int, item_id long")
        found = best(held, tree, local, weakest).join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def ranked_documents(docs: DataFrame, items: DataFrame, *, k: int = 50, item_bytes: int = ITEM_BYTES, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0.

    Terms are runs of ASCII letters and digits and of other characters, A-Z in lower case; scores are sums of integer
    weights over an item's terms, once each, damped by the document's length.  Equal scores come by ascending doc_id.
    NULL and empty texts have no terms: such documents are never found and do not count, such items find nothing.
    Every row is a document, every item row is ranked by itself, so rows that occur twice appear twice and in any order
    among themselves.  Documents without an id count in all statistics but are not returned.  No items or no documents:
    no rows.  The tasks get items in turns of at most ``item_bytes`` of text and one item more, in trees of ``tree_bytes``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    asked = items.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL AND text != ''").withColumn("size", F.octet_length("text"))
    size = asked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = asked.withColumn("turn", F.lit(0))
    if size > item_bytes:
        placed = with_running(asked.withColumn("all", F.lit(0)), ["all"], ["item_id", "text"], {"place": running_sum(F.col("size").cast("long"))})
        cut = written(placed.withColumn("turn", F.floor((F.col("place") - F.col("size")) / item_bytes)), "items")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in range(-(-size // item_bytes)):
        some = cut.filter(F.col("turn") == turn).select("item_id", "text").collect()
        found = _turn(rows, some, k, tree_bytes) if some else None
        out = out if found is None else out.unionByName(found)
    return out
