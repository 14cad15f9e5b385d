"""Near-duplicates by an LSH forest over MinHash signatures.

A document is its set of word shingles; equal word sequences are one node.  A node's signature has 128 minima.  Each of
32 trees orders the nodes by the signature read from another place on.  Nodes with the same first four minima are a
region of the tree.  A region of bounded size is compared as a whole; a larger one is read deeper: its nodes are cut, in
the tree's order, into runs, so that those with the longest common prefixes stand together, and each run is compared
with itself and the next.  Comparing uses signatures only and names pairs in proportion to the nodes; what it names is
confirmed on the full sets.  Two nodes with a similarity of 0.8 share a region of some tree but for a chance of
(1 - 0.8 ** 4) ** 32, 5e-8.

Where a block has too many similar pairs to name, or a region was cut into runs, its nodes form a cluster, whichever tree
they meet in.  The nodes outside a cluster's largest component are compared with all nodes of the cluster, block by block;
what is alike is confirmed inside the block, and only links that join components come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordinal, running_sum, with_running
from .base import fresh, join_by_key, written

MINIMA, DEPTH = 128, 4
TREES = MINIMA // DEPTH
#: Nodes of a region that are compared as one block; larger regions are cut into runs of half as many.
BLOCK = 2048
#: Agreeing minima, of 128, from which a pair is confirmed: at a similarity of 0.8 fewer agree once in a million.
ALIKE = 78
#: Pairs named per node of a block; the nodes of a block with more are a cluster.
NAMED = 4
#: Nodes of a cluster in one block, and as many outside its largest component.
RUN = 512

_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1))[None, :]
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[None, :]
NODES = "doc_id long, key binary, n_shingles long, signature binary, text binary"


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingle_set(words: list[bytes], length: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; fewer words than ``length`` are one shingle."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    hashes = np.array([known[w] for w in words], np.uint64)
    size = min(length, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, np.uint64(size))
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minima, each as 16 bits of a hash of the smallest."""
    small = np.full(MINIMA, np.uint32(0xFFFFFFFF))
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 2048):
        small = np.minimum(small, (folded[at : at + 2048, None] * _A + _B).min(axis=0))
    return ((small * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2")


def _nodes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text_words(text)
                if not words:
                    rows.append((doc_id, None, 0, None, None))
                    continue
                joined = b" ".join(words)
                shingles = shingle_set(words, length)
                rows.append((doc_id, hashlib.blake2b(joined, digest_size=16).digest(), len(shingles), signature(shingles).tobytes(), pack(joined)))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "key", "n_shingles", "signature", "text"])

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, node) of every tree: the tree's number and its first four minima, as two longs."""
    for batch in batches:
        nodes = np.array(batch.column(0).to_pylist(), np.int64)
        minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, TREES, DEPTH)
        region = np.ascontiguousarray(minima).view("<i8").reshape(-1, TREES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(nodes))), pa.array(region.ravel()), pa.array(np.repeat(nodes, TREES))], ["tree", "region", "node"]
        )


LINKS = "a long, b long, alike int"


def _agreeing(signatures: np.ndarray) -> np.ndarray:
    """(groups, m, m) numbers of agreeing minima; the diagonal is 0."""
    groups, m, _ = signatures.shape
    out = np.zeros((groups, m, m), np.int32)
    for i in range(m - 1):
        out[:, i, i + 1 :] = (signatures[:, i, None, :] == signatures[:, i + 1 :, :]).sum(-1)
    return out + out.transpose(0, 2, 1)


def _name_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similar pairs of blocks that come one after the other.

    A block with too many names the best of each node, and ties its similar nodes together by pairs without a number.
    Rows are (tree, region, block, node, minima as bytes), sorted by block.  Blocks of one size are compared together.
    """
    left: pa.Table | None = None

    def named(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, region, block, node = (rows.column(c).to_numpy() for c in ("tree", "region", "block", "node"))
        codes = np.frombuffer(b"".join(rows.column("minima").to_pylist()), np.uint8).reshape(-1, MINIMA)
        new = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (region[1:] != region[:-1]) | (block[1:] != block[:-1])]))
        sizes = np.diff(np.append(new, len(node)))
        for m in np.unique(sizes[sizes > 1]).tolist():
            starts = new[sizes == m]
            step = max(1, (1 << 24) // (m * m * MINIMA) or 1)
            for at in range(0, len(starts), step):
                places = starts[at : at + step, None] + np.arange(m)
                alike = _agreeing(codes[places])
                enough = alike >= ALIKE
                dense = np.triu(enough).reshape(len(places), -1).sum(1) > NAMED * m
                g, i, j = np.nonzero(np.triu(enough) & ~dense[:, None, None])
                best_g, best_i = np.nonzero(enough.any(2) & dense[:, None])
                best_j = alike[best_g, best_i].argmax(1) if len(best_g) else best_i
                g, i, j = np.append(g, best_g), np.append(i, best_i), np.append(j, best_j)
                tied_g, tied_i = np.nonzero(enough.any(2) & dense[:, None])
                head = places[tied_g, enough.any(2)[tied_g].argmax(1)]
                a, b = np.append(node[places[g, i]], node[head]), np.append(node[places[g, j]], node[places[tied_g, tied_i]])
                number = np.append(alike[g, i, j], np.zeros(len(head), np.int64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(number)], ["a", "b", "alike"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left, rows]) if left is not None and left.num_rows else rows
        if not rows.num_rows:
            continue
        last = [rows.column(c)[-1].as_py() for c in ("tree", "region", "block")]
        same = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(("tree", "region", "block"), last, strict=True)])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from named(rows.slice(0, cut))
        left = rows.slice(cut)
    if left is not None and left.num_rows:
        yield from named(left)


def _pack_set(shingles: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(shingles, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes())


def _unpack_set(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.cumsum(raw.reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _sets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            sets = [_pack_set(shingle_set(zstandard.ZstdDecompressor().decompress(t).split(b" "), length)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two = (c.to_pylist() for c in batch.columns)
            good = [_linked(_unpack_set(x), _unpack_set(y), percent) for x, y in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return run


def _confirm_block(percent: int):
    """The links that join components inside a block, found on full sets; at most one fewer than its nodes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").reset_index(drop=True)
        codes = np.frombuffer(b"".join(rows["minima"]), np.uint8).reshape(-1, MINIMA)
        alike = _agreeing(codes[None])[0]
        nodes, sets, found = rows["node"].tolist(), [_unpack_set(s) for s in rows["shingles"]], []
        group = {c: c for c in rows["component"]}

        def top(c: int) -> int:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        own = rows["component"].tolist()
        i, j = np.nonzero(np.triu(alike >= ALIKE))
        for k in np.argsort(-alike[i, j], kind="stable").tolist():
            x, y = top(own[i[k]]), top(own[j[k]])
            if x != y and _linked(sets[i[k]], sets[j[k]], percent):
                group[max(x, y)] = min(x, y)
                found.append((min(nodes[i[k]], nodes[j[k]]), max(nodes[i[k]], nodes[j[k]])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _blocks(nodes: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (tree, region, block, node) of all regions with two nodes or more, and the runs of the larger ones.

    In a larger region block 2k is run k with the run after it, so neighbours in the tree's order always meet.
    """
    rows = nodes.select("node", "signature").mapInArrow(_regions, "tree int, region long, node long")
    sizes = rows.groupBy("tree", "region").count().filter("count > 1")
    shared = written(rows.join(sizes, ["tree", "region"]), "regions")
    small = shared.filter(F.col("count") <= block).select("tree", "region", F.lit(0).cast("long").alias("block"), "node")
    large = shared.filter(F.col("count") > block)
    if large.isEmpty():
        return small, None
    # the tree's order: the signature from the tree's own place on
    deep = large.join(nodes.select("node", F.concat("signature", "signature").alias("twice")), "node").select(
        "tree", "region", "node", F.expr(f"substring(twice, tree * {2 * DEPTH} + 1, {2 * MINIMA})").alias("label")
    )
    placed = with_running(written(deep, "deep"), ["tree", "region"], ["label", "node"], {"place": ordinal()})
    runs = written(placed.select("tree", "region", "node", F.floor((F.col("place") - 1) / (block // 2)).alias("run")), "runs")
    near = runs.select("tree", "region", F.explode(F.array(F.col("run"), F.col("run") - 1)).alias("block"), "node").filter("block >= 0")
    return small.unionByName(near), runs


def _joined(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node with a link; components are named by their smallest node.

    Every round a node takes the smallest name among its neighbours', and then the name that the node so named has, so
    names travel far in few rounds.  After a given number of rounds nodes of one name are linked, but not all that are
    linked have one name yet.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links", narrow=True)
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "names", narrow=True)
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        near = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        named = state.select(F.col("node").alias("component"), F.col("component").alias("further"))
        following = state.join(named, "component", "left").join(near, "node").select(
            "node", F.least("component", "further", "near").alias("component"), (F.least("further", "near") < F.col("component")).alias("moved")
        )
        following = written(following, "names", narrow=True)
        state = following.drop("moved")
        if following.filter("moved").isEmpty():
            break
    return state


def _labelled(nodes: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node."""
    found = _joined(links, rounds).withColumnRenamed("component", "c")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    one, two = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").filter("ca <> cb").drop("ca", "cb")


def _cluster_blocks(ties: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, run, chunk, node, component): each run of a cluster's nodes with each chunk of those outside its largest component.

    Clusters within one component have nothing left to find.
    """
    held = _joined(ties).withColumnRenamed("component", "cluster").join(labels, "node")
    shares = held.groupBy("cluster", "component").count()
    largest = shares.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("several")).filter("several > 1")
    held = written(held.join(largest, "cluster").select("cluster", "node", "component", (F.col("component") != F.col("largest")).cast("long").alias("outside")), "clusters", narrow=True)
    placed = written(with_running(held, ["cluster"], ["node"], {"place": ordinal(), "minor": running_sum(F.col("outside"))}), "placed")
    runs = placed.withColumns({"run": F.floor((F.col("place") - 1) / RUN), "chunk": F.floor((F.col("minor") - 1) / RUN)})
    ends = placed.groupBy("cluster").agg(F.floor((F.max("place") - 1) / RUN).alias("last_run"), F.floor((F.max("minor") - 1) / RUN).alias("last_chunk"))
    runs = runs.join(ends, "cluster")
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    whole = runs.select("cluster", "run", upto(F.col("last_chunk")).alias("chunk"), "node", "component")
    minor = runs.filter("outside = 1").select("cluster", upto(F.col("last_run")).alias("run"), "chunk", "node", "component")
    return whole.unionByName(minor)


def _alike_across(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a block that are alike to one of another component."""
    rows = rows.drop_duplicates("node")
    codes = np.frombuffer(b"".join(rows["minima"]), np.uint8).reshape(-1, MINIMA)
    own = rows["component"].to_numpy()
    apart = (_agreeing(codes[None])[0] >= ALIKE) & (own[:, None] != own[None, :])
    return rows.loc[apart.any(1), ["cluster", "run", "chunk", "node", "component"]]


def _linked_rows(read: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """(row, doc_id, n_shingles, component) of every row of ``read``; the component is NULL for texts without words."""
    byte = F.expr(f"unhex(array_join(transform(sequence(1, {4 * MINIMA}, 4), i -> substring(hex(signature), i, 2)), ''))")
    # all copies of a text have one key, which may have any share of the rows
    nodes = written(read.filter("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("copies")), "keys", narrow=True)
    rows = read.select("row", "doc_id", "key", "n_shingles")
    keyed = join_by_key(rows.filter("key IS NOT NULL"), nodes, "key", "copies", read.count()).select("row", "doc_id", "n_shingles", "node")
    wordless = rows.filter("key IS NULL").select("row", "doc_id", "n_shingles", F.lit(None).cast("long").alias("node"))
    member = written(keyed.unionByName(wordless), "members")
    signed = written(
        read.select(F.col("row").alias("node"), "signature").join(member.filter("row = node").select("node"), "node").withColumn("minima", byte), "signed"
    )
    blocks, runs = _blocks(signed, block)
    dealt = blocks.join(signed.select("node", "minima"), "node").repartition("tree", "region", "block").sortWithinPartitions("tree", "region", "block", "node")
    named = written(dealt.select("tree", "region", "block", "node", "minima").mapInArrow(_name_pairs, LINKS), "named")
    ties = named.filter("alike = 0").select("a", "b")
    if runs is not None:
        first = runs.groupBy("tree", "region").agg(F.min("node").alias("a"))
        ties = ties.unionByName(runs.join(first, ["tree", "region"]).select("a", F.col("node").alias("b")))
    pairs = written(named.filter("alike > 0").groupBy("a", "b").agg(F.max("alike").alias("alike")), "pairs", narrow=True)

    texts = read.select(F.col("row").alias("node"), "text")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return texts.join(wanted.select("node").distinct(), "node").mapInArrow(_sets(shingle), "node long, shingles binary")

    def confirmed(some: DataFrame) -> DataFrame:
        ends = some.select(F.explode(F.array("a", "b")).alias("node"))
        sets = written(sets_of(ends), "sets")
        both = some.select("a", "b").join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b")
        return written(both.select("a", "b", "one", "two").mapInArrow(_confirm(percent), "a long, b long, linked boolean"), "confirmed", narrow=True)

    # the most similar neighbour of every node first: that settles most components with one pair a node
    best = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "alike").groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("alike", "a", "b")).alias("p"))
    tested = confirmed(best.select("p.a", "p.b").distinct())
    links = tested.filter("linked").select("a", "b")
    # two rounds tell enough: they only spare pairs within a component
    labels = written(_labelled(signed, links, rounds=2), "labels", narrow=True)
    more = confirmed(_across(pairs.select("a", "b"), labels).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    links = links.unionByName(more.filter("linked").select("a", "b"))
    labels = written(_labelled(signed, links), "labels", narrow=True)
    if not ties.isEmpty():
        block_of = ["cluster", "run", "chunk"]
        near = _cluster_blocks(ties.filter("a <> b").distinct(), labels).join(signed.select("node", "minima"), "node")
        alike = written(near.groupBy(*block_of).applyInPandas(_alike_across, "cluster long, run long, chunk long, node long, component long"), "alike")
        whole = alike.join(written(sets_of(alike), "sets"), "node").join(signed.select("node", "minima"), "node")
        joined = written(whole.groupBy(*block_of).applyInPandas(_confirm_block(percent), "a long, b long"), "joined", narrow=True)
        labels = written(_labelled(signed, links.unionByName(joined.distinct())), "labels", narrow=True)
    return member.join(labels, "node", "left").select("row", "doc_id", "n_shingles", "component")


def duplicate_components(docs: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Texts are linked if they share ``percent`` of their shingles of ``shingle`` words, A-Z in lower case; ``component_id``
    is the smallest id that links lead to.  NULL and empty texts, and texts without words, have no shingles and are linked
    with nothing.  Rows with equal texts are linked; repeated rows each appear.  A NULL id counts as none: such a row is
    linked as any other, its component may have no id, and it is kept if so.  No rows give none.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    read = written(rows.mapInArrow(_nodes(shingle), NODES).withColumn("row", F.monotonically_increasing_id()), "nodes")
    placed = _linked_rows(read, shingle, percent, block)
    smallest = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    found = placed.join(smallest, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def unique_documents(docs: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row of each group of linked texts, the one with the smallest doc_id, with all its columns.

    Repeated rows are one group; of rows with one id the first stays, and a row without id only where none has one.
    Texts without words are in no group and all stay.
    """
    row = fresh(docs, "row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    ids = held.select(F.col(row).alias("doc_id"), "text").mapInArrow(_nodes(shingle), NODES)
    read = written(ids.withColumn("row", F.col("doc_id")), "nodes")
    placed = _linked_rows(read, shingle, percent, block).select("row", "component").join(held.select(F.col(row).alias("row"), "doc_id"), "row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min_by("row", order).alias("row")).select("row")
    stay = first.unionByName(placed.filter("component IS NULL").select("row")).withColumnRenamed("row", row)
    return held.join(stay, row, "left_semi").drop(row)
