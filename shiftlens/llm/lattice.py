"""Near-duplicate embeddings by lattice hashing.

A table projects a vector by Gaussian directions to blocks of eight coordinates and decodes each block to the nearest
point of the E8 lattice; the points of all blocks name a cell.  A vector stands in its own cell and in the neighbouring
cells that it is closest to, so two vectors meet where any of these agree.  A pair at a cosine of 0.95 meets in a table
of three blocks with a chance of 0.46, one of 0.985 with 0.87; vectors that have nothing to do with each other meet with
a chance of about 1e-6.  Blocks grow with the logarithm of the rows and tables double with each block, so that both the
share of pairs found and the number of chance meetings stay.

Meeting vectors whose 32 signs of further projections are alike fall into one group, and inside a group cosines are
computed for all pairs, block by block, in double precision; a block gives counts and the links that join components,
never its pairs.  A group larger than a block has a core: vectors within half the link's angle of the mean direction,
which are all linked with each other without looking.  Only what is outside the core is compared with the group, so a
large tight cluster takes work in proportion to its vectors; a large loose one takes (outside) x (all).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordinal, running_sum, with_running
from .base import join_by_key, written
from .forest import _joined

#: Size of the lattice in standard deviations of a projected coordinate, and neighbouring cells probed in each table.
SPREAD, PROBES = 2.0, 4
#: Chance, one in so many, that unrelated vectors agree in a block.
APART = 91
#: Signs of a sketch, and how many may differ between vectors of a group: at a cosine of 0.95 more do once in a thousand.
SIGNS, DIFFERING = 32, 9
#: Vectors of a cell whose sketches are compared; all vectors of a larger cell are one group.
CELL = 1024
#: Vectors on each side of a compared block.
RUN = 1024
#: Cells that are taken as hot, at most.
HOT = 4096
#: Share of the vectors, one in so many, that tells which cells are hot.
SAMPLE = 16


def table_counts(rows: int) -> tuple[int, int]:
    """(blocks, tables) for so many vectors."""
    blocks = max(2, math.ceil(math.log(max(rows, 2)) / math.log(APART)))
    return blocks, 2**blocks


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """Whole numbers with an even sum: where rounding gives an odd one, the worst rounded coordinate goes the other way."""
    point = np.rint(y)
    off = y - point
    worst = np.abs(off).argmax(-1)[..., None]
    odd = point.sum(-1).astype(np.int64)[..., None] & 1
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * odd
    np.put_along_axis(point, worst, np.take_along_axis(point, worst, -1) + step, -1)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 moved by a half in every coordinate."""
    whole, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(-1) <= ((y - half) ** 2).sum(-1))[..., None], whole, half)


def neighbours(y: np.ndarray, point: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(further, point) for the two nearest neighbours of ``point`` that y leans to, one of either kind of root.

    Roots are two coordinates moved by one, or all by a half with an even number of minus signs; ``further`` is by how
    much the squared distance grows.
    """
    off = y - point
    sign, size = np.where(off >= 0, 1.0, -1.0), np.abs(off)
    order = np.argsort(-size, -1)
    two = np.zeros_like(off)
    np.put_along_axis(two, order[..., :2], np.take_along_axis(sign, order[..., :2], -1), -1)
    least, odd = order[..., 7:], ((sign < 0).sum(-1) & 1)[..., None]
    eight = sign / 2
    np.put_along_axis(eight, least, np.take_along_axis(eight, least, -1) * (1 - 2 * odd), -1)
    return [(2 - 2 * (off * root).sum(-1), point + root) for root in (two, eight)]


class Lattice:
    """The tables for vectors of one length."""

    def __init__(self, size: int, blocks: int, tables: int):
        rng = np.random.default_rng([size, blocks, tables])
        self.shape = (tables, blocks, 8)
        self.directions = rng.standard_normal((size, tables * blocks * 8 + SIGNS))
        self.odd = rng.integers(0, 1 << 62, self.shape, dtype=np.int64) | 1
        self.start = rng.integers(0, 1 << 62, tables, dtype=np.int64)

    def _mixed(self, point: np.ndarray) -> np.ndarray:
        """A number per block; a cell is named by the sum over its blocks."""
        h = ((2 * point).astype(np.int64) * self.odd).sum(-1)
        return (h ^ (h >> 29)) * np.int64(0x2545F4914F6CDD1D)

    def read(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, sketches) of unit vectors: a row of 1 + PROBES cells per table, and 32 signs as one number."""
        projected = unit @ self.directions
        sketch = np.packbits(projected[:, -SIGNS:] >= 0, axis=1).view(">u4").ravel().astype(np.int64)
        y = projected[:, :-SIGNS].reshape(-1, *self.shape) / SPREAD
        point = nearest_e8(y)
        own = self._mixed(point)
        found = neighbours(y, point)
        further = np.stack([f for f, _ in found], -1).reshape(*own.shape[:2], -1)
        change = np.stack([self._mixed(p) - own for _, p in found], -1).reshape(further.shape)
        order = np.argsort(further, -1)
        further, change, block = np.take_along_axis(further, order, -1), np.take_along_axis(change, order, -1), order // 2
        # one block moved, or two different ones
        cost, moved = [further[..., i] for i in range(further.shape[-1])], [change[..., i] for i in range(further.shape[-1])]
        for i, j in itertools.combinations(range(4), 2):
            cost.append(np.where(block[..., i] != block[..., j], further[..., i] + further[..., j], np.inf))
            moved.append(change[..., i] + change[..., j])
        best = np.argsort(np.stack(cost, -1), -1)[..., :PROBES]
        home = own.sum(-1)[..., None] + self.start[:, None]
        cells = np.concatenate([home, home + np.take_along_axis(np.stack(moved, -1), best, -1)], -1)
        return cells.reshape(len(unit), -1), sketch


def _packed(vector: np.ndarray) -> bytes:
    """Doubles, or floats where they say the same."""
    short = vector.astype("<f4")
    return b"4" + short.tobytes() if (short.astype(np.float64) == vector).all() else b"8" + vector.astype("<f8").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<f{packed[:1].decode()}", offset=1).astype(np.float64)


def _units(packed: list[bytes]) -> np.ndarray:
    vectors = np.stack([_unpacked(p) for p in packed])
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # squares of very large or small numbers would be lost
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_size(packed: list[bytes]) -> list[np.ndarray]:
    """Places of vectors of one length, for each length."""
    sizes = np.array([(len(p) - 1) // int(p[:1]) for p in packed])
    return [np.flatnonzero(sizes == s) for s in np.unique(sizes)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, vector); no key where there is no direction."""
    for batch in batches:
        keys, vectors = [], []
        for entry in batch.column(1):
            packed = None
            if entry.is_valid and entry.values.null_count == 0:
                vector = entry.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no minus zero
                if np.isfinite(vector).all() and vector.any():
                    packed = _packed(vector)
            vectors.append(packed)
            keys.append(packed and hashlib.blake2b(packed, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "key", "vector"])


ENTRIES = "cell long, node long, sketch long, head long"


def _entries(blocks: int, tables: int, heads: dict[int, int]):
    """A row for every cell of a vector; ``head`` is a vector of the same cell, for the hot cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        hot = np.array(sorted(heads), np.int64)
        head_of = np.array([heads[c] for c in sorted(heads)] + [0], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                packed, nodes = part.column(1).to_pylist(), part.column(0).to_numpy()
                for places in _by_size(packed):
                    unit = _units([packed[i] for i in places])
                    lattice = lattices.setdefault(unit.shape[1], None) or Lattice(unit.shape[1], blocks, tables)
                    lattices[unit.shape[1]] = lattice
                    cells, sketch = lattice.read(unit)
                    flat, each = cells.ravel(), cells.shape[1]
                    near = np.searchsorted(hot, flat)
                    known = np.isin(flat, hot)
                    columns = [
                        pa.array(flat), pa.array(np.repeat(nodes[places], each)), pa.array(np.repeat(sketch, each)),
                        pa.array(head_of[np.where(known, near, -1)], mask=~known),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "node", "sketch", "head"])

    return run


def _streamed(columns: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]):
    """Rows sorted by ``columns`` in runs of whole groups; ``work`` gets rows and the places where groups start."""

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in columns:
            values = rows.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([left, rows]) if left is not None else rows
            if not rows.num_rows:
                continue
            found = starts(rows)
            if found[-1]:
                yield from work(rows.slice(0, int(found[-1])), found[:-1])
            left = rows.slice(int(found[-1]))
        if left is not None and left.num_rows:
            yield from work(left, np.zeros(1, np.int64))

    return run


def _least_labels(alike: np.ndarray) -> np.ndarray:
    """(groups, m, m) of symmetric relations to the smallest place that each place is connected with."""
    m = alike.shape[1]
    label = np.broadcast_to(np.arange(m), alike.shape[:2]).copy()
    while True:
        near = np.minimum(label, np.where(alike, label[:, None, :], m).min(2))
        near = np.take_along_axis(near, near, 1)
        if (near == label).all():
            return label
        label = near


def _met(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs that connect the vectors of a cell with like sketches, at most one per vector."""
    node, sketch = rows.column("node").to_numpy(), rows.column("sketch").to_numpy().astype(np.uint32)
    sizes = np.diff(np.append(starts, len(node)))
    a, b = [], []
    for m in np.unique(sizes[sizes > 1]).tolist():
        first = starts[sizes == m]
        if m > CELL:
            for s in first:
                a.append(np.full(m - 1, node[s]))
                b.append(node[s + 1 : s + m])
            continue
        step = max(1, (1 << 21) // (m * m))
        for at in range(0, len(first), step):
            places = first[at : at + step, None] + np.arange(m)
            alike = np.bitwise_count(sketch[places][:, :, None] ^ sketch[places][:, None, :]) <= DIFFERING
            label = _least_labels(alike)
            g, i = np.nonzero(label != np.arange(m))
            a.append(node[places[g, label[g, i]]])
            b.append(node[places[g, i]])
    one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _streamed(["cell"], _met)(batches)


ASKS, ANSWERS, CREDITED = 1, 2, 4
COMPARED = "node long, links long, a long, b long"


def _compare(least: float):
    """Per block the links of the vectors that ask, and of those credited, by weight; and pairs that connect what is linked."""

    def work(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, weight, role = (rows.column(c).to_numpy() for c in ("node", "weight", "role"))
        packed = rows.column("vector").to_pylist()
        nodes, links, one, two = [], [], [], []
        for start, stop in itertools.pairwise([*starts.tolist(), len(node)]):
            for places in _by_size(packed[start:stop]):
                at = start + places
                unit = _units([packed[i] for i in at])
                ask, answer = np.flatnonzero(role[at] & ASKS), np.flatnonzero(role[at] & ANSWERS)
                if not len(ask) or not len(answer):
                    continue
                linked = (unit[ask] @ unit[answer].T >= least) & (node[at[ask]][:, None] != node[at[answer]][None, :])
                nodes += [node[at[ask]], node[at[answer]]]
                links += [linked @ weight[at[answer]], np.where(role[at[answer]] & CREDITED, weight[at[ask]] @ linked, 0)]
                # the smallest node that each one's links lead to, within the block
                x, y = node[at[ask]].copy(), node[at[answer]].copy()
                top = np.iinfo(np.int64).max
                while True:
                    x2 = np.minimum(x, np.where(linked, y[None, :], top).min(1))
                    y2 = np.minimum(y, np.where(linked, x2[:, None], top).min(0))
                    if (x2 == x).all() and (y2 == y).all():
                        break
                    x, y = x2, y2
                one += [x, y]
                two += [node[at[ask]], node[at[answer]]]
        nodes, links, one, two = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in (nodes, links, one, two))
        some = (links > 0) | (one != two)
        columns = [pa.array(c[some]) for c in (nodes, links, one, two)]
        yield pa.RecordBatch.from_arrays(columns, ["node", "links", "a", "b"])

    return _streamed(["group", "run", "chunk"], work)


def _direction_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of each group, per batch."""
    for batch in batches:
        packed, group = batch.column(1).to_pylist(), batch.column(0).to_numpy()
        for places in _by_size(packed):
            order = places[np.argsort(group[places], kind="stable")]
            first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            sums = np.add.reduceat(_units([packed[i] for i in order]), first, axis=0)
            count, size = sums.shape
            columns = [pa.array(np.repeat(group[order][first], size)), pa.array(np.tile(np.arange(size, dtype=np.int32), count)), pa.array(sums.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["group", "at", "part"])


def _in_core(half: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for packed, mean in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                unit, middle = _units([packed])[0], np.array(mean)
                length = np.linalg.norm(middle)
                # a little less than half the angle, so that rounding links nothing that is not
                flags.append(bool(len(middle) == len(unit) and length > 0 and unit @ middle >= (half + 1e-9) * length))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(flags, pa.bool_())], ["group", "node", "weight", "vector", "core"])

    return run


def _compared_blocks(grouped: DataFrame, sizes: DataFrame, total: int, least: float) -> tuple[DataFrame, DataFrame | None]:
    """(blocks of rows to compare, nodes of cores).  ``grouped``: (group, node, weight, vector) of groups of two or more."""
    block = ["group", "run", "chunk", "node", "weight", "vector", "role"]
    at = lambda name, value: F.lit(value).cast("long").alias(name)
    held = written(join_by_key(grouped, sizes, "group", "members", total), "grouped")
    small = held.filter(F.col("members") <= RUN).select("group", at("run", 0), at("chunk", 0), "node", "weight", "vector", F.lit(ASKS | ANSWERS).alias("role"))
    large = held.filter(F.col("members") > RUN).select("group", "node", "weight", "vector")
    if large.isEmpty():
        return small.select(*block), None
    parts = large.select("group", "vector").mapInArrow(_direction_sums, "group long, at int, part double").groupBy("group", "at").agg(F.sum("part").alias("part"))
    mean = parts.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("mean")).join(sizes, "group")
    half = math.sqrt((1 + least) / 2)
    cored = join_by_key(large, written(mean, "means", narrow=True), "group", "members", total).select("group", "node", "weight", "vector", "mean")
    cored = written(cored.mapInArrow(_in_core(half), "group long, node long, weight long, vector binary, core boolean"), "cored")
    outside = (~F.col("core")).cast("long")
    placed = written(with_running(cored.select("group", "node", outside.alias("outside")), ["group"], ["node"], {"place": ordinal(), "outer": running_sum(F.col("outside"))}), "placed")
    number = lambda c: F.floor((F.col(c) - 1) / RUN)
    ends = placed.groupBy("group").agg(F.max(number("place")).alias("last_run"), F.max(number("outer")).alias("last_chunk")).join(sizes, "group")
    runs = placed.select("node", number("place").alias("run"), number("outer").alias("chunk"))
    whole = join_by_key(cored.join(runs, "node"), written(ends, "ends", narrow=True), "group", "members", total)
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    answer = F.when(F.col("core"), ANSWERS | CREDITED).otherwise(ANSWERS).alias("role")
    answers = whole.filter("last_chunk >= 0").select("group", "run", upto(F.col("last_chunk")).alias("chunk"), "node", "weight", "vector", answer)
    asks = whole.filter("NOT core").select("group", upto(F.col("last_run")).alias("run"), "chunk", "node", "weight", "vector", F.lit(ASKS).alias("role"))
    cores = written(cored.filter("core").select("group", "node", "weight"), "cores", narrow=True)
    return small.select(*block).unionByName(answers.select(*block)).unionByName(asks.select(*block)), cores


def linked_vectors(embeddings: DataFrame, *, least: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are linked where their cosine is ``least`` or more; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id that links lead to.  Vectors that are NULL, empty, zero, or hold NULL or non-finite
    components are linked with nothing, vectors of different lengths not with each other.  Rows with equal vectors are
    linked; a NULL id counts as none: such a row is linked as any other, its component may have no id, and it is kept if
    so.  Rows that occur twice are two vectors.  No rows give none.
    """
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    read = written(rows.mapInArrow(_read, "vec_id long, key binary, vector binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = read.count()
    # one node per distinct vector
    nodes = written(
        read.filter("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("smallest"), F.first("vector").alias("vector")),
        "nodes",
    )
    blocks, tables = table_counts(nodes.count())
    given = nodes.select("node", "vector")
    some = given.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).mapInArrow(_entries(blocks, tables, {}), ENTRIES)
    counted = some.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter(f"n >= {CELL // SAMPLE}")
    heads = {r["cell"]: r["head"] for r in counted.orderBy(F.desc("n")).limit(HOT).collect()}  # others are only dealt by their cell
    entries = given.mapInArrow(_entries(blocks, tables, heads), ENTRIES)
    dealt = entries.filter("head IS NULL").repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_meetings, "a long, b long")
    met = dealt if not heads else dealt.unionByName(entries.filter("head <> node").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")))
    groups = _joined(written(met.distinct(), "met", narrow=True)).withColumnRenamed("component", "group")
    groups = written(groups, "groups", narrow=True)
    sizes = written(groups.groupBy("group").agg(F.count("*").alias("members")), "sizes", narrow=True)
    grouped = groups.join(nodes.select("node", "weight", "vector"), "node").select("group", "node", "weight", "vector")
    compared, cores = _compared_blocks(grouped, sizes, total, least)
    found = written(compared.repartition("group", "run", "chunk").sortWithinPartitions("group", "run", "chunk", "node").mapInArrow(_compare(least), COMPARED), "compared", narrow=True)
    links, edges = found.select("node", "links"), found.filter("a <> b").select("a", "b")
    if cores is not None:
        core = written(cores.groupBy("group").agg(F.sum("weight").alias("in_core"), F.min("node").alias("first"), F.count("*").alias("members")), "core", narrow=True)
        certain = join_by_key(cores, core, "group", "members", total)
        links = links.unionByName(certain.select("node", (F.col("in_core") - F.col("weight")).alias("links")))
        edges = edges.unionByName(certain.filter("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")))
    links = links.groupBy("node").agg(F.sum("links").alias("links"))
    labels = _joined(written(edges.distinct(), "edges", narrow=True))
    # per node: its links, and the smallest id of its component
    plain = nodes.select("node", "weight", "smallest", "key").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    plain = written(plain.join(links, "node", "left").select("component", "weight", "smallest", "key", F.coalesce("links", F.lit(0)).alias("links")), "plain")
    component = written(plain.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count("*").alias("members")), "components", narrow=True)
    known = join_by_key(plain, component, "component", "members", total).select("key", "weight", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    known = written(known, "known")
    placed = join_by_key(read.filter("key IS NOT NULL").select("key", "vec_id"), known, "key", "weight", total).select("vec_id", "n_links", "component_id")
    alone = read.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
