"""Bound-certified best-fit packing of tokenised documents into sequences.

Pieces are dealt to partitions of a bounded number of pieces, and each is packed best-fit decreasing.
Dual feasible functions bound from below how many sequences a partition can need, and all pieces together.
A partition that meets its bound is certified and gives up its emptiest sequence only; one with a gap gives up
every sequence with room.  What is given up is dealt anew, so that partitions exchange documents, and packed
again, until the total meets the bound of the whole or another exchange no longer saves a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written
from .tokens import default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"row long, {PIECES}, part long, bin long, offset long, room long, bins long, bound long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, pieces, starts, lengths, sums = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    names.append(doc_id)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, capacity: int, *, tokenizer: str | None = None, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids; only a document that is longer has more than one.

    A NULL or empty text is its end id alone.  Equal rows give equal pieces, each a piece of its own.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_cut(tokenizer or default_tokenizer(), end_id, capacity), PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of sequences that ``counts[length]`` pieces need at least, by two families of dual feasible functions."""
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    # pieces over capacity - e count whole, those under e nothing, the rest by length
    amount, number = np.cumsum(counts * lengths), np.cumsum(counts)
    e = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e]
    middle = amount[capacity - e] - amount[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    # steps of 1/k: a piece counts floor((k + 1) x) / k, or x itself where (k + 1) x is whole
    for k in range(1, 65):
        scaled = (k + 1) * lengths
        steps = np.where(scaled % capacity == 0, k * lengths, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * steps).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, room left in it at the end) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, rooms = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied = 0  # bit r: some open bin has room r
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = occupied >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = open_by_room[room].pop()
            if not open_by_room[room]:
                occupied &= ~(1 << room)
        else:
            room, chosen = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = chosen, capacity - room
        left = rooms[chosen] = room - length
        if left:
            open_by_room[left].append(chosen)
            occupied |= 1 << left
    return bins, offsets, np.array(rooms, np.int64)[bins] if len(lengths) else bins


def _pack_part(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return rows.assign(bin=bins, offset=offsets, room=room, bins=int(bins.max()) + 1, bound=bound)[
            ["row", "doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "room", "bins", "bound"]
        ]

    return run


def pack_pieces(pieces: DataFrame, capacity: int, *, per_part: int = 1 << 16, rounds: int = 12) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    ``per_part`` bounds the pieces of a packing task, ``rounds`` the exchanges.  No pieces: no rows.
    """
    pool = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = pool.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, number in histogram:
        counts[length] = number
    waiting, target, kept, taken = int(counts.sum()), lower_bound(counts, capacity), [], None
    settled, before = 0, None
    for turn in range(rounds if waiting else 0):
        parts = -(-waiting // per_part)
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)).cast("long"))
        packed = written(dealt.groupBy("part").applyInPandas(_pack_part(capacity), PACKED), "packed")
        bins = packed.agg(F.sum(F.when(F.col("offset") == 0, 1))).first()[0]
        if before is not None and bins >= before:
            break  # the sequences of the round before stay
        numbered = packed.withColumn(
            "sequence_id", F.shiftleft(F.lit(turn).cast("long"), 56) + F.shiftleft("part", 20) + F.col("bin")
        )
        emptiest = packed.groupBy("part").agg(F.max(F.struct("room", "bin")).alias("emptiest"))
        marked = numbered.join(emptiest, "part").withColumn(
            "out", (F.col("room") > 0) & ((F.col("bins") > F.col("bound")) | (F.col("bin") == F.col("emptiest.bin")))
        )
        if settled + bins <= target:
            kept.append(numbered)
            taken = None
            break
        stay, out = marked.filter("NOT out"), marked.filter("out")
        size = out.agg(F.count("*").alias("n"), F.sum(F.when(F.col("offset") == 0, 1)).alias("bins")).first()
        taken = (out, )
        kept.append(stay)
        settled, before, waiting = settled + bins - (size["bins"] or 0), size["bins"], size["n"]
        if parts == 1 or not waiting:
            break
        pool = out.select("row", *[c.split()[0] for c in PIECES.split(", ")])
    if taken is not None:
        kept.append(taken[0])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not kept:
        return pieces.sparkSession.createDataFrame([], f"{PIECES}, sequence_id long, offset long").select(*columns)
    out = kept[0].select(*columns)
    for more in kept[1:]:
        out = out.unionByName(more.select(*columns))
    return out


def pack_documents(docs: DataFrame, *, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, per_part: int = 1 << 16) -> DataFrame:
    """Tokenise, cut and pack; every document ends with ``end_id``."""
    return pack_pieces(token_pieces(docs, capacity, tokenizer=tokenizer, end_id=end_id), capacity, per_part=per_part)
