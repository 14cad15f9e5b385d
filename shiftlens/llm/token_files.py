"""Token ids in word-aligned Simple-8b files.

A file is a Parquet table that Spark commits; a row is a segment of whole documents in ascending order.
Its ids lie in blocks of 128.  A block is a row of 64-bit words: four bits of selector, sixty of data.
Selectors 0 to 13 hold 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of equal width; selector 15 is an
escape whose data is a place in the segment's list of ids of over 60 bits.  ``block_offsets`` has the first word
of every block, so any block, or all of them at once, can be decoded without reading what stands before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import written
from .tokens import default_tokenizer, encoder

BLOCK = 128
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
#: A segment is closed once it has this many ids; one longer document is a segment of its own.
SEGMENT_IDS = 1 << 19

SEGMENTS = (
    "part int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, "
    "block_offsets binary, words binary, escapes binary"
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets, escapes) of unsigned ids.

    All blocks advance together: each takes, at its place, the selector that holds the most of the ids left.
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), ids
    # most[i] is the bit width of the widest of the ``count`` ids from i on; past the block nothing fits
    bits = np.searchsorted(1 << np.arange(64, dtype=np.uint64), ids, side="right").astype(np.uint8)
    most = np.full((blocks, BLOCK + COUNTS[0]), 255, np.uint8)
    single = np.full(blocks * BLOCK, 255, np.uint8)
    single[:n] = bits
    most[:, :BLOCK] = single.reshape(blocks, BLOCK)
    one, have, selector = most, 1, np.full(most.shape, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        while have < COUNTS[s]:
            wider = np.full(one.shape, 255, np.uint8)
            np.maximum(most[:, :-have], one[:, have:], out=wider[:, :-have])
            most, have = wider, have + 1
        selector[most <= WIDTHS[s]] = s
    taken = np.append(COUNTS, [0, 1])
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n) - np.arange(blocks) * BLOCK
    live, at, rows, selectors, starts = np.arange(blocks), np.zeros(blocks, np.int64), [], [], []
    while len(live):
        chosen = selector[live, at[live]]
        rows.append(live)
        selectors.append(chosen)
        starts.append(live * BLOCK + at[live])
        at[live] += taken[chosen]
        live = live[at[live] < ends[live]]
    rows, selectors, starts = map(np.concatenate, (rows, selectors, starts))
    order = np.argsort(starts, kind="stable")
    rows, selectors, starts = rows[order], selectors[order], starts[order]
    out = selectors.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(selectors == s)
        shifts = (np.arange(count) * width).astype(np.uint64)
        data = np.zeros(len(mine), np.uint64)
        for k in range(count if len(mine) else 0):
            data |= ids[starts[mine] + k] << shifts[k]
        out[mine] |= data
    mine = np.flatnonzero(selectors == ESCAPE)
    out[mine] |= np.arange(len(mine), dtype=np.uint64)
    return out, np.searchsorted(rows, np.arange(blocks)).astype(np.uint32), ids[starts[mine]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of words from the first of a block to the last of a block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.append(COUNTS, [0, 1])[selectors]
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(selectors == s)
        if len(mine):
            shifts = (np.arange(count) * width).astype(np.uint64)
            ids[(ends[mine] - count)[:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & np.uint64((1 << int(width)) - 1)
    mine = np.flatnonzero(selectors == ESCAPE)
    ids[ends[mine] - 1] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return ids


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        names, lengths, held, size, first, segment = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, lengths, held, size, first, segment
            coded, offsets, escapes = pack(np.frombuffer(b"".join(held), "<u4"))
            row = [part, segment, first, size, names, lengths, offsets.astype("<u4").tobytes(), coded.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            done = pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                ["part", "segment", "first", "n_ids", "doc_ids", "lengths", "block_offsets", "words", "escapes"],
            )
            names, lengths, held, first, size, segment = [], [], [], first + size, 0, segment + 1
            return done

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                names.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= SEGMENT_IDS:
                    yield close()
        if names:
            yield close()

    return run


def write_ids(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, and return the table of segments as written.

    Documents stand in ascending id order (NULL first; equal ids by the hash of their text, then the text);
    ``part`` ascends with the ids.  A NULL or empty text is its end id alone.  No documents: no segments.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # the hash lets a range bound fall inside one id that a large share of the rows has
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return written(dealt.mapInArrow(_segments(tokenizer or default_tokenizer(), end_id), SEGMENTS), "ids")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8")).astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["first"] + begins, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the segments.

    A part's first position is the sum of the ids of the parts before it: a table of one row per part.
    """
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    placed = segments.join(base, "part").select("base", "first", "doc_ids", "lengths", "words", "escapes")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
