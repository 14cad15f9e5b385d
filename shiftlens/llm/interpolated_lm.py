"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of orders 1 to n and a uniform one are mixed; the weights depend on how often the context
was seen and are learned by expectation-maximisation on counts from which the token itself is deleted.

Texts are written once as compressed chunks of a few megabytes.  A chunk counts its own n-grams as sorted 64-bit hashes
and deals them to buckets, which are ranges of the hash; a bucket adds up what all chunks have sent and answers each with
what the others have of its n-grams, in their order.  So an n-gram is moved once per chunk that has it, packed, and no chunk
looks anything up in a table that grows.  There are as many buckets as keep each at about ``KEYS`` hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import crc32_fold, written

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 6 << 20
#: Hashes that a bucket receives, about.
KEYS = 1 << 20
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

CHUNKS = "chunk long, doc_ids array<long>, training array<boolean>, sizes array<long>, tokens array<long>, texts binary"
COUNTED = "doc_ids array<long>, training array<boolean>, tokens array<long>, counts binary"


def _packed(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, equal bytes together: the upper ones are nearly all zero."""
    return _packed(numbers.astype("<u4").ravel().view(np.uint8).reshape(-1, 4).T.tobytes())


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(_unpacked(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _record(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one; a chunk is megabytes, so no two are unpacked at a time."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

    def row() -> pa.RecordBatch:
        ids, training, texts, tokens = zip(*held, strict=True)
        return _record(
            {"chunk": [chunk], "doc_ids": [ids], "training": [training], "sizes": [[len(t) for t in texts]], "tokens": [tokens], "texts": [_packed(b"".join(texts), 5)]}, CHUNKS
        )

    for batch in batches:
        for doc_id, training, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            coded = text.encode("utf-8", "replace").translate(_LOWER)
            held.append((doc_id, training, coded, len(coded.split()) + 1))
            size += len(coded) + 8
            if size >= CHUNK_BYTES:
                yield row()
                chunk, held, size = chunk + 1, [], 0
    if held:
        yield row()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, by multiplying and folding."""
    x = (a ^ (b >> np.uint64(29)) ^ (b << np.uint64(35))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32)) ^ b) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a chunk's n-grams, sorted and single; per order and token, which of them; the first tokens of texts.

    An n-gram that reaches back over the beginning of its text has one start symbol there.
    """
    import xxhash

    data, lengths = _unpacked(row["texts"]), np.array(row["tokens"], np.int64)
    number: dict[bytes, int] = {}
    total, at, place = int(lengths.sum()), 0, 0
    words = np.full(total, -1, np.int64)
    for size, length in zip(row["sizes"], lengths.tolist(), strict=True):
        words[place : place + length - 1] = [number.setdefault(w, len(number)) for w in data[at : at + size].split()]
        at, place = at + size, place + length
    hashes = np.array([*(xxhash.xxh64_intdigest(w) for w in number), int(_END)], np.uint64)
    single = hashes[words]
    first = np.cumsum(lengths) - lengths
    grams, longer = [single], single
    for n in range(2, order + 1):
        before = np.roll(longer, 1)
        before[first] = _START
        longer = _mix(before * np.uint64(31) + np.uint64(n), single)
        grams.append(longer)
    every = np.concatenate(grams)
    del grams, longer, single, words
    ranked = np.argsort(every)
    every = every[ranked]
    new = np.append(True, every[1:] != every[:-1]) if len(every) else np.zeros(0, bool)
    which = np.empty(len(every), np.int32)
    which[ranked] = np.cumsum(new, dtype=np.int32) - 1
    return every[new], which.reshape(order, total), first


def _trained(row: dict, which: np.ndarray, keys: int) -> np.ndarray:
    """How often a chunk has each of its n-grams in training texts."""
    trained = np.repeat(np.array(row["training"], bool), row["tokens"])
    counts = np.zeros(keys, np.int64)
    for places in which:
        counts += np.bincount(places[trained], minlength=keys)
    return counts


def _send(order: int, buckets: int):
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys, which, _ = _grams(row, order)
                counts = _trained(row, which, len(keys))
                word = np.zeros(len(keys), bool)
                word[which[0]] = True
                bounds = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(np.diff(bounds))
                cuts = [slice(bounds[b], bounds[b + 1]) for b in full]
                # sorted hashes as differences, equal bytes together: the upper ones are nearly all zero
                steps = [np.diff(keys[c], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in cuts]
                yield _record(
                    {
                        "bucket": full, "chunk": [row["chunk"]] * len(full), "keys": [_packed(s) for s in steps],
                        "counts": [_narrow(counts[c]) for c in cuts], "words": [_packed(np.packbits(word[c]).tobytes()) for c in cuts],
                    },
                    "bucket int, chunk long, keys binary, counts binary, words binary",
                )

    return run


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """What all other chunks have of a bucket's n-grams, for each chunk in the order of its keys, and how many words were seen in training.

    A chunk knows its own counts, so those of the others say all: they are 0 for what no other has.
    """
    keys = [np.cumsum(np.frombuffer(_unpacked(k), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64) for k in rows["keys"]]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_wide(c) for c in rows["counts"]])
    words = np.concatenate([np.unpackbits(np.frombuffer(_unpacked(w), np.uint8), count=len(k)) for w, k in zip(rows["words"], keys, strict=True)]).astype(bool)
    total = np.bincount(place, counts, minlength=len(every)).astype("<u4")
    word = np.zeros(len(every), bool)
    word[place[words]] = True
    ends = np.cumsum([len(k) for k in keys])
    answers = [_narrow(total[place[e - len(k) : e]] - counts[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "others": answers, "known": [int((word & (total > 0)).sum())] + [0] * (len(rows) - 1)})


def _count(order: int):
    def run(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = texts.iloc[0].to_dict()
        keys, which, _ = _grams(row, order)
        totals = _trained(row, which, len(keys)).astype("<u4")
        totals += np.concatenate([_wide(t) for t in answers.sort_values("bucket")["others"]])
        return pd.DataFrame({"doc_ids": [row["doc_ids"]], "training": [row["training"]], "tokens": [row["tokens"]], "counts": [_packed(totals[which].tobytes())]})

    return run


def classes(tokens: int) -> int:
    """How many half powers of two there are from 1 to ``tokens`` and one beyond, and one for none.

    So many classes of context frequency have weights of their own, and so many levels has an estimate in a cell: no
    count of the training tokens, and no estimate from such counts, falls outside.
    """
    return math.ceil(2 * math.log2(tokens + 1)) + 2


def _estimates(row: dict, order: int, facts: tuple[int, int, int], deleted: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: the estimates of each order, uniform first; the frequency class of the longest context; the counts.

    ``facts`` are the training tokens, known words and training texts.  ``deleted`` is 1 for tokens that are taken out of
    the counts that they are estimated from.  A context is the n-gram before, so its count is that of the n-gram.
    """
    tokens, known, texts = facts
    lengths = np.array(row["tokens"], np.int64)
    counts = np.frombuffer(_unpacked(row["counts"]), "<u4").astype(np.int64).reshape(order, -1)
    first = np.cumsum(lengths) - lengths
    rows = [np.full(counts.shape[1], 1.0 / (known + 1)), np.maximum(counts[0] - deleted, 0) / np.maximum(tokens - deleted, 1)]
    context = np.full(counts.shape[1], tokens, np.int64)
    for n in range(1, order):
        context = np.roll(counts[n - 1], 1)
        context[first] = texts
        context = np.maximum(context - deleted, 0)
        rows.append(np.maximum(counts[n] - deleted, 0) / np.maximum(context, 1))
    frequency = np.ceil(2 * np.log2(context + 1)).astype(np.int64)
    return np.array(rows), frequency, counts


def _level(p: np.ndarray) -> np.ndarray:
    """Half powers of two below 1, from 1; 0 for none."""
    return np.where(p > 0, 1 + np.floor(-2 * np.log2(np.maximum(p, 1e-30))), 0).astype(np.int64)


def _cells(order: int, facts: tuple[int, int, int]):
    """How many training tokens fall into each cell of context frequency and levels of the estimates."""
    levels = classes(facts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                p, code, _ = _estimates(row, order, facts, 1)
                for estimate in p[1:]:
                    code = code * levels + _level(estimate)
                cells, number = np.unique(code[np.repeat(np.array(row["training"], bool), row["tokens"])], return_counts=True)
                yield _record({"cell": cells, "n": number}, "cell long, n long")

    return run


def mixture_weights(cells: np.ndarray, number: np.ndarray, order: int, known: int, tokens: int, rounds: int = 100) -> np.ndarray:
    """(frequency, order + 1) weights by expectation-maximisation on the cells of ``tokens`` training tokens.

    A frequency without tokens has the weights that fit all tokens.
    """
    levels, size = [], classes(tokens)
    for _ in range(order):
        levels.append(cells % size)
        cells = cells // size
    p = np.array([np.full(len(cells), 1.0 / (known + 1))] + [np.where(x > 0, 2.0 ** (-(x - 0.5) / 2), 0.0) for x in reversed(levels)])

    def learn(mine: np.ndarray, weights: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            share = weights[:, None] * p[:, mine]
            share = (share / share.sum(0) * number[mine]).sum(1) + 1e-6
            weights = share / share.sum()
        return weights

    start = np.full(order + 1, 1 / (order + 1))
    every = learn(np.ones(len(cells), bool), start) if len(cells) else start
    return np.array([learn(cells == f, every) if (cells == f).any() else every for f in range(size)])


def _score(order: int, facts: tuple[int, int, int], weights: np.ndarray):
    tokens, known, _ = facts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                p, frequency, counts = _estimates(row, order, facts, 0)
                mixed = weights[frequency].T.copy()
                lengths = np.array(row["tokens"], np.int64)
                first = np.cumsum(lengths) - lengths
                for n in range(order, 1, -1):  # the weight of an unseen context goes to the next lower order
                    seen = np.roll(counts[n - 2], 1) > 0
                    seen[first] = facts[2] > 0
                    mixed[n - 1] += np.where(seen, 0, mixed[n])
                    mixed[n] = np.where(seen, mixed[n], 0)
                if not tokens:
                    mixed[0], mixed[1] = mixed[0] + mixed[1], 0
                chance = np.log10((mixed * p).sum(0))
                base = np.log10((counts[0] + 0.1) / (tokens + 0.1 * (known + 1)))
                yield _record(
                    {
                        "doc_id": row["doc_ids"], "training": row["training"], "n_tokens": lengths, "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), first),
                        "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(chance, first),
                    },
                    "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double",
                )

    return run


def score_texts(docs: DataFrame, *, order: int = 2, folds: int = 10, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learned from the rows whose crc32 of the id, modulo ``folds``, is not ``held_out``; rows without id are held out.
    A NULL or empty text is its end alone.  Equal rows get equal scores and count each time.  No rows give none; without
    training rows every token has the uniform chance of the one unknown word.
    """
    fold = crc32_fold(F.col("doc_id").cast("long"), folds)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold != held_out, F.lit(False)).alias("training"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = written(rows.mapInArrow(_chunks, CHUNKS), "chunks")
    per_doc = F.explode(F.arrays_zip("training", "tokens")).alias("d")
    sizes = chunks.select(per_doc).agg(
        F.sum("d.tokens").alias("every"), F.sum(F.when(F.col("d.training"), F.col("d.tokens"))).alias("tokens"), F.count(F.when(F.col("d.training"), 1)).alias("texts")
    ).first()
    buckets = int((sizes["every"] or 0) * order * 0.4 / KEYS) + 1
    sent = chunks.mapInArrow(_send(order, buckets), "bucket int, chunk long, keys binary, counts binary, words binary")
    answers = written(sent.groupBy("bucket").applyInPandas(_add_up, "chunk long, bucket int, others binary, known long"), "answers")
    known = answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    facts = (sizes["tokens"] or 0, known, sizes["texts"])
    counted = written(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_count(order), COUNTED), "counted")
    found = counted.mapInArrow(_cells(order, facts), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # cells grow with the logarithm of the tokens only
    weights = mixture_weights(found["cell"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(float), order, known, facts[0])
    scored = counted.mapInArrow(_score(order, facts, weights), "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(facts[0]).cast("long").alias("train_tokens"), "base_score", "score"
    )
