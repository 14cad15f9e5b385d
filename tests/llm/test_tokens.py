"""Token files and packing."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shiftlens.llm import packing, token_files
from shiftlens.llm.tokens import default_tokenizer, encoder

LIBRARY = Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library(text):
    assert np.frombuffer(encoder(default_tokenizer())(text), "<u4").tolist() == ids_of(text)


@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=700))
@settings(max_examples=100, deadline=None)
def test_words_round_trip(ids):
    words, offsets, escapes = token_files.pack(np.array(ids, np.uint64))
    assert token_files.unpack(words, escapes).tolist() == ids
    bounds = [*offsets.tolist(), len(words)]
    for block, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        assert token_files.unpack(words[a:b], escapes).tolist() == ids[128 * block : 128 * block + 128]


@pytest.mark.parametrize("docs", ["odd", "sf"])
def test_files_hold_every_document(request, docs):
    table = request.getfixturevalue(docs)
    table = table("documents") if docs == "sf" else table
    got = token_files.read_documents(token_files.write_ids(table)).collect()
    want, start = [], 0
    for row in sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array([*ids_of(row["text"]), 2], "<u4")
        want.append((row["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(repr, [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got])) == sorted(map(repr, want))
    for row in sorted(got, key=lambda r: r["start"]):  # gapless, in ascending order
        assert row["start"] == start
        start += row["n_tokens"]
    named = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert named == sorted(named)


def test_no_documents(empty):
    assert token_files.read_documents(token_files.write_ids(empty)).count() == 0
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("per_part", [1 << 16, 20])
def test_packing(odd, sf, per_part):
    own = odd.selectExpr("doc_id + 1000000 AS doc_id", "text")  # ids that the other documents do not have
    docs = sf("documents").select("doc_id", "text").unionByName(own)
    got = packing.pack_documents(docs, per_part=per_part).collect()
    bins, texts = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    want = [len(ids_of(r["text"])) + 1 for r in docs.collect()]
    assert sum(r["length"] for r in got) == sum(want)
    assert len(got) == sum(-(-n // 4096) for n in want)
    counts = np.bincount([r["length"] for r in got], minlength=4097)
    assert len(bins) <= packing.lower_bound(counts, 4096) + (per_part < 100)
    assert sorted(texts[1_000_008])[0] == (0, 0, 4096)
    assert len([i for i, _ in ODD if i == 4]) == len(texts[1_000_004])


def test_exchanged_pieces_are_kept_once(spark):
    lengths = np.random.default_rng(5).integers(20, 60, 226).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES).repartition(3)
    got = packing.pack_pieces(pieces, 100, per_part=20).collect()
    assert len({r["sequence_id"] >> 56 for r in got}) > 2  # more than one exchange saved sequences
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        places.sort()
        assert [at for at, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 100


def test_bounds_and_best_fit():
    lengths = np.array([51, 51, 51, 26, 24, 24, 30])
    bins, offsets, room = packing.best_fit_decreasing(lengths, 100)
    assert bins.max() + 1 == 3 == packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert packing.lower_bound(np.bincount([51] * 5, minlength=101), 100) == 5
    assert packing.lower_bound(np.bincount([34] * 5, minlength=101), 100) == 3
    assert packing.lower_bound(np.zeros(101, int), 100) == 0


def test_batches_are_bounded(spark):
    from shiftlens.llm import base, queries

    folder = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    for name in ("op5_lsh_forest", "op6_deleted_interpolation"):
        run = queries.QUERIES[name](spark, folder)
        assert run.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(base.BATCH_BYTES)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_grams_are_ranked_as_by_unique():
    import numpy as np

    from shiftlens.llm import interpolated_lm as lm

    texts = [b"a b a b c", b"", b"c b a"]
    row = {"texts": lm._packed(b"".join(texts)), "sizes": [len(t) for t in texts], "tokens": [len(t.split()) + 1 for t in texts]}
    keys, which, first = lm._grams(row, 3)
    assert which.dtype == np.int32 and which.shape == (3, 11) and first.tolist() == [0, 6, 7]
    assert (np.diff(keys.astype(object)) > 0).all()
    assert len(np.unique(which)) == len(keys) and which[0][0] == which[0][2] == which[0][9]
