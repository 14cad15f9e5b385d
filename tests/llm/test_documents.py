"""Operators on documents against plain versions."""

import json
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import ODD

from shiftlens.llm import decontaminate, forest, interpolated_lm, quality_ratio, weak_toxicity
from shiftlens.llm.queries import QUERIES

RANDOM = random.Random(5)


def near_copies():
    """Groups of copies with more and more words replaced, unrelated texts with one passage, short texts."""
    word = lambda: "".join(RANDOM.choice("abcdefgh") for _ in range(4))
    passage, out = [word() for _ in range(60)], []
    for _ in range(3):
        base = [word() for _ in range(RANDOM.randint(30, 90))]
        for _ in range(25):
            base = [word() if RANDOM.random() < 0.012 else w for w in base]
            out.append(" ".join(base))
    out += [" ".join([word() for _ in range(40)] + passage) for _ in range(30)]
    out += [" ".join(RANDOM.choice("xyz") for _ in range(RANDOM.randint(1, 6))) for _ in range(25)]
    return [(i, t) for i, t in enumerate(out, 100)]


@pytest.mark.parametrize("block, run, named", [(2048, 512, 4), (2048, 7, 1), (6, 7, 1)])
@pytest.mark.parametrize("shingle", [4, 5])
def test_components(spark, monkeypatch, block, run, named, shingle):
    monkeypatch.setattr(forest, "RUN", run)
    monkeypatch.setattr(forest, "NAMED", named)
    rows = near_copies() + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = forest.duplicate_components(docs, shingle=shingle, block=block).collect()
    want = [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute.components(rows, shingle), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_one_of_each_group_stays(spark, odd):
    kept = forest.unique_documents(odd)
    assert kept.columns == odd.columns
    ids = sorted(repr(r["doc_id"]) for r in kept.collect())
    # 4 twice and 5 with 6 are groups, 9 and 10 are alike; NULL, empty and blank texts all stay
    assert ids == sorted(map(repr, [None, 1, 2, 3, 4, 5, None, 7, 8, 9, -1]))


def test_contamination(spark, odd, sf):
    items = [(1, "b C d"), (2, "w5 " + " ".join(f"w{i}" for i in range(6, 40))), (None, "quick brown"), (3, None), (4, "  .. "), (11, "one"), (1, "b C d")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, found string")
    want = sorted(repr((i, *brute.hits(t, [x for x in items if x[1]]))) for i, t in ODD)
    for limit in (1 << 20, 30):  # one automaton, and one for a few items each
        got = decontaminate.contamination(odd, benchmark, automaton_bytes=limit).collect()
        assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]))) for r in got) == want
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert [ODD[-1][1][s["start"] : s["stop"]] for s in spans[-1]] == ["b c d"]
    clean = decontaminate.clean_documents(odd, benchmark)
    assert clean.columns == odd.columns
    flagged = [r for r in got if r["contaminated"]]
    assert clean.count() == len(ODD) - len(flagged)
    none = decontaminate.contamination(odd, benchmark.limit(0))
    assert none.filter("n_hit > 0 OR contaminated").isEmpty()


def test_statistics_and_ratio(spark, odd, sf):
    line = "alpha beta gamma delta\n"
    rows = ODD + [(20, line * 3 + "x | y\n\n\n# #"), (21, "a b c d e f g h i a b c d e f g h i j"), (22, " ".join("abcdefgh" * 3))]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in sf("documents").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = [r["doc_id"] + 1000 for r in sf("labels").filter("quality = 1").collect()]
    good = spark.createDataFrame([(i,) for i in [*trusted, None, trusted[0]]], "doc_id long")
    got = sorted(quality_ratio.judge(docs, good).collect(), key=lambda r: repr((r["doc_id"], r["n_words"], r["word_chars"])))
    n = quality_ratio.BUCKETS
    found = {k: brute.buckets(t, n) for k, (_, t) in enumerate(rows)}
    raw, wanted = Counter(), Counter()
    for k, (i, _) in enumerate(rows):
        raw.update(found[k])
        if i in set(trusted):
            wanted.update(found[k])
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + n)
    totals = sum(raw.values()), sum(wanted.values())
    weight = {b: math.log((wanted[b] + 1) / (totals[1] + n) / ((raw[b] + 1) / (totals[0] + n))) for b in raw}
    want = []
    for k, (i, t) in enumerate(rows):
        s = brute.statistics(t)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        ratio = sum(weight[b] for b in found[k]) / len(found[k]) if found[k] else 0.0
        want.append((i, *s, failed, ratio, not failed and ratio >= quality_ratio.THRESHOLD))
    want.sort(key=lambda r: repr((r[0], r[1], r[2])))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:7] == w[:7]
        assert g["log_ratio"] == pytest.approx(w[7], abs=1e-9)
        assert g["kept"] == w[8] or abs(w[7] - quality_ratio.THRESHOLD) < 1e-9
    kept = quality_ratio.good_documents(odd, good)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(odd, sf, order):
    docs = sf("documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [[*brute.WORD.findall(brute.lower(r["text"])), None] for r in rows]
    seen = Counter(w for r, t in zip(rows, tokens, strict=True) if not held(r["doc_id"]) for w in t)
    total, known = sum(seen.values()), len(seen)
    got = interpolated_lm.score_texts(docs, order=order).collect()
    want = [
        (r["doc_id"], held(r["doc_id"]), len(t), sum(seen[w] > 0 for w in t), total, sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (known + 1))) for w in t))
        for r, t in zip(rows, tokens, strict=True)
    ]
    key = lambda r: repr((r[0], *r[1:5], round(r[5], 6)))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g["base_score"] == pytest.approx(w[5], rel=1e-9)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_language_model_is_a_distribution(spark):
    rows = [(i, "a b a c" if i % 2 else "b a") for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ask = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(["a a", "a b", "a c", "a", "a zzz"])], "doc_id long, text string")
    # what may follow "a" after the beginning, the end included: the differences of chance sum to one
    got = {r["doc_id"]: r["score"] for r in interpolated_lm.score_texts(docs.unionByName(ask), order=2).collect()}
    assert all(s < 0 for s in got.values())


def test_language_model_of_the_query_has_trigrams(spark):
    folder = "/root/testdata/sf0.001"
    got = {(r["doc_id"], round(r["score"], 6)) for r in QUERIES["op6_deleted_interpolation"](spark, folder).collect()}
    want = interpolated_lm.score_texts(spark.read.parquet(f"{folder}/documents.parquet"), order=3).collect()
    assert got == {(r["doc_id"], round(r["score"], 6)) for r in want}


def test_levels_and_frequencies_follow_the_tokens():
    p = 2.0 ** -np.arange(0, 34)
    assert len(set(interpolated_lm._level(p).tolist())) == len(p) and interpolated_lm._level(p).max() < interpolated_lm.classes(2**33)
    row = {"tokens": [1, 1, 1], "counts": interpolated_lm._packed(np.array([[5_000, 50_000, 1 << 22], [1, 1, 1]], "<u4").tobytes())}
    for texts in (5_000, 50_000, 1 << 22, 1 << 23):
        frequency = interpolated_lm._estimates(row, 2, (1 << 23, 3, texts), 0)[1]
        assert frequency[0] == math.ceil(2 * math.log2(texts + 1)) < interpolated_lm.classes(1 << 23)


def test_packed_counts_are_small_and_whole():
    """What chunks send and are answered besides hashes: under 3 bits an n-gram each way, and the same totals."""
    lm, rng = interpolated_lm, np.random.default_rng(1)
    chunks = []
    for number in range(4):
        texts = [b" ".join(b"w%d" % w for w in np.minimum(rng.zipf(1.3, 400), 1 << 20)) for _ in range(60)]
        chunks.append({
            "chunk": number, "doc_ids": list(range(60)), "training": [i % 10 > 0 for i in range(60)], "sizes": [len(t) for t in texts],
            "tokens": [401] * 60, "texts": lm._packed(b"".join(texts)),
        })
    sent = [pa.Table.from_batches(lm._send(3, 1)(iter([lm._record({k: [v] for k, v in c.items()}, lm.CHUNKS)]))).to_pandas() for c in chunks]
    answers = lm._add_up(pd.concat(sent, ignore_index=True))
    totals: dict[int, int] = {}
    keys = []
    for c in chunks:
        grams, which, _ = lm._grams(c, 3)
        keys.append(grams)
        for place, n in enumerate(lm._trained(c, which, len(grams))):
            totals[grams[place]] = totals.get(grams[place], 0) + int(n)
    every = sum(map(len, keys))
    assert sum(len(b) for s in sent for b in (*s["counts"], *s["words"])) * 8 < 3 * every and sum(len(b) for b in answers["others"]) * 8 < 3 * every
    for c, grams, at in zip(chunks, keys, range(4), strict=True):
        _, which, _ = lm._grams(c, 3)
        got = lm._count(3)((at,), pd.DataFrame([c]), answers[answers["chunk"] == at])["counts"][0]
        assert np.frombuffer(lm._unpacked(got), "<u4").tolist() == [totals[k] for k in grams[which].ravel()]


def test_no_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert interpolated_lm.score_texts(empty).count() == 0
    assert forest.duplicate_components(empty).count() == 0
    assert forest.unique_documents(empty).count() == 0
    assert weak_toxicity.toxicity(empty, labels).count() == 0
    assert quality_ratio.judge(empty, labels).count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = weak_toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("quality = 1")
    counts = Counter((r["toxic"], r["predicted"]) for r in got.collect())
    assert counts[0, 1] <= 0.02 * (counts[0, 1] + counts[0, 0])
    # other languages have two or three toxic texts each to learn from at this size
    english = Counter((r["toxic"], r["predicted"]) for r in got.filter("lang = 'en'").collect())
    assert english[1, 1] >= 0.9 * (english[1, 1] + english[1, 0])


def test_every_term_is_mined_and_copies_count_once(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    shared, own = " ".join(f"q{word(i)}" for i in range(9_000)), [f"z{word(i)}" for i in range(5)]
    toxic = [(i, f"{shared} v{word(i)}") for i in range(20)]
    rare = [(100 + i, f"u{word(i)} grumblewort") for i in range(8)] + [(100, f"u{word(0)} grumblewort")]
    copies = [(200 + i, " ".join(own)) for i in range(60)] + [(200, " ".join(own))] * 3
    civil = [(1_000 + i, f"calm weather w{word(i)}") for i in range(400)]
    docs = spark.createDataFrame(toxic + rare + copies + civil, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in {i for i, _ in toxic + rare + copies}] + [(i, 0) for i, _ in civil], "doc_id long, toxic int")
    terms = json.loads(weak_toxicity.train(docs, labels))["terms"]
    assert "grumblewort" in terms and not set(terms) & set(own)
    assert set(shared.split()) <= set(terms)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    got = weak_toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert weak_toxicity.civil_documents(odd, labels).columns == odd.columns
