"""Quality rules: text statistics, and the log-likelihood ratio of hashed n-grams between trusted and raw text.

All of it is DataFrame functions.  The words of a text and all that is derived from them stay inside its row; only the
counts of the hash buckets, whose number is fixed, are gathered from the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, lower_ascii, words

#: Hash buckets of the two multinomials; their weights are one array in the plan.
BUCKETS = 1 << 15
#: Added to every bucket's count.
SMOOTHING = 1.0
#: The least mean log ratio of an n-gram at which a text is kept.
THRESHOLD = -0.15
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _upto(n: Column) -> Column:
    """The numbers 0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))


def _hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column) -> Column:
    """The buckets of the words and of the pairs of neighbouring words."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(_upto(F.size(hashes) - 1), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of eight words that occur twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            same = lambda k, h: F.coalesce(F.get(rows, k)["h"] == h, F.lit(False))
            return F.sort_array(F.transform(F.filter(rows, lambda x, k: same(k - 1, x["h"]) | same(k + 1, x["h"])), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("stop"))
        counted = F.aggregate(
            let(ordered, twice), start,
            lambda done, i: F.struct((done["words"] + i + WINDOW - F.greatest(i, done["stop"])).alias("words"), (i + WINDOW).alias("stop")),
        )
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), counted["words"]).otherwise(0)

    windows = F.transform(_upto(F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return let(windows, covered)


def bucket_weights(docs: DataFrame, trusted: Column) -> DataFrame:
    """One row: the log ratio of trusted to raw text for every bucket, as one array.

    Raw is every row of ``docs``, trusted those where ``trusted`` holds.  Without trusted text all weights are 0.
    """
    found = docs.select(trusted.alias("trusted"), _hashes(words(lower_ascii(F.col("text")))).alias("hashes"))
    rows = found.select("trusted", F.explode(let(F.col("hashes"), ngram_buckets)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count(F.when(F.col("trusted"), 1)).alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    gathered = filled.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("counts"), F.sum("raw").alias("raw"), F.sum("good").alias("good")
    )
    share = lambda n, total: (n + SMOOTHING) / (total + SMOOTHING * BUCKETS)
    weight = lambda c: F.log(share(c["good"], F.col("good")) / share(c["raw"], F.col("raw")))
    return gathered.select(
        F.when(F.col("good") > 0, F.transform("counts", weight)).otherwise(F.transform("counts", lambda c: F.lit(0.0))).alias("weights")
    )


def _judged(docs: DataFrame, trusted_ids: DataFrame, name: str, threshold: float, once: bool = False) -> DataFrame:
    """``docs`` with all that is known of each text in one column.

    A filter on that column would take in all that its condition is made of, and measure each text several times.  With
    ``once`` the measures could differ from one time to the next, for all that the optimizer knows, so they stay below it.
    """
    text = F.coalesce("text", F.lit(""))
    ids = trusted_ids.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct().withColumn("good", F.lit(True))
    # neither side is bounded, so neither is broadcast; hashing the ids spares a sort of the texts
    marked = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(ids.hint("shuffle_hash"), "doc_id", "left")
    weights = bucket_weights(marked, F.coalesce("good", F.lit(False)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANK, "") != F.lit(""))
    measured = F.struct(
        F.length(F.translate(text, _BLANK, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                let(_hashes(w), repeated_words).cast("long").alias("n_repeat_words"),
                let(F.transform(w, lambda x: F.xxhash64(lower_ascii(x))), ngram_buckets).alias("buckets"),
            ),
        ).alias("w"),
    )
    # each name is used once by the lambda that follows, so the array of weights becomes a constant of the plan
    held = docs.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, measured) if once else measured)
    array = fresh(held, "weights")
    held = held.withColumn(array, weights.scalar())
    found, of = F.col(name), F.col(f"{name}.w")
    ratio = F.when(F.size(of["buckets"]) > 0, F.aggregate(of["buckets"], F.lit(0.0), lambda sum_, b: sum_ + F.get(array, b)) / F.size(of["buckets"])).otherwise(0.0)
    failed = (of["n_words"] < 20) | (100 * of["n_repeat_words"] > 30 * of["n_words"])
    return held.select(
        *docs.columns,
        F.struct(
            of["n_words"].alias("n_words"), found["word_chars"].alias("word_chars"), found["n_symbols"].alias("n_symbols"), found["n_dup_lines"].alias("n_dup_lines"),
            of["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), ratio.alias("log_ratio"),
        ).alias(name),
    ).withColumn(name, F.struct(f"{name}.*", (~F.col(f"{name}.base_failed") & (F.col(f"{name}.log_ratio") >= threshold)).alias("kept")))


def judge(docs: DataFrame, trusted_ids: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept), one row per row.

    ``trusted_ids`` has the doc_id of texts that show what is wanted; repeated or NULL ids in it do not matter.
    ``log_ratio`` is the mean weight of a text's words and word pairs, 0 without words.  A NULL text has no words.  A row
    with a NULL doc_id is judged and is raw text.  Equal rows are judged alike; no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return _judged(rows, trusted_ids, "found", threshold).select("doc_id", "found.*")


def good_documents(docs: DataFrame, trusted_ids: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept."""
    name = fresh(docs, "found")
    return _judged(docs, trusted_ids, name, threshold, once=True).filter(f"{name}.kept").drop(name)
