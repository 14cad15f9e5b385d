"""Ranged running values against plain windows, with one key holding most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftlens.operators import ordered as O


def rows(spark):
    base = spark.range(0, 3000, numPartitions=5)
    return base.select(
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 40).alias("k"),
        (F.hash("id") % 500).alias("a"),
        F.col("id").alias("b"),
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"),
    )


def test_same_as_plain_windows(spark):
    df = rows(spark)
    got = O.with_running(
        df, ["k"], ["a", "b"],
        {
            "n": O.ordinal(), "s": O.running_sum(F.col("b")), "s_before": O.running_sum(F.col("b"), inclusive=False),
            "m": O.running_max(F.col("v")), "p": O.previous(F.col("v")), "f": O.following(F.col("b")), "l": O.last_seen(F.col("v")),
        },
        ranges=50,
    )
    w = Window.partitionBy("k").orderBy("a", "b")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.sum("b").over(upto).alias("s"),
        F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s_before"),
        F.max("v").over(upto).alias("m"), F.lag("v").over(w).alias("p"), F.lead("b").over(w).alias("f"),
        F.last("v", ignorenulls=True).over(upto).alias("l"),
    )
    def plain(frame):
        return sorted((tuple(r) for r in frame.select(*want.columns).collect()), key=lambda r: r[2])

    assert plain(got) == plain(want)


def test_hot_key_is_cut_into_ranges(spark):
    df = rows(spark)
    position = F.struct("k", "a", "b")
    cut = O._with_range(df, position, O._range_bounds(df, position, 50).scalar(), 50)
    sizes = cut.groupBy("k", "_range").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 300
    assert sizes[1] < 150


def test_no_keys_and_no_rows(spark):
    df = rows(spark)
    assert O.with_running(df, [], ["b"], {"n": O.ordinal()}).agg(F.max("n"), F.count_distinct("n")).first() == (3000, 3000)
    assert O.with_running(df.filter("k < 0"), ["k"], ["b"], {"n": O.ordinal()}).count() == 0
