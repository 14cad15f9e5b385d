"""Conversations as budgeted windows of turns with a loss mask.

A turn is ``### role ###``, a line feed, the text and ``</turn>``, a line feed.  Inside roles and texts a backslash
stands before every backslash, every ``#`` and the slash of ``</turn>``, so no control string occurs there, and taking
away one backslash of each pair gives the text back.

Prefix sums of the turns' tokens choose the windows.  A conversation that fits the budget is one window.  Of a longer one,
what the system turn and the history leave of the budget is the space of a window: a turn belongs to the cell, of three
quarters of the space, in which it ends, and one longer than a quarter stands in a window of its own.  So a cell's turns
never take more than the space; beside a turn of its own the history gets what is left.  A window passes the budget only
where its one new turn and the system turn do.  The sums come from ordered ranges, so a conversation with a large share of
all turns is spread over many tasks.  What a window repeats is masked, so that every assistant text is a target once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordinal, running_sum, with_running
from .base import written

END = "</turn>\n"
_HEAD, _HEAD_END = "### ", " ###\n"


@dataclass(frozen=True)
class Budget:
    """``tokens`` holds for every window, but where the system turn and one other alone are longer; no turn is cut.

    A system turn over half the budget is repeated all the same; the turns beside it then come one to a window where
    they have to.
    """

    tokens: int = 4096
    history: int = 512
    chars_per_token: int = 4


def escape(text: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(conversations: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(conv_id, window, text, loss_spans, n_turns, n_context, tokens, over_budget), one row per window.

    ``loss_spans`` are code-point ranges of ``text``; the first ``n_context`` of its ``n_turns`` turns are repeated.
    Turns stand in the order of ``turn``, NULL first, equal ones by a hash of role and text; repeated rows are turns
    of their own.  NULL roles and texts are empty; rows with a NULL conv_id are one conversation.  No rows: no windows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(role, text).alias("tie"),
        (role == "assistant").alias("target"), (role == "system").alias("system"),
        F.concat(F.lit(_HEAD), escape(role), F.lit(_HEAD_END)).alias("head"), escape(text).alias("body"),
    )
    turns = written(turns.withColumn("tokens", F.ceil((F.length("head") + F.length("body") + len(END)) / budget.chars_per_token)), "turns")
    placed = written(with_running(turns, ["conv_id"], ["turn", "tie"], {"place": ordinal(), "stop": running_sum(F.col("tokens"))}), "placed")
    whole = placed.groupBy(F.col("conv_id").alias("c")).agg(
        F.sum("tokens").alias("total"), F.coalesce(F.max(F.when(F.col("system") & (F.col("place") == 1), F.col("tokens"))), F.lit(0)).alias("fixed")
    )
    left = F.greatest(budget.tokens - F.col("fixed"), F.lit(0))
    placed = placed.join(whole, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumns({
        "system": F.col("system") & (F.col("place") == 1), "begin": F.col("stop") - F.col("tokens"),
        "space": F.when(F.col("total") > budget.tokens, left - F.least(F.lit(budget.history), F.floor(left / 8))),
    })
    quarter = F.floor(F.col("space") / 4)  # NULL, as is the space, where nothing is cut
    placed = placed.withColumns({
        "cell": F.when(F.col("space").isNull(), 0).otherwise(F.floor((F.col("stop") - 1) / F.greatest(F.col("space") - quarter, F.lit(1)))),
        "alone": F.coalesce((F.col("tokens") > quarter).cast("long"), F.lit(0)),
    })
    placed = written(
        with_running(placed, ["conv_id"], ["place"], {"breaks": running_sum(F.col("alone"))}).withColumn(
            # neither falls from turn to turn, so the sum changes where one of the two does
            "window", F.col("cell") + 2 * F.col("breaks") - F.col("alone")
        ),
        "cells",
    )
    spans = placed.groupBy("conv_id", "window").agg(F.min("begin").alias("first"), F.max("stop").alias("last"), F.max("fixed").alias("fixed"))
    room = F.least(F.lit(budget.history), budget.tokens - F.col("fixed") - (F.col("last") - F.col("first")))
    later = spans.select(F.col("conv_id").alias("c"), F.col("window").alias("next"), F.col("first").alias("at"), room.alias("room"))
    chained = spans.join(later, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("last") == F.col("at"))).select("conv_id", "window", "next", "last", "room")
    part = ["conv_id", "window", "kind", "place", "head", "body", "target", "tokens"]
    fresh = placed.withColumn("kind", F.lit(2)).select(*part)
    before = chained.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), "next", "last", "room")
    history = (
        placed.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")))
        .filter((F.col("last") - F.col("begin") <= F.col("room")) & ~F.col("system"))
        .withColumns({"window": F.col("next"), "kind": F.lit(1), "target": F.lit(False)}).select(*part)
    )
    system = placed.filter("system").select(F.col("conv_id").alias("c"), F.col("window").alias("own"), "place", "head", "body", "tokens")
    system = (
        spans.join(system, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") != F.col("own")))
        .withColumns({"kind": F.lit(0), "target": F.lit(False)}).select(*part)
    )
    rows = fresh.unionByName(history).unionByName(system)
    windows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct(*part[2:]))).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,stop:int>>)").alias("spans"))

    def add(done: Column, p: Column) -> Column:
        begin = done["at"] + F.length(p["head"])
        stop = begin + F.length(p["body"])
        span = F.struct(begin.alias("start"), stop.alias("stop"))
        return F.struct((stop + len(END)).alias("at"), F.when(p["target"], F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return windows.select(
        "conv_id", "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        F.aggregate("parts", start, add)["spans"].alias("loss_spans"),
        F.size("parts").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_context"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"),
    ).withColumn("over_budget", F.col("tokens") > budget.tokens)


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets, n_chars) read back from the formatted text.

    ``turns`` are the (role, text) that the window adds, ``targets`` the texts under the mask, both unescaped.
    """
    marked = F.filter(F.split("text", END), lambda p: p != F.lit(""))
    added = F.slice(marked, F.col("n_context") + 1, F.greatest(F.size(marked) - F.col("n_context"), F.lit(0)))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, _HEAD_END, 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(_HEAD) + 1))).alias("role"),
            unescape(F.substr(p, F.length(head) + len(_HEAD_END) + 1)).alias("text"),
        )

    return windows.select(
        "conv_id", "window", F.transform(added, turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr("text", s["start"] + 1, s["stop"] - s["start"]))).alias("targets"),
        F.length("text").cast("long").alias("n_chars"),
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done, state = [], None

    def close() -> None:
        if state:
            conv_id, turns, turns_sha, chars, loss_sha, formatted = state
            done.append((conv_id, turns, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), formatted))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 6, kinds, strict=True)], names)

    for batch in batches:
        for conv_id, n_turns, turns, loss, n_chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or state[0] != conv_id:
                close()
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += n_turns
            state[2].update(turns.encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += n_chars
        yield out()
        done.clear()
    close()
    yield out()


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, from its windows as read back.

    A digest has to see its texts in order.  The windows of a conversation stream through one task, one at a time,
    and only the state of the digests is held.
    """
    read = read_windows(windows).select(
        "conv_id", "window", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"), "n_chars",
    )
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "window").drop("window")
    return dealt.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
