"""Streams whose state Spark itself keeps: token families that age out, and leases with timers.

State stands in the state store, one value per key, and is carried from batch to batch by Spark; how rows are dealt over
batches does not change what comes out.  Rows of a key are put in order inside a micro-batch, whose size the source bounds.
Rows later than the watermark allows are dropped by Spark before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOKEN_USES = "family_id string, seq bigint, generation bigint, outcome string"
LAPSES = "job_id string, seq bigint, at timestamp"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the store that keeps several columns of state, with ages."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class TokenFamilies(StatefulProcessor):
    """The newest generation of a family, and whether a reuse has revoked it; forgotten ``ttl_ms`` after its last use."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.family = handle.getValueState("family", "newest bigint, revoked boolean", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest, revoked = self.family.get() if self.family.exists() else (None, False)
        for row in sorted(rows, key=lambda r: r["seq"]):
            generation = row["generation"]
            revoked = revoked or None not in (generation, newest) and generation <= newest
            newest = max((g for g in (generation, newest) if g is not None), default=None)
            yield Row(family_id=key[0], seq=row["seq"], generation=generation, outcome="reuse" if revoked else "rotated")
        self.family.update((newest, revoked))

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """The last beat of a job; a timer tells when its lease has run out with no other beat."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "seq bigint, at timestamp, told boolean")

    def _ends(self, at: Any) -> int:
        return round(at.timestamp() * 1000) + self.lease_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = tuple(self.beat.get()) if self.beat.exists() else None
        if held is not None:
            self.handle.deleteTimer(self._ends(held[1]))
        for row in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            if held is not None and not held[2] and round(row["at"].timestamp() * 1000) > self._ends(held[1]):
                yield Row(job_id=key[0], seq=held[0], at=held[1])
            held = (row["seq"], row["at"], False)
        if held is not None:
            self.beat.update(held)
            if not held[2]:
                self.handle.registerTimer(self._ends(held[1]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.beat.exists():
            seq, at, told = self.beat.get()
            if not told and self._ends(at) <= expiredTimerInfo.getExpiryTimeInMs():
                self.beat.update((seq, at, True))
                yield Row(job_id=key[0], seq=seq, at=at)

    def close(self) -> None:
        pass


def token_uses(stream: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """(family_id, seq, generation, outcome): the stream form of ``accounts.token_uses``.

    A family that is not used for ``ttl_seconds`` is forgotten, so the state does not grow with families that are gone;
    ages are told by the clock, so such a stream has no end of its own.  Without it families are kept for good.
    """
    ttl_ms = None if ttl_seconds is None else int(ttl_seconds * 1000)
    return stream.select("family_id", "seq", "generation").groupBy("family_id").transformWithState(
        TokenFamilies(ttl_ms), TOKEN_USES, "Append", "None" if ttl_ms is None else "ProcessingTime"
    )


def lapses(stream: DataFrame, lease_seconds: float, late: str) -> DataFrame:
    """(job_id, seq, at): beats after which a lease ran out, the last beat of a silent job included.

    ``at`` is a timestamp; rows may come ``late``.  A gap between two beats shows as the later one arrives, silence once the
    watermark is past the lease's end.
    """
    timed = stream.select("job_id", "seq", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("job_id").transformWithState(Leases(int(lease_seconds * 1000)), LAPSES, "Append", "EventTime")
