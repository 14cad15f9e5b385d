"""Stateful streams as a fold of micro-batches over a state table.

Each micro-batch is answered by the batch operators, which already spread a busy key over many
tasks.  State and output of a batch go to folders named by the batch, written whole, so a batch that
runs again after a failure replaces its own files and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import accounts, queue_state
from ..operators.ordered import ordinal, with_running

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def fold(stream: DataFrame, folder: str, state_schema: str, step: Step, **trigger) -> StreamingQuery:
    """Run ``step(batch, state) -> (output, new state)`` on every micro-batch.

    ``folder`` must be shared by all executors.  Only one such query may write to it.
    """
    schema = StructType.fromDDL(state_schema)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            state = spark.createDataFrame([], schema)
        else:
            state = spark.read.schema(schema).parquet(f"{folder}/state/{batch_id - 1}")
        output, following = step(batch, state)
        output.write.mode("overwrite").parquet(f"{folder}/output/{batch_id}")
        following.write.mode("overwrite").parquet(f"{folder}/state/{batch_id}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def output_of(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/output/*")


TOKEN_STATE = "family_id string, newest bigint, killed boolean"


def token_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Token rotation: (family_id, seq, generation) in, with outcome out.

    What a family did before enters the batch as one earlier use.
    """
    uses = batch.select("family_id", "seq", "generation", F.lit(False).alias("old"))
    before = state.select("family_id", F.lit(-1).cast("long").alias("seq"), F.col("newest").alias("generation"), F.lit(True).alias("old"))
    judged = accounts.token_uses(uses.unionByName(before).select("family_id", "seq", "generation")).filter("seq >= 0")
    known = judged.join(state.select("family_id", "killed"), "family_id", "left")
    output = known.select(
        "family_id", "seq", "generation", F.when(F.coalesce("killed", F.lit(False)), "reuse").otherwise(F.col("outcome")).alias("outcome")
    )
    now = output.groupBy("family_id").agg(F.max("generation").alias("top"), F.bool_or(F.col("outcome") == "reuse").alias("hit"))
    following = state.join(now, "family_id", "full").select(
        "family_id",
        F.greatest("newest", "top").alias("newest"),
        (F.coalesce("killed", F.lit(False)) | F.coalesce("hit", F.lit(False))).alias("killed"),
    )
    return output, following


LEASE_STATE = "job_id string, seq bigint, at timestamp_ntz"


def lease_step(lease_seconds: float) -> Step:
    """Heartbeats in, expired leases out; the last beat of a job waits for the next batch."""

    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        beats = batch.select("job_id", "seq", "at").unionByName(state)
        last = beats.groupBy("job_id").agg(F.max_by(F.struct("seq", "at"), F.struct("at", "seq")).alias("last"))
        return queue_state.expired_leases(beats, lease_seconds), last.select("job_id", "last.seq", "last.at")

    return step


REPEAT_STATE = "job_id string, fingerprint string, seen bigint"


def repeat_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recovery visits in, each with its occurrence number out."""
    placed = with_running(batch, ["job_id", "fingerprint"], ["at", "seq"], {"repeat_here": ordinal()})
    joined = placed.join(state, ["job_id", "fingerprint"], "left")
    output = joined.select(
        "job_id", "fingerprint", "seq", (F.col("repeat_here") + F.coalesce("seen", F.lit(0))).alias("repeat")
    )
    counts = batch.groupBy("job_id", "fingerprint").agg(F.count("*").alias("n"))
    following = state.join(counts, ["job_id", "fingerprint"], "full").select(
        "job_id", "fingerprint", (F.coalesce("seen", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen")
    )
    return output, following


JOB_STATE = "id string, status string, worker_id string, created_at timestamp_ntz, heartbeat_at timestamp_ntz"


def queue_step(lease_seconds: float) -> Step:
    """Job events in, claims out: the single writer that stands in for row locks.

    An event is (kind, id, worker_id, at) with kind ``enqueue``, ``heartbeat``, ``claim`` or
    ``finish``.  Of the claims of a batch the n-th, by time, gets the n-th oldest claimable job.
    Only the worker that holds a running job renews or ends it; a worker that lost its lease changes nothing.
    """

    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = batch.filter("kind = 'enqueue'").join(state.select("id"), "id", "left_anti").groupBy("id").agg(F.min("at").alias("created_at"))
        jobs = state.unionByName(
            new.select("id", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("worker_id"), "created_at",
                       F.lit(None).cast("timestamp_ntz").alias("heartbeat_at"))
        )
        seen = batch.filter("kind IN ('heartbeat', 'finish')").groupBy(F.col("id").alias("seen_id"), F.col("worker_id").alias("by")).agg(
            F.max(F.when(F.col("kind") == "heartbeat", F.col("at"))).alias("beat"), F.bool_or(F.col("kind") == "finish").alias("finished")
        )
        own = (F.col("id") == F.col("seen_id")) & (F.col("worker_id") == F.col("by")) & (F.col("status") == "running")
        ended = F.coalesce("finished", F.lit(False))

        def heard(held: DataFrame) -> DataFrame:
            return held.join(seen, own, "left").select(
                "id", F.when(ended, "done").otherwise(F.col("status")).alias("status"), "worker_id", "created_at",
                F.when(ended, F.lit(None)).otherwise(F.greatest("heartbeat_at", "beat")).alias("heartbeat_at"),
            )

        jobs = heard(jobs)
        now = batch.agg(F.max("at").alias("now")).scalar()
        from ..functions.predicates import claimable

        claims = with_running(batch.filter("kind = 'claim'").select(F.col("worker_id").alias("claimer"), "at"), [], ["at", "claimer"], {"n": ordinal()})
        ready = with_running(
            jobs.withColumn("now", now).filter(claimable(F.col("status"), F.col("heartbeat_at"), F.col("now"), lease_seconds)).select("id", "created_at"),
            [], ["created_at", "id"], {"n": ordinal()},
        )
        taken = ready.join(claims, "n").select("id", "claimer", F.col("at").alias("claimed_at"))
        following = jobs.join(taken, "id", "left").select(
            "id",
            F.when(F.col("claimer").isNotNull(), "running").otherwise(F.col("status")).alias("status"),
            F.coalesce("claimer", "worker_id").alias("worker_id"),
            "created_at",
            F.coalesce("claimed_at", "heartbeat_at").alias("heartbeat_at"),
        )
        # a worker may also beat for, or end, what it has taken in this batch
        return taken, heard(following)

    return step
