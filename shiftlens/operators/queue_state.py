"""Queue, lease and step-log state, derived from event rows.

Spark has no row locks: two sessions that claim at the same time can pick the same job.  The
selection is the same as the queue's; a deployment runs it in a single writer (see
``streaming.job_events``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .ordered import following, previous, with_running

# The steps a job's log may take after each step.
NEXT_STEPS = {
    "ingest": ("plan",),
    "plan": ("execute", "report"),
    "execute": ("verify",),
    "verify": ("execute", "recover", "integrate"),
    "recover": ("execute", "plan", "verify", "integrate"),
    "integrate": ("recover", "report"),
    "report": (),
}


def queue_head(jobs: DataFrame, now: Column, lease_seconds: float = 15.0) -> DataFrame:
    """The job the next worker claims: the oldest claimable one."""
    ready = jobs.filter(P.claimable(F.col("status"), F.col("heartbeat_at"), now, lease_seconds))
    return ready.orderBy("created_at", "id").limit(1)


def claimed(jobs: DataFrame, now: Column, worker: str, lease_seconds: float = 15.0) -> DataFrame:
    """The job table after one claim."""
    head = queue_head(jobs, now, lease_seconds).select(F.col("id").alias("_claimed"))
    taken = F.col("id") == head.scalar()
    taken = F.coalesce(taken, F.lit(False))
    return jobs.select(
        "id",
        F.when(taken, "running").otherwise(F.col("status")).alias("status"),
        F.when(taken, worker).otherwise(F.col("worker_id")).alias("worker_id"),
        F.when(taken, now).otherwise(F.col("heartbeat_at")).alias("heartbeat_at"),
    )


def renewed_leases(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """(id, worker_id, heartbeat_at): running jobs after heartbeats (job_id, worker_id, at).

    Only the worker that holds a running job renews its lease; beats of a worker that has lost the job, and beats for
    jobs in any other state, change nothing.
    """
    latest = beats.groupBy(F.col("job_id").alias("id"), F.col("worker_id").alias("beating")).agg(F.max("at").alias("beat"))
    held = jobs.select("id", "status", "worker_id", "heartbeat_at")
    own = (F.col("worker_id") == F.col("beating")) & (F.col("status") == "running")
    joined = held.join(latest.withColumnRenamed("id", "beat_id"), (F.col("id") == F.col("beat_id")) & own, "left")
    return joined.filter("status = 'running'").select("id", "worker_id", F.greatest("heartbeat_at", "beat").alias("heartbeat_at"))


def last_heartbeats(beats: DataFrame) -> DataFrame:
    return beats.groupBy("job_id").agg(F.max("at").alias("heartbeat_at"), F.count("*").alias("beats"))


def expired_leases(beats: DataFrame, lease_seconds: float) -> DataFrame:
    """Heartbeats after which the lease ran out before the next one came."""
    placed = with_running(beats, ["job_id"], ["at", "seq"], {"next_at": following(F.col("at"))})
    late = F.col("next_at") > F.col("at") + F.make_dt_interval(secs=F.lit(float(lease_seconds)))
    return placed.filter(late).select("job_id", "seq", "at", "next_at")


def latest_checkpoint(steps: DataFrame) -> DataFrame:
    """How a job goes on after a restart, from its newest step."""
    last = steps.groupBy("job_id").agg(F.max_by("step", F.struct("at", "seq")).alias("step"))
    return last.withColumn("decision", resume_decision(F.col("step")))


def resume_decision(step: Column) -> Column:
    return F.when(step.isNull(), "start").when(step == "report", "no_op").otherwise("resume")


def transition_audit(steps: DataFrame) -> DataFrame:
    """Every step with the one before it and whether the routing allows that move.

    A log starts with ingest; a second move from integrate to recover is not allowed.
    """
    placed = with_running(steps, ["job_id"], ["at", "seq"], {"came_from": previous(F.col("step"))})
    allowed = F.col("came_from").isNull() & (F.col("step") == "ingest")
    for source, targets in NEXT_STEPS.items():
        if targets:
            allowed = allowed | ((F.col("came_from") == source) & F.col("step").isin(*targets))
    return placed.withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def requests_per_minute(requests: DataFrame, limit: int = 10) -> DataFrame:
    """Requests per address and minute against the limit."""
    return (
        requests.groupBy("address", F.window("at", "1 minute")["start"].alias("minute"))
        .agg(F.count("*").alias("n"))
        .withColumn("over", F.col("n") > limit)
    )


def daily_totals(events: DataFrame, limit: int, ceiling: float) -> DataFrame:
    """Jobs per user and day against the quota, and their cost against the spend ceiling."""
    day = F.date_trunc("day", F.col("at")).cast("timestamp_ntz")
    return events.groupBy("user_id", day.alias("day")).agg(
        F.count("*").alias("n"),
        F.bround(F.sum("cost"), 4).alias("cost"),
        (F.count("*") >= limit).alias("over_quota"),
        (F.bround(F.sum("cost"), 4) >= ceiling).alias("over_spend"),
    )


def unchanged_done(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks to skip on a resume: done, with the hash the file has now."""
    return tasks.filter(F.col("status") == "done").join(
        files.select(F.col("path").alias("target_path"), F.col("content_hash").alias("now_hash")), "target_path"
    ).filter(F.col("content_hash") == F.col("now_hash")).drop("now_hash")


def channel_entries(updates: DataFrame) -> DataFrame:
    """Append-only channels as rows with their place: the fold of ``old + new`` per job and channel."""
    from .ordered import ordinal

    return with_running(updates, ["job_id", "channel"], ["at", "seq"], {"place": ordinal()})
