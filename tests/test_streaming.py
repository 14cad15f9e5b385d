"""Micro-batch folds give what the batch operators give on all rows at once."""

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import accounts, attempts, queue_state
from shiftlens.plans import relations as R
from shiftlens.streaming import folds, live, windows

FOLDER = "/root/testdata/sf0.001"


def stream_of(spark, df, folder, parts=3):
    """Write rows in event order as a few files and read them back as a stream of one file each."""
    total = df.count()
    for i in range(parts):
        low, high = total * i // parts, total * (i + 1) // parts
        df.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return windows.read_events(spark, str(folder / "in"), df.schema.simpleString()[7:-1].replace(":", " "), 1)


def run(spark, stream, folder, schema, step):
    query = folds.fold(stream, str(folder / "fold"), schema, step)
    query.awaitTermination()
    return folds.output_of(spark, str(folder / "fold"))


def plain(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_token_rotation(spark, tmp_path):
    uses = R.table(spark, FOLDER, "events").select(
        R.text_of("user_id").alias("family_id"), F.col("event_id").alias("seq"),
        (F.floor(F.col("event_id") / 100) + F.when(F.col("event_type") == "error", -1).otherwise(0)).alias("generation"),
    )
    got = run(spark, stream_of(spark, uses, tmp_path), tmp_path, folds.TOKEN_STATE, folds.token_step)
    columns = ("family_id", "seq", "generation", "outcome")
    assert plain(got, *columns) == plain(accounts.token_uses(uses), *columns)


def test_leases(spark, tmp_path):
    beats = R.table(spark, FOLDER, "events").select(R.text_of("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    got = run(spark, stream_of(spark, beats, tmp_path), tmp_path, folds.LEASE_STATE, folds.lease_step(86400.0))
    assert plain(got, "job_id", "seq") == plain(queue_state.expired_leases(beats, 86400.0), "job_id", "seq")


def test_failure_repeats(spark, tmp_path):
    actions = R.recovery_actions(spark, FOLDER).select("job_id", "seq", "at", "fingerprint")
    got = run(spark, stream_of(spark, actions, tmp_path), tmp_path, folds.REPEAT_STATE, folds.repeat_step)
    assert plain(got, "job_id", "seq", "repeat") == plain(attempts.failure_ordinals(actions), "job_id", "seq", "repeat")


def test_queue_claims_are_disjoint_and_oldest_first(spark, tmp_path):
    rows = [
        (0, "enqueue", "a", None, "2024-01-01 00:00:00"), (1, "enqueue", "b", None, "2024-01-01 00:00:01"),
        (2, "claim", None, "w1", "2024-01-01 00:00:02"), (3, "enqueue", "c", None, "2024-01-01 00:00:03"),
        (4, "claim", None, "w2", "2024-01-01 00:00:04"), (5, "heartbeat", "a", "w9", "2024-01-01 00:00:15"),
        (6, "finish", "a", "w9", "2024-01-01 00:00:15"), (7, "heartbeat", "b", "w2", "2024-01-01 00:00:16"),
        (8, "claim", None, "w3", "2024-01-01 00:00:30"), (9, "claim", None, "w4", "2024-01-01 00:00:31"),
        (10, "finish", "b", "w2", "2024-01-01 00:00:31"), (11, "finish", "c", "w1", "2024-01-01 00:00:31"),
    ]
    events = spark.createDataFrame(rows, "seq long, kind string, id string, worker_id string, t string").select(
        "seq", "kind", "id", "worker_id", F.col("t").cast("timestamp_ntz").alias("at")
    )
    got = run(spark, stream_of(spark, events, tmp_path), tmp_path, folds.JOB_STATE, folds.queue_step(15.0))
    # w1 takes a, w2 takes b; a goes silent, and w9, which does not hold it, neither renews nor ends it, so w3 takes it
    # again and w4 the waiting c
    assert plain(got, "id", "claimer") == [("a", "w1"), ("a", "w3"), ("b", "w2"), ("c", "w4")]


def test_rate_limit_stream(spark, tmp_path):
    requests = R.table(spark, FOLDER, "events").select(
        (F.col("user_id") % 10).alias("address"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at")
    )
    stream = windows.requests_per_minute(stream_of(spark, requests, tmp_path), 1, "1 hour")
    query = stream.writeStream.format("memory").queryName("minutes").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = queue_state.requests_per_minute(requests, 1)
    assert plain(spark.table("minutes"), "address", "minute", "n") == plain(want, "address", "minute", "n")


def collected(spark, frame, folder, name):
    query = frame.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(folder / name))


@pytest.mark.parametrize("parts", [1, 4])
def test_live_token_families(spark, tmp_path, parts):
    """State kept by Spark gives what the batch operator gives, over one batch or several."""
    live.use_state_store(spark)
    uses = R.table(spark, FOLDER, "events").select(
        R.text_of("user_id").alias("family_id"), F.col("event_id").alias("seq"),
        (F.floor(F.col("event_id") / 100) + F.when(F.col("event_type") == "error", -1).otherwise(0)).alias("generation"),
    )
    got = collected(spark, live.token_uses(stream_of(spark, uses, tmp_path, parts)), tmp_path, "out")
    columns = ("family_id", "seq", "generation", "outcome")
    assert plain(got, *columns) == plain(accounts.token_uses(uses), *columns)


@pytest.mark.parametrize("parts", [1, 3])
def test_live_leases(spark, tmp_path, parts):
    """Gaps, and the silence of jobs whose lease is over by the watermark."""
    live.use_state_store(spark)
    beats = R.table(spark, FOLDER, "events").select(R.text_of("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    got = collected(spark, live.lapses(stream_of(spark, beats, tmp_path, parts), 86400.0, "0 seconds"), tmp_path, "out")
    gaps = set(plain(queue_state.expired_leases(beats, 86400.0), "job_id", "seq"))
    found = plain(got, "job_id", "seq")
    assert len(found) == len(set(found)) and gaps <= set(found)
    last = beats.groupBy("job_id").agg(F.max_by(F.struct("seq", "at"), F.struct("at", "seq")).alias("l")).select("job_id", "l.seq", "l.at")
    end = beats.agg(F.max("at")).first()[0]
    silent = {tuple(r) for r in last.filter(F.col("at") + F.expr("INTERVAL 1 DAY") < F.lit(end)).select("job_id", "seq").collect()}
    assert set(found) - gaps == silent
