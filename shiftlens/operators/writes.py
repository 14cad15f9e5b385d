"""Writes to the job, task and account tables as functions from old rows to new rows.

Plain files have no UPDATE.  Each operator returns the rows a writer appends or the table after the
change, so that running it twice changes nothing more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import last_seen, with_running

ERROR_LENGTH = 2000


def queued_jobs(requests: DataFrame) -> DataFrame:
    """Requests as new queued jobs; ids come from the caller so a retry makes the same job."""
    return requests.select("id", "repo_url", "migration_recipe", F.lit("queued").alias("status"), "user_id", "created_at")


def plan_if_absent(specs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Specs of the jobs that have no top-level task yet."""
    planned = tasks.filter(F.col("parent_id").isNull()).select("job_id").distinct()
    return specs.join(planned, "job_id", "left_anti")


def append_missing(specs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Specs whose path is not planned in their job; a NULL path matches a NULL path."""
    planned = tasks.filter(F.col("parent_id").isNull()).select(
        F.col("job_id").alias("_job"), F.col("target_path").alias("_path")
    ).distinct()
    same = (F.col("job_id") == F.col("_job")) & F.col("target_path").eqNullSafe(F.col("_path"))
    return specs.join(planned, same, "left_anti")


def with_architect_task(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The one architecture task per job: the stored one, or a new pending one ahead of all files."""
    stored = tasks.filter(F.col("parent_id").isNull() & (F.col("type") == "artifact_architect"))
    one = stored.groupBy("job_id").agg(F.min_by(F.struct("id", "status", "order_index"), F.struct("created_at", "id")).alias("t"))
    return jobs.select(F.col("id").alias("job_id")).join(one, "job_id", "left").select(
        "job_id",
        F.coalesce("t.id", F.concat(F.col("job_id"), F.lit("-architect"))).alias("id"),
        F.coalesce("t.status", F.lit("pending")).alias("status"),
        F.coalesce("t.order_index", F.lit(-20)).alias("order_index"),
        F.col("t").isNull().alias("created"),
    )


def patched(tasks: DataFrame, patches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sparse update: a NULL in the patch keeps the old value, ``cascade`` passes status to children.

    ``patches`` has one row per task id and may set ``cascade``.
    """
    own = patches.select(F.col("id"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    down = patches.filter(F.coalesce("cascade", F.lit(False)) & F.col("status").isNotNull()).select(
        F.col("id").alias("parent_id"), F.col("status").alias("_down")
    )
    updated = tasks.join(own, "id", "left")
    # top-level tasks have no parent to hear from; kept out of the join their NULLs cannot pile up
    top = updated.filter(F.col("parent_id").isNull()).withColumn("_down", F.lit(None).cast("string"))
    joined = updated.filter(F.col("parent_id").isNotNull()).join(down, "parent_id", "left").unionByName(top)

    def value(name: str) -> Column:
        if name not in columns:
            return F.col(name)
        kept = F.coalesce(F.col(f"_new_{name}"), F.col(name))
        return (F.coalesce(F.col("_down"), kept) if name == "status" else kept).alias(name)

    return joined.select(*[value(c) for c in tasks.columns])


def appended_attempt(log: Column, entry: Column) -> Column:
    return F.when(entry.isNull(), log).otherwise(F.array_append(F.coalesce(log, F.array()), entry))


def amended_attempt(log: Column, changes: dict[str, Column]) -> Column:
    """Merge keys into the last entry; an empty log stays empty."""
    last = F.try_element_at(log, F.lit(-1))
    for name, value in changes.items():
        last = last.withField(name, F.coalesce(value, last[name]))
    return F.when(F.size(log) > 0, F.concat(F.slice(log, 1, F.greatest(F.size(log) - 1, F.lit(0))), F.array(last))).otherwise(log)


def ended(jobs: DataFrame, endings: DataFrame) -> DataFrame:
    """Apply terminal events: status and error are set, the heartbeat is cleared."""
    last = endings.groupBy("job_id").agg(F.max_by(F.struct("status", "error", "at"), F.struct("at", "status")).alias("e"))
    joined = jobs.join(last, F.col("id") == F.col("job_id"), "left")
    has = F.col("e").isNotNull()
    return joined.select(
        "id",
        F.when(has, F.col("e.status")).otherwise(F.col("status")).alias("status"),
        F.when(has, F.lit(None)).otherwise(F.col("heartbeat_at")).alias("heartbeat_at"),
        F.when(has, F.substring(F.col("e.error"), 1, ERROR_LENGTH)).otherwise(F.col("error")).alias("error"),
        F.when(has, F.col("e.at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upserted_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users after a round of logins: a known account takes the new name, an unknown one is added."""
    newest = logins.groupBy("github_id").agg(F.max_by("login", "at").alias("new_login"))
    joined = users.join(newest, "github_id", "full")
    return joined.select(
        "github_id",
        F.coalesce("id", F.concat(F.lit("gh-"), F.col("github_id").cast("string"))).alias("id"),
        F.coalesce("new_login", "login").alias("login"),
        F.coalesce("role", F.lit("user")).alias("role"),
    )


def revoked_families(tokens: DataFrame, presented: DataFrame) -> DataFrame:
    """All tokens of a family are revoked once one of them is presented for it."""
    hit = tokens.join(presented.select("token_hash"), "token_hash", "left_semi").select("family_id").distinct()
    marked = tokens.join(hit.withColumn("hit", F.lit(True)), "family_id", "left")
    return marked.select(*[c for c in tokens.columns if c != "revoked"], (F.col("revoked") | F.coalesce("hit", F.lit(False))).alias("revoked"))


def merged_pins(old: DataFrame, new: DataFrame) -> DataFrame:
    """A replan's pins: a pin already frozen keeps its decision, new keys are added."""
    a = old.select("path", "symbol", F.col("decision").alias("old_decision"))
    b = new.select("path", "symbol", F.col("decision").alias("new_decision"))
    return a.join(b, ["path", "symbol"], "full").select(
        "path", "symbol", F.coalesce("old_decision", "new_decision").alias("decision")
    )


def snapshot_rows(files: DataFrame, batches: DataFrame) -> DataFrame:
    """The state of a batch's files before it ran: their newest version older than the batch.

    ``files`` are versions (job_id, path, version, content_hash), ``batches`` are
    (job_id, batch, path, version); a path without an older version did not exist.  Versions and
    batches are put in one order and the last version seen is carried along, so a file with very
    many versions is not joined with all its batches.
    """
    none = F.lit(None)
    versions = files.select(
        "job_id", "path", "version", F.lit(1).alias("kind"), none.cast("long").alias("batch"), F.struct("content_hash").alias("state")
    )
    # at equal numbers the batch comes first, since it does not see its own version
    marks = batches.select(
        "job_id", "path", "version", F.lit(0).alias("kind"), F.col("batch").cast("long").alias("batch"),
        none.cast("struct<content_hash:string>").alias("state"),
    )
    placed = with_running(
        versions.unionByName(marks), ["job_id", "path"], ["version", "kind", "batch"], {"before": last_seen(F.col("state"))}
    )
    return placed.filter("kind = 0").select(
        "job_id", "batch", "path", F.col("before.content_hash").alias("content_hash"), F.col("before").isNotNull().alias("existed")
    )


def restored(current: DataFrame, snapshot: DataFrame, failed: DataFrame) -> DataFrame:
    """Files after the failed batches are undone; files a batch had created are gone.

    When several failed batches cover a path, the oldest snapshot counts.
    """
    undo = snapshot.join(failed, ["job_id", "batch"], "left_semi").groupBy("job_id", "path").agg(
        F.min_by(F.struct("content_hash", "existed"), "batch").alias("undo")
    )
    return (
        current.join(undo, ["job_id", "path"], "left")
        .filter(F.col("undo").isNull() | F.col("undo.existed"))
        .select(
            "job_id",
            "path",
            F.when(F.col("undo").isNull(), F.col("content_hash")).otherwise(F.col("undo.content_hash")).alias("content_hash"),
        )
    )
