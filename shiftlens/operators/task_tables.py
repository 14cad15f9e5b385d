"""Reads of the job and task tables: pages, trees, progress and per-job summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .ordered import ordinal, with_running


def jobs_page(jobs: DataFrame, user_id: str, is_admin: bool, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the visible jobs, newest first, with the total next to every row.

    The page is a top-(offset + limit) selection, so no task sorts the whole table.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    seen = jobs.filter(P.visible_to(F.col("user_id"), user_id, is_admin))
    total = seen.agg(F.count("*").alias("total")).scalar()
    page = seen.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return page.withColumn("total_count", total)


def job_by_id(jobs: DataFrame, job_id: str, user_id: str, is_admin: bool) -> DataFrame:
    """The job, or nothing when it is missing or someone else's."""
    mine = P.visible_to(F.col("user_id"), user_id, is_admin)
    return jobs.filter((F.col("id") == job_id) & mine).limit(1)


def top_level(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("parent_id").isNull())


def task_tree(tasks: DataFrame) -> DataFrame:
    """Parents with their children, one row per child; a childless parent keeps one row.

    Children stay rows with their sort keys instead of being gathered in an array, so a parent with
    very many children is no single row.  Parents with children come from an inner join, whose
    skewed keys Spark can split on either side; an outer join could not split the children.  A child
    whose parent is missing drops out.
    """
    parents = top_level(tasks).select(
        "job_id",
        F.col("id").alias("task_id"),
        F.col("order_index").alias("task_order"),
        F.col("created_at").alias("task_created_at"),
        F.col("status").alias("task_status"),
    )
    children = tasks.filter(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("task_id"),
        F.col("id").alias("child_id"),
        F.col("order_index").alias("child_order"),
        F.col("created_at").alias("child_created_at"),
        F.col("status").alias("child_status"),
    )
    childless = parents.join(children.select("task_id").distinct(), "task_id", "left_anti")
    return parents.join(children, "task_id").unionByName(childless, allowMissingColumns=True)


def child_summary(tasks: DataFrame) -> DataFrame:
    """Per parent: how many children there are and which come first and last."""
    order = F.struct("child_order", "child_created_at", "child_id")
    return task_tree(tasks).groupBy("job_id", "task_id").agg(
        F.count("child_id").alias("children"),
        F.min_by("child_id", F.when(F.col("child_id").isNotNull(), order)).alias("first_child"),
        F.max_by("child_id", F.when(F.col("child_id").isNotNull(), order)).alias("last_child"),
    )


def progress(tasks: DataFrame) -> DataFrame:
    """Both readings of progress over the file tasks of a job."""
    status = F.col("status")
    files = top_level(tasks).filter(F.col("target_path").isNotNull())
    return files.groupBy("job_id").agg(
        F.count("*").alias("file_tasks"),
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status.isin("done", "skipped")).alias("settled"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    """Totals over all top-level tasks, the architect task included."""
    return top_level(tasks).groupBy("job_id").agg(
        F.count("*").alias("tasks_total"),
        F.count_if(F.col("status") == "done").alias("tasks_done"),
    )


def stages(jobs: DataFrame, tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """State of every step of a job, as a reader sees it."""
    files = tasks.filter(F.col("target_path").isNotNull())
    counts = files.groupBy("job_id").agg(F.bool_and(F.col("status").isin("done", "skipped")).alias("settled"))
    joined = (
        jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
        .join(counts, "job_id", "left")
        .join(reports.select("job_id", "recover_visits", F.lit(True).alias("reported")), "job_id", "left")
    )
    planned = F.col("settled").isNotNull()
    settled = F.coalesce("settled", F.lit(False))
    running, ended = F.col("job_status") == "running", F.col("job_status").isin("done", "failed")

    def state(done: Column, active: Column) -> Column:
        return F.when(done, "done").when(running & active, "active").otherwise("pending")

    never = F.lit(False)
    return joined.select(
        "job_id",
        state(planned | ended, ~planned).alias("ingest"),
        state(planned | ended, never).alias("plan"),
        state(settled | ended, planned & ~settled).alias("execute"),
        state(ended, settled).alias("verify"),
        F.when(F.coalesce("recover_visits", F.lit(0)) > 0, "done").otherwise("optional").alias("recover"),
        state(ended, never).alias("integrate"),
        state(F.coalesce("reported", never), never).alias("report"),
    )


def with_reports(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs next to their report's outcome, NULL when there is none, and what to show for it."""
    joined = jobs.select(F.col("id").alias("job_id"), "status").join(reports, "job_id", "left")
    shown = P.shown_outcome(F.col("status"), F.col("migration_outcome"))
    return joined.select(
        "job_id", "status", "migration_outcome", shown.alias("shown"), P.outcome_group(shown).alias("list_group")
    )


def artifact_status(artifacts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Planned artifacts with the status of the first task on the same path."""
    first = top_level(tasks).groupBy("job_id", F.col("target_path").alias("path")).agg(
        F.min_by("status", F.struct("order_index", "created_at", "id")).alias("status")
    )
    return artifacts.join(first, ["job_id", "path"], "left")


def first_eligible(tasks: DataFrame, protected: Sequence[str]) -> DataFrame:
    """Per job the first path a fault may hit."""
    ok = F.col("target_path").isNotNull() & ~F.col("type").isin(*protected)
    return top_level(tasks).filter(ok).groupBy("job_id").agg(
        F.min_by("target_path", F.struct("order_index", "created_at", "id")).alias("first_path")
    )


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows per key.

    Spark turns the rank filter into a limit per input partition before the shuffle, so a key with
    very many rows sends at most ``k`` from each of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= k)


def renumber(tasks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Dense positions times ten, per job."""
    placed = with_running(tasks, ["job_id"], order, {"position": ordinal()})
    return placed.withColumn("order_index", ((F.col("position") - 1) * 10).cast("int")).drop("position")


def next_batch(tasks: DataFrame, units: DataFrame) -> DataFrame:
    """The next paths to work on per job, from the task rows alone.

    ``units`` has one row per (job_id, unit_id, path), units of a job being disjoint.  A unit
    counts when all its paths are planned, none is skipped and one is pending.  The earliest such
    unit is taken unless it starts after the first pending task, which otherwise is the batch.
    """
    files = tasks.filter(F.col("target_path").isNotNull()).select(
        "job_id", F.col("target_path").alias("path"), "status", "order_index"
    )
    first = files.filter(F.col("status") == "pending").groupBy("job_id").agg(
        F.min_by("path", F.struct("order_index", "path")).alias("first_path"),
        F.min("order_index").alias("first_order"),
    )
    whole = (
        units.join(files, ["job_id", "path"], "left")
        .groupBy("job_id", "unit_id")
        .agg(
            F.bool_and(F.coalesce(F.col("status") != "skipped", F.lit(False))).alias("usable"),
            F.bool_or(F.coalesce(F.col("status") == "pending", F.lit(False))).alias("waiting"),
            F.min("order_index").alias("unit_order"),
        )
        .filter("usable AND waiting")
        .groupBy("job_id")
        .agg(F.min(F.struct("unit_order", "unit_id")).alias("unit"))
    )
    chosen = first.join(whole, "job_id", "left").select(
        "job_id",
        "first_path",
        F.when(F.col("unit.unit_order") <= F.col("first_order"), F.col("unit.unit_id")).alias("unit_id"),
    )
    alone = chosen.filter("unit_id IS NULL").select("job_id", F.col("first_path").alias("path"))
    return alone.unionByName(chosen.join(units, ["job_id", "unit_id"]).select("job_id", "path"))


def verifiable_batch(tasks: DataFrame, units: DataFrame) -> DataFrame:
    """``next_batch`` grown in task order until it owns a test.

    ``tasks`` also has ``owns_tests``.  A compat task in the first batch, or a test in it, ends the
    growth at once.  A task brings its whole unit along, so what it adds owns a test when any member
    of its unit does; without any test the batch is everything pending.
    """
    files = tasks.filter(F.col("target_path").isNotNull()).select(
        "job_id", F.col("target_path").alias("path"), "status", "order_index", "owns_tests",
        (F.col("type") == "test_compat").alias("is_compat"),
    )
    unit_tests = (
        units.join(files.select("job_id", "path", "owns_tests"), ["job_id", "path"])
        .groupBy("job_id", "unit_id")
        .agg(F.bool_or("owns_tests").alias("unit_owns"))
    )
    start = next_batch(tasks, units)
    settled = (
        start.join(files, ["job_id", "path"])
        .groupBy("job_id")
        .agg(F.bool_or(F.col("owns_tests") | F.col("is_compat")).alias("settled"))
    )
    waiting = (
        files.filter(F.col("status") == "pending")
        .join(settled.filter(~F.col("settled")).select("job_id"), "job_id", "left_semi")
        .join(start, ["job_id", "path"], "left_anti")
        .join(units, ["job_id", "path"], "left")
        .join(unit_tests, ["job_id", "unit_id"], "left")
        .withColumn("brings_tests", F.col("owns_tests") | F.coalesce("unit_owns", F.lit(False)))
    )
    place = F.struct("order_index", "path")
    stop = waiting.groupBy("job_id").agg(F.min(F.when(F.col("brings_tests"), place)).alias("stop"))
    grown = waiting.join(stop, "job_id").filter(F.coalesce(place <= F.col("stop"), F.lit(True)))
    by_unit = grown.filter("unit_id IS NOT NULL").select("job_id", "unit_id").distinct().join(units, ["job_id", "unit_id"])
    return (
        start.unionByName(grown.select("job_id", "path")).unionByName(by_unit.select("job_id", "path")).distinct()
    )
