"""Cost, token and retry reports over the attempt ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordinal, running_sum, with_running

# The actions that stand for one model call.
MODEL_CALLS = ("architect", "architect_repair", "migrate", "contract_repair", "diagnose")


def exploded(tasks: DataFrame) -> DataFrame:
    """One row per attempt with its place in the log; a task without attempts has none."""
    return tasks.select(
        *[c for c in tasks.columns if c != "attempts_log"], F.posexplode("attempts_log").alias("pos", "attempt_row")
    )


def spend(tasks: DataFrame, owners: DataFrame) -> DataFrame:
    """Recorded cost per user.  Attempts without a cost key take no part.

    Cost is summed per job before the owner is joined, so the join moves one row per job.
    """
    cost = F.col("attempt_row.cost_usd")
    per_job = exploded(tasks).filter(cost.isNotNull()).groupBy("job_id").agg(
        F.sum(cost).alias("cost"), F.count("*").alias("n")
    )
    return per_job.join(owners, "job_id").groupBy("user_id").agg(
        F.bround(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("spend"), F.sum("n").alias("paid_attempts")
    )


def spend_since(tasks: DataFrame, since: Column) -> DataFrame:
    cost = F.col("attempt_row.cost_usd")
    today = exploded(tasks.filter(F.col("created_at") >= since))
    return today.agg(F.bround(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("spend"))


def usage(tasks: DataFrame) -> DataFrame:
    """Model calls, tokens and cost per job.  Calls count some actions; sums take all attempts."""
    def total(name: str, kind: str) -> Column:
        field = F.transform("attempts_log", lambda a: F.coalesce(a[name].cast(kind), F.lit(0).cast(kind)))
        return F.sum(F.aggregate(field, F.lit(0).cast(kind), lambda acc, x: acc + x))

    calls = F.size(F.filter("attempts_log", lambda a: a["action"].isin(*MODEL_CALLS)))
    return tasks.groupBy("job_id").agg(
        F.sum(calls.cast("long")).alias("calls"),
        total("prompt_tokens", "long").alias("prompt_tokens"),
        total("completion_tokens", "long").alias("completion_tokens"),
        F.bround(total("cost_usd", "double"), 6).alias("cost_usd"),
    )


def escalations(tasks: DataFrame) -> DataFrame:
    escalated = F.exists("attempts_log", lambda a: a["tier"] == "escalation")
    return tasks.groupBy("job_id").agg(
        F.count_if(escalated).alias("escalation_attempted"),
        F.count_if(escalated & (F.col("status") == "done")).alias("escalation_rescued"),
    )


def recovery_summary(actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per job: recovery visits, stalled retries, the last classification and skipped tasks."""
    place = F.struct("at", "seq")
    seen = actions.groupBy("job_id").agg(
        F.count("*").alias("visits"),
        F.count_if(F.col("budget_charged")).alias("budget_used"),
        F.count_if(F.col("classification").contains("no_progress")).alias("no_progress_retries"),
        F.max_by("classification", place).alias("last_classification"),
    )
    skipped = tasks.groupBy("job_id").agg(F.count_if(F.col("status") == "skipped").alias("tasks_skipped"))
    return seen.join(skipped, "job_id", "full")


def architect_analysis(tasks: DataFrame) -> DataFrame:
    """Per architecture task: its calls, repairs and the model that made the first call."""
    calls = F.filter("attempts_log", lambda a: a["action"].isin("architect", "architect_repair"))
    first = F.filter("attempts_log", lambda a: a["action"] == "architect")
    repairs = F.filter("attempts_log", lambda a: a["action"] == "architect_repair")
    return tasks.filter(F.col("type") == "artifact_architect").select(
        "id",
        F.size(calls).alias("calls"),
        F.size(repairs).alias("repairs"),
        F.try_element_at(first, F.lit(1))["model"].alias("model"),
    )


def latest_attempt(tasks: DataFrame) -> DataFrame:
    last = F.try_element_at("attempts_log", F.lit(-1))
    return tasks.select("id", *[last[c].alias(c) for c in ("attempt", "tier", "action", "cost_usd")])


def latest_failing_diff(tasks: DataFrame) -> DataFrame:
    """The newest diff that is not empty, or an empty text."""
    with_diff = F.filter("attempts_log", lambda a: F.coalesce(a["failing_diff"], F.lit("")) != "")
    return tasks.select("id", F.coalesce(F.try_element_at(with_diff, F.lit(-1))["failing_diff"], F.lit("")).alias("diff"))


def targeted_repairs(tasks: DataFrame) -> DataFrame:
    """How many runtime-targeted contract repairs each task had."""
    hits = F.filter(
        "attempts_log", lambda a: (a["action"] == "contract_repair") & (a["scope"] == "runtime_targeted")
    )
    return tasks.select("id", F.size(hits).alias("targeted_repairs"))


def failure_ordinals(actions: DataFrame) -> DataFrame:
    """Which occurrence of the same failure a recovery visit is, and what follows from it."""
    placed = with_running(actions, ["job_id", "fingerprint"], ["at", "seq"], {"repeat": ordinal()})
    verdict = F.when(F.col("repeat") >= 3, "stop").when(F.col("repeat") == 2, "diagnose").otherwise("retry")
    return placed.withColumn("verdict", verdict)


def budget_ledger(actions: DataFrame, file_tasks: Column, max_visits: int = 4, repairs: int = 1) -> DataFrame:
    """Running visits and charged budget per job against their limits."""
    placed = with_running(
        actions,
        ["job_id"],
        ["at", "seq"],
        {"visit": ordinal(), "budget_used": running_sum(F.col("budget_charged").cast("long"))},
    )
    hard_limit = F.lit(max_visits + 2) + file_tasks * repairs
    return placed.withColumn(
        "stop",
        F.when(F.col("visit") > hard_limit, "hard_safety_cap").when(F.col("budget_used") > max_visits, "budget_exhausted"),
    )


def ceiling_skips(attempts: DataFrame, ceiling: Column) -> DataFrame:
    """Attempts in order with what was spent before them; at the ceiling the rest is skipped.

    A ceiling of 0 never skips.
    """
    placed = with_running(
        attempts, ["job_id"], ["at", "seq"], {"spent_before": running_sum(F.col("cost_usd"), inclusive=False)}
    )
    over = (ceiling > 0) & (F.col("spent_before") >= ceiling)
    return placed.withColumn("skipped", over)


def latest_overlap(implicated: DataFrame, batches: DataFrame) -> DataFrame:
    """The newest verified batch that shares a path with the implicated ones, per job.

    Both inputs hold one row per path; the join is on the path, so batches are never compared
    pairwise.
    """
    hit = batches.join(implicated.distinct(), ["job_id", "path"])
    return hit.groupBy("job_id").agg(F.max("seq").alias("batch_seq"))


def containing(members: DataFrame, paths: DataFrame) -> DataFrame:
    """Which units, cuts or decisions a path belongs to; ``members`` has one row per member."""
    return members.join(paths, ["job_id", "path"])
