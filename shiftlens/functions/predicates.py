"""Boolean and classifying expressions over job, task and test-summary columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The message fragments that name an architecture rejection, in order of precedence.
_REJECTIONS = (
    (("must declare at least one export",), "schema_missing_export"),
    (("strict json",), "schema_invalid_json"),
    (("requires exactly one owner artifact, got 0",), "policy_missing_owner"),
    (("requires exactly one class export", "wrong export kinds"), "policy_contract_shape"),
)


def verify_passed(passed: Column, failed: Column, errors: Column) -> Column:
    """Some test passed and none broke; a suite of skips alone does not pass."""
    return (passed > 0) & (failed == 0) & (errors == 0)


report_suite_ok = verify_passed


def junit_ok(total: Column, failed: Column, errors: Column) -> Column:
    """Nothing broke and something ran; a suite of skips alone does pass."""
    return (failed == 0) & (errors == 0) & (total > 0)


def harness_suite_ok(total: Column, passed: Column) -> Column:
    """Every test passed; a single skip does not."""
    return (total > 0) & (passed == total)


def run_status(job_status: Column, total: Column, passed: Column, tasks: Column, done: Column, outcome: Column) -> Column:
    """Status of a run from its job (NULL when the wait ran out) and its report."""
    green = harness_suite_ok(total, passed) & (tasks > 0) & (done == tasks) & (outcome == "success")
    return (
        F.when(job_status.isNull(), "timeout")
        .when(job_status == "failed", "error")
        .when(job_status != "done", "timeout")
        .when(green, "green")
        .otherwise("red")
    )


def rejection_class(error: Column) -> Column:
    """Name the reason an architecture proposal was turned down."""
    text = F.lower(F.coalesce(error, F.lit("")))
    chain = F
    for needles, name in _REJECTIONS:
        chain = chain.when(reduce(Column.__or__, [text.contains(n) for n in needles]), name)
    path_rule = text.contains("path") & (text.contains("forbidden") | text.contains("allowed_new_artifact_paths"))
    return (
        chain.when(path_rule, "policy_path")
        .when(text.contains("artifact architecture rejected"), "schema_or_policy_other")
        .otherwise("engine_or_unknown")
    )


def plan_only_status(architect_status: Column) -> Column:
    accepted = architect_status.isNull() | (architect_status == "done")
    return F.when(accepted, "green").otherwise("red")


def migration_outcome(
    plan_only: Column, architect_status: Column, unsupported: Column, migrates: Column, suite_ok: Column,
    tasks: Column, done: Column, oracle_breaks: Column,
) -> Column:
    """The report's verdict; the first rule that applies wins."""
    accepted = architect_status.isNull() | (architect_status == "done")
    return (
        F.when(plan_only & accepted, "plan_accepted")
        .when(plan_only, "plan_rejected")
        .when(unsupported > 0, "unsupported")
        .when(migrates & suite_ok & (done == tasks) & (oracle_breaks == 0), "success")
        .when(migrates, "failed")
        .otherwise("not_applicable")
    )


def shown_outcome(status: Column, outcome: Column) -> Column:
    """What a reader is told: the live status first, then the report, then plain ``done``."""
    return F.when(status.isin("queued", "running", "failed"), status).otherwise(F.coalesce(outcome, F.lit("done")))


def outcome_group(outcome: Column) -> Column:
    """The list filter a job falls under, NULL when only the full list shows it."""
    return (
        F.when(outcome.isin("queued", "running"), "active")
        .when(outcome == "success", "success")
        .when(outcome.isin("failed", "unsupported"), "attention")
    )


def visible_to(owner: Column, user_id: str, is_admin: bool) -> Column:
    """Admins see all rows; others their own.  Rows without an owner are for admins only."""
    return F.lit(True) if is_admin else F.coalesce(owner == user_id, F.lit(False))


def active(status: Column) -> Column:
    return status.isin("queued", "running")


def since_midnight(created: Column, now: Column) -> Column:
    return created >= F.date_trunc("day", now).cast("timestamp_ntz")


def claimable(status: Column, heartbeat: Column, now: Column, lease_seconds: float) -> Column:
    """Queued, or running with a heartbeat older than the lease; no heartbeat is not old."""
    stale = heartbeat < now - F.make_dt_interval(secs=F.lit(lease_seconds))
    return (status == "queued") | ((status == "running") & F.coalesce(stale, F.lit(False)))


def in_suites(suite: Column, wanted: Sequence[str]) -> Column:
    """The named suites, or every suite that is not a replay."""
    return suite.isin(*wanted) if wanted else ~suite.like("%-replay-%")


def of_scenario(scenario: Column, wanted: str) -> Column:
    """``faults`` is everything but the baseline; an empty name is everything."""
    if not wanted:
        return F.lit(True)
    return scenario != "baseline" if wanted == "faults" else scenario == wanted


def in_scope(path: Column, scopes: Sequence[str]) -> Column:
    """The path is a scope or lies under one."""
    tests = [(path == s) | path.startswith(s.rstrip("/") + "/") for s in scopes]
    return reduce(Column.__or__, tests, F.lit(False))


def tier_of(attempt: Column, escalate_after: int = 2) -> Column:
    return F.when(attempt <= escalate_after, "driver").otherwise("escalation")


def model_label(label: Column, model: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), model)


def fault_fires(fault: Column, path: Column, first_path: Column, attempt: Column) -> Column:
    """Whether an injected fault spoils this attempt; only the first planned file is hit."""
    hit = (
        F.when(fault == "bad_patch", attempt == 1)
        .when(fault == "bad_patch_until_escalation", tier_of(attempt) == "driver")
        .otherwise(False)
    )
    return F.coalesce((path == first_path) & hit, F.lit(False))
