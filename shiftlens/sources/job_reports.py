"""Job reports: one JSON document per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scrub

SCHEMA = (
    "job_id string, migration_outcome string, tasks_total int, tasks_done int, "
    "tasks array<struct<id:string,type:string,status:string,target_path:string,error:string>>, "
    "recovery struct<visits:int,budget_used:int,tasks_skipped:int,escalation_attempted:int,escalation_rescued:int,"
    "no_progress_retries:int,last_classification:string>, "
    "oracle_integrity struct<protected_files:int,clean_files:int,integrity_rate:double>, "
    "llm_usage struct<calls:int,prompt_tokens:bigint,completion_tokens:bigint,cost_usd:double>, diff string"
)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of a folder; a job without one is simply absent, and joins give it NULLs."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(folder)


def flat(reports: DataFrame) -> DataFrame:
    """The numbers a run record takes, missing ones as 0."""

    def number(source: str, name: str, kind: str = "int") -> Column:
        return F.coalesce(F.col(source).cast(kind), F.lit(0).cast(kind)).alias(name)

    return reports.select(
        "job_id",
        number("tasks_total", "tasks_total"),
        number("tasks_done", "tasks_done"),
        number("recovery.tasks_skipped", "tasks_skipped"),
        number("recovery.visits", "recover_visits"),
        number("recovery.budget_used", "recover_budget_used"),
        number("recovery.escalation_attempted", "escalation_attempted"),
        number("recovery.escalation_rescued", "escalation_rescued"),
        number("recovery.no_progress_retries", "no_progress_retries"),
        number("llm_usage.calls", "llm_calls"),
        number("llm_usage.cost_usd", "cost_usd", "double"),
        number("oracle_integrity.integrity_rate", "oracle_integrity_rate", "double"),
        F.coalesce("migration_outcome", F.lit("failed")).alias("migration_outcome"),
    )


def written(reports: DataFrame) -> DataFrame:
    """Reports as JSON texts, the diff scrubbed on the way out."""
    fields = [scrub(F.col(c)).alias(c) if c == "diff" else F.col(c) for c in reports.columns if c != "job_id"]
    return reports.select("job_id", F.to_json(F.struct("job_id", *fields)).alias("report"))


def parsed(texts: DataFrame) -> DataFrame:
    return texts.select(F.from_json("report", SCHEMA).alias("r")).select("r.*")
