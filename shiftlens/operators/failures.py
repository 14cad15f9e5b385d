"""Who a failure text points at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..session import stored
from .ordered import previous, with_running


def unplanned_residue(files: DataFrame, planned: DataFrame, pattern: str = r"(?m)^\s*(from\s+flask\b|import\s+flask\b)") -> DataFrame:
    """Source files that still import the old framework and are in no plan."""
    return files.filter(F.col("text").rlike(pattern)).join(planned, ["repo", "path"], "left_anti").select("repo", "path")


def one_per_job(candidates: DataFrame, column: str) -> DataFrame:
    """The candidate of each job that has exactly one."""
    found = candidates.groupBy("job_id").agg(F.min(column).alias(column), F.max(column).alias("_other"))
    return found.filter(F.col(column) == F.col("_other")).drop("_other")


def contract_owner(outputs: DataFrame, pins: DataFrame, members: DataFrame, batch: DataFrame) -> DataFrame:
    """The one file of the current batch whose frozen contract a failure text breaks.

    ``pins`` has (job_id, path, symbol, planned), ``members`` (job_id, path, member), ``batch``
    (job_id, path).  A missing module names a planned file, a missing name a pinned symbol of the
    module, a missing attribute a pinned member.  Two candidates mean no answer.
    """
    text = F.col("output")
    said = outputs.select(
        "job_id",
        T.missing_module(text).alias("module"),
        T.missing_name(text).alias("symbol"),
        T.missing_name_module(text).alias("symbol_module"),
        T.missing_attribute(text).alias("member"),
    )
    # one join for modules and names of modules, so that the pins' names are worked out and dealt once
    asked = said.select("job_id", F.explode(F.array_compact(F.array(
        F.when(F.col("module").isNotNull(), F.struct(F.col("module").alias("name"), F.lit(None).cast("string").alias("wanted"))),
        F.when(F.col("symbol").isNotNull(), F.struct(F.col("symbol_module").alias("name"), F.col("symbol").alias("wanted"))),
    ))).alias("a")).select("job_id", "a.*")
    named = pins.select("job_id", "path", "symbol", "planned", F.explode(P.module_names(F.col("path"))).alias("name"))
    by_name = asked.join(named, ["job_id", "name"]).filter(F.when(F.col("wanted").isNull(), F.col("planned")).otherwise(F.col("wanted") == F.col("symbol")))
    by_member = said.filter("member IS NOT NULL").select("job_id", "member").join(members, ["job_id", "member"])
    found = (
        by_name.select("job_id", "path")
        .unionByName(by_member.select("job_id", "path"))
        .distinct()
    )
    return one_per_job(found.join(batch, ["job_id", "path"], "left_semi"), "path")


def contract_target(owners: DataFrame, outputs: DataFrame, members: DataFrame, implemented: DataFrame, consumers: DataFrame, batch: DataFrame) -> DataFrame:
    """The side of a broken contract to repair: the provider, or its only consumer.

    The consumer is meant when the missing member belongs to one pin of the owner, the owner does
    implement it, and one file of the batch consumes the pin.  ``members`` has (job_id, path,
    symbol, member), ``implemented`` the same key for what the source defines, ``consumers``
    (job_id, path, symbol, consumer).
    """
    said = outputs.select("job_id", T.missing_attribute(F.col("output")).alias("member")).filter("member IS NOT NULL")
    pin = (
        owners.join(said, "job_id")
        .join(members, ["job_id", "path", "member"])
        .groupBy("job_id", "path", "member")
        .agg(F.min("symbol").alias("symbol"), F.count("*").alias("n"))
        .filter("n = 1")
    )
    kept = pin.join(implemented, ["job_id", "path", "symbol", "member"], "left_semi")
    inside = consumers.join(batch.withColumnRenamed("path", "consumer"), ["job_id", "consumer"], "left_semi")
    only = one_per_job(kept.join(inside, ["job_id", "path", "symbol"]).select("job_id", "consumer"), "consumer")
    return owners.join(only, "job_id", "left").select("job_id", F.coalesce("consumer", "path").alias("target"))


def traceback_leaf(outputs: DataFrame, eligible: DataFrame) -> DataFrame:
    """The one eligible file every attributable traceback of a job ends in.

    A frame line names a file as ``path:line:``; an exception line closes the traceback, which then
    ends in the last frame before it.  Lines become rows, so a long log is spread over tasks.
    """
    lines = outputs.select("job_id", F.posexplode(T.lines_of(F.col("output"))).alias("line_no", "line"))
    named = lines.select("job_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"([^\s:\"']+):\d+:"), F.lit(1))).alias("token"))
    tails = T.let(F.split(F.translate("token", "\\", "/"), "/"), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/")
    ))
    frames = (
        named.withColumn("path", F.explode(tails))
        .join(eligible, ["job_id", "path"])
        .groupBy("job_id", "line_no")
        .agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("path"))
    )
    ends = lines.filter(F.col("line").rlike("(?U)" + T.EXCEPTION_LINE)).select("job_id", "line_no", F.lit(None).cast("string").alias("path"))
    ends = ends.join(frames, ["job_id", "line_no"], "left_anti")
    # running values read their rows three times
    marks = stored(frames.unionByName(ends))
    placed = with_running(marks, ["job_id"], ["line_no"], {"frame": previous(F.col("path"))})
    return one_per_job(placed.filter("path IS NULL AND frame IS NOT NULL").select("job_id", F.col("frame").alias("path")), "path")


def classified(visits: DataFrame) -> DataFrame:
    """The recovery decision of each visit from its facts; the first rule that applies wins.

    ``visits`` has visit, hard_limit, budget_used (before the visit), max_visits, restoring,
    integration, missing_compat, residue, contract_owner, leaf_owner, crashed, mentioned, repeat,
    owner_repairs and max_repairs.
    """
    col = F.col
    over = col("visit") > col("hard_limit")
    early = col("restoring") | (~col("integration") & (col("missing_compat") | col("residue")))
    owned = ~col("integration") & (col("contract_owner").isNotNull() | col("leaf_owner").isNotNull())
    kind = (
        F.when(owned & col("contract_owner").isNotNull(), "contract_failure")
        .when(owned, "traceback_leaf")
        .when(col("integration"), "integration_regression")
        .when(col("crashed") & col("mentioned"), "crash_batch")
        .otherwise("behavioral")
    )
    stalled = ~col("integration") & (col("repeat") >= 3)
    diagnosing = ~col("integration") & (col("repeat") == 2)
    allowance = owned & (col("owner_repairs") < col("max_repairs")) & ~stalled
    charged = early | ~(allowance & (col("repeat") == 1))
    used = col("budget_used") + charged.cast("int")
    spent = used > col("max_visits")
    classification = (
        F.when(over, "hard_safety_cap")
        .when(spent, "budget_exhausted")
        .when(col("restoring"), "restored_cut_reverify_failed")
        .when(~col("integration") & col("missing_compat"), "missing_test_compat")
        .when(~col("integration") & col("residue"), "unplanned_residue")
        .when(diagnosing, F.concat(kind, F.lit("_no_progress_diagnostic")))
        .when(stalled, "no_progress")
        .otherwise(kind)
    )
    route = (
        F.when(over | spent | col("restoring"), "integrate")
        .when(early, "plan")
        .when(stalled, "integrate")
        .otherwise("execute")
    )
    return visits.select(
        *visits.columns,
        classification.alias("classification"),
        route.alias("route"),
        F.when(over, False).otherwise(charged).alias("budget_charged"),
    )
