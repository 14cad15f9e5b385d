"""Files of checked-out repositories as rows (repo, path, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators.ordered import ordinal, running_sum, with_running

TRUNCATED = "… (truncated)"


def read_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """All files below ``root`` that decode as UTF-8, with paths relative to it."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "content")
    )
    base = root.rstrip("/") + "/"
    clean = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _quoted(base), "")
    return found.select(clean.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).filter(
        F.col("text").isNotNull()
    )


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def python_files(files: DataFrame, skipped: Sequence[str] = P.SKIPPED_FOLDERS) -> DataFrame:
    return files.filter(F.col("path").endswith(".py") & ~P.has_part(F.col("path"), skipped))


def other_files(files: DataFrame, skipped: Sequence[str] = P.SKIPPED_FOLDERS) -> DataFrame:
    """Files other than Python source that may be shown."""
    path = F.col("path")
    return files.filter((P.suffix(path) != ".py") & ~P.has_part(path, skipped) & ~P.is_denied(path))


def listing(files: DataFrame, limit: int = 80, skipped: Sequence[str] = P.SKIPPED_FOLDERS) -> DataFrame:
    """The first paths of every repository in path order (by folder, then name), with a note after a full list.

    The rank filter becomes a limit before the shuffle.
    """
    window = Window.partitionBy("repo").orderBy(F.split("path", "/"))
    placed = other_files(files, skipped).select("repo", "path", F.row_number().over(window).alias("place"))
    kept = placed.filter(F.col("place") <= limit)
    full = kept.filter(F.col("place") == limit)
    return kept.unionByName(full.select("repo", F.lit(TRUNCATED).alias("path"), (F.col("place") + 1).alias("place")))


def budgeted_text(
    files: DataFrame,
    content_limit: int = 24000,
    path_limit: int = 500,
    suffixes: Sequence[str] = P.SEMANTIC_SUFFIXES,
    skipped: Sequence[str] = P.SKIPPED_FOLDERS,
) -> DataFrame:
    """Paths with as much scrubbed text as the repository's budget leaves, spent in path order."""
    wanted = F.lower(P.suffix(F.col("path"))).isin(*suffixes)
    shown = other_files(files, skipped).select(
        "repo", "path", F.when(wanted, T.scrub(F.col("text"))).otherwise("").alias("body")
    )
    return _spend(shown, content_limit, None).filter(F.col("place") <= path_limit).drop("place")


def _spend(rows: DataFrame, total: int, each: int | None) -> DataFrame:
    """Cut ``body`` so that a repository's texts stay within ``total``, in path order.

    The order is computed on the lengths alone; only the files within the budget, a few per
    repository, bring their text.
    """
    size = F.length("body") if each is None else F.least(F.length("body"), F.lit(each))
    sized = rows.select("repo", "path", F.split("path", "/").alias("parts"), size.cast("long").alias("size"))
    placed = with_running(
        sized, ["repo"], ["parts"], {"spent": running_sum(F.col("size"), inclusive=False), "place": ordinal()}
    )
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(total) - F.col("spent"))).cast("int")
    placed = placed.select("repo", "path", "place", left.alias("left"))
    within = placed.filter(F.col("left") > 0).join(rows, ["repo", "path"])
    texts = within.select("repo", "path", F.substring(F.col("body"), F.lit(1), F.col("left")).alias("body"), "place")
    return texts.unionByName(placed.filter(F.col("left") == 0).select("repo", "path", F.lit("").alias("body"), "place"))


def architecture_text(files: DataFrame, total: int = 60000, each: int = 12000) -> DataFrame:
    """Planned sources in order within a total and a per-file budget."""
    rows = files.select("repo", "path", T.scrub(F.col("text")).alias("body"))
    return _spend(rows, total, each).filter(F.length("body") > 0).drop("place")


def context_text(budgeted: DataFrame) -> DataFrame:
    """One text per repository from the budgeted bodies, which bound its size."""
    part = F.format_string("--- %s ---\n%s", F.col("path"), F.col("body"))
    gathered = (
        budgeted.filter(F.col("body") != "")
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct(F.split("path", "/"), part.alias("part")))).alias("parts"))
    )
    return gathered.select("repo", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("context"))


def read_file(files: DataFrame, wanted: DataFrame, limit: int = 8000) -> DataFrame:
    """The wanted paths with their text, cut at the limit; NULL when missing."""
    return wanted.join(files, ["repo", "path"], "left").select("repo", "path", T.truncated(F.col("text"), limit).alias("text"))


def written(files: DataFrame) -> DataFrame:
    """Files with the hash a writer returns."""
    return files.withColumn("content_hash", T.content_hash(F.col("text")))


def visible_context(files: DataFrame, task: Column, waiting: DataFrame) -> DataFrame:
    """Files a task may read: not itself, not waiting to be migrated, not denied; secrets scrubbed."""
    seen = files.filter((F.col("path") != task) & ~P.is_denied(F.col("path")))
    return seen.join(waiting.select("repo", "path"), ["repo", "path"], "left_anti").withColumn("text", T.scrub(F.col("text")))
