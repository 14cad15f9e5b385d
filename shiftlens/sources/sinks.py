"""Where results go: run and metric tables, patches, stored files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_by_suite(rows: DataFrame, folder: str) -> None:
    """Append runs or metrics to a table partitioned by suite.

    Rows are brought together by suite so that files are few, and adaptive execution splits a suite that is large.
    """
    rows.hint("rebalance", "suite").write.mode("append").partitionBy("suite").parquet(folder)


def store_path(root: str, key: str) -> str:
    """The path of a stored file; a key may not leave the root, nor reach a sibling of like name."""
    base = PurePosixPath(root)
    parts: list[str] = []
    for part in PurePosixPath(key).parts:
        if part == "..":
            if not parts:
                raise ValueError(f"key leaves the storage root: {key}")
            parts.pop()
        elif part == "/":
            raise ValueError(f"key leaves the storage root: {key}")
        elif part != ".":
            parts.append(part)
    if not parts:
        raise ValueError(f"key names no file: {key}")
    return str(base.joinpath(*parts))


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """One Markdown table row per metric, for ``metrics_table`` or a text sink."""
    cells = ["corpus_name", "scenario", "metric", F.col("k").cast("string"), fixed(F.col("mean"), 4), fixed(F.col("variance"), 6)]
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return metrics.select("suite", "corpus_name", "scenario", "metric", text.alias("line"))


def write_patches(diffs: DataFrame, folder: str) -> None:
    """Patches as text, one folder per job."""
    diffs.select("job_id", F.col("diff").alias("value")).repartition("job_id").write.mode("overwrite").partitionBy("job_id").text(folder)
