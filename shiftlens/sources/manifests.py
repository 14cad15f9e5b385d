"""Versioned checkpoints: a table per version, a manifest that describes it, and one pointer to the version that counts.

A version is written beside the others.  Only when all of it is there does the pointer move to it, by a rename, which the
file system does whole or not at all.  So a writer that dies leaves what was there before, and a reader never sees half a
version.  Whatever cannot be read as what it should be counts as not there.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST, POINTER = "manifest.json", "CURRENT"
_VERSION = re.compile(r"v-[0-9]{8}-[0-9a-f]{32}")


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, folder: str):
    return _path(spark, folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file, written beside and renamed over what is there."""
    jvm = spark.sparkContext._jvm
    beside = _path(spark, folder, f".{name}-{uuid.uuid4().hex}")
    out = _files(spark, folder).create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else _files(spark, folder).getUri())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, _path(spark, folder, name), options)


def _get(spark: SparkSession, folder: str, name: str) -> str | None:
    path = _path(spark, folder, name)
    if not _files(spark, folder).exists(path):
        return None
    lines = spark.read.text(path.toString(), wholetext=True).head(1)
    return lines[0][0] if lines else ""


def save_version(rows: DataFrame, folder: str, number: int) -> str:
    """Write ``rows`` as version ``number`` and let it count; gives the version's name.

    A version that was saved under the same number stays, under its own name, but no longer counts.
    """
    spark = rows.sparkSession
    name = f"v-{number:08d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}/rows")
    count = spark.read.schema(rows.schema).parquet(f"{folder}/{name}/rows").count()
    _put(spark, f"{folder}/{name}", MANIFEST, json.dumps({"version": name, "number": number, "rows": count, "schema": rows.schema.simpleString()}))
    _put(spark, folder, POINTER, name)
    return name


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of the version that counts; None where the pointer or the manifest is missing or malformed."""
    name = (_get(spark, folder, POINTER) or "").strip()
    if not _VERSION.fullmatch(name):
        return None
    try:
        found = json.loads(_get(spark, f"{folder}/{name}", MANIFEST) or "")
    except ValueError:
        return None
    good = isinstance(found, dict) and found.get("version") == name and isinstance(found.get("number"), int) and isinstance(found.get("rows"), int)
    return found if good else None


def load_version(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """The rows of the version that counts, as ``schema``; no rows where there is none, or what there is does not fit its manifest."""
    found = manifest(spark, folder)
    nothing = spark.createDataFrame([], schema)
    if found is None or found.get("schema") != nothing.schema.simpleString():
        return nothing
    path = f"{folder}/{found['version']}/rows"
    if not _files(spark, folder).exists(_path(spark, path)):
        return nothing
    rows = spark.read.schema(schema).parquet(path)
    return rows if rows.count() == found["rows"] else nothing


def discard_versions(spark: SparkSession, folder: str) -> None:
    """Let no version count any more; the rows stay for whoever is reading them."""
    _put(spark, folder, POINTER, "")
