"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "shiftlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # source files travel through Python in batches; keep a batch well under a task's memory
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def beside(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the settings of ``spark`` and these; ``spark`` keeps its own."""
    other = spark.newSession()
    for key, value in (spark.conf.getAll | settings).items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


#: Bytes of a side that may be broadcast once it is measured.  As a hash table a side takes about three times its bytes, and a
#: query has up to forty of them in the driver at once.
MOST_BROADCAST = 1 << 20


def _bytes(spark: SparkSession, size: str) -> int:
    return -1 if size.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def sized_when_run(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` in which a join broadcasts a side by the size it turned out to have.

    Before a query runs, Spark only knows the size of the files.  Where narrow rows grow into texts, syntax nodes or
    several rows each, that is a small part of what a broadcast would bring to the driver.  Here no side is broadcast
    before it was shuffled and measured; the caller's limit then holds for the measured size, and ``MOST_BROADCAST`` if that
    is less, so that many joins together do not fill the driver.
    """
    limit = "spark.sql.autoBroadcastJoinThreshold"
    measured = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get(limit)
    return beside(spark, {
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(min(_bytes(spark, measured), MOST_BROADCAST)), limit: "-1",
        # the facts of a file are written each to its folder; rows need not be sorted for that
        "spark.sql.maxConcurrentOutputFileWriters": "16",
    })


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    A cluster names its shared folder in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a folder of this machine; elsewhere an executor loss would take the data along.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="shiftlens-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, with a folder for each value of ``by``, read again.

    Unlike a checkpoint it does not carry the estimates of the plan that made it; in loops those multiply with every join
    until planning takes longer than the work.
    """
    spark = df.sparkSession
    path = f"{use_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs in here deletes its shuffle files when it ends; else they stay until the driver collects its garbage.

    For loops that store every round: their rounds read no shuffle of an earlier one.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if path is not None and path.getName().startswith("stored-"):
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
