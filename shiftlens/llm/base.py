"""What the operators share: reading tables, tables written half-way, Arrow batches, words."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import use_checkpoint_dir

#: Bytes of rows that a Python worker gets at once; next to the heap of an executor there is little room.
BATCH_BYTES = 8 << 20
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
#: What separates words wherever a contract says ``[^\x20\x09-\x0D]+``.
BLANKS = r"[\x20\x09-\x0D]+"
#: A key with one row in so many counts as hot: its rows meet what belongs to them by broadcast, at most so many keys.
HOT = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again.

    It survives lost executors, and what reads it more than once computes nothing twice.  A ``narrow`` table, of a few
    numbers a row, has an eighth of the shuffle partitions as files, so that rounds over it move few small blocks.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{use_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_by_key(rows: DataFrame, found: DataFrame, key: str, share: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row per key of ``found``, where a key may have any share of the rows.

    ``share`` is the column of ``found`` with the rows of a key, of ``total``.  Keys with a row in 4096 or more, so at most
    4096 keys, are broadcast; the rest is an ordinary join.
    """
    hot = F.col(share) * HOT >= total
    heavy, light = found.filter(hot), found.filter(~hot)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words between blanks; NULL gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def with_read(df: DataFrame, columns: list[str], name: str, kind: str, make: Callable[[], Callable[..., pa.Array]]) -> DataFrame:
    """``df`` with a further column, which a function of whole ``columns`` makes batch by batch.

    ``make`` runs once in each task.  All other columns pass through, so nothing has to be joined back.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        for batch in batches:
            added = read(*(batch.column(i).to_pylist() for i in places))
            yield pa.RecordBatch.from_arrays([*batch.columns, added], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def crc32_fold(doc_id: Column, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``parts``; a NULL id is in fold NULL."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def process_state() -> dict:
    """A dictionary that lives as long as the Python process, for what is dear to set up.

    Functions travel to the workers by value, so their own globals do not outlive a task.
    """
    return sys.modules.setdefault("_shiftlens_process", types.ModuleType("_shiftlens_process")).__dict__.setdefault("kept", {})
