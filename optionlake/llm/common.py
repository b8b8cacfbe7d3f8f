"""Small helpers of the text operators: tables, intermediate results, words."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word rules of the operators. Bytes of UTF-8 above 0x7F always belong to a word.
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ALNUM = bytes(range(0x30, 0x3A)) + _LOWER + bytes(range(0x80, 0x100))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_ALNUM_TABLE = bytes((b if b in _ALNUM else 0x20) for b in _FOLD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split(None)


def alnum_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and anything beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_ALNUM_TABLE).split()


def text_digest(text: Column) -> Column:
    """What tells rows of one doc_id apart: equal for equal texts, null like empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def per_worker(name, make):
    """What ``make`` gives, made once per Python worker and kept from task to task.

    Functions travel to the workers by value, and their module's variables start
    anew with each task; the interpreter's own module does not.
    """
    kept = sys.__dict__.setdefault("_optionlake_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def work_folder(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame that several steps read, and read it back.

    The table lies in the shared folder, so a lost executor costs nothing, and
    the plan after it starts at a scan.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Partitions for an exchange whose rows are few and heavy; AQE would join them into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
