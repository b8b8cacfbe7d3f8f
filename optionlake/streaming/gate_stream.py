"""The freshness gate over a stream of captures.

Every micro-batch is judged by the batch operators, which cut a ticker's rows
into ranges over the tasks: no ticker passes through one of them whole. What
crosses micro-batches is one row per ticker, the print and sequence number last
accepted. It is stored with the query's checkpoint, in turn in two places: a
batch that is repeated starts from what the batch before it left, and replaces
its own verdicts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.symbols import STAMP
from ..operators import gate
from ..plans import collect
from ..sources import archive

STATE = "ticker string, print string, seqno bigint"
#: Judges a micro-batch: (rows, what was accepted before or None, how intermediate rows are kept).
Judge = Callable[[DataFrame, DataFrame | None, Callable[[DataFrame], DataFrame]], DataFrame]


def landed(spark: SparkSession, landing_dir: str, max_files: int = 1000) -> DataFrame:
    """Stream of bodies landed as ``ticker=<ticker>/<stamp>.json[.gz]``.

    The ticker's underscore sits in a partition folder, where file sources do
    not take it for a hidden file.
    """
    lines = (
        spark.readStream.schema("value string, ticker string")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", max_files)
        .text(landing_dir)
    )
    stamp = F.regexp_extract("_metadata.file_name", r"^(.*?)\.json(\.gz)?$", 1)
    return lines.select(
        "ticker", F.try_to_timestamp(stamp, F.lit(STAMP)).alias("capture_utc"), F.col("value").alias("body")
    ).where("capture_utc is not null")


def archived(spark: SparkSession, raw_dir: str, lag_seconds: float = 0.0) -> DataFrame:
    """Stream of the bodies of an archive, under the archive's own names. An unreadable file is a body that fails to parse."""
    return archive.with_bodies(archive.arrivals(spark, raw_dir, lag_seconds)).select(
        "ticker", "capture_utc", F.coalesce("body", F.lit("")).alias("body")
    )


def _kept_in(folder: str) -> Callable[[DataFrame], DataFrame]:
    """Stores intermediate rows as Parquet; the next micro-batch writes over them."""
    places = (f"{folder}/{n}" for n in range(1 << 30))

    def keep(df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(place := next(places))
        return df.sparkSession.read.schema(df.schema).parquet(place)

    return keep


def _accepted_by(judged: DataFrame, seed: DataFrame | None, order: list[str]) -> DataFrame:
    """What was last accepted of every ticker, after a micro-batch."""
    last = F.max_by(F.struct("print", F.col("seqno").cast("bigint").alias("seqno")), F.struct(*order))
    now = gate.accepted(judged).where("print is not null").groupBy("ticker").agg(last.alias("_s")).select("ticker", "_s.*")
    return now if seed is None else now.unionByName(seed.join(now, "ticker", "left_anti"))


def to_table(rows: DataFrame, judge: Judge, order: list[str], out_dir: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Write the judged rows of every micro-batch to a Parquet table partitioned by ``batch``."""

    def run(batch: DataFrame, number: int) -> None:
        spark, folder, out = batch.sparkSession, f"{checkpoint_dir}/gate", f"{out_dir}/batch={number}"
        seed = spark.read.schema(STATE).parquet(f"{folder}/accepted-{(number - 1) % 2}") if number else None
        judge(batch, seed, _kept_in(f"{folder}/rows")).write.mode("overwrite").parquet(out)
        state = _accepted_by(spark.read.parquet(out), seed, order)
        state.coalesce(1).write.mode("overwrite").parquet(f"{folder}/accepted-{number % 2}")  # a row per ticker

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def verdicts(
    attempts: DataFrame, out_dir: str, checkpoint_dir: str, max_stale: timedelta = gate.MAX_STALE,
    order: list[str] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """``gate.judge`` for a stream of attempts with a ``seqno``."""
    order = order or ["capture_utc"]

    def judge(batch, seed, keep):
        return gate.judge(batch, seed, max_stale, order, keep=keep)

    return to_table(attempts, judge, order, out_dir, checkpoint_dir, available_now)


def start(
    bodies: DataFrame, out_dir: str, checkpoint_dir: str, max_stale: timedelta = gate.MAX_STALE,
    available_now: bool = True, force: bool = False,
) -> StreamingQuery:
    """``collect.screen`` for a stream of (ticker, capture_utc, body)."""

    def judge(batch, seed, keep):
        return collect.screen(batch, seed, max_stale, force, keep)

    return to_table(bodies, judge, ["capture_utc"], out_dir, checkpoint_dir, available_now)
