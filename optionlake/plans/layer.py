"""Queries that write: archives, curated tables and streams, read back and reported.

Each works in a folder of its own that every executor shares.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import health, subset
from ..session import work_folder
from ..sources import archive, curated, payloads
from ..streaming import gate_stream
from . import tape
from .registry import count, query, rnd, when_text


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def archived(spark: SparkSession, sf: str, compressed: bool = True) -> str:
    """An archive of the tape's bodies, written by the sink; returns its folder."""
    folder = fresh_folder(spark, "raw")
    archive.write(tape.bodies(spark, sf), folder, compressed)
    return folder


@query
def archive_bodies(spark, sf):
    """Bodies written by the archive sink, listed by their names, read in order of capture and validated."""
    found = archive.scan(spark, archived(spark, sf))
    read = payloads.snapshots(archive.with_bodies(found, in_order=True))
    return read.select("stem", when_text(), "ticker", F.coalesce("read_error", "error").alias("error"), count("n_options", "n_options"))


@query
def archive_names(spark, sf):
    """Listing of a written archive."""
    return archive.scan(spark, archived(spark, sf)).select("ticker", when_text(), "compressed", "stem", "name", (F.col("size") > 0).alias("filled"))


@query
def manifest_on_disk(spark, sf):
    """A checksum manifest written over an archive; then some captures change or go, others come."""
    raw, manifest = archived(spark, sf), fresh_folder(spark, "manifest")
    archive.write_manifest(spark, raw, manifest)
    gone = archive.digests(archive.scan(spark, raw)).withColumn("second", F.unix_timestamp("capture_utc"))
    seen = gone.where("second % 11 <> 0").select(
        F.when(F.col("second") % 13 == 0, F.concat(F.lit("new_"), F.col("name"))).otherwise(F.col("name")).alias("name"),
        F.when(F.col("second") % 17 == 0, F.reverse("digest")).otherwise(F.col("digest")).alias("digest"),
    )
    return archive.reconcile.verify(archive.read_manifest(spark, manifest), seen)


@query
def gzip_archive(spark, sf):
    """Plain captures compressed one by one, each proven before its original goes, and the bodies read after that."""
    raw = archived(spark, sf, compressed=False)
    listed = archive.scan(spark, raw)
    before = {r.compressed: r.n for r in listed.groupBy("compressed").agg(F.count(F.lit(1)).alias("n")).collect()}
    done = archive.compress_archive(listed)
    done.write.mode("overwrite").parquet(report := fresh_folder(spark, "gzip"))
    after = payloads.snapshots(archive.with_bodies(archive.scan(spark, raw)))
    report = spark.read.parquet(report).select("stem", "skipped", (F.col("after") < F.col("before")).alias("smaller"))
    return report.join(after.select("stem", count("n_options", "n_options")), "stem").withColumn("plain_before", F.lit(before.get(False, 0)))


def _curated(spark: SparkSession, sf: str) -> tuple[str, str]:
    raw, out = archived(spark, sf), fresh_folder(spark, "curated")
    curated.backfill(spark, raw, out)
    return raw, out


@query
def curated_captures(spark, sf):
    """An archive converted twice, so that every day is replaced once, and its captures read from their own rows."""
    raw, out = _curated(spark, sf)
    curated.backfill(spark, raw, out)
    known = curated.known_captures(curated.table(spark, out))
    return known.select(
        when_text(), "feed_timestamp", when_text("index_last_trade", "index_last_trade"), "seqno", "underlying_ticker", "underlying_price",
        *[count(c, c) for c in ("n_options", "n_expiries", "n_roots")],
    )


@query
def curated_quotes(spark, sf):
    """Quotes read back from a curated table, totals by smile."""
    _, out = _curated(spark, sf)
    rows = curated.table(spark, out).where(F.col("kind") == curated.QUOTE)
    return rows.groupBy("capture_utc", "expiry", "root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("strike").alias("strikes"), F.count("bid").alias("bids"), rnd(F.sum("ask"), 4, "asks"),
        F.count_if(F.col("tick") == "up").alias("ups"),
    ).select(when_text(), "expiry", "root", "n", "strikes", "bids", "asks", "ups")


@query
def backfill_resumed(spark, sf):
    """Outcome of every capture when a finished conversion is resumed: what failed is tried again."""
    raw, out = _curated(spark, sf)
    done = curated.backfill(spark, raw, out, overwrite=False)
    return done.outcomes.select("stem", "status", count("rows", "rows"), count("unparsed", "unparsed"), "error")


@query
def curated_divergence(spark, sf):
    """What an archive holds that its curated table does not."""
    raw, out = _curated(spark, sf)
    return curated.divergence(spark, raw, out)


@query
def stream_verdicts(spark, sf):
    """The gate over the event log as a stream; what was last accepted of a ticker is kept between micro-batches."""
    attempts = tape.attempts(spark, sf)
    attempts.write.parquet(landing := fresh_folder(spark, "landing"))
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1 << 20).parquet(landing)
    out = fresh_folder(spark, "verdicts")
    gate_stream.verdicts(stream, out, fresh_folder(spark, "state"), order=["capture_utc", "event_id"]).awaitTermination()
    return spark.read.parquet(out).select("event_id", "ticker", "print", "last_print", rnd("age_minutes", 4), "verdict")


@query
def stream_bodies(spark, sf):
    """An archive streamed under its own names and screened."""
    raw, out = archived(spark, sf), fresh_folder(spark, "screened")
    gate_stream.start(gate_stream.archived(spark, raw), out, fresh_folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select(when_text(), "verdict", rnd("age_minutes", 4), count("n_options", "n_options"), "error", "detail")


NOW = "2030-01-01 00:00:00"


@query
def health_ages(spark, sf):
    """How long ago each clock of the health record moved, and which of them are late."""
    now = F.lit(NOW).cast("timestamp")
    record = health.with_ages(health.fold(tape.outcomes(spark, sf), ["ticker"], ["at", "event_id"]), now)
    seconds = [F.expr(f"extract(day from {c}_age) * 86400 + extract(hour from {c}_age) * 3600 + extract(minute from {c}_age) * 60").cast("bigint").alias(f"{c}_age") for c in health.CLOCKS]
    late = health.stale(record, now, "1 day", "write").select("ticker", F.lit(True).alias("late"))
    return record.select("ticker", *seconds).join(late, "ticker", "left").withColumn("late", F.coalesce("late", F.lit(False)))


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    same = Window.partitionBy("capture_utc", "expiry", "option_right", "strike")  # a contract: one row per root
    traded = F.when(F.col("h") % 17 == 0, F.format_string("2025-%02d-15T10:00:00", F.col("h") % 12 + 1)).when(F.col("h") % 5 != 0, "2026-08-10T15:59:00")
    return tape.quotes(spark, sf).withColumns(
        {"spot": F.col("underlying_price"), "expires_today": F.col("week") == 0, "last_trade_time": traded, "both_roots": F.min("root").over(same) != F.max("root").over(same)}
    )


def _subset(spark: SparkSession, sf: str) -> DataFrame:
    reasons = subset.troubles(F.col("both_roots") & (F.col("week") == 1), F.col("week") == 5, deep=0.92)
    return subset.by_reason(_chain(spark, sf), ["capture_utc"], "option_symbol", reasons)


@query
def subset_by_reason(spark, sf):
    """Contracts of every capture that show one trouble each, the first reason that takes them."""
    return _subset(spark, sf).select(when_text(), "option_symbol", count("reason_no", "reason_no"), "reason")


@query
def subset_tally(spark, sf):
    return subset.tally(_subset(spark, sf), ["capture_utc"]).select(when_text(), "reason", "n")
