"""The curated layer: one partitioned table holding quotes and their bookkeeping.

One pass over the raw bodies writes three kinds of rows into one commit: the
quotes, the options whose symbol did not parse, and one row per capture (with
the error of a capture that could not be converted). Quotes and bookkeeping can
therefore never disagree, and an empty chain still leaves its mark.

A day of captures is the unit of replacement: rebuilding it overwrites exactly
its partition, so a rerun repairs instead of duplicating.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import symbols
from ..operators import reconcile
from ..schema import QUOTE_COLUMNS, QUOTE_FIELDS, QUOTES
from . import archive, payloads

QUOTE, UNPARSED, CAPTURE = "quote", "unparsed", "capture"
TOTALS = ("n_options", "expiries", "roots")
DAY = "capture_date"
TABLE = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("ticker", T.StringType()),
     T.StructField("stem", T.StringType()), T.StructField("error", T.StringType()),
     T.StructField("run", T.StringType())]
    + [T.StructField(f.name, f.dataType) for f in QUOTES]
    # Of a capture's own row: how many quotes it has, and on what.
    + [T.StructField("n_options", T.LongType()), T.StructField("expiries", T.ArrayType(T.DateType())), T.StructField("roots", T.ArrayType(T.StringType()))]
    + [T.StructField(DAY, T.DateType())]
)


def table_rows(bodies: DataFrame, run: str) -> DataFrame:
    """Rows of the table for (ticker, capture_utc, stem, body, read_error)."""
    snaps = payloads.snapshots(bodies).withColumn("error", F.coalesce("read_error", "error"))
    good = F.col("error").isNull()
    listed = F.when(good, F.transform("options", lambda o: F.struct(o.alias("o"), symbols.contract(payloads._text(o["option"])).alias("contract"))))
    snaps = snaps.withColumn("_listed", listed)
    parsed = F.filter("_listed", lambda e: e["contract"].isNotNull())
    each_type = snaps.schema["_listed"].dataType.elementType
    totals = [
        F.size(parsed).cast("bigint").alias("n_options"),
        F.array_distinct(F.transform(parsed, lambda e: e["contract"]["expiry"])).alias("expiries"),
        F.array_distinct(F.transform(parsed, lambda e: e["contract"]["root"])).alias("roots"),
    ]
    own = F.array(F.struct(F.lit(True).alias("own"), F.lit(None).cast(each_type).alias("e"), *[F.when(good, t).alias(n) for t, n in zip(totals, TOTALS, strict=True)]))
    nothing = [F.lit(None).cast(TABLE[n].dataType).alias(n) for n in TOTALS]
    each = F.transform("_listed", lambda e: F.struct(F.lit(False).alias("own"), e.alias("e"), *nothing))
    exploded = snaps.select(
        "ticker", "stem", "error", "capture_utc", "feed_timestamp", "index_last_trade", "seqno",
        F.col("ticker").alias("underlying_ticker"), F.col("spot").alias("underlying_price"),
        F.explode_outer(F.when(good, F.concat(own, each)).otherwise(own)).alias("_e"),
    )
    parsed = exploded.select("*", F.col("_e.own").alias("own"), F.col("_e.e.o").alias("_o"), F.col("_e.e.contract").alias("contract"), *[F.col(f"_e.{n}").alias(n) for n in TOTALS])
    kind = F.when(F.col("own"), CAPTURE).when(F.col("contract").isNull(), UNPARSED).otherwise(QUOTE)
    values = {
        name: payloads._text(F.col(f"_o.{name}")) if isinstance(t, T.StringType) else F.col(f"_o.{name}")
        for name, t in QUOTE_FIELDS
    }
    return (
        parsed.withColumn("kind", kind)
        .select("kind", "ticker", "stem", "error", F.lit(run).alias("run"), *QUOTE_COLUMNS[:6], "contract.*",
                *[v.alias(n) for n, v in values.items()], *TOTALS, F.to_date("capture_utc").alias(DAY))
        .select(*TABLE.fieldNames())
    )


def write(rows: DataFrame, curated_dir: str, append: bool) -> None:
    """Commit rows by day. Rebalancing splits a busy day and joins quiet ones."""
    (
        rows.hint("rebalance", DAY)
        .sortWithinPartitions(DAY, "kind", "capture_utc", "root", "expiry", "strike")
        .write.mode("append" if append else "overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(DAY)
        .parquet(str(curated_dir))
    )


def table(spark: SparkSession, curated_dir: str) -> DataFrame:
    """The table, with its declared schema; raises if nothing was ever curated."""
    try:
        found = spark.read.schema(TABLE).parquet(str(curated_dir))
        empty = found.select("kind").isEmpty()
    except AnalysisException:
        empty = True
    if empty:
        raise FileNotFoundError(f"no curated Parquet in {curated_dir}: run backfill first")
    return found


def index(spark: SparkSession, curated_dir: str) -> DataFrame:
    """One row per converted capture; an empty frame before the first backfill."""
    try:
        found = table(spark, curated_dir)
    except FileNotFoundError:
        return spark.createDataFrame([], "ticker string, stem string, capture_utc timestamp, error string")
    return found.where(F.col("kind") == CAPTURE).select("ticker", "stem", "capture_utc", "error")


def converted(spark: SparkSession, curated_dir: str) -> DataFrame:
    return index(spark, curated_dir).where("error is null")


def divergence(spark: SparkSession, raw_dir: str, curated_dir: str) -> DataFrame:
    return reconcile.divergence(archive.scan(spark, raw_dir), converted(spark, curated_dir))


@dataclass(frozen=True)
class Backfill:
    """What a backfill did, read back from the table it wrote."""

    outcomes: DataFrame
    """(stem, status, rows, unparsed, error) per capture: written, skipped or failed."""

    total_bytes: int

    def totals(self):
        return self.sums().first()

    def sums(self) -> DataFrame:
        def of(status: str):
            return F.count_if(F.col("status") == status).alias(status)

        return self.outcomes.agg(
            of("written"), of("skipped"), of("failed"),
            F.coalesce(F.sum(F.when(F.col("status") == "written", F.col("rows"))), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("status") == "written", F.col("unparsed"))), F.lit(0)).alias("unparsed"),
        )


def backfill(
    spark: SparkSession, raw_dir: str, curated_dir: str, overwrite: bool = True, stems: list[str] | None = None
) -> Backfill:
    """Convert the archive, every capture on its own: one bad body fails alone.

    With ``overwrite`` the days of the chosen captures are rebuilt whole.
    Without it only captures not yet converted are added. Rows carry the run
    that wrote them, so the report is a query over the table itself.
    """
    run = uuid.uuid4().hex
    captures = archive.scan(spark, raw_dir)
    asked = captures if stems is None else captures.where(F.col("stem").isin(stems))
    if overwrite:
        days = asked.select(F.to_date("capture_utc").alias(DAY)).distinct()
        dated = captures.withColumn(DAY, F.to_date("capture_utc"))
        chosen = captures if stems is None else dated.join(days, DAY, "left_semi")
    else:
        chosen = asked.join(converted(spark, curated_dir), "stem", "left_anti")
    write(table_rows(archive.with_bodies(chosen), run), curated_dir, append=not overwrite)

    try:
        whole = table(spark, curated_dir)
    except FileNotFoundError:
        whole = spark.createDataFrame([], TABLE)
    # Only the days asked for: the report of one capture does not read the table.
    whole = whole.join(asked.select(F.to_date("capture_utc").alias(DAY)).distinct(), DAY, "left_semi")
    marker, mine = F.col("kind") == CAPTURE, F.col("run") == run
    good = marker & F.col("error").isNull()
    counts = whole.groupBy("stem").agg(
        F.count_if(F.col("kind") == QUOTE).alias("rows"),
        F.count_if(F.col("kind") == UNPARSED).alias("unparsed"),
        (F.count_if(good & mine) > 0).alias("_now"),
        (F.count_if(good & ~mine) > 0).alias("_before"),
        F.max(F.when(marker & mine, F.col("error"))).alias("error"),
    )
    status = F.when(F.col("_now"), "written").when(F.col("_before"), "skipped").otherwise("failed")
    outcomes = asked.select("stem").join(counts, "stem", "left").select(
        "stem", status.alias("status"), "rows", "unparsed", "error"
    )
    return Backfill(outcomes, _bytes(spark, curated_dir))


def _bytes(spark: SparkSession, curated_dir: str) -> int:
    """Size of the table's files, from their listing."""
    files = archive.listing(spark, curated_dir).where(F.col("name").endswith(".parquet"))
    return files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


# --- SQL ---------------------------------------------------------------------


def captures_view(quotes: DataFrame) -> DataFrame:
    """One row per capture. Smiles are counted first, so the distinct counts run
    over one row per (expiry, root) and not over the quotes."""
    smiles = quotes.groupBy("capture_utc", "expiry", "root").agg(
        *[F.any_value(c).alias(c) for c in ("feed_timestamp", "index_last_trade", "seqno", "underlying_ticker", "underlying_price")],
        F.count(F.lit(1)).alias("n"),
    )
    return smiles.groupBy("capture_utc").agg(
        *[F.any_value(c).alias(c) for c in ("feed_timestamp", "index_last_trade", "seqno", "underlying_ticker", "underlying_price")],
        F.sum("n").alias("n_options"),
        F.count_distinct("expiry").alias("n_expiries"),
        F.count_distinct("root").alias("n_roots"),
    )


def known_captures(rows: DataFrame) -> DataFrame:
    """``captures_view`` of the table, from the captures' own rows: quotes are not read.

    Those rows are committed with the day they belong to, so a rebuilt day
    brings its captures along.
    """
    mine = rows.where((F.col("kind") == CAPTURE) & F.col("error").isNull() & (F.col("n_options") > 0))

    def kinds(name: str):  # lists of the few tickers captured at one instant
        return F.size(F.array_distinct(F.flatten(F.collect_list(name)))).cast("bigint")

    return mine.groupBy("capture_utc").agg(
        *[F.any_value(c).alias(c) for c in ("feed_timestamp", "index_last_trade", "seqno", "underlying_ticker", "underlying_price")],
        F.sum("n_options").alias("n_options"), kinds("expiries").alias("n_expiries"), kinds("roots").alias("n_roots"),
    )


def open_catalog(spark: SparkSession, curated_dir: str) -> DataFrame:
    """Register the views ``quotes`` and ``captures`` for any ``spark.sql`` query."""
    rows = table(spark, curated_dir)
    quotes = rows.where(F.col("kind") == QUOTE).select(*QUOTE_COLUMNS, DAY)
    quotes.createOrReplaceTempView("quotes")
    known_captures(rows).createOrReplaceTempView("captures")
    return quotes


def matching(captures: DataFrame, wanted: str | None = None) -> DataFrame:
    """One row: the newest capture, and the last whose stamp contains ``wanted``."""
    stamped = captures.select("capture_utc", symbols.stamp(F.col("capture_utc")).alias("stamp"))
    hit = F.lit(True) if wanted is None else F.col("stamp").contains(wanted)
    return stamped.agg(F.max("capture_utc").alias("newest"), F.max(F.when(hit, F.col("capture_utc"))).alias("match"))


def resolve_capture(captures: DataFrame, wanted: str | None = None):
    """The newest capture, or the last whose stamp contains ``wanted``."""
    found = matching(captures, wanted).first()
    if found.newest is None:
        raise LookupError("no captures in the curated layer: run backfill first")
    if found.match is None:
        raise LookupError(f"no capture matching {wanted!r}; newest is {found.newest:%Y-%m-%dT%H-%M-%SZ}")
    return found.match


def newest(captures: DataFrame, count: int = 1) -> DataFrame:
    return captures.orderBy(F.col("capture_utc").desc()).limit(count)

