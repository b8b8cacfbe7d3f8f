"""Raw capture bodies to validated snapshots to option rows, all declaratively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, symbols
from ..schema import CAPTURE_FIELDS, META_FIELDS, PAYLOAD, QUOTE_COLUMNS, QUOTE_FIELDS


def _text(variant: Column) -> Column:
    """Text of a VARIANT that holds text; NULL for any other type and for ''."""
    is_text = F.schema_of_variant(variant) == "STRING"
    return F.when(is_text, F.nullif(F.try_variant_get(variant, "$", "string"), F.lit("")))


def snapshots(bodies: DataFrame) -> DataFrame:
    """Validate each ``body`` of (ticker, capture_utc, body).

    Adds the lifted fields, ``options`` and ``error``: NULL for a usable body,
    else the first rule it breaks. Nothing is ever defaulted. The ticker is the
    one requested; the body's own symbol does not round-trip to it.
    """
    data = F.col("_p.data")
    read = (
        bodies.withColumn("_p", F.from_json("body", PAYLOAD))
        .withColumns(
            {
                "feed_timestamp": F.col("_p.timestamp"),
                "_stamp": _text(data["last_trade_time"]),
                "seqno": data["seqno"],
                "spot": data["current_price"],
                "options": data["options"],
            }
        )
        .withColumn("index_last_trade", clock.eastern_instant(F.col("_stamp")))
    )
    stamp, spot = F.col("_stamp"), F.col("spot")
    quoted = F.concat(F.lit("'"), stamp, F.lit("'"))
    lost = F.col("index_last_trade").isNull()
    error = (
        # Only a body without a data object is ever read a second time.
        F.when(
            data.isNull(),
            F.when(F.col("body").isNull() | F.try_parse_json("body").isNull(), "malformed JSON")
            .when(~F.ltrim("body").startswith("{"), "payload is not an object")
            .otherwise("payload has no 'data' object"),
        )
        .when(F.coalesce("feed_timestamp", F.lit("")) == "", "payload has no top-level 'timestamp'")
        .when(stamp.isNull(), "empty timestamp")
        .when(
            lost & clock.looks_aware(stamp),
            F.concat(F.lit("expected a naive US/Eastern timestamp, got an aware one: "), quoted),
        )
        .when(lost, F.concat(F.lit("unparseable timestamp "), quoted))
        .when(
            spot.isNull() | F.isnan(spot) | (spot <= 0),
            F.concat(F.lit("unusable current_price: "), F.coalesce(spot.cast("string"), F.lit("None"))),
        )
        .when(F.col("seqno").isNull(), "unusable seqno")
        .when(F.col("options").isNull(), "payload has no 'options' list")
    )
    return read.withColumns(
        {"error": error, "n_options": F.coalesce(F.size("options"), F.lit(0))}
    ).drop("_stamp")


def capture_meta(snaps: DataFrame) -> DataFrame:
    """One row per capture with the index-level fields of its header."""
    head = F.struct(
        "ticker", "capture_utc", "feed_timestamp", "index_last_trade", "seqno", "spot",
        *[F.col("_p.data")[name].alias(name) for name in META_FIELDS],
    )
    usable = F.array(F.when(F.col("error").isNull(), head))
    return snaps.select(F.inline_outer(usable)).where("ticker is not null")


def option_rows(snaps: DataFrame) -> DataFrame:
    """One row per option of every usable snapshot; ``contract`` NULL if unparsed."""
    # Not a filter before the explode: it would be pushed under the JSON read and
    # make every body be read twice.
    return (
        snaps.select(
            "capture_utc", "feed_timestamp", "index_last_trade", "seqno",
            F.col("ticker").alias("underlying_ticker"), F.col("spot").alias("underlying_price"),
            F.explode_outer(F.when(F.col("error").isNull(), F.col("options"))).alias("_o"),
        )
        .where("_o is not null")
        .withColumn("contract", symbols.contract(_text(F.col("_o.option"))))
    )


def quotes(rows: DataFrame) -> DataFrame:
    """The curated table: parsed options in the declared columns and order."""

    def field(name: str, kind: T.DataType) -> Column:
        raw = F.col(f"_o.{name}")
        return (_text(raw) if isinstance(kind, T.StringType) else raw).alias(name)

    return (
        rows.where("contract is not null")
        .select(
            *[name for name, _ in CAPTURE_FIELDS], "contract.*",
            *[field(name, kind) for name, kind in QUOTE_FIELDS],
        )
        .select(*QUOTE_COLUMNS)
    )


def conversion_report(snaps: DataFrame) -> DataFrame:
    """Per capture: rows converted, contracts that did not parse, or the error."""
    unparsed = F.size(
        F.filter("options", lambda o: symbols.contract(_text(o["option"])).isNull())
    )
    good = F.col("error").isNull()
    return snaps.select(
        "ticker", "capture_utc", symbols.stem(F.col("ticker"), F.col("capture_utc")).alias("stem"),
        F.when(good, F.col("n_options") - unparsed).alias("rows"),
        F.when(good, unparsed).alias("unparsed"),
        "error",
    )
