"""Declared schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["capture_utc", "expiry", "root"]
"""One smile: a settlement root of one expiry in one capture."""

# The quote columns of the curated table, in file order.
QUOTE_FIELDS = [
    ("bid", T.DoubleType()),
    ("bid_size", T.DoubleType()),
    ("ask", T.DoubleType()),
    ("ask_size", T.DoubleType()),
    ("last_trade_price", T.DoubleType()),
    ("last_trade_time", T.StringType()),
    ("volume", T.DoubleType()),
    ("open_interest", T.DoubleType()),
    ("iv", T.DoubleType()),
    ("theo", T.DoubleType()),
    ("delta", T.DoubleType()),
    ("gamma", T.DoubleType()),
    ("theta", T.DoubleType()),
    ("vega", T.DoubleType()),
    ("rho", T.DoubleType()),
    ("prev_day_close", T.DoubleType()),
    ("change", T.DoubleType()),
    ("percent_change", T.DoubleType()),
    ("open", T.DoubleType()),
    ("high", T.DoubleType()),
    ("low", T.DoubleType()),
    ("tick", T.StringType()),
]

CAPTURE_FIELDS = [
    ("capture_utc", T.TimestampType()),
    ("feed_timestamp", T.StringType()),
    ("index_last_trade", T.TimestampType()),
    ("seqno", T.LongType()),
    ("underlying_ticker", T.StringType()),
    ("underlying_price", T.DoubleType()),
]

CONTRACT_FIELDS = [
    ("option_symbol", T.StringType()),
    ("root", T.StringType()),
    ("option_right", T.StringType()),
    ("expiry", T.DateType()),
    ("strike", T.DoubleType()),
]

QUOTES = T.StructType(
    [T.StructField(n, t, False) for n, t in CAPTURE_FIELDS + CONTRACT_FIELDS]
    + [T.StructField(n, t, True) for n, t in QUOTE_FIELDS]
)
QUOTE_COLUMNS = QUOTES.fieldNames()

# Text fields of an option travel as VARIANT so that a number in a text field
# can be told from text; see sources.payloads.
_OPTION = T.StructType(
    [T.StructField("option", T.VariantType())]
    + [
        T.StructField(n, T.VariantType() if isinstance(t, T.StringType) else t)
        for n, t in QUOTE_FIELDS
    ]
)

# Index-level fields of the payload header.
META_FIELDS = [
    "bid", "ask", "bid_size", "ask_size", "open", "high", "low", "close",
    "prev_day_close", "price_change", "price_change_percent", "iv30",
    "iv30_change", "iv30_change_percent", "volume",
]

PAYLOAD = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("symbol", T.StringType()),
                    T.StructField("current_price", T.DoubleType()),
                    T.StructField("last_trade_time", T.VariantType()),
                    T.StructField("seqno", T.LongType()),
                    *[T.StructField(n, T.DoubleType()) for n in META_FIELDS],
                    T.StructField("options", T.ArrayType(_OPTION)),
                ]
            ),
        ),
    ]
)

STAMP = "yyyy-MM-dd'T'HH-mm-ss'Z'"
"""Capture instants as they appear in file names, always UTC."""
