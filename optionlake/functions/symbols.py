"""Contract symbols and capture file names, parsed with built-in string functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STAMP

# The contract-symbol layout and the capture file-name layout.
CONTRACT = r"^([A-Z]+)(\d{6})([CP])(\d{8})$"
CAPTURE_FILE = r"^([A-Z_]+)_(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z)\.json(\.gz)?$"


def clean_symbol(symbol: Column) -> Column:
    return F.translate(symbol, " ", "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value worked out once: inside a lambda Spark works out every mention of an expression again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contract(symbol: Column) -> Column:
    """``struct(option_symbol, root, option_right, expiry, strike)``, or NULL.

    NULL covers both a symbol off the layout and a date that does not exist.
    """

    def placed(text: Column, root: Column) -> Column:
        after = F.length(root)
        expiry = F.try_to_date(F.concat(F.lit("20"), text.substr(after + 1, F.lit(6))), "yyyyMMdd")
        return F.when(root != "", _once(expiry, lambda day: F.when(day.isNotNull(), F.struct(  # "" where the layout is another
            text.alias("option_symbol"),
            root.alias("root"),
            F.when(text.substr(after + 7, F.lit(1)) == "C", "call").otherwise("put").alias("option_right"),
            day.alias("expiry"),
            (text.substr(after + 8, F.lit(8)).try_cast("int") / 1000.0).alias("strike"),
        ))))

    return _once(clean_symbol(symbol), lambda text: _once(F.regexp_extract(text, CONTRACT, 1), lambda root: placed(text, root)))


def capture_file(name: Column) -> Column:
    """``struct(ticker, capture_utc, compressed, stem)`` of a file name, or NULL."""
    stamp = F.regexp_extract(name, CAPTURE_FILE, 2)
    instant = F.try_to_timestamp(stamp, F.lit(STAMP))
    ticker = F.regexp_extract(name, CAPTURE_FILE, 1)
    return F.when(
        name.rlike(CAPTURE_FILE) & instant.isNotNull(),
        F.struct(
            ticker.alias("ticker"),
            instant.alias("capture_utc"),
            name.endswith(".gz").alias("compressed"),
            F.concat(ticker, F.lit("_"), stamp).alias("stem"),
        ),
    )


def stamp(instant: Column) -> Column:
    return F.date_format(instant, STAMP)


def stem(ticker: Column, instant: Column) -> Column:
    return F.concat(ticker, F.lit("_"), stamp(instant))
