"""Frames as text: one printer for every report, streamed row by row."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame


def _shown(value) -> str:
    if value is None:
        return "-"
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, float):
        return f"{value:.6g}"
    return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def lines(frame: DataFrame, *order) -> Iterator[str]:
    """A heading of the column names, then one line per row; widths follow from the column types."""
    wide = {"string": 24, "timestamp": 19, "double": 12, "bigint": 11, "int": 8, "boolean": 7, "date": 10}
    width = [max(len(name), wide.get(kind, 12)) for name, kind in frame.dtypes]
    yield "  ".join(name.ljust(w) for name, w in zip(frame.columns, width, strict=True)).rstrip()
    for row in (frame.orderBy(*order) if order else frame).toLocalIterator():
        yield "  ".join(_shown(v).ljust(w) for v, w in zip(row, width, strict=True)).rstrip()


def show(title: str, frame: DataFrame, *order) -> int:
    """Print a titled frame; returns how many rows it had."""
    n = -1
    for n, line in enumerate(lines(frame, *order)):
        if not n:
            print(f"[{title}]")
        print(line)
    return n
