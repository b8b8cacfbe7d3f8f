"""Folding collection outcomes into one health record per key.

Three clocks fail differently: no attempt at all means the scheduler, no
success means the feed, and no write is normal out of hours.

A stretch of the log, in order, comes down to a summary: counters, clocks, the
last outcome, and the failures since its last success. Two neighbouring
summaries make one, so the log is read once, cut into ranges over tasks, and what
the tasks give per key is merged in the order of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .gate import LOCKED
from .ordered import group_starts, ranged

CLOCKS = {"attempt": "last_attempt", "ok": "last_ok", "write": "last_write"}
COUNTERS = ("total_writes", "total_skips", "total_failures")
#: A stretch's summary besides the counters; ``streak`` counts failures after its last success, all of them where it has none.
LAST = ("last_attempt", "last_ok", "last_write", "last_verdict", "last_error")


def _picked(column: pa.Array, at: np.ndarray) -> pa.Array:
    """Entries at places; null where the place is negative."""
    return column.take(pa.array(np.maximum(at, 0), mask=at < 0))


def _summaries(batch: pa.RecordBatch, key: np.ndarray, keys: list[str]) -> pa.Table:
    """One row per group of a sorted batch."""
    starts = np.flatnonzero(group_starts(key))
    ends = np.append(starts[1:], len(key)) - 1
    ok = ~batch.column("error").is_valid().to_numpy(zero_copy_only=False)
    written = ok & batch.column("written").fill_null(False).to_numpy(zero_copy_only=False)
    place = np.arange(len(key))
    last = lambda mask: np.maximum.reduceat(np.where(mask, place, -1), starts)
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    failed = np.cumsum(~ok)
    last_ok, last_write = last(ok), last(written)
    base = np.where(last_ok >= 0, failed[last_ok], failed[starts] - ~ok[starts])
    at = batch.column("at")
    return pa.table(
        {
            **{k: batch.column(k).take(pa.array(starts)) for k in keys},
            "_has_ok": last_ok >= 0, "streak": failed[ends] - base,
            "total_writes": count(written), "total_skips": count(ok & ~written), "total_failures": count(~ok),
            "last_attempt": _picked(at, ends), "last_ok": _picked(at, last_ok), "last_write": _picked(at, last_write),
            "last_verdict": _picked(batch.column("verdict"), ends), "last_error": _picked(batch.column("error"), ends),
        }
    )


def _after(early: dict, late: dict) -> dict:
    """The summary of a stretch followed by another."""
    clocks = {c: late[c] if late[c] is not None else early[c] for c in ("last_ok", "last_write")}
    return {
        **late, **clocks, **{c: early[c] + late[c] for c in COUNTERS},
        "streak": late["streak"] + (0 if late["_has_ok"] else early["streak"]), "_has_ok": early["_has_ok"] or late["_has_ok"],
    }


def _stretches(keys: list[str], schema: pa.Schema):
    """One summary per key and task: batches are summarised as arrays, and joined where a key runs on into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, held_key = TaskContext.get().partitionId(), None, None

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.append_column("_part", pa.array(np.full(rows.num_rows, part, np.int32)))
            yield from rows.select(schema.names).cast(schema).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("_key").to_numpy(zero_copy_only=False)
            made = _summaries(batch, key, keys)
            first = made.slice(0, 1).to_pylist()[0]
            if held is not None:
                if key[0] == held_key:
                    first = _after(held, first)
                else:
                    yield from out(pa.Table.from_pylist([held], made.schema))
            if made.num_rows > 1:
                yield from out(pa.Table.from_pylist([first], made.schema))
                yield from out(made.slice(1, made.num_rows - 2))
                first = made.slice(made.num_rows - 1).to_pylist()[0]
            held, held_key, held_schema = first, key[-1], made.schema
        if held is not None:
            yield from out(pa.Table.from_pylist([held], held_schema))

    return run


def fold(outcomes: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """Clocks and counters over (``at``, ``verdict``, ``written``, ``error``) rows, ``order`` starting with ``at``.

    A run that found the lock held records nothing. The log is read once.
    """
    rows = outcomes.where(F.col("verdict") != LOCKED)
    rows = rows.select(*dict.fromkeys([*keys, *order, "at", "verdict", "written", "error"]), F.to_json(F.struct(*keys)).alias("_key"))
    field = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType(
        [T.StructField(k, field[k]) for k in keys]
        + [T.StructField("_part", T.IntegerType()), T.StructField("_has_ok", T.BooleanType()), T.StructField("streak", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in COUNTERS]
        + [T.StructField(c, field["at"]) for c in CLOCKS.values()]
        + [T.StructField(c, T.StringType()) for c in ("last_verdict", "last_error")]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    stretches = ranged(rows, keys, order, tasks).mapInArrow(_stretches(keys, arrow), schema)
    # At most a row per key and task.
    part = F.col("_part")
    merged = stretches.groupBy(*keys).agg(
        F.max("last_attempt").alias("last_attempt"), F.max("last_ok").alias("last_ok"), F.max("last_write").alias("last_write"),
        F.max_by("last_verdict", part).alias("last_verdict"), F.max_by("last_error", part).alias("last_error"),
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.array_sort(F.collect_list(F.struct("_part", "_has_ok", "streak"))).alias("_parts"),
    )
    streak = F.aggregate("_parts", F.lit(0).cast("bigint"), lambda n, p: F.when(p["_has_ok"], p["streak"]).otherwise(n + p["streak"]))
    return merged.withColumn("consecutive_failures", streak).drop("_parts")


def age(clock: Column, now: Column) -> Column:
    """How long ago a clock last moved, as an interval; null if it never has."""
    return now - clock


def with_ages(record: DataFrame, now: Column) -> DataFrame:
    """Add ``attempt_age``, ``ok_age`` and ``write_age``."""
    return record.withColumns({f"{name}_age": age(F.col(clock), now) for name, clock in CLOCKS.items()})


def stale(record: DataFrame, now: Column, limit: str, clock: str = "ok") -> DataFrame:
    """Records whose clock has not moved within ``limit`` (an interval such as '30 minutes'), or never."""
    moved = age(F.col(CLOCKS[clock]), now)
    return record.where(moved.isNull() | (moved > F.expr(f"interval {limit}")))
