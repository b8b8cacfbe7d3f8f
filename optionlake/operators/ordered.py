"""Row-order operators that never put a whole group into one task.

``lead`` and ``lag`` over a plain partition sort every row of a group in one
task. ``with_following`` cuts each group into bands of its ordering value (a
strike band); windows run inside a band, and one small edge row per band carries
what crosses a boundary. ``last_before`` cuts by range exchange instead, at
whatever density, and carries one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settle


def with_following(
    df: DataFrame, keys: list[str], band: Column, order: list[str], payload: list[str]
) -> DataFrame:
    """Add ``ahead`` (up to two following rows of the group) and ``group_rows``.

    ``band`` must not decrease along ``order``. ``ahead`` is an array of structs
    of the ``payload`` columns; ``group_rows`` counts the whole group.
    """
    banded = df.withColumn("_band", band)
    local = Window.partitionBy(*keys, "_band").orderBy(*order)
    item = F.struct(*payload)
    rows = banded.select(
        "*",
        F.row_number().over(local).alias("_pos"),
        F.lead(item, 1).over(local).alias("_next1"),
        F.lead(item, 2).over(local).alias("_next2"),
    )

    # One row per band: how many rows, and its first two.
    edges = rows.groupBy(*keys, "_band").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_compact(
            F.array(
                F.max(F.when(F.col("_pos") == 1, item)),
                F.max(F.when(F.col("_pos") == 2, item)),
            )
        ).alias("_head"),
    )
    across = Window.partitionBy(*keys).orderBy("_band")
    group = Window.partitionBy(*keys)
    empty = F.slice(F.col("_head"), 1, 0)
    edges = edges.select(
        *keys,
        "_band",
        F.sum("_n").over(group).alias("group_rows"),
        F.slice(
            F.concat(
                F.coalesce(F.lead("_head", 1).over(across), empty),
                F.coalesce(F.lead("_head", 2).over(across), empty),
            ),
            1,
            2,
        ).alias("_beyond"),
    )
    ahead = F.slice(
        F.concat(F.array_compact(F.array("_next1", "_next2")), F.col("_beyond")), 1, 2
    )
    return (
        rows.join(edges, [*keys, "_band"])
        .withColumn("ahead", ahead)
        .drop("_band", "_pos", "_next1", "_next2", "_beyond")
    )


def ranged(df: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """Rows in order of keys and order, cut into equally full ranges over tasks.

    A group of any size or density is split wherever the ranges say; the tasks
    that hold its rows are consecutive.
    """
    conf = df.sparkSession.conf
    tasks = tasks or max(int(conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)


def group_starts(key: np.ndarray) -> np.ndarray:
    """Whether each row of a batch starts a new group."""
    return np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)


def _filled(columns: list[str], types: list[pa.DataType], value_type: pa.DataType):
    """Carry values forward through the sorted rows of a task, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        nothing = pa.nulls(1, value_type)
        held, first_key, last_key, opened = nothing, None, None, True

        def marks(n: int, still_open: np.ndarray, edge: bool) -> list[pa.Array]:
            return [pa.array(still_open), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge))]

        names = [*columns, "_seen", "_open", "_part", "_edge", "_first", "_last"]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column("_key").to_numpy(zero_copy_only=False)
            has = batch.column("_value").is_valid().to_numpy(zero_copy_only=False)
            start = group_starts(key)
            start[0] = last_key is None or key[0] != last_key
            if first_key is None:
                first_key = key[0]
            if start[0]:
                held = nothing
            place = np.arange(n)
            begins = np.maximum.accumulate(np.where(start, place, 0))
            latest = np.maximum.accumulate(np.where(has, place, -1))
            before = np.append(-1, latest[:-1])
            carried = begins == 0 if not start[0] else np.zeros(n, bool)  # the group began in an earlier batch
            inside = before >= begins
            # Entry 0 is what earlier batches left, the others are this batch's values.
            pool = pa.concat_arrays([held, batch.column("_value")])
            take = np.where(inside, before + 1, 0)
            seen = pool.take(pa.array(take, mask=~(inside | carried)))
            first_group = key == first_key if opened else np.zeros(n, bool)
            still_open = first_group & ~seen.is_valid().to_numpy(zero_copy_only=False)
            nulls = [pa.nulls(n, pa.string())] * 2
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), seen, *marks(n, still_open, False), *nulls], names=names)
            opened = opened and key[-1] == first_key
            ends = int(latest[-1])
            if ends >= begins[-1]:
                held = batch.column("_value").slice(ends, 1)
            elif begins[-1] > 0:
                held = nothing
            last_key = key[-1]
        if last_key is not None:
            edge = [pa.nulls(1, t) for t in types]
            yield pa.RecordBatch.from_arrays(
                [*edge, held, *marks(1, np.zeros(1, bool), True), pa.array([first_key]), pa.array([last_key])], names=names
            )

    return run


def last_before(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, tasks: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = settle,
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` strictly before each row of its group.

    One exchange by ranges of (keys, order), so a dense group is spread over as
    many tasks as its rows fill. Each task carries values forward and adds one
    row that says which groups it began and ended with and what it held at the
    end; those rows, one per task, tell a task what its first group had before.
    ``keep`` stores the rows, which are read twice.
    """
    keyed = df.withColumns({"_key": F.to_json(F.struct(*keys)), "_value": value})
    fields = [f for f in keyed.schema.fields if f.name not in ("_key", "_value")]
    value_type = keyed.schema["_value"].dataType
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in fields]
        + [T.StructField("_seen", value_type), T.StructField("_open", T.BooleanType()), T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.BooleanType()), T.StructField("_first", T.StringType()), T.StructField("_last", T.StringType())]
    )
    arrow = [to_arrow_type(f.dataType) for f in fields]
    swept = keep(ranged(keyed, keys, order, tasks).mapInArrow(_filled([f.name for f in fields], arrow, to_arrow_type(value_type)), schema))

    along, group = Window.orderBy("_part"), Window.partitionBy("_last").orderBy("_part")  # a row per task
    edges = swept.where("_edge").select("_part", "_first", "_last", "_seen")
    edges = edges.withColumn("_held", F.last("_seen", ignorenulls=True).over(group))
    carried = edges.select(
        F.col("_part").alias("_to"), F.when(F.lag("_last").over(along) == F.col("_first"), F.lag("_held").over(along)).alias("_carried")
    ).where("_carried is not null")
    # Bounded by the number of tasks, so a broadcast whatever the size of the log.
    return (
        swept.where("not _edge").join(F.broadcast(carried), F.col("_open") & (F.col("_part") == F.col("_to")), "left")
        .withColumn(name, F.coalesce("_seen", "_carried"))
        .select(*df.columns, name)
    )
