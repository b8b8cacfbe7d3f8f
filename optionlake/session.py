"""Session settings the plans rely on.

Everything here is either a correctness setting (UTC) or lets AQE do the work a
hand-written plan would otherwise repeat: turning a shuffled join into a
broadcast one once the measured side is small, splitting hot join partitions,
and coalescing small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even if the aggregate after it then needs its
    # own exchange: one more exchange of partial rows beats one endless task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A generated method over 8,000 bytes is never compiled to machine code; let
    # Spark use its split-up form for the long pricing expressions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.compression.codec": "zstd",
    # Rows sent to Python are batched by size too: 10,000 bodies in one batch
    # would be gigabytes a task.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def get_spark(master: str | None = None, app: str = "optionlake", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(
        # Recording a call site per expression doubles the time to build a plan.
        "spark.python.sql.dataFrameDebugging.enabled", "false"
    )
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, str(value))
    return tune(builder.getOrCreate())


def work_folder(spark: SparkSession) -> str:
    """A folder that every executor shares: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def settle(df: DataFrame) -> DataFrame:
    """Compute a frame once that several parts of a plan read, and cut its lineage.

    Goes to ``spark.checkpoint.dir``, or to the warehouse where that is unset;
    executors share both, so losing one costs nothing.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread few rows that each mean much work over all tasks.

    AQE joins partitions by size, and rows of a few bytes would all end up in
    one task; a partition count given here is left alone. An aggregation by the
    same keys needs no further exchange.
    """
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
