"""Comparing what should exist with what does: manifests and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, CORRUPTED, MISSING, UNLISTED = "ok", "corrupted", "missing", "unlisted"


def verify(manifest: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(name, status) of a full outer match on file name.

    ``manifest`` and ``on_disk`` hold (name, digest). Corrupted and missing are
    bad; unlisted is a file newer than the manifest.
    """
    listed = manifest.select("name", F.col("digest").alias("_listed"))
    found = on_disk.select("name", F.col("digest").alias("_found"))
    status = (
        F.when(F.col("_found").isNull(), MISSING)
        .when(F.col("_listed").isNull(), UNLISTED)
        .when(F.col("_listed") == F.col("_found"), OK)
        .otherwise(CORRUPTED)
    )
    return listed.join(found, "name", "full_outer").select("name", status.alias("status"))


def divergence(raw: DataFrame, curated: DataFrame) -> DataFrame:
    """(stem, side): archived but not curated, or curated without an archive file."""
    a, b = raw.select("stem"), curated.select("stem")
    missing = a.subtract(b).withColumn("side", F.lit("missing_curated"))
    orphan = b.subtract(a).withColumn("side", F.lit("orphan_curated"))
    return missing.unionByName(orphan)
