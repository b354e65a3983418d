"""Label edits: last write wins, bulk replacement, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F




def latest_labels(events: DataFrame) -> DataFrame:
    """The newest edit of each ``(raster_key, cluster_id)`` by ``ts``, then ``seq``.

    An aggregate rather than a window: edits are reduced before the shuffle, so a
    cluster with very many edits sends one row per task.
    """
    newest = events.groupBy("raster_key", "cluster_id").agg(
        F.max(F.struct("ts", "seq", "path")).alias("_e")
    )
    return newest.select("raster_key", "cluster_id", F.col("_e.path").alias("path"), F.col("_e.ts").alias("ts"), F.col("_e.seq").alias("seq"))


def merge_labels(current: DataFrame, newer: DataFrame) -> DataFrame:
    """Add edits to a label table; the later edit wins."""
    cols = ["raster_key", "cluster_id", "path", "ts", "seq"]
    return latest_labels(current.select(*cols).unionByName(newer.select(*cols)))


def replace_labels(current: DataFrame, rasters: DataFrame, labels: DataFrame) -> DataFrame:
    """W6 in bulk: the label sets of the listed rasters are replaced by ``labels``."""
    cols = ["raster_key", "cluster_id", "path", "ts", "seq"]
    kept = current.join(rasters.select("raster_key").distinct(), "raster_key", "left_anti")
    new = labels.join(rasters.select("raster_key").distinct(), "raster_key", "left_semi")
    return kept.select(*cols).unionByName(new.select(*cols))


def clear_labels(current: DataFrame) -> DataFrame:
    """An empty label set."""
    return current.limit(0)
