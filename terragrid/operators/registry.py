"""Cluster counts, registries, lookups and labels over pixel tables.

Pixel-sized inputs are aggregated to cluster size first; everything that joins
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.color import DEFAULT_RGB, css_of
from terragrid.functions.ids import is_labeled, k_of, outside_reserved
from terragrid.plans.sizing import Dim, number_rows, stage


def area_ha(count: Column, pixel_area_ha: float = S.PIXEL_AREA_HA) -> Column:
    """Hectares of a pixel count, two decimals."""
    return (count * F.lit(str(pixel_area_ha)).cast("decimal(18,6)")).cast("decimal(18,2)")


def map_pixels(pixels: DataFrame, fn: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """New value from ``fn(y, x, value)``."""
    return pixels.withColumn("value", fn(F.col("y"), F.col("x"), F.col("value")).cast("int"))


def remap(pixels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace ids by a table ``(raster_key, value, new_value)``; others stay."""
    joined = Dim(mapping.select("raster_key", "value", "new_value"), derived=False).join(pixels, ["raster_key", "value"])
    return joined.select("raster_key", "y", "x", F.coalesce("new_value", "value").alias("value"))


def count_by_value(pixels: DataFrame, exclude: Iterable[int] = ()) -> DataFrame:
    """A2: pixels per value, without the listed values."""
    exclude = list(exclude)
    kept = pixels.filter(~F.col("value").isin(exclude)) if exclude else pixels
    return kept.groupBy("raster_key", F.col("value").alias("cluster_id")).agg(F.count(F.lit(1)).alias("pixel_count"))


def count_pixels(pixels: DataFrame, nodata: int = S.NODATA) -> DataFrame:
    """A1: pixels per cluster, nodata left out (F2)."""
    return count_by_value(pixels, [nodata])


def histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """A3: equal bins from the smallest to the largest value, nodata included.

    Pixels are counted per distinct value first; only those counts are binned.
    A constant raster has all its pixels in bin 0.
    """
    counts = stage(count_by_value(pixels), "histogram")
    size = (F.col("_max") - F.col("_min")) / F.lit(float(bins))
    ranges = counts.groupBy("raster_key").agg(F.min("cluster_id").alias("_min"), F.max("cluster_id").alias("_max"))
    ranges = ranges.withColumn("_size", size)
    slot = F.when(
        F.col("_size") > 0,
        F.least(F.floor(F.try_divide(F.col("cluster_id") - F.col("_min"), F.col("_size"))), F.lit(bins - 1)),
    ).otherwise(F.lit(0))
    filled = counts.join(ranges, "raster_key").select("raster_key", slot.cast("int").alias("bin"), "pixel_count")
    filled = filled.groupBy("raster_key", "bin").agg(F.sum("pixel_count").alias("count"))
    edges = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edges = edges.withColumn("left_edge", F.col("_min") + F.col("bin") * F.col("_size"))
    return edges.join(filled, ["raster_key", "bin"], "left").select(
        "raster_key", "bin", "left_edge", F.coalesce("count", F.lit(0)).alias("count")
    )


def build_registry(
    pixels: DataFrame,
    attributes: DataFrame | Callable[[Column], tuple[Column, Column]] | None = None,
    pixel_area_ha: float = S.PIXEL_AREA_HA,
) -> DataFrame:
    """A4: one row per cluster that occurs.

    ``attributes`` is a table of ``raster_key, cluster_id`` with ``path`` and
    ``color``, or a function ``cluster_id -> (path, color)`` of Columns; a missing
    path is "unlabeled".
    """
    counts = count_pixels(pixels)
    if callable(attributes):
        path, color = attributes(F.col("cluster_id"))
        path = F.when(is_labeled(path), path).otherwise(F.lit(S.UNLABELED))
    elif attributes is None:
        path, color = F.lit(S.UNLABELED), F.lit(None).cast("string")
    else:
        counts = counts.join(attributes, ["raster_key", "cluster_id"], "left")
        path = F.col("path") if "path" in attributes.columns else F.lit(None).cast("string")
        path = F.when(is_labeled(path), path).otherwise(F.lit(S.UNLABELED))
        color = F.col("color") if "color" in attributes.columns else F.lit(None).cast("string")
    return counts.select(
        "raster_key",
        "cluster_id",
        "pixel_count",
        path.alias("classification_path"),
        color.alias("color"),
        area_ha(F.col("pixel_count"), pixel_area_ha).alias("area_ha"),
    )


def palette_colors(registry_ids: DataFrame, palette: DataFrame) -> DataFrame:
    """``rgb(r, g, b)`` of each ``(raster_key, cluster_id)``, grey when unknown."""
    joined = registry_ids.join(palette, ["raster_key", "cluster_id"], "left")
    css = css_of(F.col("r"), F.col("g"), F.col("b"))
    return joined.select("raster_key", "cluster_id", F.coalesce(css, F.lit(DEFAULT_RGB)).alias("color"))


def lookup_clusters(pixels: DataFrame, registry: DataFrame, derived: bool = True) -> DataFrame:
    """Class and colour of every pixel; "unlabeled" and null when unknown."""
    attrs = registry.select(
        "raster_key", F.col("cluster_id").alias("value"), F.col("classification_path").alias("path"), "color"
    )
    joined = Dim(attrs, derived).join(pixels, ["raster_key", "value"])
    return joined.select(
        "raster_key", "y", "x", "value", F.coalesce("path", F.lit(S.UNLABELED)).alias("path"), "color"
    )


def filter_clusters(
    seg: S.SegmentedRaster, ids: DataFrame, fill: int = S.NODATA, derived: bool = False
) -> S.SegmentedRaster:
    """keep the listed ``(raster_key, cluster_id)``; other pixels become ``fill``.

    Registry rows of the kept clusters stay as they are.
    """
    wanted = ids.select("raster_key", "cluster_id").distinct()
    dim = Dim(wanted.select("raster_key", F.col("cluster_id").alias("value"), F.lit(True).alias("_keep")), derived)
    kept = dim.join(seg.pixels, ["raster_key", "value"]).select(
        "raster_key", "y", "x", F.when(F.col("_keep"), F.col("value")).otherwise(F.lit(fill)).alias("value")
    )
    registry = seg.registry.join(wanted, ["raster_key", "cluster_id"], "left_semi")
    return S.SegmentedRaster(kept, registry, seg.meta)


def labeled_clusters(registry: DataFrame) -> DataFrame:
    """labelled clusters; rasters without any disappear."""
    return registry.filter(is_labeled(F.col("classification_path"))).select(
        "raster_key", "cluster_id", F.col("classification_path").alias("path")
    )


def labeled_paths(registry: DataFrame) -> DataFrame:
    """Distinct class paths in use."""
    return labeled_clusters(registry).select("path").distinct()


def progress(registry: DataFrame) -> DataFrame:
    """Labelled and total clusters per raster."""
    return registry.groupBy("raster_key").agg(
        F.count_if(is_labeled(F.col("classification_path"))).alias("labeled"),
        F.count(F.lit(1)).alias("total"),
    )


def restore_labels(registry: DataFrame, labels: DataFrame) -> DataFrame:
    """Put saved labels onto clusters that exist; colours are left alone."""
    saved = labels.select("raster_key", "cluster_id", F.col("path").alias("_saved"))
    joined = registry.join(saved, ["raster_key", "cluster_id"], "left")
    return joined.withColumn("classification_path", F.coalesce("_saved", "classification_path")).select(
        *registry.columns
    )


def set_labels(registry: DataFrame, edits: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """W6 applied to a registry: new path and its colour; "unlabeled" has none.

    ``edits`` holds the winning edit per ``(raster_key, cluster_id)``.
    """
    from terragrid.operators.hierarchy import path_colors

    new = edits.select("raster_key", "cluster_id", F.col("path").alias("_path"))
    if colors is not None:
        resolved = path_colors(new.select(F.col("_path").alias("path")).distinct(), colors, strict=True)
        new = new.join(resolved.select(F.col("path").alias("_path"), F.col("css").alias("_css")), "_path", "left")
    else:
        new = new.withColumn("_css", F.lit(None).cast("string"))
    joined = registry.join(new, ["raster_key", "cluster_id"], "left")
    edited = F.col("_path").isNotNull()
    return joined.select(
        "raster_key",
        "cluster_id",
        "pixel_count",
        F.coalesce("_path", "classification_path").alias("classification_path"),
        F.when(edited, F.col("_css")).otherwise(F.col("color")).alias("color"),
        "area_ha",
    )


def raster_order(keys: DataFrame, descending: bool = False) -> DataFrame:
    """O1: rasters by their k."""
    k = k_of(F.col("raster_key"))
    return keys.select("raster_key", k.alias("k")).orderBy(
        (F.col("k").desc_nulls_last() if descending else F.col("k").asc_nulls_last()), "raster_key"
    )


def aggregate_by_key(
    seg: S.SegmentedRaster, key: Callable[[Column, Column, Column], Column], nodata: int = S.NODATA
) -> S.SegmentedRaster:
    """Merge clusters that share ``key(cluster_id, path, color)``.

    New ids count from 1 in row-major order of first appearance (past the reserved ids); path and colour
    come from the earliest cluster of the key that the registry knows.  The key
    depends on the cluster alone, so pixels are reduced to one row per cluster
    before any ranking.  ``source_id`` keeps the old id of every pixel.
    """
    place = F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("x").cast("long"))
    clusters = (
        seg.pixels.filter(F.col("value") != nodata)
        .groupBy("raster_key", F.col("value").alias("cluster_id"))
        .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    known = seg.registry.select(
        "raster_key", "cluster_id", "classification_path", "color", F.lit(True).alias("_known")
    )
    clusters = clusters.join(known, ["raster_key", "cluster_id"], "left")
    clusters = stage(
        clusters.withColumn("_key", key(F.col("cluster_id"), F.col("classification_path"), F.col("color"))), "clusters"
    )
    info = F.when(F.col("_known"), F.struct("classification_path", "color"))
    at = F.when(F.col("_known"), F.col("_first"))
    groups = clusters.groupBy("raster_key", "_key").agg(
        F.min("_first").alias("_first"), F.sum("_n").alias("pixel_count"), F.min_by(info, at).alias("_info")
    )
    groups = number_rows(groups, ["_first"], "_id", start=1, within=["raster_key"]).withColumn("_id", outside_reserved(F.col("_id")))
    new_ids = clusters.select("raster_key", F.col("cluster_id").alias("value"), "_key").join(
        groups.select("raster_key", "_key", "_id"), ["raster_key", "_key"]
    )
    pixels = Dim(new_ids.select("raster_key", "value", "_id")).join(seg.pixels, ["raster_key", "value"])
    pixels = pixels.select(
        "raster_key", "y", "x", F.coalesce("_id", "value").alias("value"), F.col("value").alias("source_id")
    )
    path = F.col("_info.classification_path")
    registry = groups.select(
        "raster_key",
        F.col("_id").alias("cluster_id"),
        "pixel_count",
        F.when(is_labeled(path), path).otherwise(F.lit(S.UNLABELED)).alias("classification_path"),
        F.col("_info.color").alias("color"),
        area_ha(F.col("pixel_count")).alias("area_ha"),
        F.col("_key").alias("source_key"),
    )
    return S.SegmentedRaster(pixels, registry, seg.meta)
