"""Display and export colours of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.color import BLACK, DEFAULT_HEX, grayscale, hex_to_rgb
from terragrid.functions.ids import is_labeled
from terragrid.operators.hierarchy import path_colors
from terragrid.plans.sizing import Dim


def _paint(seg: S.SegmentedRaster, by_cluster: DataFrame) -> DataFrame:
    """Attach a colour resolved per cluster to pixels; one lookup, nodata stays null."""
    dim = Dim(by_cluster.select("raster_key", F.col("cluster_id").alias("value"), "_color"))
    painted = dim.join(seg.pixels, ["raster_key", "value"])
    shown = F.when(F.col("value") != S.NODATA, F.col("_color"))
    return painted.select("raster_key", "y", "x", "value", shown.alias("color"))


def _select(painted: DataFrame, selected: int | None) -> DataFrame:
    if selected is None:
        return painted
    chosen = (F.col("value") == selected) & (F.col("value") != S.NODATA)
    return painted.withColumn("color", F.when(chosen, F.lit(BLACK)).otherwise(F.col("color")))


def cluster_colors(
    seg: S.SegmentedRaster, selected: int | None = None, shown: DataFrame | None = None, grayscale_labeled: bool = False
) -> DataFrame:
    """Colour by cluster.

    Nodata has none, the selected cluster is black, clusters outside ``shown``
    are faint grey, labelled ones grey on demand.
    """
    reg = seg.registry.select("raster_key", "cluster_id", "classification_path", F.nullif("color", F.lit("")).alias("color"))
    if shown is None:
        reg = reg.withColumn("_in", F.lit(True))
    else:
        keep = shown.select("raster_key", "cluster_id", F.lit(True).alias("_in")).distinct()
        reg = reg.join(keep, ["raster_key", "cluster_id"], "left")
    color = F.when(F.col("_in").isNull(), grayscale(F.col("color"), 0.3))
    if grayscale_labeled:
        color = color.when(is_labeled(F.col("classification_path")), grayscale(F.col("color"), 1))
    by_cluster = reg.withColumn("_color", color.otherwise(F.col("color")))
    return _select(_paint(seg, by_cluster), selected)


def class_colors(
    seg: S.SegmentedRaster,
    colors: DataFrame,
    level: int = 1,
    selected: int | None = None,
    grayscale_labeled: bool = False,
) -> DataFrame:
    """Colour by class at a hierarchy level; unlabelled clusters keep their own."""
    shade = path_colors(seg.registry.select(F.col("classification_path").alias("path")), colors, level=level)
    reg = seg.registry.join(
        shade.select(F.col("path").alias("classification_path"), "css"), "classification_path", "left"
    )
    css = grayscale(F.col("css"), 1) if grayscale_labeled else F.col("css")
    own = F.when(is_labeled(F.col("classification_path")), css).otherwise(F.col("color"))
    painted = _paint(seg, reg.withColumn("_color", own))
    marked = F.when(F.col("value") == S.SELECTED, F.lit(BLACK)).otherwise(F.col("color"))
    return _select(painted.withColumn("color", marked), selected)


def composite_colors(seg: S.SegmentedRaster, colors: DataFrame, level: int | None = None) -> DataFrame:
    """Composite layer; 0, nodata, 9999, unknown and unlabelled are transparent."""
    shade = path_colors(seg.registry.select(F.col("classification_path").alias("path")), colors, level=level)
    reg = seg.registry.join(
        shade.select(F.col("path").alias("classification_path"), "css"), "classification_path", "left"
    )
    shown = F.when(~F.col("cluster_id").isin(0, S.UNLABELED_ID), F.col("css"))
    return _paint(seg, reg.withColumn("_color", shown))


def export_colors(classes: DataFrame, mapping: DataFrame, colors: DataFrame) -> DataFrame:
    """Colour of an exported class raster, ``#888888`` where no colour is known."""
    plain = mapping.select("id", "path")
    shade = path_colors(plain, colors, strict=False, fallback=DEFAULT_HEX).select("path", "hex")
    by_id = plain.join(shade, "path", "left").select(
        F.col("id").alias("class_id"), "path", F.coalesce("hex", F.lit(DEFAULT_HEX)).alias("hex")
    )
    joined = Dim(by_id).join(classes, ["class_id"])
    return joined.select(
        "raster_key", "y", "x", "class_id", F.when(F.col("class_id") != S.NODATA, F.col("hex")).alias("hex"), "path"
    )


def render_image(classes: DataFrame, mapping: DataFrame, colors: DataFrame, scale: int = 4) -> DataFrame:
    """Up-scaled RGBA image; nodata transparent, unlabelled and unknown black."""
    painted = export_colors(classes, mapping, colors)
    hexed = F.when(is_labeled(F.col("path")), F.col("hex")).otherwise(F.lit("#000000"))
    transparent = (F.col("class_id") == S.NODATA) & ~is_labeled(F.col("path"))
    rgb = F.split(hex_to_rgb(hexed, strict=False), ",")
    channel = lambda i: F.when(transparent, F.lit(0)).otherwise(rgb[i].cast("int"))
    out = painted.select(
        "raster_key", "y", "x",
        channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"),
        F.when(transparent, F.lit(0)).otherwise(F.lit(255)).alias("a"),
    )
    step = F.sequence(F.lit(0), F.lit(scale - 1))
    out = out.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    return out.select(
        "raster_key", (F.col("y") * scale + F.col("_dy")).alias("y"), (F.col("x") * scale + F.col("_dx")).alias("x"),
        "r", "g", "b", "a",
    )
