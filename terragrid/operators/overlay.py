"""Overlays of several rasters: composite, merge, interactive, class export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions import ids as I
from terragrid.functions import paths as P
from terragrid.functions.color import NODATA_HEX
from terragrid.operators.hierarchy import path_colors
from terragrid.operators.registry import aggregate_by_key, area_ha, build_registry, count_pixels
from terragrid.plans.sizing import Dim, number_rows, stage

PRIORITIES = ("highest_k", "lowest_k", "most_specific")


def synthetic_raster(pixels: DataFrame, reference: str) -> S.SegmentedRaster:
    """Empty label raster over a reference raster: 9999 where it has data."""
    base = pixels.filter(F.col("raster_key") == reference)
    value = F.when(F.col("value") != S.NODATA, F.lit(S.UNLABELED_ID)).otherwise(F.lit(S.NODATA))
    made = base.select(F.lit(S.SYNTHETIC_KEY).alias("raster_key"), "y", "x", value.alias("value"))
    return S.SegmentedRaster(made, build_registry(made))


def composite_placeholder(pixels: DataFrame, reference: str) -> DataFrame:
    """9999 everywhere, nodata pixels too; its registry is empty."""
    base = pixels.filter(F.col("raster_key") == reference)
    return base.select(F.lit(S.COMPOSITE_KEY).alias("raster_key"), "y", "x", F.lit(S.UNLABELED_ID).alias("value"))


def constant_raster(meta: DataFrame, fill: int) -> DataFrame:
    """P5: a raster of one value on the grid of each ``meta`` row.

    Rows of the grid are spread over tasks before their pixels are generated.
    """
    n = meta.sparkSession.sparkContext.defaultParallelism
    rows = meta.filter("width > 0 AND height > 0").select(
        "raster_key", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    )
    rows = rows.repartition(n, "raster_key", "y")
    return rows.select(
        "raster_key", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), F.lit(fill).alias("value")
    )


def composite_inputs(registry: DataFrame, priority: str = "highest_k") -> DataFrame:
    """The rasters that enter a composite with their place ``prio`` (1 first).

    Special rasters stay out, except the synthetic one, which leads when it has
    labels.  There is one row per raster.
    """
    per_raster = registry.groupBy("raster_key").agg(
        F.max(I.is_labeled(F.col("classification_path"))).alias("_labeled")
    )
    synthetic = F.col("raster_key") == S.SYNTHETIC_KEY
    kept = per_raster.filter(~F.col("raster_key").isin(*S.SPECIAL_KEYS) | (synthetic & F.col("_labeled")))
    k = I.k_of(F.col("raster_key"))
    by_k = k.asc_nulls_last() if priority == "lowest_k" else k.desc_nulls_last()
    return number_rows(kept.select("raster_key"), [(~synthetic).asc(), by_k, "raster_key"], "prio", start=1)


def composite_ids(registry: DataFrame, priority: str = "highest_k", inputs: DataFrame | None = None) -> DataFrame:
    """Ids 1..n of all labelled clusters by (priority, cluster id).

    "most_specific" ranks deeper class paths first, then higher k.  Ids that
    would be reserved ones (9999 and above) are moved to ``COMPOSITE_START``
    and above; they keep the order.
    """
    if priority not in PRIORITIES:
        raise ValueError(f"priority must be one of {PRIORITIES}")
    inputs = composite_inputs(registry, priority) if inputs is None else inputs
    labeled = registry.filter(I.is_labeled(F.col("classification_path"))).join(inputs, "raster_key")
    order: list = ["prio", "cluster_id"]
    if priority == "most_specific":
        order = [P.depth(F.col("classification_path")).desc()] + order
    labeled = labeled.select("raster_key", "cluster_id", "classification_path", "color", "prio")
    numbered = number_rows(labeled, order, "uid", start=1)
    return numbered.withColumn("uid", I.outside_reserved(F.col("uid")))


def composite(
    seg: S.SegmentedRaster,
    priority: str = "highest_k",
    reference: str | None = None,
    colors: DataFrame | None = None,
) -> S.SegmentedRaster:
    """Each pixel takes the first raster, by priority, whose cluster is labelled.

    Composite ids grow with priority, so the winner at a pixel is the smallest
    id: one ``min`` per pixel, combined before the only shuffle, on ``(y, x)``.
    Pixels without a label are dropped before it unless they belong to the
    reference raster, which decides where the output is nodata.
    """
    inputs = composite_inputs(seg.registry, priority)
    ids = composite_ids(seg.registry, priority, inputs)
    if reference is None:
        first = inputs.filter("prio = 1").first()
        if first is None:
            raise ValueError("no rasters to build a composite from")
        reference = first["raster_key"]
    lookup = Dim(ids.select("raster_key", F.col("cluster_id").alias("value"), "uid"))
    tagged = lookup.join(seg.pixels, ["raster_key", "value"])
    is_ref = F.col("raster_key") == reference
    tagged = tagged.filter(is_ref | F.col("uid").isNotNull()).select(
        "y", "x", "uid", F.when(is_ref, F.col("value") != S.NODATA).alias("_valid")
    )
    won = tagged.groupBy("y", "x").agg(F.min("uid").alias("_uid"), F.max("_valid").alias("_valid"))
    value = F.when(F.col("_valid"), F.coalesce("_uid", F.lit(S.UNLABELED_ID))).otherwise(F.lit(S.NODATA))
    pixels = won.filter(F.col("_valid").isNotNull()).select(
        F.lit(S.COMPOSITE_KEY).alias("raster_key"), "y", "x", value.cast("int").alias("value")
    )
    counts = count_pixels(pixels).select(F.col("cluster_id").alias("uid"), "pixel_count")
    rows = ids.join(counts, "uid", "left").withColumn("pixel_count", F.coalesce("pixel_count", F.lit(0)))
    if colors is not None:
        shade = path_colors(ids.select(F.col("classification_path").alias("path")), colors)
        rows = rows.join(shade.select(F.col("path").alias("classification_path"), "css"), "classification_path", "left")
        rows = rows.withColumn("color", F.col("css"))
    registry = rows.select(
        F.lit(S.COMPOSITE_KEY).alias("raster_key"),
        F.col("uid").alias("cluster_id"),
        "pixel_count",
        "classification_path",
        "color",
        area_ha(F.col("pixel_count")).alias("area_ha"),
        F.col("raster_key").alias("source_raster"),
        F.col("cluster_id").alias("source_id"),
    )
    return S.SegmentedRaster(pixels, registry, seg.meta)


def check_same_grid(meta_a: DataFrame, meta_b: DataFrame) -> None:
    """Refuse to merge rasters of different size (metadata of one or more rasters each)."""
    size = [F.col("width"), F.col("height")]
    sizes = meta_a.select(*size).union(meta_b.select(*size)).distinct().take(2)
    if len(sizes) > 1:
        a, b = sorted(tuple(r) for r in sizes)
        raise ValueError(f"cannot merge rasters with different dimensions: {a} and {b}")


def merge(
    a: DataFrame,
    b: DataFrame,
    decide: Callable[[Column, Column, Column, Column], Column],
    key: str = "merged",
    metas: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Combine two rasters cell by cell with ``decide(a, b, y, x) -> Column``.

    Rasters of different extent are refused; a cell that one of them lacks is
    nodata there.  With ``metas``, the metadata of both, sizes are read from it
    and no pixel is scanned for them; otherwise the last row and column that
    occur must be the same, so a raster without its last row needs ``metas``.
    """
    if metas is not None:
        check_same_grid(*metas)
    else:
        last = lambda px, name: px.agg(F.struct(F.max("y"), F.max("x")).alias(name))
        ends = last(a, "a").crossJoin(last(b, "b")).first()  # one row each
        if tuple(ends["a"]) != tuple(ends["b"]):
            raise ValueError(f"cannot merge rasters with different dimensions: {tuple(ends['a'])} and {tuple(ends['b'])}")
    none = F.lit(S.NODATA)
    left = a.select("y", "x", F.col("value").alias("_a"))
    right = b.select("y", "x", F.col("value").alias("_b"))
    both = left.join(right, ["y", "x"], "full").withColumns({"_a": F.coalesce("_a", none), "_b": F.coalesce("_b", none)})
    value = decide(F.col("_a"), F.col("_b"), F.col("y"), F.col("x"))
    return both.select(F.lit(key).alias("raster_key"), "y", "x", value.cast("int").alias("value"))


def interactive_pixels(
    composite_px: DataFrame, current_px: DataFrame, metas: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """J4 first half: composite where labelled, else the current cluster + 50000.

    Nodata on either side stays nodata.  ``metas`` as in ``merge``.
    """

    def decide(c: Column, v: Column, y: Column, x: Column) -> Column:
        free = F.when(v == S.NODATA, F.lit(S.NODATA)).otherwise(v + S.FINE_GRAIN_START)
        return F.when(c == S.NODATA, F.lit(S.NODATA)).when(c != S.UNLABELED_ID, c).otherwise(free)

    return merge(composite_px, current_px, decide, S.INTERACTIVE_KEY, metas)


def interactive_registry(composite_reg: DataFrame, current_reg: DataFrame) -> DataFrame:
    """Composite rows without 9999, and the current rows as unlabelled fine-grain ids."""
    cols = ["raster_key", "cluster_id", "pixel_count", "classification_path", "color", "area_ha"]
    top = composite_reg.filter(F.col("cluster_id") != S.UNLABELED_ID).withColumn(
        "raster_key", F.lit(S.INTERACTIVE_KEY)
    )
    fine = (
        current_reg.withColumn("raster_key", F.lit(S.INTERACTIVE_KEY))
        .withColumn("cluster_id", (F.col("cluster_id") + S.FINE_GRAIN_START).cast("int"))
        .withColumn("classification_path", F.lit(S.UNLABELED))
        .withColumn("color", F.lit(None).cast("string"))
    )
    return top.select(*cols).unionByName(fine.select(*cols))


def interactive(
    composite_seg: S.SegmentedRaster,
    current_seg: S.SegmentedRaster,
    colors: DataFrame | None = None,
    level: int | None = None,
) -> S.SegmentedRaster:
    """One raster of labelled classes and still unlabelled clusters.

    Clusters of the same class path become one; each unlabelled cluster stays
    on its own.  The merged pixels are staged once, because ids are assigned
    from them and then written back to them.  Sizes are compared by metadata where
    both rasters have it.
    """
    known = composite_seg.meta is not None and current_seg.meta is not None
    metas = (composite_seg.meta, current_seg.meta) if known else None
    merged = stage(interactive_pixels(composite_seg.pixels, current_seg.pixels, metas), "interactive")
    both = S.SegmentedRaster(merged, interactive_registry(composite_seg.registry, current_seg.registry))

    def key(cluster_id: Column, path: Column, color: Column) -> Column:
        own = F.concat(F.lit("unlabeled_"), cluster_id.cast("string"))
        return F.when(I.is_labeled(path), path).otherwise(own)

    out = aggregate_by_key(both, key)
    if colors is None:
        return out
    shade = path_colors(out.registry.select(F.col("classification_path").alias("path")), colors, level=level)
    registry = out.registry.drop("color").join(
        shade.select(F.col("path").alias("classification_path"), F.col("css").alias("color")),
        "classification_path",
        "left",
    )
    return S.SegmentedRaster(out.pixels, registry.select(*out.registry.columns), composite_seg.meta)


def _shown_paths(seg: S.SegmentedRaster, level: int | None) -> DataFrame:
    """Truncated class of every cluster that occurs in the pixels."""
    present = count_pixels(seg.pixels).select("raster_key", "cluster_id")
    known = seg.registry.select("raster_key", "cluster_id", "classification_path")
    path = P.truncate(F.col("classification_path"), level)
    path = F.when(I.is_labeled(F.col("classification_path")), path).otherwise(F.lit(S.UNLABELED))
    return present.join(known, ["raster_key", "cluster_id"], "left").select("raster_key", "cluster_id", path.alias("path"))


def _mapping_of(shown: DataFrame) -> DataFrame:
    distinct = stage(shown.select("path").distinct(), "classes")
    ids = number_rows(distinct.filter(F.col("path") != S.UNLABELED), ["path"], "id")
    rest = distinct.filter(F.col("path") == S.UNLABELED).select("path", F.lit(S.UNLABELED_ID).alias("id"))
    return ids.select("path", I.outside_reserved(F.col("id")).alias("id")).unionByName(rest)


def pixel_mapping(seg: S.SegmentedRaster, level: int | None = None, colors: DataFrame | None = None) -> DataFrame:
    """Export ids: sorted class paths 0..n-1, "unlabeled" 9999 if it occurs; ids from 9999 on move beyond the reserved ones.

    Works on distinct clusters, never on pixels.
    """
    mapping = _mapping_of(_shown_paths(seg, level))
    if colors is None:
        return mapping.select("id", "path")
    shade = path_colors(mapping, colors).select("path", "hex")
    return mapping.join(shade, "path", "left").select("id", "path", "hex")


def color_mapping(mapping: DataFrame, colors: DataFrame) -> DataFrame:
    """Id -> hex for an export; -1 is black, 9999 has no colour."""
    shade = path_colors(mapping, colors).select("path", "hex")
    classes = mapping.filter(F.col("id") != S.UNLABELED_ID).join(shade, "path", "left").select("id", "path", "hex")
    none = F.lit(None).cast("string")
    fixed = mapping.sparkSession.range(2).select(
        F.when(F.col("id") == 0, F.lit(S.NODATA)).otherwise(F.lit(S.UNLABELED_ID)).alias("id"),
        F.when(F.col("id") == 1, F.lit(S.UNLABELED)).alias("path"),
        F.when(F.col("id") == 0, F.lit(NODATA_HEX)).otherwise(none).alias("hex"),
    )
    return classes.unionByName(fixed)


def classification_raster(seg: S.SegmentedRaster, level: int | None = None) -> DataFrame:
    """Export class of every pixel; nodata -1, unlabelled 9999.

    Class ids are attached to clusters first, so pixels see one lookup.
    """
    shown = stage(_shown_paths(seg, level), "shown")
    class_of = shown.join(_mapping_of(shown), "path").select(
        "raster_key", F.col("cluster_id").alias("value"), F.col("id").alias("class_id")
    )
    joined = Dim(class_of).join(seg.pixels, ["raster_key", "value"])
    value = F.when(F.col("value") == S.NODATA, F.lit(S.NODATA)).otherwise(
        F.coalesce("class_id", F.lit(S.UNLABELED_ID))
    )
    return joined.select("raster_key", "y", "x", value.cast("int").alias("class_id"))
