"""Polygons over rasters: burn, zonal intersection, feature filters, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.geo import latlng_to_pixel
from terragrid.plans.sizing import Dim, shuffled, stage

MIN_PCT = 62.5


def polygon_spans(features: DataFrame, grid: DataFrame) -> DataFrame:
    """Runs of pixels whose centres lie inside each polygon.

    ``features`` has ``feature_id`` and ``rings`` (arrays of ``struct(lng, lat)``,
    closed here if they are not; those of fewer than three corners hold no pixel); ``grid`` is one row of raster metadata.  Edges, not polygons, are
    expanded to the pixel rows they cross, so the work of one large polygon
    spreads by row; a group below is one polygon on one row.  Even-odd rule over
    all rings, left edge inside, right edge outside.
    """
    g = grid.select("xmin", "ymax", "pixel_width", "pixel_height", "width", "height").first()
    width, height = g["width"], g["height"]
    rings = features.select("feature_id", F.explode("rings").alias("_ring"))
    closed = F.when(F.col("_ring")[0] == F.element_at("_ring", -1), F.col("_ring")).otherwise(F.concat("_ring", F.slice("_ring", 1, 1)))
    rings = rings.filter(F.size("_ring") > 2).select("feature_id", closed.alias("_ring")).filter(F.size("_ring") > 3)
    edges = rings.select(
        "feature_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("_ring") - 1),
                lambda i: F.struct(F.col("_ring")[i - 1].alias("a"), F.col("_ring")[i].alias("b")),
            )
        ).alias("e"),
    )
    gx = lambda p: (F.col(f"e.{p}.lng") - F.lit(g["xmin"])) / F.lit(g["pixel_width"])
    gy = lambda p: (F.lit(g["ymax"]) - F.col(f"e.{p}.lat")) / F.lit(g["pixel_height"])
    edges = edges.select(
        "feature_id", gx("a").alias("xa"), gy("a").alias("ya"), gx("b").alias("xb"), gy("b").alias("yb")
    ).filter("ya <> yb")
    # rows with min <= y + 0.5 < max
    y0 = F.greatest(F.ceil(F.least("ya", "yb") - 0.5), F.lit(0)).cast("int")
    y1 = F.least(F.ceil(F.greatest("ya", "yb") - 0.5) - 1, F.lit(height - 1)).cast("int")
    rows = edges.select("*", y0.alias("y0"), y1.alias("y1")).filter("y0 <= y1")
    rows = rows.withColumn("y", F.explode(F.sequence("y0", "y1")))
    cross = F.col("xa") + (F.col("y") + 0.5 - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    hits = rows.groupBy("feature_id", "y").agg(F.sort_array(F.collect_list(cross)).alias("_c"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_c") / 2).cast("int") - 1),
        lambda i: F.struct(F.col("_c")[i * 2].alias("a"), F.col("_c")[i * 2 + 1].alias("b")),
    )
    spans = hits.filter(F.size("_c") >= 2).select("feature_id", "y", F.explode(pairs).alias("s"))
    x0 = F.greatest(F.ceil(F.col("s.a") - 0.5), F.lit(0)).cast("int")
    x1 = F.least(F.ceil(F.col("s.b") - 0.5) - 1, F.lit(width - 1)).cast("int")
    return spans.select("feature_id", "y", x0.alias("x0"), x1.alias("x1")).filter("x0 <= x1")


#: Neighbouring pixels of a row that are burnt and sent together.
RUN = 64


def burn(features: DataFrame, grid: DataFrame) -> DataFrame:
    """J6 on runs: ``y, _run, _ids``, the features of ``RUN`` neighbouring pixels, null where there is none.

    Spans are cut at the runs and overlaps settled per run, the later feature
    wins; no row per pixel is made.
    """
    of = lambda c: F.floor(F.col(c) / RUN).cast("int")
    cut = polygon_spans(features, grid).withColumn("_run", F.explode(F.sequence(of("x0"), of("x1"))))
    a, b = F.greatest(F.col("x0") - F.col("_run") * RUN, F.lit(0)), F.least(F.col("x1") - F.col("_run") * RUN, F.lit(RUN - 1))
    parts = cut.groupBy("y", "_run").agg(F.collect_list(F.struct("feature_id", a.alias("a"), b.alias("b"))).alias("_s"))
    last = lambda i: F.array_max(F.transform("_s", lambda s: F.when(i.between(s["a"], s["b"]), s["feature_id"])))
    return parts.select("y", "_run", F.transform(F.sequence(F.lit(0), F.lit(RUN - 1)), last).alias("_ids"))


def rasterize(features: DataFrame, grid: DataFrame, fill: bool = False) -> DataFrame:
    """Feature of every covered pixel; the later feature wins an overlap.

    With ``fill`` pixels outside all polygons are returned as feature 0.
    """
    cells = burn(features, grid).select("y", "_run", F.posexplode("_ids").alias("_at", "feature_id")).filter("feature_id IS NOT NULL")
    burnt = cells.select("y", (F.col("_run") * RUN + F.col("_at")).alias("x"), "feature_id")
    if not fill:
        return burnt
    from terragrid.operators.overlay import constant_raster

    cells = constant_raster(grid.limit(1), 0).select("y", "x")
    return cells.join(shuffled(burnt), ["y", "x"], "left").select("y", "x", F.coalesce("feature_id", F.lit(0)).alias("feature_id"))


def _packed(feature_pixels: DataFrame) -> DataFrame:
    """Pixel rows ``y, x, feature_id`` as runs."""
    run = F.floor(F.col("x") / RUN).cast("int")
    burnt = feature_pixels.filter("feature_id <> 0").select("y", run.alias("_run"), (F.col("x") % RUN).alias("_at"), "feature_id")
    packed = burnt.groupBy("y", "_run").agg(F.map_from_entries(F.collect_list(F.struct("_at", "feature_id"))).alias("_m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(RUN - 1)), lambda i: F.col("_m")[i])
    return packed.select("y", "_run", slots.alias("_ids"))


def attach_features(pixels: DataFrame, burnt: DataFrame) -> DataFrame:
    """Feature under every pixel, null where there is none.

    ``burnt`` holds runs as ``burn`` makes them, or pixel rows ``y, x, feature_id``.
    """
    run = F.floor(F.col("x") / RUN).cast("int")
    runs = Dim(burnt if "_ids" in burnt.columns else _packed(burnt), name="runs")
    if runs.small:
        met = runs.join(pixels.withColumn("_run", run), ["y", "_run"])
        return met.select(*pixels.columns, F.get("_ids", F.col("x") % RUN).alias("feature_id"))
    cells = runs.df.select("y", "_run", F.posexplode("_ids").alias("_at", "feature_id")).filter("feature_id IS NOT NULL")
    cells = cells.select("y", (F.col("_run") * RUN + F.col("_at")).alias("x"), "feature_id")
    return pixels.join(shuffled(cells), ["y", "x"], "left").select(*pixels.columns, "feature_id")


def zonal_intersection(pixels: DataFrame, feature_pixels: DataFrame, min_pct: float = MIN_PCT) -> DataFrame:
    """Share of each cluster inside each feature, for all rasters at once.

    ``pct`` is of the cluster's valid pixels, inside features or not; ``passes``
    tells whether it reaches ``min_pct`` before rounding.

    Burnt polygons come as runs of a row (``burn``) or as pixel rows, which are
    packed into runs.  If those fit a broadcast, the rasters are not shuffled at all; otherwise both meet on
    ``(y, x)``.  Pixels are counted per (raster, cluster, feature) before the
    shuffle of the aggregate, and totals come from those counts, so a background
    cluster with most pixels costs no more than any other.
    """
    if not 0 <= min_pct <= 100:
        raise ValueError("min_pct must be between 0 and 100")
    valid = pixels.filter(F.col("value") != S.NODATA)
    counts = (
        attach_features(valid, feature_pixels)
        .groupBy("raster_key", F.col("value").alias("cluster_id"), "feature_id")
        .agg(F.count(F.lit(1)).alias("pixel_count"))
    )
    counts = stage(counts, "zonal")
    totals = counts.groupBy("raster_key", "cluster_id").agg(F.sum("pixel_count").alias("_total"))
    joined = Dim(totals).join(counts.filter("feature_id IS NOT NULL"), ["raster_key", "cluster_id"])
    pct = F.col("pixel_count") / F.col("_total") * 100
    return joined.select(
        "raster_key", "feature_id", "cluster_id", F.bround(pct, 2).alias("pct"), "pixel_count", (pct >= min_pct).alias("passes")
    )


def by_feature(intersections: DataFrame) -> DataFrame:
    """O2: feature -> clusters that pass, largest share first."""
    return intersections.filter("passes").orderBy("raster_key", "feature_id", F.desc("pct"), "cluster_id")


def by_cluster(intersections: DataFrame) -> DataFrame:
    """O2: cluster -> all features it touches, largest share first."""
    return intersections.orderBy("raster_key", "cluster_id", F.desc("pct"), "feature_id")


def check_threshold(threshold: float, min_pct: float) -> None:
    if not min_pct <= threshold <= 100:
        raise ValueError(f"threshold must be between {min_pct} and 100")


def filter_by_feature(
    intersections: DataFrame, registry: DataFrame, threshold: float, min_pct: float = MIN_PCT, feature_id: int | None = None
) -> DataFrame:
    """clusters of a feature (or of all) with ``pct >= threshold``, and their whole size."""
    check_threshold(threshold, min_pct)
    hits = intersections.filter(F.col("passes") & (F.col("pct") >= threshold))
    if feature_id is not None:
        hits = hits.filter(F.col("feature_id") == feature_id)
    sizes = registry.select("raster_key", "cluster_id", F.col("pixel_count").alias("cluster_size"))
    joined = hits.join(sizes, ["raster_key", "cluster_id"], "left")
    return joined.select(
        "raster_key", "feature_id", "cluster_id", "pct", "pixel_count", F.coalesce("cluster_size", F.lit(0)).alias("cluster_size")
    )


def feature_coverage(intersections: DataFrame, threshold: float, min_pct: float = MIN_PCT) -> DataFrame:
    """Share of a feature's indexed pixels in clusters that pass the threshold.

    A feature without a row here has no indexed cluster: no filter applies.
    """
    check_threshold(threshold, min_pct)
    indexed = intersections.filter("passes")
    hit = F.col("pct") >= threshold
    sums = indexed.groupBy("raster_key", "feature_id").agg(
        F.coalesce(F.sum(F.when(hit, F.col("pixel_count"))), F.lit(0)).alias("_covered"),
        F.sum("pixel_count").alias("_all"),
        F.count_if(hit).alias("n_clusters"),
    )
    pct = F.when(F.col("_all") > 0, F.try_divide(F.col("_covered"), F.col("_all")) * 100).otherwise(F.lit(0.0))
    return sums.select("raster_key", "feature_id", "n_clusters", pct.alias("coverage_pct"))


def cluster_list(
    registry: DataFrame, intersections: DataFrame, feature_id: int, threshold: float, min_pct: float = MIN_PCT
) -> DataFrame:
    """All clusters; those of the feature first, by share, then the rest by id."""
    hits = filter_by_feature(intersections, registry, threshold, min_pct, feature_id).select(
        "raster_key", "cluster_id", "pct", F.col("pixel_count").alias("inside_count"), "cluster_size"
    )
    listed = registry.join(hits, ["raster_key", "cluster_id"], "left").withColumn("is_filtered", F.col("pct").isNotNull())
    return listed.orderBy("raster_key", F.desc("is_filtered"), F.desc("pct"), "cluster_id")


def attach_properties(intersections: DataFrame, features: DataFrame) -> DataFrame:
    """Feature attributes next to each intersection."""
    return intersections.join(features.select("feature_id", "properties"), "feature_id", "left")


def sample_points(points: DataFrame, meta: DataFrame, seg: S.SegmentedRaster) -> DataFrame:
    """Value and class under each point, in every raster.

    ``points`` has ``point_id, lng, lat``, and ``raster_key`` to look into one raster
    only.  Outside a raster ``x, y, cluster_id``
    and ``path`` are null.  Distinct cells are looked up first: few of them are sent
    to the pixels, which then need no shuffle, and a cell under very many points
    is looked up once.
    """
    grids = meta.select("raster_key", "xmin", "ymax", "pixel_width", "pixel_height", "width", "height")
    if "raster_key" not in points.columns:
        # as many as the data set has rasters
        keys = [r["raster_key"] for r in grids.select("raster_key").collect()]
        points = points.withColumn("raster_key", F.explode(F.array(*[F.lit(k) for k in keys])))
    placed = Dim(grids, derived=False).join(points, ["raster_key"], how="inner")
    placed = placed.select("point_id", "raster_key", latlng_to_pixel(F.col("lat"), F.col("lng")).alias("_p"))
    placed = placed.select("point_id", "raster_key", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    cells = Dim(placed.filter("x IS NOT NULL").select("raster_key", "y", "x").distinct())
    found = cells.join(seg.pixels, ["raster_key", "y", "x"], how="inner", bounded=True)
    hit = Dim(found.select("raster_key", "y", "x", F.col("value").alias("cluster_id"))).join(
        placed, ["raster_key", "y", "x"], spread=["point_id"]
    )
    attrs = seg.registry.select("raster_key", "cluster_id", F.col("classification_path").alias("_path"))
    named = Dim(attrs).join(hit, ["raster_key", "cluster_id"])
    path = F.when(F.col("cluster_id").isNotNull(), F.coalesce("_path", F.lit(S.UNLABELED)))
    return named.select("point_id", "raster_key", "x", "y", "cluster_id", path.alias("path"))


def select_clusters(sampled: DataFrame) -> DataFrame:
    """Cluster picked by each point; negative ids select nothing."""
    return sampled.select(
        "point_id", "raster_key", F.when(F.col("cluster_id") >= 0, F.col("cluster_id")).alias("cluster_id")
    )
