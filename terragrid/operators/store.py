"""Block store: blocks along a Z-order curve, ranges per file, a pyramid of value counts.

A block row is ``raster_key, by, bx, values`` with row-major values, null where the
raster has no pixel.  ``write_store`` lays the rows out by their place on a Z-order
curve, so a file holds blocks that lie close together; an index names the part of the
curve in each file.  Readers that want few blocks open only files whose part holds one.

The pyramid counts the values of every block, and of 2 x 2 blocks level by level.
Zones that cover whole blocks are counted from it; only blocks on the border of a zone
are read as pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.geo import latlng_to_pixel
from terragrid.operators.zonal import MIN_PCT, RUN, burn, polygon_spans, sample_points
from terragrid.plans.sizing import Dim, stage

PLACE = ["raster_key", "by", "bx"]


def block_of(c: Column | str, block: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / block).cast("int")


def cell_of(block: int, y: str = "y", x: str = "x") -> Column:
    """Row-major place of a pixel in its block."""
    return (F.pmod(F.col(y), F.lit(block)) * block + F.pmod(F.col(x), F.lit(block))).cast("int")


def pack_blocks(pixels: DataFrame, block: int) -> DataFrame:
    """M1 with built-in functions: one row per block, null where the raster has no pixel.

    Rows of a block are packed first, then the block from its rows: both groupings
    agree with the one shuffle by block.
    """
    cells = pixels.select("raster_key", block_of("y", block).alias("by"), block_of("x", block).alias("bx"), F.pmod("y", F.lit(block)).alias("_r"), F.pmod("x", F.lit(block)).alias("_c"), "value")
    packed = lambda df, keys, at, v: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at, v))).alias("_m"))
    # the map is named once for each place and not within a lambda: there the optimiser would build it anew for every place
    at = [F.col("_m")[i] for i in range(block)]
    rows = packed(cells.repartition(*PLACE), [*PLACE, "_r"], "_c", "value").select(*PLACE, "_r", F.array(*at).alias("_row"))
    none = F.array_repeat(F.lit(None).cast("int"), block)
    return packed(rows, PLACE, "_r", "_row").select(*PLACE, F.concat(*[F.coalesce(row, none) for row in at]).alias("values"))


def z_order(y: Column, x: Column) -> Column:
    """Place on the Z-order curve: the bits of both coordinates in turn (30 each; never negative)."""

    def spread(c: Column) -> Column:
        c = c.cast("long")
        # Masks that part the bits of a number, by halves.
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return F.shiftleft(spread(y), 1).bitwiseOR(spread(x))


def write_store(blocks: DataFrame, path: str, files: int) -> None:
    """Write blocks in Z-order into about ``files`` files, and the index of what each holds."""
    placed = blocks.withColumn("z", z_order(F.col("by"), F.col("bx")))
    placed.repartitionByRange(files, "raster_key", "z").sortWithinPartitions("raster_key", "z").write.parquet(f"{path}/blocks")
    spark = blocks.sparkSession
    held = spark.read.parquet(f"{path}/blocks").select("raster_key", "z", F.col("_metadata.file_path").alias("file"))
    held.groupBy("raster_key", "file").agg(F.min("z").alias("low"), F.max("z").alias("high")).coalesce(1).write.parquet(f"{path}/index")


def files_with(spark: SparkSession, path: str, wanted: DataFrame) -> list[str]:
    """Files of a store whose part of the curve holds one of the ``wanted`` blocks (raster_key, by, bx).

    The index has a row per file and raster; each wanted block looks through those of its raster.
    """
    index = spark.read.parquet(f"{path}/index")
    parts = index.groupBy("raster_key").agg(F.collect_list(F.struct("low", "high", "file")).alias("_parts"))
    placed = wanted.select("raster_key", z_order(F.col("by"), F.col("bx")).alias("z")).distinct()
    hit = placed.join(F.broadcast(parts), "raster_key").select(F.explode(F.filter("_parts", lambda p: F.col("z").between(p["low"], p["high"]))).alias("p"))
    return sorted(r["file"] for r in hit.select("p.file").distinct().collect())  # names of files


def read_store(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Blocks of a store; with ``wanted`` (raster_key, by, bx) only files that may hold one are opened, and only those rows returned."""
    if wanted is None:
        return spark.read.parquet(f"{path}/blocks").select(*PLACE, "values")
    wanted = stage(wanted.select(*PLACE).distinct(), "wanted", measure=True)
    files = files_with(spark, path, wanted)
    found = spark.read.schema(f"{S.BLOCKS}, z long").parquet(*files) if files else spark.createDataFrame([], f"{S.BLOCKS}, z long")
    return Dim(wanted, derived=False).join(found, PLACE, how="left_semi", bounded=True).select(*PLACE, "values")


def sample_points_stored(points: DataFrame, meta: DataFrame, registry: DataFrame, path: str, block: int) -> DataFrame:
    """J5 on a store: :func:`terragrid.operators.zonal.sample_points`, reading only files with a block under a point."""
    spark = points.sparkSession
    grids = meta.select("raster_key", "xmin", "ymax", "pixel_width", "pixel_height", "width", "height")
    on = F.col("p.raster_key") == F.col("g.raster_key") if "raster_key" in points.columns else F.lit(True)
    # a grid is one row per raster
    at = points.alias("p").join(F.broadcast(grids.alias("g")), on).select(F.col("g.raster_key"), latlng_to_pixel(F.col("lat"), F.col("lng")).alias("_p"))
    cells = at.select("raster_key", F.col("_p.y").alias("y"), F.col("_p.x").alias("x")).filter("x IS NOT NULL").distinct()
    cells = stage(cells.select("*", block_of("y", block).alias("by"), block_of("x", block).alias("bx")), "cells", measure=True)
    found = Dim(cells, derived=False).join(read_store(spark, path, cells), PLACE, how="inner", bounded=True)
    pixels = found.select("raster_key", "y", "x", F.get("values", cell_of(block)).alias("value")).filter("value IS NOT NULL")
    return sample_points(points, meta, S.SegmentedRaster(pixels, registry, meta))


def stored_blocks(spark: SparkSession, path: str) -> Callable[[DataFrame], DataFrame]:
    """Reader for growth: each round opens the files with blocks that its fronts reach."""
    return lambda wanted: read_store(spark, path, wanted)


# --- summaries -----------------------------------------------------------------------------------


def pyramid(blocks: DataFrame, levels: int, nodata: int = S.NODATA) -> DataFrame:
    """A1 per block and level: ``level, raster_key, by, bx, value, n``; a level halves the places of the one below."""
    cells = blocks.select(*PLACE, F.explode("values").alias("value")).filter(F.col("value") != nodata)
    now = stage(cells.groupBy(*PLACE, "value").agg(F.count(F.lit(1)).alias("n")), "pyramid")
    out = now.withColumn("level", F.lit(0))
    for level in range(1, levels):
        up = now.groupBy("raster_key", F.floor(F.col("by") / 2).cast("int").alias("by"), F.floor(F.col("bx") / 2).cast("int").alias("bx"), "value")
        now = stage(up.agg(F.sum("n").alias("n")), "pyramid")
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out.select("level", *PLACE, "value", "n")


def zone_cover(features: DataFrame, grid: DataFrame, block: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Burnt polygons as a quadtree: whole places ``level, by, bx, feature_id``, and ``by, bx`` of blocks on a border.

    A block is whole when the last feature that touches it covers all of it.  Four whole
    blocks of one feature become a place of the next level.
    """
    g = grid.select("width", "height").first()
    spans = polygon_spans(features, grid)
    parts = spans.select("feature_id", block_of("y", block).alias("by"), F.explode(F.sequence(block_of("x0", block), block_of("x1", block))).alias("bx"), "x0", "x1")
    length = F.least(F.col("x1"), F.col("bx") * block + block - 1) - F.greatest(F.col("x0"), F.col("bx") * block) + 1
    touched = parts.groupBy("by", "bx", "feature_id").agg(F.sum(length).alias("covered"))
    last = touched.groupBy("by", "bx").agg(F.max_by("covered", "feature_id").alias("covered"), F.max("feature_id").alias("feature_id"))
    side = lambda c, size: F.least(F.lit(block), F.lit(size) - F.col(c) * block)
    last = stage(last.select("by", "bx", "feature_id", (F.col("covered") == side("by", g["height"]) * side("bx", g["width"])).alias("whole")), "zones")
    border = last.filter("NOT whole").select("by", "bx")
    now, out = last.filter("whole").select("by", "bx", "feature_id"), []
    for level in range(levels):
        half = lambda c: F.floor(F.col(c) / 2).cast("int")
        up = now.groupBy(half("by").alias("uy"), half("bx").alias("ux"), "feature_id").agg(F.count(F.lit(1)).alias("_n"))
        full = stage(up.filter("_n = 4").select("uy", "ux", "feature_id"), "zones") if level + 1 < levels else None
        if full is None:
            out.append(now.withColumn("level", F.lit(level)))
            break
        rest = now.withColumns({"uy": half("by"), "ux": half("bx")}).join(full, ["uy", "ux", "feature_id"], "left_anti")
        out.append(rest.select("by", "bx", "feature_id", F.lit(level).alias("level")))
        now = full.select(F.col("uy").alias("by"), F.col("ux").alias("bx"), "feature_id")
    cover = out[0]
    for more in out[1:]:
        cover = cover.unionByName(more)
    return cover.select("level", "by", "bx", "feature_id"), border


def zonal_intersection_stored(
    features: DataFrame, meta: DataFrame, counts: DataFrame, read: Callable[[DataFrame], DataFrame], block: int, levels: int, min_pct: float = MIN_PCT
) -> DataFrame:
    """A6 from summaries: ``raster_key, feature_id, cluster_id, pct, pixel_count, passes`` for all rasters of one grid.

    ``counts`` is the :func:`pyramid` of the rasters; ``read`` gives the blocks of ``raster_key,
    by, bx`` (:func:`stored_blocks`).  Places inside a feature are counted from the pyramid,
    blocks on a border from their pixels.
    """
    if not 0 <= min_pct <= 100:
        raise ValueError("min_pct must be between 0 and 100")
    grid = meta.limit(1)
    cover, border = zone_cover(features, grid, block, levels)
    inner = Dim(cover, name="cover").join(counts, ["level", "by", "bx"], how="inner", bounded=True).select("raster_key", "feature_id", "value", "n")
    keys = meta.select("raster_key")
    wanted = border.join(F.broadcast(keys)).select(*PLACE)  # a row per raster
    cells = read(wanted).select(*PLACE, F.posexplode("values").alias("_i", "value")).filter(F.col("value") != S.NODATA)
    cells = cells.select("raster_key", (F.col("by") * block + F.floor(F.col("_i") / block)).cast("int").alias("y"), (F.col("bx") * block + F.col("_i") % block).cast("int").alias("x"), "value")
    runs = Dim(burn(features, grid), name="runs")
    met = runs.join(cells.withColumn("_run", F.floor(F.col("x") / RUN).cast("int")), ["y", "_run"], how="inner", bounded=True)
    outer = met.select("raster_key", F.get("_ids", F.col("x") % RUN).alias("feature_id"), "value").filter("feature_id IS NOT NULL")
    outer = outer.groupBy("raster_key", "feature_id", "value").agg(F.count(F.lit(1)).alias("n"))
    inside = inner.unionByName(outer).groupBy("raster_key", "feature_id", F.col("value").alias("cluster_id")).agg(F.sum("n").alias("pixel_count"))
    totals = counts.filter(F.col("level") == levels - 1).groupBy("raster_key", F.col("value").alias("cluster_id")).agg(F.sum("n").alias("_total"))
    pct = F.col("pixel_count") / F.col("_total") * 100
    joined = Dim(totals).join(inside, ["raster_key", "cluster_id"], how="inner")
    return joined.select("raster_key", "feature_id", "cluster_id", F.bround(pct, 2).alias("pct"), "pixel_count", (pct >= min_pct).alias("passes"))
